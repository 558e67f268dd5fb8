"""Point tables: ``point_id, lon, lat, outcome`` out of CSV files and of the driver's tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Dataset, dataset_path

#: What pandas, which wrote the files, reads as missing.
MISSING = ("", "NA", "NaN", "nan", "null", "NULL", "N/A", "n/a", "None", "<NA>", "#N/A", "-nan", "-NaN", "NAN")


@dataclass(frozen=True)
class Profile:
    """Totals and extent of a point table: one row, whatever its size."""

    n: int
    p: int
    lon_min: float | None
    lon_max: float | None
    lat_min: float | None
    lat_max: float | None
    lon_mean: float | None
    lat_mean: float | None

    @property
    def rate(self) -> float:
        return self.p / self.n if self.n else 0.0


def profile_frame(points: DataFrame) -> DataFrame:
    return points.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.col("outcome").cast("long")), F.lit(0)).cast("long").alias("p"),
        *(f(c).alias(f"{c}_{name}") for c in ("lon", "lat") for name, f in (("min", F.min), ("max", F.max))),
        *(F.avg(c).alias(f"{c}_mean") for c in ("lon", "lat")),
    )


def profile(points: DataFrame) -> Profile:
    return Profile(**profile_frame(points).first().asDict())


def normalised(rows: DataFrame, label: str, recode: tuple[tuple[int, int], ...] = ()) -> DataFrame:
    """Rows with ``lon``, ``lat`` and a label, without missing ones, and the label as a 0/1 ``outcome``.

    Recoding comes first, then the label is cut to a whole number (0.9 is 0). An outcome other than 0 or 1
    raises when the rows are computed. Other columns stay, with their nulls.
    """
    if missing := sorted({"lat", "lon", label} - set(rows.columns)):
        raise ValueError(f"Missing columns: {', '.join(missing)}")
    there: Column = F.lit(True)
    for c in ("lat", "lon", label):
        there &= F.col(c).isNotNull()
        if dict(rows.dtypes)[c] in ("double", "float"):
            there &= ~F.isnan(c)
    value = F.col(label).cast("double")
    for old, new in recode:
        value = F.when(value == old, F.lit(float(new))).otherwise(value)
    whole = value.cast("int")
    checked = F.when(whole.isin(0, 1), whole).otherwise(F.raise_error(F.concat(F.lit("outcome is not 0 or 1: "), whole.cast("string"))).cast("int"))
    return rows.where(there).withColumn("outcome", checked)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, without its first column (a row index), numbers where all values are.

    Spark knows one null marker; the usual ones are turned into nulls here, and a column becomes double if
    every value then parses.
    """
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    raw = raw.select(*(F.when(~F.trim(F.col(f"`{c}`")).isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in raw.columns[1:]))
    logical = {"true": "1", "false": "0"}
    as_number = {c: F.expr(f"try_cast(CASE lower(trim(`{c}`)) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in logical.items())} ELSE trim(`{c}`) END AS DOUBLE)") for c in raw.columns}
    bad = raw.agg(*(F.count(F.when(F.col(f"`{c}`").isNotNull() & as_number[c].isNull(), 1)).alias(c) for c in raw.columns)).first()
    return raw.select(*(as_number[c].alias(c) if not bad[c] else F.col(f"`{c}`") for c in raw.columns))


def numbered(rows: DataFrame) -> DataFrame:
    """``point_id`` from 0 in file order: rows of each partition are counted first, then every row's place follows.

    Spark's own row numbers hold the partition above 33 bits and the row in it below; only the totals, one row
    for each partition, are gathered and sent out again.
    """
    tagged = rows.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33))
    before, pairs = 0, []
    for part, n in sorted(tuple(r) for r in tagged.groupBy("__part").count().collect()):
        pairs.append((part, before))
        before += n
    bases = rows.sparkSession.createDataFrame(pairs, "__part long, __base long")
    place = F.col("__base") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return tagged.join(F.broadcast(bases), "__part").withColumn("point_id", place).drop("__at", "__part", "__base")


def load_dataset(spark: SparkSession, spec: Dataset, root: str = "datasets/old") -> DataFrame:
    """The points of a catalogued CSV file."""
    rows = normalised(read_csv(spark, dataset_path(spec, root)), spec.label, spec.recode)
    return numbered(rows.withColumns({"lon": F.col("lon").cast("double"), "lat": F.col("lat").cast("double")}))


def _blob(m: int, modulus: int) -> str:
    return f"((doc_id * {m}) % {modulus}) / {modulus}e0 * (1 + doc_id % 3)"


#: Points as projections of the driver's tables: source, id, longitude, latitude, outcome, further columns.
VIEWS: dict[str, tuple[str, str, str, str, str, tuple[str, ...]]] = {
    "events": ("events", "event_id", "value", "CAST(user_id AS DOUBLE)", "event_type = 'purchase'", ()),
    "biased": ("events", "event_id", "value", "CAST(user_id AS DOUBLE)", "(event_id * 7919) % 100 < CASE WHEN value < 30 AND user_id < 50 THEN 80 ELSE 30 END", ()),
    "fair": ("events", "event_id", "value", "CAST(user_id AS DOUBLE)", "(event_id * 7919) % 100 < 30", ()),
    "orders": ("orders JOIN customer ON o_custkey = c_custkey", "o_orderkey", "o_totalprice / 5000", "c_acctbal / 100", "o_orderstatus = 'F'", ()),
    "embed": ("embeddings", "vec_id", "CAST(embedding[{first}] AS DOUBLE) * 90", "CAST(embedding[{second}] AS DOUBLE) * 90", "label < 5", ("label",)),
    "blobs": ("documents", "doc_id", f"(doc_id % 5) * 20e0 + {_blob(7919, 101)}", f"(doc_id % 5) * 10e0 + {_blob(104729, 97)} + CASE WHEN doc_id % 11 = 0 THEN (doc_id * 31) % 40 ELSE 0 END", "(doc_id * 7919) % 100 < CASE WHEN doc_id % 5 = 2 THEN 80 ELSE 30 END", ()),
    "lineitem": ("lineitem", "CAST(NULL AS BIGINT)", "l_extendedprice", "CAST(l_quantity AS DOUBLE)", "l_returnflag = 'R'", ()),
}


def view_sql(name: str, first_index: int) -> str:
    """SELECT of a view, in SQL that Spark (arrays from 0) and DuckDB (from 1) both run."""
    source, key, lon, lat, outcome, more = VIEWS[name]
    lon, lat = (x.format(first=first_index, second=first_index + 1) for x in (lon, lat))
    return f"SELECT {key} AS point_id, {lon} AS lon, {lat} AS lat, CASE WHEN {outcome} THEN 1 ELSE 0 END AS outcome{''.join(', ' + c for c in more)} FROM {source}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view's points; only the columns that it needs are read."""
    sql = view_sql(name, 0)
    frames = {}
    for table in sorted({w for w in VIEWS[name][0].split() if w in ("events", "orders", "customer", "embeddings", "documents", "lineitem")}):
        frames[table] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if "customer" in frames:  # it grows with the orders, so it must not go through the driver to be broadcast
        frames["customer"] = frames["customer"].hint("merge")
    head, _, source = sql.partition(" FROM ")
    for table in frames:
        source = source.replace(table, f"{{{table}}}", 1)
    return spark.sql(f"{head} FROM {source}", **frames)

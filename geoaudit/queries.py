"""Registered queries over the driver's tables, each with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.scores import min_cluster_size, rounded
from .operators import hdbscan, layers
from .operators import regions as R
from .operators import significance as S
from .operators.kmeans import DIGITS, STEPS, SUMMARY_LEVELS
from .operators.scan import best_region, deviations, scored, variance_summary
from .plans.audit import MOST_BOXES
from .plans.report import params_json
from .sources.catalog import DATASETS, radius_values
from .sources.written import Rounds
from .sources.points import normalised, numbered, profile, profile_frame, view, view_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

GRID = 20
WORLDS, LEVEL, SEED = 20, 0.005, 82
RADII = [2.0, 4.0, 6.0, 8.0, 10.0]
CENTRES = [(10.0, 10.0), (25.5, 70.0), (50.0, 50.0), (90.0, 5.0), (75.0, 95.0)]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _pts(name: str) -> str:
    return f"pts AS ({view_sql(name, 1)})"


# --- SQL shared by the oracles ------------------------------------------------------------------------


def _cells_sql(n: int = GRID, m: int | None = None) -> str:
    """Cells of a grid of n columns and m rows (as many) with counts, by the closed range join."""
    m = m or n
    return f"""
b AS (SELECT min(lon) lo0, max(lon) lo1, min(lat) la0, max(lat) la1, count(*) nt, CAST(coalesce(sum(outcome), 0) AS BIGINT) pt FROM pts),
cells AS (
  SELECT CAST(i.id * {n} + j.id AS BIGINT) region_id, CAST(j.id AS INTEGER) j, CAST(i.id AS INTEGER) i,
    lo0 + (j.id / {n}e0) * (lo1 - lo0) lon_start, la0 + (i.id / {m}e0) * (la1 - la0) lat_start,
    lo0 + ((j.id + 1) / {n}e0) * (lo1 - lo0) lon_end, la0 + ((i.id + 1) / {m}e0) * (la1 - la0) lat_end, nt, pt
  FROM b, (SELECT unnest(range({m})) id) i, (SELECT unnest(range({n})) id) j),
st AS (
  SELECT region_id, j, i, lon_start, lat_start, lon_end, lat_end, nt, pt, count(outcome) n, CAST(coalesce(sum(outcome), 0) AS BIGINT) p
  FROM cells LEFT JOIN pts ON lon BETWEEN lon_start AND lon_end AND lat BETWEEN lat_start AND lat_end
  GROUP BY ALL)"""


def _xlp(x: str, p: str) -> str:
    return f"CASE WHEN {x} <= 0 OR {p} <= 0 THEN 0e0 ELSE ({x}) * ln({p}) END"


def _scored_sql(source: str, direction: str = "both") -> str:
    """CTE ``sc``: rho and sul of ``source``, which has region_id, n, p, nt, pt."""
    keep = {"both": "true", "less_in": "ri < ro", "less_out": "ri > ro"}[direction]
    return f"""
r AS (SELECT *, p / CAST(nullif(n, 0) AS DOUBLE) ri, (pt - p) / CAST(nullif(nt - n, 0) AS DOUBLE) ro, pt / CAST(nullif(nt, 0) AS DOUBLE) r0 FROM {source}),
sc AS (
  SELECT *, round(ri, 6) rho, round(CASE WHEN nt = 0 OR n = 0 OR n = nt OR NOT ({keep}) THEN 0e0 ELSE
    {_xlp("p", "ri")} + {_xlp("n - p", "1 - ri")} + {_xlp("pt - p", "ro")} + {_xlp("nt - n - (pt - p)", "1 - ro")}
    - ({_xlp("pt", "r0")} + {_xlp("nt - pt", "1 - r0")}) END, 6) + 0e0 sul FROM r)"""


def _grid_sql(name: str, direction: str = "both") -> str:
    return f"WITH {_pts(name)},{_cells_sql()},{_scored_sql('st', direction)}"


def _grid(spark: SparkSession, sf_dir: str, name: str):
    points = view(spark, sf_dir, name)
    p = profile(points)
    return points, p, R.grid_of(points, GRID, GRID, p).drop("grid_idx")


# --- loading -------------------------------------------------------------------------------------------

_RAW = "SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END AS lon, CASE WHEN event_id % 70 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS lat, CASE WHEN event_id % 90 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 3e0 WHEN event_id % 3 = 1 THEN 9e-1 ELSE 1e0 END AS action_taken, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS note FROM events"


@query("load_normalize", f"SELECT event_id, lon, lat, note, CAST(trunc(CASE WHEN action_taken = 3 THEN 0e0 ELSE action_taken END) AS INTEGER) AS outcome FROM ({_RAW}) WHERE lon IS NOT NULL AND lat IS NOT NULL AND action_taken IS NOT NULL")
def load_normalize(spark, sf_dir):
    raw = spark.sql(_RAW.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return normalised(raw, "action_taken", DATASETS["lar"].recode).select("event_id", "lon", "lat", "note", "outcome")


@query("row_numbers", "SELECT event_id, CAST(row_number() OVER () - 1 AS BIGINT) point_id FROM events")
def row_numbers(spark, sf_dir):
    """Rows of a file in its order."""
    return numbered(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id"))


@query("dataset_profile", f"WITH {_pts('orders')} SELECT count(*) n, CAST(sum(outcome) AS BIGINT) p, min(lon) lon_min, max(lon) lon_max, min(lat) lat_min, max(lat) lat_max, round(avg(lon), 6) lon_mean, round(avg(lat), 6) lat_mean, round(sum(outcome) / CAST(count(*) AS DOUBLE), 6) global_rate FROM pts")
def dataset_profile(spark, sf_dir):
    rows = profile_frame(view(spark, sf_dir, "orders"))
    return rows.withColumns({"lon_mean": F.round("lon_mean", 6), "lat_mean": F.round("lat_mean", 6), "global_rate": F.round(F.try_divide(F.col("p"), F.col("n")), 6)})


@query("radii_expand", "SELECT CAST(k - 1 AS BIGINT) radius_rank, round(k * 5e-2, 10) radius FROM (SELECT unnest(range(1, 21)) k)")
def radii_expand(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(radius_values(*DATASETS["lar"].radii))), "radius_rank long, radius double")


# --- grids -----------------------------------------------------------------------------------------------


@query("grid_cells", f"WITH {_pts('events')},{_cells_sql()} SELECT region_id, j, i, lon_start, lat_start, lon_end, lat_end FROM cells")
def grid_cells(spark, sf_dir):
    return R.grid_cells(R.one_grid(spark, GRID, GRID), profile(view(spark, sf_dir, "events"))).drop("grid_idx")


for _name in ("events", "biased", "fair", "orders", "lineitem"):

    @query(f"grid_stats_{_name}", f"{_grid_sql(_name)} SELECT region_id, n, p, rho FROM sc")
    def _grid_stats(spark, sf_dir, name=_name):
        _, p, cells = _grid(spark, sf_dir, name)
        return scored(cells, p.n, p.p).select("region_id", "n", "p", "rho")


for _way in ("both", "less_in", "less_out"):

    @query(f"grid_sul_{_way}", f"{_grid_sql('biased', _way)} SELECT region_id, n, p, rho, sul FROM sc")
    def _grid_sul(spark, sf_dir, way=_way):
        _, p, cells = _grid(spark, sf_dir, "biased")
        return scored(cells, p.n, p.p, way).select("region_id", "n", "p", "rho", "sul")


@query("grid_best_region", f"{_grid_sql('biased')} SELECT region_id, n, p, rho, sul FROM sc ORDER BY sul DESC, region_id LIMIT 1")
def grid_best_region(spark, sf_dir):
    _, p, cells = _grid(spark, sf_dir, "biased")
    return best_region(scored(cells, p.n, p.p).select("region_id", "n", "p", "rho", "sul"))


@query("grid_meanvar_scores", f"{_grid_sql('fair')} SELECT region_id, n, p, rho, round((rho - avg(rho) OVER ()) * (rho - avg(rho) OVER ()), 8) + 0e0 mv_score FROM sc")
def grid_meanvar_scores(spark, sf_dir):
    return deviations(_grid(spark, sf_dir, "fair")[2]).select("region_id", "n", "p", "rho", "mv_score")


_SUMMARY_SQL = """
mv AS (SELECT {keys} region_id, n, p, rho, round((rho - avg(rho) OVER ({part})) * (rho - avg(rho) OVER ({part})), 8) + 0e0 s FROM sc),
top AS (SELECT * FROM mv QUALIFY row_number() OVER ({part} ORDER BY coalesce(s, -1e0) DESC, region_id) = 1)
SELECT {keys} g.n_regions, g.meanvar, g.mean_score, g.max_score, top.region_id best_region_id, top.n best_n, top.p best_p, top.rho best_rho
FROM (SELECT {keys} count(*) n_regions, coalesce(round(var_pop(rho), 6) + 0e0, 0e0) meanvar, coalesce(round(avg(s), 6) + 0e0, 0e0) mean_score, coalesce(max(s), 0e0) max_score FROM mv {group}) g JOIN top {using}"""


@query("grid_meanvar", _grid_sql("fair") + "," + _SUMMARY_SQL.format(keys="", part="", group="", using="ON true"))
def grid_meanvar(spark, sf_dir):
    return variance_summary(_grid(spark, sf_dir, "fair")[2])


_SIZES = R.random_grids(8, seed=42)
_ALL_SIZES = R.random_grids(100, seed=42)


def _random_sql(sizes: list[tuple[int, int, int]]) -> str:
    cells = f"""WITH {_pts("orders")},
b AS (SELECT min(lon) lo0, max(lon) lo1, min(lat) la0, max(lat) la1, count(*) nt, CAST(sum(outcome) AS BIGINT) pt FROM pts),
g AS (SELECT CAST(column0 AS INTEGER) grid_idx, CAST(column1 AS INTEGER) lon_n, CAST(column2 AS INTEGER) lat_n FROM (VALUES {", ".join(map(str, sizes))}) v(column0, column1, column2)),
c AS (SELECT grid_idx, lon_n, lat_n, unnest(range(lon_n * lat_n)) k FROM g),
cells AS (
  SELECT grid_idx, CAST(k AS BIGINT) region_id, nt, pt,
    lo0 + (CAST(k % lon_n AS DOUBLE) / CAST(lon_n AS DOUBLE)) * (lo1 - lo0) xs, lo0 + (CAST(k % lon_n + 1 AS DOUBLE) / CAST(lon_n AS DOUBLE)) * (lo1 - lo0) xe,
    la0 + (CAST(k // lon_n AS DOUBLE) / CAST(lat_n AS DOUBLE)) * (la1 - la0) ys, la0 + (CAST(k // lon_n + 1 AS DOUBLE) / CAST(lat_n AS DOUBLE)) * (la1 - la0) ye FROM c, b),
st AS (
  SELECT grid_idx, region_id, nt, pt, count(outcome) n, CAST(coalesce(sum(outcome), 0) AS BIGINT) p
  FROM cells LEFT JOIN pts ON lon BETWEEN xs AND xe AND lat BETWEEN ys AND ye GROUP BY ALL),{_scored_sql("st")}"""
    return cells + "," + _SUMMARY_SQL.format(keys="grid_idx,", part="PARTITION BY grid_idx", group="GROUP BY grid_idx", using="USING (grid_idx)")


_RANDOM_SUMMARY = _random_sql(_SIZES)


def _random(spark, sf_dir, sizes=_SIZES):
    points = view(spark, sf_dir, "orders")
    return R.grid_stats(points, R.grid_table(spark, sizes), sizes, profile(points))


@query("random_grids_full", _random_sql(_ALL_SIZES))
def random_grids_full(spark, sf_dir):
    """All 100 grids of the published experiment, 59,089 cells."""
    return variance_summary(_random(spark, sf_dir, _ALL_SIZES), "grid_idx")


@query("random_grids_meanvar", _RANDOM_SUMMARY)
def random_grids_meanvar(spark, sf_dir):
    return variance_summary(_random(spark, sf_dir), "grid_idx")


@query("random_grids_summary", f"SELECT CAST(sum(n_regions) AS BIGINT) n_regions, round(avg(mean_score), 6) + 0e0 meanvar, max(max_score) meanvar_max_score FROM ({_RANDOM_SUMMARY})")
def random_grids_summary(spark, sf_dir):
    return variance_summary(_random(spark, sf_dir), "grid_idx").agg(F.sum("n_regions").alias("n_regions"), rounded(F.avg("mean_score")).alias("meanvar"), F.max("max_score").alias("meanvar_max_score"))


# --- seeds and squares -------------------------------------------------------------------------------------

_SEEDS_SQL = f"""{_pts("orders")},
ct AS (SELECT CAST(column0 AS INTEGER) seed_rank, CAST(column1 AS DOUBLE) x, CAST(column2 AS DOUBLE) y FROM (VALUES {", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(CENTRES))}) v(column0, column1, column2)),
sd AS (SELECT seed_rank, point_id center, lon, lat FROM ct, pts QUALIFY row_number() OVER (PARTITION BY seed_rank ORDER BY (lon - x) * (lon - x) + (lat - y) * (lat - y), point_id) = 1)"""


def _squares_sql(seeds: str, radii: list[float]) -> str:
    """CTEs up to ``sc``: squares round the seeds ``sd`` with counts, by the closed range join, and scores."""
    return f"""{seeds},
b AS (SELECT count(*) nt, CAST(sum(outcome) AS BIGINT) pt FROM pts),
sq AS MATERIALIZED (SELECT seed_rank * {len(radii)} + radius_rank region_id, seed_rank, radius_rank, center, radius, lon - radius lon_min, lat - radius lat_min, lon + radius lon_max, lat + radius lat_max
  FROM sd, (SELECT CAST(column0 AS INTEGER) radius_rank, CAST(column1 AS DOUBLE) radius FROM (VALUES {", ".join(f"({k}, {r})" for k, r in enumerate(radii))}) v(column0, column1))),
st AS (SELECT CAST(region_id AS BIGINT) region_id, seed_rank, radius_rank, center, radius, lon_min, lat_min, lon_max, lat_max, nt, pt, count(outcome) n, CAST(coalesce(sum(outcome), 0) AS BIGINT) p
  FROM sq CROSS JOIN b LEFT JOIN pts ON lon BETWEEN lon_min AND lon_max AND lat BETWEEN lat_min AND lat_max GROUP BY ALL),{_scored_sql("st")}"""


_SQUARES_SQL = _squares_sql(_SEEDS_SQL, RADII)


def _squares(spark, sf_dir):
    points = view(spark, sf_dir, "orders")
    seeds = R.nearest_points(points, CENTRES)
    p = profile(points)
    return points, p, seeds, scored(R.square_stats(points, seeds, RADII), p.n, p.p)


@query("nearest_seed", f"WITH {_SEEDS_SQL} SELECT seed_rank, center, lon, lat FROM sd")
def nearest_seed(spark, sf_dir):
    return R.nearest_points(view(spark, sf_dir, "orders"), CENTRES)


def _kmeans_sql(k: int, seed: int) -> str:
    """CTEs up to ``sd``, the seeds: centres drawn from the cells' means one after another, then moved over all points."""
    n, digits, uniform = 1 << SUMMARY_LEVELS, DIGITS, f"CAST(CAST('0x' || substr(md5('{seed}|' || step || '|' || cell), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496e0"
    wait = f"CASE WHEN away > 0 THEN -ln(1 - {uniform}) / (w * away) END"
    return f"""{_pts("orders")},
bx AS (SELECT min(lon) lo0, max(lon) lo1, min(lat) la0, max(lat) la1 FROM pts),
su AS (
  SELECT i * {n} + j cell, count(*) w, round(avg(lon), {digits}) x, round(avg(lat), {digits}) y
  FROM (SELECT lon, lat, CAST(least(floor((lon - lo0) / (lo1 - lo0) * {n}), {n - 1}) AS BIGINT) j, CAST(least(floor((lat - la0) / (la1 - la0) * {n}), {n - 1}) AS BIGINT) i FROM pts, bx) GROUP BY i, j),
dw AS (
  SELECT 0 step, cell, w, x, y, 1e0 away FROM su
  UNION ALL
  SELECT step + 1, cell, w, x, y, CASE WHEN step = 0 THEN d ELSE least(away, d) END
  FROM (SELECT *, (x - to_.x) * (x - to_.x) + (y - to_.y) * (y - to_.y) d FROM (SELECT *, arg_min({{'x': x, 'y': y}}, ({wait}, cell)) OVER () to_ FROM dw)) WHERE step < {k}),
fc AS (SELECT step c, x, y FROM dw WHERE step < {k} QUALIFY row_number() OVER (PARTITION BY step ORDER BY {wait}, cell) = 1),
ll AS (
  SELECT 0 step, c, x, y FROM fc
  UNION ALL
  SELECT any_value(step) + 1, c, coalesce(round(avg(lon), {digits}), any_value(x)), coalesce(round(avg(lat), {digits}), any_value(y))
  FROM (SELECT ll.*, near.lon, near.lat FROM ll LEFT JOIN (
    SELECT point_id, any_value(lon) lon, any_value(lat) lat, arg_min(c, ((lon - x) * (lon - x) + (lat - y) * (lat - y), c)) own FROM pts, ll GROUP BY point_id) near ON own = c)
  WHERE step < {STEPS} GROUP BY c),
sd AS (
  SELECT c seed_rank, point_id center, lon, lat FROM ll, pts WHERE step = {STEPS}
  QUALIFY row_number() OVER (PARTITION BY c ORDER BY (lon - x) * (lon - x) + (lat - y) * (lat - y), point_id) = 1)"""


@query("kmeans_seeds", f"WITH RECURSIVE {_kmeans_sql(20, 42)} SELECT CAST(seed_rank AS INTEGER) seed_rank, center, lon, lat FROM sd")
def kmeans_seeds(spark, sf_dir):
    """Points nearest to the centres of KMeans, as many as asked for."""
    return R.kmeans_seeds(view(spark, sf_dir, "orders"), 20, 42)


@query("square_stats", f"WITH {_SQUARES_SQL} SELECT region_id, seed_rank, radius_rank, center, radius, lon_min, lat_min, lon_max, lat_max, n, p FROM sc")
def square_stats(spark, sf_dir):
    return _squares(spark, sf_dir)[3].select("region_id", "seed_rank", "radius_rank", "center", "radius", "lon_min", "lat_min", "lon_max", "lat_max", "n", "p")


@query("square_sul", f"WITH {_SQUARES_SQL} SELECT region_id, n, p, rho, sul FROM sc")
def square_sul(spark, sf_dir):
    return _squares(spark, sf_dir)[3].select("region_id", "n", "p", "rho", "sul")


# --- significance ------------------------------------------------------------------------------------------


_IN_CELLS = "cells JOIN pts ON lon BETWEEN lon_start AND lon_end AND lat BETWEEN lat_start AND lat_end"
_IN_SQUARES = "sq JOIN pts ON lon BETWEEN lon_min AND lon_max AND lat BETWEEN lat_min AND lat_max"


def _worlds_sql(members: str, worlds: int = WORLDS) -> str:
    uniform = f"CAST(CAST('0x' || substr(md5('{SEED}|' || w || '|' || point_id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496e0"
    return f"""
mem AS (SELECT region_id, point_id FROM {members}),
ws AS (SELECT CAST(unnest(range({worlds})) AS INTEGER) w),
hit AS (SELECT w, point_id FROM ws, pts, b WHERE {uniform} < pt / CAST(nt AS DOUBLE)),
dr AS (SELECT w, region_id, count(*) p FROM hit JOIN mem USING (point_id) GROUP BY ALL),
wr AS (SELECT w, st.region_id, n, coalesce(dr.p, 0) p, nt, pt FROM st CROSS JOIN ws LEFT JOIN dr USING (w, region_id))"""


def _maxima_of(regions: str, members: str) -> str:
    """CTE ``mx``, the largest score of each world, after the CTEs of ``regions``."""
    inner = _scored_sql("wr").replace("r AS (", "wr1 AS (", 1).replace("FROM r)", "FROM wr1)").replace("sc AS (", "wsc AS (")
    return f"{regions},{_worlds_sql(members)},{inner},mx AS (SELECT w AS world, max(sul) max_sul FROM wsc GROUP BY w)"


def _maxima_sql(name: str) -> str:
    return f"WITH {_maxima_of(f'{_pts(name)},{_cells_sql()}', _IN_CELLS)}"


def _maxima(spark, sf_dir, name):
    points, p, cells = _grid(spark, sf_dir, name)
    maxima = S.world_maxima(R.with_cells(points, p, GRID, GRID), cells, p.n, p.p, WORLDS, SEED, "portable")
    return points, p, scored(cells, p.n, p.p), maxima


@query("alt_world_max", f"{_maxima_sql('biased')} SELECT world, max_sul FROM mx")
def alt_world_max(spark, sf_dir):
    return _maxima(spark, sf_dir, "biased")[3]


_THRESHOLD_SQL = f"th AS (SELECT max_sul threshold FROM mx ORDER BY max_sul DESC LIMIT 1 OFFSET {S.threshold_rank(WORLDS, LEVEL)})"

for _name in ("biased", "fair", "events"):

    @query(f"signif_threshold_{_name}", f"{_maxima_sql(_name)},{_THRESHOLD_SQL} SELECT threshold FROM th")
    def _signif_threshold(spark, sf_dir, name=_name):
        return S.threshold(_maxima(spark, sf_dir, name)[3], WORLDS, LEVEL)


@query("significant_regions", f"{_maxima_sql('biased')},{_THRESHOLD_SQL},{_scored_sql('st')} SELECT region_id, n, p, rho, sul, CAST(row_number() OVER (ORDER BY sul DESC, region_id DESC) AS INTEGER) rank FROM sc, th WHERE sul >= threshold")
def significant_regions(spark, sf_dir):
    _, _, scores, maxima = _maxima(spark, sf_dir, "biased")
    return S.significant(scores, S.threshold(maxima, WORLDS, LEVEL)).select("region_id", "n", "p", "rho", "sul", "rank")


@query("alt_world_max_binomial")
def alt_world_max_binomial(spark, sf_dir):
    points, p, cells = _grid(spark, sf_dir, "biased")
    return S.world_maxima(R.with_cells(points, p, GRID, GRID), cells, p.n, p.p, 200, SEED)


def _rows_of_grids(spark, sf_dir, worlds: int, mode: str):
    """Both grids of the largest published experiment: a row for each significant cell, or for a grid without any."""
    points, out = view(spark, sf_dir, "biased"), None
    p = profile(points)
    for x, y in DATASETS["lar"].grids:
        cells = R.grid_of(points, x, y, p)
        maxima = S.world_maxima(R.with_cells(points, p, x, y), cells, p.n, p.p, worlds, SEED + x + y, mode)
        limit = S.threshold(maxima, worlds, LEVEL)
        hits = S.significant(scored(cells, p.n, p.p), limit).select("region_id", "n", "p", "sul", "rank")
        grid = limit.crossJoin(F.broadcast(hits.agg(F.count("*").alias("n_significant")))).crossJoin(F.broadcast(cells.agg(F.count("*").alias("n_regions"))))
        rows = grid.join(hits, F.lit(True), "left").select(F.lit(x).alias("lon_n"), F.lit(y).alias("lat_n"), "threshold", "n_regions", "n_significant", "region_id", "n", "p", "sul", "rank")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("grid_worlds_full")
def grid_worlds_full(spark, sf_dir):
    """5,300 cells with the 1,000 worlds of the published experiment for each grid."""
    return _rows_of_grids(spark, sf_dir, 1000, "binomial")


def _rows_of_grids_sql() -> str:
    """The same with worlds that SQL can draw too."""
    parts = []
    for x, y in DATASETS["lar"].grids:
        of = _maxima_of(f"{_pts('biased')},{_cells_sql(x, y)}", _IN_CELLS).replace(f"'{SEED}|'", f"'{SEED + x + y}|'")
        parts.append(f"""(WITH {of},{_THRESHOLD_SQL},{_scored_sql("st")},
h AS (SELECT region_id, n, p, sul, CAST(row_number() OVER (ORDER BY sul DESC, region_id DESC) AS INTEGER) rank FROM sc, th WHERE sul >= threshold)
SELECT CAST({x} AS INTEGER) lon_n, CAST({y} AS INTEGER) lat_n, threshold, (SELECT count(*) FROM st) n_regions, (SELECT count(*) FROM h) n_significant, h.* FROM th LEFT JOIN h ON true)""")
    return " UNION ALL ".join(parts)


@query("grid_worlds_portable", _rows_of_grids_sql())
def grid_worlds_portable(spark, sf_dir):
    """The same grids whole, with fewer worlds, drawn point by point as SQL can."""
    return _rows_of_grids(spark, sf_dir, WORLDS, "portable")


@query("square_worlds_full")
def square_worlds_full(spark, sf_dir):
    """The published free scan: 100 KMeans seeds by 20 radii, 200 worlds, ranked and pruned."""
    points, radii = view(spark, sf_dir, "orders"), _MANY_RADII
    p, seeds, rounds = profile(points), R.kmeans_seeds(points, _MANY_SEEDS, 42), Rounds(spark, "scan")
    scores = rounds.kept(scored(R.square_stats(points, seeds, radii), p.n, p.p))
    maxima = S.world_maxima(R.with_square_ids(points, seeds, radii, True), scores, p.n, p.p, 200, SEED, "fast", len(radii))
    limit = rounds.kept(S.threshold(maxima, 200, LEVEL))
    ranked = scores.crossJoin(limit).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("sul"), F.desc("region_id"))))
    kept = S.pruned(ranked.where("sul >= threshold")).select("region_id", "kept_rank")
    return ranked.join(kept, "region_id", "left").select("region_id", "center", "radius", "n", "p", "sul", "threshold", "rank", "kept_rank")


@query("square_worlds_fast")
def square_worlds_fast(spark, sf_dir):
    points, p, seeds, scores = _squares(spark, sf_dir)
    return S.world_maxima(R.with_square_ids(points, seeds, RADII), scores, p.n, p.p, WORLDS, SEED, "fast")


_MEET = "a.lon_max >= b.lon_min AND b.lon_max >= a.lon_min AND a.lat_max >= b.lat_min AND b.lat_max >= a.lat_min"


@query("region_overlap_pairs", f"WITH {_SQUARES_SQL} SELECT a.region_id a, b.region_id b FROM sc a JOIN sc b ON a.region_id < b.region_id AND {_MEET}")
def region_overlap_pairs(spark, sf_dir):
    return S.overlapping_pairs(_squares(spark, sf_dir)[3])


#: Greedy pruning of ``rk`` (rank and box): ``f``, the ranks that are kept.
_PRUNED_SQL = f"""
g AS (SELECT 0 k, []::STRUCT(rank INTEGER, lon_min DOUBLE, lat_min DOUBLE, lon_max DOUBLE, lat_max DOUBLE)[] kept
  UNION ALL SELECT k + 1, CASE WHEN len(list_filter(kept, lambda b: {_MEET.replace("a.", "rk.")})) > 0 THEN kept
    ELSE list_append(kept, {{'rank': rk.rank, 'lon_min': rk.lon_min, 'lat_min': rk.lat_min, 'lon_max': rk.lon_max, 'lat_max': rk.lat_max}}) END
  FROM g JOIN rk ON rk.rank = g.k + 1),
f AS (SELECT unnest(kept).rank rank FROM (SELECT kept FROM g ORDER BY k DESC LIMIT 1))"""
_RANK = "CAST(row_number() OVER (ORDER BY sul DESC, region_id DESC) AS INTEGER) rank"


@query(
    "non_overlapping",
    f"""WITH RECURSIVE {_SQUARES_SQL},
rk AS (SELECT *, {_RANK} FROM sc),{_PRUNED_SQL}
SELECT rk.region_id, rk.rank, CAST(row_number() OVER (ORDER BY rank) AS INTEGER) kept_rank, n, p, sul FROM f JOIN rk USING (rank)""",
)
def non_overlapping(spark, sf_dir):
    scores = _squares(spark, sf_dir)[3]
    ranked = S.significant(scores, spark.createDataFrame([(-1.0,)], "threshold double"))
    return S.pruned(ranked).select("region_id", "rank", "kept_rank", "n", "p", "sul")


@query(
    "map_boxes",
    f"""{_grid_sql("biased").replace("WITH", "WITH RECURSIVE", 1)},
rk AS (SELECT region_id, lon_start lon_min, lat_start lat_min, lon_end lon_max, lat_end lat_max, sul, {_RANK} FROM sc),{_PRUNED_SQL}
SELECT region_id, lon_min, lat_min, lon_max, lat_max, sul, CAST(row_number() OVER (ORDER BY rank) AS INTEGER) kept_rank FROM f JOIN rk USING (rank) QUALIFY kept_rank <= {MOST_BOXES}""",
)
def map_boxes(spark, sf_dir):
    """The first boxes that a map shows of all 400 cells, ranked and pruned: cells next to each other meet."""
    _, p, cells = _grid(spark, sf_dir, "biased")
    boxes = scored(cells, p.n, p.p).withColumnsRenamed({"lon_start": "lon_min", "lat_start": "lat_min", "lon_end": "lon_max", "lat_end": "lat_max"})
    ranked = S.significant(boxes, spark.createDataFrame([(-1.0,)], "threshold double"))
    return S.pruned(ranked).where(F.col("kept_rank") <= MOST_BOXES).select("region_id", "lon_min", "lat_min", "lon_max", "lat_max", "sul", "kept_rank")


# --- clusters ------------------------------------------------------------------------------------------------

FRACTIONS = (0.005, 0.01, 0.02)


@query("min_cluster_sizes", f"SELECT fraction, CAST(greatest(25, round_even(fraction * (SELECT count(*) FROM events), 0)) AS INTEGER) min_size FROM (SELECT CAST(unnest({list(FRACTIONS)}) AS DOUBLE) fraction)")
def min_cluster_sizes(spark, sf_dir):
    n = profile(view(spark, sf_dir, "events")).n
    return spark.createDataFrame([(f, min_cluster_size(f, n, 25)) for f in FRACTIONS], "fraction double, min_size int")


def _blobs(spark, sf_dir):
    points = view(spark, sf_dir, "blobs")
    return points, hdbscan.clusterings(points)


@query("hdbscan_members")
def hdbscan_members(spark, sf_dir):
    """All members of each cluster, named by the least one's blob. SQL cannot tell which planted outliers are taken in."""
    points, found = _blobs(spark, sf_dir)
    members = found[0].regions().join(points, "point_id")
    least = members.groupBy("cluster_label").agg(F.min("point_id").alias("first"), F.count("*").alias("n"), F.sum("outcome").alias("p"))
    return least.select((F.col("first") % 5).cast("int").alias("blob"), "n", "p")


@query("hdbscan_labels")
def hdbscan_labels(spark, sf_dir):
    return _blobs(spark, sf_dir)[1][0].labels


@query("hdbscan_noise")
def hdbscan_noise(spark, sf_dir):
    points, found = _blobs(spark, sf_dir)
    return found[0].noise().join(points, "point_id")


@query("hdbscan_eval")
def hdbscan_eval(spark, sf_dir):
    points, found = _blobs(spark, sf_dir)
    p, out = profile(points), None
    for c in found:
        stats = R.counted(c.regions().join(points, "point_id").withColumn("region_id", F.col("cluster_label").cast("long")), "region_id")
        row = scored(stats, p.n, p.p).withColumn("fraction", F.lit(c.fraction)).withColumn("min_size", F.lit(c.min_size))
        out = row if out is None else out.unionByName(row)
    return out


# --- layers and reports ----------------------------------------------------------------------------------------


@query(
    "stratified_sample",
    f"""WITH {_pts("events")},
h AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY md5('42|' || point_id), point_id) k, count(*) OVER () nt, CAST(sum(outcome) OVER () AS BIGINT) pt FROM pts)
SELECT point_id, lon, lat, outcome, CASE WHEN outcome = 1 THEN '{layers.POSITIVE}' ELSE '{layers.NEGATIVE}' END color FROM h
WHERE nt <= 500 OR k <= CASE WHEN outcome = 1 THEN least(pt, 250) ELSE 500 - least(pt, 250) END""",
)
def stratified_sample(spark, sf_dir):
    return layers.stratified_sample(view(spark, sf_dir, "events"), 500, 42)


@query("group_bounds", f"WITH {_pts('embed')} SELECT label, min(lon) lon_min, min(lat) lat_min, max(lon) lon_max, max(lat) lat_max FROM pts GROUP BY label")
def group_bounds(spark, sf_dir):
    return layers.bounds(view(spark, sf_dir, "embed"), "label")


@query(
    "group_hull",
    f"""WITH {_pts("embed")}, d AS (SELECT DISTINCT label, lon, lat FROM pts),
e AS (SELECT a.label, a.lon, a.lat, b.lon blon, b.lat blat FROM d a JOIN d b ON a.label = b.label AND (a.lon <> b.lon OR a.lat <> b.lat)),
bad AS (SELECT DISTINCT e.label, e.lon, e.lat, blon, blat FROM e JOIN d c ON e.label = c.label WHERE (blon - e.lon) * (c.lat - e.lat) - (blat - e.lat) * (c.lon - e.lon) < 0)
SELECT DISTINCT label, lon, lat FROM e ANTI JOIN bad USING (label, lon, lat, blon, blat)""",
)
def group_hull(spark, sf_dir):
    rows = layers.hulls(view(spark, sf_dir, "embed"), "label")
    return rows.select("label", F.explode("hull").alias("v")).select("label", "v.lon", "v.lat")


_GRID_PARAMS = params_json({"lon_n": GRID, "lat_n": GRID})


@query(
    "report_one_partitioning",
    f"""{_maxima_sql("biased")},{_THRESHOLD_SQL},{_scored_sql("st")},
mv AS (SELECT region_id, n, p, rho, round((rho - avg(rho) OVER ()) * (rho - avg(rho) OVER ()), 8) + 0e0 s FROM sc),
best AS (SELECT * FROM sc ORDER BY sul DESC, region_id LIMIT 1),
mbest AS (SELECT * FROM mv ORDER BY coalesce(s, -1e0) DESC, region_id LIMIT 1)
SELECT 'one_partitioning' experiment, 'biased' dataset, 'grid' "method", '{_GRID_PARAMS}' params, best.nt n_points, best.pt p_points, round(best.pt / CAST(best.nt AS DOUBLE), 6) global_rate,
  (SELECT count(*) FROM sc) n_regions, best.sul max_sul, threshold signif_threshold, (SELECT count(*) FROM sc, th WHERE sul >= threshold) significant_regions,
  (SELECT round(var_pop(rho), 6) + 0e0 FROM mv) meanvar, (SELECT max(s) FROM mv) meanvar_max_score,
  best.n best_region_n, best.p best_region_p, best.rho best_region_rate, mbest.n meanvar_best_n, mbest.p meanvar_best_p, mbest.rho meanvar_best_rate
FROM best, mbest, th""",
)
def report_one_partitioning(spark, sf_dir):
    points, p, scores, maxima = _maxima(spark, sf_dir, "biased")
    limit = S.threshold(maxima, WORLDS, LEVEL)
    best = best_region(scores).select(F.col("sul").alias("max_sul"), F.col("n").alias("best_region_n"), F.col("p").alias("best_region_p"), F.col("rho").alias("best_region_rate"))
    variance = variance_summary(scores.select("region_id", "n", "p")).select("n_regions", "meanvar", F.col("max_score").alias("meanvar_max_score"), F.col("best_n").alias("meanvar_best_n"), F.col("best_p").alias("meanvar_best_p"), F.col("best_rho").alias("meanvar_best_rate"))
    hits = S.significant(scores, limit).agg(F.count("*").alias("significant_regions"))
    row = best.crossJoin(variance).crossJoin(limit.withColumnRenamed("threshold", "signif_threshold")).crossJoin(hits)
    fixed = {"experiment": "one_partitioning", "dataset": "biased", "method": "grid", "params": _GRID_PARAMS}
    return row.withColumns({k: F.lit(v) for k, v in fixed.items()} | {"n_points": F.lit(p.n).cast("long"), "p_points": F.lit(p.p).cast("long"), "global_rate": F.round(F.lit(p.rate), 6)})


_GRIDS_PARAMS = [(k, params_json({"partitioning_idx": k, "lon_n": x, "lat_n": y})) for k, x, y in _SIZES]
_ALL_PARAMS = params_json({"n_partitionings": len(_SIZES), "lat_n_range": [10, 40], "lon_n_range": [10, 40]})


@query(
    "report_multiple",
    f"""WITH d AS ({_RANDOM_SUMMARY}), pa AS (SELECT CAST(column0 AS INTEGER) grid_idx, column1 params FROM (VALUES {", ".join(f"({k}, '{text}')" for k, text in _GRIDS_PARAMS)}) v(column0, column1))
SELECT 'multiple_partitionings' experiment, 'random_grid' "method", params, n_regions, meanvar, max_score meanvar_max_score, best_n best_region_n, best_p best_region_p, best_rho best_region_rate FROM d JOIN pa USING (grid_idx)
UNION ALL SELECT 'multiple_partitionings', 'random_grid_summary', '{_ALL_PARAMS}', CAST(sum(n_regions) AS BIGINT), round(avg(mean_score), 6) + 0e0, max(max_score), 0, 0, NULL FROM d""",
)
def report_multiple(spark, sf_dir):
    """A row for each grid, and the summary's."""
    grids = variance_summary(_random(spark, sf_dir), "grid_idx").join(F.broadcast(spark.createDataFrame(_GRIDS_PARAMS, "grid_idx int, params string")), "grid_idx")
    detail = grids.select(F.lit("random_grid").alias("method"), "params", "n_regions", "meanvar", F.col("max_score").alias("meanvar_max_score"), F.col("best_n").alias("best_region_n"), F.col("best_p").alias("best_region_p"), F.col("best_rho").alias("best_region_rate"))
    whole = grids.agg(F.sum("n_regions").alias("n_regions"), rounded(F.avg("mean_score")).alias("meanvar"), F.max("max_score").alias("meanvar_max_score"))
    fixed = {"method": F.lit("random_grid_summary"), "params": F.lit(_ALL_PARAMS), "best_region_n": F.lit(0).cast("long"), "best_region_p": F.lit(0).cast("long")}
    return detail.unionByName(whole.withColumns(fixed), allowMissingColumns=True).withColumn("experiment", F.lit("multiple_partitionings"))


def _unrestricted_sql(squares: str) -> str:
    """The row of the free scan after the CTEs of ``squares``."""
    return f"""WITH RECURSIVE {_maxima_of(squares, _IN_SQUARES)},{_THRESHOLD_SQL},
rk AS (SELECT sc.*, {_RANK} FROM sc, th WHERE sul >= threshold),{_PRUNED_SQL}
SELECT 'unrestricted' experiment, 'squares' "method", max(nt) n_points, max(pt) p_points, count(*) n_regions, max(sul) max_sul, any_value(threshold) signif_threshold,
  (SELECT count(*) FROM rk) significant_regions, (SELECT count(*) FROM f) non_overlapping_regions,
  arg_max(n, (sul, -region_id)) best_region_n, arg_max(p, (sul, -region_id)) best_region_p FROM sc, th"""


def _unrestricted(points, p, seeds, radii):
    rounds = Rounds(points.sparkSession, "scan")  # a few rows, for each of which all points are gone through
    scores = rounds.kept(scored(R.square_stats(points, seeds, radii), p.n, p.p))
    limit = rounds.kept(S.threshold(S.world_maxima(R.with_square_ids(points, seeds, radii, True), scores, p.n, p.p, WORLDS, SEED, "portable", len(radii)), WORLDS, LEVEL))
    ranked = S.significant(scores, limit)
    top = F.struct("sul", -F.col("region_id"))
    row = scores.agg(F.count("*").alias("n_regions"), F.max("sul").alias("max_sul"), F.max_by("n", top).alias("best_region_n"), F.max_by("p", top).alias("best_region_p"))
    row = row.crossJoin(limit.withColumnRenamed("threshold", "signif_threshold")).crossJoin(ranked.agg(F.count("*").alias("significant_regions")))
    row = row.crossJoin(S.pruned(ranked).agg(F.count("*").alias("non_overlapping_regions")))
    return row.withColumns({"experiment": F.lit("unrestricted"), "method": F.lit("squares"), "n_points": F.lit(p.n).cast("long"), "p_points": F.lit(p.p).cast("long")})


@query("report_unrestricted", _unrestricted_sql(_SQUARES_SQL))
def report_unrestricted(spark, sf_dir):
    """The scan with its threshold, ranking and pruning, around fixed places."""
    points = view(spark, sf_dir, "orders")
    return _unrestricted(points, profile(points), R.nearest_points(points, CENTRES), RADII)


_MANY_SEEDS, _MANY_RADII = 100, [0.5 * k for k in range(1, 21)]


@query("report_unrestricted_full", _unrestricted_sql(_squares_sql(_kmeans_sql(_MANY_SEEDS, 42), _MANY_RADII)))
def report_unrestricted_full(spark, sf_dir):
    """The same at the published size: 100 seeds of its own by 20 radii; with as many worlds as SQL draws point by point."""
    points = view(spark, sf_dir, "orders")
    return _unrestricted(points, profile(points), R.kmeans_seeds(points, _MANY_SEEDS, 42), _MANY_RADII)


from . import structure_queries, table_queries  # noqa: E402, F401  they register their queries here

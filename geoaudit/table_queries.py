"""Registered queries on what goes in and out: CSV files, the rows of maps, the evaluation of clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import regions as R
from .operators import significance as S
from .operators.dbscan import dbscan
from .operators.scan import best_region, scored, variance_summary
from .plans.report import write_frame_by_dataset
from .queries import _RAW, _RANDOM_SUMMARY, _THRESHOLD_SQL, LEVEL, SEED, WORLDS, _maxima, _maxima_sql, _random, _scored_sql, _worlds_sql, query
from .sources.catalog import DATASETS
from .sources.maps import STYLE, cluster_shapes, map_data, map_rows
from .sources.points import normalised, numbered, profile, read_csv, view
from .sources.written import Rounds
from .structure_queries import _DENSE, _HULL_SQL, _dbscan_sql

# --- CSV files ------------------------------------------------------------------------------------------

#: Raw rows with missing values of several spellings, and notes with commas and quotes.
_MESSY = f"""SELECT event_id AS idx, CAST(lat AS {{text}}) AS lat, CASE WHEN event_id % 60 = 0 THEN 'N/A' ELSE CAST(lon AS {{text}}) END AS lon,
  CASE WHEN event_id % 110 = 0 THEN 'nan' ELSE CAST(action_taken AS {{text}}) END AS action_taken, event_id, note || ', "' || event_id || '"' AS note FROM ({_RAW})"""


@query(
    "csv_scan",
    f"SELECT CAST(event_id AS DOUBLE) event_id, lat, lon, action_taken, CASE WHEN note IS NOT NULL THEN note || ', \"' || event_id || '\"' END note, CAST(trunc(CASE WHEN action_taken = 3 THEN 0e0 ELSE action_taken END) AS INTEGER) outcome FROM ({_RAW}) WHERE lat IS NOT NULL AND lon IS NOT NULL AND action_taken IS NOT NULL AND event_id % 60 <> 0 AND event_id % 110 <> 0",
)
def csv_scan(spark, sf_dir):
    """Raw rows written as CSV and loaded as a dataset's file is: first column dropped, types told, missing rows out, labels recoded."""
    raw = spark.sql(_MESSY.format(text="STRING").replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    path = Rounds(spark, "csv").path()
    raw.write.option("header", True).option("escape", '"').csv(path)
    rows = numbered(normalised(read_csv(spark, path), "action_taken", DATASETS["lar"].recode))
    return rows.select("event_id", "lat", "lon", "action_taken", "note", "outcome")


@query(
    "csv_by_dataset",
    f"""SELECT 'grids_' || coalesce(dataset, 'None') || '.csv' file, dataset, grid_idx, n_regions, meanvar, mean_score, max_score, best_region_id, best_n, best_p, best_rho
FROM (SELECT *, CASE WHEN grid_idx % 3 = 0 THEN NULL WHEN grid_idx % 3 = 1 THEN 'a' ELSE 'b "c"' END dataset FROM ({_RANDOM_SUMMARY}))""",
)
def csv_by_dataset(spark, sf_dir):
    """Result rows written to one CSV table for each dataset, missing names among them, and read back from all."""
    rows = variance_summary(_random(spark, sf_dir), "grid_idx").withColumn("dataset", F.when(F.col("grid_idx") % 3 == 1, "a").when(F.col("grid_idx") % 3 == 2, 'b "c"'))
    folder = Rounds(spark, "csv").path()
    out = None
    for path in write_frame_by_dataset(rows, folder, "grids_{dataset}.csv"):
        back = spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(path).withColumn("file", F.lit(path.rsplit("/", 1)[1]))
        out = back if out is None else out.unionByName(back)
    return out


# --- maps -----------------------------------------------------------------------------------------------

_MOST = 300


@query(
    "map_layers",
    f"""{_maxima_sql("biased")},{_THRESHOLD_SQL},{_scored_sql("st")},
h AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY md5('42|' || point_id), point_id) k, CAST(sum(outcome) OVER () AS BIGINT) pt FROM pts)
SELECT 'center' layer, round(avg(lon), 6) lon_min, round(avg(lat), 6) lat_min, round(avg(lon), 6) lon_max, round(avg(lat), 6) lat_max, NULL color, 'zoom {STYLE["zoom"]}' title FROM pts
UNION ALL SELECT 'extent', round(min(lon), 6), round(min(lat), 6), round(max(lon), 6), round(max(lat), 6), NULL, NULL FROM pts
UNION ALL SELECT 'point', round(lon, 6), round(lat, 6), round(lon, 6), round(lat, 6), CASE WHEN outcome = 1 THEN '#2ca25f' ELSE '#de2d26' END, NULL FROM h WHERE k <= CASE WHEN outcome = 1 THEN least(pt, {_MOST // 2}) ELSE {_MOST} - least(pt, {_MOST // 2}) END
UNION ALL SELECT 'box', round(lon_start, 6), round(lat_start, 6), round(lon_end, 6), round(lat_end, 6), '{STYLE["grid"]["color"]}', '{STYLE["grid"]["title"]}' FROM sc, th WHERE sul >= threshold""",
)
def map_layers(spark, sf_dir):
    """All that the map of a grid shows: middle, extent, sampled points with colours, significant cells."""
    points, p, scores, maxima = _maxima(spark, sf_dir, "biased")
    hits = [r.asDict() for r in S.significant(scores, S.threshold(maxima, WORLDS, LEVEL)).collect()]
    rows = spark.createDataFrame(map_rows(map_data(points, p, grid=hits, most=_MOST)), "layer string, lon_min double, lat_min double, lon_max double, lat_max double, color string, title string")
    return rows.withColumns({c: F.round(c, 6) for c in ("lon_min", "lat_min", "lon_max", "lat_max")})


@query(
    "map_hulls",
    f"""WITH {_HULL_SQL}, g AS (SELECT label, count(*) n, sum(outcome) p FROM pts GROUP BY label), c AS (SELECT label, count(*) corners, min(ax) lon_min, min(ay) lat_min, max(ax) lon_max, max(ay) lat_max FROM side GROUP BY label)
SELECT label, corners, lon_min, lat_min, lon_max, lat_max, printf('HDBSCAN cluster=%d, n=%d, p=%d, rho=%.3f', label, n, CAST(p AS BIGINT), p / CAST(n AS DOUBLE)) title FROM g JOIN c USING (label)""",
)
def map_hulls(spark, sf_dir):
    """Hulls, bounds and tooltips of groups, as the map draws clusters; in the order of their labels."""
    points = view(spark, sf_dir, "embed")
    shapes = cluster_shapes(points.select("point_id", "lon", "lat", "outcome"), points.select("point_id", F.col("label").alias("cluster_label")))
    rows = [(s["cluster_label"], len(s["hull"]), s["lon_min"], s["lat_min"], s["lon_max"], s["lat_max"], s["title"]) for s in shapes]
    return spark.createDataFrame(rows, "label int, corners long, lon_min double, lat_min double, lon_max double, lat_max double, title string")


# --- clusters as regions --------------------------------------------------------------------------------


@query(
    "cluster_report",
    f"""{_dbscan_sql("blobs", *_DENSE)},
b AS (SELECT count(*) nt, CAST(sum(outcome) AS BIGINT) pt FROM pts),
st AS (SELECT cluster region_id, nt, pt, count(*) n, CAST(sum(outcome) AS BIGINT) p FROM db JOIN pts USING (point_id), b WHERE cluster IS NOT NULL GROUP BY ALL){_worlds_sql("(SELECT cluster region_id, point_id FROM db WHERE cluster IS NOT NULL)").replace("mem AS", ", mem AS", 1)},
{_scored_sql("wr").replace("r AS (", "wr1 AS (", 1).replace("FROM r)", "FROM wr1)").replace("sc AS (", "wsc AS (")}, mx AS (SELECT w AS world, max(sul) max_sul FROM wsc GROUP BY w),{_THRESHOLD_SQL},{_scored_sql("st")},
best AS (SELECT * FROM sc ORDER BY sul DESC, region_id LIMIT 1), no AS (SELECT count(*) noise_n FROM db WHERE kind = 'noise')
SELECT best.nt n_points, best.pt p_points, (SELECT count(*) FROM sc) n_regions, best.sul max_sul, threshold signif_threshold, (SELECT count(*) FROM sc, th WHERE sul >= threshold) significant_regions,
  (SELECT round(var_pop(rho), 6) + 0e0 FROM sc) meanvar, noise_n, round(noise_n / CAST(best.nt AS DOUBLE), 6) noise_rate, best.region_id best_region_id, best.n best_region_n, best.p best_region_p, best.rho best_region_rate FROM best, th, no""",
)
def cluster_report(spark, sf_dir):
    """The evaluation of a clustering as regions: scores, threshold, significant clusters, variance of rates, and noise."""
    points = view(spark, sf_dir, "blobs")
    p = profile(points)
    labels = Rounds(spark, "clusters").kept(dbscan(points, *_DENSE))
    members = labels.where("cluster is not null").join(points, "point_id").select("point_id", "outcome", F.col("cluster").alias("region_id"))
    stats = R.counted(members, "region_id")
    scores = scored(stats, p.n, p.p)
    maxima = S.world_maxima(members.withColumn("region_ids", F.array("region_id")), stats, p.n, p.p, WORLDS, SEED, "portable")
    limit = S.threshold(maxima, WORLDS, LEVEL)
    best = best_region(scores).select(F.col("sul").alias("max_sul"), F.col("region_id").alias("best_region_id"), F.col("n").alias("best_region_n"), F.col("p").alias("best_region_p"), F.col("rho").alias("best_region_rate"))
    row = best.crossJoin(variance_summary(stats).select("n_regions", "meanvar")).crossJoin(limit.withColumnRenamed("threshold", "signif_threshold"))
    row = row.crossJoin(S.significant(scores, limit).agg(F.count("*").alias("significant_regions"))).crossJoin(labels.where("kind = 'noise'").agg(F.count("*").alias("noise_n")))
    return row.withColumns({"n_points": F.lit(p.n).cast("long"), "p_points": F.lit(p.p).cast("long"), "noise_rate": F.round(F.col("noise_n") / F.lit(float(max(p.n, 1))), 6)})

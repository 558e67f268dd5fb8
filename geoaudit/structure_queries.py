"""Registered queries on how points lie: autocorrelation, neighbours, density clusters, scales."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.scores import rounded
from .operators import autocorrelation as A
from .operators import communities as C
from .operators import layers
from .operators import neighbours as N
from .operators import polygons as G
from .operators import pyramid as P
from .operators import regions as R
from .operators.dbscan import cluster_table, dbscan
from .operators.delaunay import delaunay
from .operators.scan import scored
from .queries import GRID, SEED, _cells_sql, _pts, _scored_sql, query
from .sources.points import profile, view
from .sources.written import Rounds

# --- autocorrelation ------------------------------------------------------------------------------------

PERMUTATIONS = 49
BAND = 0.5


def _cell_values(spark, sf_dir, name):
    """Rates of the cells that have points, with their places in the grid."""
    points = view(spark, sf_dir, name)
    cells = R.grid_of(points, GRID, GRID, profile(points)).where("n > 0")
    return cells.select(F.col("region_id").alias("id"), "j", "i", (F.col("p") / F.col("n").cast("double")).alias("x"))


def _cell_values_sql(name: str) -> str:
    return f"{_pts(name)},{_cells_sql()}, v AS (SELECT region_id id, j, i, p / CAST(n AS DOUBLE) x FROM st WHERE n > 0)"


_QUEEN = "w AS (SELECT a.id a, b.id b, 1e0 w FROM v a JOIN v b ON a.id <> b.id AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1)"
_ROOK = "w0 AS (SELECT a.id a, b.id b FROM v a JOIN v b ON abs(a.i - b.i) + abs(a.j - b.j) = 1), w AS (SELECT a, b, 1e0 / count(*) OVER (PARTITION BY a) w FROM w0)"
_NEAR = f"w AS (SELECT a.id a, b.id b, 1e0 w FROM v a JOIN v b ON a.id <> b.id AND b.lon BETWEEN a.lon - {BAND} AND a.lon + {BAND} AND (a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat) <= {BAND * BAND})"


def _global_sql(values: str, weights: str, permutations: int) -> str:
    """Moran and Geary of ``v`` (id, x) under ``w`` (a, b, w)."""
    dealt = f""",
o AS (SELECT id, row_number() OVER (ORDER BY id) k FROM z),
e AS (SELECT q, z, row_number() OVER (PARTITION BY q ORDER BY md5('{SEED}|' || q || '|' || id), id) k FROM z, (SELECT unnest(range(1, {permutations + 1})) q)),
pz AS (SELECT q, o.id, e.z FROM e JOIN o USING (k)),
pp AS (SELECT x.q, sum(w * x.z * y.z) alike, sum(w * (x.z - y.z) * (x.z - y.z)) unlike FROM w JOIN pz x ON x.id = a JOIN pz y ON y.id = b AND y.q = x.q GROUP BY x.q),
pc AS (SELECT count(*) FILTER (round(pp.alike, 9) >= round(pr.alike, 9)) i, count(*) FILTER (round(pp.unlike, 9) <= round(pr.unlike, 9)) c FROM pp, pr)"""
    shares = f", round((i + 1) / {permutations + 1}e0, 6) moran_p, round((c + 1) / {permutations + 1}e0, 6) geary_p"
    return f"""WITH {values}, {weights},
z AS (SELECT id, x, x - avg(x) OVER () z FROM v),
m AS (SELECT count(*) n, CAST(count(*) AS DOUBLE) f, sum(z * z) m2, sum(z * z * z * z) m4 FROM z),
pr AS (SELECT sum(w) s0, sum(w * x.z * y.z) alike, sum(w * (x.z - y.z) * (x.z - y.z)) unlike FROM w JOIN z x ON x.id = a JOIN z y ON y.id = b),
t AS (SELECT a, b, sum(w) t FROM (SELECT a, b, w FROM w UNION ALL SELECT b, a, w FROM w) GROUP BY a, b),
ts AS (SELECT sum(t2) / 2 s1, sum(t * t) s2 FROM (SELECT a, sum(t * t) t2, sum(t) t FROM t GROUP BY a)),
k AS (SELECT *, f * alike / (s0 * m2) moran, (f - 1) * unlike / (2 * s0 * m2) geary, -1 / (f - 1) expected, f * m4 / (m2 * m2) b2 FROM m, pr, ts),
va AS (SELECT *,
  (f * ((f * f - 3 * f + 3) * s1 - f * s2 + 3 * s0 * s0) - b2 * ((f * f - f) * s1 - 2 * f * s2 + 6 * s0 * s0)) / ((f - 1) * (f - 2) * (f - 3) * s0 * s0) - expected * expected moran_var,
  ((f - 1) * s1 * (f * f - 3 * f + 3 - (f - 1) * b2) - (f - 1) * s2 * (f * f + 3 * f - 6 - (f * f - f + 2) * b2) / 4 + s0 * s0 * (f * f - 3 - (f - 1) * (f - 1) * b2)) / (f * (f - 2) * (f - 3) * s0 * s0) geary_var
  FROM k){dealt if permutations else ""}
SELECT n, round(s0, 6) s0, round(moran, 6) moran, round(moran_var, 6) moran_var, round((moran - expected) / sqrt(moran_var), 6) moran_z,
  round(geary, 6) geary, round(geary_var, 6) geary_var, round((geary - 1) / sqrt(geary_var), 6) geary_z{shares if permutations else ""} FROM va{", pc" if permutations else ""}"""


@query("moran_cells", _global_sql(_cell_values_sql("biased"), _QUEEN, PERMUTATIONS))
def moran_cells(spark, sf_dir):
    """Whether neighbouring cells have like rates, with permutations."""
    v = _cell_values(spark, sf_dir, "biased")
    return A.global_autocorrelation(v, A.cell_weights(v), PERMUTATIONS, SEED)


@query("moran_rook", _global_sql(_cell_values_sql("fair"), _ROOK, 0))
def moran_rook(spark, sf_dir):
    """The same between cells that share an edge, each cell's neighbours counting for one, where there is no bias."""
    v = _cell_values(spark, sf_dir, "fair")
    return A.global_autocorrelation(v, A.row_standardised(A.cell_weights(v, diagonal=False)))


@query("moran_band", _global_sql(f"{_pts('orders')}, v AS (SELECT point_id id, lon, lat, CAST(outcome AS DOUBLE) x FROM pts)", _NEAR, 0))
def moran_band(spark, sf_dir):
    """Whether near points have like outcomes: all points, those within half a degree of each other as neighbours."""
    v = view(spark, sf_dir, "orders").select(F.col("point_id").alias("id"), "lon", "lat", F.col("outcome").alias("x"))
    return A.band_autocorrelation(v, BAND)


@query(
    "local_moran_cells",
    f"""WITH {_cell_values_sql("biased")}, {_QUEEN},
z AS (SELECT id, x, (x - avg(x) OVER ()) / sqrt(var_pop(x) OVER ()) z FROM v),
s AS (SELECT a id, count(*) neighbours, sum(w) weight, sum(w * y.z) lag, sum(w * (x.z - y.z) * (x.z - y.z)) local_geary FROM w JOIN z x ON x.id = a JOIN z y ON y.id = b GROUP BY a),
l AS (SELECT z.id, x, z, coalesce(neighbours, 0) neighbours, weight, lag, z * lag local_moran, local_geary FROM z LEFT JOIN s USING (id)),
e AS (SELECT q, id other, z oz, row_number() OVER (PARTITION BY q ORDER BY md5('{SEED}|' || q || '|' || id), id) k FROM z, (SELECT unnest(range(1, {PERMUTATIONS + 1})) q)),
d AS (SELECT q, id, z, neighbours, weight, local_moran, oz, row_number() OVER (PARTITION BY q, id ORDER BY k) r FROM l JOIN e ON other <> id AND k <= 10),
c AS (SELECT q, id, any_value(local_moran) lm, any_value(z) * coalesce(sum(oz) FILTER (r <= neighbours), 0) * any_value(weight) / any_value(neighbours) v FROM d GROUP BY q, id),
n AS (SELECT id, count(*) FILTER (CASE WHEN round(lm, 9) >= 0 THEN round(v, 9) >= round(lm, 9) ELSE round(v, 9) <= round(lm, 9) END) n FROM c GROUP BY id)
SELECT id, round(x, 6) x, neighbours, round(lag, 6) + 0e0 lag, round(local_moran, 6) + 0e0 local_moran, round(local_geary, 6) + 0e0 local_geary,
  CASE WHEN round(z, 9) > 0 THEN 'H' WHEN round(z, 9) < 0 THEN 'L' END || CASE WHEN round(lag, 9) > 0 THEN 'H' WHEN round(lag, 9) < 0 THEN 'L' END quadrant,
  CASE WHEN local_moran IS NOT NULL THEN round((n + 1) / {PERMUTATIONS + 1}e0, 6) END p FROM l LEFT JOIN n USING (id)""",
)
def local_moran_cells(spark, sf_dir):
    """Where cells and their neighbours are alike, and how often dealing the rates out again does as much."""
    v = _cell_values(spark, sf_dir, "biased")
    return A.local_autocorrelation(v, A.cell_weights(v), PERMUTATIONS, SEED)


# --- density clusters -----------------------------------------------------------------------------------


def _dbscan_sql(name: str, radius: float, least: int) -> str:
    """CTE ``db``: kind and cluster of each point, by comparing all pairs."""
    return f"""WITH RECURSIVE {_pts(name)},
nb AS MATERIALIZED (SELECT a.point_id a, b.point_id b, (a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat) d
  FROM pts a JOIN pts b ON b.lon BETWEEN a.lon - {radius} AND a.lon + {radius} AND (a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat) <= {radius * radius!r}),
co AS MATERIALIZED (SELECT a point_id FROM nb GROUP BY a HAVING count(*) >= {least}),
ed AS MATERIALIZED (SELECT a, b FROM nb WHERE a IN (FROM co) AND b IN (FROM co)),
cl AS (
  SELECT 0 k, point_id, point_id cluster, true moved FROM co
  UNION ALL
  SELECT k + 1, a, least(any_value(mine), min(theirs)), least(any_value(mine), min(theirs)) < any_value(mine)
  FROM (SELECT x.k, ed.a, x.cluster mine, y.cluster theirs, bool_or(x.moved) OVER () go FROM ed JOIN cl x ON x.point_id = ed.a JOIN cl y ON y.point_id = ed.b) WHERE go GROUP BY k, a),
cf AS (SELECT point_id, cluster FROM cl QUALIFY k = max(k) OVER ()),
db AS (
  SELECT point_id, 'core' kind, cluster FROM cf
  UNION ALL
  SELECT a, 'border', arg_min(cluster, (d, cluster)) FROM nb JOIN cf ON cf.point_id = b WHERE a NOT IN (FROM co) GROUP BY a
  UNION ALL
  SELECT point_id, 'noise', NULL FROM pts WHERE point_id NOT IN (SELECT a FROM nb WHERE b IN (FROM co)))"""


#: Radius and least number of points, for clusters of `blobs` and for the scattered points of `orders`.
_DENSE, _LOOSE = (0.35, 6), (0.6, 4)


@query("dbscan_labels", f"{_dbscan_sql('blobs', *_DENSE)} SELECT * FROM db")
def dbscan_labels(spark, sf_dir):
    """Core, border and noise of the planted groups and outliers."""
    return dbscan(view(spark, sf_dir, "blobs"), *_DENSE)


@query("dbscan_orders", f"{_dbscan_sql('orders', *_LOOSE)} SELECT * FROM db")
def dbscan_orders(spark, sf_dir):
    """The same where points lie all over the plane."""
    return dbscan(view(spark, sf_dir, "orders"), *_LOOSE)


@query(
    "dbscan_quality",
    f"""{_dbscan_sql("blobs", *_DENSE)},
g AS (SELECT cluster, count(*) n, count(*) FILTER (kind = 'core') core, CAST(sum(outcome) AS BIGINT) p, min(lon) lon_min, min(lat) lat_min, max(lon) lon_max, max(lat) lat_max FROM db JOIN pts USING (point_id) WHERE cluster IS NOT NULL GROUP BY cluster)
SELECT cluster, n, core, p, round(p / CAST(n AS DOUBLE), 6) rho, round(n / CAST((SELECT count(*) FROM pts) AS DOUBLE), 6) share, lon_min, lat_min, lon_max, lat_max FROM g""",
)
def dbscan_quality(spark, sf_dir):
    """Clusters with their points, core points, rates, shares of all points, and bounds."""
    points = view(spark, sf_dir, "blobs")
    return cluster_table(dbscan(points, *_DENSE), points)


# --- neighbours -----------------------------------------------------------------------------------------

_ANGLE = "2 * asin(sqrt(pow(sin((b.la - a.la) / 2), 2) + cos(a.la) * cos(b.la) * pow(sin((b.lo - a.lo) / 2), 2)))"
_CORE_SQL = f"""WITH {_pts("embed")},
rd AS (SELECT point_id, radians(lat) la, radians(lon) lo FROM pts),
pr AS MATERIALIZED (SELECT a.point_id a, b.point_id b, round({_ANGLE}, 8) d FROM rd a, rd b),
co AS MATERIALIZED (SELECT a point_id, d core FROM pr QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 25)"""


def _embed(spark, sf_dir):
    return view(spark, sf_dir, "embed")


@query("core_distance", f"{_CORE_SQL} SELECT point_id, core FROM co")
def core_distance(spark, sf_dir):
    return N.core_distances(_embed(spark, sf_dir), 25)


@query(
    "mutual_reachability",
    f"""{_CORE_SQL}, mr AS (SELECT a, x.core, greatest(x.core, y.core, d) d FROM pr JOIN co x ON a = x.point_id JOIN co y ON b = y.point_id WHERE a <> b)
SELECT a point_id, any_value(core) core, min(d) nearest, max(d) farthest FROM mr GROUP BY a""",
)
def mutual_reachability(spark, sf_dir):
    return N.mutual_reachability(_embed(spark, sf_dir), 25)


_K = 5


@query(
    "nearest_neighbours",
    f"""WITH {_pts("embed")}, rd AS (SELECT point_id, radians(lat) la, radians(lon) lo FROM pts),
pr AS (SELECT a.point_id, b.point_id neighbour, {_ANGLE} d FROM rd a JOIN rd b ON a.point_id <> b.point_id)
SELECT point_id, CAST(row_number() OVER (PARTITION BY point_id ORDER BY d, neighbour) AS INTEGER) rank, neighbour, round(d, 8) distance FROM pr QUALIFY rank <= {_K}""",
)
def nearest_neighbours(spark, sf_dir):
    """The nearest others of each point: the edges of a neighbour graph."""
    return N.nearest_neighbours(_embed(spark, sf_dir), _K)


@query(
    "neighbours_orders",
    f"""WITH {_pts("orders")}, rd AS (SELECT point_id, lat, lon, radians(lat) la, radians(lon) lo FROM pts),
pr AS (SELECT a.point_id, {_ANGLE} d FROM rd a JOIN rd b ON b.lat BETWEEN a.lat - 12 AND a.lat + 12),
k AS (SELECT point_id, d FROM pr QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY d) = 10)
SELECT point_id, round(d, 8) core FROM k""",
)
def neighbours_orders(spark, sf_dir):
    """Core distances of all orders' points, on a part of the sphere where they are dense and at its rim."""
    return N.core_distances(view(spark, sf_dir, "orders"), 10)


# --- scales ---------------------------------------------------------------------------------------------

LEVELS = 6

#: Every level counted on its own, from the points.
_PYRAMID_SQL = f"""{_pts("biased")},
b AS (SELECT min(lon) lo0, max(lon) lo1, min(lat) la0, max(lat) la1, count(*) nt, CAST(sum(outcome) AS BIGINT) pt FROM pts),
lv AS (SELECT CAST(unnest(range({LEVELS + 1})) AS INTEGER) AS level),
ce AS (
  SELECT level, CAST(least(floor((lon - lo0) / (lo1 - lo0) * (1 << level)), (1 << level) - 1) AS BIGINT) j, CAST(least(floor((lat - la0) / (la1 - la0) * (1 << level)), (1 << level) - 1) AS BIGINT) i, nt, pt, outcome
  FROM pts, b, lv),
st AS (
  SELECT level, CAST(list_sum(list_transform(range({LEVELS + 1}), lambda k: (((j >> k) & 1) << (2 * k)) + (((i >> k) & 1) << (2 * k + 1)))) AS BIGINT) AS cell, j, i, nt, pt, count(*) n, CAST(sum(outcome) AS BIGINT) p
  FROM ce GROUP BY level, j, i, nt, pt),{_scored_sql("st")}"""
_SCALES_SQL = f"""{_PYRAMID_SQL},
gs AS (SELECT level, count(*) occupied, round(var_pop(rho), 6) + 0e0 meanvar, sum(n * ri * ri) / sum(n) - (sum(p) / CAST(sum(n) AS DOUBLE)) ** 2 bt, sum(p) / CAST(sum(n) AS DOUBLE) m,
  max(sul) max_sul, arg_max(cell, (sul, -cell)) best_cell FROM sc GROUP BY level),
sl AS (SELECT level, occupied, meanvar, round(greatest(0, bt), 6) + 0e0 "between", round(greatest(0, m * (1 - m) - greatest(0, bt)), 6) + 0e0 "within", round(greatest(0, bt) / (m * (1 - m)), 6) + 0e0 explained, max_sul, best_cell FROM gs)"""


def _pyramid(spark, sf_dir):
    return P.pyramid(view(spark, sf_dir, "biased"), LEVELS)


@query("pyramid_cells", f"WITH {_PYRAMID_SQL} SELECT level, cell, j, i, n, p, rho, sul FROM sc")
def pyramid_cells(spark, sf_dir):
    """Cells of all scales from one count; SQL counts each level from the points."""
    return _pyramid(spark, sf_dir)


@query("pyramid_scales", f"WITH {_SCALES_SQL} SELECT * FROM sl")
def pyramid_scales(spark, sf_dir):
    """How the outcome's variance divides between and within cells at each scale."""
    return P.scales(_pyramid(spark, sf_dir))


def _told_sql(c: str) -> str:
    return f"round(avg({c}), 6) + 0e0 {c}_mean, round(stddev_pop({c}), 6) + 0e0 {c}_spread, round(stddev_pop({c}) / avg({c}), 6) + 0e0 {c}_variation, arg_max(level, ({c}, -level)) {c}_level"


@query("maup_sensitivity", f"WITH {_SCALES_SQL} SELECT count(*) levels, {_told_sql('meanvar')}, {_told_sql('max_sul')} FROM sl WHERE level > 0")
def maup_sensitivity(spark, sf_dir):
    """How far variance and largest score move with the scale."""
    return P.sensitivity(P.scales(_pyramid(spark, sf_dir)))


@query(
    "region_stability",
    f"""WITH {_PYRAMID_SQL}, f AS (SELECT cell, n fn FROM sc WHERE level = {LEVELS}), w AS (SELECT ri mean FROM sc WHERE level = 0),
g AS (SELECT f.cell, any_value(fn) n, count(*) FILTER (ri > mean) above, count(*) FILTER (ri < mean) below, min(rho) rho_min, max(rho) rho_max FROM f JOIN sc ON level > 0 AND sc.cell = f.cell >> (2 * ({LEVELS} - level)), w GROUP BY f.cell)
SELECT cell, n, above, below, round(greatest(above, below) / {LEVELS}e0, 6) agreement, rho_min, rho_max FROM g""",
)
def region_stability(spark, sf_dir):
    """On how many scales each finest cell is told the same way."""
    return P.stability(_pyramid(spark, sf_dir), LEVELS)


# --- polygons -------------------------------------------------------------------------------------------

#: Hulls of the groups of `embed`, their sides in order round the middle, and measures, without the operators' own ways.
_HULL_SQL = f"""{_pts("embed")}, d AS (SELECT DISTINCT label, lon, lat FROM pts),
e AS (SELECT a.label, a.lon ax, a.lat ay, b.lon bx, b.lat by_ FROM d a JOIN d b ON a.label = b.label AND (a.lon <> b.lon OR a.lat <> b.lat)),
bad AS (SELECT DISTINCT e.label, ax, ay, bx, by_ FROM e JOIN d c ON e.label = c.label WHERE (bx - ax) * (c.lat - ay) - (by_ - ay) * (c.lon - ax) < 0),
side AS MATERIALIZED (SELECT label, ax, ay, bx, by_ FROM e ANTI JOIN bad USING (label, ax, ay, bx, by_)),
inn AS (SELECT side.label, point_id, min((bx - ax) * (lat - ay) - (by_ - ay) * (lon - ax)) >= 0 inside FROM side, pts GROUP BY side.label, point_id)"""


def _hulls(spark, sf_dir):
    return layers.hulls(_embed(spark, sf_dir), "label").select(F.col("label").alias("id"), F.col("hull").alias("ring"))


@query(
    "polygon_measures",
    f"""WITH {_HULL_SQL},
m AS (SELECT label, count(*) vertices, sum(ax * by_ - bx * ay) / 2 area, sum(sqrt((ax - bx) ** 2 + (ay - by_) ** 2)) perimeter, sum((ax + bx) * (ax * by_ - bx * ay)) cx, sum((ay + by_) * (ax * by_ - bx * ay)) cy FROM side GROUP BY label)
SELECT label id, CAST(vertices AS INTEGER) vertices, round(area, 6) area, round(perimeter, 6) perimeter, round(4 * pi() * area / (perimeter * perimeter), 6) compactness, round(cx / (6 * area), 6) center_lon, round(cy / (6 * area), 6) center_lat FROM m""",
)
def polygon_measures(spark, sf_dir):
    """Area, perimeter, compactness and centroid of each group's hull."""
    rows = G.with_measures(_hulls(spark, sf_dir))
    return rows.select("id", "vertices", *(F.round(c, 6).alias(c) for c in ("area", "perimeter", "compactness", "center_lon", "center_lat")))


@query("points_in_polygons", f"WITH {_HULL_SQL} SELECT inn.label id, count(*) n, CAST(sum(outcome) AS BIGINT) p FROM inn JOIN pts USING (point_id) WHERE inside GROUP BY inn.label")
def points_in_polygons(spark, sf_dir):
    """All points that lie in each group's hull, whatever their group."""
    inside = G.points_in(_embed(spark, sf_dir).select("point_id", "lon", "lat", "outcome"), _hulls(spark, sf_dir))
    return inside.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.col("outcome").cast("long")).alias("p"))


_CLUSTER_SIDES_SQL = f"""{_dbscan_sql("blobs", *_DENSE)},
d AS (SELECT DISTINCT cluster, lon, lat FROM db JOIN pts USING (point_id) WHERE cluster IS NOT NULL),
ex AS (SELECT * FROM d QUALIFY count(*) OVER (PARTITION BY cluster) > 1),
e AS (SELECT a.cluster, a.lon ax, a.lat ay, b.lon bx, b.lat by_ FROM ex a JOIN ex b ON a.cluster = b.cluster AND (a.lon <> b.lon OR a.lat <> b.lat)),
bad AS (SELECT DISTINCT e.cluster, ax, ay, bx, by_ FROM e JOIN d c ON e.cluster = c.cluster
  WHERE (bx - ax) * (c.lat - ay) - (by_ - ay) * (c.lon - ax) < 0
    OR ((bx - ax) * (c.lat - ay) - (by_ - ay) * (c.lon - ax) = 0 AND ((bx - ax) * (c.lon - ax) + (by_ - ay) * (c.lat - ay) < 0 OR (ax - bx) * (c.lon - bx) + (ay - by_) * (c.lat - by_) < 0))),
side AS MATERIALIZED (SELECT cluster, ax, ay, bx, by_ FROM e ANTI JOIN bad USING (cluster, ax, ay, bx, by_) UNION ALL SELECT cluster, lon, lat, lon, lat FROM d QUALIFY count(*) OVER (PARTITION BY cluster) = 1)"""


@query(
    "cluster_isolation",
    f"""{_CLUSTER_SIDES_SQL},
pp AS (
  SELECT s.cluster id, t.cluster nearest, (s.ax - t.ax - k * (t.bx - t.ax)) ** 2 + (s.ay - t.ay - k * (t.by_ - t.ay)) ** 2 d
  FROM (SELECT *, least(1, greatest(0, coalesce(((s.ax - t.ax) * (t.bx - t.ax) + (s.ay - t.ay) * (t.by_ - t.ay)) / nullif((t.bx - t.ax) ** 2 + (t.by_ - t.ay) ** 2, 0), 0))) k
    FROM side s JOIN side t ON s.cluster <> t.cluster) x(cluster, ax, ay, bx, by_, cluster_1, ax_1, ay_1, bx_1, by_1, k), LATERAL (SELECT cluster, ax, ay) s, LATERAL (SELECT cluster_1 cluster, ax_1 ax, ay_1 ay, bx_1 bx, by_1 by_) t),
ov AS (SELECT DISTINCT s.cluster id, t.cluster nearest FROM side s JOIN side t ON s.cluster <> t.cluster AND sign((s.bx - s.ax) * (t.ay - s.ay) - (s.by_ - s.ay) * (t.ax - s.ax)) * sign((s.bx - s.ax) * (t.by_ - s.ay) - (s.by_ - s.ay) * (t.bx - s.ax)) < 0
  AND sign((t.bx - t.ax) * (s.ay - t.ay) - (t.by_ - t.ay) * (s.ax - t.ax)) * sign((t.bx - t.ax) * (s.by_ - t.ay) - (t.by_ - t.ay) * (s.bx - t.ax)) < 0),
hd AS (SELECT s.cluster id, c.cluster nearest FROM side s JOIN d c ON c.cluster <> s.cluster GROUP BY s.cluster, c.cluster, c.lon, c.lat HAVING min((s.bx - s.ax) * (c.lat - s.ay) - (s.by_ - s.ay) * (c.lon - s.ax)) >= 0 AND count(*) > 2),
al AS (SELECT id, nearest, least(min(d), any_value(0e0) FILTER (false)) d FROM (SELECT id, nearest, d FROM pp UNION ALL SELECT nearest, id, d FROM pp UNION ALL SELECT id, nearest, 0 FROM ov UNION ALL SELECT id, nearest, 0 FROM hd UNION ALL SELECT nearest, id, 0 FROM hd) GROUP BY id, nearest)
SELECT id, arg_min(nearest, (d, nearest)) nearest, round(sqrt(min(d)), 6) + 0e0 distance FROM al GROUP BY id""",
)
def cluster_isolation(spark, sf_dir):
    """How far the polygon of each density cluster is from the nearest other one's."""
    points = view(spark, sf_dir, "blobs")
    members = dbscan(points, *_DENSE).where("cluster is not null").join(points, "point_id")
    found = G.nearest_others(layers.hulls(members, "cluster").select(F.col("cluster").alias("id"), F.col("hull").alias("ring")))
    return found.select("id", "nearest", rounded(F.col("distance")).alias("distance"))


@query(
    "segregation_cells",
    f"""WITH {_pts("biased")},{_cells_sql()},
s AS (SELECT n, p, p / CAST(n AS DOUBLE) r, sum(n) OVER () nt, sum(p) OVER () pt FROM st WHERE n > 0),
h AS (SELECT *, -(CASE WHEN r > 0 THEN r * ln(r) ELSE 0 END + CASE WHEN r < 1 THEN (1 - r) * ln(1 - r) ELSE 0 END) e, pt / CAST(nt AS DOUBLE) r0 FROM s)
SELECT round(sum(abs(p / CAST(pt AS DOUBLE) - (n - p) / CAST(nt - pt AS DOUBLE))) / 2, 6) dissimilarity, round(sum(p / CAST(pt AS DOUBLE) * r), 6) isolation, round(sum(p / CAST(pt AS DOUBLE) * (1 - r)), 6) exposure,
  round(1 - sum(n / CAST(nt AS DOUBLE) * e) / any_value(-(r0 * ln(r0) + (1 - r0) * ln(1 - r0))), 6) heterogeneity, round(sum(n / CAST(nt AS DOUBLE) * 2 * r * (1 - r)), 6) gini FROM h""",
)
def segregation_cells(spark, sf_dir):
    """Indices of how unevenly the outcome lies over the cells."""
    points = view(spark, sf_dir, "biased")
    return G.segregation(R.grid_of(points, GRID, GRID, profile(points)))


@query("cell_communities")
def cell_communities(spark, sf_dir):
    """Communities of the graph of cells as regions of the audit: cells, points and scores. Held against brute force in tests."""
    points = view(spark, sf_dir, "biased")
    p = profile(points)
    # The points are counted once: edges and the result read the cells again and again.
    cells = Rounds(spark, "cells").kept(R.grid_of(points, 10, 10, p).withColumnRenamed("region_id", "id").where("n > 0"))
    own = cells.join(C.louvain(C.cell_graph(cells))[0].withColumnRenamed("node", "id"), "id", "left").withColumn("region_id", F.coalesce("community", "id"))
    return scored(own.groupBy("region_id").agg(F.count("*").alias("cells"), F.sum("n").alias("n"), F.sum("p").alias("p")), p.n, p.p)


# --- triangulation --------------------------------------------------------------------------------------


@query(
    "delaunay_edges",
    f"""WITH {_pts("embed")},
pq AS (SELECT a.point_id a, b.point_id b, (a.lon + b.lon) / 2 mx, (a.lat + b.lat) / 2 my, -(b.lat - a.lat) nx, b.lon - a.lon ny, ((a.lon - b.lon) ** 2 + (a.lat - b.lat) ** 2) / 4 h FROM pts a JOIN pts b ON a.point_id < b.point_id),
cs AS (SELECT pq.*, (c.lon - mx) ** 2 + (c.lat - my) ** 2 - h e, 2 * ((c.lon - mx) * nx + (c.lat - my) * ny) f FROM pq JOIN pts c ON c.point_id <> a AND c.point_id <> b),
bd AS (SELECT a, b, coalesce(min(CASE WHEN f > 0 THEN e / f END), 1e300) high, coalesce(max(CASE WHEN f < 0 THEN e / f END), -1e300) low FROM cs GROUP BY a, b)
SELECT a, b, low <= 0 AND high >= 0 gabriel FROM bd WHERE low < high""",
)
def delaunay_edges(spark, sf_dir):
    """Places with an empty circle through both, and those with nothing in the circle between them."""
    return delaunay(_embed(spark, sf_dir))

"""Candidate regions and the points in them: regular and random grids, squares around seeds.

Regions are closed boxes: a point on a shared edge is in both neighbours. Points are never joined with
grid cells; a point's cells follow from its coordinates, so membership is a projection and counting needs
one shuffle of partial counts.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.points import Profile, profile
from ..sources.written import Rounds
from .kmeans import first_centres, lloyd, nearest_to

NO_GRID = 0
#: Cells of some grids that a task counts in one table; beyond, counts are shuffled cell by cell.
_AT_ONCE = 1 << 21


def edge(k: Column, n: Column, low: Column, high: Column) -> Column:
    """The k-th of n+1 edges. The order of operations is part of the result: the last may miss ``high``."""
    return low + (k.cast("double") / n.cast("double")) * (high - low)


def _bands(x: Column, n: Column, low: float, high: float) -> Column:
    """Indices of the bands that hold ``x``: those next to its rounded place whose exact edges enclose it."""
    lo, hi = F.lit(low), F.lit(high)
    if high == low:  # all bands are that one value
        return F.when(x == lo, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    place = F.least(F.greatest(F.floor((x - lo) / (hi - lo) * n), F.lit(0)), n - 1).cast("int")
    near = F.sequence(F.greatest(place - 1, F.lit(0)), F.least(place + 1, n - 1))
    return F.filter(near, lambda k: (x >= edge(k, n, lo, hi)) & (x <= edge(k + 1, n, lo, hi)))


def cell_ids(p: Profile, lon_n: Column, lat_n: Column) -> Column:
    """The ``region_id``s (row * lon_n + column) of the cells that a point is in: one, or more on an edge."""
    columns = _bands(F.col("lon"), lon_n, p.lon_min, p.lon_max)
    rows = _bands(F.col("lat"), lat_n, p.lat_min, p.lat_max)
    return F.flatten(F.transform(rows, lambda i: F.transform(columns, lambda j: (i * lon_n + j).cast("long"))))


def with_cells(points: DataFrame, p: Profile, lon_n: int, lat_n: int) -> DataFrame:
    """Points with their ``region_ids`` in one grid over the extent of all points."""
    if not p.n:
        return points.withColumn("region_ids", F.array().cast("array<long>"))
    return points.withColumn("region_ids", cell_ids(p, F.lit(lon_n), F.lit(lat_n)))


def grid_table(spark: SparkSession, grids: Iterable[tuple[int, int, int]]) -> DataFrame:
    """``grid_idx, lon_n, lat_n`` rows: a few numbers for each grid."""
    return spark.createDataFrame(list(grids), "grid_idx int, lon_n int, lat_n int")


def grid_cells(grids: DataFrame, p: Profile) -> DataFrame:
    """All cells of some grids, with ``region_id, j`` (column), ``i`` (row) and bounds; none without points."""
    cells = grids.where(F.lit(bool(p.n))).select("grid_idx", "lon_n", "lat_n", F.explode(F.sequence(F.lit(0), F.col("lon_n") * F.col("lat_n") - 1)).alias("cell"))
    cells = cells.select("grid_idx", "lon_n", "lat_n", F.col("cell").cast("long").alias("region_id"), (F.col("cell") % F.col("lon_n")).alias("j"), F.floor(F.col("cell") / F.col("lon_n")).cast("int").alias("i"))

    def at(k: str, n: str, low: float | None, high: float | None, next_: int) -> Column:
        return edge(F.col(k) + next_, F.col(n), F.lit(low).cast("double"), F.lit(high).cast("double"))

    return cells.select(
        "grid_idx", "region_id", "j", "i",
        at("j", "lon_n", p.lon_min, p.lon_max, 0).alias("lon_start"), at("i", "lat_n", p.lat_min, p.lat_max, 0).alias("lat_start"),
        at("j", "lon_n", p.lon_min, p.lon_max, 1).alias("lon_end"), at("i", "lat_n", p.lat_min, p.lat_max, 1).alias("lat_end"),
    )


def one_grid(spark: SparkSession, lon_n: int, lat_n: int) -> DataFrame:
    return grid_table(spark, [(NO_GRID, lon_n, lat_n)])


def random_grids(n: int = 100, lon_range: tuple[int, int] = (10, 40), lat_range: tuple[int, int] = (10, 40), seed: int = 42) -> list[tuple[int, int, int]]:
    """Grids of random size, both ends possible; columns are drawn before rows."""
    rng = random.Random(seed)
    return [(k, rng.randint(*lon_range), rng.randint(*lat_range)) for k in range(n)]


def counted(members: DataFrame, *keys: str) -> DataFrame:
    """``n`` points and ``p`` positive outcomes of each region."""
    return members.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("outcome").cast("long")).alias("p"))


def _held(x: np.ndarray, n: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the bands that hold each ``x``, by the edges of ``edge``; the first is behind the last if none does."""
    edges = low + (np.arange(n + 1) / n) * (high - low)
    return np.searchsorted(edges[1:], x, "left"), np.searchsorted(edges[:-1], x, "right") - 1


def _laid(points: DataFrame, sizes: list[tuple[int, int, int]], p: Profile) -> DataFrame:
    """``grid_idx, region_id, n, p`` of the cells that have points, one row for each task: tasks add up their points' cells."""
    ends = {"lon": (p.lon_min, p.lon_max), "lat": (p.lat_min, p.lat_max)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((2, x * y)) for _, x, y in sizes]
        for batch in batches:
            lon, lat, outcome = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lon", "lat", "outcome"))
            columns = {x: _held(lon, x, *ends["lon"]) for x in {x for _, x, _ in sizes}}
            rows = {y: _held(lat, y, *ends["lat"]) for y in {y for _, _, y in sizes}}
            for total, (_, x, y) in zip(totals, sizes):
                (j, last_j), (i, last_i) = columns[x], rows[y]
                one = (j == last_j) & (i == last_i)
                # On an edge a point is in some columns and rows, on none of them in one of each.
                rest = np.flatnonzero(~one)
                wide, high = np.maximum(0, last_j[rest] - j[rest] + 1), np.maximum(0, last_i[rest] - i[rest] + 1)
                times = wide * high
                at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                more, wide = np.repeat(rest, times), np.repeat(wide, times)
                cell = np.concatenate([i[one] * x + j[one], (i[more] + at // np.maximum(wide, 1)) * x + j[more] + at % np.maximum(wide, 1)])
                total[0] += np.bincount(cell, minlength=x * y)
                total[1] += np.bincount(cell, np.concatenate([outcome[one], outcome[more]]), x * y)
        for (g, _, _), total in zip(sizes, totals):
            has = np.flatnonzero(total[0])
            n, positive = total[:, has].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(has), g, np.int32)), pa.array(has.astype(np.int64)), pa.array(n), pa.array(positive)], names=["grid_idx", "region_id", "n", "p"])

    double = {c: F.col(c).cast("double") for c in ("lon", "lat")}
    places = points.where("lon is not null and lat is not null").select(*(v.alias(c) for c, v in double.items()), F.coalesce(F.col("outcome").cast("double"), F.lit(0.0)).alias("outcome"))
    return places.mapInArrow(run, "grid_idx int, region_id long, n long, p long")


def grid_stats(points: DataFrame, grids: DataFrame, sizes: list[tuple[int, int, int]], p: Profile) -> DataFrame:
    """Cells of the grids with ``n`` and ``p``; empty cells have 0 of both.

    Points are laid over all grids where they are read; what is shuffled is each task's counts of cells. Where these
    are too many for a table in each task, they are counted as rows.
    """
    cells = grid_cells(grids, p)
    if not p.n:
        return cells.withColumn("n", F.lit(0).cast("long")).withColumn("p", F.lit(0).cast("long"))
    zero = {"n": 0, "p": 0}
    if sum(x * y for _, x, y in sizes) <= _AT_ONCE:
        found = _laid(points, sizes, p).groupBy("grid_idx", "region_id").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
        return cells.join(found, ["grid_idx", "region_id"], "left").na.fill(zero)
    places = points.select("lon", "lat", "outcome").withColumn("g", F.explode(F.array(*(F.struct(F.lit(g).alias("grid_idx"), F.lit(x).alias("lon_n"), F.lit(y).alias("lat_n")) for g, x, y in sizes))))
    ids = cell_ids(p, F.col("g.lon_n"), F.col("g.lat_n"))
    members = places.select(F.col("g.grid_idx").alias("grid_idx"), F.explode(ids).alias("region_id"), "outcome")
    found = counted(members, "grid_idx", "region_id")
    return cells.join(found, ["grid_idx", "region_id"], "left").na.fill(zero)


def grid_of(points: DataFrame, lon_n: int, lat_n: int, p: Profile | None = None) -> DataFrame:
    """The cells of one grid over the points' extent with their counts."""
    p = p or profile(points)
    sizes = [(NO_GRID, lon_n, lat_n)]
    return grid_stats(points, grid_table(points.sparkSession, sizes), sizes, p)


# --- seeds and squares ---------------------------------------------------------------------------------


def nearest_points(points: DataFrame, centres: list[tuple[float, float]]) -> DataFrame:
    """For each centre (lon, lat), the nearest point by distance in degrees; ties go to the least point_id.

    One pass with one minimum for each centre: centres are few, points are not.
    """
    if not centres:
        return points.sparkSession.createDataFrame([], "seed_rank int, center long, lon double, lat double")
    found = nearest_to(points, np.array(centres, float).reshape(-1, 2))
    return found.select(F.col("c").cast("int").alias("seed_rank"), F.col("point_id").alias("center"), "lon", "lat")


def kmeans_seeds(points: DataFrame, n_seeds: int, seed: int = 42) -> DataFrame:
    """The points nearest to the centres of KMeans on (lon, lat); min(n_seeds, N) of them.

    Where KMeans finds fewer centres (equal points), seeds are repeated to make up the number.
    """
    # Written once: each step is a pass over the places, not over what they are derived from.
    rounds = Rounds(points.sparkSession, "seeds")
    points = rounds.kept(points.select("point_id", "lon", "lat", "outcome"))
    k = min(n_seeds, points.count())
    if k == 0:
        return nearest_points(points, [])
    centres = lloyd(points, first_centres(points, k, seed))
    return rounds.kept(nearest_points(points, [tuple(centres[i % len(centres)]) for i in range(k)]))


def squares(seeds: DataFrame, radii: list[float]) -> DataFrame:
    """Seeds by radii, seed by seed and from the smallest radius: ``region_id`` and the box of each."""
    rows = seeds.crossJoin(F.broadcast(seeds.sparkSession.createDataFrame(list(enumerate(radii)), "radius_rank int, radius double")))
    return rows.select(
        (F.col("seed_rank").cast("long") * len(radii) + F.col("radius_rank")).alias("region_id"), "seed_rank", "radius_rank", "center", "radius",
        (F.col("lon") - F.col("radius")).alias("lon_min"), (F.col("lat") - F.col("radius")).alias("lat_min"),
        (F.col("lon") + F.col("radius")).alias("lon_max"), (F.col("lat") + F.col("radius")).alias("lat_max"), "lon", "lat",
    )


def _reached(seeds: DataFrame, largest: float, size: float) -> DataFrame:
    """Seeds by the buckets of side ``size`` (``bx, by``) that their largest square touches, with some room for rounding."""
    for axis, name in (("lon", "bx"), ("lat", "by")):
        room = F.abs(F.col(axis) / size) * 1e-12 + 1e-6
        seeds = seeds.withColumn(name, F.explode(F.sequence(F.floor((F.col(axis) - largest) / size - room), F.floor((F.col(axis) + largest) / size + room))))
    return seeds


def with_rings(points: DataFrame, seeds: DataFrame, radii: list[float]) -> DataFrame:
    """Points by the seeds whose largest square holds them, and the rank of the smallest one that does.

    Squares of a seed are nested, so that rank tells all of them. Seeds are few and are broadcast by the
    buckets that their largest square touches; a point looks only into its own bucket.
    """
    order = sorted(range(len(radii)), key=lambda k: radii[k])
    largest = max(radii)
    size = 2 * largest if largest > 0 else 1.0

    reach = _reached(seeds, largest, size).select("seed_rank", F.col("lon").alias("x"), F.col("lat").alias("y"), "bx", "by")
    keyed = points.withColumn("bx", F.floor(F.col("lon") / size)).withColumn("by", F.floor(F.col("lat") / size))

    def inside(r: Column) -> Column:
        lon, lat, x, y = (F.col(c) for c in ("lon", "lat", "x", "y"))
        return (lon >= x - r) & (lon <= x + r) & (lat >= y - r) & (lat <= y + r)

    # Few of a bucket's seeds are near enough: the others go by one test. Of nested squares the smallest come first.
    met = keyed.join(F.broadcast(reach), ["bx", "by"]).where(inside(F.lit(largest)))
    holding = F.size(F.filter(F.array(*(F.lit(radii[k]) for k in order)), inside))
    return met.withColumn("ring", F.lit(len(radii)) - holding).drop("bx", "by", "x", "y")


def square_stats(points: DataFrame, seeds: DataFrame, radii: list[float]) -> DataFrame:
    """Every square with ``n`` and ``p``: counts by ring, summed outwards. Empty squares have 0 of both."""
    from pyspark.sql import Window

    order = sorted(range(len(radii)), key=lambda k: radii[k])
    rings = counted(with_rings(points, seeds, radii), "seed_rank", "ring")
    place = F.element_at(F.create_map(*(F.lit(v) for place, k in enumerate(order) for v in (k, place))), F.col("radius_rank"))
    every = squares(seeds, radii).withColumn("ring", place)
    outwards = Window.partitionBy("seed_rank").orderBy("ring").rowsBetween(Window.unboundedPreceding, 0)
    joined = every.join(rings, ["seed_rank", "ring"], "left").na.fill({"n": 0, "p": 0})
    return joined.withColumn("n", F.sum("n").over(outwards)).withColumn("p", F.sum("p").over(outwards)).drop("ring")


def with_square_ids(points: DataFrame, seeds: DataFrame, radii: list[float], smallest: bool = False) -> DataFrame:
    """Points with the ``region_ids`` of all squares that hold them; no shuffle of points.

    With ``smallest``, of each seed's squares only the smallest one that does; radii must then ascend.
    """
    if smallest and radii != sorted(radii):
        raise ValueError("Radii must ascend")
    largest = max(radii)
    size = 2 * largest if largest > 0 else 1.0
    reach = _reached(seeds, largest, size)
    near = reach.groupBy("bx", "by").agg(F.collect_list(F.struct("seed_rank", F.col("lon").alias("x"), F.col("lat").alias("y"))).alias("near"))
    keyed = points.withColumn("bx", F.floor(F.col("lon") / size)).withColumn("by", F.floor(F.col("lat") / size)).join(F.broadcast(near), ["bx", "by"], "left")
    ranks = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(r).alias("r")) for k, r in enumerate(radii)))

    def held(s: Column, c: Column) -> Column:
        lon, lat, r = F.col("lon"), F.col("lat"), c["r"]
        return (lon >= s["x"] - r) & (lon <= s["x"] + r) & (lat >= s["y"] - r) & (lat <= s["y"] + r)

    def first_id(s: Column) -> Column:
        return s["seed_rank"].cast("long") * len(radii)

    # Most seeds of a bucket are too far for all of their squares: those go by one test.
    there = F.filter("near", lambda s: held(s, F.struct(F.lit(largest).alias("r"))))
    if smallest:  # squares are nested: those that do not hold a point come first
        ids = F.transform(there, lambda s: first_id(s) + len(radii) - F.size(F.filter(ranks, lambda c: held(s, c))))
    else:
        ids = F.flatten(F.transform(there, lambda s: F.transform(F.filter(ranks, lambda c: held(s, c)), lambda c: first_id(s) + c["k"])))
    none = F.array().cast("array<long>")
    return keyed.withColumn("region_ids", F.array_sort(F.coalesce(ids, none))).drop("bx", "by", "near")

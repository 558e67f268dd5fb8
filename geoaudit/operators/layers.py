"""What a map shows: a stratified sample, bounds and hulls of point groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POSITIVE, NEGATIVE = "#2ca25f", "#de2d26"


def stratified_sample(points: DataFrame, most: int = 5000, seed: int = 42) -> DataFrame:
    """At most ``most`` points with a colour, by id: up to half positives, the rest negatives, by a hash of the id.

    What positives leave of their half goes to negatives, not the other way round. A table that fits stays
    whole.
    """
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("point_id").cast("string")))
    counts = {r["outcome"]: r["count"] for r in points.groupBy("outcome").count().collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    coloured = points.withColumn("color", F.when(F.col("outcome") == 1, POSITIVE).otherwise(NEGATIVE))
    if ones + zeros <= most:
        return coloured.orderBy("point_id")
    take = {1: min(ones, most // 2)}
    take[0] = min(zeros, most - take[1])
    parts = [coloured.where(F.col("outcome") == o).orderBy(key, "point_id").limit(k) for o, k in take.items()]
    return parts[0].unionAll(parts[1]).orderBy("point_id")


def bounds(points: DataFrame, *keys: str) -> DataFrame:
    return points.groupBy(*keys).agg(F.min("lon").alias("lon_min"), F.min("lat").alias("lat_min"), F.max("lon").alias("lon_max"), F.max("lat").alias("lat_max"))


def _turn(o, a, b):
    return (a["lon"] - o["lon"]) * (b["lat"] - o["lat"]) - (a["lat"] - o["lat"]) * (b["lon"] - o["lon"])


def _chain(points):
    """One side of a hull: points are taken in order, and those that do not turn left are dropped."""
    def trim(kept, x):
        # Drop from the end while the last two and x do not turn left.
        size = F.size(kept)
        last = F.filter(F.sequence(size, F.lit(1), F.lit(-1)), lambda k: (k < 2) | (_turn(F.element_at(kept, k - 1), F.element_at(kept, k), x) > 0))
        return F.array_append(F.slice(kept, 1, F.element_at(last, 1)), x)

    return F.aggregate(points, F.slice(points, 1, 0), lambda kept, x: F.when(F.size(kept) < 2, F.array_append(kept, x)).otherwise(trim(kept, x)))


def _folded(points: DataFrame, *keys: str) -> DataFrame:
    """``hull`` of each group, out of all its points in one row."""
    listed = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lon", "lat"))).alias("pts"))
    both = listed.withColumn("lower", _chain(F.col("pts"))).withColumn("upper", _chain(F.reverse("pts")))
    joined = F.concat(F.slice("lower", 1, F.size("lower") - 1), F.slice("upper", 1, F.size("upper") - 1))
    return both.select(*keys, F.when(F.size("pts") < 2, F.col("pts")).otherwise(joined).alias("hull"))


def hulls(points: DataFrame, *keys: str, slice_of: int = 2048) -> DataFrame:
    """``hull`` of each group: vertices (lon, lat) counter-clockwise from the least, without points on edges.

    A monotone chain (Andrew 1979) as a fold over the sorted distinct points; points that cannot be on a
    hull, inside the box of the extreme ones, never reach it. Groups are folded in slices of about
    ``slice_of`` points by hash, and the corners of the slices' hulls once more. One point gives itself,
    points in a line their ends.
    """
    from functools import reduce

    spot = points.select(*keys, "lon", "lat").distinct()
    # Points strictly inside the quadrilateral of the four extreme ones are on no hull.
    extremes = (f(F.struct(*order)).alias(name) for name, f, order in (("w", F.min, ("lon", "lat")), ("e", F.max, ("lon", "lat")), ("s", F.min, ("lat", "lon")), ("n", F.max, ("lat", "lon"))))
    ends = spot.groupBy(*keys).agg(*extremes, F.ceil(F.count("*") / slice_of).alias("slices"))
    at = F.struct("lon", "lat")
    sides = [("w", "s"), ("s", "e"), ("e", "n"), ("n", "w")]
    inside = reduce(lambda x, y: x & y, (_turn(F.col(a), F.col(b), at) > 0 for a, b in sides))
    outer = (spot.join(ends, list(keys)) if keys else spot.crossJoin(F.broadcast(ends))).where(~inside)
    part = "_".join(("slice", *keys))
    sliced = outer.select(*keys, "lon", "lat", F.pmod(F.xxhash64("lon", "lat"), F.col("slices")).alias(part))
    corners = _folded(sliced, *keys, part).select(*keys, F.explode("hull").alias("corner")).select(*keys, "corner.*")
    return _folded(corners, *keys)

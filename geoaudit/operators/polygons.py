"""Polygons of groups of points: their measures, the points in them, and how far they are from each other.

A polygon is a row with ``ring``, its vertices (structs of lon and lat) in order, the first not repeated. All is on the
plane of degrees, as for squares and grids. Fewer than three vertices are a point or a line, of no area.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import rate, rounded
from ..sources.written import Rounds


def _sides(ring: Column) -> Column:
    """Pairs ``(a, b)`` of neighbouring vertices, the last one and the first among them."""
    return F.transform(ring, lambda a, k: F.struct(a.alias("a"), F.element_at(ring, F.when(k + 1 < F.size(ring), k + 2).otherwise(F.lit(1))).alias("b")))


def _total(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + of(x))


def _cross(s: Column) -> Column:
    return s["a"]["lon"] * s["b"]["lat"] - s["b"]["lon"] * s["a"]["lat"]


def _square(x: Column) -> Column:
    return x * x


def with_measures(polygons: DataFrame) -> DataFrame:
    """Polygons with ``vertices, area, perimeter, compactness`` and the centroid ``center_lon, center_lat``.

    ``compactness`` is the area as a share of that of a circle with the same perimeter (Polsby and Popper), 0 for lines
    and null for points; the centroid of what has no area is the mean of its vertices.
    """
    # Vertices are taken from the first one on, so that far from the origin no digits are lost.
    first = F.element_at("ring", 1)
    moved = F.transform("ring", lambda p: F.struct((p["lon"] - first["lon"]).alias("lon"), (p["lat"] - first["lat"]).alias("lat")))
    rows = polygons.withColumn("_first", first).withColumn("_sides", _sides(moved))
    twice = _total(F.col("_sides"), _cross)
    length = _total(F.col("_sides"), lambda s: F.sqrt(_square(s["a"]["lon"] - s["b"]["lon"]) + _square(s["a"]["lat"] - s["b"]["lat"])))
    rows = rows.withColumn("_twice", twice).withColumn("perimeter", length)

    def centre(axis: str) -> Column:
        solid = F.try_divide(_total(F.col("_sides"), lambda s: (s["a"][axis] + s["b"][axis]) * _cross(s)), 3 * F.col("_twice"))
        thin = _total(F.col("_sides"), lambda s: s["a"][axis]) / F.size("ring")
        return F.col(f"_first.{axis}") + F.coalesce(solid, thin)

    area = F.abs("_twice") / 2
    rows = rows.withColumns({"vertices": F.size("ring"), "area": area, "compactness": F.try_divide(4 * F.pi() * area, _square(F.col("perimeter"))), "center_lon": centre("lon"), "center_lat": centre("lat")})
    return rows.drop("_first", "_sides", "_twice")


def _boxed(polygons: DataFrame) -> DataFrame:
    ends = {f"{c}_{name}": f(F.col(f"ring.{c}")) for c in ("lon", "lat") for name, f in (("min", F.array_min), ("max", F.array_max))}
    return polygons.where(F.size("ring") > 0).withColumns(ends)


def holds(ring: Column, lon: Column, lat: Column) -> Column:
    """Whether a polygon holds a place; its edges and vertices are in it."""

    def on_edge(s: Column) -> Column:
        turn = (s["b"]["lon"] - s["a"]["lon"]) * (lat - s["a"]["lat"]) - (s["b"]["lat"] - s["a"]["lat"]) * (lon - s["a"]["lon"])
        return (turn == 0) & lon.between(F.least(s["a"]["lon"], s["b"]["lon"]), F.greatest(s["a"]["lon"], s["b"]["lon"])) & lat.between(F.least(s["a"]["lat"], s["b"]["lat"]), F.greatest(s["a"]["lat"], s["b"]["lat"]))

    def crossed(s: Column) -> Column:
        """Sides that a ray to the east meets; one end of a side counts."""
        up = s["b"]["lat"] > s["a"]["lat"]
        turn = (s["b"]["lon"] - s["a"]["lon"]) * (lat - s["a"]["lat"]) - (s["b"]["lat"] - s["a"]["lat"]) * (lon - s["a"]["lon"])
        return ((s["a"]["lat"] > lat) != (s["b"]["lat"] > lat)) & F.when(up, turn > 0).otherwise(turn < 0)

    sides = _sides(ring)
    return F.exists(sides, on_edge) | (F.size(F.filter(sides, crossed)) % 2 == 1)


def points_in(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """``points`` once for each polygon (``id, ring``) that holds them, with its ``id``.

    Polygons are laid over squares of a half of the widest one's box, nine of them at most; a point looks into its own.
    """
    boxes = _boxed(polygons.select("id", "ring"))
    widest = boxes.agg(F.max(F.greatest(F.col("lon_max") - F.col("lon_min"), F.col("lat_max") - F.col("lat_min")))).first()[0]
    side = widest / 2 if widest else 1.0
    laid = boxes
    for axis in ("lon", "lat"):
        laid = laid.withColumn(f"at_{axis}", F.explode(F.sequence(*(F.floor(F.col(f"{axis}_{end}") / side) for end in ("min", "max")))))
    looks = points.where("lon is not null and lat is not null and not isnan(lon) and not isnan(lat)").withColumns({f"at_{c}": F.floor(F.col(c) / side) for c in ("lon", "lat")})
    met = looks.join(laid, ["at_lon", "at_lat"])
    inside = F.col("lon").between(F.col("lon_min"), F.col("lon_max")) & F.col("lat").between(F.col("lat_min"), F.col("lat_max")) & holds(F.col("ring"), F.col("lon"), F.col("lat"))
    return met.where(inside).select(*points.columns, "id")


def _to_side(p: Column, s: Column) -> Column:
    """Squared distance of a place from a side."""
    dx, dy = s["b"]["lon"] - s["a"]["lon"], s["b"]["lat"] - s["a"]["lat"]
    along = F.coalesce(F.try_divide((p["lon"] - s["a"]["lon"]) * dx + (p["lat"] - s["a"]["lat"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    along = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    return _square(p["lon"] - s["a"]["lon"] - along * dx) + _square(p["lat"] - s["a"]["lat"] - along * dy)


def _crossing(s: Column, t: Column) -> Column:
    """Whether two sides cross inside both; where they only touch, an end is on the other."""

    def turn(p: Column, q: Column, r: Column) -> Column:
        return F.signum((q["lon"] - p["lon"]) * (r["lat"] - p["lat"]) - (q["lat"] - p["lat"]) * (r["lon"] - p["lon"]))

    return (turn(s["a"], s["b"], t["a"]) * turn(s["a"], s["b"], t["b"]) < 0) & (turn(t["a"], t["b"], s["a"]) * turn(t["a"], t["b"], s["b"]) < 0)


def distance(one: Column, two: Column) -> Column:
    """Least distance of two polygons, 0 where they meet or one holds the other."""
    a, b = _sides(one), _sides(two)

    def nearest(ring: Column, sides: Column) -> Column:
        return F.array_min(F.flatten(F.transform(ring, lambda p: F.transform(sides, lambda s: _to_side(p, s)))))

    near = F.least(nearest(one, b), nearest(two, a))
    first = (F.element_at(x, 1) for x in (one, two))
    p, q = next(first), next(first)
    meet = holds(one, q["lon"], q["lat"]) | holds(two, p["lon"], p["lat"]) | F.exists(a, lambda s: F.exists(b, lambda t: _crossing(s, t)))
    return F.when(meet, F.lit(0.0)).otherwise(F.sqrt(near))


def nearest_others(polygons: DataFrame) -> DataFrame:
    """``id, nearest, distance`` (isolation): the nearest other polygon, of equally near ones that of the least id.

    Polygons look for others within a reach, by squares of its width that their boxes touch; those that find none that
    near look again with twice the reach, until none is left or all are in reach of each other. A lone one is near none.
    """
    rounds = Rounds(polygons.sparkSession, "polygons")
    boxes = rounds.kept(_boxed(polygons.select("id", "ring")))
    extent = boxes.agg(F.max(F.greatest(F.col("lon_max") - F.col("lon_min"), F.col("lat_max") - F.col("lat_min"))).alias("widest"), (F.max("lon_max") - F.min("lon_min") + F.max("lat_max") - F.min("lat_min")).alias("whole")).first()
    reach, left, found = extent.widest or 1.0, boxes, None
    while not left.isEmpty():

        def laid(rows: DataFrame, wider: float) -> DataFrame:
            for axis in ("lon", "lat"):
                rows = rows.withColumn(f"at_{axis}", F.explode(F.sequence(F.floor((F.col(f"{axis}_min") - wider) / reach), F.floor((F.col(f"{axis}_max") + wider) / reach))))
            return rows.select("at_lon", "at_lat", "id", "ring")

        other = laid(boxes, 0.0).withColumnsRenamed({"id": "nearest", "ring": "other"})
        pairs = laid(left, reach).join(other, ["at_lon", "at_lat"]).where("id <> nearest").dropDuplicates(["id", "nearest"])
        near = pairs.select("id", F.struct(distance(F.col("ring"), F.col("other")).alias("distance"), "nearest").alias("to"))
        near = near.groupBy("id").agg(F.min("to").alias("to")).select("id", "to.nearest", "to.distance")
        last = reach > (extent.whole or 0.0)
        done = rounds.kept(near if last else near.where(F.col("distance") <= reach))
        found = done if found is None else found.unionByName(done)
        if last:
            break
        left, reach = rounds.kept(left.join(done.select("id"), "id", "left_anti")), 2 * reach
    return found if found is not None else boxes.select("id", F.col("id").alias("nearest"), F.lit(0.0).alias("distance"))


def segregation(regions: DataFrame) -> DataFrame:
    """One row on how unevenly the outcome lies over regions (``n, p``; empty ones count for nothing).

    ``dissimilarity`` (the share of positives that would have to move for even rates), ``isolation`` (the rate that a
    positive meets in its region), ``exposure`` (the negatives' share that it meets), ``heterogeneity`` (entropy of the
    outcome that regions explain, Theil's H) and ``gini``, the mean impurity within regions. Null where all outcomes are equal.
    """
    rho = rate(F.col("p"), F.col("n"))

    def entropy(r: Column) -> Column:
        return -sum((F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0)) for x in (r, 1 - r)), F.lit(0.0))

    known = regions.where("n > 0")
    total = known.agg(F.sum("n").alias("nt"), F.sum("p").alias("pt"))
    rows = known.crossJoin(F.broadcast(total))
    share_p, share_q = F.try_divide(F.col("p"), F.col("pt")), F.try_divide(F.col("n") - F.col("p"), F.col("nt") - F.col("pt"))
    whole = entropy(rate(F.first("pt"), F.first("nt")))
    inside = F.sum(F.col("n") / F.col("nt") * entropy(rho))
    return rows.agg(
        rounded(F.sum(F.abs(share_p - share_q)) / 2).alias("dissimilarity"), rounded(F.sum(share_p * rho)).alias("isolation"), rounded(F.sum(share_p * (1 - rho))).alias("exposure"),
        rounded(F.try_divide(whole - inside, whole)).alias("heterogeneity"), rounded(F.sum(F.col("n") / F.col("nt") * 2 * rho * (1 - rho))).alias("gini"),
    )

"""Density clusters by DBSCAN (Ester and others 1996) on longitude and latitude in degrees, exactly.

Points lie in square cells whose diagonal is at most the radius, so those of one cell are all within it of each
other: a cell with enough points has core points only, and all core points of a cell are in one cluster. What is
left is sparse. Points of thin cells, fewer than ``least`` in each, look into the cells around them; and two cells
near each other are one cluster if any two of their core points are within the radius. For that no points are
compared: cells are halved, and the boxes of what is in them, which settles most pairs of boxes, and halved again
where it does not. So the points of a dense cell are counted and boxed, never gathered. Clusters are the components
of the cells. Cells side by side come first, by the boxes of their quarters: in dense places that joins all of them,
and only pairs of cells that are still in different clusters are halved further. So work follows the cells, however
many points each holds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.written import Rounds
from .components import components

CORE, BORDER, NOISE = "core", "border", "noise"
#: Halvings of a cell's sides in one step, and steps after which no two coordinates are in one box.
_HALVINGS, _STEPS = 3, 20
#: Cells on a side of a block, whose links are followed at once: 4,096 cells at most.
_BLOCK = 64


@dataclass(frozen=True)
class Dbscan:
    """The radius in degrees, and the points within it, itself included, that make a point a core point."""

    radius: float
    least: int

    @property
    def side(self) -> float:
        # A little less than the radius by the root of two, so that rounding cannot take a cell's corners apart.
        return self.radius / 2**0.5 * (1 - 1e-9)


def _near(x: Column, y: Column, d: Dbscan) -> Column:
    return x * x + y * y <= F.lit(d.radius * d.radius)


def _around(rows: DataFrame, own: bool) -> DataFrame:
    """Rows once for each cell that can hold a point within the radius: two away in either direction, but for the corners."""
    steps = [(x, y) for x in range(-2, 3) for y in range(-2, 3) if abs(x) + abs(y) < 4 and (own or x or y)]
    to = F.explode(F.array(*(F.struct((F.col("cx") + x).alias("cx"), (F.col("cy") + y).alias("cy")) for x, y in steps)))
    return rows.withColumn("to", to).drop("cx", "cy").select("*", "to.*").drop("to")


def with_cells(points: DataFrame, d: Dbscan) -> DataFrame:
    rows = points.where("lon is not null and lat is not null and not isnan(lon) and not isnan(lat)")
    return rows.select("point_id", "lon", "lat", *(F.floor(F.col(c) / d.side).alias(name) for c, name in (("lon", "cx"), ("lat", "cy"))))


def with_core(placed: DataFrame, d: Dbscan) -> DataFrame:
    """Points with ``core``. Only those of cells with fewer than ``least`` points look around."""
    sizes = placed.groupBy("cx", "cy").agg(F.count("*").alias("held"))
    sized = placed.join(sizes, ["cx", "cy"])
    thin = sized.where(F.col("held") < d.least)
    looks = _around(thin.select("point_id", F.col("lon").alias("x"), F.col("lat").alias("y"), "cx", "cy"), own=False)
    met = looks.join(placed.select("lon", "lat", "cx", "cy"), ["cx", "cy"]).where(_near(F.col("x") - F.col("lon"), F.col("y") - F.col("lat"), d))
    seen = met.groupBy("point_id").agg(F.count("*").alias("seen"))
    counted = thin.join(seen, "point_id", "left").withColumn("core", F.col("held") + F.coalesce("seen", F.lit(0)) >= d.least)
    columns = ["point_id", "lon", "lat", "cx", "cy", "core"]
    return counted.select(columns).unionByName(sized.where(F.col("held") >= d.least).withColumn("core", F.lit(True)).select(columns))


def _boxes(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*(f(c).alias(f"{c}_{name}") for c in ("lon", "lat") for name, f in (("min", F.min), ("max", F.max))))


def _apart(a: str, b: str, d: Dbscan) -> tuple[Column, Column]:
    """Whether all points of box ``a`` are near all of ``b``, and whether none is."""

    def most(c: str) -> Column:
        return F.greatest(F.abs(F.col(f"{a}.{c}_max") - F.col(f"{b}.{c}_min")), F.abs(F.col(f"{b}.{c}_max") - F.col(f"{a}.{c}_min")))

    def least(c: str) -> Column:
        return F.greatest(F.lit(0.0), F.col(f"{a}.{c}_min") - F.col(f"{b}.{c}_max"), F.col(f"{b}.{c}_min") - F.col(f"{a}.{c}_max"))

    return _near(most("lon"), most("lat"), d), ~_near(least("lon"), least("lat"), d)


def _followed(links: pa.Table) -> pa.Table:
    """``cx, cy, wx, wy``: the cells of links within one block, and the least cell that each is tied to."""
    u, v = (np.stack([links.column(f"{e}{c}").to_numpy() for c in "xy"]) for e in "uv")
    corner = u[:, :1] // _BLOCK * _BLOCK
    ends = [(x[0] - corner[0]) * _BLOCK + x[1] - corner[1] for x in (u, v)]
    label, before = np.arange(_BLOCK * _BLOCK), None
    while before is None or (label != before).any():
        before, least = label.copy(), np.minimum(label[ends[0]], label[ends[1]])
        for end in ends:
            np.minimum.at(label, end, least)
        label = label[label]
    cells = np.unique(np.concatenate(ends))
    columns = [x for k in (cells, label[cells]) for x in (k // _BLOCK + corner[0], k % _BLOCK + corner[1])]
    return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("cx", "cy", "wx", "wy"), columns, strict=True)})


def tied_cells(links: DataFrame, rounds: Rounds) -> DataFrame:
    """``node, whole``: each cell of ``links`` (``u, v``) and the least cell that can be reached from it.

    Links within a block are followed where they lie; what is left for rounds of joins is links between blocks.
    """
    ends = links.select(*(F.col(f"{e}.c{c}").alias(f"{e}{c}") for e in "uv" for c in "xy"))
    block = {f"{e}b{c}": F.floor(F.col(f"{e}{c}") / _BLOCK) for e in "uv" for c in "xy"}
    placed = rounds.kept(ends.withColumns(block))
    same = (F.col("ubx") == F.col("vbx")) & (F.col("uby") == F.col("vby"))
    inside = placed.where(same).groupBy("ubx", "uby").applyInArrow(_followed, "cx long, cy long, wx long, wy long")
    inside = rounds.kept(inside.select(F.struct("cx", "cy").alias("node"), F.struct(F.col("wx").alias("cx"), F.col("wy").alias("cy")).alias("own")))
    across = placed.where(~same).select(*(F.struct(F.col(f"{e}x").alias("cx"), F.col(f"{e}y").alias("cy")).alias(e) for e in "uv"))
    for e in "uv":
        across = across.join(inside.select(F.col("node").alias(e), F.col("own").alias(f"own_{e}")), e, "left").withColumn(e, F.coalesce(f"own_{e}", e)).drop(f"own_{e}")
    tied = components(across, rounds).select(F.col("node").alias("own"), F.col("component").alias("whole"))
    every = inside.unionByName(tied.select(F.col("own").alias("node"), "own").join(inside.select("node"), "node", "left_anti"))
    return rounds.kept(every.join(tied, "own", "left").select("node", F.coalesce("whole", "own").alias("whole")))


def _settled(pairs: DataFrame, cores: DataFrame, d: Dbscan, rounds: Rounds) -> DataFrame:
    """``u, v``: those of some pairs of cells that have core points within the radius of each other.

    Pairs of boxes that may hold such points go on to the next step, where each is cut into boxes of an eighth
    of the side, until every pair of cells is settled. A box of one place is settled at once.
    """

    def box(step: int) -> Column:
        """A number for the part of the cell that a point is in, from the sides halved again and again."""
        scale = float(1 << _HALVINGS * step)
        return F.struct(*(F.floor((F.col(c) / d.side - F.col(of)) * scale).alias(name) for c, of, name in (("lon", "cx", "bx"), ("lat", "cy", "by"))))

    cell = F.struct("cx", "cy")
    none = F.struct(F.lit(0).cast("long").alias("bx"), F.lit(0).cast("long").alias("by"))
    pairs = pairs.select("u", "v", none.alias("in_u"), none.alias("in_v"), "a", "b")
    found = None
    for step in range(1, _STEPS + 1):
        all_near, none_near = _apart("a", "b", d)
        judged = rounds.kept(pairs.where(~none_near).withColumn("linked", all_near).select("u", "v", "in_u", "in_v", "linked"))
        linked = rounds.kept(judged.where("linked").select("u", "v").distinct())
        found = linked if found is None else found.unionByName(linked)
        open_ = rounds.kept(judged.where("not linked").join(linked, ["u", "v"], "left_anti").select("u", "v", "in_u", "in_v"))
        if open_.isEmpty():
            return found
        # The boxes that are still open, each cut into smaller ones.
        boxes = open_.select(F.col("u").alias("cell"), F.col("in_u").alias("part")).unionByName(open_.select(F.col("v").alias("cell"), F.col("in_v").alias("part"))).distinct()
        inner = cores.select(cell.alias("cell"), box(step - 1).alias("part"), box(step).alias("inner"), "lon", "lat").join(boxes, ["cell", "part"])
        cut = rounds.kept(_boxes(inner, "cell", "part", "inner").select("cell", "part", "inner", F.struct(*_ENDS).alias("box")))
        one = cut.select(F.col("cell").alias("u"), F.col("part").alias("in_u"), F.col("inner").alias("to_u"), F.col("box").alias("a"))
        two = cut.select(F.col("cell").alias("v"), F.col("part").alias("in_v"), F.col("inner").alias("to_v"), F.col("box").alias("b"))
        pairs = open_.join(one, ["u", "in_u"]).join(two, ["v", "in_v"]).select("u", "v", F.col("to_u").alias("in_u"), F.col("to_v").alias("in_v"), "a", "b")
    raise ArithmeticError("boxes of single places were not settled")


_ENDS = tuple(f"{c}_{name}" for c in ("lon", "lat") for name in ("min", "max"))


def clustered_cells(cores: DataFrame, d: Dbscan, rounds: Rounds) -> DataFrame:
    """``node, whole``: cells (as ``cx, cy``) with core points, and the least one of those in the same cluster."""
    cell = F.struct("cx", "cy")
    half = (F.floor((F.col(c) / d.side - F.col(of)) * 2.0).alias(name) for c, of, name in (("lon", "cx", "hx"), ("lat", "cy", "hy")))
    quarters = rounds.kept(_boxes(cores.select("cx", "cy", *half, "lon", "lat"), "cx", "cy", "hx", "hy"))
    beside = F.explode(F.array(*(F.struct((F.col("cx") + x).alias("cx"), (F.col("cy") + y).alias("cy")) for x, y in ((1, 0), (0, 1), (1, 1), (1, -1)))))
    met = quarters.select(cell.alias("u"), beside.alias("v"), F.struct(*_ENDS).alias("a")).join(quarters.select(cell.alias("v"), F.struct(*_ENDS).alias("b")), "v")
    tied = tied_cells(rounds.kept(met.where(_apart("a", "b", d)[0]).select("u", "v").distinct()), rounds)
    whole = quarters.groupBy("cx", "cy").agg(*(f(c).alias(c) for c, f in zip(_ENDS, (F.min, F.max) * 2, strict=True)))
    first = rounds.kept(whole.select("cx", "cy", cell.alias("node"), F.struct(*_ENDS).alias("box")).join(tied, "node", "left").withColumn("whole", F.coalesce("whole", "node")))
    here = first.select(F.col("node").alias("u"), "cx", "cy", F.col("box").alias("a"), F.col("whole").alias("whole_u"))
    there = first.select(F.col("node").alias("v"), "cx", "cy", F.col("box").alias("b"), F.col("whole").alias("whole_v"))
    pairs = _around(here, own=False).join(there, ["cx", "cy"]).where("u < v and whole_u <> whole_v")
    links = _settled(pairs, cores, d, rounds)
    for e in "uv":
        links = links.join(first.select(F.col("node").alias(e), F.col("whole").alias(f"whole_{e}")), e)
    more = tied_cells(links.select(F.col("whole_u").alias("u"), F.col("whole_v").alias("v")).where("u <> v").distinct(), rounds)
    joined = first.select("node", "whole").join(more.select(F.col("node").alias("whole"), F.col("whole").alias("last")), "whole", "left")
    return joined.select("node", F.coalesce("last", "whole").alias("whole"))


def dbscan(points: DataFrame, radius: float, least: int) -> DataFrame:
    """``point_id, kind, cluster`` for each point with a place: core, border or noise.

    A cluster is named by the least point_id of its core points; noise has none. A border point goes to the cluster
    of the nearest core point, of equally near ones to the one whose cluster has the least name. Points with null or
    NaN coordinates are left out. Distances are in degrees on the plane, as for squares and grids.
    """
    if radius <= 0 or least < 1:
        raise ValueError("The radius must be above 0, and the least number of points 1 or more")
    d, rounds = Dbscan(radius, least), Rounds(points.sparkSession, "dbscan")
    known = rounds.kept(with_core(rounds.kept(with_cells(points, d)), d))
    cores = known.where("core")
    cell = F.struct("cx", "cy")
    cells = cores.groupBy(cell.alias("node")).agg(F.min("point_id").alias("first")).join(clustered_cells(cores, d, rounds), "node")
    names = cells.groupBy("whole").agg(F.min("first").alias("cluster"))
    named = rounds.kept(cells.join(names, "whole").select(F.col("node.cx").alias("cx"), F.col("node.cy").alias("cy"), "cluster"))
    inside = cores.join(named, ["cx", "cy"])
    rest = known.where("not core")
    looks = _around(rest.select("point_id", F.col("lon").alias("x"), F.col("lat").alias("y"), "cx", "cy"), own=True)
    away = (F.col("x") - F.col("lon")) * (F.col("x") - F.col("lon")) + (F.col("y") - F.col("lat")) * (F.col("y") - F.col("lat"))
    met = looks.join(inside.select("lon", "lat", "cx", "cy", "cluster"), ["cx", "cy"]).where(away <= F.lit(radius * radius))
    border = met.groupBy("point_id").agg(F.min(F.struct(away.alias("d"), "cluster")).alias("to"))
    outer = rest.join(border, "point_id", "left").select("point_id", F.when(F.col("to").isNull(), NOISE).otherwise(BORDER).alias("kind"), F.col("to.cluster").alias("cluster"))
    return inside.select("point_id", F.lit(CORE).alias("kind"), "cluster").unionByName(outer)


def cluster_table(labels: DataFrame, points: DataFrame) -> DataFrame:
    """A row for each cluster: ``n`` points, ``core`` ones, ``p`` positive, their rate ``rho``, ``share`` of all points, and bounds."""
    total = points.agg(F.count("*").alias("total"))
    met = labels.where("cluster is not null").join(points, "point_id")
    rows = met.groupBy("cluster").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("kind") == CORE, 1)).alias("core"), F.sum(F.col("outcome").cast("long")).alias("p"),
        *(f(c).alias(f"{c}_{name}") for c in ("lon", "lat") for name, f in (("min", F.min), ("max", F.max))),
    )
    rows = rows.crossJoin(F.broadcast(total))
    return rows.select("cluster", "n", "core", "p", F.round(F.col("p") / F.col("n"), 6).alias("rho"), F.round(F.col("n") / F.col("total"), 6).alias("share"), "lon_min", "lat_min", "lon_max", "lat_max")

"""Nearest points on the sphere, exactly and without a point on the driver.

Places are points of the unit sphere in space. A tree halves space along all axes, twice a step, and stops where
few places are left; so it is deep where points are dense. Leaves are the unit of work: each goes down the tree
with the box of its places, level by level for all leaves at once, and keeps the nodes that may hold an answer for
one of them. What each node can add at least and at most follows from the two boxes; the answers that enough
points are sure to reach rule out all nodes that cannot. Leaf by leaf the places that are left are then compared.
Plans are joins and windows over boxes; only a leaf's places and those of a few others are ever side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.written import Rounds

#: Halvings of space along each axis, those in one step, and the places in a leaf.
_BITS, _STEP, _LEAF = 20, 2, 128
_LEVELS = _BITS // _STEP
#: Candidates of a leaf that are compared with it at once.
_MET = 16
_AXES = ("x", "y", "z")
#: Room for rounding in bounds, as shares of what is compared and in itself.
_SHARE, _ROOM = 1e-9, 1e-12
_NODE = ("l", *(f"q{a}" for a in _AXES), "chunk")


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Central angles between rows of (lat, lon) in radians."""
    half = np.sin((a[:, None, 0] - b[None, :, 0]) / 2) ** 2 + np.cos(a[:, None, 0]) * np.cos(b[None, :, 0]) * np.sin((a[:, None, 1] - b[None, :, 1]) / 2) ** 2
    return 2 * np.arcsin(np.sqrt(np.minimum(half, 1)))


def spots_of(points: DataFrame, most: int) -> DataFrame:
    """Different places (``lat, lon`` in degrees) with the ``most`` least ids of the points there.

    No answer needs more of a place, so a place of very many points is cut down before it is shuffled.
    """
    there = points.where("lon is not null and lat is not null and not isnan(lon) and not isnan(lat)").select("point_id", "lat", "lon")
    first = there.withColumn("k", F.row_number().over(Window.partitionBy("lat", "lon").orderBy("point_id"))).where(F.col("k") <= most)
    return first.groupBy("lat", "lon").agg(F.sort_array(F.collect_list("point_id")).alias("ids"))


def _box(value: str = "") -> list[Column]:
    """Bounds and counts of places, or of what is below a node (``value`` names its struct)."""
    ends = [f(f"{value}{a}_{name}" if value else a).alias(f"{a}_{name}") for a in _AXES for name, f in (("min", F.min), ("max", F.max))]
    own = [F.min(f"{value}v_min" if value else "v").alias("v_min"), F.max(f"{value}v_max" if value else "v").alias("v_max")]
    return [*ends, *own, F.sum(f"{value}n" if value else F.size("ids")).cast("long").alias("n")]


@dataclass(frozen=True)
class Tree:
    """``leaves`` (node, box, places as arrays) and ``steps`` (from a node to those below it, or from a leaf to itself)."""

    leaves: DataFrame
    steps: DataFrame
    depth: int


def grown(spots: DataFrame, rounds: Rounds, leaf: int | None = None) -> Tree:
    """The tree over ``lat, lon, ids, v``; ``v`` is a number of the place's own, whose bounds nodes keep too.

    Places are on the sphere, unless they come with ``la, lo`` and with ``x, y, z`` from -1 to 1 of their own.
    """
    leaf, la, lo = leaf or _LEAF, F.radians("lat"), F.radians("lon")
    placed = spots if "x" in spots.columns else spots.withColumns({"la": la, "lo": lo, "x": F.cos(la) * F.cos(lo), "y": F.cos(la) * F.sin(lo), "z": F.sin(la)})
    whole = placed.withColumns({f"q{a}": F.least(F.floor((F.col(a) + 1) / 2 * (1 << _BITS)), F.lit((1 << _BITS) - 1)).cast("int") for a in _AXES})
    spots = rounds.kept(whole)

    def at(level: Column | str, shift: str = f"{_BITS} - {_STEP} * l") -> list[Column]:
        return [F.expr(f"shiftright(q{a}, {shift})").alias(f"q{a}") for a in _AXES]

    every = spots.select(*(f"q{a}" for a in _AXES), F.explode(F.sequence(F.lit(0), F.lit(_LEVELS))).alias("l")).select("l", *at("l"))
    nodes = every.groupBy("l", *(f"q{a}" for a in _AXES)).agg(F.count("*").alias("held"))
    over = rounds.kept(nodes.where((F.col("held") > leaf) & (F.col("l") < _LEVELS)).select("l", *(f"q{a}" for a in _AXES)))
    # A leaf holds few places, or cannot be halved again, below a node that holds more.
    below = over.select((F.col("l") + 1).alias("l"), *(F.col(f"q{a}").alias(f"p{a}") for a in _AXES))
    few = nodes.where((F.col("held") <= leaf) | (F.col("l") == _LEVELS)).withColumns({f"p{a}": F.expr(f"shiftright(q{a}, {_STEP})") for a in _AXES})
    kept = few.join(below, ["l", *(f"p{a}" for a in _AXES)], "left_semi").unionByName(few.where("l = 0")).select("l", *(f"q{a}" for a in _AXES), "held")
    kept = rounds.kept(kept)
    levels = sorted(r[0] for r in kept.select("l").distinct().collect())
    depth = max(levels, default=0)
    # Places meet their leaf at one of the levels that have leaves.
    looks = spots.withColumn("l", F.explode(F.array(*map(F.lit, levels or [0])))).select("l", *at("l"), "lat", "lon", "la", "lo", *_AXES, "v", "ids")
    met = looks.join(kept, ["l", *(f"q{a}" for a in _AXES)])
    chunk = F.pmod(F.xxhash64("lat", "lon"), F.ceil(F.col("held") / leaf)).cast("int")
    held = F.collect_list(F.struct("lat", "lon", "la", "lo", "v", "ids")).alias("s")
    leaves = met.withColumn("chunk", chunk).groupBy(*_NODE).agg(*_box(), held)
    box = [c for c in leaves.columns if c not in (*_NODE, "s")]
    leaves = rounds.kept(leaves.select(F.struct(*_NODE).alias("node"), F.struct(*box).alias("box"), *(F.col(f"s.{c}").alias(c) for c in ("lat", "lon", "la", "lo", "v", "ids"))))
    small = leaves.select("node", "box")
    # Inner nodes add up what is below them: a row for each leaf and level.
    up = small.where("node.l > 0").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("node.l") - 1)))
    inner = up.select(F.struct(F.col("to").alias("l"), *(F.expr(f"shiftright(node.q{a}, {_STEP} * (node.l - to))").alias(f"q{a}") for a in _AXES), F.lit(0).alias("chunk")).alias("node"), "box")
    inner = inner.groupBy("node").agg(F.struct(*_box("box.")).alias("box"))
    parent = F.struct((F.col("node.l") - 1).alias("l"), *(F.expr(f"shiftright(node.q{a}, {_STEP})").alias(f"q{a}") for a in _AXES), F.lit(0).alias("chunk"))
    downs = small.unionByName(inner).where("node.l > 0").select(parent.alias("from"), "node", "box")
    stays = small.select(F.col("node").alias("from"), "node", "box")
    return Tree(leaves, rounds.kept(downs.unionByName(stays)), depth)


def _least(a: str, b: str) -> Column:
    """The least distance between two boxes, squared."""
    gaps = (F.greatest(F.lit(0.0), F.col(f"{a}.{c}_min") - F.col(f"{b}.{c}_max"), F.col(f"{b}.{c}_min") - F.col(f"{a}.{c}_max")) for c in _AXES)
    return sum((g * g for g in gaps), F.lit(0.0))


def _most(a: str, b: str) -> Column:
    ends = (F.greatest(F.abs(F.col(f"{a}.{c}_max") - F.col(f"{b}.{c}_min")), F.abs(F.col(f"{b}.{c}_max") - F.col(f"{a}.{c}_min"))) for c in _AXES)
    return sum((g * g for g in ends), F.lit(0.0))


Bounds = Callable[[str, str], tuple[Column, Column]]


def distance_bounds(a: str, b: str) -> tuple[Column, Column]:
    return _least(a, b), _most(a, b)


def reach_bounds(a: str, b: str) -> tuple[Column, Column]:
    """Bounds of the largest of two places' own values and their distance, all squared."""

    def with_own(distance: Column, name: str) -> Column:
        one, two = F.col(f"{a}.v_{name}"), F.col(f"{b}.v_{name}")
        return F.greatest(distance, one * one, two * two)

    return with_own(_least(a, b), "min"), with_own(_most(a, b), "max")


def farthest_bounds(a: str, b: str) -> tuple[Column, Column]:
    """The same for the largest instead of the smallest: what is searched for is its negative."""
    low, high = reach_bounds(a, b)
    return -high, -low


def candidates(tree: Tree, bounds: Bounds, need: int, rounds: Rounds, reach: DataFrame | None = None) -> DataFrame:
    """``q, to, low``: leaves, and those that may hold one of the ``need`` smallest answers for one of their places.

    ``reach`` (``node, reach``): a bound of those answers that is known of each leaf beforehand.
    """
    here = tree.leaves.select(F.col("node").alias("q"), F.col("box").alias("a"))
    here = here.withColumn("known", F.lit(float("inf"))) if reach is None else here.join(reach.select(F.col("node").alias("q"), F.col("reach").alias("known")), "q")
    # All begin at the root, which has 64 nodes below it at most.
    root = F.broadcast(tree.steps.where("from.l = 0").select(F.col("node").alias("to"), F.col("box").alias("b")))
    steps = tree.steps.select(F.col("from").alias("at"), F.col("node").alias("to"), F.col("box").alias("b"))
    low, high = bounds("a", "b")
    for level in range(max(1, tree.depth)):
        met = here.join(steps, "at") if level else here.crossJoin(root)
        seen = met.select("q", "a", "known", "to", F.col("b.n").alias("n"), low.alias("low"), high.alias("high"))
        # The answer that so many points are sure to reach.
        sure = F.sum("n").over(Window.partitionBy("q").orderBy("high"))
        seen = seen.withColumn("sure", F.when(sure >= need, F.col("high"))).withColumn("bound", F.min("sure").over(Window.partitionBy("q")))
        bound = F.least("bound", "known")  # of what is not null
        open_ = F.col("low") <= bound + F.abs(bound) * _SHARE + _ROOM
        here = seen.where(open_).select("q", "a", "known", F.col("to").alias("at"), "low")
        if level % 3 == 2:
            here = rounds.kept(here)
    return here.select("q", F.col("at").alias("to"), "low")


def _compared(tree: Tree, pairs: DataFrame, fold: Callable, result: str) -> DataFrame:
    """Runs ``fold`` over each leaf and its candidates, nearest first: the first alone, then a few at a time."""
    other = tree.leaves.select(F.col("node").alias("to"), *(F.col(c).alias(f"{c}_b") for c in ("la", "lo", "v", "ids")))
    return _folded(pairs.join(other, "to"), tree, fold, result)


def _folded(met: DataFrame, tree: Tree, fold: Callable, result: str) -> DataFrame:
    """Runs ``fold`` over each leaf and what it has ``met``; a leaf's own places come once, before them."""
    columns, theirs = ("lat", "lon", "la", "lo", "v", "ids"), [f"{c}_b" for c in ("la", "lo", "v", "ids")]
    own = tree.leaves.select(F.col("node").alias("q"), F.lit(float("-inf")).alias("low"), *(F.col(c).alias(f"{c}_a") for c in columns))
    both = own.unionByName(met.select("q", "low", *theirs), allowMissingColumns=True)
    both = both.withColumn("key", F.concat_ws(" ", *(F.col(f"q.{c}").cast("string") for c in _NODE))).withColumn("whose", F.col("la_a").isNull())
    rows = both.repartition("key").sortWithinPartitions("key", "whose", "low").select("key", *(f"{c}_a" for c in columns), *theirs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys = batch.column("key").to_pylist()
            low = 0
            while low < len(keys):
                if keys[low] != key:
                    if state is not None:
                        yield state.done()
                    key, state = keys[low], fold({c: batch.column(c)[low] for c in batch.schema.names})
                    low, most = low + 1, 1  # the nearest alone, so that it bounds the others
                    continue
                high = low + 1
                while high < min(len(keys), low + most) and keys[high] == key:
                    high += 1
                state.meet({c: SimpleNamespace(values=batch.column(c).slice(low, high - low).flatten()) for c in ("la_b", "lo_b", "v_b", "ids_b")})
                low, most = high, _MET
        if state is not None:
            yield state.done()

    return rows.mapInArrow(run, result)


def _places(row: dict, side: str) -> np.ndarray:
    return np.stack([row[f"{c}_{side}"].values.to_numpy(zero_copy_only=False) for c in ("la", "lo")], axis=1)


def _in_space(places: np.ndarray) -> np.ndarray:
    la, lo = places.T
    return np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=1)


class _Lists:
    """The k nearest points of each place of a leaf: angles and ids, nearest and then least first."""

    def __init__(self, row: dict, k: int):
        self.k, self.row, self.at = k, row, _places(row, "a")
        n, self.space = len(self.at), _in_space(self.at)
        self.d, self.ids = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def meet(self, row: dict) -> None:
        other = _places(row, "b")
        # Chords, which are quick, tell which places may be among the nearest of which; angles of those alone are taken.
        chords = 2 - 2 * (self.space @ _in_space(other).T)
        near = chords <= (4 * np.sin(np.minimum(self.d[:, -1], np.pi) / 2) ** 2 * (1 + _SHARE) + 1e-14)[:, None]
        mine, use = np.flatnonzero(near.any(axis=1)), near.any(axis=0)
        if not len(mine):
            return
        away = angles(self.at[mine], other[use])
        ids = row["ids_b"].values
        sizes = ids.value_lengths().to_numpy(zero_copy_only=False)
        flat = ids.flatten().to_numpy(zero_copy_only=False)[np.repeat(use, sizes)]
        d = np.concatenate([self.d[mine], np.repeat(away, sizes[use], axis=1)], axis=1)
        every = np.concatenate([self.ids[mine], np.broadcast_to(flat, (len(mine), len(flat)))], axis=1)
        order = np.lexsort((every, d), axis=1)[:, : self.k]
        self.d[mine], self.ids[mine] = np.take_along_axis(d, order, 1), np.take_along_axis(every, order, 1)

    def done(self) -> pa.RecordBatch:
        there = np.isfinite(self.d)
        starts = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(starts), pa.array(x[there])) for x in (self.d, self.ids)]
        return pa.RecordBatch.from_arrays([self.row["lat_a"].values, self.row["lon_a"].values, *lists], names=["lat", "lon", "d", "near"])


class _Reach:
    """The least or largest mutual reachability of each place with points other than one of its own."""

    def __init__(self, row: dict, largest: bool):
        self.largest, self.row, self.at = largest, row, _places(row, "a")
        self.own = row["v_a"].values.to_numpy(zero_copy_only=False)
        self.best = np.full(len(self.at), -np.inf if largest else np.inf)

    def meet(self, row: dict) -> None:
        other, v = _places(row, "b"), row["v_b"].values.to_numpy(zero_copy_only=False)
        # Values of places are chords; a place's angle follows.
        d = np.maximum(np.maximum(angles(self.at, other), 2 * np.arcsin(np.minimum(self.own / 2, 1))[:, None]), 2 * np.arcsin(np.minimum(v / 2, 1))[None, :])
        if not self.largest:
            alone = row["ids_b"].values.value_lengths().to_numpy(zero_copy_only=False) == 1
            same = (self.at[:, None, :] == other[None, :, :]).all(axis=2) & alone[None, :]
            d = np.where(same, np.inf, d)
        self.best = np.maximum(self.best, d.max(axis=1)) if self.largest else np.minimum(self.best, d.min(axis=1))

    def done(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self.row["lat_a"].values, self.row["lon_a"].values, pa.array(self.best)], names=["lat", "lon", "value"])


_LIST = "lat double, lon double, d array<double>, near array<long>"


def _reached(tree: Tree, k: int) -> DataFrame:
    """``node, reach``: how far each leaf's places look at most: squared, in space, to the k-th point of their own leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                at = np.stack([batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in _AXES], axis=1)
                size = batch.column("n")[row].values.to_numpy(zero_copy_only=False)
                chords = ((at[:, None, :] - at[None, :, :]) ** 2).sum(axis=2)
                rank = np.argsort(chords, axis=1)
                held = np.cumsum(size[rank], axis=1)
                there = np.take_along_axis(chords, rank, 1)[np.arange(len(at)), np.minimum((held < k).sum(axis=1), len(at) - 1)]
                out.append(float(there.max()) if size.sum() >= k else np.inf)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.float64())], names=["node", "reach"])

    la, lo = F.col("la"), F.col("lo")
    space = {
        "x": F.zip_with(la, lo, lambda a, b: F.cos(a) * F.cos(b)),
        "y": F.zip_with(la, lo, lambda a, b: F.cos(a) * F.sin(b)),
        "z": F.transform(la, F.sin),
    }
    rows = tree.leaves.select("node", *(c.alias(a) for a, c in space.items()), F.transform("ids", F.size).alias("n"))
    return rows.mapInArrow(run, f"node {tree.leaves.schema['node'].dataType.simpleString()}, reach double")


def _near_places(tree: Tree, pairs: DataFrame) -> DataFrame:
    """``q, low`` and, as arrays, the places of another leaf that are within reach of ``q``'s box; the leaf itself has all."""
    other = tree.leaves.select(F.col("node").alias("to"), F.arrays_zip("la", "lo", "v", "ids").alias("s"))
    met = pairs.join(other, "to")

    def within(p: Column) -> Column:
        at = {"x": F.cos(p["la"]) * F.cos(p["lo"]), "y": F.cos(p["la"]) * F.sin(p["lo"]), "z": F.sin(p["la"])}
        gaps = (F.greatest(F.lit(0.0), F.col(f"a.{c}_min") - at[c], at[c] - F.col(f"a.{c}_max")) for c in _AXES)
        return sum((g * g for g in gaps), F.lit(0.0)) <= F.col("reach") * (1 + _SHARE) + _ROOM

    kept = met.select("q", "low", F.when(F.col("q") == F.col("to"), F.col("s")).otherwise(F.filter("s", within)).alias("s")).where(F.size("s") > 0)
    return kept.select("q", "low", *(F.col(f"s.{c}").alias(f"{c}_b") for c in ("la", "lo", "v", "ids")))


def _lists(points: DataFrame, k: int, rounds: Rounds) -> tuple[DataFrame, DataFrame]:
    """Places with their ids, and the ``k`` nearest points of each, those on it among them.

    A leaf's own places bound how far it looks, so that of others only the places next to it are sent; its own are sent once.
    """
    spots = rounds.kept(spots_of(points, max(k, 2)))
    tree = grown(spots.withColumn("v", F.lit(0.0)), rounds)
    reach = rounds.kept(_reached(tree, k))
    pairs = candidates(tree, distance_bounds, k, rounds, reach)
    boxes = reach.select(F.col("node").alias("q"), "reach").join(tree.leaves.select(F.col("node").alias("q"), F.col("box").alias("a")), "q")
    met = _near_places(tree, pairs.join(boxes, "q"))
    return spots, rounds.kept(_folded(met, tree, lambda row: _Lists(row, k), _LIST))


def nearest_neighbours(points: DataFrame, k: int) -> DataFrame:
    """``point_id, rank, neighbour, distance``: the ``k`` nearest others of each point, by central angle, rounded to 8 digits.

    Of equally near ones the least ids come first. Fewer than ``k`` others are all neighbours. Points without a place
    take no part. Also a graph: a row is an edge from a point to a near one.
    """
    rounds = Rounds(points.sparkSession, "neighbours")
    _, lists = _lists(points, k + 1, rounds)
    met = points.select("point_id", "lat", "lon").join(lists, ["lat", "lon"])
    others = F.slice(F.filter(F.arrays_zip("near", "d"), lambda x: x["near"] != F.col("point_id")), 1, k)
    rows = met.select("point_id", F.posexplode(others).alias("at", "to"))
    return rows.select("point_id", (F.col("at") + 1).alias("rank"), F.col("to.near").alias("neighbour"), F.round("to.d", 8).alias("distance"))


def core_distances(points: DataFrame, k: int) -> DataFrame:
    """``point_id, core``: distance to the k-th nearest point, itself included; no rows with fewer than k points."""
    _, lists = _lists(points, k, Rounds(points.sparkSession, "core"))
    whole = lists.where(F.size("d") >= k).select("lat", "lon", F.round(F.element_at("d", k), 8).alias("core"))
    return points.select("point_id", "lat", "lon").join(whole, ["lat", "lon"]).select("point_id", "core")


def mutual_reachability(points: DataFrame, k: int) -> DataFrame:
    """``point_id, core, nearest, farthest``: the extremes of a point's mutual reachability distances to the others.

    That distance is the largest of the two core distances and their own. No rows with fewer than k points, or one.
    """
    rounds = Rounds(points.sparkSession, "reachability")
    spots, lists = _lists(points, k, rounds)
    cores = lists.where(F.size("d") >= k).select("lat", "lon", F.element_at("d", k).alias("core"))
    valued = spots.join(cores, ["lat", "lon"]).withColumn("v", 2 * F.sin(F.col("core") / 2))
    tree = grown(valued.select("lat", "lon", "ids", "v"), rounds)
    out = cores
    for name, bounds, need, largest in (("nearest", reach_bounds, 2, False), ("farthest", farthest_bounds, 1, True)):
        found = _compared(tree, candidates(tree, bounds, need, rounds), lambda row, x=largest: _Reach(row, x), "lat double, lon double, value double")
        out = out.join(found.where(F.col("value") < float("inf")).select("lat", "lon", F.round("value", 8).alias(name)), ["lat", "lon"])
    return points.select("point_id", "lat", "lon").join(out, ["lat", "lon"]).select("point_id", F.round("core", 8).alias("core"), "nearest", "farthest")

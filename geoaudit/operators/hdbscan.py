"""Density-based clusters: HDBSCAN (Campello, Moulavi and Sander 2013) on the sphere.

Distances are central angles. Core distances and each round's shortest edges out of every component
(Boruvka's algorithm on mutual reachability) are computed by tasks that each take some leaves of a tree of boxes
over the points, and go down it: boxes that lie within a core distance are counted whole, boxes that cannot hold an
edge as short as one that is known are left out. Points of one place have one core distance, which no edge of theirs is
shorter than, so a place stands for all of them, with their number. Places are broadcast, up to ``MOST_PLACES`` of
them, however many points there are: the tree that follows needs them on one machine. It is condensed on the driver;
the points get their labels by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import min_cluster_size

#: Points that are counted, and different places that the tree is made of.
MOST_POINTS, MOST_PLACES = 1 << 31, 1_000_000
_LEAF, _BLOCK = 64, 16
#: Room for rounding in bounds, as a share and in itself.
_SHARE, _ROOM = 1e-9, 1e-12


def _halves(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What grows with the central angles between rows of (lat, lon) in radians."""
    return np.sin((a[:, None, 0] - b[None, :, 0]) / 2) ** 2 + np.cos(a[:, None, 0]) * np.cos(b[None, :, 0]) * np.sin((a[:, None, 1] - b[None, :, 1]) / 2) ** 2


def _as_angles(half: np.ndarray) -> np.ndarray:
    return 2 * np.arcsin(np.sqrt(np.minimum(half, 1)))


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Central angles between rows of (lat, lon) in radians."""
    return _as_angles(_halves(a, b))


class _Boxes:
    """A tree that halves the points level by level: ``order`` of the points by leaf, and of each level's nodes the
    first points (``starts``, one more at the end) and the boxes in space."""

    def __init__(self, places: np.ndarray):
        n, (la, lo) = len(places), places.T
        at = np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=1)
        self.depth = max(0, int(np.ceil(np.log2(max(n, 1) / _LEAF))))
        self.starts = [np.arange((1 << level) + 1) * n >> level for level in range(self.depth + 1)]
        self.order = np.arange(n)
        for starts in self.starts[:-1]:
            own = at[self.order]
            widest = (np.maximum.reduceat(own, starts[:-1]) - np.minimum.reduceat(own, starts[:-1])).argmax(axis=1)
            node = np.repeat(np.arange(len(widest)), np.diff(starts))
            self.order = self.order[np.lexsort((own[np.arange(n), widest[node]], node))]
        own = at[self.order]
        self.low, self.high = self.by_node(np.minimum, own), self.by_node(np.maximum, own)

    def by_node(self, f: np.ufunc, values: np.ndarray) -> list[np.ndarray]:
        """``f`` over the values, in ``order``, of the points of each node, level by level."""
        out = [f.reduceat(values, self.starts[-1][:-1])]
        for _ in range(self.depth):
            out.append(f(out[-1][::2], out[-1][1::2]))
        return out[::-1]

    def away(self, leaf: int, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest angle between points of a leaf and of each of some nodes, with room for rounding."""
        low, high, to, up = self.low[-1][leaf], self.high[-1][leaf], self.low[level][nodes], self.high[level][nodes]
        gap = np.maximum(np.maximum(to - high, low - up), 0)
        span = np.maximum(np.abs(up - low), np.abs(high - to))
        least, most = (2 * np.arcsin(np.minimum(np.sqrt((x * x).sum(axis=1)) / 2, 1)) for x in (gap, span))
        return least * (1 - _SHARE) - _ROOM, most * (1 + _SHARE) + _ROOM

    def points(self, leaves: np.ndarray) -> np.ndarray:
        """Places in ``order`` of the points of some leaves."""
        first, size = self.starts[-1][leaves], self.starts[-1][leaves + 1] - self.starts[-1][leaves]
        return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _by_chunk(spark, n: int, work, schema: str) -> pa.Table:
    """Run ``work(first, end)`` over chunks of ``n`` numbers, spread over the cluster."""
    step = max(1, min(64, -(-n // (4 * spark.sparkContext.defaultParallelism))))
    chunks = spark.range(-(-n // step), numPartitions=max(1, min(-(-n // step), 10_000)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.column(0).to_pylist():
                yield work(c * step, min(n, (c + 1) * step))

    return chunks.mapInArrow(run, schema).toArrow()


def _cores(spark, where, n: int, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """The distance to the k-th nearest point, itself included, of each of ``n`` places; ``weights``: the points there."""
    if not n:
        return np.zeros(0)
    tree = _Boxes(where.value)
    own_weights = np.ones(n, np.int64) if weights is None else weights[tree.order]
    alone = bool((own_weights == 1).all())
    sent = spark.sparkContext.broadcast((tree, own_weights, np.concatenate([[0], np.cumsum(own_weights)])))

    def of_leaf(tree: _Boxes, weights: np.ndarray, before: np.ndarray, places: np.ndarray, leaf: int) -> np.ndarray:
        nodes, need = np.zeros(1, np.int64), k
        for level in range(1, tree.depth + 1):
            nodes = np.concatenate([2 * nodes, 2 * nodes + 1])
            low, high = tree.away(leaf, level, nodes)
            size = before[tree.starts[level][nodes + 1]] - before[tree.starts[level][nodes]]
            near, far = np.argsort(low), np.argsort(high)
            # The k-th point is at least as far as where nodes that begin nearer have k points, and at most where those that end do.
            least = low[near[np.searchsorted(np.cumsum(size[near]), need)]]
            most = high[far[np.searchsorted(np.cumsum(size[far]), need)]]
            within = high < least
            need -= int(size[within].sum())
            nodes = nodes[(low <= most) & ~within]
        own = tree.order[slice(*tree.starts[-1][leaf : leaf + 2])]
        there = tree.points(nodes)
        half = _halves(places[own], places[tree.order[there]])
        if alone:
            return _as_angles(np.partition(half, need - 1, axis=1)[:, need - 1])
        rank = np.argsort(half, axis=1)
        at = (np.cumsum(weights[there][rank], axis=1) < need).sum(axis=1)
        rows = np.arange(len(own))
        return _as_angles(half[rows, rank[rows, at]])

    def work(first: int, end: int) -> pa.RecordBatch:
        tree, weights, before = sent.value
        found = [of_leaf(tree, weights, before, where.value, leaf) for leaf in range(first, end)]
        return pa.RecordBatch.from_arrays([pa.array(tree.order[tree.starts[-1][first] : tree.starts[-1][end]]), pa.array(np.concatenate(found))], names=["i", "core"])

    found = _by_chunk(spark, 1 << tree.depth, work, "i long, core double").sort_by("i")
    return found.column("core").to_numpy()


def _spots(points: DataFrame) -> DataFrame:
    """Different places ``lat, lon``, with the least id and the number ``n`` of the points there."""
    return points.groupBy("lat", "lon").agg(F.min("point_id").alias("point_id"), F.count("*").alias("n"))


def _placed(points: DataFrame) -> pa.Table:
    """Places in the order of their first points; more than ``MOST_PLACES`` of them raise: coarsen them first."""
    spots = _spots(points)
    n, places = spots.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if n > MOST_POINTS or places > MOST_PLACES:
        raise ValueError(f"{n} points at {places} places; at most {MOST_POINTS} at {MOST_PLACES} are compared with each other")
    return spots.select("lat", "lon", F.radians("lat").alias("la"), F.radians("lon").alias("lo"), "point_id", "n").toArrow().sort_by("point_id")


def _frame(spark: SparkSession, columns: dict, schema: str) -> DataFrame:
    table = pa.table(columns)
    return spark.createDataFrame(table) if table.num_rows else spark.createDataFrame([], schema)


def _shortest(spark, fixed, component: np.ndarray, known: np.ndarray, stride: int) -> pa.Table:
    """Of every ``stride``-th leaf's points, the first edge by (d, lower, higher end) out of each component that is not longer than ``known``."""
    tree = fixed.value[0]
    own = component[tree.order]
    least, most = tree.by_node(np.minimum, own), tree.by_node(np.maximum, own)
    sent = spark.sparkContext.broadcast((own, known, least, most))

    def of_leaf(leaf: int, bound: np.ndarray) -> list[tuple]:
        tree, places, core, (core_min, core_max, first_id) = fixed.value
        of, _, least, most = sent.value
        here = np.arange(*tree.starts[-1][leaf : leaf + 2])
        here = here[core[here] <= bound[of[here]]]
        if not len(here):
            return []
        whose, cores = of[here], core[here]
        alone = bool((whose == whose[0]).all())
        nodes = np.zeros(1, np.int64)
        for level in range(tree.depth + 1):
            if level:
                nodes = np.concatenate([2 * nodes, 2 * nodes + 1])
            if alone:
                nodes = nodes[(least[level][nodes] != whose[0]) | (most[level][nodes] != whose[0])]
            low, high = tree.away(leaf, level, nodes)
            low = np.maximum(np.maximum(low, core_min[level][nodes]), cores.min())
            limit = bound[whose].max()
            if alone:  # all points of such a node may be joined
                other = (most[level][nodes] < whose[0]) | (least[level][nodes] > whose[0])
                limit = min(limit, np.maximum(np.maximum(high, core_max[level][nodes]), cores.max())[other].min(initial=np.inf))
            nodes, low = nodes[low <= limit], low[low <= limit]
        order = np.argsort(low, kind="stable")  # the nearest, then those with the first points, as of equal edges the first counts
        order = np.concatenate([order[:4], order[4:][np.argsort(first_id[-1][nodes[order[4:]]], kind="stable")]])
        nodes, low = nodes[order], low[order]
        best, to = np.full(len(here), np.inf), np.full(len(here), len(of))
        step = 4
        while len(nodes):
            there = tree.points(nodes[:step])
            there = there[np.argsort(tree.order[there])]
            d = np.maximum(np.maximum(_angles(places[here], places[there]), cores[:, None]), core[there])
            d[whose[:, None] == of[there]] = np.inf
            at = d.argmin(axis=1)
            value, names = d[np.arange(len(at)), at], tree.order[there[at]]
            better = (value < best) | ((value == best) & (names < to) & np.isfinite(value))
            best[better], to[better] = value[better], names[better]
            np.minimum.at(bound, whose, best)
            nodes, low, step = nodes[step:], low[step:], _BLOCK
            at_least = np.maximum(low[None, :], cores[:, None])
            open_ = (at_least < best[:, None]) | ((at_least == best[:, None]) & (first_id[-1][nodes][None, :] < to[:, None]))
            open_ = (open_ & (at_least <= bound[whose][:, None])).any(axis=0)
            nodes, low = nodes[open_], low[open_]
        some = np.flatnonzero(best <= bound[whose])
        some = some[np.isfinite(best[some])]
        return [whose[some], best[some], tree.order[here[some]], to[some]]

    def work(first: int, end: int) -> pa.RecordBatch:
        bound = sent.value[1].copy()
        found = [x for x in (of_leaf(leaf * stride, bound) for leaf in range(first, end)) if len(x)]
        c, d, a, b = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.float64 if k == 1 else np.int64) for k in range(4))
        order = np.lexsort((np.maximum(a, b), np.minimum(a, b), d, c))
        order = order[np.concatenate([[True], np.diff(c[order]) != 0])] if len(order) else order
        return pa.RecordBatch.from_arrays([pa.array(x[order]) for x in (c, d, a, b)], names=["c", "d", "a", "b"])

    found = _by_chunk(spark, -(-(1 << tree.depth) // stride), work, "c long, d double, a long, b long")
    sent.unpersist()
    return found


def _spanning_tree(spark, where, core: np.ndarray) -> np.ndarray:
    """Edges (distance, a, b) of a minimum spanning tree of the mutual reachability graph."""
    n, edges = len(core), []
    component, tree = np.arange(n), _Boxes(where.value)
    values = [tree.by_node(f, x[tree.order]) for f, x in ((np.minimum, core), (np.maximum, core), (np.minimum, np.arange(n)))]
    fixed = spark.sparkContext.broadcast((tree, where.value[tree.order], core[tree.order], values))
    while len(edges) < n - 1:
        found = None
        known = np.full(n, np.inf)
        # Some of the leaves first: what they find bounds the search of the others.
        for stride in (16, 1) if edges and tree.depth > 4 else (1,):
            part = _shortest(spark, fixed, component, known, stride)
            c, d = (part.column(x).to_numpy() for x in ("c", "d"))
            np.minimum.at(known, c, d)
            found = part if found is None else pa.concat_tables([found, part])
        c, d, a, b = (found.column(x).to_numpy() for x in ("c", "d", "a", "b"))
        low, high = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((high, low, d, c))
        order = order[np.concatenate([[True], np.diff(c[order]) != 0])]
        # Join components along their edges, shortest first; one order for equal ones, so that no cycle closes.
        root = {int(x): int(x) for x in np.unique(component)}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for k in order[np.lexsort((high[order], low[order], d[order]))].tolist():
            x, y = find(int(component[a[k]])), find(int(component[b[k]]))
            if x != y:
                root[max(x, y)] = min(x, y)
                edges.append((float(d[k]), int(low[k]), int(high[k])))
        final = {x: find(x) for x in root}
        keys = np.array(sorted(final))
        component = np.array([final[int(x)] for x in keys])[np.searchsorted(keys, component)]
    return np.array(sorted(edges)).reshape(-1, 3)


def cluster_labels(edges: np.ndarray, n: int, least: int, weights: np.ndarray | None = None, core: np.ndarray | None = None) -> np.ndarray:
    """Labels from a spanning tree: clusters of ``least`` points or more by excess of mass, -1 for noise.

    With ``weights``, each of the ``n`` is a place of so many points, which part at its ``core`` distance.
    """
    # Single linkage: merge n, n+1, ... joins two earlier nodes.
    parent, size, node = list(range(n)), ([1] * n if weights is None else weights.tolist()) + [0] * (n - 1), list(range(n))
    sons: list[tuple[int, int, float]] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k, (d, a, b) in enumerate(edges.tolist()):
        x, y = find(int(a)), find(int(b))
        sons.append((node[x], node[y], d))
        size[n + k] = size[node[x]] + size[node[y]]
        parent[y], node[x] = x, n + k
    labels = np.full(n, -1)
    if not n or sum(size[:n]) < max(least, 2):
        return labels
    if n == 1:  # one place is the root, which is never a cluster
        return labels

    def leaves(x: int) -> list[int]:
        out, todo = [], [x]
        while todo:
            y = todo.pop()
            todo.extend(sons[y - n][:2]) if y >= n else out.append(y)
        return out

    # Condense: a cluster goes on until both sides of a split are large enough; what splits off small falls out.
    birth, mass, below, lost = [0.0], [0.0], [[]], [[]]
    todo = [(2 * n - 2, 0)]
    while todo:
        x, c = todo.pop()
        while True:
            if x < n:
                lost[c].append(x)
                if weights is not None:
                    density = 1 / core[x] if core[x] > 0 else np.inf
                    mass[c] += (density - birth[c]) * size[x] if density > birth[c] else 0.0
                break
            left, right, d = sons[x - n]
            density = 1 / d if d > 0 else np.inf
            big = [s for s in (left, right) if size[s] >= least]
            if len(big) == 2:
                for s in (left, right):
                    below[c].append(len(birth))
                    birth.append(density), mass.append(0.0), below.append([]), lost.append([])
                    mass[c] += (density - birth[c]) * size[s] if density > birth[c] else 0.0
                    todo.append((s, len(birth) - 1))
                break
            for s in (left, right):
                if s not in big:
                    mass[c] += (density - birth[c]) * size[s] if density > birth[c] else 0.0
                    lost[c].extend(leaves(s))
            if not big:
                break
            x = big[0]
    # Excess of mass, from the leaves: a cluster stands if it has more than the best below it. Never the root.
    best, stands = list(mass), [True] * len(mass)
    for c in range(len(mass) - 1, -1, -1):
        under = sum(best[x] for x in below[c])
        if below[c] and (c == 0 or under > mass[c]):
            best[c], stands[c] = under, False
    stands[0] = False
    todo2, chosen = [0], []
    while todo2:
        c = todo2.pop()
        if stands[c]:
            chosen.append(c)
        else:
            todo2.extend(below[c])
    groups = []
    for c in chosen:
        members, inner = [], [c]
        while inner:
            y = inner.pop()
            members += lost[y]
            inner += below[y]
        groups.append(sorted(members))
    for label, members in enumerate(sorted(groups)):
        labels[members] = label
    return labels


@dataclass(frozen=True)
class Clustering:
    """``labels`` (point_id, label; -1 is noise) and the sizes that they were made with."""

    labels: DataFrame
    fraction: float
    min_size: int

    def regions(self) -> DataFrame:
        """The clusters' points: ``point_id, cluster_label``."""
        return self.labels.where("label >= 0").withColumnRenamed("label", "cluster_label")

    def noise(self) -> DataFrame:
        return self.labels.where("label = -1").select("point_id")


def clusterings(points: DataFrame, fractions: tuple[float, ...] = (0.005, 0.01, 0.02), least: int = 25) -> list[Clustering]:
    """One clustering for each fraction of the points that a cluster must have (and ``least`` of them).

    Labels go by the clusters' first points in point_id order. With fewer points than a cluster needs, all
    are noise. More than ``MOST_POINTS`` points or ``MOST_PLACES`` different places raise.
    """
    spark, found = points.sparkSession, _placed(points)
    places, weights = np.stack([found.column(c).to_numpy() for c in ("la", "lo")], axis=1), found.column("n").to_numpy()
    n, where = int(weights.sum()), spark.sparkContext.broadcast(places)
    out, known = [], {}
    for fraction in fractions:
        size = min_cluster_size(fraction, n, least)
        if size not in known:
            if n < max(size, 2):
                labels = np.full(len(places), -1)
            else:
                core = _cores(spark, where, len(places), size, weights)
                labels = cluster_labels(_spanning_tree(spark, where, core), len(places), size, weights, core)
            placed = _frame(spark, {"lat": found.column("lat"), "lon": found.column("lon"), "label": labels.astype(np.int32)}, "lat double, lon double, label int")
            at = points.select(F.col("point_id").cast("long").alias("point_id"), F.col("lat").alias("lat_p"), F.col("lon").alias("lon_p"))
            known[size] = at.join(placed, F.col("lat").eqNullSafe(F.col("lat_p")) & F.col("lon").eqNullSafe(F.col("lon_p"))).select("point_id", "label")
        out.append(Clustering(known[size], fraction, size))
    return out

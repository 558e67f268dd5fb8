"""The Delaunay and Gabriel graphs of points on the plane of degrees: which places are neighbours with nothing between them.

Two places are joined if some circle through both has no other place in it; then their Voronoi cells share a side. Each
leaf of the tree of places (see ``neighbours``) makes the cells of its own. First a cell is cut by the bisectors
with a few of the nearest places. Then all places are gathered that are nearer to a corner of the cell than the cell's
own place, and the cell is cut by those too. That is final: a corner that a cut makes lies on a side of the cell as it
was, and the circle round it is inside those round the ends of that side, so nothing can be in it that has not been
gathered. Circles are looked for down the tree, level by level for all leaves at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.written import Rounds
from .neighbours import _NODE, Tree, candidates, distance_bounds, grown, spots_of

#: Nearest places that a cell is first cut by, places in a leaf, half the side of the square that cells begin as (the
#: points' extent is 2), the length from which a side counts, as a share of the distance of the two places, and room
#: for rounding in circles. With few first places, too many cells would have no end yet, and wide circles.
_FIRST, _LEAF, _EDGE, _LEAST, _ROOM = 32, 64, 1e6, 1e-9, 1e-15
_KEY = "key"


class Cell:
    """A convex polygon round a place, as corners from there on and the lines of its sides (``x * dx + y * dy = m``).

    Corners are where two lines meet, not shares of the way between far ones, so that they are as exact as the lines
    however close places are. ``beyond`` has the number of the place beyond each side (-1: the first square's).
    """

    def __init__(self, x: float, y: float):
        self.x, self.y = x, y
        self.corners = [(-_EDGE, -_EDGE), (_EDGE, -_EDGE), (_EDGE, _EDGE), (-_EDGE, _EDGE)]
        self.lines = [(0.0, -1.0, _EDGE), (1.0, 0.0, _EDGE), (0.0, 1.0, _EDGE), (-1.0, 0.0, _EDGE)]
        self.beyond = [-1] * 4  # of the side from this corner on

    def cut(self, x: float, y: float, number: int) -> None:
        """Keep what is nearer to the cell's place than to ``(x, y)``."""
        dx, dy = x - self.x, y - self.y
        m = (dx * dx + dy * dy) / 2
        over = [cx * dx + cy * dy - m for cx, cy in self.corners]
        if max(over) <= 0:
            return
        corners, lines, beyond = [], [], []
        for k, corner in enumerate(self.corners):
            at, to, line, side = over[k], over[(k + 1) % len(over)], self.lines[k], self.beyond[k]
            if at <= 0:
                corners.append(corner)
                lines.append(line)
                beyond.append(side)
            if (at < 0 < to) or (to < 0 < at):
                lx, ly, lm = line
                turn = lx * dy - ly * dx
                if abs(turn) > 1e-12 * (abs(lx) + abs(ly)) * (abs(dx) + abs(dy)):
                    corners.append(((lm * dy - ly * m) / turn, (lx * m - lm * dx) / turn))
                else:
                    end, share = self.corners[(k + 1) % len(over)], at / (at - to)
                    corners.append((corner[0] + share * (end[0] - corner[0]), corner[1] + share * (end[1] - corner[1])))
                lines.append((dx, dy, m) if at < 0 else line)
                beyond.append(number if at < 0 else side)
            elif at == 0 and to > 0:
                lines[-1], beyond[-1] = (dx, dy, m), number
        self.corners, self.lines, self.beyond = corners, lines, beyond

    def sides(self) -> Iterator[tuple[int, tuple[float, float], tuple[float, float]]]:
        """Places beyond the sides that have a length, and the side's two ends."""
        for k, number in enumerate(self.beyond):
            (ax, ay), (bx, by) = self.corners[k], self.corners[(k + 1) % len(self.corners)]
            dx, dy, _ = self.lines[k]
            if number >= 0 and (ax - bx) ** 2 + (ay - by) ** 2 > _LEAST**2 * (dx * dx + dy * dy):
                yield number, (ax, ay), (bx, by)


def _flat(points: DataFrame, rounds: Rounds) -> DataFrame:
    """Places with the least id of each, scaled alike along both axes to lie between -1 and 1."""
    spots = rounds.kept(spots_of(points, 1))
    ends = spots.agg(*(f(c).alias(f"{c}_{n}") for c in ("lon", "lat") for n, f in (("min", F.min), ("max", F.max)))).first()
    if ends.lon_min is None:
        return spots.withColumns({c: F.lit(0.0) for c in ("la", "lo", "x", "y", "z", "v")})
    half = max(ends.lon_max - ends.lon_min, ends.lat_max - ends.lat_min) / 2 or 1.0
    x, y = (((F.col(c) - F.lit((ends[f"{c}_min"] + ends[f"{c}_max"]) / 2)) / F.lit(half)) for c in ("lon", "lat"))
    return spots.withColumns({"la": y, "lo": x, "x": x, "y": y, "z": F.lit(0.0), "v": F.lit(0.0)})


def _key(node: str) -> Column:
    return F.concat_ws(" ", *(F.col(f"{node}.{c}").cast("string") for c in _NODE))


def _arrays(row: dict, *names: str) -> list[np.ndarray]:
    return [row[n].values.to_numpy(zero_copy_only=False) for n in names]


def _by_leaf(rows: DataFrame, begin, schema: str) -> DataFrame:
    """Runs over leaves (``key``) and what they meet, one row at a time, in the order of ``low``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                if row[_KEY].as_py() != key:
                    if state is not None:
                        yield state.done()
                    key, state = row[_KEY].as_py(), begin(row)
                state.meet(row)
        if state is not None:
            yield state.done()

    return rows.repartition(_KEY).sortWithinPartitions(_KEY, "low").mapInArrow(run, schema)


_CELLS = "key string, circles array<struct<x: double, y: double, r: double>>, own array<int>, first_x array<array<double>>, first_y array<array<double>>, first_id array<array<long>>"


class _First:
    """Cells cut by the nearest places: the circles round their corners, and the places that they were cut by."""

    def __init__(self, row: dict):
        self.key, (self.x, self.y) = row[_KEY], _arrays(row, "lo_a", "la_a")
        n = len(self.x)
        self.d, self.qx, self.qy, self.ids = np.full((n, _FIRST), np.inf), np.zeros((n, _FIRST)), np.zeros((n, _FIRST)), np.zeros((n, _FIRST), np.int64)

    def meet(self, row: dict) -> None:
        x, y, ids = _arrays(row, "lo_b", "la_b", "id_b")
        d = (self.x[:, None] - x) ** 2 + (self.y[:, None] - y) ** 2
        d[d == 0] = np.inf  # the place itself
        every = np.concatenate([self.d, d], axis=1)
        order = np.argsort(every, axis=1, kind="stable")[:, :_FIRST]
        for name, new in (("qx", x), ("qy", y), ("ids", ids)):
            setattr(self, name, np.take_along_axis(np.concatenate([getattr(self, name), np.broadcast_to(new, d.shape)], axis=1), order, 1))
        self.d = np.take_along_axis(every, order, 1)

    def done(self) -> pa.RecordBatch:
        circles, own, lists = [], [], ([], [], [])
        for k in range(len(self.x)):
            cell, near = Cell(self.x[k], self.y[k]), np.isfinite(self.d[k])
            for x, y in zip(self.qx[k][near].tolist(), self.qy[k][near].tolist()):
                cell.cut(x, y, 0)
            circles += [{"x": cell.x + x, "y": cell.y + y, "r": float(np.hypot(x, y)) * (1 + 1e-12) + _ROOM} for x, y in cell.corners]
            own += [k] * len(cell.corners)
            for out, values in zip(lists, (self.qx, self.qy, self.ids)):
                out.append(values[k][near].tolist())
        kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64()), ("r", pa.float64())]))
        nested = (pa.array([v], pa.list_(pa.list_(t))) for v, t in zip(lists, (pa.float64(), pa.float64(), pa.int64())))
        return pa.RecordBatch.from_arrays([pa.array([self.key.as_py()]), pa.array([circles], kind), pa.array([own], pa.list_(pa.int32())), *nested], names=["key", "circles", "own", "first_x", "first_y", "first_id"])


class _Final:
    """Cells cut by all places in the circles round their corners: edges to those beyond their sides."""

    def __init__(self, row: dict):
        self.x, self.y, self.ids, self.own = _arrays(row, "lo_a", "la_a", "id_a", "own")
        circles = row["circles"].values
        self.cx, self.cy, self.r = (circles.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "r"))
        self.found = [dict(zip(i, zip(x, y))) for x, y, i in zip(*(row[f"first_{c}"].as_py() for c in ("x", "y", "id")))]

    def meet(self, row: dict) -> None:
        x, y, ids = _arrays(row, "lo_b", "la_b", "id_b")
        inside = np.hypot(self.cx[:, None] - x, self.cy[:, None] - y) <= self.r[:, None]
        for circle, place in zip(*np.nonzero(inside)):
            k = self.own[circle]
            if ids[place] != self.ids[k]:
                self.found[k][int(ids[place])] = (float(x[place]), float(y[place]))

    def done(self) -> pa.RecordBatch:
        out: list[tuple[int, int, bool]] = []
        for k, near in enumerate(self.found):
            x, y, own = float(self.x[k]), float(self.y[k]), int(self.ids[k])
            order = sorted(near, key=lambda i: ((near[i][0] - x) ** 2 + (near[i][1] - y) ** 2, i))
            cell = Cell(x, y)
            for n, i in enumerate(order):
                cell.cut(*near[i], n)
            for n, (ax, ay), (bx, by) in cell.sides():
                mx, my = (near[order[n]][0] - x) / 2, (near[order[n]][1] - y) / 2
                # Of the circles through both places, the smallest one is round their middle.
                gabriel = (mx - ax) * (bx - ax) + (my - ay) * (by - ay) >= 0 and (mx - bx) * (ax - bx) + (my - by) * (ay - by) >= 0
                out.append((min(own, order[n]), max(own, order[n]), gabriel))
        columns = list(zip(*out)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "gabriel"])


def _in_circles(tree: Tree, cells: DataFrame, rounds: Rounds) -> DataFrame:
    """``key, to``: leaves whose box one of the circles of another leaf's cells reaches into."""

    def reached() -> Column:
        def into(c: Column) -> Column:
            gaps = [F.greatest(F.lit(0.0), F.col(f"b.{a}_min") - c[a], c[a] - F.col(f"b.{a}_max")) for a in ("x", "y")]
            return gaps[0] * gaps[0] + gaps[1] * gaps[1] <= c["r"] * c["r"] * (1 + 1e-12)

        return F.exists("circles", into)

    steps = tree.steps.select(F.col("from").alias("at"), F.col("node").alias("to"), F.col("box").alias("b"))
    root = F.broadcast(tree.steps.where("from.l = 0").select(F.col("node").alias("to"), F.col("box").alias("b")))
    here = cells.select("key", "circles")
    for level in range(max(1, tree.depth)):
        met = here.join(steps, "at") if level else here.crossJoin(root)
        here = met.where(reached()).select("key", "circles", F.col("to").alias("at"))
    return here.select("key", F.col("at").alias("to"))


def delaunay(points: DataFrame) -> DataFrame:
    """``a, b, gabriel``: each edge once, ``a < b``, and whether no place is in the circle of which it is a diameter.

    Points at one place are one, named by the least point_id. Where four places and more are on one empty circle, only
    sides of cells with a length are edges. Places that only circles wider than a million times the extent join are not.
    Points without a place take no part.
    """
    rounds = Rounds(points.sparkSession, "delaunay")
    tree = grown(_flat(points, rounds), rounds, _LEAF)
    leaves = rounds.kept(tree.leaves.select("node", "la", "lo", F.transform("ids", lambda i: F.element_at(i, 1)).alias("id")))
    own = leaves.select(_key("node").alias("key"), *(F.col(c).alias(f"{c}_a") for c in ("la", "lo", "id")))
    other = leaves.select(F.col("node").alias("to"), *(F.col(c).alias(f"{c}_b") for c in ("la", "lo", "id")))
    pairs = candidates(tree, distance_bounds, _FIRST + 1, rounds).select(_key("q").alias("key"), "to", "low")
    cells = rounds.kept(_by_leaf(pairs.join(other, "to").join(own, "key").drop("to"), _First, _CELLS))
    again = _in_circles(tree, cells, rounds).join(other, "to").join(own, "key").join(cells, "key").drop("to").withColumn("low", F.lit(0.0))
    # Each edge is found from both ends; where rounding lets the two disagree, it is none.
    found = _by_leaf(again, _Final, "a long, b long, gabriel boolean").groupBy("a", "b").agg(F.count("*").alias("ends"), F.bool_and("gabriel").alias("gabriel"))
    return found.where("ends = 2").select("a", "b", "gabriel")

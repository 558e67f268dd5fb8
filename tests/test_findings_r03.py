"""Findings of round 3: each of these would have failed before."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from geoaudit.llm import substring
from geoaudit.operators import communities as C
from geoaudit.operators import dbscan as D
from geoaudit.operators import neighbours as N
from geoaudit.operators import regions as R
from geoaudit.queries import QUERIES
from geoaudit.sources.points import profile, view
from geoaudit.sources.written import Rounds


def test_customers_are_never_broadcast(spark, sf):
    """F16: they grow with the orders, and a broadcast goes through the driver."""
    rows = view(spark, sf, "orders")
    rows.collect()
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()


def test_grids_are_counted_in_the_tasks(spark, monkeypatch):
    """no row for each point and grid; counts are those of the rows, on edges and outside too."""
    where = [(x / 4, y / 4, (x * y) % 2) for x in range(9) for y in range(9)] + [(0.1 * k, 0.07 * k, k % 2) for k in range(20)] + [(None, 1.0, 1)]
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(where)], "point_id long, lon double, lat double, outcome int")
    sizes = [(0, 4, 8), (1, 3, 7), (2, 1, 1)]
    for some in (points, points.where("lon = 1")):
        p = profile(some)
        rows = R.grid_stats(some, R.grid_table(spark, sizes), sizes, p)
        assert "MapInArrow" in rows._jdf.queryExecution().executedPlan().toString()
        found = sorted(map(tuple, rows.collect()))
        with monkeypatch.context() as m:
            m.setattr(R, "_AT_ONCE", 0)
            assert found == sorted(map(tuple, R.grid_stats(some, R.grid_table(spark, sizes), sizes, p).collect()))


def test_dense_cells_are_not_compared_box_by_box(spark, monkeypatch):
    """what a round writes stays below the points, however many boxes the cells could be cut into."""
    kept, sizes = Rounds.kept, []

    def counted(self, rows):
        out = kept(self, rows)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(Rounds, "kept", counted)
    where = np.random.default_rng(4).uniform(0, 3, (20_000, 2)).tolist()
    points = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(where)], "point_id long, lon double, lat double")
    assert {tuple(r) for r in D.dbscan(points, 0.6, 4).select("kind", "cluster").distinct().collect()} == {("core", 0)}
    assert max(sizes) <= len(where)


def test_cells_are_tied_within_and_between_blocks(spark):
    """blocks are followed at once, and the rounds join what they found, on both sides of 0."""
    cells = np.random.default_rng(6).integers(-90, 90, (60, 2)).tolist()
    edges = [((k, 3), (k + 1, 3)) for k in range(-100, 100)] + [((a, b), (a + 1, b + 1)) for a, b in cells] + [((a, b), (a + 2, b - 1)) for a, b in cells]
    least = {x: x for e in edges for x in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    links = spark.createDataFrame(edges, "u struct<cx:long,cy:long>, v struct<cx:long,cy:long>")
    assert {tuple(map(tuple, r)) for r in D.tied_cells(links, Rounds(spark, "t")).collect()} == set(least.items())


def test_cells_of_communities_are_counted_once(spark, sf, monkeypatch):
    """neither the edges nor the result read the points again."""
    read = []

    def louvain(edges):
        read.extend(edges.inputFiles())
        return edges.select(F.col("a").alias("node"), F.col("a").alias("community")).distinct(), []

    monkeypatch.setattr(C, "louvain", louvain)
    read += QUERIES["cell_communities"](spark, sf).inputFiles()
    assert read and not any("events" in x for x in read)


def test_angles_are_taken_of_near_places_alone(monkeypatch):
    """chords rule out the others; the lists are those of all angles, ties by the least ids."""
    rng = np.random.default_rng(8)
    own, other = rng.uniform(0, 0.1, (40, 2)), np.concatenate([rng.uniform(0, 0.1, (200, 2)), rng.uniform(0.1, 1, (800, 2))])
    other[:40] = own
    other[150:200] = own[:1]
    ids, taken, angles = rng.permutation(1000), [], N.angles
    monkeypatch.setattr(N, "angles", lambda a, b: taken.append(len(a) * len(b)) or angles(a, b))

    def row(side, where, ids):
        lists = pa.array([[int(k)] for k in ids], pa.list_(pa.int64()))
        return {f"la_{side}": SimpleNamespace(values=pa.array(where[:, 0])), f"lo_{side}": SimpleNamespace(values=pa.array(where[:, 1])), f"ids_{side}": SimpleNamespace(values=lists)}

    lists = N._Lists(row("a", own, ids[:40]), 5)
    for low, high in ((0, 40), (40, 200), (200, 1000)):
        lists.meet(row("b", other[low:high], ids[low:high]))
    every = angles(own, other)
    order = np.lexsort((np.broadcast_to(ids, every.shape), every), axis=1)[:, :5]
    assert (lists.ids == ids[order]).all() and (lists.d == np.take_along_axis(every, order, 1)).all()
    assert sum(taken) < every.size / 3


def test_near_copies_round_a_run_that_many_share(spark):
    """a word more right after the run moves all samples; joins by neighbours found 24 of the 30."""
    rng = np.random.default_rng(5)
    fresh = lambda n: [f"r{x}" for x in rng.integers(0, 10**9, n)]
    shared = fresh(40)
    rows = [(1000 + k, [*fresh(int(rng.integers(20, 60))), *shared, *fresh(int(rng.integers(20, 60)))]) for k in range(400)]
    for k in range(30):
        own = fresh(10)
        rows += [(k, [*fresh(50), *shared, *own, *fresh(50)]), (10_000 + k, [*fresh(50), *shared, f"more{k}", *own, *fresh(50)])]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(int(i), " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(4)
    for block in (2048, 64):  # the windows of a token at once, and by pairs of blocks
        config = substring.SubstringConfig(batch_docs=200, block=block)
        assert {(r.doc_id, r.match_doc_id) for r in substring.repeated_passages(frame, config).collect()} == {(10_000 + k, k) for k in range(30)}


def test_different_tokens_of_the_poorest_run():
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 6, (40, 15)).astype(np.uint32)
    least, shares = substring._least_different(tokens, 4), substring._shares(tokens, slice(0, 40), slice(0, 40))
    for k, row in enumerate(tokens.tolist()):
        runs = [set(row[s : s + 4]) for s in range(12) if row[s] and row[s + 3]]
        assert least[k] == min([len(r) for r in runs], default=4)
        assert shares[k].tolist() == [len(set(row) & set(other) - {0}) for other in tokens.tolist()]

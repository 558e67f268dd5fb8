"""Autocorrelation, density clusters, neighbours and scales against brute force and known properties."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoaudit.operators import autocorrelation as A
from geoaudit.operators import communities as C
from geoaudit.operators import dbscan as D
from geoaudit.operators import delaunay as T
from geoaudit.operators import layers
from geoaudit.operators import kmeans as K
from geoaudit.operators import neighbours as N
from geoaudit.operators import polygons as G
from geoaudit.operators import pyramid as P
from geoaudit.operators import regions as R
from geoaudit.operators.components import components
from geoaudit.operators.places import with_places
from geoaudit.sources.points import profile, view
from geoaudit.sources.written import Rounds

POINT = "point_id long, lon double, lat double, outcome int"


def frame(spark, where, outcome=None):
    return spark.createDataFrame([(k, float(x), float(y), int(outcome[k]) if outcome is not None else 0) for k, (x, y) in enumerate(where)], POINT)


# --- autocorrelation ------------------------------------------------------------------------------------


def moran_geary(x, w):
    z = x - x.mean()
    n, s0, m2 = len(x), w.sum(), (z * z).sum()
    return n / s0 * (w * np.outer(z, z)).sum() / m2, (n - 1) / (2 * s0) * (w * (x[:, None] - x[None]) ** 2).sum() / m2


def tables(spark, x, w):
    values = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in enumerate(x)], "id long, x double")
    return values, spark.createDataFrame([(int(a), int(b), float(w[a, b])) for a, b in zip(*np.nonzero(w))], "a long, b long, w double")


def test_moments_are_those_of_all_dealings(spark):
    """Mean and variance under random dealing, for weights that differ by direction, from every permutation."""
    rng = np.random.default_rng(4)
    x, w = rng.normal(size=6).round(2), rng.uniform(0, 1, (6, 6)).round(2) * (rng.uniform(size=(6, 6)) < 0.6)
    np.fill_diagonal(w, 0)
    every = np.array([moran_geary(x[list(p)], w) for p in itertools.permutations(range(6))])
    row = A.global_autocorrelation(*tables(spark, x, w)).first()
    assert (row.moran, row.geary) == pytest.approx(moran_geary(x, w), abs=1e-6)
    assert (row.moran_var, row.geary_var) == pytest.approx(every.var(axis=0), abs=2e-6)
    assert (row.moran_z, row.geary_z) == pytest.approx((np.array(moran_geary(x, w)) - every.mean(axis=0)) / every.std(axis=0), abs=1e-4)


def test_shares_of_dealings(spark):
    """Permutations deal out the same values, and their shares are near those of all dealings."""
    x, w = np.array([1.0, 2, 2, 5, 7, 9, 4]), np.zeros((7, 7))
    for k in range(6):
        w[k, k + 1] = w[k + 1, k] = 1
    values, weights = tables(spark, x, w)
    dealt = A.permuted(values.select("id", F.col("x").alias("z")), 20, 3, Rounds(spark, "t")).collect()
    by = {p: sorted(r.z for r in dealt if r.permutation == p) for p in range(1, 21)}
    assert all(v == sorted(x) for v in by.values()) and len({tuple(r.z for r in sorted(dealt, key=lambda r: r.id) if r.permutation == p) for p in by}) > 15
    every = np.array([moran_geary(x[list(p)], w) for p in itertools.permutations(range(7))])
    own, row = moran_geary(x, w), A.global_autocorrelation(values, weights, 999, 3).first()
    assert row.moran_p == pytest.approx((every[:, 0] >= own[0] - 1e-9).mean(), abs=0.03)
    assert row.geary_p == pytest.approx((every[:, 1] <= own[1] + 1e-9).mean(), abs=0.03)


def test_local_statistics_add_up(spark):
    rng = np.random.default_rng(5)
    side = 6
    cells = spark.createDataFrame([(j + side * i, j, i, float(rng.normal() + (j > 2) * 3)) for i in range(side) for j in range(side)], "id long, j int, i int, x double")
    for diagonal, neighbours in ((True, 2 * (2 * side * (side - 1)) + 4 * (side - 1) ** 2), (False, 4 * side * (side - 1))):
        weights = A.cell_weights(cells, diagonal)
        assert weights.count() == neighbours
        local = A.local_autocorrelation(cells, weights, 99, 1).collect()
        whole = A.global_autocorrelation(cells, weights).first()
        assert sum(r.local_moran for r in local) / whole.s0 == pytest.approx(whole.moran, abs=1e-4)
        assert sum(r.local_geary for r in local) / whole.s0 / 2 * (side**2 - 1) / side**2 == pytest.approx(whole.geary, abs=1e-4)
        assert all(0 < r.p <= 1 and r.quadrant in ("HH", "LL", "HL", "LH") for r in local)
        assert min(r.p for r in local) <= 0.05  # two halves of the plane differ


def test_local_shares_are_those_of_dealing_others_out(spark):
    x, w = np.array([5.0, 4, 0, 1, 2, 3]), np.zeros((6, 6))
    w[0, 1] = w[1, 0] = w[1, 2] = w[2, 1] = w[3, 4] = w[4, 3] = 1
    values, weights = tables(spark, x, w)
    z = (x - x.mean()) / x.std()
    got = {r.id: r for r in A.local_autocorrelation(values, weights, 1999, 2).collect()}
    for k in range(6):
        near = np.flatnonzero(w[k])
        others = [z[i] for i in range(6) if i != k]
        every = np.array([z[k] * sum(p) for p in itertools.permutations(others, len(near))])
        own = z[k] * z[near].sum()
        want = (every >= own - 1e-9).mean() if own >= 0 else (every <= own + 1e-9).mean()
        assert (got[k].p == pytest.approx(want, abs=0.04)) if len(near) else got[k].p is None
    assert got[5].neighbours == 0 and got[5].lag is None


def test_autocorrelation_of_odd_values(spark):
    w = np.ones((4, 4)) - np.eye(4)
    values, weights = tables(spark, [1, None, 1, 1], w)
    row = A.global_autocorrelation(values, weights, 5, 1).first()
    assert row.n == 3 and row.s0 == 6 and row.moran is None and row.geary is None and row.moran_p is None
    row = A.global_autocorrelation(values.limit(0), weights, 5, 1).first()
    assert row.n == 0 and row.moran is None
    assert A.local_autocorrelation(values.limit(0), weights, 5, 1).count() == 0
    none = A.global_autocorrelation(values, weights.limit(0)).first()
    assert none.n == 3 and none.moran is None and none.s0 is None


def test_standardised_rows_and_bands(spark):
    rng = np.random.default_rng(6)
    where = rng.uniform(-3, 3, (90, 2)).round(1)
    sites = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(where)], "id long, lon double, lat double")
    got = {(r.a, r.b) for r in A.band_weights(sites, 0.7).collect()}
    away = ((where[:, None] - where[None]) ** 2).sum(axis=2)
    assert got == {(a, b) for a in range(90) for b in range(90) if a != b and away[a, b] <= 0.7 * 0.7}
    sums = A.row_standardised(A.band_weights(sites, 0.7)).groupBy("a").agg(F.sum("w").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in sums)
    with pytest.raises(ValueError):
        A.band_weights(sites, 0)


# --- components and places --------------------------------------------------------------------------------


def test_components_of_paths_stars_and_loops(spark):
    rng = np.random.default_rng(7)
    edges = [(k, k + 1) for k in range(100, 140)] + [(500, k) for k in range(501, 560)] + [(7, 7), (3, 2), (2, 3)] + [tuple(map(int, e)) for e in rng.integers(1000, 1060, (40, 2))]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    linked = {x for e in edges for x in e if e[0] != e[1]}
    got = components(spark.createDataFrame(edges, "u long, v long"), Rounds(spark, "t")).collect()
    assert sorted((r.node, r.component) for r in got) == sorted((x, find(x)) for x in linked)
    assert components(spark.createDataFrame([], "u long, v long"), Rounds(spark, "t")).count() == 0


def test_places_within_groups(spark):
    rows = [(g, v) for g, n in (("a", 50), ("b", 1), ("c", 7)) for v in np.random.default_rng(1).integers(0, 20, n).tolist()]
    got = with_places(spark.createDataFrame(rows, "g string, v long").repartition(5), [F.desc("v")], Rounds(spark, "t"), "g").collect()
    for g in "abc":
        own = sorted((r.place, r.v) for r in got if r.g == g)
        assert [k for k, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted((v for h, v in rows if h == g), reverse=True)


# --- density clusters -------------------------------------------------------------------------------------


def brute_dbscan(where, radius, least):
    n = len(where)
    away = ((where[:, None] - where[None]) ** 2).sum(axis=2)
    near = away <= radius * radius
    core, label = near.sum(axis=1) >= least, {}
    for k in range(n):
        if core[k] and k not in label:
            todo = [k]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = k
                    todo += np.flatnonzero(near[x] & core).tolist()
    out = {}
    for k in range(n):
        close = [(away[k, b], label[b]) for b in np.flatnonzero(near[k] & core)]
        out[k] = ("core", label[k]) if core[k] else ("border", min(close)[1]) if close else ("noise", None)
    return out


@pytest.mark.parametrize(("radius", "least"), [(0.5, 4), (1.0, 10), (0.2, 2), (3.0, 30), (0.7, 1)])
def test_dbscan_by_brute_force(spark, radius, least):
    rng = np.random.default_rng(int(radius * 10) + least)
    where = np.concatenate([rng.normal(size=(120, 2)) * 0.4, rng.normal(size=(60, 2)) * 0.3 + [4, 1], rng.uniform(-6, 6, (80, 2)), np.repeat([[2.0, 2.0]], 15, axis=0)]).round(2)
    got = {r.point_id: (r.kind, r.cluster) for r in D.dbscan(frame(spark, where), radius, least).collect()}
    assert got == brute_dbscan(where, radius, least)


def test_dbscan_settles_near_cells_by_halving(spark):
    """Dense cells whose nearest points are a hair more or less than the radius apart."""
    rng = np.random.default_rng(3)
    for gap, clusters in ((0.999999, 1), (1.0, 1), (1.000001, 2)):
        left, right = rng.uniform(-0.3, 0, (300, 2)), rng.uniform(0, 0.3, (300, 2)) + [gap, 0]
        where = np.concatenate([left, right, [[0.0, 0.1], [gap, 0.1]]])
        labels = D.dbscan(frame(spark, where), 1.0, 5)
        want = brute_dbscan(where, 1.0, 5)
        assert {r.point_id: (r.kind, r.cluster) for r in labels.collect()} == want
        assert len({c for _, c in want.values()}) == clusters


def test_dbscan_of_odd_points(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(1, 0.0, 0.0, 1), (2, None, 0.0, 1), (3, nan, 0.0, 0), (4, 0.0, 0.5, 0), (5, -1e7, 1e7, 0)], POINT)
    got = {r.point_id: (r.kind, r.cluster) for r in D.dbscan(rows, 1.0, 2).collect()}
    assert got == {1: ("core", 1), 4: ("core", 1), 5: ("noise", None)}
    assert D.dbscan(rows.limit(0), 1.0, 2).count() == 0
    table = D.cluster_table(D.dbscan(rows, 1.0, 2), rows).first()
    assert (table.cluster, table.n, table.core, table.p, table.rho, table.share) == (1, 2, 2, 1, 0.5, 0.4)
    with pytest.raises(ValueError):
        D.dbscan(rows, 0, 2)


def test_dbscan_never_pairs_points_of_dense_cells(spark):
    """All points but two in one cell: what is joined stays far below the pairs of that cell."""
    where = np.concatenate([np.random.default_rng(2).uniform(0, 0.1, (20_000, 2)), [[0.5, 0.5], [9.0, 9.0]]])
    labels = D.dbscan(frame(spark, where), 1.0, 5)
    assert {(r.kind, r["count"]) for r in labels.groupBy("kind").count().collect()} == {("core", 20_001), ("noise", 1)}


# --- neighbours -------------------------------------------------------------------------------------------


def brute_lists(where, k):
    rad = np.radians(where[:, ::-1])
    d = N.angles(rad, rad)
    out = {}
    for a in range(len(where)):
        order = sorted((d[a, b], b) for b in range(len(where)) if b != a)[:k]
        out[a] = [(r + 1, b, pytest.approx(x, abs=2e-8)) for r, (x, b) in enumerate(order)]
    return out


@pytest.mark.parametrize("leaf", [4, 40, 1000])
def test_neighbours_by_brute_force(spark, leaf, monkeypatch):
    """Round the poles and the date line, of dense groups, of lone points, and of many at one place."""
    monkeypatch.setattr(N, "_LEAF", leaf)
    rng = np.random.default_rng(9)
    where = np.concatenate([
        rng.normal(size=(60, 2)) * [40, 2] + [0, 88], rng.normal(size=(40, 2)) * 0.3 + [179.9, 10], rng.normal(size=(10, 2)) * 0.3 + [-179.9, 10],
        rng.uniform(-90, 90, (40, 2)), np.repeat([[30.0, 30.0]], 9, axis=0), [[0.0, 90.0], [120.0, 90.0], [0.0, -90.0]],
    ])
    where[:, 1] = where[:, 1].clip(-90, 90)
    got = {}
    for r in N.nearest_neighbours(frame(spark, where), 6).collect():
        got.setdefault(r.point_id, []).append((r["rank"], r.neighbour, r.distance))
    want = brute_lists(where, 6)
    for k, rows in got.items():
        rows.sort()
        assert [x[2] for x in rows] == [x[2] for x in want[k]]
        assert [x[1] for x in rows] == [x[1] for x in want[k]] or 90 in abs(where[k])  # at a pole, distances differ by rounding alone
    assert set(got) == set(want)


def test_neighbours_of_few_and_odd_points(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0, 0), (2, 0.0, 1.0, 0), (3, None, 1.0, 0), (4, 0.0, float("nan"), 0)], POINT)
    assert sorted((r.point_id, r["rank"], r.neighbour) for r in N.nearest_neighbours(rows, 3).collect()) == [(1, 1, 2), (2, 1, 1)]
    assert N.nearest_neighbours(rows.limit(0), 3).count() == N.core_distances(rows.limit(0), 1).count() == 0
    assert {(r.point_id, r.core) for r in N.core_distances(rows, 1).collect()} == {(1, 0.0), (2, 0.0)}


def test_most_points_at_one_place(spark, monkeypatch):
    """A place of very many points goes into the tree once."""
    monkeypatch.setattr(N, "_LEAF", 8)
    rng = np.random.default_rng(11)
    where = np.concatenate([np.repeat([[10.0, 10.0]], 3000, axis=0), rng.normal(size=(50, 2)) + 10])
    points = frame(spark, where)
    assert N.spots_of(points, 5).count() == 51
    core = {r.point_id: r.core for r in N.core_distances(points, 5).collect()}
    rad = np.radians(where[:, ::-1])
    for k in (0, 2999, *range(3000, 3050)):
        assert core[k] == pytest.approx(np.sort(N.angles(rad[[k]], rad)[0])[4], abs=2e-8)


def test_leaves_look_at_few_others(spark):
    """The candidates of a leaf do not grow with the table."""
    seen = []
    for n in (1000, 4000):
        points = frame(spark, np.random.default_rng(n).uniform(-60, 60, (n, 2)))
        rounds = Rounds(spark, "t")
        tree = N.grown(N.spots_of(points, 5).withColumn("v", F.lit(0.0)), rounds, leaf=16)
        seen.append(N.candidates(tree, N.distance_bounds, 5, rounds).count() / tree.leaves.count())
    assert seen[1] < 1.5 * seen[0] and seen[1] < 60


# --- scales -----------------------------------------------------------------------------------------------


def test_pyramid_counts_every_point_once_a_level(spark, sf):
    points = view(spark, sf, "biased")
    p, cells = profile(points), P.pyramid(points, 9)
    for r in cells.groupBy("level").agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.max("j").alias("j"), F.max("i").alias("i")).collect():
        assert (r.n, r.p) == (p.n, p.p) and max(r.j, r.i) < 1 << r.level
    rows = P.scales(cells).orderBy("level").collect()
    whole = p.rate * (1 - p.rate)
    assert all(r.between + r.within == pytest.approx(whole, abs=2e-6) for r in rows)
    assert [r.explained for r in rows] == sorted(r.explained for r in rows)  # finer cells explain no less


def test_z_order_is_the_interleaved_bits(spark):
    pairs = [(0, 0), (1, 0), (0, 1), (5, 9), (2**31 - 1, 0), (123456789, 987654321)]
    rows = spark.createDataFrame(pairs, "j long, i long").select("j", "i", P.z_order(F.col("j"), F.col("i")).alias("z")).collect()
    assert all(r.z == sum((r.j >> k & 1) << 2 * k | (r.i >> k & 1) << 2 * k + 1 for k in range(31)) for r in rows)


def test_stability_of_a_planted_region(spark):
    """One half with a higher rate: cells in it agree on every scale but those that hold both halves."""
    rng = np.random.default_rng(13)
    where = rng.uniform(0, 1, (6000, 2))
    where[:2] = [[0, 0], [1, 1]]
    points = frame(spark, where, (rng.uniform(size=6000) < np.where(where[:, 0] < 0.5, 0.9, 0.1)).astype(int))
    cells = P.pyramid(points, 3)
    rows = P.stability(cells, 3).collect()
    assert len(rows) == 64 and all(r.agreement == 1 for r in rows)
    told = P.sensitivity(P.scales(cells)).first()
    assert told.levels == 3 and told.meanvar_variation < 0.1 < told.max_sul_variation and told.max_sul_level == 1


def test_pyramid_of_odd_points(spark):
    one = frame(spark, [(3.0, 4.0)], [1])
    assert [(r.level, r.cell, r.n, r.p) for r in P.pyramid(one, 2).orderBy("level").collect()] == [(0, 0, 1, 1), (1, 0, 1, 1), (2, 0, 1, 1)]
    assert P.pyramid(one.limit(0), 2).count() == 0
    assert P.stability(P.pyramid(one, 0), 0).count() == 0
    with pytest.raises(ValueError):
        P.pyramid(one, 32)


# --- communities ------------------------------------------------------------------------------------------


def modularity(w, label):
    """By definition, with loops on the diagonal counted twice."""
    a = w + w.T
    k, m2 = a.sum(axis=1), a.sum()
    same = np.equal.outer(label, label)
    return ((a - np.outer(k, k) / m2) * same).sum() / m2


def partitions(n):
    if n == 0:
        yield []
        return
    for p in partitions(n - 1):
        for c in range(max(p, default=-1) + 2):
            yield [*p, c]


def test_modularity_by_definition(spark):
    rng = np.random.default_rng(17)
    w = np.triu(rng.integers(0, 5, (7, 7)))
    label = np.array([0, 0, 2, 2, 4, 4, 4])
    edges = spark.createDataFrame([(a, b, int(w[a, b])) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(w)))], "a long, b long, w long")
    own = spark.createDataFrame(list(enumerate(label.tolist())), "node long, c long")
    n, d = C.modularity_parts(C._both_ways(edges), own)
    assert n / d == pytest.approx(modularity(w, label))


def test_communities_of_small_graphs(spark):
    """Two cliques with one link beside a part without, and a ring of triangles: as good as the best of all partitions."""
    two = [(a, b) for s in (range(3), range(3, 6)) for a, b in itertools.combinations(s, 2)] + [(2, 3)]
    ring = [(3 * t + a, 3 * t + b) for t in range(3) for a, b in ((0, 1), (0, 2), (1, 2))] + [(2, 3), (5, 6), (8, 0)]
    apart = [(0, 1), (1, 2), (0, 2)]
    for pairs in ([*two, *((a + 6, b + 6) for a, b in apart)], ring):
        n = max(map(max, pairs)) + 1
        w = np.zeros((n, n), int)
        for a, b in pairs:
            w[a, b] += 1
        found, values = C.louvain(spark.createDataFrame([(a, b, 1) for a, b in pairs], "a long, b long, w long"))
        got = {r.node: r.community for r in found.collect()}
        nodes = sorted(got)
        best = max(modularity(w[np.ix_(nodes, nodes)], np.array(p)) for p in partitions(len(nodes)))
        assert values[-1] == pytest.approx(best) == modularity(w[np.ix_(nodes, nodes)], np.array([got[k] for k in nodes]))
        assert values == sorted(values) and all(c == min(k for k in got if got[k] == c) for c in got.values())


def test_communities_do_not_hang_on_the_layout(spark, sf):
    points = view(spark, sf, "biased")
    cells = R.grid_of(points, 5, 5, profile(points)).where("n > 0").withColumnRenamed("region_id", "id")
    edges = C.cell_graph(cells)
    one, values = C.louvain(edges)
    two, again = C.louvain(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w").repartition(7))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) and values == again
    assert values == sorted(values) and values[-1] > 0.2
    assert one.count() == cells.join(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id").count()


def test_communities_of_odd_edges(spark):
    rows = spark.createDataFrame([(1, 2, 3), (1, 2, 4), (2, 1, 1), (3, 3, 5), (4, 5, 0), (6, 7, None), (8, 9, -1)], "a long, b long, w long")
    found, values = C.louvain(rows)
    assert {(r.node, r.community) for r in found.collect()} == {(1, 1), (2, 1), (3, 3)}
    assert values == sorted(values)
    assert C.louvain(rows.limit(0))[0].count() == 0


# --- polygons ---------------------------------------------------------------------------------------------


def rings(spark, found):
    return spark.createDataFrame([(k, [(float(x), float(y)) for x, y in r]) for k, r in found.items()], "id long, ring array<struct<lon: double, lat: double>>")


def _inside(ring, p):
    """By the angles under which the sides are seen; on a side counts."""
    whole = 0.0
    for a, b in zip(ring, ring[1:] + ring[:1]):
        u, v = np.subtract(a, p), np.subtract(b, p)
        cross, dot = u[0] * v[1] - u[1] * v[0], float(np.dot(u, v))
        if abs(cross) < 1e-12 and dot <= 0:
            return True
        whole += np.arctan2(cross, dot)
    return abs(whole) > 3


STAR = [(0.0, 0.0), (4.0, 1.0), (8.0, 0.0), (5.0, 3.0), (6.0, 7.0), (4.0, 4.0), (1.0, 7.0), (2.0, 3.0)]


def test_measures_of_known_shapes(spark):
    turn = [(1e6 + 3 * np.cos(t), 3 * np.sin(t)) for t in np.linspace(0, 2 * np.pi, 721)[:-1]]
    got = {r.id: r for r in G.with_measures(rings(spark, {1: [(0, 0), (2, 0), (2, 2), (0, 2)], 2: [(5, 5)], 3: [(0, 0), (3, 4)], 4: turn, 5: [(0, 0), (0, 2), (2, 2), (2, 0)]})).collect()}
    assert (got[1].area, got[1].perimeter, got[1].center_lon, got[1].center_lat, got[1].vertices) == (4, 8, 1, 1, 4) and got[1].compactness == pytest.approx(np.pi / 4)
    assert (got[2].area, got[2].perimeter, got[2].compactness, got[2].center_lon) == (0, 0, None, 5)
    assert (got[3].area, got[3].perimeter, got[3].compactness, got[3].center_lat) == (0, 10, 0, 2)
    assert got[4].compactness == pytest.approx(1, abs=1e-4) and got[4].center_lon == pytest.approx(1e6) and got[4].area == pytest.approx(9 * np.pi, rel=1e-4)
    assert got[5].area == 4 and got[5].center_lon == 1  # the other way round


def test_points_in_polygons_by_brute_force(spark):
    rng = np.random.default_rng(19)
    found = {1: STAR, 2: [(x + 2.5, y - 1) for x, y in STAR], 3: [(-9, -9), (9, -9), (9, 9), (-9, 9)], 4: [(1, 1)], 5: [(0, 0), (3, 0)]}
    where = np.concatenate([rng.uniform(-3, 11, (300, 2)), rng.integers(-1, 9, (200, 2)), STAR])
    points = frame(spark, where)
    got = {(r.point_id, r.id) for r in G.points_in(points, rings(spark, found)).collect()}
    assert got == {(k, i) for k, p in enumerate(where) for i, ring in found.items() if _inside([tuple(map(float, v)) for v in ring], p)}
    assert G.points_in(points.limit(0), rings(spark, found)).count() == 0


def test_nearest_other_polygons(spark):
    square = lambda x, y, s=1.0: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    found = {1: square(0, 0), 2: square(3, 0), 3: square(0.5, 0.5), 4: square(100, 100), 5: square(40, 0, 20), 6: [(50.0, 10.0)], 7: [(62.0, 0.0), (62.0, 9.0)], 8: square(-50, 3)}
    got = {r.id: (r.nearest, round(r.distance, 6)) for r in G.nearest_others(rings(spark, found)).collect()}
    assert got == {1: (3, 0), 2: (3, 1.5), 3: (1, 0), 4: (5, round(np.hypot(40, 80), 6)), 5: (6, 0), 6: (5, 0), 7: (5, 2), 8: (1, round(np.hypot(49, 2), 6))}
    assert G.nearest_others(rings(spark, {1: STAR})).count() == 0
    crossing = {1: [(0, 1), (9, 1), (9, 2), (0, 2)], 2: [(4, 0), (5, 0), (5, 3), (4, 3)]}  # no corner of one in the other
    assert {r.distance for r in G.nearest_others(rings(spark, crossing)).collect()} == {0.0}


def test_segregation_of_known_regions(spark):
    regions = spark.createDataFrame([(1, 10, 10), (2, 10, 0), (3, 0, 0)], "region_id long, n long, p long")
    assert G.segregation(regions).first() == (1.0, 1.0, 0.0, 1.0, 0.0)
    even = spark.createDataFrame([(1, 10, 5), (2, 4, 2)], "region_id long, n long, p long")
    assert G.segregation(even).first() == (0.0, 0.5, 0.5, 0.0, 0.5)
    none = spark.createDataFrame([(1, 10, 0)], "region_id long, n long, p long")
    assert G.segregation(none).first()[:4] == (None, None, None, None)


# --- centres ----------------------------------------------------------------------------------------------


def test_steps_are_those_of_plain_kmeans(spark):
    rng = np.random.default_rng(20)
    where = np.concatenate([rng.normal(size=(80, 2)) + [6 * k, 3 * k] for k in range(3)]).round(3)
    points, centres = frame(spark, where), where[[0, 1, 2, 100]].copy()
    got = K.lloyd(points, centres, 5)
    far = K.lloyd(points, np.array([[0.0, 0.0], [900.0, 900.0]]), 3)
    for _ in range(5):
        own = ((where[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([where[own == c].mean(axis=0).round(6) if (own == c).any() else centres[c] for c in range(4)])
    assert got == pytest.approx(centres, abs=2e-6) and far[1].tolist() == [900, 900]
    near = {r.c: r.point_id for r in K.nearest_to(points.repartition(5), got).collect()}
    assert near == {c: int(((where - got[c]) ** 2).sum(axis=1).argmin()) for c in range(4)}


def test_draws_go_with_squared_distance(spark):
    """Three heaps: which two are the first centres, over many seeds, as KMeans++ has it."""
    heaps = {0: (np.array([0.0, 0.0]), 2), 1: (np.array([1.0, 0.0]), 5), 10: (np.array([10.0, 1.0]), 3)}
    at, weight, seen = np.array([x for x, _ in heaps.values()]), np.array([n for _, n in heaps.values()], float), {}
    for seed in range(4000):
        pair = tuple(round(float(x)) for x, _ in K.drawn(at, weight, np.arange(3), 2, seed))
        seen[pair] = seen.get(pair, 0) + 1
    for a, (x, n) in heaps.items():
        rates = {b: m * ((y - x) ** 2).sum() for b, (y, m) in heaps.items() if b != a}
        assert all(abs(seen.get((a, b), 0) / 4000 - n / 10 * r / sum(rates.values())) < 0.03 for b, r in rates.items())
    points = frame(spark, np.repeat(at, [2, 5, 3], axis=0))
    assert sorted(map(tuple, K.first_centres(points, 9, 1).tolist())) == sorted(map(tuple, at.tolist()))  # no more places than that


# --- triangulation ----------------------------------------------------------------------------------------


def brute_edges(where):
    """Pairs with room for the middle of an empty circle, along the line of equal distance."""
    out = {}
    for a, b in itertools.combinations(range(len(where)), 2):
        m, n = (where[a] + where[b]) / 2, np.array([-(where[b] - where[a])[1], (where[b] - where[a])[0]])
        c = np.delete(where, [a, b], axis=0) - m
        e, f = (c**2).sum(axis=1) - ((where[a] - where[b]) ** 2).sum() / 4, 2 * c @ n
        high, low = (e[f > 0] / f[f > 0]).min(initial=1e6), (e[f < 0] / f[f < 0]).max(initial=-1e6)
        if high - low > 1e-7 and not (e[f == 0] < 0).any():
            out[a, b] = bool(low <= 0 <= high)
    return out


def found_edges(points):
    return {(r.a, r.b): r.gabriel for r in T.delaunay(points).collect()}


@pytest.mark.parametrize("leaf", [5, 64])
def test_triangulation_by_brute_force(spark, leaf, monkeypatch):
    """Dense heaps, lone places, and the rim, where cells have no end."""
    monkeypatch.setattr(T, "_LEAF", leaf)
    monkeypatch.setattr(T, "_FIRST", 4)  # few, so that most corners are still to be looked round
    rng = np.random.default_rng(23)
    where = np.concatenate([rng.normal(size=(60, 2)) * 0.01, rng.uniform(-9, 9, (60, 2)), rng.normal(size=(20, 2)) * [0.001, 5] + [30, 0]])
    got = found_edges(frame(spark, where))
    assert got == brute_edges(where)


def test_triangulation_of_lattices_and_few_places(spark):
    side = 6
    lattice = np.array([(x, y) for x in range(side) for y in range(side)], float)
    got = found_edges(frame(spark, lattice))
    assert set(got) == {(a, b) for a, b in itertools.combinations(range(side * side), 2) if ((lattice[a] - lattice[b]) ** 2).sum() == 1} and all(got.values())
    line = frame(spark, [(k * k, 0.0) for k in range(7)])
    assert found_edges(line) == {(k, k + 1): True for k in range(6)}
    twice = frame(spark, [(0, 0), (0, 0), (1, 0), (0, 1), (0, 1)])
    assert set(found_edges(twice)) == {(0, 2), (0, 3), (2, 3)}
    assert found_edges(twice.limit(1)) == {} == found_edges(twice.limit(0))


def test_triangulation_of_places_that_nearly_meet(spark):
    """A thousand places within a billionth of the extent, and some far away: a plane graph still, with all its triangles."""
    rng = np.random.default_rng(26)
    where = np.concatenate([rng.normal(size=(1000, 2)) * 1e-9, rng.uniform(-9, 9, (100, 2))])
    n, edges = len(where), found_edges(frame(spark, where))
    assert 3 * n - 3 - 90 < len(edges) <= 3 * n - 6


def test_triangulation_has_all_triangles(spark):
    """By Euler's formula, n places of which h are on the hull have 3n - 3 - h edges."""
    where = np.random.default_rng(24).uniform(0, 1, (1500, 2))
    points = frame(spark, where)
    (hull,) = layers.hulls(points.withColumn("g", F.lit(1)), "g").collect()
    # Edges along the rim may have circles wider than those that are looked at.
    assert 0 <= 3 * 1500 - 3 - len(hull.hull) - len(found_edges(points)) <= 1



def test_band_sums_are_those_of_pairs(spark, monkeypatch):
    """Sites at shared places, null values and lonely sites; no pair is written."""
    rows = [(k, (k * 7 % 13) / 10, (k * 5 % 11) / 10, None if k % 17 == 0 else float(k * k % 7)) for k in range(120)] + [(500, 50.0, 50.0, 1.0)]
    sites = spark.createDataFrame(rows, "id long, lon double, lat double, x double")
    (want,) = A.global_autocorrelation(sites, A.band_weights(sites, 0.3)).collect()
    monkeypatch.setattr(A, "band_weights", None)
    assert A.band_autocorrelation(sites, 0.3).collect() == [want]
    (alone,) = A.band_autocorrelation(sites.where("id = 500"), 0.3).collect()
    assert alone.n == 1 and alone.s0 is None and alone.moran is None

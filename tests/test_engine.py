"""Operators on small fixtures with known results, and their properties."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from geoaudit.cli import fractions, parser
from geoaudit.functions.scores import likelihood_ratio, min_cluster_size
from geoaudit.operators import hdbscan, layers, neighbours
from geoaudit.operators import regions as R
from geoaudit.operators import significance as S
from geoaudit.operators.scan import best_region, scored, variance_summary
from geoaudit.plans.audit import Audit
from geoaudit.plans.report import params_json, write_by_dataset, write_csv
from geoaudit.queries import QUERIES
from geoaudit.sources.catalog import DATASETS, Dataset, dataset, dataset_path, radius_values
from geoaudit.sources.points import load_dataset, normalised, numbered, profile, view
from geoaudit.streaming.counts import stream_cells

POINT = "point_id long, lon double, lat double, outcome int"


@pytest.fixture(scope="module")
def diagonal(spark):
    at = np.linspace(0, 1, 100)
    return spark.createDataFrame([(k, float(x), float(x), k % 2) for k, x in enumerate(at)], POINT)


def sul(spark, n, p, total, positive, way="both"):
    return spark.range(1).select(likelihood_ratio(*(F.lit(x).cast("long") for x in (n, p, total, positive)), way)).first()[0]


@pytest.mark.parametrize(
    ("args", "want"),
    [
        ((0, 0, 10, 5), 0), ((10, 5, 10, 5), 0), ((3, 3, 10, 10), 0), ((0, 0, 0, 0), 0), ((5, 5, 10, 5), 6.931471805599453), ((5, 0, 10, 5), 6.931471805599453),
        ((30, 10, 100, 50), 2.415725678117127), ((1, 1, 3, 1), 1.9095425048844383), ((4, 2, 10, 5), 0), ((8, 8, 10, 5), 11.512925464970229),
        ((5, 5, 10, 5, "less_in"), 0), ((5, 5, 10, 5, "less_out"), 6.931471805599453), ((5, 5, 10, 5, "any"), 6.931471805599453),
    ],
)
def test_likelihood_ratio(spark, args, want):
    assert sul(spark, *args) == pytest.approx(want, abs=1e-9)


def test_likelihood_ratio_is_the_same_for_swapped_outcomes(spark):
    assert sul(spark, 30, 10, 100, 50) == pytest.approx(sul(spark, 30, 20, 100, 50))


def test_catalogue():
    assert dataset("lar").grids == ((100, 50), (25, 12))
    assert len(dataset("lar").radius_values()) == 20 and dataset("lar").radius_values()[::19] == [0.05, 1.0]
    assert [len(d.radius_values()) for d in DATASETS.values()] == [20, 19, 19, 19, 19]
    with pytest.raises(ValueError, match="nowhere"):
        dataset("nowhere")
    with pytest.raises(FileNotFoundError):
        dataset_path(dataset("lar"), "/nowhere")
    assert radius_values(0.0, 0.0, 1.0) == []


CSV = '''idx,lat,lon,action_taken,note
0,1.0,2.0,3,x
1,,2.0,1,x
2,1.5,NA,1,x
3,1.5,2.5,,x
4,1.5,2.5,1,
5,1.5,2.5,0.9,"a, ""b"""
'''


def test_load_csv(spark, tmp_path):
    (tmp_path / "LAR.csv").write_text(CSV)
    rows = load_dataset(spark, dataset("lar"), str(tmp_path)).orderBy("point_id").collect()
    assert [(r.point_id, r.lat, r.lon, r.outcome, r.note) for r in rows] == [(0, 1.0, 2.0, 0, "x"), (1, 1.5, 2.5, 1, None), (2, 1.5, 2.5, 0, 'a, "b"')]


@pytest.mark.parametrize("label", [2.0, 3.5])
def test_outcomes_other_than_0_and_1_raise(spark, label):
    rows = spark.createDataFrame([(1.0, 1.0, label)], "lat double, lon double, action_taken double")
    with pytest.raises(PySparkException, match="outcome"):
        normalised(rows, "action_taken", ((3, 0),)).collect()


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="lon, pred"):
        normalised(spark.createDataFrame([(1.0,)], "lat double"), "pred")


def test_empty_table(spark):
    empty = spark.createDataFrame([], POINT)
    p = profile(empty)
    assert (p.n, p.p, p.rate) == (0, 0, 0.0)
    assert R.grid_of(empty, 3, 3, p).count() == 0
    assert R.kmeans_seeds(empty, 5).count() == 0
    assert layers.hulls(empty.withColumn("g", F.lit(1)), "g").count() == 0
    assert layers.stratified_sample(empty).count() == 0
    assert [c.labels.count() for c in hdbscan.clusterings(empty, (0.5,), 2)] == [0]


@pytest.mark.parametrize(("size", "want"), [((4, 3), [25, 8, 0, 0, 0, 17, 16, 0, 0, 0, 9, 25]), ((3, 3), [33, 0, 0, 0, 33, 0, 0, 0, 34])])
def test_diagonal_grid(diagonal, size, want):
    assert [r.n for r in R.grid_of(diagonal, *size).orderBy("region_id").collect()] == want


def test_points_on_inner_edges_are_in_both_cells(diagonal):
    assert R.grid_of(diagonal, 11, 11).agg(F.sum("n")).first()[0] == 115


def test_one_place(spark):
    same = spark.createDataFrame([(k, 5.0, 7.0, k % 2) for k in range(4)], POINT)
    assert [r.n for r in R.grid_of(same, 2, 2).collect()] == [4] * 4


def test_random_grids():
    assert [(x, y) for _, x, y in R.random_grids(8)] == [(30, 13), (10, 33), (18, 17), (17, 14), (33, 13), (31, 33), (38, 27), (12, 28)]
    assert [(x, y) for _, x, y in R.random_grids(5, seed=7)] == [(20, 40), (14, 22), (30, 11), (12, 36), (27, 13)]
    assert sum(x * y for _, x, y in R.random_grids(100)) == 59_089


def test_seeds_and_squares(diagonal):
    seeds = R.kmeans_seeds(diagonal, 100)
    assert seeds.count() == 100
    assert R.squares(seeds, dataset("lar").radius_values()).count() == 2000


def test_seeds_are_repeated_when_points_are_few(spark):
    points = spark.createDataFrame([(k, float(k % 3), 0.0, 0) for k in range(12)], POINT)
    assert R.kmeans_seeds(points, 10).count() == 10


def test_square_counts_and_ids_agree(diagonal):
    seeds, radii = R.nearest_points(diagonal, [(0.2, 0.2), (0.9, 0.9)]), [0.05, 0.3, 0.1]
    p = profile(diagonal)
    assert p.n == 100
    counts = {r.region_id: (r.n, r.p) for r in R.square_stats(diagonal, seeds, radii).collect()}
    ids = R.with_square_ids(diagonal, seeds, radii).select("outcome", F.explode("region_ids").alias("region_id"))
    assert counts == {r.region_id: (r.n, r.p) for r in R.counted(ids, "region_id").collect()}


@pytest.mark.parametrize("mode", ("portable", "fast"))
def test_worlds_of_nested_squares_are_those_of_all(diagonal, mode):
    seeds, radii = R.nearest_points(diagonal, [(0.2, 0.2), (0.9, 0.9), (0.25, 0.3)]), [0.05, 0.1, 0.3]
    stats, p = R.square_stats(diagonal, seeds, radii), profile(diagonal)
    every = S.world_maxima(R.with_square_ids(diagonal, seeds, radii), stats, p.n, p.p, 12, 3, mode).orderBy("world").collect()
    inner = S.world_maxima(R.with_square_ids(diagonal, seeds, radii, True), stats, p.n, p.p, 12, 3, mode, len(radii)).orderBy("world").collect()
    assert len(every) == 12 and len({r.max_sul for r in every}) > 1 and inner == every
    with pytest.raises(ValueError, match="ascend"):
        R.with_square_ids(diagonal, seeds, radii[::-1], True)


def test_variance_ignores_empty_regions(spark):
    rows = spark.createDataFrame([(0, 4, 0), (1, 0, 0), (2, 4, 4)], "region_id long, n long, p long")
    got = variance_summary(rows).first()
    assert (got.meanvar, got.best_region_id, got.n_regions) == (0.25, 0, 3)
    none = variance_summary(rows.withColumn("n", F.lit(0).cast("long")).withColumn("p", F.lit(0).cast("long"))).first()
    assert (none.meanvar, none.max_score, none.best_region_id) == (0.0, 0.0, 0)


def test_ties(spark):
    rows = spark.createDataFrame([(k, 2, 2) for k in range(3)], "region_id long, n long, p long")
    scores = scored(rows, 6, 6).withColumn("sul", F.lit(1.0))
    assert best_region(scores).first().region_id == 0
    ranked = S.significant(scores, spark.createDataFrame([(1.0,)], "threshold double"))
    assert [r.region_id for r in ranked.orderBy("rank").collect()] == [2, 1, 0]


def test_threshold(spark):
    assert [S.threshold_rank(w, 0.005) for w in (20, 200, 1000)] == [0, 1, 5]
    maxima = spark.createDataFrame([(k, float(k)) for k in range(200)], "world int, max_sul double")
    assert S.threshold(maxima, 200, 0.005).first()[0] == 198.0
    assert S.threshold(maxima.limit(0), 0, 0.005).first()[0] == 0.0


def _worlds(spark, sf, mode, partitions=2, worlds=60):
    points = view(spark, sf, "biased").repartition(partitions)
    p = profile(points)
    cells = R.grid_of(points, 4, 4, p)
    got = S.world_maxima(R.with_cells(points, p, 4, 4), cells, p.n, p.p, worlds, 5, mode).orderBy("world").collect()
    return [r.max_sul for r in got]


@pytest.mark.parametrize("mode", S.MODES)
def test_worlds_do_not_hang_on_the_layout(spark, sf, mode):
    assert _worlds(spark, sf, mode, 1, 10) == _worlds(spark, sf, mode, 7, 10)


def test_modes_agree_in_distribution(spark, sf):
    means = [np.mean(_worlds(spark, sf, mode)) for mode in ("portable", "fast", "binomial")]
    assert max(means) / min(means) < 1.5


def test_exact_worlds_are_numpys_stream(spark):
    n, worlds = 40, 3
    points = spark.createDataFrame([(k, float(k % 8), 0.0, int(k < 10)) for k in range(n)], POINT).repartition(3).withColumn("region_ids", F.array(F.col("lon").cast("long")))
    regions = R.counted(points.withColumn("region_id", F.col("lon").cast("long")), "region_id")
    got = S.world_maxima(points, regions, n, 10, worlds, 9, "exact").orderBy("world").collect()
    rng, want = np.random.default_rng(9), []
    for _ in range(worlds):
        drawn = rng.binomial(1, 0.25, n)
        rows = spark.createDataFrame([(k, 5, int(drawn[np.arange(n) % 8 == k].sum())) for k in range(8)], "region_id long, n long, p long")
        want.append(scored(rows, n, 10).agg(F.max("sul")).first()[0])
    assert [r.max_sul for r in got] == want


def test_worlds_at_once_are_those_of_single_draws(spark):
    """Every draw of the matrix is that of the hash expression, and counts are those of a row for each point and world."""
    rng = np.random.default_rng(21)
    rows = [(int(i), sorted(rng.choice(9, rng.integers(0, 4), replace=False).tolist())) for i in rng.integers(-(2**62), 2**62, 400)]
    points = spark.createDataFrame(rows, "point_id long, region_ids array<long>").repartition(3)
    for seed in (5, -7):
        every = points.withColumn("world", F.explode(F.sequence(F.lit(0), F.lit(69)))).where(S.fast_uniform(seed, F.col("world"), F.col("point_id")) < 0.3)
        want = {(r.world, r.region_id): r["count"] for r in every.withColumn("region_id", F.explode("region_ids")).groupBy("world", "region_id").count().collect()}
        got = {(r.world, r.region_id): r.p for r in S._drawn_at_once(points, 70, 0.3, seed).collect()}
        assert {k: v for k, v in got.items() if v} == want and len(got) == 70 * 9


def test_pruned_boxes_are_apart_and_many(spark):
    rows = [(i, float((i * 7919) % 100), float((i * 104729) % 97), 3.0 + i % 5) for i in range(200)]
    ranked = spark.createDataFrame([(i, i + 1, x - r, y - r, x + r, y + r) for i, x, y, r in rows], "region_id long, rank int, lon_min double, lat_min double, lon_max double, lat_max double")
    kept = S.pruned(ranked)
    assert kept.count() == 51
    assert S.overlapping_pairs(kept).count() == 0


def test_overlapping_pairs_are_those_of_brute_force(spark):
    rng = np.random.default_rng(6)
    low = rng.uniform(-9, 9, (80, 2)).round(0)
    boxes = [(k, x, y, x + w, y + h) for k, ((x, y), (w, h)) in enumerate(zip(low.tolist(), rng.integers(0, 4, (80, 2)).astype(float).tolist()))]
    schema = "region_id long, lon_min double, lat_min double, lon_max double, lat_max double"
    want = {(a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and a[3] >= b[1] and b[3] >= a[1] and a[4] >= b[2] and b[4] >= a[2]}
    got = S.overlapping_pairs(spark.createDataFrame(boxes, schema)).collect()
    assert want and len(got) == len(want) and {(r.a, r.b) for r in got} == want
    points = [(k, x, y, x, y) for k, x, y, _, _ in boxes]
    assert S.overlapping_pairs(spark.createDataFrame(points, schema)).count() == sum(a[1:] == b[1:] for a in points for b in points if a[0] < b[0])
    assert S.overlapping_pairs(spark.createDataFrame([], schema)).count() == 0


BOXES = "region_id long, rank int, lon_min double, lat_min double, lon_max double, lat_max double"


def _greedy(boxes):
    """Ranks that are kept, one box after another, with kept boxes looked up by the unit squares that they touch."""
    kept, by = [], {}
    for rank, a in enumerate(boxes, 1):
        squares = [(x, y) for x in range(int(np.floor(a[0])), int(np.floor(a[2])) + 1) for y in range(int(np.floor(a[1])), int(np.floor(a[3])) + 1)]
        if not any(a[2] >= b[0] and b[2] >= a[0] and a[3] >= b[1] and b[3] >= a[1] for s in squares for b in by.get(s, ())):
            kept.append(rank)
            for s in squares:
                by.setdefault(s, []).append(a)
    return kept


@pytest.mark.parametrize("kind", ["mixed", "nested", "grid", "flat"])
def test_pruning_is_that_of_one_fold(spark, kind):
    """Boxes of very different sizes, squares inside each other, cells with common edges, and points and lines."""
    rng = np.random.default_rng(15)
    if kind == "mixed":
        at, side = rng.uniform(-30, 30, (700, 2)), 2.0 ** rng.uniform(-6, 4, (700, 1))
        boxes = np.concatenate([at, at + side * rng.uniform(0.2, 1, (700, 2))], axis=1)
    elif kind == "nested":
        at = np.repeat(rng.uniform(-9, 9, (30, 2)), 20, axis=0)
        r = np.tile(np.arange(1, 21) * 0.1, 30)[:, None]
        boxes = np.concatenate([at - r, at + r], axis=1)
    elif kind == "grid":
        j, i = np.divmod(np.arange(400), 20)
        boxes = np.stack([j, i, j + 1, i + 1], axis=1).astype(float)
    else:
        at = rng.integers(-5, 5, (200, 2)).astype(float)
        boxes = np.concatenate([at, at + rng.integers(0, 2, (200, 2)) * [2, 0]], axis=1)
    boxes = rng.permutation(boxes).tolist()
    ranked = spark.createDataFrame([(k, k + 1, *b) for k, b in enumerate(boxes)], BOXES).repartition(3)
    got = sorted((r.kept_rank, r["rank"]) for r in S.pruned(ranked).collect())
    assert got == list(enumerate(_greedy(boxes), 1))


def test_pruning_many_boxes(spark):
    """As many boxes as one row could not hold."""
    n = 300_000
    rng = np.random.default_rng(16)
    at = rng.uniform(0, 700, (n, 2))
    boxes = np.concatenate([at, at + rng.uniform(0.3, 1, (n, 2))], axis=1)
    frame = pd.DataFrame(boxes, columns=["lon_min", "lat_min", "lon_max", "lat_max"]).assign(region_id=range(n), rank=range(1, n + 1))
    got = [r["rank"] for r in S.pruned(spark.createDataFrame(frame)).select("rank").collect()]
    assert sorted(got) == _greedy(boxes.tolist())


def test_pruning_boxes_that_all_meet(spark):
    """Pairs that meet are never listed: twenty thousand boxes over one place leave one."""
    k = F.col("id")
    ranked = spark.range(20_000).select(k.alias("region_id"), (k + 1).cast("int").alias("rank"), (-1 - k % 7).cast("double").alias("lon_min"), F.lit(-1.0).alias("lat_min"), F.lit(1.0).alias("lon_max"), (1 + k % 5).cast("double").alias("lat_max"))
    assert [(r["rank"], r.kept_rank) for r in S.pruned(ranked).collect()] == [(1, 1)]
    assert S.pruned(ranked.limit(0)).count() == 0


def test_rows_are_numbered_over_partitions(spark):
    rows = spark.range(0, 50, 1, 7).where("id % 10 != 3 AND (id < 14 OR id > 27)")
    got = [(r.id, r.point_id) for r in numbered(rows).orderBy("id").collect()]
    assert [k for _, k in got] == list(range(len(got))) and len(got) == rows.count()
    assert numbered(rows.limit(0)).count() == 0


def test_reachability_is_that_of_brute_force(spark, monkeypatch):
    where = np.random.default_rng(8).normal(size=(70, 2)) * 20
    where[5] = where[6]
    points = spark.createDataFrame([(100 - k, float(x), float(y), 0) for k, (x, y) in enumerate(where)], POINT)
    rad = np.radians(where[:, ::-1])
    every = neighbours.angles(rad, rad)
    core = np.sort(every, axis=1)[:, 3]
    reach = np.maximum(np.maximum(core[:, None], core), every)
    reach[np.diag_indices(70)] = np.nan
    monkeypatch.setattr(neighbours, "_LEAF", 16)
    got = {r.point_id: (r.core, r.nearest, r.farthest) for r in neighbours.mutual_reachability(points, 4).collect()}
    assert len(got) == 70
    for k in range(70):
        assert got[100 - k] == pytest.approx((core[k], np.nanmin(reach[k]), np.nanmax(reach[k])), abs=2e-8)
    assert {r.point_id: r.core for r in neighbours.core_distances(points, 4).collect()} == {k: v[0] for k, v in got.items()}
    few = points.limit(3)
    assert neighbours.core_distances(few, 4).count() == neighbours.mutual_reachability(few, 4).count() == 0
    monkeypatch.setattr(hdbscan, "MOST_POINTS", 69)
    with pytest.raises(ValueError, match="70 points"):
        hdbscan.clusterings(points, (0.5,), 2)


def test_two_blobs_and_an_outlier(spark):
    places = [0, 0.0001, 0.0002, 1, 1.0001, 1.0002, 20]
    points = spark.createDataFrame([(k, float(x), float(x), 0) for k, x in enumerate(places)], POINT)
    (found,) = hdbscan.clusterings(points, (0.4,), 2)
    assert found.min_size == 3
    assert [r.label for r in found.labels.orderBy("point_id").collect()] == [0, 0, 0, 1, 1, 1, -1]


def _brute_clusters(where: np.ndarray, least: int) -> list[tuple[set[int], set[int]]]:
    """HDBSCAN from its definition: take the longest links away, level by level, and see what falls apart.

    Of each cluster, its members, and points that leave it at the very level at which it comes to be (ties).
    """
    every = hdbscan._angles(where, where)
    core = np.sort(every, axis=1)[:, least - 1]
    reach = np.maximum(np.maximum(core[:, None], core), every)

    def parts(members, limit):
        out, rest = [], set(members)
        while rest:
            todo, part = [rest.pop()], []
            while todo:
                part.append(todo.pop())
                near = {k for k in rest if reach[part[-1], k] < limit}
                rest -= near
                todo.extend(near)
            out.append(part)
        return out

    def grow(members, birth, ties=()):
        mass, inside, under = 0.0, members, []
        while True:
            levels = np.unique(reach[np.ix_(inside, inside)][~np.eye(len(inside), dtype=bool)])
            low, high = 0, len(levels) - 1
            while low < high:  # the least level that holds all together
                middle = (low + high) // 2
                low, high = (low, middle) if len(parts(inside, np.nextafter(levels[middle], 9))) == 1 else (middle + 1, high)
            big = [p for p in parts(inside, levels[low]) if len(p) >= least]
            gone = len(inside) - (len(big[0]) if len(big) == 1 else 0)
            mass += (1 / levels[low] - birth) * gone
            if len(big) != 1:
                kept = set().union(*big)
                loose = {k for k in inside if k not in kept}
                under = [grow(p, 1 / levels[low], {k for k in loose if reach[k, p].min() <= levels[low]}) for p in big]
                break
            inside = big[0]
        below = sum(m for m, _ in under)
        if under and (birth == 0 or below > mass):
            return below, [c for _, found in under for c in found]
        return mass, [(set(members), set(ties))] if birth else []

    return grow(list(range(len(where))), 0.0)[1]


def test_all_members_are_those_of_brute_force(spark, sf):
    rng = np.random.default_rng(12)
    places = np.concatenate([rng.normal(size=(30, 2)) * 0.2 + [8 * k, 4 * k] for k in range(3)])
    places[::11] += rng.uniform(-6, 6, (len(places[::11]), 2))  # outliers, near and far
    points = spark.createDataFrame([(k, float(x), float(y), 0) for k, (x, y) in enumerate(places)], POINT)
    for frame in (points, view(spark, sf, "blobs")):
        rows = frame.orderBy("point_id").select("point_id", F.radians("lat"), F.radians("lon")).collect()
        found = hdbscan.clusterings(frame)[0] if frame is not points else hdbscan.clusterings(frame, (0.08,), 5)[0]
        got = {}
        for r in found.regions().collect():
            got.setdefault(r.cluster_label, set()).add(r.point_id)
        ids = [r[0] for r in rows]
        want = sorted((sorted(ids[k] for k in c), {ids[k] for k in ties}) for c, ties in _brute_clusters(np.array([r[1:] for r in rows]), found.min_size))
        assert want and len(want) == len(got)
        for own, (members, ties) in zip(sorted(got.values(), key=min), want, strict=True):
            assert set(members) <= own <= set(members) | ties
    positive = {r.point_id for r in view(spark, sf, "blobs").where("outcome = 1").collect()}
    sizes = sorted((r.blob, r.n, r.p) for r in QUERIES["hdbscan_members"](spark, sf).collect())
    assert sizes == sorted((min(c) % 5, len(c), len(c & positive)) for c in got.values())


def test_min_cluster_size_rounds_half_to_even():
    assert [min_cluster_size(0.005, n, 1) for n in (500, 1500)] == [2, 8]


def test_spanning_tree_is_minimal(spark):
    rng = np.random.default_rng(1)
    where = rng.normal(size=(60, 2)) * 0.1
    sent = spark.sparkContext.broadcast(where)
    core = hdbscan._cores(spark, sent, 60, 5)
    every = hdbscan._angles(where, where)
    assert np.allclose(core, np.sort(every, axis=1)[:, 4])
    reach = np.maximum(np.maximum(core[:, None], core), every)
    inside, total = [0], 0.0
    while len(inside) < 60:  # Prim
        rest = [k for k in range(60) if k not in inside]
        part = reach[np.ix_(inside, rest)]
        total += part.min()
        inside.append(rest[np.unravel_index(part.argmin(), part.shape)[1]])
    assert hdbscan._spanning_tree(spark, sent, core)[:, 0].sum() == pytest.approx(total)


def _hull(spark, places, slice_of=2048):
    points = spark.createDataFrame([(k, float(x), float(y), 0) for k, (x, y) in enumerate(places)], POINT).withColumn("g", F.lit(1))
    return [(v.lon, v.lat) for v in layers.hulls(points, "g", slice_of=slice_of).first().hull]


@pytest.mark.parametrize(
    ("places", "want"),
    [
        ([(0, 0), (1, 0), (1, 1), (0, 1), (0.5, 0.5), (0.5, 0)], [(0, 0), (1, 0), (1, 1), (0, 1)]),
        ([(0, 0), (1, 1), (2, 2)], [(0, 0), (2, 2)]),
        ([(3, 4)], [(3, 4)]),
    ],
)
def test_hull(spark, places, want):
    assert _hull(spark, places) == want


def test_random_hulls(spark):
    rng = np.random.default_rng(3)
    places = rng.normal(size=(200, 2)).round(2).tolist()
    hull = _hull(spark, places)
    for (x, y), (u, v) in zip(hull, hull[1:] + hull[:1]):
        assert all((u - x) * (b - y) - (v - y) * (a - x) >= -1e-12 for a, b in places)


def test_hulls_do_not_hang_on_slices(spark):
    places = np.random.default_rng(4).normal(size=(300, 2)).round(1).tolist()
    assert _hull(spark, places) == _hull(spark, places, 16) == _hull(spark, places, 1)


def test_sample_gives_what_positives_leave_to_negatives(spark):
    points = spark.createDataFrame([(k, 0.0, 0.0, int(k < 3)) for k in range(50)], POINT)
    got = layers.stratified_sample(points, 20)
    assert {r.outcome: r["count"] for r in got.groupBy("outcome").count().collect()} == {1: 3, 0: 17}
    assert {r.color for r in got.where("outcome = 1").collect()} == {layers.POSITIVE}


def test_csv(tmp_path):
    assert write_csv([], tmp_path / "none.csv") is None
    rows = [{"dataset": "b", "x": None, "params": params_json({"b": 1, "a": [1.5]})}, {"dataset": "a", "x": 2, "params": "{}"}]
    paths = write_by_dataset(rows, tmp_path, "t_{dataset}.csv")
    assert [p.name for p in paths] == ["t_a.csv", "t_b.csv"]
    assert paths[1].read_text() == 'dataset,x,params\nb,,"{""a"": [1.5], ""b"": 1}"\n'
    assert [p.name for p in write_by_dataset([{"x": 1}], tmp_path, "t_{dataset}.csv")] == ["t_all.csv"]


def test_command_line():
    assert fractions("0.1, ,0.2") == (0.1, 0.2) and fractions("") == ()
    a = parser().parse_args(["one-partitioning", "--notebook-grid", "--maps"])
    assert (a.dataset, a.n_alt_worlds, a.notebook_grid, a.maps) == ("lar", 1000, True, True)
    assert parser().parse_args(["all"]).n_partitionings == 100


def test_experiments(spark, sf, tmp_path):
    audit = Audit(spark, tmp_path, maps=True, fractions=(0.01,), verbose=False)
    spec = Dataset("blobs", "", "", (1.0, 3.0, 1.0), ((4, 3),))
    audit.add(spec, view(spark, sf, "blobs"))
    (free,) = audit.unrestricted("blobs", 20, 0.05, 5)
    assert (free["n_regions"], free["method"]) == (10, "kmeans_scan") and free["non_overlapping_regions"] <= 5
    assert json.loads(free["params"]) == {"n_seeds": 5, "radii": [1.0, 2.0]}
    (grid,) = audit.one_partitioning("blobs", 20, 0.05)
    assert grid["n_regions"] == 12 and grid["meanvar_best_n"] > 0
    rows = audit.multiple_partitionings("blobs", 3)
    assert len(rows) == 4 and rows[-1]["n_regions"] == sum(r["n_regions"] for r in rows[:-1])
    clusters = audit.rows["hdbscan"]
    assert [r["n_regions"] for r in clusters] == [5, 5, 5]
    assert clusters[0]["signif_threshold"] is not None and clusters[2]["signif_threshold"] is None
    assert sorted(p.name for p in audit.write()) == ["hdbscan_blobs_comparison.csv", "multiple_partitionings_blobs.csv", "one_partitioning_blobs.csv", "unrestricted_blobs_regions.csv"]
    assert audit.frame("hdbscan").count() == 3
    pages = sorted(p.name for p in tmp_path.glob("*.html"))
    assert pages == ["one_partitioning_blobs_4x3.html", "one_partitioning_blobs_hdbscan.html", "unrestricted_blobs.html"]
    assert "HDBSCAN cluster=" in (tmp_path / "one_partitioning_blobs_hdbscan.html").read_text()


def test_planted_bias_is_found_and_fairness_is_not(spark):
    found = {}
    for name in ("biased", "fair"):
        points = view(spark, "/root/testdata/sf0.01", name)
        p = profile(points)
        cells = R.grid_of(points, 20, 20, p)
        limit = S.threshold(S.world_maxima(R.with_cells(points, p, 20, 20), cells, p.n, p.p, 200, 82, "fast"), 200, 0.005)
        found[name] = S.significant(scored(cells, p.n, p.p), limit).count()
    assert found["biased"] > 0 and found["fair"] == 0


def test_stream_equals_batch(spark, sf, tmp_path):
    points = view(spark, sf, "events").select("lon", "lat", "outcome")
    points.repartition(3).write.parquet(str(tmp_path / "in"))
    p = profile(points)
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_cells(stream, p, 5, 5).writeStream.format("memory").queryName("cells").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = {r.region_id: (r.n, r.p) for r in stream_cells(points, p, 5, 5).collect()}
    assert {r.region_id: (r.n, r.p) for r in spark.table("cells").collect()} == want


def test_grid_counting_shuffles_partial_counts_only(spark, sf):
    points = view(spark, sf, "lineitem")
    plan = R.grid_of(points, 20, 20, profile(points))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert "ReadSchema: struct<l_quantity" in plan and "l_orderkey" not in plan.split("ReadSchema")[-1]


@pytest.mark.parametrize("mode", ["fast", "portable"])
def test_more_draws_than_a_byte_counts(spark, mode):
    """1,000 points in one region, so that sums by bytes would overflow; the draws are those of the expressions."""
    points = spark.range(1000).select(F.col("id").alias("point_id"), F.array(F.lit(3).cast("long"), (F.col("id") % 2 + 5).cast("long")).alias("region_ids"))
    uniform = {"fast": S.fast_uniform, "portable": S.portable_uniform}[mode]
    every = points.withColumn("world", F.explode(F.sequence(F.lit(0), F.lit(2)))).where(uniform(7, F.col("world"), F.col("point_id")) < 0.9)
    want = every.select("world", F.explode("region_ids").alias("region_id")).groupBy("world", "region_id").count()
    got = S._drawn_at_once(points, 3, 0.9, 7, mode)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rings_look_at_few_seeds(spark):
    """Of 100 seeds, a point meets those of the buckets that their squares touch, without further ones around."""
    seeds = spark.range(100).select(F.col("id").cast("int").alias("seed_rank"), (F.col("id") % 10 * 10.0).alias("lon"), (F.floor(F.col("id") / 10) * 10.0).alias("lat"))
    assert R._reached(seeds, 1.0, 2.0).groupBy("seed_rank").count().agg(F.max("count")).first()[0] <= 9


def test_tree_search_is_that_of_all_pairs(spark):
    """Equal places and distances on a lattice, 1,500 points in leaves of a tree: cores and edges of the one minimal tree by (d, lower, higher end)."""
    k = np.arange(1500)
    where = np.radians(np.stack([k * 7919 % 37 / 10 + k % 3 * 20, k * 104729 % 31 / 10], axis=1))
    every = hdbscan._angles(where, where)
    sent = spark.sparkContext.broadcast(where)
    core = hdbscan._cores(spark, sent, 1500, 20)
    assert hdbscan._Boxes(where).depth > 4
    assert (core == np.sort(every, axis=1)[:, 19]).all()
    reach = np.maximum(np.maximum(every, core[:, None]), core[None, :])
    a, b = np.triu_indices(1500, 1)
    root, want = list(range(1500)), []

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for at in np.lexsort((b, a, reach[a, b])).tolist():
        x, y = find(int(a[at])), find(int(b[at]))
        if x != y:
            root[x] = y
            want.append((reach[a[at], b[at]], int(a[at]), int(b[at])))
    assert [tuple(e) for e in hdbscan._spanning_tree(spark, sent, core).tolist()] == sorted(want)

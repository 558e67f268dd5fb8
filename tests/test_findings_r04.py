"""Findings of round 4: each of these would have failed before."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoaudit.llm import lm
from geoaudit.llm import running as R
from geoaudit.operators import hdbscan
from geoaudit.operators import neighbours as N


def test_running_texts_are_counted_and_scored_whole(spark):
    """every training word counts as often as it comes, after the word before; the order of words matters."""
    sizes, texts = (12,) * 6, pa.array(["a b a b", "", None, "a b"])
    tables = [np.zeros(2 << s, np.uint32) for s in sizes]
    R.count(tables, sizes, texts)
    assert [int(t.sum()) for t in tables] == [8 * (9 + 1 + 1 + 5)] * 6  # the bits of all words and ends, each with a space
    config = lm.LmConfig(slots=(14,) * 5)
    plain = "seven ships sailed over the cold northern sea before winter came again"
    rows = [(k, plain) for k in range(40)] + [(k, " ".join(reversed(plain.split()))) for k in range(40, 400) if lm.zlib.crc32(str(k).encode()) % 5 == 1]
    got = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), config).collect()
    inside, turned = (np.mean([r.score for r in got if (r.doc_id < 40) == x]) for x in (True, False))
    assert inside > turned + 1
    assert np.ptp([r.score for r in got if r.doc_id < 40]) < 1e-9


def test_running_text_is_spelt_in_full():
    """the chances of the first byte's bits add up to one, and those of a text are of all its words in order."""
    sizes, rng = (10,) * 6, np.random.default_rng(0)
    tables = [rng.integers(0, 50, 2 << s).astype(np.float16) for s in sizes]
    mixer = R.RunningMixer(tables, sizes).fixed()
    whole, first, both = mixer.text_scores(pa.array(["", "x", "x y"]))
    assert both < first < 0 and whole < 0
    # All texts of one byte and the empty one: what the first byte may be, summed over what follows it.
    every = pa.array([bytes([b]) for b in range(33, 127)], pa.binary()).cast(pa.string())
    assert np.sum(10.0 ** mixer.text_scores(every)) + 10.0**whole < 1


def test_points_of_one_place_are_clustered_together(spark, monkeypatch):
    """many points at few places are no error, and have the labels that each on its own would have."""
    rng = np.random.default_rng(5)
    where = np.concatenate([rng.normal(size=(40, 2)) * 0.2 + [8 * k, 4 * k] for k in range(3)])
    where[::13] += rng.uniform(-6, 6, (len(where[::13]), 2))
    every = np.repeat(where, rng.integers(1, 6, len(where)), axis=0)[rng.permutation(100)]
    every = np.concatenate([every, np.repeat(where, 2, axis=0)])
    n, rad = len(every), np.radians(every[:, ::-1])
    sent = spark.sparkContext.broadcast(rad)
    core = hdbscan._cores(spark, sent, n, 12)
    want = hdbscan.cluster_labels(hdbscan._spanning_tree(spark, sent, core), n, 12)
    assert want.max() == 2 and want.min() == -1
    assert hdbscan.MOST_POINTS > 6 * 512_820  # the documents of 6 GB
    monkeypatch.setattr(hdbscan, "MOST_PLACES", len(where), raising=False)
    points = spark.createDataFrame([(k, float(x), float(y), 0) for k, (x, y) in enumerate(every)], "point_id long, lon double, lat double, outcome int")
    (found,) = hdbscan.clusterings(points, (12 / n,), 2)
    assert found.min_size == 12
    assert [r.label for r in found.labels.orderBy("point_id").collect()] == want.tolist()


def test_only_places_within_reach_are_sent(spark):
    """what leaves are compared with are their own places and those next to them, not all of the leaves around."""
    rng = np.random.default_rng(2)
    points = spark.createDataFrame([(k, float(x), float(y), 0) for k, (x, y) in enumerate(rng.uniform(0, 40, (3000, 2)))], "point_id long, lon double, lat double, outcome int")
    sent, known = [], N._folded
    with pytest.MonkeyPatch.context() as m:
        m.setattr(N, "_LEAF", 64)
        m.setattr(N, "_folded", lambda met, *rest: sent.append(met.select(F.sum(F.size("la_b"))).first()[0]) or known(met, *rest))
        got = {r.point_id: r.core for r in N.core_distances(points, 5).collect()}
    at = np.radians(np.array([(r.lat, r.lon) for r in points.orderBy("point_id").collect()]))
    want = np.sort(N.angles(at, at), axis=1)[:, 4]
    assert [got[k] for k in range(3000)] == pytest.approx(want.tolist(), abs=1.1e-8)
    assert len(sent) == 1 and sent[0] < 10 * 3000

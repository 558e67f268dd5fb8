"""The training-data operators against brute force, round trips and held-out labels, and on odd tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoaudit.llm import ann, chat, decontam, html, langid, lm, neardup, packing, quality, substring
from geoaudit.llm.components import connected_components, least_reachable
from geoaudit.llm.queries import ORACLE_SQL, QUERIES
from geoaudit.llm.scratch import Scratch, shared_dir

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns that clash with what the operators name theirs.
CLASH = {"score": "x", "row": 1, "kept": True, "node": 2, "bands": "b", "hit": "h", "__text": "t", "salt": 3}
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def letters(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").persist()


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts and ids, repeated rows, a very long text, clashing columns."""
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (3, ""), (4, " \n\t "), (5, "A B C D E F G"), (6, "one two"), (7, "one TWO"), (8, long), (9, long + " end"), (None, "a b c d e f g"), (10, "\x1c\x00 ß é"), (11, "日本語 テキスト")]
    frame = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCUMENT)
    return frame.withColumns({k: F.lit(v) for k, v in CLASH.items()})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCUMENT)


# --- 8: near-duplicates -------------------------------------------------------------------------------


def shingles(text):
    w = words(text)
    return frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(rows):
    """Components by all pairs that share a shingle."""
    sets, root, by = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}, defaultdict(list)

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, s in sorted(sets.items()):
        shared = Counter(j for x in s for j in by[x])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in s:
            by[x].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near(frame, **settings):
    return {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame, neardup.NearDupConfig(**settings)).collect()}


def test_near_duplicates_by_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = {(i, n, c, i == c) for i, (n, c) in linked(rows).items()}
    assert near(docs) == want


def test_near_duplicate_families(spark):
    """Chains of edits, and a passage that most documents share, in more than one block."""
    rng = np.random.default_rng(2)
    fresh = lambda n: [f"v{x}" for x in rng.integers(0, 10**9, n)]
    base, common, rows = fresh(120), fresh(50), []
    for k in range(90):
        own = list(base)
        for place in rng.integers(0, 120, int(rng.integers(0, 6))):
            own[place] = f"e{k}_{place}"
        rows.append((k, " ".join(own)))
    rows += [(100 + k, " ".join(common + fresh(int(rng.integers(3, 60))))) for k in range(90)]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCUMENT)
    want = {(i, n, c, i == c) for i, (n, c) in linked(rows).items()}
    assert near(frame) == want and near(frame, block=16) == want


def test_near_duplicates_of_odd_rows(odd, none):
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(odd).collect())
    assert got == Counter({(1, 3, 1, True): 2, (2, 0, 2, True): 1, (3, 0, 3, True): 1, (4, 0, 4, True): 1, (5, 3, 1, False): 1, (6, 1, 6, True): 1, (7, 1, 6, False): 1, (8, 59_996, 8, True): 1, (9, 59_997, 8, False): 1, (None, 3, None, True): 1, (10, 1, 10, True): 1, (11, 1, 11, True): 1})
    assert near(none) == set()


def test_circulant_coordinates_agree_as_often_as_sets_overlap():
    h = neardup.CirculantMinHash(neardup.NearDupConfig())
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[:320], rng.integers(0, 2**63, 80, dtype=np.uint64)])
    assert abs((h.signature(a) == h.signature(b)).mean() - 320 / 480) < 0.1


def test_near_duplicates_that_repeat_an_id(spark):
    """Rows are documents of their own: a text under a taken id is linked, and kept, by itself."""
    texts = {name: " ".join(f"{name}{k}" for k in range(40)) for name in "AUV"}
    rows = [(1, texts["A"]), (2, texts["A"]), (2, texts["U"]), (5, texts["V"] + " end"), (5, texts["A"]), (7, texts["V"]), (1, texts["A"])]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCUMENT).withColumns({k: F.lit(v) for k, v in {**CLASH, "first": 1, "number": 2, "component": 3, "least": 4}.items()})
    got = Counter((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(frame).collect())
    assert got == Counter({(1, 1, True): 2, (2, 1, False): 1, (2, 2, True): 1, (5, 5, True): 1, (5, 1, False): 1, (7, 5, False): 1})
    left = neardup.without_near_duplicates(frame)
    assert left.columns == frame.columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted([(1, texts["A"]), (2, texts["U"]), (5, texts["V"] + " end")])


def test_large_mixed_buckets(spark):
    """Families that share a passage meet in buckets of several blocks, and single members link families."""
    rng = np.random.default_rng(7)
    fresh = lambda n: [f"v{x}" for x in rng.integers(0, 10**9, n)]
    common, rows = fresh(70), []
    for family in range(6):
        own = fresh(22)
        for k in range(40):
            text = [*common, *own]
            text[int(rng.integers(0, 92))] = f"e{family}_{k}"
            rows.append((1000 * family + k, " ".join(text)))
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCUMENT)
    want = {(i, n, c, i == c) for i, (n, c) in linked(rows).items()}
    assert near(frame, block=16) == want == near(frame, block=16, block_shingles=400)


@pytest.mark.parametrize("one_task", [0, 1 << 20])
def test_components(spark, one_task):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95), (95, 100), (7, 7)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), one_task).collect()
    assert Counter((r.node, r.component) for r in got) == Counter([*((k, 0) for k in range(41)), (90, 90), (95, 90), (100, 90)])
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test"), one_task).count() == 0


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_least_reachable_nodes(edges):
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    nodes, least = least_reachable(*np.array(edges, np.int64).reshape(-1, 2).T)
    assert dict(zip(nodes.tolist(), least.tolist())) == root


# --- 9: decontamination -----------------------------------------------------------------------------------


def contaminated(rows, items, window=13):
    lists, windows = {}, defaultdict(set)
    for i, t in items:
        w = letters(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    lists = {len(x) for x in windows}
    out = set()
    for i, t in rows:
        w = letters(t)
        hit, found = set(), set()
        for n in lists:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    found |= x
                    hit |= set(range(k, k + n))
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.add((i, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def decontaminate(frame, items, **settings):
    return {tuple(r) for r in decontam.contamination_report(frame, items, decontam.DecontamConfig(**settings)).collect()}


def test_decontamination_by_brute_force(spark, sf, docs):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = contaminated([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert any(x[5] for x in want)
    assert decontaminate(docs, items) == want
    assert decontaminate(docs, items, block_words=200) == want
    kept = {r.doc_id for r in decontam.decontaminated(docs, items).collect()}
    assert kept == {x[0] for x in want if not x[5]}


word = st.sampled_from("a b c d".split())
text = st.lists(word, max_size=14).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(text, max_size=4), text.map(lambda t: t + ", " + t))
def test_streaming_the_automaton_finds_what_brute_force_does(items, doc):
    coded = [(k, decontam._item_words(t)) for k, t in enumerate(items)]
    own = decontam.Benchmark(coded, 4)
    import pyarrow as pa

    parts = decontam.W.split(*decontam.W.utf8(pa.array([doc], pa.large_string())), decontam.W.WORD)
    hit, found = np.zeros(len(parts.start), bool), {}
    own.scan(parts, hit, found)
    ((_, n, n_hit, n_items, *_),) = contaminated([(0, doc)], list(enumerate(items)), 4)
    assert (len(hit), int(hit.sum()), len(found.get(0, ()))) == (n, n_hit, n_items)


def test_decontamination_of_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (None, "one two"), (3, ""), (4, "TWO"), (5, "日本語")], "item_id long, text string").withColumn("hit", F.lit(1))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontam.contamination_report(odd, items).collect()}
    assert got[1] == got[None] == got[5] == (7, 7, 1, True) and got[6] == (2, 1, 1, True) and got[2] == got[3] == got[4] == (0, 0, 0, False)
    assert got[8] == (60_000, 0, 0, False) and got[11] == (2, 1, 1, True)
    assert decontam.decontaminated(odd, items).columns == odd.columns
    assert decontaminate(none, items) == set() and not any(x[2] for x in decontaminate(odd, items.limit(0)))


def test_long_spans_are_cut(spark):
    rows = spark.createDataFrame([(1, "x " * 300 + "a b c d e f g, h y")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "A b c d e f g")], "item_id long, text string")
    assert decontam.decontaminated(rows, items, longest_span=5).first().text == "x " * 300 + ", h y"
    assert decontam.decontaminated(rows, items, longest_span=7).first().text == rows.first().text


# --- 1: packing ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    t.encode_special_tokens = True
    return t


def check_pieces(rows, pieces, tokenizer, window):
    want = Counter()
    for i, t in rows:
        want[i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])] += 1
    at, spans = 0, defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.sequence_id * window + p.offset == at
        at += p.length
        spans[p.doc_id].append(p)
    got = Counter()
    for i, own in spans.items():
        held = []
        for p in own:
            held += np.frombuffer(p.ids, "<u4").tolist()
            assert len(p.ids) == 4 * p.length and p.begins == (p.start == 0) and p.ends == (p.start + p.length == p.doc_tokens)
            if p.ends:
                assert len(held) == p.doc_tokens
                got[i, tuple(held)] += 1
                held = []
        assert not held
    assert got == want


def test_packing_round_trip(docs, tokenizer):
    frame = docs.repartition(5)
    pieces = packing.pack(frame, packing.PackingConfig(packing.tokenizer_path())).collect()
    check_pieces([(r.doc_id, r.text) for r in docs.collect()], pieces, tokenizer, 2048)


def test_packing_of_odd_rows(spark, odd, none, tokenizer):
    config = packing.PackingConfig(packing.tokenizer_path(), window=64, cached=3)
    rows = odd.where("doc_id is null or doc_id <> 9")
    check_pieces([(r.doc_id, r.text) for r in rows.collect()], packing.pack(rows, config).collect(), tokenizer, 64)
    assert packing.pack(none, config).count() == 0
    whole = packing.sequences(packing.pack(rows, config), 64).collect()
    assert {len(r.ids) for r in whole} == {256} and sorted(r.n_tokens for r in whole)[1:] == [64] * (len(whole) - 1)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["don't", "İ", "Σς", "ab,", "AB.", "é", "́", "\x1c", " ", "<|endoftext|>", "٣", "漢", "a" * 30])).map(" ".join))
def test_words_are_tokenised_as_the_library_does(text):
    import pyarrow as pa

    own = packing.word_tokenizer(packing.tokenizer_path(), 50)
    ids, first = own.encode(*packing.W.utf8(pa.array([text, None, text], pa.large_string())))
    got = [ids[b:e].tobytes() for b, e in itertools.pairwise(first)]
    assert got == [own.direct(text), b"", own.direct(text)]


# --- 3: nearest neighbours ------------------------------------------------------------------------------------


def duck(sf, sql):
    c = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return c.sql(sql).df()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck(sf, ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns and len(got)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=True)


def test_nearest_in_blocks_and_tiles(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = {tuple(r) for r in ann.nearest_report(rows).collect()}
    assert {tuple(r) for r in ann.nearest_report(rows.repartition(7), ann.NearestConfig(query_block=7, query_tile=3, tile=11)).collect()} == want


def test_nearest_of_odd_rows(spark):
    v = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [0.0, 2.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (None, [9.0, 9.0]), (8, [1.0, 2.0, 3.0]), (9, [-1.0, 1e-30])]
    frame = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = [tuple(r) for r in ann.nearest_report(frame).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (0, 4, 9, -1.0), (20, 1, 9, 2e-30), (20, 2, 0, 0.0), (20, 3, 1, 0.0), (20, 4, 2, 0.0)]
    assert ann.nearest_report(frame.limit(0)).count() == 0


def test_nearest_of_extreme_vectors(spark):
    """Very long and very short vectors beside ordinary ones; products that leave the range of doubles."""
    rng = np.random.default_rng(5)
    rows = [(k, x.tolist()) for k, x in enumerate(rng.normal(size=(60, 2)))]
    rows += [(k, [v, 0.0]) for k, v in ((100, 1e200), (101, 5e-324), (102, 1e-310), (103, -1e200), (104, 1e200))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for config in (ann.NearestConfig(), ann.NearestConfig(block_bytes=64, tile=7)):
        got = defaultdict(list)
        for r in ann.nearest(frame, frame, config).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        for q, x in rows:
            with np.errstate(over="ignore"):
                want = sorted((-(np.float64(x[0]) * y[0] + np.float64(x[1]) * y[1]), i) for i, y in rows if i != q)[:20]
            assert got[q] == [(i, -s) for s, i in want]


def test_error_bounds_hold():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(50, 24)) * 10.0 ** rng.integers(-6, 6, (50, 1)), rng.normal(size=(60, 24))
    near, off = ann._product(ann.Quantised(a), ann.Quantised(b), slice(0, 50))
    assert (np.abs(near - a @ b.T) <= off).all()


# --- 5: repeated passages -----------------------------------------------------------------------------------------


def test_every_long_repeat_is_covered(docs):
    spans = defaultdict(set)
    for r in substring.repeated_passages(docs).collect():
        assert r.match_doc_id < r.doc_id and r.similarity >= 0.75 and r.end - r.start >= 50
        spans[r.doc_id] |= set(range(r.start, r.end))
    seen = {}
    for r in docs.orderBy("doc_id").collect():
        w = words(r.text)
        own = [tuple(w[k : k + 51]) for k in range(len(w) - 50)]
        for k, x in enumerate(own):
            assert x not in seen or spans[r.doc_id] >= set(range(k, k + 51))
        seen |= dict.fromkeys(own)


def test_passages_that_many_share(spark):
    rng = np.random.default_rng(8)
    fresh = lambda n: [f"v{x}" for x in rng.integers(0, 10**9, n)]
    passage, rows = fresh(60), []
    for k in range(200):
        own = list(passage)
        if k % 3 == 1:
            own[30] = f"edit{k}"
        rows.append((k, " ".join([*fresh(int(rng.integers(0, 90))), *own, *fresh(int(rng.integers(0, 90)))]), None, None, None))
    clean = [(1000 + k, " ".join([*fresh(80), *passage[:30], *fresh(80)]), None, None, None) for k in range(20)]
    frame = spark.createDataFrame(rows + clean, DOCUMENT).repartition(4)
    for common in (64, 5):
        found = substring.repeated_passages(frame, substring.SubstringConfig(common=common, batch_docs=30)).collect()
        assert {r.doc_id for r in found} == set(range(1, 200))
    left = {r.doc_id: r.text for r in substring.without_repeats(frame).collect()}
    assert left[0] == rows[0][1] and all(left[i] == t for i, t, *_ in clean)
    assert all(" ".join(passage[5:25]) not in left.get(k, "") for k in range(1, 200))


def test_partners_that_fail_do_not_close_a_stretch(spark):
    rng = np.random.default_rng(21)
    fresh = lambda n: [f"p{x}" for x in rng.integers(0, 10**9, n)]
    passage, rows = fresh(50), []
    for k in range(40):  # each has 49 of the words, too few for a passage
        rows.append((k, [*fresh(60), *passage[k % 2 : 49 + k % 2], *fresh(60)]))
    rows += [(100, [*fresh(60), *passage, *fresh(60)]), (200, [*fresh(60), *passage, *fresh(60)])]
    frame = spark.createDataFrame([(k, " ".join(w), None, None, None) for k, w in rows], DOCUMENT)
    assert {(r.doc_id, r.match_doc_id) for r in substring.repeated_passages(frame).collect()} == {(200, 100)}


def test_near_copies_are_found(spark):
    """Pairs of passages with 0.75 to 0.9 in common, among documents that share 14 to 35 of their words."""
    rng = np.random.default_rng(31)
    fresh = lambda n: [f"n{x}" for x in rng.integers(0, 10**9, n)]
    rows, wanted, same = [], [], lambda x, y: len(x & y) / len(x | y)
    for k in range(60):
        base, copy = fresh(int(rng.integers(55, 90))), None
        while copy is None or not 0.75 <= same(shingles(" ".join(base)), shingles(" ".join(copy))) <= 0.9:
            copy = [f"e{rng.integers(10**9)}" if rng.random() < 0.035 else w for w in base]
        for j in range(30):  # others with part of the passage, some before and some after the pair
            n = int(rng.integers(14, 36))
            at = int(rng.integers(0, len(base) - n + 1))
            rows.append((10_000 * (j % 2 * 2) + 100 * k + j, [*fresh(40), *base[at : at + n], *fresh(40)]))
        rows += [(10_000 + 2 * k, [*fresh(30), *base, *fresh(30)]), (10_001 + 2 * k, [*fresh(30), *copy, *fresh(30)])]
        wanted.append((10_001 + 2 * k, 10_000 + 2 * k))
    frame = spark.createDataFrame([(i, " ".join(w), None, None, None) for i, w in rows], DOCUMENT).repartition(4)
    for config in (substring.SubstringConfig(), substring.SubstringConfig(common=8, batch_docs=200)):
        found = {(r.doc_id, r.match_doc_id) for r in substring.repeated_passages(frame, config).collect()}
        assert sum(pair in found for pair in wanted) >= 0.95 * len(wanted)
        assert {d for d, _ in found} <= {d for d, _ in wanted}


def test_copies_round_a_run_that_very_many_share():
    """Exact copies of 50 to 55 words, of which 1,500 others have 38 to 45: joined in one batch and between batches."""
    import pyarrow as pa

    config = substring.SubstringConfig()
    for seed, run, left in ((1, 40, 5), (2, 38, 7), (3, 45, 5), (4, 40, 8)):
        rng = np.random.default_rng(seed)
        fresh = lambda n: [f"s{x}" for x in rng.integers(0, 10**9, n)]  # noqa: E731, B023
        shared = fresh(run)
        rows = [(1000 + k, [*fresh(int(rng.integers(20, 60))), *shared, *fresh(int(rng.integers(20, 60)))]) for k in range(1500)]
        for k in range(40):
            passage = [*fresh(left), *shared, *fresh(max(5, 50 - run - left))]
            rows += [(k, [*fresh(30), *passage, *fresh(30)]), (10_000 + k, [*fresh(25), *passage, *fresh(35)])]
        rng.shuffle(rows)
        batch = pa.RecordBatch.from_arrays([pa.array([int(i) for i, _ in rows]), pa.array([" ".join(w) for _, w in rows])], names=["doc_id", "text"])
        for size in (len(rows), 800, 50):  # one batch, two, and 32 that each hold few of the others
            parts = [substring._batch_windows(batch.slice(k, size), config) for k in range(0, len(rows), size)]
            link = [substring._links(np.concatenate([substring._dealt(p, config) for p in parts]), config), *(substring._links(p, config) for p in parts)]
            pairs = {p for x in link for p in zip(x["later"].tolist(), x["earlier"].tolist(), strict=True)}
            assert sum((10_000 + k, k) in pairs for k in range(40)) >= 39
            assert len(pairs) < 80 * len(rows)  # not all pairs: that would be over a million


def test_documents_round_a_run_that_many_share(spark):
    rng = np.random.default_rng(41)
    fresh = lambda n: [f"t{x}" for x in rng.integers(0, 10**9, n)]
    shared = fresh(40)
    rows = [(1000 + k, [*fresh(30), *shared, *fresh(30)]) for k in range(300)]
    for k in range(30):
        passage = [*fresh(5), *shared, *fresh(5)]
        rows += [(k, [*fresh(30), *passage, *fresh(30)]), (10_000 + k, [*fresh(25), *passage, *fresh(35)])]
    frame = spark.createDataFrame([(i, " ".join(w), None, None, None) for i, w in rows], DOCUMENT).repartition(4)
    found = {(r.doc_id, r.match_doc_id) for r in substring.repeated_passages(frame).collect()}
    assert found == {(10_000 + k, k) for k in range(30)}


def test_repeats_under_one_id(spark):
    rng = np.random.default_rng(12)
    fresh = lambda n: [f"r{x}" for x in rng.integers(0, 10**9, n)]
    passage, short, other = fresh(60), fresh(3), fresh(130)
    rows = [(1, [*fresh(40), *passage]), (2, [*fresh(100), *passage, "tail"]), (2, short), (2, other)]
    frame = spark.createDataFrame([(i, " ".join(w), None, None, None) for i, w in rows], DOCUMENT)
    frame = frame.withColumns({k: F.lit(v) for k, v in {"__spans": 1, "__id": 2, "spans": 3, "span_doc_id": 4, "SPAN_HASH": 5, "own_hash": 6}.items()})
    left = substring.without_repeats(frame)
    assert left.columns == frame.columns
    texts = sorted(r.text for r in left.collect())
    assert texts == sorted([" ".join(rows[0][1]), " ".join([*rows[1][1][:100], "tail"]), " ".join(short), " ".join(other)])
    assert [(r.doc_id, r.match_doc_id, r.start, r.end) for r in substring.repeated_passages(frame).collect()] == [(2, 1, 100, 160)]


def test_passages_go_on_over_long_gaps():
    config, rng = substring.SubstringConfig(), np.random.default_rng(4)
    for half, gap in ((36, 17), (36, 20), (120, 76)):  # tokens: similarity 0.75 or more, gaps of over 16
        tokens = rng.integers(0, 2**60, 2 * half + gap, dtype=np.uint64)
        short, full = np.delete(tokens, slice(half, half + gap)), tokens
        for later, earlier, e in ((short, full, 2 * half), (full, short, 2 * half + gap)):
            ((s, t, *_, similarity),) = substring.passages(later, substring.Places(earlier), [(5 << 32) | 5], config)
            assert (s, t) == (0, e + 4) and similarity == 2 * half / (2 * half + gap)


def test_windows_are_those_of_the_cartesian_tree():
    rng = np.random.default_rng(6)
    tokens, width = rng.integers(0, 2**60, 80, dtype=np.uint64), 7
    doc = np.repeat([0, 1], [50, 30])
    got = {tuple(x) for x in zip(*(a.tolist() for a in substring.compact_windows(tokens, doc, 1, width)))}
    h = substring.W.mix(tokens ^ np.uint64(0xD6E8FEB86659FD93 * 2 % (1 << 64)))
    want = set()
    for low, high in ((0, 50), (50, 80)):
        for c in range(low, high):
            left, right = c, c
            while left > low and h[left - 1] > h[c]:
                left -= 1
            while right < high - 1 and h[right + 1] > h[c]:
                right += 1
            if right - left + 1 >= width:
                want.add((c, max(left, c - width + 1), min(right, c + width - 1)))
    assert got == want


def test_repeats_in_odd_rows(odd, none):
    assert {(r.doc_id, r.match_doc_id) for r in substring.repeated_passages(odd).collect()} == {(9, 8)}
    left = substring.without_repeats(odd)
    assert left.columns == odd.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    assert {r.text for r in left.where("doc_id = 9").collect()} == {"end"} or left.where("doc_id = 9").first().n_chars < 100
    assert substring.repeated_passages(none).count() == 0 and substring.without_repeats(none).count() == 0


# --- 7: language-model scores ---------------------------------------------------------------------------------------


def test_base_scores_by_brute_force(docs):
    got = {r.doc_id: r for r in lm.score_texts(docs).collect()}
    rows = {r.doc_id: [*words(r.text), 0] for r in docs.collect()}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in rows}
    counts = Counter(w for i, ws in rows.items() if not out[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in rows.items():
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (out[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert got[i].base_score == pytest.approx(base, abs=1e-6) and -30 * len(ws) < got[i].score < 0
    size = {r.doc_id: max(1, len((r.text or "").encode())) for r in docs.collect()}
    assert all(r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / size[i]) for i, r in got.items())


def test_scores_of_known_words(spark):
    """No known word is less likely than its discounted share, and equal texts have equal scores."""
    config = lm.LmConfig(slots=(12, 12, 12, 12, 12), discounts=(0.5,), urns=(100.0,), slice_bits=10, run_tokens=40)
    texts = [f"the cat {a} on the {b}. {a} is" for a in ("sat", "lay", "slept", "stood") for b in ("mat", "bed", "hat")] * 2
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCUMENT)
    got = {r.doc_id: r for r in lm.score_texts(frame, config).collect()}
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for t in train for w in [*words(t), ""])
    n = sum(counts.values())
    for i, r in got.items():
        own = [*words(texts[i]), ""]
        assert r.n_tokens == len(own) and r.train_tokens == n
        known = [max(counts[w] - 0.5, 0) / n for w in own]
        least = sum(math.log10(k) for k in known)
        assert r.score > least - math.log10(3) and r.score < 0
    assert all(got[i].score == pytest.approx(got[j].score) for i in got for j in got if texts[i] == texts[j])


def test_spelling_probabilities_add_up_to_one():
    config = lm.LmConfig(slots=(10, 10, 10, 10, 12))
    rng = np.random.default_rng(0)
    tables = [rng.integers(0, 50, 2 << s).astype(np.float32) for s in config.slots]
    mixer = lm.Mixer(tables, config)
    every = [bytes([b]) for b in range(256) if b != 32] + [b""]
    lexicon = lm.Lexicon(np.arange(256, dtype=np.uint64), np.zeros(256, np.int64), np.array([len(w) for w in every], np.uint32), np.frombuffer(b"".join(every), np.uint8))
    first = [list(lm.Spelling(lexicon.part(k, k + 1), config).bits()) for k in range(256)]
    total = 0.0
    for steps in first:  # the first byte's eight bits of each word
        p = 1.0
        for _, bit, slots in steps:
            x, gate = mixer.inputs(bit[:1], [s[:1] for s in slots], None)
            q = 1 / (1 + np.exp(-mixer.mix(x, gate)[0]))
            p *= q if bit[0] else 1 - q
        total += p
    assert total == pytest.approx(1)


def test_urn_is_a_product_of_steps():
    chance, times, strength = np.array([0.2, 0.05]), np.array([3, 2]), 10.0
    got = lm.document_scores(np.array([0, 1]), times, np.array([2]), np.array([0, 0]), np.log10(chance), 0, 0, (0.5,), (strength,))["score"][0]
    steps, had = 0.0, Counter()
    for t, w in enumerate([0, 1, 0, 0, 1]):
        steps += math.log10((strength * chance[w] + had[w]) / (strength + t))
        had[w] += 1
    plain = float((times * np.log10(chance)).sum())
    assert got == pytest.approx(math.log10((2 * 10**plain + 10**steps) / 3))


def test_scores_of_odd_rows(odd, none):
    got = lm.score_texts(odd).collect()
    assert Counter(r.n_tokens for r in got if r.doc_id in (2, 3, 4)) == {1: 3}
    assert len(got) == odd.count() and all(np.isfinite(r.score) for r in got)
    assert lm.score_texts(none).count() == 0


# --- 10 and 4: language and quality -----------------------------------------------------------------------------------


def test_language_held_out(docs):
    got = langid.language_report(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95


def test_phrases_by_brute_force():
    learnt = ["banana", "bandit"]
    parser = langid.CrossParser(learnt)
    inside = {x[i:j] for w in learnt for x in [f" {w} "] for i in range(len(x)) for j in range(i + 1, len(x) + 1)}

    def count(text):
        n = 0.0
        while text:
            k = max((j for j in range(1, len(text) + 1) if text[:j] in inside), default=0)
            n += 1.0 if k else 1.5
            text = text[max(k, 1) :]
        return n

    for w in ("banana", "bananadit", "nana", "xyz", "bxn", "a", "ditban"):
        assert parser.phrases(w) == count(f" {w} ")


def test_every_label_is_learnt(spark):
    """As many labels as documents hold: the rarest are told too."""
    rows = [(k, " ".join(f"{chr(0x100 + k)}{chr(0x300 + k % 90 + 0x100)}{c}" for c in "abcdefg"), f"l{k:03d}", "s", 1) for k in range(300)]
    docs = spark.createDataFrame(rows, DOCUMENT)
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, docs, ["doc_id"]).select("row.doc_id", "lang_pred").collect()}
    assert got == {k: f"l{k:03d}" for k in range(300)}
    few = langid.learn_sample(docs, langid.LangIdConfig(all_words=600))
    assert len(few) == 300 and {len(w) for w in few.values()} == {2}


def test_language_of_odd_rows(odd, none):
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.language_report(odd).collect()}
    assert got[2] == got[3] == got[4] == ("und", 0.0) and got[1][0] == "en"
    left = langid.with_language(odd)
    assert left.columns == odd.columns and {r.doc_id for r in left.collect()} >= {1, 6, 11, None}
    assert langid.language_report(none).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, none, ["doc_id"]).collect()} == {"und"}


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.quality_report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 1), (6, 0), (7, 0), (8, 1), (None, 1), (9, None)], "doc_id long, quality int")
    got = quality.quality_report(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.quality_report(none, labels).count() == 0
    assert len(quality.quality_report(odd, labels.limit(0)).collect()) == odd.count()


# --- 2: main text ---------------------------------------------------------------------------------------------------------


def test_articles_of_the_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    import html as entities

    for r in html.extract(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(x for x in blocks if x) and r.n_chars == len(r.text)


PAGE = """<html><body><header class="site-header"><p>The site of all sites</p></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div id="cookie-notice"><p>We use cookies, as everyone does, to tell you apart.</p></div>
<main><article><h1>Caf&eacute;  news</h1><p>First&nbsp;paragraph, with a <a href=x>link</a> and &lt;signs&gt;.<p>Second   one
goes on.<script>var x = "<p>not this</p>";</script><ul><li>item one<li>item two</ul><!-- <p>nor this</p> --><style>p{}</style></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>What a fine paper this is, I say, truly.</p></div></section></main>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=/c>Other</a></li></ul></aside><form><label>Mail</label><input><button>Subscribe</button></form>
<footer><p>&copy; All rights reserved by the owners of it.</p></footer></body></html>"""


def test_a_page_of_all_parts(spark):
    rows = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (1, "u", PAGE), (4, "u", "<p"), (None, "u", "</div></p><b>"), (5, "u", "<div>" * 3000)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in html.extract(rows).collect())
    want = "Café news\nFirst paragraph, with a link and <signs>.\nSecond one goes on.\nitem one\nitem two"
    assert got[1, "u", want, len(want)] == 2 and got[2, None, "", 0] == 1 and got[3, "u", "", 0] == 1 and sum(got.values()) == 7
    assert html.extract(rows.limit(0)).count() == 0


def test_like_siblings_are_counted_on_long_pages():
    page = html.Page("<div>" + "<h2>t</h2>" * 70 + "<p>a</p>" * 30 + "</div>")
    own = [k for k, x in enumerate(page.nodes) if x.group == page.nodes[-1].group]
    assert len(own) == 30 and {int(html.node_features(page)[k - 1][-2]) for k in own} == {30}


def main_of(source, trees):
    page = html.Page(source)
    return html.main_text(page, trees.odds(html.node_features(page)))


def test_articles_without_paragraphs():
    trees = html.learn_trees()
    say = lambda k: " ".join(f"Word{k}x{j} goes on here," for j in range(9)) + " and ends."
    one, two, three = say(1), say(2), say(3)
    nav, foot = '<nav class="menu"><ul><li><a href="/">Home</a></li><li><a href="/b">News</a></li></ul></nav>', '<footer class="footer"><p>Copyright by us</p></footer>'
    for body in (
        f"<article><h1>A title of it</h1><div>{one}</div><div>{two}</div><div>{three}</div></article>",
        f'<div id="content"><div>{one}</div><div>{two}</div><div>{three}</div></div>',
        f'<div class="post">{one}<br>{two}<br>{three}</div>',
        f"<div><div><section><div>{one}</div></section><section><div>{two}</div></section><section><div>{three}</div></section></div></div>",
        f'<form id="aspnetForm" action="/"><input type="hidden"><div>{one}</div><div>{two}</div><div>{three}</div></form>',
    ):
        text = main_of(f"<html><body>{nav}{body}{foot}</body></html>", trees)
        assert all(t in text for t in (one, two, three)) and "Home" not in text and "Copyright" not in text


@pytest.mark.parametrize("head", ["<p><li>", "<p><ul><li>"])
def test_closing_is_linear(head):
    took = []
    for n in (4_000, 32_000):
        source, begin = head + "<blockquote>" * n, time.process_time()
        html.Page(source)
        took.append(time.process_time() - begin)
    assert took[1] < 20 * took[0] + 0.5


@pytest.mark.parametrize("piece", ['<a href="x>', "<a '", '<p "">', "<ul><li>x</li>", "<div>", "</p>", "<b", "<script>", '<a ""', "<!--", "<li>x", "</section><div>", "<a<"])
def test_parsing_is_linear(piece):
    took = []
    for size in (60_000, 480_000):
        source, begin = piece * (size // len(piece)) + "'>'", time.process_time()
        html.node_features(html.Page(source))
        took.append(time.process_time() - begin)
    assert took[1] < 20 * took[0] + 1.5


def test_decoding_by_enumeration():
    """The kept nodes are the closed set of the largest sum."""
    rng = np.random.default_rng(11)
    for _ in range(40):
        source = "<div>x" + "".join(rng.choice(["<div>a", "</div>", "<p>b</p>", "<ul><li>c</ul>"], 7)) + "</div>"
        page = html.Page(source)
        n = len(page.nodes) - 1
        odds = rng.normal(size=n)
        best = (0.0, frozenset())
        for chosen in itertools.product((False, True), repeat=n):
            kept = frozenset(k + 1 for k, c in enumerate(chosen) if c)
            if all(page.nodes[k].parent == 0 or page.nodes[k].parent in kept for k in kept):
                best = max(best, (sum(odds[k - 1] for k in kept), kept), key=lambda x: x[0])
        assert html.main_text(page, odds) == "\n".join(t for k, t in page.runs if k == 0 or k in best[1])


def test_decoding_keeps_no_node_below_a_dropped_one():
    page = html.Page("<div><p>a</p><div><p>b</p></div></div>")
    assert html.main_text(page, np.array([1.0, 1.0, -5.0, 2.0])) == "a"
    assert html.main_text(page, np.array([1.0, -1.0, -1.0, 2.0])) == "b"


def test_trees_tell_new_pages_apart():
    trees, maker = html.learn_trees(), html.PageMaker(1234)
    right = total = 0
    for _ in range(60):
        source = maker.page()
        marks = np.array([True, *(bool(m[2]) for m in html._MARKED.finditer(source.partition("</head>")[2]) if m[1] in html.TAG_GROUP)])
        odds = trees.odds(html.node_features(html.Page(source)))
        right, total = right + int(((odds > 0) == marks).sum()), total + len(marks)
    assert right / total > 0.98


# --- 6: chat ------------------------------------------------------------------------------------------------------------------


def test_chat_of_odd_rows(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, None, "first"), (1, 70, "ann", "late"), (2, 0, "system", "alone"), (None, 0, "ann", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("chunk", F.lit("x"))
    got = {(r.conv_id, r.speaker, r.chunk): r for r in chat.perspectives(frame).collect()}
    assert {k[:2] for k in got} == {(1, "ann"), (1, "bob"), (1, "unknown")}
    ann_ = [got[1, "ann", c] for c in (-1, 0, 1)]
    assert ann_[0].text == "<|im_start|>user name=unknown\nfirst<|im_end|>\n" and ann_[0].mask == ""
    assert ann_[1].text.startswith("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n") and ann_[1].n_turns == 4
    b, e = map(int, ann_[1].mask.split("-"))
    assert ann_[1].text[b:e] == "hi<|im_end|>\n"
    assert [a.start_char for a in ann_] == [0, *itertools.accumulate(len(a.text) for a in ann_[:2])]
    assert chat.perspectives(frame.limit(0)).count() == 0


def test_turns_of_one_number_come_in_parts(spark):
    rows = [(1, None if k % 2 else 3, "ann" if k % 3 else "bob", f"t{k:03d}") for k in range(300)]
    got = chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.chunk, r.part, r.n_turns) for r in got} == {(c, p, 64 if p < 2 else 22) for c in (-1, 0) for p in range(3)}
    for speaker in ("ann", "bob"):
        own = sorted((r for r in got if r.speaker == speaker), key=lambda r: (r.chunk, r.part))
        whole = "".join(r.text for r in own)
        assert [r.start_char for r in own] == [0, *itertools.accumulate(len(r.text) for r in own[:-1])]
        order = sorted(rows, key=lambda r: (r[1] is not None, r[2], r[3]))
        assert re.findall(r"t\d{3}", whole) == [r[3] for r in order]
        learnt = [r.text[b:e] for r in own for b, e in (map(int, m.split("-")) for m in r.mask.split(",") if m)]
        assert learnt == [r[3] + "<|im_end|>\n" for r in order if r[2] == speaker]


# --- all together ---------------------------------------------------------------------------------------------------------------


def test_pipeline_by_its_parts(spark, sf, docs, tokenizer):
    import corpus_pipeline

    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_dedup", "substring_dedup", "decontamination", "packing"]
    now, steps = docs, {}
    keep = Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = steps[name] = keep.write(stage(spark, now, sf), name)
        assert now.columns == docs.columns
    rows = {n: {r.doc_id: r.text for r in f.collect()} for n, f in steps.items()}
    assert set(rows["language"]) == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    parts = linked(list(rows["language"].items()))
    assert set(rows["near_dedup"]) == {i for i, (_, c) in parts.items() if i == c}
    assert all(len(words(t)) <= len(words(rows["near_dedup"][i])) for i, t in rows["substring_dedup"].items())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(rows["decontamination"]) == {x[0] for x in contaminated(list(rows["substring_dedup"].items()), items) if not x[5]}
    got = {(r.doc_id, r.start, r.length, r.doc_tokens) for r in corpus_pipeline.run(spark, sf).collect()}
    ends = {i: n for i, s, k, n in got if s + k == n}
    assert ends == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows["decontamination"].items()}


def test_pipeline_of_odd_rows(spark, sf, odd, none):
    """Clashing names, repeated ids, nulls and nothing at all go through every stage."""
    import corpus_pipeline

    names = {**CLASH, "__gone": 1, "__spans": 2, "__id": 3, "lang_pred": "x", "number": 4, "first": 5, "cut": "c", "row": 6}
    taken = spark.createDataFrame([(1, "another text", "en", "s", 12), (1, "a b c d e f g h", "de", "s", 15), (None, "x", None, None, None)], DOCUMENT)
    for start in (odd.select("doc_id", "text", "lang", "source", "n_chars").unionAll(taken).withColumns({k: F.lit(v) for k, v in names.items()}), none):
        now, keep = start, Scratch(spark, "test")
        for name, stage in corpus_pipeline.Corpus().stages()[:-1]:
            now = keep.write(stage(spark, now, sf), name)
            assert now.columns == start.columns
            if name == "near_dedup" and start is not none:
                got = Counter((r.doc_id, r.text) for r in now.collect())
                assert got[1, "another text"] == 1 and got[1, "a b c d e f g"] == 1 and got[5, "A B C D E F G"] == 0
        packed = corpus_pipeline.STAGES[-1][1](spark, now, sf)
        assert (packed.count() > 0) == (start is not none)


def test_runs_leave_each_others_tables_alone(spark, sf, docs):
    import corpus_pipeline

    waiting = neardup.near_duplicates(docs)
    one, other = corpus_pipeline.Corpus(), corpus_pipeline.Corpus()
    held = one.near_dedup(spark, docs, sf)
    other.near_dedup(spark, docs, sf).count()
    other.packing(spark, docs, sf)
    assert waiting.count() == docs.count() and held.count() <= docs.count()


def test_shared_folder_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_shards_of_the_vocabulary_go_by_bytes(spark, monkeypatch):
    """One split with much text still has many shards, so that the words of one stay few."""
    from geoaudit.llm import lm

    asked, known = [], lm._requests
    monkeypatch.setattr(lm, "_requests", lambda docs, shards, config: asked.append(shards) or known(docs, shards, config))
    docs = spark.range(50).coalesce(1).selectExpr("id doc_id", "repeat('some words ', 10) text")
    assert lm.score_texts(docs, lm.LmConfig(shard_bytes=100)).count() == 50
    assert asked == [55]

"""Vector codes, the mixing of sources and the Merkle manifest: against plain Python, and on odd tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoaudit.llm import codes, merkle, mixing

CLASH = {"leaf": "x", "rank": 1, "node": 2, "code": "b", "error": 3, "spread": 4, "size": 5, "copies": 6, "of": 7, "at": 8, "path": "p", "part": 9, "label_error": 0}
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty values in all columns, repeated rows and ids, a very long text, clashing columns."""
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (1, "d e f", "en", "s", 5), (2, None, None, None, None), (None, "x y", "de", "t", 3), (None, "x y", "de", "t", 3), (7, "", "", "", 0), (-5, long, "en", "s", 9), (8, " \t\n", None, "日本", 1), (9, "ß é 日本", "zz", None, None), (10, "one", "en", "s", 3)]
    frame = spark.createDataFrame(rows, DOCUMENT)
    return frame.withColumns({k: F.lit(v) for k, v in CLASH.items()})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCUMENT)


# --- 11: vector codes ---------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-4, 4), st.integers(-4, 4), st.integers(-2, 2)), min_size=1, max_size=40), st.lists(st.tuples(*[st.integers(-6, 6)] * 3), min_size=1, max_size=40), st.integers(1, 5))
def test_trees_find_the_nearest_and_lowest(entries, rows, leaf):
    entries, rows = np.array(entries), np.array(rows)
    away = ((rows[:, None, :] - entries[None]) ** 2).sum(axis=2)
    index, best = codes.KdTree(entries, leaf).nearest(rows)
    assert index.tolist() == away.argmin(axis=1).tolist() and best.tolist() == away.min(axis=1).tolist()


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """Kept rows with codes and errors, and the codebooks, row by row."""
    kept = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, label, v) for i, label, v in kept if len(v) == len(min(kept, key=lambda r: (r[0] is None, r[0] or 0, len(r[2])))[2])]
    cut = [k * len(kept[0][2]) // parts for k in range(parts + 1)]
    first = {}
    for i, _, v in kept:
        first[i] = min(first.get(i, v), v)
    ids = sorted(first, key=lambda i: (i is None, i or 0))[:entries]
    books = [[first[i][a:b] for i in ids] for a, b in zip(cut, cut[1:])]

    def nearest(book, x):
        return min((sum((p - q) ** 2 for p, q in zip(e, x)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(zip(cut, cut[1:])):
            held = defaultdict(list)
            for _, _, v in kept:
                held[nearest(books[p], v[a:b])[1]].append(v[a:b])
            books[p] = [[sum(c) // len(held[k]) for c in zip(*held[k])] if k in held else e for k, e in enumerate(books[p])]
    out, errors = [], Counter()
    for i, label, v in kept:
        found = [nearest(book, v[a:b]) for book, a, b in zip(books, cut, cut[1:])]
        error = sum(d for d, _ in found)
        errors[label] += error
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), error))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, code, error, errors[label], digest) for i, label, code, error in out]


VECTORS = "vec_id long, embedding array<float>, label int"
ORDER = lambda r: (r[0] is None, r[0] or 0, r[1:])


def reported(frame):
    return sorted((tuple(r) for r in codes.code_report(frame).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=ORDER)


def test_codes_by_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in v], int(k) if k < 3 else None) for i, v, k in zip(rng.permutation(300), rng.normal(size=(300, 32)).round(1) / 3, rng.integers(0, 5, 300))]
    frame = spark.createDataFrame(rows, VECTORS)
    want = sorted(brute_codes(rows), key=ORDER)
    assert reported(frame) == want
    assert reported(frame.repartition(7)) == want  # whatever the layout
    found = codes.coded(frame)
    back = {r.vec_id: r.embedding for r in found.decoded().collect()}
    assert max(sum((256 * x - math.floor(256 * y)) ** 2 for x, y in zip(back[i], v)) for i, v, _ in rows) == max(w[2] for w in want)


def test_codes_of_odd_vectors(spark):
    v, nan, inf = [0.1, -0.2, 0.3, 0.4] * 4, float("nan"), float("inf")
    rows = [(3, v, 1), (3, v, 1), (3, [-x for x in v], None), (None, v, None), (4, None, 1), (5, [None, *v[1:]], 1), (6, [nan, *v[1:]], 1), (7, [inf, *v[1:]], 2), (8, v[:5], 2), (9, [], 2), (1, [0.0] * 16, 7), (11, [x * 2 for x in v], 7)]
    frame = spark.createDataFrame(rows, VECTORS).withColumns({k: F.lit(x) for k, x in CLASH.items() if k not in ("error",)})
    assert reported(frame) == sorted(brute_codes(rows), key=ORDER)
    assert len(reported(frame)) == 6
    assert codes.code_report(frame.limit(0)).count() == 0
    assert codes.code_report(frame.where("vec_id in (4, 6)")).count() == 0
    short = spark.createDataFrame([(k, [float(k), 1.0, -1.0], 0) for k in range(5)], VECTORS)  # fewer components than parts
    assert [r[2] for r in reported(short)] == [0] * 5
    huge = spark.createDataFrame([(k, [3e38 * (-1) ** k] * 16, 0) for k in range(3)], VECTORS)
    assert [r.error for r in codes.code_report(huge).collect()] == [0] * 3


# --- 12: mixing ---------------------------------------------------------------------------------------


def brute_targets(sizes):
    """Targets by sharing what is over again and again, until none is above twice its size."""
    weights = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be"))))}
    targets, free, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while free:
        share = left / sum(weights[s] for s in free)
        over = {s for s in free if share * weights[s] > 2 * sizes[s]}
        if not over:
            return targets | {s: share * weights[s] for s in free}
        targets |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return targets


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.sampled_from([None, "", "a", "b", "Z", "é", "日", "src1", "src10", "src2"]), st.integers(0, 400), min_size=1))
def test_targets_by_sharing_again(spark, sizes):
    rows = [(1, s, n, 1) for s, n in sizes.items()]
    got = mixing.targets(spark.createDataFrame(rows, "doc_id long, source string, size long, copies long")).collect()
    want = brute_targets(sizes)
    assert {r.source: r.target for r in got} == pytest.approx(want)
    assert all(abs(r.quota - r.target) <= 0.5 and r.quota <= 2 * r.source_size for r in got)


def test_hypergeometric_draws_have_their_chances(spark):
    for pool, hits, draws in ((20, 7, 9), (10, 9, 5), (50, 25, 3), (6, 6, 2), (6, 0, 2), (5, 2, 5), (5, 2, 0)):
        chances = {x: math.comb(hits, x) * math.comb(pool - hits, draws - x) / math.comb(pool, draws) for x in range(max(0, draws - pool + hits), min(hits, draws) + 1)}
        n = 20_000
        args = (F.lit(x).cast("long") for x in (pool, hits, draws))
        got = spark.range(n).select(mixing.hypergeometric(*args, (F.col("id") + 0.5) / n).alias("x")).groupBy("x").count().collect()
        # Evenly spread uniform numbers give each value its share, but for the two ends of its stretch.
        assert {r.x: r["count"] / n for r in got} == pytest.approx({x: c for x, c in chances.items() if c > 1 / n}, abs=2 / n)


def test_large_hypergeometric_draws(spark):
    pool, hits, draws = 10**9, 3 * 10**8, 10**6
    u = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53))
    got = [r.x for r in spark.range(0, 200, 1, 4).select(mixing.hypergeometric(*(F.lit(x).cast("long") for x in (pool, hits, draws)), u).alias("x")).collect()]
    spread = math.sqrt(draws * 0.3 * 0.7)
    assert abs(np.mean(got) - 0.3 * draws) < 5 * spread / math.sqrt(200) and 0.8 < np.std(got) / spread < 1.2


@pytest.mark.parametrize("n_shards", [1, 2, 7, 100])
def test_splitting_keeps_quotas_and_evens_shards(spark, n_shards):
    quotas = {0: 5000, 3: 1, 4: 777, 9: 60}
    rows = mixing.splitting_tree(spark, spark.createDataFrame(list(quotas.items()), "rank int, n long"), n_shards).collect()
    by_source, by_shard = Counter(), Counter()
    for r in rows:
        by_source[r["rank"]] += r.n
        by_shard[r.shard] += r.n
    assert by_source == quotas and len(by_shard) == n_shards
    assert max(by_shard.values()) - min(by_shard.values()) <= 1
    expected = 5000 / n_shards
    spread = math.sqrt(expected * (1 - 5000 / sum(quotas.values())) + 1)
    assert all(abs(r.n - expected) < 6 * spread for r in rows if r["rank"] == 0)


def test_mix_draws_disjoint_blocks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mix, sizes, plan = mixing.mixed(docs, mixing.MixConfig(block_words=64, shard_words=5000, least_shards=4))
    blocks, words = mix.collect(), {r["rank"]: r.quota for r in plan.collect()}
    known = {r.doc_id: r.size for r in sizes.collect()}
    assert all(known[i] == len(re.findall(mixing.WORD, t or "")) for i, t in docs.select("doc_id", "text").collect())
    taken, places, shards = Counter(), set(), defaultdict(list)
    for r in blocks:
        key = (r.doc_id, r["pass"], r.start)
        assert key not in places and 0 < r.words <= min(64, known[r.doc_id] - r.start) and r.start % 64 == 0
        places.add(key)
        taken[r["rank"]] += r.words
        shards[r.shard].append(r.offset)
    assert taken == {k: v for k, v in words.items() if v}
    assert all(sorted(x) == list(range(len(x))) for x in shards.values()) and len(shards) == -(-sum(words.values()) // 5000)
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    again = mixing.mixed(docs.repartition(5), mixing.MixConfig(block_words=64, shard_words=5000, least_shards=4))[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, blocks))


def test_mix_of_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in mixing.mix_report(odd).collect()]
    assert len(rows) == 11 and mixing.mix_report(none).count() == 0
    sizes = Counter()
    for r in odd.select("source", "text").collect():
        sizes[r.source] += len(re.findall(mixing.WORD, r.text or ""))
    want, by_size = brute_targets(sizes), Counter()
    for i, size, source_size, target, taken in rows:
        assert 0 <= taken <= 2 * size and source_size in sizes.values()
        by_size[source_size, target] += taken
    assert all(any(abs(t - target) < 1e-6 for t in want.values()) for _, target in by_size)
    assert all(abs(taken - target) <= 0.5 or list(sizes.values()).count(s) > 1 for (s, target), taken in by_size.items())
    empty = odd.withColumn("text", F.lit(None).cast("string"))
    assert [(r.size, r.target, r.taken) for r in mixing.mix_report(empty).collect()] == [(0, 0.0, 0)] * 11


def test_mixing_stays_in_the_jvm(spark, sf):
    frame = mixing.mix_report(spark.read.parquet(f"{sf}/documents.parquet"))
    plan = frame._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- 13: Merkle manifest ------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """Rows of a manifest, from a tree in one list after another. ``rows``: doc_id, source, lang, n_chars, text."""

    def leaf(row):
        return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))

    def grow(nodes):
        levels = [nodes]
        while len(nodes) > 1:
            nodes = [sha(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
            levels.append(nodes)
        return levels

    def way(levels, at):
        for nodes in levels[:-1]:
            yield (at ^ 1) < at, nodes[at ^ 1] if (at ^ 1) < len(nodes) else None
            at //= 2

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: grow([leaf(r) for r in groups[g]]) for g in order}
    top = grow([trees[g][-1][0] for g in order])
    root, out = top[-1][0], []
    for k, g in enumerate(order):
        for at, r in enumerate(groups[g]):
            path = [*way(trees[g], at), *way(top, k)]
            tampered = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf((*r[:3], r[3] + 1, r[4])) if tampered else leaf(r)
            for left, other in path:
                node = sha(*((other, node) if left and other else (node, other or "")))
            out.append((r[0], leaf(r), trees[g][-1][0], root, sha(*(o or "" for _, o in path)), node, node == root))
    return out


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
KEY = lambda r: (r[0] is not None, r[0] or 0, r[1:])


def manifested(frame, climb=8):
    return sorted((tuple(r) for r in merkle.manifest(frame, merkle.MerkleConfig(climb=climb)).collect()), key=KEY)


@pytest.mark.parametrize("climb", [1, 2, 8])
def test_manifest_by_brute_force(spark, climb):
    """Groups of one leaf to many, over one height and over several, and many groups."""
    sizes = [1, 2, 3, 4, 5, 8, 9, 17, 33, 100, *[1] * 9]
    rows, n = [], 0
    for k, size in enumerate(sizes):
        for _ in range(size):
            rows.append(((n * 7919) % 1009, f"s{n % 3}", None if k == 3 else f"l{k:02d}é", n if n % 5 else None, f"text {n} ß"))
            n += 1
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    got = manifested(frame, climb)
    assert got == sorted(brute_manifest(rows), key=KEY)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in odd.select(FIELDS).collect()]
    assert manifested(odd) == sorted(brute_manifest(rows), key=KEY)
    assert manifested(none) == []
    one = odd.where("doc_id = 10")
    (row,) = manifested(one)
    assert row[1] == row[2] == row[3] and row[4] == sha() and row[6]


def test_any_change_shows(spark, odd):
    base = manifested(odd)[0][3]
    for column, value in (("text", "?"), ("source", "?"), ("lang", "?"), ("n_chars", 77), ("doc_id", 77)):
        changed = odd.withColumn(column, F.when(F.col("doc_id") == 10, F.lit(value)).otherwise(F.col(column)))
        assert manifested(changed)[0][3] != base

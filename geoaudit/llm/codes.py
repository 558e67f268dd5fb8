"""Vectors as short codes: each part of a vector as the number of the nearest entry of that part's codebook.

All arithmetic is on whole numbers, so that sums do not depend on the order or the layout of the rows. Codebooks
are of a fixed size. Each round broadcasts them, a kd-tree for each part; tasks search every part's nearest entry
and add up the parts of each entry, and those sums, a fixed number for each task, are added in one shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .process import bounded_batches
from .scratch import Scratch

_FAR = np.iinfo(np.int64).max


@dataclass(frozen=True)
class CodeConfig:
    """Parts of a vector, entries of a codebook (256 at most), rounds, steps to one, and entries in a leaf of a tree."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256
    leaf: int = 8


class KdTree:
    """The entries of one codebook, split at the median of the widest side, with the box of each node."""

    def __init__(self, entries: np.ndarray, leaf: int):
        self.entries = entries
        #: Each node: its box, its own entries (leaves), and for others the side, the value that still goes left, and its two sons.
        self.nodes: list[tuple] = []
        self._grow(np.arange(len(entries)), leaf)

    def _grow(self, ids: np.ndarray, leaf: int) -> int:
        own, at = self.entries[ids], len(self.nodes)
        low, high = own.min(axis=0), own.max(axis=0)
        self.nodes.append(())
        if len(ids) <= leaf or not own.shape[1]:
            self.nodes[at] = (low, high, ids, None)
            return at
        side = int((high - low).argmax())
        order = ids[np.argsort(own[:, side], kind="stable")]
        half = len(ids) // 2
        left, right = self._grow(np.sort(order[:half]), leaf), self._grow(np.sort(order[half:]), leaf)
        self.nodes[at] = (low, high, None, (side, self.entries[order[half - 1], side], left, right))
        return at

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row; of equally near ones the lowest index."""
        best, index = np.full(len(x), _FAR), np.full(len(x), len(self.entries))
        self._descend(0, np.arange(len(x)), x, best, index)
        self._search(0, np.arange(len(x)), x, best, index)
        return index, best

    def _compare(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        away = x[rows][:, None, :] - self.entries[ids][None, :, :]
        away = np.einsum("ned,ned->ne", away, away)
        first = away.argmin(axis=1)
        d, i = away[np.arange(len(rows)), first], ids[first]
        closer = (d < best[rows]) | ((d == best[rows]) & (i < index[rows]))
        best[rows[closer]], index[rows[closer]] = d[closer], i[closer]

    def _descend(self, node: int, rows: np.ndarray, x: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        """First the leaf that a row falls into, for a bound to begin with."""
        if not len(rows):
            return
        _, _, ids, split = self.nodes[node]
        if split is None:
            self._compare(ids, rows, x, best, index)
            return
        side, value, left, right = split
        goes = x[rows, side] <= value
        self._descend(left, rows[goes], x, best, index)
        self._descend(right, rows[~goes], x, best, index)

    def _search(self, node: int, rows: np.ndarray, x: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        """Then every node whose box is no farther than the best: as far is enough, for a lower index may be in it."""
        low, high, ids, split = self.nodes[node]
        own = x[rows]
        out = np.maximum(low - own, 0) + np.maximum(own - high, 0)
        rows = rows[np.einsum("nd,nd->n", out, out) <= best[rows]]
        if not len(rows):
            return
        if split is None:
            self._compare(ids, rows, x, best, index)
            return
        self._search(split[2], rows, x, best, index)
        self._search(split[3], rows, x, best, index)


def cuts(length: int, parts: int) -> list[int]:
    """Where the parts of a vector begin, and its end."""
    return [k * length // parts for k in range(parts + 1)]


def most(length: int) -> int:
    """The largest size of a component: squared distances of whole vectors stay within 63 bits."""
    return int(((2**63 - 1) / max(length, 1)) ** 0.5 / 2)


def whole(vectors: pa.Array, length: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of a length that have all components, finite, and those as whole numbers."""
    if not len(vectors):
        return np.zeros(0, np.int64), np.zeros((0, length), np.int64)
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == length)
    flat = vectors.take(pa.array(rows)).flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(rows), length)
    there = np.isfinite(values).all(axis=1)
    limit = most(length)
    with np.errstate(over="ignore"):
        return rows[there], np.clip(np.floor(values[there] * scale), -limit, limit).astype(np.int64)


def _seeds(vectors: DataFrame, config: CodeConfig, scratch: Scratch) -> np.ndarray:
    """The first entries: the kept vectors of the lowest vec_ids, of a repeated one the smallest."""

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each length of vectors that a task meets, those of its lowest ids; a null id comes last."""
        known: dict[int, dict[tuple[bool, int], list[int]]] = {}
        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), batch.column(1)
            for length in set(lists.value_lengths().drop_null().to_pylist()):
                own = known.setdefault(length, {})
                rows, values = whole(lists, length, config.scale)
                keys = [(ids[r] is None, ids[r] or 0) for r in rows.tolist()]
                bound = sorted({*own, *keys})[: config.entries][-1:]
                for k, row in zip(keys, values, strict=True):
                    if k <= bound[0]:
                        own[k] = min(own[k], row.tolist()) if k in own else row.tolist()
                known[length] = {k: own[k] for k in sorted(own)[: config.entries]}
        rows = [(length, none, i, v) for length, own in known.items() for (none, i), v in own.items()]
        names = ("length", "none", "vec_id", "v")
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=list(names))

    found = scratch.write(vectors.select("vec_id", "embedding").mapInArrow(lowest, "length long, none boolean, vec_id long, v array<long>"), "seeds")
    first = found.orderBy("none", "vec_id", "length").select("length").limit(1).collect()
    if not first:
        return np.zeros((0, 0), np.int64)
    rows = found.where(F.col("length") == first[0][0]).groupBy("none", "vec_id").agg(F.min("v").alias("v")).orderBy("none", "vec_id").limit(config.entries).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), first[0][0])


def _updated(vectors: DataFrame, books: list[np.ndarray], config: CodeConfig) -> list[np.ndarray]:
    """One round: entries replaced by the floored means of the parts nearest to them; the others stay."""
    length, at = sum(b.shape[1] for b in books), cuts(sum(b.shape[1] for b in books), config.parts)
    trees: Broadcast = vectors.sparkSession.sparkContext.broadcast([KdTree(b, config.leaf) for b in books])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            _, x = whole(batch.column(0), length, config.scale)
            for p, tree in enumerate(trees.value):
                index, _ = tree.nearest(x[:, at[p] : at[p + 1]])
                counts[p] += np.bincount(index, minlength=len(counts[p]))
                np.add.at(totals[p], index, x[:, at[p] : at[p + 1]])
        rows = [(p, e, c, int(n), int(totals[p][e, c])) for p in range(len(books)) for e, n in enumerate(counts[p]) if n for c in range(books[p].shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=["part", "entry", "place", "n", "total"])

    # As many rows as the codebooks have numbers, whatever the table's size.
    found = vectors.select("embedding").mapInArrow(sums, "part long, entry long, place long, n long, total long")
    out = [b.copy() for b in books]
    for r in found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        out[r.part][r.entry, r.place] = r.total // r.n
    trees.unpersist()
    return out


@dataclass(frozen=True)
class Coded:
    """``rows`` (vec_id, label, code, error) and the codebooks that the codes are of, one matrix for each part."""

    rows: DataFrame
    books: list[np.ndarray]

    def decoded(self, scale: int = CodeConfig.scale) -> DataFrame:
        """``vec_id, embedding``: what the codes say of the vectors."""
        books = self.books

        def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = np.array([list(bytes.fromhex(c)) for c in batch.column(1).to_pylist()], np.int64).reshape(batch.num_rows, len(books))
                v = np.concatenate([b[codes[:, p]] for p, b in enumerate(books)], axis=1) / scale
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v.tolist(), pa.list_(pa.float64()))], names=["vec_id", "embedding"])

        return self.rows.select("vec_id", "code").mapInArrow(values, "vec_id long, embedding array<double>")

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()


def coded(vectors: DataFrame, config: CodeConfig = CodeConfig(), scratch: Scratch | None = None) -> Coded:
    """Codebooks learnt from all of ``vectors`` (``vec_id, embedding, label``; more columns are not read), and codes.

    Vectors that are null or hold null or non-finite components are left out, and so are those of another length
    than the vector of the lowest vec_id that is kept: they have no parts to compare. A part begins at the whole
    part of its share of the length, so that all are equal where the length can be divided. Components beyond
    what ``most`` allows (741,455 in vectors of 64) count as that. A null vec_id comes after all others. Rows that
    repeat a vec_id are all coded; the first codebooks take the smallest vector of each. Fewer vec_ids than
    entries make smaller codebooks, no kept rows none, and then no rows are returned.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "codes")
    bounded_batches(spark)
    kind = vectors.schema["embedding"].dataType
    plain = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    label = vectors.schema["label"].dataType
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("embedding") if plain else F.col("embedding").cast("array<double>")).alias("embedding"), "label")
    seeds = _seeds(vectors, config, scratch)
    length = seeds.shape[1]
    at = cuts(length, config.parts)
    books = [seeds[:, at[p] : at[p + 1]] for p in range(config.parts)]
    kinds = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not len(seeds):
        return Coded(spark.createDataFrame([], kinds), books)
    for _ in range(config.rounds):
        books = _updated(vectors, books, config)
    trees = spark.sparkContext.broadcast([KdTree(b, config.leaf) for b in books])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = whole(batch.column("embedding"), length, config.scale)
            found = [tree.nearest(x[:, at[p] : at[p + 1]]) for p, tree in enumerate(trees.value)]
            named = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
            error = np.sum([d for _, d in found], axis=0)
            of = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(of), batch.column("label").take(of), pa.array([r.tobytes().hex() for r in named], pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return Coded(scratch.write(vectors.mapInArrow(codes, kinds), "codes"), books)


def code_report(vectors: DataFrame, config: CodeConfig = CodeConfig(), scratch: Scratch | None = None) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for each vector that ``coded`` keeps.

    Errors are summed for each label before they meet its rows again, so that a frequent one is not gathered; null
    labels are one. A sum beyond 63 bits is given as the largest number.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "codes")
    found = coded(vectors, config, scratch)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    # Written, so that its size is known: Spark broadcasts it where it is small, else splits the labels with most rows.
    labels = scratch.write(found.rows.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "labels")
    met = found.rows.join(labels, F.col("label").eqNullSafe(F.col("of")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """Assignments to codebook ``b{k}``, and the next one."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT rid, v.part, min((list_sum(list_transform(list_zip(v.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), entry)) AS best
  FROM v JOIN b{k} b ON v.part = b.part GROUP BY rid, v.part),
s{k} AS (
  SELECT part, entry, place, CAST(floor(sum(x) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT v.part, best[2] AS entry, unnest(range(1, len(v.v) + 1)) AS place, unnest(v.v) AS x FROM v JOIN a{k} a ON v.rid = a.rid AND v.part = a.part)
  GROUP BY ALL),
u{k} AS (SELECT part, entry, list(x ORDER BY place) AS v FROM s{k} GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(u.v, b.v) AS v FROM b{k} b LEFT JOIN u{k} u ON b.part = u.part AND b.entry = u.entry)"""


#: The same rows in DuckDB SQL.
ORACLE_SQL = f"""
WITH k AS (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (
  SELECT rid, vec_id, part, list_slice(e, part * len(e) // 16 + 1, (part + 1) * len(e) // 16) AS v
  FROM k, (SELECT unnest(range(16)) AS part)),
f AS (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < 64),
b0 AS (SELECT part, entry, v FROM v JOIN f USING (rid)),{_round_sql(0)},{_round_sql(1)},{_round_sql(2).split("s2 AS")[0].rstrip().rstrip(",")},
c AS (SELECT rid, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a2 GROUP BY rid),
w AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(range(len(v))) AS place, unnest(v) AS x FROM b2))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN k USING (rid), w
"""

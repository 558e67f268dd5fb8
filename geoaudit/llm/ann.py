"""Nearest neighbours by largest inner product: a block matrix join with quantised tiles.

Vectors are quantised to int8 with one scale each. The product of a tile of queries and a tile of
candidates then gives every inner product up to a bound that follows from the lengths of the quantised
vectors and of what rounding left over (Cauchy-Schwarz). Pairs whose upper bound reaches the worst of the
best found so far are computed again in double precision; each query keeps a heap of its best.

Queries are broadcast in blocks of a fixed size, one pass over the candidates for each block, so neither
side is shuffled and no block grows with the data. The result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import groups
from .scratch import Scratch


@dataclass(frozen=True)
class NearestConfig:
    """Neighbours for each query, and sizes of the broadcast query block, in rows and bytes, and of the tiles."""

    k: int = 20
    query_block: int = 32_768
    block_bytes: int = 1 << 26
    query_tile: int = 1024
    tile: int = 1024


_LONGEST = 1e100


class Quantised:
    """Vectors as int8 times a scale, with the lengths that bound the error."""

    def __init__(self, vectors: np.ndarray):
        most = np.abs(vectors).max(axis=1)
        # Of vectors this long or short, products can leave the range of doubles: no bound is set for them.
        self.wild = (most > _LONGEST) | (most < 1 / _LONGEST)
        vectors = np.where(self.wild[:, None], 0.0, vectors)
        self.scale = np.where(self.wild, 1.0, most) / 127.0
        codes = np.rint(vectors / self.scale[:, None])
        # int8 values; held as floats, in which their products and sums are exact, for the matrix product.
        self.codes = codes.astype(np.float32 if vectors.shape[1] <= 1000 else np.float64)
        near = codes * self.scale[:, None]
        self.length = np.linalg.norm(near, axis=1)
        self.rest = np.linalg.norm(vectors - near, axis=1)


def _product(a: Quantised, b: Quantised, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """Approximate inner products of a's ``rows`` and all of b, and how far they can be off."""
    near = (a.codes[rows] @ b.codes.T).astype(np.float64) * a.scale[rows, None] * b.scale
    off = a.length[rows, None] * b.rest + a.rest[rows, None] * (b.length + b.rest)
    off = off * (1 + 1e-9) + 1e-12 * np.abs(near) + 1e-300
    off[a.wild[rows]], off[:, b.wild] = np.inf, np.inf
    return near, off


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, summed from the first component to the last.

    Sums beyond the range of doubles are infinite; of infinite parts of both signs, the least of all.
    """
    total = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for k in range(a.shape[1]):
            total += a[:, k] * b[:, k]
    return np.where(np.isnan(total), -np.inf, total)


def _vectors(ids: pa.Array, column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors that take part, by dimension."""
    if isinstance(column, pa.ChunkedArray):
        column, ids = column.combine_chunks(), ids.combine_chunks()
    there = np.asarray(ids.is_valid()) & np.asarray(column.is_valid())
    column = column.fill_null([]) if column.null_count else column
    at = column.offsets.to_numpy()
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = {}
    for n in np.unique(np.diff(at)[there]).tolist():
        if n:
            rows = np.flatnonzero(there & (np.diff(at) == n))
            found = flat[at[rows][:, None] + np.arange(n)]
            good = np.isfinite(found).all(axis=1) & found.any(axis=1)
            if good.any():
                out[n] = ids[rows[good]], found[good]
    return out


_NOBODY = np.iinfo(np.int64).max


class Best:
    """The k best of each query so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, config: NearestConfig):
        self.ids, self.vectors, self.config = ids, vectors, config
        self.near = Quantised(vectors)
        self.score = np.full((len(ids), config.k), -np.inf)
        self.found = np.full((len(ids), config.k), _NOBODY)

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        k, near = self.config.k, Quantised(vectors)
        for low in range(0, len(self.ids), self.config.query_tile):
            rows = slice(low, min(low + self.config.query_tile, len(self.ids)))
            product, off = _product(self.near, near, rows)
            own = self.ids[rows, None] == ids
            least = np.where(own, -np.inf, product - off)
            worst = self.score[rows, -1]
            if len(ids) > k:
                worst = np.maximum(worst, np.partition(least, len(ids) - k, axis=1)[:, -k])
            q, c = np.nonzero(((product + off) >= worst[:, None]) & ~own)
            if not len(q):
                continue
            score = np.empty(len(q))
            for b in range(0, len(q), 65_536):
                part = slice(b, b + 65_536)
                score[part] = exact_products(self.vectors[low + q[part]], vectors[c[part]])
            touched = np.unique(q)
            q = np.concatenate([q, np.repeat(touched, k)])
            score = np.concatenate([score, self.score[low + touched].ravel()])
            who = np.concatenate([ids[c], self.found[low + touched].ravel()])
            order = np.lexsort((who, -score, q))
            q, score, who = q[order], score[order], who[order]
            first = np.searchsorted(q, touched)
            keep = (first[:, None] + np.arange(k)).ravel()
            self.score[low + touched] = score[keep].reshape(-1, k)
            self.found[low + touched] = who[keep].reshape(-1, k)


_PARTIAL = "query_id long, vec_id array<long>, score array<double>"


def _block_pass(candidates: DataFrame, sent, config: NearestConfig) -> DataFrame:
    """Each task's best for every query of the broadcast block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: Best(*own, config) for n, own in sent.value.items()}
        for batch in batches:
            for n, (ids, vectors) in _vectors(batch.column("vec_id"), batch.column("embedding")).items():
                if n in best:
                    for at in range(0, len(ids), config.tile):
                        best[n].offer(ids[at : at + config.tile], vectors[at : at + config.tile])
        for b in best.values():
            real = [np.count_nonzero(x != _NOBODY) for x in b.found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.ids), pa.array([x[:r].tolist() for x, r in zip(b.found, real, strict=True)], pa.list_(pa.int64())), pa.array([x[:r].tolist() for x, r in zip(b.score, real, strict=True)], pa.list_(pa.float64()))],
                names=["query_id", "vec_id", "score"],
            )

    return candidates.mapInArrow(run, _PARTIAL)


def nearest(vectors: DataFrame, queries: DataFrame, config: NearestConfig = NearestConfig()) -> DataFrame:
    """Each query's ``k`` nearest among ``vectors`` by inner product: ``query_id, rank, vec_id, score``.

    Both have ``vec_id`` and ``embedding``; further columns are not read. Rank 1 has the largest inner
    product, ties go to the smaller vec_id; fewer rows where there are fewer candidates. Rows with the
    query's vec_id are no candidates for it. Null ids, and vectors that are null, empty, zero or hold null or
    non-finite components, take no part; only vectors of one dimension are compared. A vec_id that repeats
    among the queries is asked once, with the vector that sorts first; repeated candidates all count. Finite
    vectors of any length take part; their product can be infinite (``exact_products``).
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = queries.where("vec_id is not null").groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.col("embedding").cast("array<double>")).alias("embedding"))
    number, widest = queries.agg(F.count("vec_id"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    blocks = max(1, -(-number // max(1, min(config.query_block, config.block_bytes // (8 * max(1, widest))))))
    parts, scratch = None, Scratch(vectors.sparkSession, "nearest")
    asked = scratch.write(asked, "queries") if blocks > 1 else asked
    for b in range(blocks):
        block = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)).toArrow()
        sent = vectors.sparkSession.sparkContext.broadcast(_vectors(block.column("vec_id"), block.column("embedding")))
        part = _block_pass(rows, sent, config)
        if blocks > 1:  # one block after the other: neither the plan nor what is broadcast grows with the queries
            part = scratch.write(part, "best")
            sent.unpersist()
        parts = part if parts is None else parts.unionAll(part)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, rank, found, score = [], [], [], []
        for group in groups(batches, 1):
            heaps = [[(-s, i) for s, i in zip(scores, ids, strict=True)] for scores, ids in zip(group.column("score").to_pylist(), group.column("vec_id").to_pylist(), strict=True)]
            best = list(islice(heapq.merge(*heaps), config.k))
            query += [group.column("query_id")[0].as_py()] * len(best)
            rank += range(1, len(best) + 1)
            found += [i for _, i in best]
            score += [-s for s, _ in best]
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(rank, pa.int32()), pa.array(found, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "rank", "vec_id", "score"])

    merged = parts.repartition("query_id").sortWithinPartitions("query_id")
    return merged.mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


def nearest_report(vectors: DataFrame, config: NearestConfig = NearestConfig()) -> DataFrame:
    """The stated query set, ids divisible by 20, against all rows."""
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), config)

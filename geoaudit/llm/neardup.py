"""Near-duplicate documents by circulant MinHash, with every link confirmed on the full shingle sets.

Two permutations make all signature coordinates: the first scatters a shingle's bin, the second is read
from a place that moves on by one for each coordinate (a circular shift). Bands of coordinates name
buckets; documents that share a bucket are candidates.

No bucket is ever gathered: bucket rows are sorted into ranges and each range links its members to the
first of them. The links are checked, components are formed, and only buckets in which two components
still meet are looked at again, in full. So a group of copies costs links in proportion to its size, and
no pair that shares a bucket and lies in two components at the end is left out. The full look compares
blocks of members by their signatures and passes on the members with a likely partner, not the pairs; a
pair is looked at in the first bucket that it shares. Its links join components, which are contracted to
one node each, so that what was found before is not gone through again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from . import words as W
from .components import connected_components
from .process import bounded_batches, keep_nothing, kept
from .rows import groups, text_of, with_text
from .scratch import Scratch


@dataclass(frozen=True)
class NearDupConfig:
    """Shingle length, similarity ``percent`` and signature shape.

    A pair at exactly 0.75 is missed by all bands with probability (1 - 0.75**5)**48 = 2e-6. In the full
    look, a pair whose signatures agree in less than ``percent - slack`` of the coordinates is not compared
    further; at exactly 0.75 that is 4.6 standard deviations off (2e-6).
    """

    shingle: int = 5
    percent: int = 75
    bands: int = 48
    rows: int = 5
    universe_bits: int = 20
    seed: int = 20251
    slack: int = 13
    block: int = 256
    block_shingles: int = 1 << 19


class CirculantMinHash:
    """Signatures over the bins of a fixed universe from two permutations."""

    def __init__(self, config: NearDupConfig):
        rng = np.random.default_rng(config.seed)
        size, self.length = 1 << config.universe_bits, config.bands * config.rows
        self.shift = np.uint64(64 - config.universe_bits)
        self.scatter = rng.permutation(size).astype(np.int32)
        second = rng.permutation(size).astype(np.int32)
        # Row p of the view holds the second permutation at p, p+1, ..., with wrap-around.
        self.turned = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: self.length]]), self.length)
        self.factor = W.mix(np.arange(1, config.rows + 1, dtype=np.uint64)) | np.uint64(1)
        self.offset = W.mix(np.arange(1, config.bands + 1, dtype=np.uint64) << np.uint64(32))
        self.shape = (config.bands, config.rows)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = self.scatter[(shingles >> self.shift).astype(np.int64)]
        low = self.turned[at[:1024]].min(axis=0)
        for k in range(1024, len(at), 1024):
            np.minimum(low, self.turned[at[k : k + 1024]].min(axis=0), out=low)
        return low

    def bands(self, shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
        """One 64-bit bucket name for each band, and the low byte of each coordinate."""
        low = self.signature(shingles)
        rows = low.astype(np.uint64).reshape(self.shape)
        return W.mix((rows * self.factor).sum(axis=1, dtype=np.uint64) + self.offset), low.astype(np.uint8).tobytes()


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    for _, _, data, at in W.chunks(column):
        hashes, first = W.shingle_hashes(W.split(data, at), size)
        for d in range(len(at) - 1):
            own = np.sort(hashes[first[d] : first[d + 1]])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) > 1 else own


SIGNATURES = "number long, n_shingles long, h1 long, h2 long, bands array<long>, low binary"


def signatures(rows: DataFrame, config: NearDupConfig) -> DataFrame:
    """A number for every row of ``with_text``, its set's size, 128-bit hash and buckets.

    No bands for an empty set. Numbers are unique: the partition's and a count within it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = kept(config, lambda: CirculantMinHash(config))
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            n, h1, h2, bands, low, known = [], [], [], [], [], {}
            for own in _sets(text_of(batch), config.shingle):
                key = (len(own), int(np.sum(W.mix(own), dtype=np.uint64)), int(np.sum(W.mix(own ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
                if key not in known:
                    known[key] = hasher.bands(own) if len(own) else (np.zeros(0, np.uint64), b"")
                n.append(key[0]), h1.append(key[1]), h2.append(key[2]), bands.append(known[key][0]), low.append(known[key][1])
            flat = np.concatenate([np.zeros(0, np.uint64), *bands]).view(np.int64)
            at = np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(np.arange(number, number + batch.num_rows)),
                    pa.array(n, pa.int64()),
                    pa.array(np.array(h1, np.uint64).view(np.int64)),
                    pa.array(np.array(h2, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(flat)),
                    pa.array(low, pa.binary()),
                ],
                names=[*batch.schema.names, "number", "n_shingles", "h1", "h2", "bands", "low"],
            )
            number += batch.num_rows

    kind = StructType([*rows.schema.fields, *_parse_datatype_string(SIGNATURES).fields])
    return rows.mapInArrow(run, kind)


def _stars(buckets: DataFrame) -> DataFrame:
    """For sorted ranges of ``(bucket, node)``: each member of a bucket beside the first in its range.

    Buckets with one member in a range of their own are left out; a bucket that goes on over several
    ranges keeps its first and last members, so that it is seen to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = first = member = None  # bucket and first node of the group that is open, the one row not yet written
        def rows(bucket, node, pivot):
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(node, pa.int64()), pa.array(pivot, pa.int64())], names=["bucket", "node", "pivot"])
        opening = True  # the first group may have begun in the range before
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.concatenate([[True], bucket[1:] != bucket[:-1]])
            goes_on = last is not None and bucket[0] == last
            head = np.flatnonzero(new)
            pivot = np.repeat(node[head], np.diff(np.concatenate([head, [len(node)]])))
            alone = np.zeros(len(node), bool)
            sizes = np.diff(np.concatenate([head, [len(node)]]))
            alone[head[sizes == 1]] = True
            if goes_on:
                end = sizes[0]
                pivot[:end], alone[:end] = first, False
                if member is not None:
                    yield rows([last], [member], [first])
            elif member is not None and opening:
                yield rows([last], [member], [first])
            if last is not None and not goes_on:
                opening = False
            if opening and len(head) > 1:
                alone[head[0]] = False
                opening = False
            # The last group may go on in the next batch or range.
            last, first = bucket[-1], pivot[-1]
            member = node[-1] if alone[-1] else None
            keep = ~alone
            if keep.any():
                yield rows(bucket[keep], node[keep], pivot[keep])
        if member is not None:
            yield rows([last], [member], [first])

    return buckets.mapInArrow(run, "bucket long, node long, pivot long")


def _similar(a: np.ndarray, b: np.ndarray, config: NearDupConfig) -> bool:
    """Whether two sorted sets are similar enough."""
    if not 100 * min(len(a), len(b)) >= config.percent * max(len(a), len(b)) > 0:
        return False
    both = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
    return 100 * both >= config.percent * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, texts: DataFrame, config: NearDupConfig) -> DataFrame:
    """The pairs ``(a, b)`` that are similar enough, by the sizes of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        known, own = None, None
        for batch in batches:
            a, b, text_b = batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text_b")
            good = []
            for k, left in enumerate(_sets(batch.column("text_a"), config.shingle)):
                if b[k] != known:
                    known, own = b[k], next(_sets(text_b.slice(k, 1), config.shingle))
                good.append(_similar(left, own, config))
            good = np.array(good, bool)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], names=["a", "b"])

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "text_a", "b", "text_b").mapInArrow(run, "a long, b long")


_HEAD = ["bucket", "block", "least", "most", "small", "large"]
_SIDE = ["node", "component", "n_shingles", "bands", "low"]
_BLOCK = "bucket long, block long, least long, most long, small long, large long, node array<long>, component array<long>, n_shingles array<long>, bands array<array<long>>, low array<binary>"


def _blocks(members: DataFrame, config: NearDupConfig) -> DataFrame:
    """Members of mixed buckets, sorted by bucket and component, as one row for each block of them.

    A block ends with its bucket, with its Arrow batch, after ``block`` members or with ``block_shingles`` shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            bucket, component, size = (batch.column(c).to_numpy() for c in ("bucket", "component", "n_shingles"))
            total = np.concatenate([[0], np.cumsum(size)])
            ends, low, at = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)), 0, []
            for end in ends.tolist():
                while low < end:
                    high = min(end, low + config.block, max(low + 1, int(np.searchsorted(total, total[low] + config.block_shingles, side="right")) - 1))
                    at.append((low, high))
                    low = high
            heads = [(int(bucket[b]), number + k, int(component[b:e].min()), int(component[b:e].max()), int(size[b:e].min()), int(size[b:e].max())) for k, (b, e) in enumerate(at)]
            number += len(at)
            offsets = pa.array([0, *(e for _, e in at)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([h[k] for h in heads], pa.int64()) for k in range(6)), *(pa.ListArray.from_arrays(offsets, batch.column(c)) for c in _SIDE)],
                names=[*_HEAD, *_SIDE],
            )

    return members.mapInArrow(run, _BLOCK)


_GROUP = ["bucket", "one", "two"]


Side = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
_LIKELY = "bucket long, one long, two long, node long, component long, partners array<long>"


def _side(row: dict, name: str = "") -> Side:
    return (*(np.array(row[f"{name}{c}"], np.int64) for c in _SIDE[:-1]), np.frombuffer(b"".join(row[f"{name}low"]), np.uint8).reshape(len(row[f"{name}node"]), -1))


def _partners(bucket: int, x: Side, y: Side, same: bool, config: NearDupConfig) -> tuple[list[int], list[int], list[list[int]]]:
    """Of two blocks of a bucket, or of one with itself: members with likely partners, their components, the partners."""
    least = (config.percent - config.slack) * config.bands * config.rows / 100
    partners: dict[int, list[int]] = {}
    component = dict(zip(y[0].tolist(), y[1].tolist(), strict=True))
    for i, node in enumerate(x[0].tolist()):
        j = np.flatnonzero((y[1] != x[1][i]) & (100 * np.minimum(y[2], x[2][i]) >= config.percent * np.maximum(y[2], x[2][i])))
        if same:
            j = j[j > i]
        if len(j):
            j = j[x[3][i][np.argmax(y[3][j] == x[3][i], axis=1)] == bucket]
            j = j[np.count_nonzero(y[4][j] == x[4][i], axis=1) >= least]
            if len(j):
                partners[node] = y[0][j].tolist()
                component[node] = int(x[1][i])
    used = sorted({*partners, *(b for own in partners.values() for b in own)})
    return used, [component[u] for u in used], [partners.get(u, []) for u in used]


def _likely(blocks: DataFrame, config: NearDupConfig) -> DataFrame:
    """For rows with one block, or with two (columns ``one_...`` and ``two_...``): members with likely partners."""
    two = "two" in blocks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if not two and row["least"] == row["most"]:
                    continue
                one, other = (row["one"], row["two"]) if two else (row["block"], row["block"])
                x = _side(row, "one_" if two else "")
                used, component, partners = _partners(row["bucket"], x, _side(row, "two_") if two else x, not two, config)
                if used:
                    heads = [pa.array([v] * len(used), pa.int64()) for v in (row["bucket"], one, other)]
                    yield pa.RecordBatch.from_arrays([*heads, pa.array(used, pa.int64()), pa.array(component, pa.int64()), pa.array(partners, pa.list_(pa.int64()))], names=[*_GROUP, "node", "component", "partners"])

    return blocks.mapInArrow(run, _LIKELY)


def _joined(members: DataFrame, config: NearDupConfig) -> DataFrame:
    """Links between components by their similar partners, one at most for two components in a block pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3):
            node, component = group.column("node").to_pylist(), group.column("component").to_pylist()
            of, root, sets = dict(zip(node, component, strict=True)), {c: c for c in component}, dict(zip(node, _sets(group.column("text").combine_chunks(), config.shingle), strict=True))

            def find(c, root=root):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            links = []
            for a, partners in zip(node, group.column("partners").to_pylist(), strict=True):
                for b in partners:
                    x, y = find(of[a]), find(of[b])
                    if x != y and _similar(sets[a], sets[b], config):
                        root[x] = y
                        links.append((of[a], of[b]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], names=["a", "b"])

    return members.mapInArrow(run, "a long, b long")


def _remaining(members: DataFrame, texts: DataFrame, scratch: Scratch, config: NearDupConfig) -> DataFrame:
    """All links left between components that meet in a bucket; ``members`` of those, with their signatures.

    Blocks hold members in the order of components, and two blocks of one component, or of sizes that
    cannot be similar, are not compared: one large component beside some others costs in proportion to
    its size.
    """
    ordered = members.repartitionByRange("bucket", "component", "node").sortWithinPartitions("bucket", "component", "node")
    blocks = scratch.write(_blocks(ordered.select("bucket", *_SIDE), config), "blocks")
    heads = blocks.select(*_HEAD)
    other = heads.select("bucket", *(F.col(c).alias(f"other_{c}") for c in _HEAD[1:]))
    pairs = heads.join(other, "bucket").where(
        (F.col("block") < F.col("other_block"))
        & ((F.col("least") != F.col("most")) | (F.col("other_least") != F.col("other_most")) | (F.col("least") != F.col("other_least")))
        & (F.col("large") * 100 >= F.col("other_small") * config.percent)
        & (F.col("other_large") * 100 >= F.col("small") * config.percent)
    )
    pairs = pairs.select("bucket", F.col("block").alias("one"), F.col("other_block").alias("two"))
    for name in ("one", "two"):
        pairs = pairs.join(blocks.select("bucket", F.col("block").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in _SIDE)), ["bucket", name])
    likely = scratch.write(_likely(blocks, config).unionAll(_likely(pairs, config)), "likely")
    whole = likely.join(texts, "node").repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    return _joined(whole.select(*_GROUP, "node", "component", "partners", "text"), config)


_SET = ["n_shingles", "h1", "h2"]


def _grouped(docs: DataFrame, columns: list[str], scratch: Scratch, config: NearDupConfig) -> tuple[DataFrame, DataFrame]:
    """All rows with their signatures and ``columns`` as struct ``row``; and of each set, its group's first row.

    The first row of a group, as struct ``first``, is that with the smallest ``doc_id``, then ``number``.
    """
    signed = scratch.write(signatures(with_text(docs, columns), config), "signatures").withColumn("doc_id", F.col("row.doc_id").cast("long"))
    text = F.col("row.text" if "text" in columns else "text").alias("text")
    sets = signed.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.write(sets.groupBy(*_SET).agg(F.min("number").alias("node"), F.min(F.struct("doc_id", "number")).alias("first")), "classes")
    buckets = scratch.write(signed.select("number", "bands").join(classes.select(F.col("node").alias("number")), "number", "left_semi").select(F.explode("bands").alias("bucket"), F.col("number").alias("node")), "buckets")
    members = scratch.write(_stars(buckets.repartitionByRange("bucket", "node").sortWithinPartitions("bucket", "node")), "members")
    scratch.drop(buckets)
    texts = scratch.write(signed.select(F.col("number").alias("node"), text).join(members.select("node").distinct(), "node", "left_semi"), "texts")

    links = scratch.write(_verified(members.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), texts, config), "links")
    found = connected_components(links, scratch)
    placed = members.select("bucket", "node").join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    features = signed.select(F.col("number").alias("node"), "n_shingles", "bands", "low")
    mixed = scratch.write(placed.join(mixed.select("bucket"), "bucket", "left_semi").join(features, "node"), "mixed")
    if not mixed.isEmpty():
        more = scratch.write(_remaining(mixed, texts, scratch, config), "links")
        # The components so far are the nodes of what is left to join.
        wider = connected_components(more, scratch).select(F.col("node").alias("component"), F.col("component").alias("wider"))
        alone = wider.join(found.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("node"), "component")
        found = found.unionAll(alone).join(wider, "component", "left").select("node", F.coalesce("wider", "component").alias("component"))
    joined = classes.select("node", "first").join(found, "node")
    first = joined.join(joined.groupBy("component").agg(F.min("first").alias("least")), "component").select("node", "least")
    return signed, classes.join(scratch.write(first, "first"), "node", "left").select(*_SET, F.coalesce("least", "first").alias("first"))


def near_duplicates(docs: DataFrame, config: NearDupConfig = NearDupConfig()) -> DataFrame:
    """Link documents whose shingle sets have a Jaccard similarity of ``percent`` or more.

    ``docs`` has ``doc_id`` and ``text``; other columns, of any name, are not read. Returns ``doc_id,
    n_shingles, component_id`` (smallest doc_id that links lead to, itself included), ``kept``
    (doc_id = component_id), one row for each row of ``docs``. Words are split at white space, with A-Z in
    lower case; a text with fewer words than a shingle has one shingle, its whole sequence. A text that is
    null or has no words has an empty set and is linked with nothing. Every row is a document of its own:
    rows that share a doc_id are linked by their texts alone. A row with a null doc_id takes no part:
    component_id is null and kept true. Exact copies are one class and are compared once. An empty table
    gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    signed, groups_ = _grouped(docs, ["doc_id"], Scratch(docs.sparkSession, "neardup"), config)
    out = signed.select("doc_id", *_SET).join(groups_, _SET, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("first.doc_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame, config: NearDupConfig = NearDupConfig(), scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with one row of each group of ``near_duplicates``: the smallest doc_id, and one row of that id.

    All columns stay. Rows without words, or with a null doc_id, are in no group and all stay. Rows that
    repeat a doc_id stay if their texts are in different groups. ``scratch``: the caller's folder.
    """
    bounded_batches(docs.sparkSession)
    signed, groups_ = _grouped(docs, docs.columns, scratch or Scratch(docs.sparkSession, "neardup"), config)
    out = signed.select("row", "doc_id", "number", *_SET).join(groups_, _SET, "left")
    return out.where(F.col("doc_id").isNull() | F.col("first").isNull() | (F.col("first.number") == F.col("number"))).select("row.*")

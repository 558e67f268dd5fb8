"""A Merkle manifest of a table of documents: one root, and for each row a proof that it belongs to it.

Leaves are numbered within their group (``lang``) by one range sort. The tree then grows in supersteps over
vertices, each of which stands for ``1 << climb`` consecutive nodes of a level: children send their digests to
the parent vertex, which, once all are there, hashes ``climb`` levels and sends its own digest on. When every
group has its subroot, the subroots go through the same supersteps to the root. Reverse supersteps send each
vertex the siblings on its way up; leaves share the path of their vertex, so that what is sent down is one path
for each vertex and not for each leaf. No group and no path is ever gathered beyond a vertex.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .process import bounded_batches
from .scratch import Scratch

#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_PATH = "path array<string>"

#: A vertex: its group, the levels of that group's tree, and its number among the vertices of its height.
Key = tuple[str | None, int, int]


@dataclass(frozen=True)
class MerkleConfig:
    """Levels that a vertex hashes, and the divisor of the ids' checksums by which rows are tampered with."""

    climb: int = 8
    tampered: int = 7


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climbed(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and ``levels`` levels above them; every two become one, the last one alone if it has no other."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def siblings(tree: list[list[str]], at: int) -> list[str]:
    """What stands beside the way up from node ``at``: ``<`` and a digest to the left of it, ``>`` to its right, or nothing."""
    out = []
    for nodes in tree[:-1]:
        other = at ^ 1
        out.append("" if other >= len(nodes) else ("<" if other < at else ">") + nodes[other])
        at >>= 1
    return out


def folded(node: str, path: list[str]) -> str:
    """The digest at the end of a path."""
    for step in path:
        node = digest(step[1:], node) if step[:1] == "<" else digest(node, step[1:])
    return node


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _leaf(n_chars: Column) -> Column:
    parts = (_field(n_chars if c == "n_chars" else F.col(c)) for c in FIELDS)
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs: DataFrame, config: MerkleConfig = MerkleConfig()) -> DataFrame:
    """``doc_id, lang, leaf, changed``: a row's digest, and the one after tampering, null where there is none."""
    marked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % config.tampered == 0
    changed = F.when(marked & F.col("n_chars").isNotNull(), _leaf(F.col("n_chars").cast("long") + 1))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), _leaf(F.col("n_chars")).alias("leaf"), changed.alias("changed"))


def numbered(rows: DataFrame, group: str | None, order: list[str], scratch: Scratch) -> DataFrame:
    """Rows with ``idx``, from 0 within each group in the given order (nulls first), and ``levels`` of its tree.

    One range sort, in which a group spreads over as many partitions as it needs; equal rows too, for which
    any order will do. Each row then takes its place from its partition's first row and the rows before it.
    """
    keys = [F.asc_nulls_first(c) for c in ([group] if group else []) + order]
    spread = rows.withColumn("spread", F.monotonically_increasing_id())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = spread.repartitionByRange(parts, *keys, "spread").sortWithinPartitions(*keys, "spread").drop("spread")
    placed = scratch.write(ranged.withColumn("at", F.monotonically_increasing_id()), "sorted").withColumn("part", F.shiftright("at", 33))
    by = F.col(group) if group else F.lit(None).cast("string")
    runs = placed.groupBy(by.alias("of"), F.col("part").alias("in")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    each = Window.partitionBy("of")
    before = F.coalesce(F.sum("n").over(each.orderBy("in").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = F.length(F.regexp_replace(F.bin(F.sum("n").over(each) - 1), "^0$", ""))
    runs = scratch.write(runs.select("of", "in", (before - F.col("first")).alias("shift"), levels.cast("int").alias("levels")), "runs")
    met = placed.join(runs, by.eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
    return met.withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "of", "in", "shift")


class Supersteps:
    """The tree over the vertices of some groups: upwards to each group's last digest, then paths downwards."""

    def __init__(self, first: RDD, most_levels: int, climb: int, tasks: int):
        """``first``: pairs of a key and the digest of that vertex of the lowest height."""
        self.climb, self.tasks = climb, tasks
        self.heights: list[RDD] = []
        self.tops = first.filter(lambda x: x[0][1] <= climb).map(lambda x: (*x[0][:2], x[1]))
        digests = first
        for height in range(1, max(1, -(-most_levels // climb))):
            vertices = self._received(digests, height)
            self.heights.append(vertices)
            digests = vertices.mapValues(lambda tree: tree[-1][0])
            self.tops = self.tops.union(digests.filter(lambda x, least=climb * height, most=climb * (height + 1): least < x[0][1] <= most).map(lambda x: (*x[0][:2], x[1])))

    def _received(self, digests: RDD, height: int) -> RDD:
        """Vertices one height up, each with the levels that it hashes out of its children's messages."""
        climb = self.climb
        messages = digests.filter(lambda x: x[0][1] > climb * height).map(lambda x: ((x[0][0], x[0][1], x[0][2] >> climb), (x[0][2] & ((1 << climb) - 1), x[1])))
        grown = messages.groupByKey(self.tasks)
        return grown.map(lambda x: (x[0], climbed([d for _, d in sorted(x[1])], min(climb, x[0][1] - climb * height))), preservesPartitioning=True)

    def paths(self, told: RDD) -> RDD:
        """Pairs of a lowest vertex's key and what its group was told (``told``: pairs of group and list) after its own path.

        A group's last vertex takes what it is told and sends it down. There must be a height above the lowest,
        and groups without it get nothing.
        """
        climb, above = self.climb, None
        for height in range(len(self.heights), 0, -1):
            vertices = self.heights[height - 1]
            last = vertices.filter(lambda x, most=climb * (height + 1): x[0][1] <= most).map(lambda x: (x[0][0], x[0])).join(told, self.tasks).map(lambda x: (x[1][0], x[1][1]))
            got = last if above is None else last.union(above)
            # Each child hears its siblings inside this vertex, and then what this vertex heard.
            above = vertices.join(got, self.tasks).flatMap(lambda x: (((x[0][0], x[0][1], (x[0][2] << climb) + k), siblings(x[1][0], k) + x[1][1]) for k in range(len(x[1][0][0]))))
        return above


def _upwards(vertices: DataFrame, digests: str, climb: int, tasks: int) -> Supersteps:
    """Supersteps from ``vertices`` (group ``of``, ``levels``, ``vertex``), whose nodes have ``digests``."""
    first = vertices.select("of", "levels", "vertex", digests).rdd.map(lambda r: ((r[0], r[1], r[2]), climbed(r[3], min(climb, r[1]))[-1][0]))
    return Supersteps(first, vertices.agg(F.max("levels")).first()[0] or 0, climb, tasks)


def _vertices(rows: DataFrame, group: Column, content: list[str], climb: int) -> DataFrame:
    """Runs of ``1 << climb`` consecutive nodes: the lowest vertices with their nodes in order."""
    runs = rows.groupBy(group.alias("of"), "levels", F.shiftright("idx", climb).alias("vertex"))
    return runs.agg(F.sort_array(F.collect_list(F.struct("idx", *content))).alias("nodes"))


def manifest(docs: DataFrame, config: MerkleConfig = MerkleConfig(), scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row of ``docs``.

    ``docs`` has the columns of ``FIELDS`` and may have more, which are not read. Every row is a leaf. Leaves of a
    ``lang`` (nulls are a group of their own) stand in the order of doc_id, null first; rows that share one in
    that of their digests; rows equal in all have neighbouring places, either way round. ``folded_root`` goes from
    the leaf after tampering along the untampered siblings; rows with a null doc_id or n_chars are not tampered
    with. Empty texts are values (``0:``), unlike null ones (``-``). No rows give no rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "merkle")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    climb = config.climb
    bounded_batches(spark)
    rows = numbered(scratch.write(leaves(docs, config), "leaves"), "lang", ["doc_id", "leaf"], scratch)
    vertices = scratch.write(_vertices(rows, F.col("lang"), ["doc_id", "leaf", "changed"], climb), "vertices")
    groups = _upwards(vertices, "nodes.leaf", climb, tasks)
    # The groups' last digests are the nodes of one more tree.
    subroots = scratch.write(spark.createDataFrame(groups.tops, "lang string, high int, subroot string"), "subroots")
    tops = scratch.write(_vertices(numbered(subroots, None, ["lang"], scratch), F.lit(None).cast("string"), ["lang", "high", "subroot"], climb), "tops")
    over = _upwards(tops, "nodes.subroot", climb, tasks)
    last = over.tops.take(1)
    root = last[0][2] if last else ""

    def to_groups(x) -> Iterator[tuple[str | None, int, str, list[str]]]:
        (_, levels, _), (nodes, path) = x
        tree = climbed([n["subroot"] for n in nodes], min(climb, levels))
        for k, n in enumerate(nodes):
            yield n["lang"], n["high"], n["subroot"], siblings(tree, k) + path

    ends = tops.rdd.map(lambda r: ((r[0], r[1], r[2]), r[3]))
    heard = over.paths(spark.sparkContext.parallelize([(None, [])], 1)) if over.heights else ends.mapValues(lambda _: [])
    told = scratch.write(spark.createDataFrame(ends.join(heard, tasks).flatMap(to_groups), f"to string, high int, subroot string, {_PATH}"), "told")
    alone = told.where(F.col("high") <= climb).select("to", "high", F.lit(0).cast("long").alias("at"), "path", "subroot")
    down = groups.paths(told.select("to", "path", "subroot").rdd.map(lambda r: (r[0], ["=" + r[2], *r[1]]))) if groups.heights else spark.sparkContext.emptyRDD()
    # A group's subroot comes down as the one step that is marked "=".
    sent = spark.createDataFrame(down.map(lambda x: (*x[0], [s for s in x[1] if s[:1] != "="], next(s[1:] for s in x[1] if s[:1] == "="))), alone.schema)
    paths = scratch.write(alone.unionByName(sent), "paths")
    met = vertices.join(paths, F.col("of").eqNullSafe(F.col("to")) & (F.col("levels") == F.col("high")) & (F.col("vertex") == F.col("at")))

    def proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                yield _proved(r["nodes"], r["path"], min(climb, r["levels"]), r["subroot"], root)

    return met.select("nodes", "path", "levels", "subroot").mapInArrow(proved, RESULT)


def _proved(nodes: list[dict], path: list[str], levels: int, subroot: str, root: str) -> pa.RecordBatch:
    """The rows of one vertex. Paths above it are followed once for each digest that arrives there."""
    tree = climbed([n["leaf"] for n in nodes], levels)
    rest, ends = "".join(s[1:] for s in path), {}
    out: dict[str, list] = {"doc_id": [], "leaf": [], "subroot": [], "root": [], "proof_sha256": [], "folded_root": [], "verified": []}
    for k, n in enumerate(nodes):
        beside = siblings(tree, k)
        at = folded(n["changed"] or n["leaf"], beside)
        if at not in ends:
            ends[at] = folded(at, path)
        row = (n["doc_id"], n["leaf"], subroot, root, digest(*(s[1:] for s in beside), rest), ends[at], ends[at] == root)
        for name, value in zip(out, row, strict=True):
            out[name].append(value)
    kinds = {"doc_id": pa.int64(), "verified": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()], names=list(out))


#: The same rows in DuckDB SQL; the checksum is taken bit by bit, for lack of a function.
ORACLE_SQL = """
WITH RECURSIVE d AS (
  SELECT *, list_reduce(
      flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda b: (ascii(c) >> b) & 1))),
      lambda crc, bit: xor(crc >> 1, CASE WHEN (xor(crc, bit) & 1) = 1 THEN 3988292384 ELSE 0 END), 4294967295) AS c FROM documents),
f AS (
  SELECT doc_id, lang, n_chars IS NOT NULL AND doc_id IS NOT NULL AND xor(c, 4294967295) % 7 = 0 AS tampered,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
    CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS own,
    strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) AS other,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail FROM d),
l AS (SELECT doc_id, lang, sha256(head || own || tail) AS leaf, CASE WHEN tampered THEN sha256(head || other || tail) END AS changed FROM f),
i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM l),
up AS (
  SELECT lang, 0 AS level, idx, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM i
  UNION ALL
  SELECT lang, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY lang, level, idx // 2, n),
s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, pos AS idx, subroot AS h, count(*) OVER () AS n FROM s
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, idx // 2, n),
lift AS (SELECT lang, max(level) AS height FROM up GROUP BY lang),
nodes AS (
  SELECT lang, level, idx, h FROM up WHERE n > 1
  UNION ALL
  SELECT lang, height + level, idx, h FROM top, lift WHERE n > 1),
walk AS (
  SELECT i.lang, i.idx AS leaf_idx, i.idx AS pos, 0 AS level, coalesce(changed, leaf) AS h, '' AS proof, s.pos AS lang_at FROM i JOIN s ON i.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT lang, leaf_idx, pos // 2, level + 1, CASE WHEN own % 2 = 1 THEN sha256(coalesce(other, '') || h) ELSE sha256(h || coalesce(other, '')) END, proof || coalesce(other, ''), lang_at
  FROM (
    SELECT w.lang, w.leaf_idx, w.own AS pos, w.level, w.h, w.proof, w.lang_at, w.own, o.h AS other
    FROM (SELECT x.*, CASE WHEN x.level = y.height THEN x.lang_at ELSE x.pos END AS own FROM walk x JOIN lift y ON x.lang IS NOT DISTINCT FROM y.lang) w
    JOIN nodes m ON m.lang IS NOT DISTINCT FROM w.lang AND m.level = w.level AND m.idx = w.own
    LEFT JOIN nodes o ON o.lang IS NOT DISTINCT FROM w.lang AND o.level = w.level AND o.idx = xor(w.own, 1))),
done AS (SELECT lang, leaf_idx, h AS folded_root, proof FROM walk QUALIFY row_number() OVER (PARTITION BY lang, leaf_idx ORDER BY level DESC) = 1),
r AS (SELECT h AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM i JOIN s ON i.lang IS NOT DISTINCT FROM s.lang JOIN done ON done.lang IS NOT DISTINCT FROM i.lang AND done.leaf_idx = i.idx, r
"""

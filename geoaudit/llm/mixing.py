"""Sources mixed to target weights: every shard gets its exact share of the blocks drawn from each source.

A document is cut into blocks of at most ``block_words`` words. The blocks of a source stand in an order that a
hash gives; its quota is drawn from the front of that order, in whole passes and a part of one more, whose last
block is cut where the quota is reached. How many of a source's drawn blocks go to each shard follows from a tree
that splits the shards in two and the blocks of all sources between the halves by a multivariate hypergeometric
draw, down to single shards: as if all blocks had been shuffled and dealt out. Shards then take disjoint runs of
each source's blocks, and each shard shuffles its own.

All of it is DataFrame operations. Sizes are counted in one pass over the texts; what is shuffled are rows of a few
numbers for each block, and a source is spread over ``buckets`` runs of its order, whose totals give every block
its place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: A word, the weights in the order of the sources, and how often the mix may take a word.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_PASSES = 2


@dataclass(frozen=True)
class MixConfig:
    """Size of a block and of a shard in words, the fewest shards, the hex digits that name a bucket, and the seed."""

    block_words: int = 512
    shard_words: int = 1 << 26
    least_shards: int = 16
    bucket_digits: int = 3
    seed: int = 12


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, copies``: words of the documents, those equal in all three counted together."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    return rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))


def targets(sizes: DataFrame) -> DataFrame:
    """A row for each source: ``source, rank, weight, source_size, target`` and ``quota``, the target in whole words.

    Where a source stops at twice its size, the others share what is over by weight. That ends where all targets are
    one multiple of the weights but for the sources that stop: those whose size is least for their weight, so
    going through them in that order finds how many do.
    """
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    known = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    # Sources are few; rows are not.
    ranked = known.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1).withColumn("weight", weight.cast("long"))
    whole, small = Window.partitionBy(), Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = small.rowsBetween(Window.unboundedPreceding, -1)
    size, w = F.col("source_size"), F.col("weight")
    # Twice what is left for a source and those after it if all before it stop, and their weights.
    left = 3 * F.sum(size).over(whole) - 4 * F.coalesce(F.sum(size).over(before), F.lit(0))
    rest = F.sum(w).over(whole) - F.coalesce(F.sum(w).over(before), F.lit(0))
    tried = ranked.withColumns({"left": left, "rest": rest}).withColumn("goes_on", F.col("left") * w <= 4 * size * F.col("rest"))
    first = F.min(F.when(F.col("goes_on"), F.struct((size / w).alias("ratio"), "rank", "left", "rest"))).over(whole)
    share = first["left"].cast("double") * w / (2 * first["rest"])
    stops = first.isNull() | (F.struct(size / w, F.col("rank")) < F.struct(first["ratio"], first["rank"]))
    target = F.when(stops, MOST_PASSES * size.cast("double")).otherwise(share)
    return tried.withColumn("target", target).select("source", "rank", "weight", "source_size", "target", F.floor(F.col("target") + 0.5).alias("quota"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hypergeometric(pool: Column, hits: Column, draws: Column, uniform: Column) -> Column:
    """How many of ``draws`` from a pool are hits: the value that a uniform number picks.

    Chances are laid end to end from the likeliest value upwards, then downwards, each as a ratio to the one before.
    Values beyond ten standard deviations, which have less of the chance than a double can tell, are left out.
    """
    number = {k: v.cast("double") for k, v in (("pool", pool), ("hits", hits), ("draws", draws))}
    given = F.struct(pool.alias("pool"), hits.alias("hits"), draws.alias("draws"), *(v.alias(f"{k}_") for k, v in number.items()))

    def ranges(g: Column) -> Column:
        mode = F.floor((g["draws_"] + 1) * (g["hits_"] + 1) / (g["pool_"] + 2))
        spread = F.sqrt(g["draws_"] * (g["hits_"] / g["pool_"]) * (1 - g["hits_"] / g["pool_"]) * (g["pool_"] - g["draws_"]) / F.greatest(g["pool_"] - 1, F.lit(1.0)))
        low, high = F.greatest(F.lit(0).cast("long"), g["draws"] - (g["pool"] - g["hits"])), F.least(g["draws"], g["hits"])
        near = F.least(F.greatest(mode, low), high)
        reach = F.ceil(10 * spread) + 10
        return F.struct(g.alias("g"), near.alias("mode"), F.greatest(low, near - reach).alias("low"), F.least(high, near + reach).alias("high"))

    def picked(r: Column) -> Column:
        g, none = r["g"], F.array().cast("array<bigint>")
        up = F.when(r["high"] > r["mode"], F.sequence(r["mode"], r["high"] - 1)).otherwise(none)
        down = F.when(r["low"] < r["mode"], F.sequence(r["mode"], r["low"] + 1, F.lit(-1).cast("long"))).otherwise(none)

        def above(x: Column) -> Column:
            return (g["hits_"] - x) * (g["draws_"] - x) / ((x + 1) * (g["pool_"] - g["hits_"] - g["draws_"] + x + 1))

        def below(x: Column) -> Column:
            return x * (g["pool_"] - g["hits_"] - g["draws_"] + x) / ((g["hits_"] - x + 1) * (g["draws_"] - x + 1))

        def summed(steps: Column, ratio: Callable[[Column], Column]) -> Column:
            start = F.struct(F.lit(1.0).alias("chance"), F.lit(0.0).alias("sum"))
            return F.aggregate(steps, start, lambda s, x: _let(s["chance"] * ratio(x.cast("double")), lambda c: F.struct(c.alias("chance"), (s["sum"] + c).alias("sum"))), lambda s: s["sum"])

        def walked(steps: Column, start: Column, ratio: Callable[[Column], Column], step: int) -> Column:
            """Goes on until what is left of the uniform number is less than the value's chance."""
            return F.aggregate(
                steps, start,
                lambda s, x: _let(s["chance"] * ratio(x.cast("double")), lambda c: F.struct(c.alias("chance"), (s["left"] - c).alias("left"), F.when(s["found"].isNull() & (s["left"] < c), x + step).otherwise(s["found"]).alias("found"))),
            )

        def start(left: Column, found: Column) -> Column:
            return F.struct(F.lit(1.0).alias("chance"), left.alias("left"), found.alias("found"))

        first = _let(uniform * (1 + summed(up, above) + summed(down, below)), lambda u: start(u - 1, F.when(u < 1, r["mode"])))
        return _let(walked(up, first, above, 1), lambda s: F.coalesce(s["found"], walked(down, start(s["left"], F.lit(None).cast("long")), below, -1)["found"], r["mode"]))

    sure = (draws <= 0) | (hits <= 0) | (hits >= pool) | (draws >= pool)
    return F.when(sure, F.when((draws <= 0) | (hits <= 0), F.lit(0).cast("long")).when(hits >= pool, draws).otherwise(hits)).otherwise(_let(given, lambda g: _let(ranges(g), picked)))


def splitting_tree(spark: SparkSession, quotas: DataFrame, n_shards: int, config: MixConfig = MixConfig()) -> DataFrame:
    """``rank, shard, n``: blocks of each source in each shard, out of ``rank, n``; shards differ by one block at most.

    A node is a row with its shards and its sources' blocks. Each level halves the nodes: source by source, as many go
    left as a hypergeometric draw from what is left of the node's blocks and of the left half's room gives. The
    uniform numbers are hashes of the node and the source, so that reruns agree.
    """
    total = quotas.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long")).first()[0]
    nodes = quotas.where("n > 0").agg(F.sort_array(F.collect_list(F.struct(F.col("rank").cast("long").alias("rank"), "n"))).alias("blocks"))
    nodes = nodes.select(F.lit(0).cast("long").alias("low"), F.lit(n_shards).cast("long").alias("high"), "blocks")

    def first(shard: Column) -> Column:
        """Blocks in all shards before one; in decimals, as the product can leave the range of longs."""
        return F.floor(shard.cast("decimal(19,0)") * F.lit(total).cast("decimal(19,0)") / F.lit(n_shards).cast("decimal(19,0)")).cast("long")

    depth = (n_shards - 1).bit_length()
    for level in range(depth):
        if level == 6:  # one row until here: many enough now to go on in many tasks
            nodes = nodes.repartition("low")
        middle = F.floor((F.col("low") + F.col("high")) / 2)

        def drawn(s: Column, b: Column) -> Column:
            uniform = F.shiftrightunsigned(F.xxhash64(F.lit(config.seed), F.col("low"), F.col("high"), b["rank"]), 11) / F.lit(float(1 << 53))
            taken = hypergeometric(s["pool"], b["n"], s["room"], uniform)
            return _let(taken, lambda x: F.struct((s["pool"] - b["n"]).alias("pool"), (s["room"] - x).alias("room"), F.array_append(s["left"], x).alias("left")))

        start = F.struct((first(F.col("high")) - first(F.col("low"))).alias("pool"), (first(F.col("middle")) - first(F.col("low"))).alias("room"), F.array().cast("array<bigint>").alias("left"))
        split = nodes.withColumn("middle", middle).withColumn("left", F.when(F.col("high") - F.col("low") > 1, F.aggregate("blocks", start, drawn, lambda s: s["left"])))

        def half(low: str, high: str, count: Callable[[Column, Column], Column]) -> Column:
            blocks = F.zip_with("blocks", "left", lambda b, x: F.struct(b["rank"].alias("rank"), count(b["n"], x).alias("n")))
            return F.struct(F.col(low).alias("low"), F.col(high).alias("high"), F.filter(blocks, lambda b: b["n"] > 0).alias("blocks"))

        halves = F.array(half("low", "middle", lambda n, x: x), half("middle", "high", lambda n, x: n - x))
        alone = F.array(F.struct("low", "high", "blocks"))
        nodes = split.select(F.explode(F.when(F.col("left").isNull(), alone).otherwise(halves)).alias("node")).select("node.*")
    return nodes.select(F.col("low").alias("shard"), F.explode("blocks").alias("b")).select(F.col("b.rank").cast("int").alias("rank"), "shard", "b.n")


def _drawn(sizes: DataFrame, plan: DataFrame, config: MixConfig, scratch: Scratch) -> DataFrame:
    """Blocks that are drawn, with ``place`` in the order of their source's draws, and the bucket that they are in."""
    passes = F.sequence(F.lit(1), F.ceil(F.col("quota") / F.col("source_size")).cast("int"))
    block = F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / config.block_words))
    rows = sizes.where("size > 0").join(plan.where("quota > 0").withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    rows = rows.select("doc_id", "rank", "size", "source_size", "quota", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"), passes.alias("passes"))
    rows = rows.withColumn("block", F.explode(block)).withColumn("pass", F.explode("passes")).drop("passes")
    named = F.concat_ws("|", F.lit(str(config.seed)), "pass", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "size", "copy", "block")
    rows = rows.withColumn("key", F.md5(named.cast("binary"))).withColumn("bucket", F.substring("key", 1, config.bucket_digits))
    words = F.least(F.lit(config.block_words).cast("long"), F.col("size") - F.col("block") * config.block_words)
    rows = rows.withColumn("words", words)
    totals = rows.groupBy("rank", "pass", "bucket").agg(F.count("*").alias("n"), F.sum("words").alias("sum"))
    order = Window.partitionBy("rank").orderBy("pass", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("rank", "pass", "bucket", *(F.coalesce(F.sum(c).over(order), F.lit(0)).alias(name) for c, name in (("n", "blocks_before"), ("sum", "words_before"))))
    bases = scratch.write(bases, "buckets")
    inside = Window.partitionBy("rank", "pass", "bucket").orderBy("key", "doc_id", "size", "copy", "block")
    before = F.col("words_before") + F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
    met = rows.join(bases, ["rank", "pass", "bucket"]).withColumns({"place": F.col("blocks_before") + F.row_number().over(inside) - 1, "before": before})
    taken = F.least(F.col("words"), F.col("quota") - F.col("before"))
    return met.where(F.col("before") < F.col("quota")).select("rank", "pass", "bucket", "place", "doc_id", "size", "copy", "block", taken.alias("words"))


def _sharded(drawn: DataFrame, quotas: DataFrame, scratch: Scratch) -> DataFrame:
    """Drawn blocks with the ``shard`` whose run of the source's draws they are in.

    Runs of shards and of buckets both cover a source's draws in order. Laid together, each bucket gets the list of the
    shards that begin in it or before it, with the place where they do; a block looks into its own bucket's list.
    """
    kinds = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("long")
    start = F.sum("n").over(Window.partitionBy("rank").orderBy("shard")) - F.col("n")
    shards = quotas.select("rank", start.alias("at"), "shard", kinds[1].alias("pass"), kinds[0].alias("bucket"))
    buckets = drawn.groupBy("rank", "pass", "bucket").agg(F.min("place").alias("at"))
    events = shards.unionByName(buckets.select("rank", "at", kinds[2].alias("shard"), "pass", "bucket"))
    onwards = Window.partitionBy("rank").orderBy("at", F.asc_nulls_last("shard")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = events.select("rank", "at", *(F.last(c, ignorenulls=True).over(onwards).alias(c) for c in ("shard", "pass", "bucket"))).where("bucket is not null")
    # A list may begin with the bucket before's, of the same place; those are never looked at.
    lists = scratch.write(runs.groupBy("rank", "pass", "bucket").agg(F.sort_array(F.collect_list(F.struct("at", "shard"))).alias("runs")), "runs")
    met = drawn.join(lists, ["rank", "pass", "bucket"])
    begun = F.size(F.filter("runs", lambda r: r["at"] <= F.col("place")))
    return met.withColumn("shard", F.element_at("runs", begun)["shard"]).drop("runs")


def mixed(docs: DataFrame, config: MixConfig = MixConfig(), scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of ``docs`` (``doc_id, source, text``; more columns are not read), the sizes and the plan that it follows.

    The mix has a row for each block that is taken: ``shard``, its ``offset`` in it (from 0), ``doc_id, rank, size,
    copy`` (which document: rows equal in id, source and size are copies 1, 2, ...), ``pass``, ``start`` (the first
    word) and ``words``. Sizes are ``doc_id, source, size, copies``, the plan is that of ``targets``.

    Every row counts, also those that repeat others. Null and empty texts have no words and are never taken; a null
    source is one source, the last. A source with one document gets its target like any other, by cutting it. If
    no text has words, the mix is empty.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mixing")
    sizes = scratch.write(sized(docs), "sizes")
    plan = scratch.write(targets(sizes), "plan")
    drawn = scratch.write(_drawn(sizes, plan, config, scratch), "drawn")
    words = drawn.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    n_shards = max(config.least_shards, -(-words // config.shard_words))
    quotas = scratch.write(splitting_tree(spark, drawn.groupBy("rank").agg(F.count("*").alias("n")), n_shards, config), "quotas")
    placed = _sharded(drawn, quotas, scratch)
    own = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(config.seed), "rank", "place"), "rank", "place")
    mix = placed.select("shard", (F.row_number().over(own) - 1).alias("offset"), "doc_id", "rank", "size", "copy", "pass", (F.col("block") * config.block_words).alias("start"), "words")
    return scratch.write(mix, "mix"), sizes, plan


def mix_report(docs: DataFrame, config: MixConfig = MixConfig(), scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for each row of ``docs``: what the mix takes of it."""
    mix, sizes, plan = mixed(docs, config, scratch)
    ranks = plan.select(F.col("source").alias("of"), "rank", "source_size", "target")
    every = sizes.join(ranks.select("of", "rank"), F.col("source").eqNullSafe(F.col("of")))
    every = every.select("doc_id", "rank", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"), F.lit(0).cast("long").alias("words"))
    taken = every.unionByName(mix.select("doc_id", "rank", "size", "copy", "words")).groupBy("doc_id", "rank", "size", "copy").agg(F.sum("words").alias("taken"))
    return taken.join(ranks.drop("of"), "rank").select("doc_id", "size", "source_size", "target", "taken")


#: The same rows in DuckDB SQL: the plan by going through the sources, and what each source's order gives of a document.
ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) AS copy FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, sum(source_size) OVER () AS total FROM s),
g AS (
  SELECT 0 AS step, source, rank, source_size, weight, total, false AS stops FROM w
  UNION ALL
  SELECT step + 1, source, rank, source_size, weight, total, stops OR left_ * weight > 4 * source_size * rest
  FROM (SELECT *, 3 * total - 4 * coalesce(sum(source_size) FILTER (stops) OVER (), 0) AS left_, sum(weight) FILTER (NOT stops) OVER () AS rest,
      max(step) OVER () AS now FROM g) WHERE step < (SELECT count(*) FROM w)),
e AS (SELECT * FROM g QUALIFY step = max(step) OVER ()),
t AS (
  SELECT source, rank, source_size, CASE WHEN stops THEN 2 * CAST(source_size AS DOUBLE)
    ELSE CAST(3 * total - 4 * coalesce(sum(source_size) FILTER (stops) OVER (), 0) AS DOUBLE) * weight / (2 * sum(weight) FILTER (NOT stops) OVER ()) END AS target FROM e),
q AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM t),
b AS (
  SELECT doc_id, rank, size, copy, pass, block, quota, least(512, size - block * 512) AS words,
    md5(concat_ws('|', '12', pass, coalesce(CAST(doc_id AS VARCHAR), '-'), size, copy, block)) AS key
  FROM (SELECT *, unnest(range((size + 511) // 512)) AS block FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source), (SELECT unnest([1, 2]) AS pass)),
o AS (SELECT *, sum(words) OVER (PARTITION BY rank ORDER BY pass, key, doc_id, size, copy, block ROWS UNBOUNDED PRECEDING) - words AS before FROM b),
k AS (SELECT doc_id, rank, size, copy, sum(greatest(0, least(words, quota - before))) AS taken FROM o GROUP BY ALL)
SELECT c.doc_id, c.size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source
LEFT JOIN k ON k.doc_id IS NOT DISTINCT FROM c.doc_id AND k.rank = q.rank AND k.size = c.size AND k.copy = c.copy
"""

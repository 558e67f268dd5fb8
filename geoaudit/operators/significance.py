"""Monte Carlo significance, ranking and overlap pruning.

In a simulated world every point's outcome is drawn again with the global rate, and regions are scored
against the observed number of positives. A draw belongs to a point, so regions that share points share
draws. Points with the same regions are exchangeable: they are counted together as an atom.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import likelihood_ratio, rounded
from ..sources.written import Rounds
from .places import with_places

MODES = ("binomial", "portable", "fast", "exact")
_ROWS = 1 << 16


def portable_uniform(seed: int, world: Column, point_id: Column) -> Column:
    """A number in [0, 1) from an MD5 digest, the same in any engine and for any layout of rows."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), world.cast("string"), point_id.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def fast_uniform(seed: int, world: Column, point_id: Column) -> Column:
    """The same from a 64-bit hash: much cheaper, and known to Spark alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), world, point_id), 11).cast("double") / F.lit(float(1 << 53))


#: The five primes of the 64-bit xxHash.
_PRIMES = tuple(np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def hashed(value: np.ndarray, state: np.ndarray, size: int) -> np.ndarray:
    """One step of Spark's ``xxhash64`` over numbers of 4 or 8 bytes: what the next column's step starts from."""
    one, two, three, four, five = _PRIMES
    with np.errstate(over="ignore"):
        h = state + five + np.uint64(size)
        if size == 8:
            h = _rotated(h ^ (_rotated(value * two, 31) * one), 27) * one + four
        else:
            h = _rotated(h ^ ((value & np.uint64(0xFFFFFFFF)) * one), 23) * two + three
        h = (h ^ (h >> np.uint64(33))) * two
        h = (h ^ (h >> np.uint64(29))) * three
    return h ^ (h >> np.uint64(32))


class _Totals:
    """Draws of some points by all worlds, added up by region.

    Draws are bytes and are added eight at a time, as numbers of 64 bits, in runs that no byte can overflow in.
    """

    def __init__(self, worlds: int):
        self.worlds, self.width, self.at = worlds, -(-worlds // 8) * 8, {}
        self.counts = np.zeros((0, worlds), np.int64)

    def add(self, drawn: np.ndarray, lists: pa.Array) -> None:
        """``drawn`` has a row of ``width`` bytes for each point, ``lists`` the regions of each."""
        regions = lists.flatten().to_numpy(zero_copy_only=False)
        if not len(regions):
            return
        order = np.argsort(regions, kind="stable")
        point = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))[order]
        names, starts = np.unique(regions[order], return_index=True)
        rows = np.array([self.at.setdefault(name, len(self.at)) for name in names.tolist()])
        if len(self.at) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros((2 * len(self.at) - len(self.counts), self.worlds), np.int64)])
        lanes = drawn.view(np.uint64)
        for row, low, high in zip(rows.tolist(), starts.tolist(), [*starts[1:].tolist(), len(point)]):
            for first in range(low, high, 255):
                sums = lanes[point[first : min(high, first + 255)]].sum(axis=0, dtype=np.uint64)
                self.counts[row] += sums.view(np.uint8)[: self.worlds]

    def batch(self) -> pa.RecordBatch:
        counts = self.counts[: len(self.at)]
        ends = np.arange(len(self.at) + 1, dtype=np.int32) * self.worlds
        return pa.RecordBatch.from_arrays([pa.array(list(self.at), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(counts.ravel()))], names=["region_id", "counts"])


def _uniforms_below(ids: np.ndarray, states: np.ndarray, chance: float, width: int) -> np.ndarray:
    """Whether ``fast_uniform`` is below ``chance``: a row of bytes for each id, a column for each world."""
    out = np.zeros((len(ids), width), np.uint8)
    for first in range(0, len(ids), 256):  # so much stays in the cache
        some = hashed(ids[first : first + 256, None], states[None, :], 8)
        out[first : first + 256, : len(states)] = (some >> np.uint64(11)).astype(np.float64) / float(1 << 53) < chance
    return out


def _drawn_at_once(points: DataFrame, worlds: int, chance: float, seed: int, mode: str = "fast") -> DataFrame:
    """``world, region_id, p``: the draws of ``fast_uniform`` or ``portable_uniform``, all worlds of a point together.

    Where points have hardly two in the same regions, atoms save nothing, and a row for each point and world is what
    costs. Here a point's regions are gone through once: a task draws a matrix of some points by all worlds, and adds
    the rows of each region's points. It gives on one count for each region and world that it has met.
    """
    states = hashed(np.arange(worlds).astype(np.uint64), hashed(np.array([seed & 0xFFFFFFFF], np.uint64), np.array([42], np.uint64), 4), 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = _Totals(worlds)
        step = max(1, (_ROWS << 6) // worlds)
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                some = batch.slice(first, step)
                if mode == "fast":
                    ids = some.column("point_id").cast(pa.int64()).to_numpy(zero_copy_only=False).view(np.uint64)
                    drawn = _uniforms_below(ids, states, chance, totals.width)
                else:
                    drawn = np.zeros((some.num_rows, totals.width), np.uint8)
                    drawn[:, :worlds] = some.column("drawn").flatten().to_numpy(zero_copy_only=False).reshape(-1, worlds)
                totals.add(drawn, some.column("region_ids"))
        yield totals.batch()

    own = "point_id"
    if mode == "portable":
        own = F.transform(F.sequence(F.lit(0), F.lit(worlds - 1)), lambda w: portable_uniform(seed, w, F.col("point_id")) < F.lit(chance)).alias("drawn")
    rows = points.select(own, "region_ids").mapInArrow(run, "region_id long, counts array<long>")
    return rows.select("region_id", F.posexplode("counts").alias("world", "n")).groupBy("world", "region_id").agg(F.sum("n").alias("p"))


def _drawn_by_atom(points: DataFrame, worlds: int, chance: float, seed: int) -> DataFrame:
    """The same in distribution, one binomial draw for each atom and world: the points need not be gone through
    again for each world. Draws are seeded by the atom, so they do not hang on the layout of rows."""
    atoms = points.groupBy("region_ids").agg(F.count("*").alias("m")).withColumn("key", F.xxhash64("region_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, _ROWS // worlds)
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                some = batch.slice(first, step)
                keys, sizes = (some.column(c).to_pylist() for c in ("key", "m"))
                drawn = [np.random.default_rng([seed, key & (1 << 63) - 1]).binomial(m, chance, worlds) for key, m in zip(keys, sizes)]
                world = np.tile(np.arange(worlds, dtype=np.int32), len(keys))
                ids = some.column("region_ids").take(pa.array(np.repeat(np.arange(len(keys)), worlds)))
                yield pa.RecordBatch.from_arrays([pa.array(world), ids, pa.array(np.concatenate(drawn))], names=["world", "region_ids", "drawn"])

    return atoms.mapInArrow(run, "world int, region_ids array<long>, drawn long")


def _drawn_exactly(points: DataFrame, worlds: int, n: int, chance: float, seed: int, block: int = 8) -> DataFrame:
    """One stream of numpy's PCG64 over worlds and points 0..n-1 in order, as a single process would draw it.

    Each row of points advances the generator to its place in each world, so nothing is gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("point_id").to_numpy()
            order = np.argsort(ids)
            starts = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) != 1])) if len(ids) else []
            drawn = np.empty((worlds, len(ids)), np.int64)
            for b, e in zip(starts, [*starts[1:], len(ids)]):
                for world in range(worlds):
                    bits = np.random.PCG64(seed).advance(world * n + int(ids[order[b]]))
                    drawn[world, order[b:e]] = np.random.Generator(bits).binomial(1, chance, e - b)
            for low in range(0, worlds, block):
                world, at = np.nonzero(drawn[low : low + block])
                yield pa.RecordBatch.from_arrays([pa.array(world + low, pa.int32()), batch.column("region_ids").take(pa.array(at)), pa.array(np.ones(len(at), np.int64))], names=["world", "region_ids", "drawn"])

    rows = points.select("point_id", "region_ids").mapInArrow(run, "world int, region_ids array<long>, drawn long")
    return rows.groupBy("world", "region_ids").agg(F.sum("drawn").alias("drawn"))


def world_maxima(points: DataFrame, regions: DataFrame, total: int, positive: int, worlds: int, seed: int, mode: str = "binomial", nested: int = 0) -> DataFrame:
    """``world, max_sul``: the largest score of each simulated world.

    ``points`` has ``point_id`` and ``region_ids``, ``regions`` has ``region_id`` and ``n``. No rows without
    worlds or regions. With ``nested``, that many regions in a row (by region_id, from 0) lie each in the next
    one, ``region_ids`` name only the innermost of them, and draws are summed outwards.
    """
    if mode not in MODES:
        raise ValueError(f"Unknown mode {mode!r}; known: {', '.join(MODES)}")
    spark = points.sparkSession
    if worlds <= 0:
        return spark.createDataFrame([], "world int, max_sul double")
    chance = positive / total if total else 0.0
    inside = points.where(F.size("region_ids") > 0)
    if mode in ("fast", "portable"):
        by_region = _drawn_at_once(inside, worlds, chance, seed, mode)
    else:
        drawn = _drawn_by_atom(inside, worlds, chance, seed) if mode == "binomial" else _drawn_exactly(inside, worlds, total, chance, seed)
        by_region = drawn.select("world", F.explode("region_ids").alias("region_id"), "drawn").groupBy("world", "region_id").agg(F.sum("drawn").alias("p"))
    every = regions.select("region_id", "n").crossJoin(F.broadcast(spark.range(worlds).select(F.col("id").cast("int").alias("world"))))
    counted = every.join(by_region, ["world", "region_id"], "left").na.fill({"p": 0})
    if nested:
        outwards = Window.partitionBy("world", F.floor(F.col("region_id") / nested)).orderBy("region_id").rowsBetween(Window.unboundedPreceding, 0)
        counted = counted.withColumn("p", F.sum("p").over(outwards))
    score = rounded(likelihood_ratio(F.col("n"), F.col("p"), F.lit(total).cast("long"), F.lit(positive).cast("long")))
    return counted.groupBy("world").agg(F.max(score).alias("max_sul"))


def threshold_rank(worlds: int, level: float) -> int:
    """The place, from 0 and from the largest, of the world whose maximum is the threshold."""
    return min(int(level * worlds), worlds - 1)


def threshold(maxima: DataFrame, worlds: int, level: float) -> DataFrame:
    """One row, ``threshold``: the world maximum at the significance level; 0 without worlds or regions."""
    place = threshold_rank(worlds, level) + 1 if worlds > 0 else 1
    top = F.sort_array(F.collect_list("max_sul"), asc=False)  # one number for each world
    return maxima.agg(F.coalesce(F.try_element_at(top, F.lit(place)), F.lit(0.0)).alias("threshold"))


def significant(scores: DataFrame, limit: DataFrame) -> DataFrame:
    """Regions at or above the threshold with their ``rank`` from 1; of equals, the later region comes first."""
    kept = scores.crossJoin(F.broadcast(limit)).where("sul >= threshold").drop("threshold")
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("sul"), F.desc("region_id"))))


def boxes_meet(a: Column, b: Column) -> Column:
    """Whether two boxes (structs with ``lon_min`` to ``lat_max``) have a point in common; edges count."""
    return (a["lon_max"] >= b["lon_min"]) & (b["lon_max"] >= a["lon_min"]) & (a["lat_max"] >= b["lat_min"]) & (b["lat_max"] >= a["lat_min"])


_BOX = ("lon_min", "lat_min", "lon_max", "lat_max")


def overlapping_pairs(regions: DataFrame) -> DataFrame:
    """Pairs of regions that meet, ``a < b`` by region_id.

    Boxes are joined within squares of the widest box's side, which each box touches a few of; a pair counts
    in the square of its common part's lower left corner alone.
    """
    widest = regions.agg(F.max(F.greatest(F.col("lon_max") - F.col("lon_min"), F.col("lat_max") - F.col("lat_min")))).first()[0]
    side = widest if widest else 1.0

    def square(x: Column) -> Column:
        return F.floor(x / F.lit(side))

    laid = regions.select("region_id", F.struct(*_BOX).alias("box"))
    for axis in ("lon", "lat"):
        laid = laid.withColumn(f"at_{axis}", F.explode(F.sequence(square(F.col(f"box.{axis}_min")), square(F.col(f"box.{axis}_max")))))
    one, two = (laid.withColumnsRenamed({"region_id": name, "box": f"box_{name}"}) for name in ("a", "b"))
    both = one.join(two, ["at_lon", "at_lat"]).where((F.col("a") < F.col("b")) & boxes_meet(F.col("box_a"), F.col("box_b")))
    corner = (square(F.greatest(f"box_a.{x}_min", f"box_b.{x}_min")) == F.col(f"at_{x}") for x in ("lon", "lat"))
    return both.where(next(corner) & next(corner)).select("a", "b")


def _touched(boxes: DataFrame, levels: list[int]) -> DataFrame:
    """Boxes by the squares that they touch: of their own level (``own``) and of each coarser one that has boxes."""
    upper = boxes.withColumn("lv", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col("level")))).withColumn("own", F.col("lv") == F.col("level"))
    for axis in ("lon", "lat"):
        ends = (F.floor(F.col(f"{axis}_{end}") / F.pow(F.lit(2.0), F.col("lv"))) for end in ("min", "max"))
        upper = upper.withColumn(f"at_{axis}", F.explode(F.sequence(*ends)))
    return upper


_SQUARE = ("lv", "at_lon", "at_lat")


def pruned(ranked: DataFrame) -> DataFrame:
    """Ranked boxes without those that meet a box kept before them; ``kept_rank`` from 1.

    A box's fate hangs on those ranked before it that it meets, so all boxes that come first in every square that
    they touch are kept at once, those that meet them go, and the rest has another round. Squares are as wide as
    the boxes, a power of two, so that few boxes touch one without meeting; a box looks into the squares of its own
    width and of wider boxes, and is seen there by these. A round joins each box with at most one kept box of a
    square, never all that meet with each other. Ranks are different; boxes with null sides take no part.
    """
    rounds = Rounds(ranked.sparkSession, "pruned")
    side = F.greatest(F.col("lon_max") - F.col("lon_min"), F.col("lat_max") - F.col("lat_min"))
    level = F.ceil(F.log2(F.greatest(side, F.lit(2.0**-40)))).cast("int")
    left = rounds.kept(ranked.select("rank", *_BOX, level.alias("level")).where(level.isNotNull()))
    winners = None
    while True:
        levels = sorted(r[0] for r in left.select("level").distinct().collect())  # powers of two
        if not levels:
            break
        looks = _touched(left, levels)
        first = looks.groupBy(*_SQUARE).agg(F.min("rank").alias("first"), F.min(F.when(F.col("own"), F.col("rank"))).alias("first_own"))
        # Another box counts in a square if either of the two is as wide as it.
        behind = looks.join(first, list(_SQUARE)).where(F.when(F.col("own"), F.col("first")).otherwise(F.col("first_own")) < F.col("rank"))
        now = rounds.kept(left.join(behind.select("rank").distinct(), "rank", "left_anti"))
        kept = _touched(now, levels).select(*_SQUARE, F.col("own").alias("wide"), F.struct(*_BOX).alias("kept"))
        gone = looks.join(kept, list(_SQUARE)).where((F.col("own") | F.col("wide")) & boxes_meet(F.struct(*_BOX), F.col("kept")))
        left = rounds.kept(left.join(gone.select("rank").distinct(), "rank", "left_anti"))
        winners = now if winners is None else winners.unionByName(now)
    if winners is None:
        return ranked.limit(0).withColumn("kept_rank", F.lit(0))
    places = with_places(winners.select("rank"), [F.asc("rank")], rounds)
    return ranked.join(places, "rank").withColumn("kept_rank", (F.col("place") + 1).cast("int")).drop("place")

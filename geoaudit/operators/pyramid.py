"""One count of the points, seen at every scale: how much an audit hangs on the size of its cells.

The extent is halved again and again along both axes, so that the cells of a level are quarters of those of the
one before: half-open, the last ones closed, and every point in one of them. Points are counted once, at the finest
level, by the place of their cell in Z-order; a cell's ancestors are that number without its last bits. All
coarser levels come from those counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import rate, rounded
from ..sources.points import Profile, profile
from ..sources.written import Rounds
from .scan import scored

#: The bits of a key are those of a column and a row in turn, 31 of each at most.
MOST_LEVELS = 31


def _spread(x: Column) -> Column:
    """The bits of a number of 31 bits, with a zero between every two."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def z_order(j: Column, i: Column) -> Column:
    """The place of column ``j`` and row ``i`` in Z-order: bits of the column first, from the last."""
    return _spread(j.cast("long")).bitwiseOR(F.shiftleft(_spread(i.cast("long")), 1))


def with_finest(points: DataFrame, p: Profile, levels: int) -> DataFrame:
    """Points with ``j, i`` at the finest level; a flat extent has its points in the first column or row."""
    if not 0 <= levels <= MOST_LEVELS:
        raise ValueError(f"0 to {MOST_LEVELS} levels")

    def place(x: str, low: float | None, high: float | None) -> Column:
        if low is None or high == low:
            return F.lit(0).cast("long")
        return F.least(F.floor((F.col(x) - F.lit(low)) / (F.lit(high) - F.lit(low)) * float(1 << levels)), F.lit((1 << levels) - 1)).cast("long")

    return points.withColumns({"j": place("lon", p.lon_min, p.lon_max), "i": place("lat", p.lat_min, p.lat_max)})


def pyramid(points: DataFrame, levels: int, p: Profile | None = None) -> DataFrame:
    """``level, cell, j, i, n, p, rho, sul`` of each cell that has points, from level 0 (one cell) to ``levels``.

    ``cell`` is the cell's number in Z-order on its level. Points are shuffled as each task's counts of finest
    cells; the levels above are sums over those. No points give no cells.
    """
    p = p or profile(points)
    finest = with_finest(points, p, levels).groupBy("j", "i").agg(F.count("*").alias("n"), F.sum(F.col("outcome").cast("long")).alias("p"))
    finest = Rounds(points.sparkSession, "pyramid").kept(finest.withColumn("key", z_order(F.col("j"), F.col("i"))))
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    up = f"{levels} - level"
    cells = finest.select(level, "key", "j", "i", "n", "p").select("level", F.expr(f"shiftright(key, 2 * ({up}))").alias("cell"), F.expr(f"shiftright(j, {up})").alias("j"), F.expr(f"shiftright(i, {up})").alias("i"), "n", "p")
    rows = cells.groupBy("level", "cell").agg(F.first("j").alias("j"), F.first("i").alias("i"), F.sum("n").alias("n"), F.sum("p").alias("p"))
    return scored(rows, p.n, p.p)


def scales(cells: DataFrame) -> DataFrame:
    """A row for each level of a pyramid: how the outcome's variance divides between and within its cells.

    ``occupied`` cells, ``meanvar`` (variance of the cells' rates, each counting for one), ``between`` (of the points'
    variance, what the cells' rates explain, weighted by their points), ``within`` (the rest), ``explained`` (the
    share of the first), and the largest score with its cell, the first of equals.
    """
    exact = rate(F.col("p"), F.col("n"))
    rows = cells.groupBy("level").agg(
        F.count("*").alias("occupied"), F.sum("n").alias("points"), F.sum("p").alias("positive"), rounded(F.var_pop("rho")).alias("meanvar"),
        F.sum(F.col("n") * exact * exact).alias("squares"), F.max("sul").alias("max_sul"), F.max_by("cell", F.struct("sul", -F.col("cell"))).alias("best_cell"),
    )
    mean = rate(F.col("positive"), F.col("points"))
    between = F.greatest(F.lit(0.0), F.col("squares") / F.col("points") - mean * mean)
    whole = mean * (1 - mean)
    return rows.select(
        "level", "occupied", "meanvar", rounded(between).alias("between"), rounded(F.greatest(F.lit(0.0), whole - between)).alias("within"),
        rounded(F.try_divide(between, whole)).alias("explained"), "max_sul", "best_cell",
    )


def sensitivity(levels: DataFrame) -> DataFrame:
    """One row over the levels of ``scales``: how far the answer moves with the scale alone.

    Mean, spread and their ratio (coefficient of variation) of ``meanvar`` and of the largest score, and the levels at
    which each is largest, the coarsest of equals. The level of one cell, on which nothing varies, is left out.
    """
    rows = levels.where("level > 0")

    def told(c: str) -> list[Column]:
        mean, spread = F.avg(c), F.stddev_pop(c)
        return [rounded(mean).alias(f"{c}_mean"), rounded(spread).alias(f"{c}_spread"), rounded(F.try_divide(spread, mean)).alias(f"{c}_variation"), F.max_by("level", F.struct(F.col(c), -F.col("level"))).alias(f"{c}_level")]

    return rows.agg(F.count("*").alias("levels"), *told("meanvar"), *told("max_sul"))


def stability(cells: DataFrame, levels: int) -> DataFrame:
    """``cell, n, above, below, agreement, rho_min, rho_max`` of each cell of the finest level of a pyramid.

    On how many levels the cell's ancestors (itself among them, the one cell of level 0 not) have a rate above and
    below that of all points; ``agreement`` is the larger of both over all levels: 1 where a region is told the same
    way at every scale. A finding that is an artefact of one grid does not agree with the others.
    """
    finest = cells.where(F.col("level") == levels).select("cell", "n")
    whole = cells.where("level = 0").select(rate(F.col("p"), F.col("n")).alias("mean"))
    looks = finest.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels)))) if levels else finest.withColumn("level", F.lit(0)).where("false")
    looks = looks.withColumn("upper", F.expr(f"shiftright(cell, 2 * ({levels} - level))"))
    upper = cells.select("level", F.col("cell").alias("upper"), "rho", rate(F.col("p"), F.col("n")).alias("exact"))
    met = looks.join(upper, ["level", "upper"]).crossJoin(F.broadcast(whole))
    rows = met.groupBy("cell").agg(
        F.first("n").alias("n"), F.count(F.when(F.col("exact") > F.col("mean"), 1)).alias("above"), F.count(F.when(F.col("exact") < F.col("mean"), 1)).alias("below"),
        F.min("rho").alias("rho_min"), F.max("rho").alias("rho_max"),
    )
    return rows.select("cell", "n", "above", "below", rounded(F.greatest("above", "below") / F.lit(float(max(levels, 1)))).alias("agreement"), "rho_min", "rho_max")

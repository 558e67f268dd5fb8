"""Communities of a weighted graph by Louvain's method (Blondel and others 2008), as joins over its edges.

A level moves nodes between communities while modularity grows, then makes each community one node, and goes on. Weights
are whole numbers and gains are compared exactly, so that the result is the same for any layout. Many nodes move at
once: first every node that gains goes to the best community around it, if that one's name is less than its own, so that
no two change places; if modularity has not grown by that, only moves of which no two touch the same community are made,
whose gains add up. So modularity never falls. State is written after each round: a row for each node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.written import Rounds

_EXACT = "decimal(38,0)"


def _big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(_EXACT)


def _both_ways(edges: DataFrame) -> DataFrame:
    """Edges (``a, b, w``, each pair once, loops too) as links both ways; a loop counts twice, as both its ends are there."""
    ways = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return ways.groupBy("a", "b").agg(F.sum("w").alias("w"))


def modularity_parts(links: DataFrame, own: DataFrame) -> tuple[int, int]:
    """Numerator and denominator of the modularity of ``own`` (``node, c``): links inside communities beyond what degrees alone give."""
    met = links.join(own.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(own.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b")
    each = met.groupBy("ca").agg(F.sum("w").alias("all"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(F.lit(0))).alias("inside"))
    whole = F.col("all").cast("decimal(19,0)")
    row = each.agg(F.sum("all").alias("m2"), F.sum("inside").alias("inside"), F.sum((whole * whole).cast(_EXACT)).alias("squares")).first()
    m2 = row.m2 or 0
    return (m2 * row.inside - int(row.squares), m2 * m2) if m2 else (0, 1)


def _moved(links: DataFrame, own: DataFrame, m2: int, alone: bool) -> DataFrame:
    """``node, to``: the moves of a round. Of gains only differences count, so they come as whole numbers (times m2 squared by 2)."""
    degree = links.groupBy("a").agg(F.sum("w").alias("k")).withColumnRenamed("a", "node")
    held = own.join(degree, "node")
    total = held.groupBy("c").agg(F.sum("k").alias("total"))
    around = links.where("a <> b").join(own.select(F.col("node").alias("b"), F.col("c").alias("to")), "b").groupBy(F.col("a").alias("node"), "to").agg(F.sum("w").alias("w"))
    mine = around.join(own, "node")
    home = mine.where("to = c").select("node", F.col("w").alias("home"))
    tried = mine.where("to <> c").join(held.select("node", "k"), "node").join(home, "node", "left").na.fill({"home": 0})
    tried = tried.join(total.withColumnRenamed("c", "to").withColumnRenamed("total", "there"), "to").join(total.withColumnRenamed("total", "here"), "c")
    gain = F.lit(m2).cast(_EXACT) * (F.col("w") - F.col("home")) - _big("k") * (F.col("there") - F.col("here") + F.col("k"))
    tried = tried.withColumn("gain", gain).where("gain > 0")
    if not alone:
        tried = tried.where("to < c")
    # The largest gain, of equal ones the community of the least name.
    best = tried.groupBy("node").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "to", "c")).alias("m")).select("node", "m.*")
    if not alone:
        return best.select("node", "to")
    touched = best.withColumn("touches", F.explode(F.array("to", "c"))).groupBy("touches").agg(F.min(F.struct("loss", "node")).alias("first"))
    first = best.join(touched.select(F.col("touches").alias("to"), F.col("first.node").alias("one")), "to").join(touched.select(F.col("touches").alias("c"), F.col("first.node").alias("two")), "c")
    return first.where("one = node and two = node").select("node", "to")


def _level(links: DataFrame, rounds: Rounds) -> tuple[DataFrame, int, list[tuple[int, int]]]:
    """Communities of one level: every node, the rounds in which nodes moved, and the modularity after each."""
    own = rounds.kept(links.select(F.col("a").alias("node")).distinct().withColumn("c", F.col("node")))
    m2 = int(links.agg(F.sum(_big("w"))).first()[0])
    known, moves = [modularity_parts(links, own)], 0
    while True:
        for alone in (False, True):
            moved = _moved(links, own, m2, alone)
            new = rounds.kept(own.join(moved, "node", "left").select("node", F.coalesce("to", "c").alias("c")))
            value = modularity_parts(links, new)
            if value[0] > known[-1][0]:
                break
        else:
            # Names of communities are their least nodes.
            least = own.groupBy("c").agg(F.min("node").alias("least"))
            return rounds.kept(own.join(least, "c").select("node", F.col("least").alias("c"))), moves, known
        own, moves = new, moves + 1
        known.append(value)


def louvain(edges: DataFrame, levels: int = 20) -> tuple[DataFrame, list[float]]:
    """``node, community`` of each node of ``edges`` (``a, b, w``: each pair once, whole weights), and the modularity along the way.

    A community is named by its least node. Edges that are repeated add up, weights that are null or not above 0 are
    left out, and so are nodes without any other. It ends when a level moves no node, or after ``levels``.
    """
    rounds = Rounds(edges.sparkSession, "louvain")
    links = rounds.kept(_both_ways(edges.where("w > 0").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("w").cast("long").alias("w"))))
    whole = links.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
    values: list[float] = []
    if links.isEmpty():
        return whole, values
    for _ in range(levels):
        own, moves, known = _level(links, rounds)
        values += [n / d for n, d in known[1 if values else 0 :]]
        if not moves:
            break
        whole = rounds.kept(whole.join(own.select(F.col("node").alias("community"), "c"), "community").select("node", F.col("c").alias("community")))
        named = own.select(F.col("node").alias("a"), F.col("c").alias("ca"))
        met = links.join(named, "a").join(own.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b")
        links = rounds.kept(met.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
    return whole, values


def cell_graph(cells: DataFrame) -> DataFrame:
    """``a, b, w``: neighbouring cells (``id, j, i, n``; edges and corners), weighed by the points of the one that has fewer."""
    steps = F.array(*(F.struct((F.col("j") + x).alias("j"), (F.col("i") + y).alias("i")) for x, y in ((1, 0), (0, 1), (1, 1), (1, -1))))
    looks = cells.select(F.col("id").alias("a"), F.col("n").alias("na"), F.explode(steps).alias("to")).select("a", "na", "to.*")
    met = looks.join(cells.select(F.col("id").alias("b"), F.col("n").alias("nb"), "j", "i"), ["j", "i"])
    return met.select("a", "b", F.least("na", "nb").cast("long").alias("w")).where("w > 0")

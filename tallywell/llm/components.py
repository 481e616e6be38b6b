"""Connected components of a link table by alternating star contraction, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywell.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of every node move to the least node of its neighbourhood."""
    both = links.union(links.select("b", "a").toDF("a", "b"))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them. Links run from larger to smaller."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a != b")
    return moved.union(least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``links (a, b)``, two longs: the least node connected to it.
    ``links`` is read twice, so it should be a stored table.

    A step is two groupings with map-side combining and two joins, whatever the degree of a
    node; the number of steps grows with the logarithm of a component's diameter.
    """
    links = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    state = None
    while True:
        links = stored(_small_star(stored(_large_star(links), "large")), "small")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if now == state or now[0] == 0:
            break
        state = now
    roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)

"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormrail.llm.common import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One round: link each node's larger (``large``) or smaller neighbours to the smallest of all of them."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = links
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    near = both.join(least, both.a == least.u)
    if large:
        moved = near.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return moved.filter("a != b").distinct()


def _is_settled(links: DataFrame) -> bool:
    """Whether the links are trees of depth one: each node has one link, and no link ends in a node that has one."""
    ends = links.groupBy("a").agg(F.count("*").alias("n"), F.lit(0).alias("m")).union(
        links.groupBy("b").agg(F.lit(0), F.lit(1)))
    worst = ends.groupBy("a").agg((F.sum("n") + F.sum("m")).alias("x")).agg(F.max("x")).first()[0]
    return worst is None or worst < 2


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns ``a`` and ``b``): ``root`` is the smallest node that it is
    connected with.

    Each pair of rounds at least halves the depth of the trees, so the number of rounds grows with the logarithm of
    the longest chain. A node with a great many neighbours takes part in plain equi-joins and partial aggregates
    only. Nulls and self links are left out; an empty table gives an empty result.
    """
    now = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:
        now = written(_star(_star(now, True), False), "links", slim=True)
        if _is_settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

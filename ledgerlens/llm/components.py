"""Connected components of a graph of links, by alternating large and small stars.

Each round replaces links by links to the smallest neighbour; both kinds of star keep the components, and the rounds end
when no link changes, after a number of rounds that grows with the logarithm of the longest chain. The smallest
neighbour is an aggregate that Spark combines before the shuffle, and the join that follows may be split where a node
has many links, so one large component takes no task to itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Tables


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.u", "x.v")


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of the node and its neighbours."""
    ways = _both_ways(links)
    least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return ways.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them; links run from smaller a to larger b."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    return links.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))


def _tidy(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links: columns a and b, of one ordered type. Returns node, component for every node with a link to another; component is the smallest node reached."""
    tables, step = Tables(links.sparkSession), 0
    now, mark = tables.store("links0", _tidy(links)), None
    while True:
        step += 1
        new = tables.store(f"links{step}", _tidy(_small_star(_tidy(_large_star(now)))))
        tables.drop(f"links{step - 1}")
        now, seen = new, new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
    return now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())

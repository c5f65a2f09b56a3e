"""Connected components of a link table, by alternating star contraction over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import settled


def components(links: DataFrame) -> DataFrame:
    """The smallest node that each linked node can reach: (node, root), for links (a, b) between long nodes.

    Each round points every node's larger neighbours at its smallest one, then every node's smaller neighbours at
    the smallest of them, until all are stars; rounds are settled in the shared folder. A node that many others link
    to is summed map-side before the shuffle, and only joined with its one smallest neighbour. Nodes without links
    have no row. Loops, repeated links and null ends are dropped.
    """
    found = settled(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b and a is not null and b is not null").distinct())
    while not _stars(found):
        both = found.unionAll(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.greatest("b", "m").alias("x"), "m", "a")
        found = settled(small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
    return found.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _stars(found: DataFrame) -> bool:
    """Whether every node points at one other, and none that is pointed at points on."""
    ends = found.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(found.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    wrong = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out > 0 and into > 0)")
    return not wrong.limit(1).count()

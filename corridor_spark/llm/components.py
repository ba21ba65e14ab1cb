"""Connected components of a table of links by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor_spark.llm.common import discard, stage


def _large_star(links: DataFrame) -> DataFrame:
    """Every node sends its larger neighbours to the smallest of its neighbourhood."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node sends its smaller neighbours, and itself, to the smallest of them; links point to the smaller node."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``a, b``: each linked node but the smallest, and its component's smallest node.

    ``links`` has columns a and b of one orderable type. Each round halves the
    trees' depth about; it ends when a round changes nothing, which sums of the
    links' hashes tell.
    """
    now = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now
        seen, last = state, now
        now = stage(_small_star(_large_star(last)), "links")
        discard(last)

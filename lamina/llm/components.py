"""Connected components of a link table, by alternating large and small stars; state lives in written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (its two columns) that is not its component's smallest.

    Each round hangs larger neighbours on the smallest node in sight (large star), then smaller ones
    (small star); the rounds grow with the logarithm of the component. Neither gathers a node's neighbours:
    both are a minimum per node, combined before the shuffle, joined back to the links.
    """
    a, b = links.columns
    now = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct()
    now, before = materialize(now, "links"), None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        if seen == before or not seen["n"]:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("lo"), F.least("u", "m").alias("m"))
        large = now.join(least, "lo").select("hi", F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = materialize(small.union(least).distinct(), "links")
        discard(now)
        now, before = after, seen

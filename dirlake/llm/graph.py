"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirlake.llm.common import scratch, work_table


def components(links: DataFrame) -> DataFrame:
    """(node, component): for each end of the links (a, b), the smallest node it reaches.

    Each round hangs neighbours under the smallest node in sight (large star, then small star); the rounds, a
    logarithm of the longest path, end when the links no longer change. Hot nodes are pre-aggregated minima and
    joins whose large side may be split. Self links and repeated links do no harm.
    """
    with scratch():
        stars = work_table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        mark = None
        while True:
            both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            hung = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            lowest = hung.groupBy("u").agg(F.min("v").alias("m"))
            joined = hung.join(lowest, "u")
            # a node's other, larger neighbours move under the smallest one; the node itself is under it already
            stars = work_table(joined.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct())
            now = stars.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
            if tuple(now) == mark:
                return work_table(stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select("v", "v").distinct()), keep=True)
            mark = tuple(now)

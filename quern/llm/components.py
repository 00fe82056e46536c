"""Connected components by alternating large-star and small-star steps; nothing reaches the driver but sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, write_table


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node in the links a, b; roots aren't listed.

    Every step is written to the shared folder, so lost executors cost one step. The number of steps grows
    with the logarithm of the longest path.
    """
    up = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, at = write_table(spark, up, "stars")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if not now["n"] or (now["n"], now["s"]) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = (now["n"], now["s"])
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(least, F.col("u") == F.col("k"))
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("k", "m")).distinct()
        last = at
        edges, at = write_table(spark, small, "stars")
        drop_table(spark, last)

"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltlab.session import staged

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; the root is the smallest node of its component.

    Every round keeps components and pulls nodes towards their roots; a logarithmic number of rounds
    suffices. Joins on hot nodes are plain equi-joins that Spark can split. No edge gives no row.
    """
    spark = edges.sparkSession
    small = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct()
    small = staged(small)
    seen = None
    for _ in range(MAX_ROUNDS):
        mark = tuple(small.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(20,0)"))).first())
        if mark == seen:
            return small.select(F.col("v").alias("node"), F.col("m").alias("root")).unionByName(
                small.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct()
            )
        seen = mark
        both = small.unionByName(small.select(F.col("m").alias("v"), F.col("v").alias("m")))
        low = both.groupBy("v").agg(F.min("m").alias("low")).select(F.col("v").alias("u"), F.least("v", "low").alias("low"))
        large = both.join(low, F.col("v") == F.col("u")).where("m > v").select(F.col("m").alias("v"), F.col("low").alias("m"))
        large = large.where("v <> m").distinct()
        low = large.groupBy("v").agg(F.min("m").alias("low")).withColumnRenamed("v", "u")
        step = large.join(low, F.col("v") == F.col("u")).select(F.explode(F.array(F.struct("v", "low"), F.struct(F.col("m").alias("v"), "low"))).alias("e"))
        small = staged(step.select(F.col("e.v").alias("v"), F.col("e.low").alias("m")).where("v <> m").distinct())
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")

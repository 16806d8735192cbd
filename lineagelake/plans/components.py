"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import resettled, settle
from .skew import counted_join


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every end of ``edges(u, v)``: the least node that is reachable. Goes on until all are stars; large stars are in no one task."""

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))

    def all_stars(e: DataFrame) -> bool:  # no node has two partners below it, or is itself below another
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), "v").unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(None).cast(e.schema["v"].dataType).alias("v")))
        return ends.groupBy("n").agg(F.max("up").alias("a"), F.min("up").alias("b"), F.min("v").alias("c"), F.max("v").alias("d")).filter("a <> b or c <> d").isEmpty()

    e = resettled(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    while not all_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = settle(least(both).select("u", F.least("u", "m").alias("m"), "n"))
        e = resettled(counted_join(both, low, "u", "n", 2 * e.count()).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = settle(least(e))
        near = counted_join(e, low, "u", "n", e.count()).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = resettled(near.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())

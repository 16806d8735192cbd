"""Layers of facts as partitions on disk: one is replaced or deleted without the others being written.

A layer is a value of the partition columns, say of provenance and source reference. A null value is a layer of its own.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE_LAYER = ["provenance", "src_ref"]
_NONE = "__HIVE_DEFAULT_PARTITION__"


def rebuild(rows: DataFrame, path: str, by: list[str] = EDGE_LAYER) -> None:
    """Writes all layers anew; what was there goes."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(path)


def replace(rows: DataFrame, path: str, by: list[str] = EDGE_LAYER) -> None:
    """Writes the layers that ``rows`` has, in the place of those there; others keep their files. A layer without rows stays: see :func:`delete`."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """All layers with columns as in ``schema``; a filter on a layer's columns reads only its files."""
    return spark.read.schema(schema).parquet(path).select(*[c.name for c in schema])


def _folders(spark: SparkSession, path: str, by: list[str]) -> list[tuple[dict[str, str | None], str]]:
    """The layers there are and their folders."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(path + "/" + "/".join(f"{c}=*" for c in by))) or []
    out = []
    for status in found:
        full = status.getPath().toString()
        parts = [unquote(p.partition("=")[2]) for p in full.split("/")[-len(by) :]]
        out.append(({c: None if v == _NONE else v for c, v in zip(by, parts, strict=True)}, full))
    return out


def delete(spark: SparkSession, path: str, by: list[str] = EDGE_LAYER, **layer: str | None) -> int:
    """Deletes the layers whose columns have the given values, and says how many; a column that isn't given may have any."""
    jvm, gone = spark.sparkContext._jvm, 0
    for values, full in _folders(spark, path, by):
        if all(values[c] == v for c, v in layer.items()):
            folder = jvm.org.apache.hadoop.fs.Path(full)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
            gone += 1
    return gone


def layers(spark: SparkSession, path: str, by: list[str] = EDGE_LAYER) -> list[dict[str, str | None]]:
    """The layers there are, from the folders' names alone."""
    return sorted((v for v, _ in _folders(spark, path, by)), key=str)


def reapply(rows: DataFrame, path: str, nodes: DataFrame, by: list[str] = EDGE_LAYER) -> DataFrame:
    """Replaces layers of edges by those of ``rows`` whose ends are nodes; one row with what was kept and pruned of each layer."""
    keys = nodes.select("key").distinct()
    a, b = keys.withColumnRenamed("key", "src").withColumn("has_src", F.lit(True)), keys.withColumnRenamed("key", "dst").withColumn("has_dst", F.lit(True))
    told = rows.join(a, "src", "left").join(b, "dst", "left").withColumn("whole", F.coalesce(F.col("has_src") & F.col("has_dst"), F.lit(False))).select(*rows.columns, "whole")
    replace(told.filter("whole").drop("whole"), path, by)
    return told.groupBy(*by).agg(F.count_if("whole").alias("kept"), F.count_if(~F.col("whole")).alias("pruned"))

"""Shuffles whose partitions follow the size of the tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Bytes of the tables for each partition with which a shuffle begins.
SHARE = 4_000_000
_BEGIN = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def divide(spark: SparkSession, sf_dir: str) -> None:
    """Lets shuffles begin with a partition for each :data:`SHARE` bytes of the tables of ``sf_dir``, where that is more than ``spark.sql.shuffle.partitions``.

    Adaptive execution joins those that turn out small, so what one task sorts or hashes doesn't grow with the tables. A number that the cluster's own setting names stays.
    """
    if spark.sparkContext.getConf().contains(_BEGIN):
        return
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    size = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    spark.conf.set(_BEGIN, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARE))


def shared(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query after :func:`divide`."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str, *rest):
        divide(spark, sf_dir)
        return query(spark, sf_dir, *rest)

    return run

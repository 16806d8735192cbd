"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share.

    That is the folder already set, else ``spark.checkpoint.dir``. Where neither is there, a folder in the warehouse is taken on a cluster, which must not be a
    machine's own then, and a temporary one only where driver and executors are one process.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="checkpoints")
        if not folder:
            home = spark.conf.get("spark.sql.warehouse.dir")
            if home.startswith("file:"):
                raise ValueError(f"set spark.checkpoint.dir: the warehouse is a local folder, {home}")
            folder = f"{home}/checkpoints-{uuid.uuid4()}"
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder. With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark deletes what nothing refers to any more."""
    _folder(df.sparkSession)
    return df.checkpoint()


def resettled(df: DataFrame) -> DataFrame:
    """:func:`settle` for the state of a loop, of whose size Spark has no estimate.

    Spark takes the size of a join for the product of its sides' sizes and keeps that with a checkpoint, so in a loop with joins the estimate gets several times as many digits in every round,
    until the numbers alone fill the driver. Rows that come from an RDD have a fixed one. Strings go as binary, as they are not decoded then.
    """
    spark, text = df.sparkSession, {c for c, kind in df.dtypes if kind == "string"}
    plain = df.select(*[F.col(c).cast("binary") if c in text else F.col(c) for c in df.columns])
    rows = spark._jsparkSession.createDataFrame(plain._jdf.javaRDD(), plain._jdf.schema())
    return settle(DataFrame(rows, spark)).select(*[F.col(c).cast("string") if c in text else F.col(c) for c in df.columns])


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path beside the checkpoints, for a table."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4()}"

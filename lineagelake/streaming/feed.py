"""The graph as a stream: windows over an event feed, deduplication, incremental maintenance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layers import upsert


def feed(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; the schema is that of the files there now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def _marked(events: DataFrame, late: str) -> DataFrame:
    """A stream with a watermark on ``ts``, which must be a timestamp with a zone there; batches stay as they are."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events and sums by type in tumbling or sliding windows, with a watermark."""
    at = F.window("ts", size, slide) if slide else F.window("ts", size)
    return _marked(events, late).groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of each user: events that follow each other within a gap."""
    return _marked(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "events")


def once(events: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key; in a stream within the watermark."""
    return _marked(events, late).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


BUCKETS = 64


def maintain(stream: DataFrame, key: list[str], seq: str, path: str, checkpoint: str, derive: Callable[[DataFrame], DataFrame] | None = None, buckets: int = BUCKETS):
    """Keeps the latest row of each key in a Parquet table; ``derive`` is recomputed over the whole state.

    Keys are dealt to buckets by hash. A batch reads and writes only the buckets that it touches, each as a folder named by batch, so a batch costs
    its share of the state, and one that is run again after a failure rewrites its own folders. Of each bucket the versions that the last but one batch
    made obsolete are deleted. Returns the started query; :func:`state` reads the last version.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, n: int) -> None:
        rows = batch.withColumn("bucket", F.pmod(F.hash(*key), F.lit(buckets)))
        met = sorted(r[0] for r in rows.select("bucket").distinct().collect())  # at most ``buckets``
        if met:
            old = state(spark, path, n, met)
            every = rows if old is None else old.withColumn("bucket", F.pmod(F.hash(*key), F.lit(buckets))).unionByName(rows)
            upsert(every, [*key, "bucket"], seq).select(*batch.columns, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v{n}")
            _forget(spark, path, n)
        if derive and (now := state(spark, path, n + 1)) is not None:
            derive(now).write.mode("overwrite").parquet(f"{path}/derived{n}")
            _drop(spark, f"{path}/derived{n - 2}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _drop(spark: SparkSession, path: str) -> None:
    folder, fs = _folder(spark, path)
    fs.delete(folder, True)


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The buckets of each finished version."""
    folder, fs = _folder(spark, path)
    if not fs.exists(folder):
        return {}
    numbers = [int(n[1:]) for s in fs.listStatus(folder) if (n := s.getPath().getName())[:1] == "v" and n[1:].isdigit()]
    done = [n for n in numbers if fs.exists(_folder(spark, f"{path}/v{n}/_SUCCESS")[0])]
    return {n: [int(b.removeprefix("bucket=")) for s in fs.listStatus(_folder(spark, f"{path}/v{n}")[0]) if (b := s.getPath().getName()).startswith("bucket=")] for n in done}


def _forget(spark: SparkSession, path: str, n: int) -> None:
    """Deletes the buckets that a version before ``n`` replaced; those that ``n`` itself replaces stay, should it be run again."""
    last: dict[int, int] = {}
    for v, found in sorted(_versions(spark, path).items(), reverse=True):
        for b in found:
            if v < n and last.setdefault(b, v) != v:
                _drop(spark, f"{path}/v{v}/bucket={b}")


def state(spark: SparkSession, path: str, before: int = 1 << 30, buckets: list[int] | None = None) -> DataFrame | None:
    """The last finished version of each bucket below ``before``."""
    last: dict[int, int] = {}
    for v, found in sorted(_versions(spark, path).items()):
        last |= {b: v for b in found if v < before}
    paths = [f"{path}/v{v}/bucket={b}" for b, v in sorted(last.items()) if buckets is None or b in buckets]
    return spark.read.parquet(*paths) if paths else None

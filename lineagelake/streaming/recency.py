"""A cache's entries as state of a stream of its gets, puts and forgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ENTRY = "key string, tick bigint, bytes bigint, hits bigint, last_used bigint, there boolean"
#: The store that keeps arbitrary state.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Keys are dealt to this many buckets; a call folds what a batch brings to one of them.
BUCKETS = 1024
_FIELDS = "key string, bytes bigint, put boolean, hits bigint, last_used bigint"
_STATE = ", ".join(f"{name} array<{kind}>" for name, kind in (f.split(" ") for f in _FIELDS.split(", ")))


class Recency(StatefulProcessor):
    """Keeps of each key of a bucket the bytes of its latest put, the gets since its first put and its last use; a forget clears it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getValueState("entries", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = self.entries.get() if self.entries.exists() else None
        entries = {k: entry for k, *entry in zip(*kept, strict=True)} if kept else {}
        met = {}
        batch = pd.concat(list(rows)).sort_values("tick")
        for key, tick, op, own in zip(*[batch[c].tolist() for c in ("key", "tick", "op", "bytes")], strict=True):
            met[key] = int(tick)
            if op == "forget":
                entries.pop(key, None)
                continue
            entry = entries.get(key)
            if entry is None:
                entry = entries[key] = [None, False, 0, None]
            entry[2] += int(entry[1] and op == "get")
            entry[3] = int(tick)
            if op == "put":
                entry[0], entry[1] = None if pd.isna(own) else int(own), True
        if entries:
            self.entries.update(tuple(list(c) for c in zip(*[(k, *entry) for k, entry in entries.items()], strict=True)))
        else:
            self.entries.clear()
        size, there, hits, used = zip(*[entries.get(k, (None, False, 0, None)) for k in met], strict=True)
        yield pd.DataFrame({"key": list(met), "tick": list(met.values()), "bytes": pd.array(size, "Int64"), "hits": hits, "last_used": pd.array(used, "Int64"), "there": there})

    def close(self) -> None:
        pass


def recency(log: DataFrame) -> DataFrame:
    """A row for each key that a batch of the stream ``log`` (key, tick, op, bytes) meets: its entry after the batch, under the last tick.

    Ticks of a key ascend from batch to batch, as a log's do; within a batch they may come in any order. The session's state store must be :data:`PROVIDER`.
    """
    told = log.select(F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).alias("bucket"), "key", "tick", "op", "bytes")
    return told.groupBy("bucket").transformWithStateInPandas(Recency(), ENTRY, "Append", "None")


def latest(entries: DataFrame) -> DataFrame:
    """``key, bytes, hits, last_used`` of the entries that are there, from all rows of :func:`recency`."""
    last = entries.groupBy("key").agg(F.max_by(F.struct("bytes", "hits", "last_used", "there"), "tick").alias("e"))
    return last.select("key", "e.*").filter("there").drop("there")

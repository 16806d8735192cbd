"""Sharding by sampled splitters (operator 8).

A record's key puts the hash of its text above a hash of its id and row, so equal
texts lie side by side and a group of copies, of any size and even of one id, can be divided. A
sample of keys is drawn with chances in proportion to size; its quantiles
split the keys into ranges, ``RANGES`` at first. Ranges that hold over twice their share, that of
``RANGE`` rows at most, and those in which a shard ends, are subdivided by splitters of their own, all of a round from one sample, until each
shard can end within ``TOLERANCE`` of its share or nothing more can be divided; what is missing then is logged. Quantiles are
taken in tasks, a range at a time, so only splitters and the ranges' sums come to the driver. Shards are unions of
whole ranges; slots number each range on its own from the sum of those before
it, so no shard is sorted in one task.

``law`` is ``bytes``: the shards' sizes (UTF-8 bytes of the text plus 1) are
nearly equal. A shard ends at the range edge nearest to its due. So at most one group of equal texts is divided
at each of these ends, whatever its size, and all others stay in one shard.

Defined results: null text has size 1 and the checksum of no bytes. Rows that
repeat id and text get slots of their own, in no stated order. Null ids hash
as such. Further columns are not read.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

TOLERANCE = 1e-3
RANGES, RANGE = 512, 1_000_000
#: Sampled keys for each range that is made.
DRAWN = 40
LOW = 24  # bits of the key that come from the id and row
#: Rows of range numbers that are sent to every task, at most: 16 bytes each.
BROADCAST_ROWS = 500_000


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text, i = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col)
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("bigint") + 1
    low = (1 << LOW) - 1
    key = F.xxhash64(text).bitwiseAND(F.lit(~low)).bitwiseOR(F.xxhash64(i, F.monotonically_increasing_id()).bitwiseAND(F.lit(low)))
    return docs.select(i.alias("id"), size.alias("size"), F.crc32(text.cast("binary")).alias("crc"), key.alias("key"))


def range_of(splitters: list[int]):
    """Column function: how many splitters are at most the key."""
    at = np.array(splitters, np.int64)

    @F.pandas_udf("int")
    def find(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, key.to_numpy(), "right").astype(np.int32))

    return find


def _sampled(rows: DataFrame, splitters: list[int], held: list[tuple[int, int]], wanted: dict[int, int]) -> list[int]:
    """New splitters for some ranges: ``wanted`` says into how many parts each is to be cut. One job samples all of them.

    Keys are drawn with chances in proportion to size, about ``DRAWN`` for each part, and each range's quantiles are taken in a task.
    """
    rate = [DRAWN * wanted.get(k, 0) / max(1, size) for k, (size, _) in enumerate(held)]
    most = max(wanted.values(), default=1)
    at, rates = np.array(splitters, np.int64), np.array(rate)

    @F.pandas_udf("double")
    def chance(key: pd.Series) -> pd.Series:
        return pd.Series(rates[np.searchsorted(at, key.to_numpy(), "right")])

    def quantiles(key: tuple, drawn: pd.DataFrame) -> pd.DataFrame:
        keys = np.sort(np.repeat(drawn["key"].to_numpy(), drawn["times"].to_numpy()))
        parts = wanted[key[0]]
        return pd.DataFrame({"key": np.unique(keys[(np.arange(1, parts) * len(keys)) // parts])})

    draw = F.xxhash64("key", F.lit(88 + len(splitters))).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    # rows larger than one sampling step are drawn once for each step, up to the number of draws of a range
    times = F.least(F.floor(F.col("size") * chance("key") + draw), F.lit(DRAWN * most)).cast("int")
    drawn = rows.select(range_of(splitters)("key").alias("range"), "key", times.alias("times")).filter("times > 0")
    return [r[0] for r in drawn.groupBy("range").applyInPandas(quantiles, "key bigint").collect()]


def shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", ranges: int = RANGES, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``."""
    rows = settle(keyed(docs, id_col, text_col))
    splitters: list[int] = []
    held = _held(rows, splitters)
    (total, n), share = held[0], held[0][0] / n_shards
    wanted, ranges = {0: ranges}, max(ranges, -(-n // RANGE))
    while wanted:
        new = sorted({*splitters, *_sampled(rows, splitters, held, wanted)})
        if len(new) == len(splitters):
            logging.getLogger(__name__).warning("%d ranges can't be divided further", len(wanted))
            break
        splitters = new
        held, wanted = _held(rows, splitters), {}
        before = np.cumsum([0, *[b for b, _ in held]])
        edges = [-(2**63), *splitters, 2**63 - 1]
        for k, (size, count) in enumerate(held):
            ends = np.floor(before[k + 1] / share) > np.floor(before[k] / share) if share else False
            if count > 1 and edges[k + 1] - edges[k] > 1 and ((ends and size > tolerance * share) or size > 2 * total / ranges):
                wanted[k] = 32
    shard = _assign(held, n_shards)
    off = max((abs(s - share) for s in pd.Series([b for b, _ in held]).groupby(shard).sum()), default=0)
    if off > tolerance * share:  # single records or few rows
        logging.getLogger(__name__).warning("a shard is %.2f %% off its share of %.0f bytes", 100 * off / share, share)
    first = pd.Series([n for _, n in held]).groupby(shard).transform(lambda s: s.cumsum() - s).tolist() if held else []
    placed = rows.withColumn("range", range_of(splitters)("key"))
    known = docs.sparkSession.createDataFrame([(k, int(s), int(f)) for k, (s, f) in enumerate(zip(shard, first, strict=True))], "range int, shard int, first bigint")
    slot = F.row_number().over(Window.partitionBy("range").orderBy("key", "id", "size", "crc")) - 1
    known = F.broadcast(known) if len(held) <= BROADCAST_ROWS else known  # one row a range, of at most about RANGE rows each
    placed = placed.withColumn("at", slot).join(known, "range")
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("at")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _held(rows: DataFrame, splitters: list[int]) -> list[tuple[int, int]]:
    """Bytes and rows of each range; as many rows as there are ranges come to the driver."""
    got = {r[0]: (r[1], r[2]) for r in rows.groupBy(range_of(splitters)("key").alias("range")).agg(F.sum("size"), F.count("*")).collect()}
    return [got.get(k, (0, 0)) for k in range(len(splitters) + 1)]


def _assign(held: list[tuple[int, int]], n_shards: int) -> list[int]:
    """The shard of each range: a shard ends at the range edge nearest to its due."""
    before = np.cumsum([0, *[b for b, _ in held]])
    out, at = np.zeros(len(held), int), 0
    for s in range(1, n_shards):
        due = s * before[-1] / n_shards
        best = int(np.searchsorted(before, due))
        best = max(at, min(best, len(held)))
        best = best - 1 if best > at and due - before[best - 1] <= before[best] - due else best
        out[best:] = s
        at = best
    return out.tolist()


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes ``docs`` with shard and slot, one folder a shard; ids must be unique."""
    docs.join(placed.select(id_col, "shard", "slot"), id_col).write.partitionBy("shard").parquet(path)

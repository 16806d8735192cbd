"""Removal of repeated byte passages (operator 5).

A byte goes if a string of ``length`` bytes that covers it also starts earlier, in a
document of smaller id or before in the same one.

Not a suffix array of every position: its records would be about twenty times the input on disk
(README, operator 5). The suffixes are sorted in buckets all the same, but a bucket is
the positions that share a seed chosen by content instead of a difference
cover, and only buckets with more than one member are looked at:

1. Each window of ``length`` bytes chooses the ``SEED``-byte string in it with the
   least hash, the leftmost of equals. Equal windows choose alike, so equal
   windows share a bucket. Neighbouring windows that choose the same string form
   a run, about one for 35 bytes, and a run has one hash over all its bytes.
2. Of equal runs in one portion of the input all but the first are known to repeat
   before any shuffle, and are dealt out at random rather than to their bucket; so a passage that a third of
   all documents share costs its bucket a row for each portion. The other
   runs are sorted by bucket, run hash and place. A run whose hash was seen
   before repeats as a whole. For the others: a window reaches at least half of
   ``length - SEED`` bytes to the left or to the right of its seed, so it can
   only repeat if the seed with as many bytes on that side occurs in another run.
3. The windows that this leaves, at the edges of repeated passages, are hashed one by one
   and sorted by hash and place.

Equality is that of 96 bits of hash: a run's 64 with the 32 of its bucket, a window's 64 with 32 of a hash over other byte values. Among 1e12
windows the chance of any false match is about 6e-6.

Defined results: null text counts as empty. Null ids come before all others. Rows that repeat an id
are ordered by the hash of their text; of rows that repeat both, the first is the earliest and
the others repeat it. Further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import flat, mix, partitions, portions, powers, range_hashes, settle
from .common import _VALUE as VALUE
from .common import OTHER

LENGTH, SEED = 100, 32
CHUNK = 2_000_000
#: Ids that are sent to every task rather than joined by a shuffle of texts, at most: 8 MB.
BROADCAST_IDS = 1_000_000


def seed_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    """Hash of the ``seed`` bytes from each position that has as many."""
    forth, back = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUE[data] * forth[:-1], out=sums[1:])
    return mix((sums[seed:] - sums[:-seed]) * back[: len(data) + 1 - seed])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def runs(data: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Per run: row, first window (place in ``data``), number of windows, bytes from there to the seed, and hashes of the seed, of all bytes, and of the seed with its left and right side."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 8
    hashes = seed_hashes(data, seed)
    # the place in the low bits, of one width for all portions: so equal windows choose alike wherever they stand
    bits = np.uint64((max(CHUNK, 2 * length) + length).bit_length())
    packed = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    chosen = (sliding_least(packed, length - seed + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(chosen)]
    at = np.flatnonzero(np.arange(len(chosen)) + length <= offsets[1:][row])
    if not len(at):
        return (np.zeros(0, np.int64),) * 8
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(chosen[at]) != 0) | (np.diff(row[at]) != 0)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start = at[first]
    row, at_seed, side = row[start], chosen[start], (length - seed) // 2
    left = range_hashes(data, np.maximum(at_seed - side, offsets[:-1][row]), at_seed + seed)
    right = range_hashes(data, at_seed, np.minimum(at_seed + seed + side, offsets[1:][row]))
    whole = range_hashes(data, start, start + count - 1 + length)
    return row, start, count, at_seed - start, *[h.view(np.int64) for h in (hashes[at_seed], whole, left, right)]


def repeated(bucket: np.ndarray, whole: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which runs are equal to an earlier one of these; runs of a row come in order of place."""
    at = np.lexsort((order, whole, bucket))
    out = np.zeros(len(bucket), bool)
    out[at[1:]] = (bucket[at[1:]] == bucket[at[:-1]]) & (whole[at[1:]] == whole[at[:-1]])
    return out


def _runs(docs: DataFrame, length: int, seed: int) -> DataFrame:
    def run(batches):
        for batch in portions(batches):
            data, offsets = flat(batch.column(1))
            order = np.empty(batch.num_rows, np.int64)  # of the rows by id
            order[pa.compute.sort_indices(batch.select([0, 2]), [(n, "ascending") for n in batch.schema.names[::2]], null_placement="at_start").to_numpy()] = np.arange(batch.num_rows)
            step = max(CHUNK, 2 * length) if batch.num_rows == 1 else max(1, len(data))
            for low in range(0, max(1, len(data)), step):
                part = data[low : low + step + length - 1]
                row, start, count, before, key, whole, left, right = runs(part, offsets if batch.num_rows > 1 else np.array([0, len(part)]), length, seed)
                row_ = pa.array(row)
                place = low + start - offsets[row]
                bucket = key >> 32
                known = repeated(bucket, whole, order[row])
                bucket = np.where(known, (1 << 32) + (mix((whole + place).view(np.uint64)) >> np.uint64(32)).astype(np.int64), bucket)
                ints = [pa.array(x.astype(np.int32)) for x in (left >> 32, right >> 32, place, count, before)]
                cols = [pa.array(bucket), pa.array(known), *ints[:2], pa.array(whole), batch.column(0).take(row_), batch.column(2).take(row_), *ints[2:]]
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", "known", "left", "right", "whole", "id", "sub", "at", "n", "before"])

    kind = dict(docs.dtypes)["id"]
    return docs.mapInArrow(run, f"bucket bigint, known boolean, left int, right int, whole bigint, id {kind}, sub bigint, at int, n int, before int")


def _windows(asked: DataFrame, length: int) -> DataFrame:
    """Two hashes, 96 bits together, of each window that ``asked`` lists beside its text."""

    def run(batches):
        for batch in portions(batches):
            for r in range(batch.num_rows):
                data, _ = flat(batch.column(1).slice(r, 1))
                spans = batch.column(3)[r].values
                at, n = spans.field("at").to_numpy().astype(np.int64), spans.field("n").to_numpy().astype(np.int64)
                start = np.sort(np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))
                found, check = np.empty(len(start), np.uint64), np.empty(len(start), np.int32)
                a = 0
                while a < len(start):
                    b = int(np.searchsorted(start, start[a] + CHUNK, "right"))
                    low = start[a]
                    part = data[low : start[b - 1] + length]
                    found[a:b] = range_hashes(part, start[a:b] - low, start[a:b] - low + length)
                    check[a:b] = (range_hashes(part, start[a:b] - low, start[a:b] - low + length, OTHER) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    a = b
                owner = pa.array(np.full(len(start), r))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(check), batch.column(0).take(owner), batch.column(2).take(owner), pa.array(start.astype(np.int32))], names=["hash", "check", "id", "sub", "at"])

    kind = dict(asked.dtypes)["id"]
    return asked.mapInArrow(run, f"hash bigint, check int, id {kind}, sub bigint, at int")


def _kept(rows: DataFrame, length: int, keep_text: bool) -> DataFrame:
    """What is left of each text after its repeated windows, in ``spans``, and for later copies after all windows."""

    def run(batches):
        for batch in portions(batches):
            out: list[list] = [[], [], [], [], []]
            copies = batch.column(3).to_pylist()
            for r in range(batch.num_rows):
                data, _ = flat(batch.column(1).slice(r, 1))
                gone = np.zeros(len(data) + 1, np.int32)
                spans = batch.column(2)[r]
                if copies[r] > 1 and len(data) >= length:
                    gone[0], gone[-1] = 1, -1
                elif spans.is_valid:
                    at, n = spans.values.field("at").to_numpy(), spans.values.field("n").to_numpy()
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + n - 1 + length, -1)
                mask = np.cumsum(gone)[:-1] > 0
                kept = data[~mask].tobytes()
                out[0].append(len(data))
                out[1].append(int(mask.sum()))
                out[2].append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()))
                out[3].append(hashlib.sha256(kept).hexdigest())
                out[4].append(kept if keep_text else None)
            cols = [batch.column(0), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.string()), pa.array(out[4], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_bytes binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, if asked for, ``kept_bytes``."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    unique = docs.groupBy("id").count().filter("count > 1 or id is null").isEmpty()
    docs = docs.withColumn("sub", F.lit(0).cast("bigint") if unique else F.coalesce(F.xxhash64("text"), F.lit(0)))
    if not unique:
        docs = docs.withColumn("copy", F.row_number().over(Window.partitionBy("id", "sub").orderBy(F.lit(0))))
    else:
        docs = docs.withColumn("copy", F.lit(1))
    dealt = _runs(docs.select("id", "text", "sub"), length, seed).repartition(partitions(docs), "bucket")
    seen = (F.rank().over(Window.partitionBy("bucket", "whole").orderBy("id", "sub", "at")) > 1) | F.col("known")
    shared = lambda side: F.min("whole").over(Window.partitionBy("bucket", side)) != F.max("whole").over(Window.partitionBy("bucket", side))
    found = dealt.withColumn("seen", seen).withColumn("by_left", shared("left")).withColumn("by_right", shared("right")).filter("seen or by_left or by_right")
    # windows that reach far to the left come first in a run, then those that reach far to the right
    found = found.withColumn("lefts", F.greatest(F.lit(0), F.least("n", F.col("before") - (length - seed) // 2 + 1)))
    skip = F.when(F.col("seen") | F.col("by_left"), 0).otherwise(F.col("lefts"))
    take = F.when(F.col("seen"), F.col("n")).otherwise(F.when(F.col("by_left"), F.col("lefts")).otherwise(0) + F.when(F.col("by_right"), F.col("n") - F.col("lefts")).otherwise(0))
    found = found.select("id", "sub", "seen", (F.col("at") + skip).alias("at"), take.alias("n")).filter("n > 0")
    found = settle(found.groupBy("id", "sub").agg(*[F.collect_list(F.when(c, F.struct("at", "n"))).alias(k) for k, c in (("seen", F.col("seen")), ("edges", ~F.col("seen")))]))

    def beside(spans: DataFrame, how: str) -> DataFrame:
        keys = spans.select("id", "sub")
        texts = docs
        if how == "inner" and keys.count() <= BROADCAST_IDS:
            texts = texts.join(F.broadcast(keys.select("id").distinct().withColumnRenamed("id", "i")), F.col("id").eqNullSafe(F.col("i")), "left_semi")
        other = spans.withColumnsRenamed({"id": "i", "sub": "s"})
        return texts.join(other, F.col("id").eqNullSafe(F.col("i")) & (F.col("sub") == F.col("s")), how)

    asked = beside(found.filter("size(edges) > 0").select("id", "sub", "edges"), "inner").filter("copy = 1").select("id", "text", "sub", "edges")
    again = F.rank().over(Window.partitionBy("hash", "check").orderBy("id", "sub", "at")) > 1
    edges = _windows(asked, length).withColumn("again", again).filter("again")
    edges = edges.groupBy("id", "sub").agg(F.collect_list(F.struct("at", F.lit(1).alias("n"))).alias("more"))
    both = found.filter("size(seen) > 0").select("id", "sub", F.col("seen").alias("spans")).unionByName(edges.select("id", "sub", F.col("more").alias("spans")))
    spans = settle(both.groupBy("id", "sub").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    none = F.lit(None).cast("array<struct<at:int,n:int>>")
    if unique and spans.count() <= BROADCAST_IDS:
        ids = F.broadcast(spans.select(F.col("id").alias("i")))
        changed = beside(spans, "inner").select("id", "text", "spans", "copy")
        rest = docs.join(ids, F.col("id") == F.col("i"), "left_anti").select("id", "text", none.alias("spans"), "copy")
        rows = [changed, rest]
    else:
        rows = [beside(spans, "left").select("id", "text", "spans", "copy")]
    out = _kept(rows[0], length, keep_text)
    for r in rows[1:]:
        out = out.unionByName(_kept(r, length, keep_text))
    return out.withColumnRenamed("id", id_col) if keep_text else out.drop("kept_bytes").withColumnRenamed("id", id_col)

"""What the operators of this subpackage share: settled tables and words of Arrow text columns as numpy arrays."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import settle

#: The white space that separates words, 0x20 and 0x09 to 0x0D.
WHITE = b" \t\n\x0b\x0c\r"
PORTION = 1_000_000
#: Bytes of a batch of results on its way from a Python worker.
SENT = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(text):
    """Column with A-Z in lower case and all else as it is; null stays null."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def give_back() -> None:
    """Hands memory that a worker no longer uses back to the system, as workers stay for the tasks to come."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def portions(batches, text: int = 1, size: int = PORTION):
    """Slices of record batches that hold about ``size`` bytes of text, or one row if it is longer. Column ``text`` is a string without nulls then."""
    for batch in batches:
        values = batch.column(text)
        values = (values.cast(pa.string()) if values.type != pa.string() else values).fill_null("")
        batch = batch.set_column(text, batch.schema.names[text], values)
        _, offsets = flat(values)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    give_back()


def flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls and each row's offsets in them."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[list(WHITE)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = np.random.default_rng(20).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
OTHER = np.random.default_rng(21).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _BACK)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray = _VALUE) -> np.ndarray:
    """64-bit hash of each byte range of ``data``; another table of byte ``value`` gives an independent one."""
    forth, back = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * forth[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; words never cross rows."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(_SPACE[data], out=inside[1:-1])
    cuts = offsets[1:-1]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    starts[cuts] |= inside[1:-1][cuts]
    ends[cuts - 1] |= inside[1:-1][cuts - 1]
    start = np.flatnonzero(starts)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, block: int = 1_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end of each word. Long portions are hashed in blocks of whole words, which bounds the memory."""
    start, end, row = word_bounds(data, offsets)
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + block, "right")))
        low = start[at]
        out[at:to] = range_hashes(data[low : end[to - 1]], start[at:to] - low, end[at:to] - low)
        at = to
    return out, row, start, end


def per_row(marked: np.ndarray, offsets: np.ndarray, block: int = 1_000_000) -> np.ndarray:
    """How many of the marked bytes each row has."""
    before, at, total = np.zeros(len(offsets), np.int64), 0, 0
    for low in range(0, len(marked) + 1, block):  # sums of a block at a time take little
        sums = np.append(0, np.cumsum(marked[low : low + block], dtype=np.int32))
        to = int(np.searchsorted(offsets, low + block)) if low + block <= len(marked) else len(offsets)
        before[at:to] = total + sums[offsets[at:to] - low]
        at, total = to, total + int(sums[-1])
    return np.diff(before)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def by_group(df: DataFrame, key: str, order: list[str], work, schema: str, count: int | None = None, size: int = 60_000, held: int = 64_000_000) -> DataFrame:
    """``work(record batch) -> iterator of record batches`` over the rows of ``df``, dealt by ``key`` and sorted by ``[key, *order]``.

    Each call gets whole groups, as many as make about ``size`` rows or ``held`` bytes, so small groups cost little. A group larger than
    that comes in one call; callers bound the size of their groups.
    """
    limit = held

    def run(batches):
        held: list[pa.RecordBatch] = []
        n = used = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            used += batch.get_total_buffer_size()
            if n >= size or used >= limit:
                del batch
                whole = _joined(held)
                at = last_group(whole.column(0))
                held, n = [_own(whole.slice(at))], whole.num_rows - at
                used = held[0].get_total_buffer_size()
                whole = whole.slice(0, at) if at else None
                if at:
                    for out in work(whole):
                        yield from _sent(out)
                        del out
                del whole
        if n:
            for out in work(_joined(held)):
                yield from _sent(out)
                del out
        give_back()

    names = [key, *[c for c in df.columns if c != key]]
    return df.select(*names).repartition(count or partitions(df), key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The batches of a list as one; the list is empty then, so that they aren't held beside it."""
    table = pa.Table.from_batches(held)
    held.clear()
    return table.combine_chunks().to_batches(max_chunksize=None)[0]


def _sent(batch: pa.RecordBatch):
    """Slices of about ``SENT`` bytes, as the JVM holds each batch that it gets as a whole, outside its heap."""
    rows = max(1, batch.num_rows * SENT // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _own(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A copy that holds no more than its rows."""
    return batch.take(pa.array(np.arange(batch.num_rows)))


def group_bounds(keys: pa.Array) -> np.ndarray:
    """Where the groups of a sorted column begin, and its length at the end."""
    if len(keys) < 2:
        return np.arange(len(keys) + 1)
    codes = pa.compute.run_end_encode(keys).run_ends
    return np.append(0, codes.to_numpy(zero_copy_only=False).astype(np.int64))


def last_group(keys: pa.Array) -> int:
    return int(group_bounds(keys)[-2])

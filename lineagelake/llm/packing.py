"""Packing token sequences by first-fit decreasing (operator 10).

Every document becomes token ids and an end id; it is cut into pieces of at
most ``capacity`` ids, which travel with their pieces and are laid into the sequences. Full pieces are sequences of their own; their ids travel only if they are asked for. The rest of a
random group of documents is packed by first-fit decreasing: a tournament
tree over the bins holds the most room in each subtree, so the first bin with
room is found in a walk from the root. Groups are drawn by a hash of the row's place in the table and hold about
``GROUP`` documents each, so they are packed independently and no skew of
sources, texts or repeated rows reaches them. A task packs as many groups at once as make ``HELD`` bytes of ids.

The ids are those of the ``tokenizers`` library for the vocabulary file,
computed by the rank coder of ``tiktoken`` for the same vocabulary (tests hold
both against each other). Long texts are coded in parts that end where a word begins; a part over ``LONG`` characters, which is one
unbroken word, goes through :mod:`.bpe`, whose time doesn't grow with the square of a word.

Defined results: null text is empty and gives the end id alone. Rows that
repeat an id are packed as documents of their own, also those with a null id.
Further columns are not read.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import by_group, group_bounds, portions

CAPACITY = 1024
GROUP = 4096
LONG = 500_000
#: Bytes of ids that a task holds at once, if no single group has more.
HELD = 16_000_000


@lru_cache(maxsize=2)
def coder(path: str):
    """Function from text to an array of ids, once per Python worker."""
    import tiktoken

    token_bytes, added = bpe.tokens(bpe.read_spec(path))
    whole = bpe.never_cut(added)
    ranks = {b: i for i, b in enumerate(token_bytes) if b and i not in added.values()}
    fast = tiktoken.Encoding("ranks", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def part_ids(text: str) -> np.ndarray:
        if len(text) > LONG:
            return np.frombuffer(bpe.load(path).encode_batch([text])[0], "<u4")  # its tables are made only where there is such a part
        return fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())

    def ids(text: str) -> np.ndarray:
        if len(text) <= LONG or whole:
            return part_ids(text)
        return np.concatenate([part_ids(p) for p in bpe.parts(text, LONG)])

    return ids


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Pieces of at most ``capacity`` ids: ``id, draw, start, length, doc_tokens, crc, ids``.

    A full piece is a sequence as it is: it has its checksum here, and without ``keep_ids`` no ids. The others have none until they are packed.
    """
    path = path or bpe.vocabulary_path()

    def run(batches):
        for batch in portions(batches):
            code = coder(path)
            row, start, total, kept = [], [], [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(code(text), end_id).astype(np.int32)
                cuts = range(0, len(ids), capacity)
                row += [r] * len(cuts)
                start += cuts
                total += [len(ids)] * len(cuts)
                kept.append(ids)
            row, start, total = pa.array(row, pa.int64()), np.array(start, np.int64), np.array(total, np.int64)
            length = np.minimum(capacity, total - start)
            every = np.concatenate(kept) if kept else np.zeros(0, np.int32)
            ends = np.append(0, np.cumsum(length))
            full = length == capacity
            raw = memoryview(every.astype("<u4").view(np.uint8))
            crc = np.zeros(len(length), np.int64)
            for k in np.flatnonzero(full).tolist():
                crc[k] = zlib.crc32(raw[4 * ends[k] : 4 * ends[k + 1]])
            carried = length if keep_ids else np.where(full, 0, length)
            every = every if keep_ids else every[np.repeat(~full, length)]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(carried)).astype(np.int32)), pa.array(every))
            columns = [batch.column(0).take(row), batch.column(2).take(row), pa.array(start), pa.array(length), pa.array(total), pa.array(crc), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "draw", "start", "length", "doc_tokens", "crc", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    # the row's own number, so that rows that repeat id and text are drawn apart
    draw = F.xxhash64(F.col(id_col), F.col(text_col), F.monotonically_increasing_id())
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), draw.alias("draw"))
    return text.mapInArrow(run, f"id {kind}, draw bigint, start bigint, length bigint, doc_tokens bigint, crc bigint, ids array<int>")


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length."""
    order = np.argsort(-lengths, kind="stable").tolist()
    size = 1 << max(0, len(lengths) - 1).bit_length()
    room = [capacity] * (2 * size)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in order:
        need, k = int(lengths[i]), 1
        while k < size:
            k *= 2
            if room[k] < need:
                k += 1
        bins[i], offsets[i] = k - size, capacity - room[k]
        room[k] -= need
        k //= 2
        while k:
            a, b = room[2 * k], room[2 * k + 1]
            room[k] = a if a > b else b
            k //= 2
    return bins, offsets


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset``, the ``ids_crc32`` of their ids as packed and, if asked for, the ``ids``; :func:`sequences` lays these out."""
    groups = max(1, round(docs.count() / group))
    cut = pieces(docs, path, capacity, 0, id_col, text_col, keep_ids)
    # a very long document is in several groups
    cut = cut.withColumn("group", F.pmod(F.xxhash64("draw", F.floor(F.col("start") / (group * capacity)), F.lit(10)), F.lit(groups)))

    def work(batch):
        column = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
        length = column["length"].to_numpy()
        where, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        bounds = group_bounds(column["group"]).tolist()
        for a, b in zip(bounds, bounds[1:], strict=False):
            full = length[a:b] == capacity
            rest = np.flatnonzero(~full)
            bins, at = first_fit_decreasing(length[a:b][rest], capacity)
            part = np.zeros(b - a, np.int64)
            part[rest], offset[a + rest] = bins, at
            used = int(bins.max()) + 1 if len(bins) else 0
            part[full] = used + np.arange(int(full.sum()))
            where[a:b] = (column["group"][a].as_py() << 32) + part
        ids = column["ids"].flatten().to_numpy()
        full = length == capacity
        ends = np.append(0, np.cumsum(length if keep_ids else np.where(full, 0, length)))
        raw = memoryview(ids.view(np.uint8))
        crc = column["crc"].to_numpy().copy()
        for k in np.flatnonzero(~full).tolist():
            crc[k] = zlib.crc32(raw[4 * ends[k] : 4 * ends[k + 1]])
        names = ["id", "start", "length", "doc_tokens"]
        yield pa.RecordBatch.from_arrays([*[column[c] for c in names], pa.array(where), pa.array(offset), pa.array(crc, pa.int64()), column["ids"]], names=[*names, "sequence_id", "offset", "ids_crc32", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids_crc32 bigint, ids array<int>"
    out = by_group(cut, "group", ["length", "id", "start", "draw"], work, schema, held=HELD)
    return (out if keep_ids else out.drop("ids")).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the ids of each sequence in their order, at most one capacity a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))

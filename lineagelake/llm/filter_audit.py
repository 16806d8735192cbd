"""How filters overlap, in every order (operator 12).

Five filters judge a text on its own, but which of them is said to remove it
depends on their order. Each document becomes a mask of the filters it fails;
counts of masks are additive, so whatever follows from them, for all 120
orders, follows from 32 counters of each part.

The fifth filter needs all texts: documents are sorted by range of fingerprint,
and within a range by fingerprint, full text and id; each is compared with the one before. Copies
of one text may lie in several ranges, also of one id. Only a range's first and last fingerprint
can go on elsewhere; their rows of least id are counted apart until the least of all ranges is known.

Defined results: a null text is empty, a null part is the empty string. A row
without an id is no copy and makes none. Rows that repeat are documents each; those of
equal text and equal id are no copies of each other. A document counts as good or toxic if any label of its id says so.
Distinct words are those of distinct 64-bit hashes. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, per_row, portions, settle, word_hashes

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKS = 1 << len(FILTERS)
COPY = 1 << FILTERS.index("E")
#: Labels that are sent to every task rather than joined by a shuffle, at most.
BROADCAST_BYTES = 8_000_000
#: The least number of words, the least share of distinct words and the greatest of capitals in percent, and the symbols.
WORDS, DISTINCT, CAPITALS, SYMBOLS = 200, 50, 3, b"#$%&*|"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def failed(values: pa.Array) -> np.ndarray:
    """The filters A to D that each text fails, as bits."""
    data, offsets = flat(values)
    words, row, _, _ = word_hashes(data, offsets)
    n = np.bincount(row, minlength=len(values))
    ends = np.cumsum(n)
    for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
        words[a:b].sort()
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (row[1:] != row[:-1])
    distinct = np.bincount(row[new], minlength=len(values))
    points = per_row((data & 0xC0) != 0x80, offsets)
    capitals = per_row((data >= 65) & (data <= 90), offsets)
    symbols = per_row(_SYMBOL[data], offsets)
    return (n < WORDS) | (100 * distinct < DISTINCT * n) << 1 | (100 * capitals > CAPITALS * points) << 2 | (symbols > 0) << 3


def _compared(batches):
    """Masks of one range's rows, sorted by fingerprint, text and id. Rows of the least id of a text that may go on in another range carry the text's digest and are added up."""
    first = last = text = least = None  # fingerprints of the range's first row and of the row before; that row's text and the least id of its run
    opening, closing = Counter(), Counter()  # such rows of the first fingerprint, and of the one before if it is another

    def added(counts: Counter, keyed: bool) -> pa.RecordBatch:
        rows = [(i, part, mask, key if keyed else None, n) for (key, i, part, mask), n in counts.items()]
        counts.clear()
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["doc_id", "part", "mask", "key", "n"])

    for batch in portions(batches):
        prints, texts, parts, n = batch.column(0).to_numpy(), batch.column(1), batch.column(3), batch.num_rows
        known, ids = batch.column(2).is_valid().to_numpy(zero_copy_only=False), batch.column(2).fill_null(0).to_numpy()
        first = prints[0] if first is None else first
        same = np.zeros(n, bool)
        near = np.flatnonzero(prints[1:] == prints[:-1]) + 1
        same[near] = pc.equal(texts.take(pa.array(near)), texts.take(pa.array(near - 1))).to_numpy(zero_copy_only=False)
        same[0] = last == prints[0] and texts.slice(0, 1).equals(text)
        run = np.cumsum(~same) - (not same[0])
        at = np.full(run[-1] + 1, n)
        np.minimum.at(at, run, np.where(known, np.arange(n), n))  # ids ascend in a run
        low, told = ids[np.minimum(at, n - 1)], at < n
        if same[0] and least is not None:
            low[0], told[0] = least, True
        later = known & told[run] & (ids > low[run])
        mask = (failed(texts) | later * COPY).astype(np.int32)
        if prints[-1] != last and closing:
            yield added(closing, False)
        open_ = known & ~later & ((prints == first) | (prints == prints[-1]))
        digest: dict[int, bytes] = {}
        for i in np.flatnonzero(open_).tolist():
            if run[i] not in digest:
                digest[run[i]] = hashlib.sha256(texts[i].as_buffer()).digest()
            (opening if prints[i] == first else closing)[digest[run[i]], int(ids[i]), parts[i].as_py(), int(mask[i])] += 1
        done = [pa.array(ids, mask=~known), parts, pa.array(mask), pa.nulls(n, pa.binary()), pa.array(np.ones(n, np.int64))]
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(~open_)) for c in done], names=["doc_id", "part", "mask", "key", "n"])
        last, text, least = prints[-1], texts.take(pa.array([n - 1])), int(low[run[-1]]) if told[run[-1]] else None
    yield added(opening, True)
    yield added(closing, True)


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", ranges: int | None = None) -> DataFrame:
    """``doc_id, part, mask, key, n``: documents with the filters they fail; where ``key`` is not null, copies in earlier ranges are not yet taken into account."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("print"), text.alias("text"), F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # a text and even an id may hold any share of the rows
    ends = ["print", "doc_id", "row"]
    dealt = rows.repartitionByRange(ranges, *ends) if ranges else rows.repartitionByRange(*ends)
    return dealt.drop("row").sortWithinPartitions("print", "text", "doc_id").mapInArrow(_compared, "doc_id bigint, part string, mask int, key binary, n bigint")


def counters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", ranges: int | None = None) -> DataFrame:
    """``part, mask, good, toxic, n``: documents of each kind, to be added up."""
    told = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).filter("doc_id is not null and (good or toxic)")
    told = settle(told.groupBy("doc_id").agg(F.coalesce(F.max("good"), F.lit(False)).alias("good"), F.coalesce(F.max("toxic"), F.lit(False)).alias("toxic")))
    told = F.broadcast(told) if told.count() * 10 <= BROADCAST_BYTES else told
    own = masks(docs, id_col, text_col, part_col, ranges).join(told, "doc_id", "left").na.fill(False, ["good", "toxic"])
    kinds = ["part", "mask", "good", "toxic"]
    counts = settle(own.groupBy(*kinds, "key", F.when(F.col("key").isNotNull(), F.col("doc_id")).alias("own")).agg(F.sum("n").alias("n")))
    firsts = counts.filter("key is not null").groupBy("key").agg(F.min("own").alias("least"))
    met = counts.filter("key is not null").join(firsts, "key").withColumn("mask", F.when(F.col("own") > F.col("least"), F.col("mask").bitwiseOR(F.lit(COPY))).otherwise(F.col("mask")))
    return counts.filter("key is null").select(*kinds, "n").unionByName(met.select(*kinds, "n"))


def _weights() -> dict[str, np.ndarray]:
    """For each order and step, how often a document of each mask counts."""
    mask = np.arange(MASKS)
    size = np.array([bin(m).count("1") for m in mask])
    out: dict[str, list] = {c: [] for c in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    for order in ORDERS:
        before = 0
        for letter in order:
            bit = 1 << FILTERS.index(letter)
            fails, gone = mask & bit > 0, mask & before > 0
            before |= bit
            out["kept"].append(mask & before == 0)
            out["removed"].append(fails & ~gone)
            out["redundant"].append(fails & gone)
            out["unique_fails"].append(mask == bit)
            out["shapley"].append(fails * (len(ORDERS) // np.maximum(size, 1)))  # each of a mask's filters comes first equally often
    return {c: np.array(v, np.int64) for c, v in out.items()}


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", ranges: int | None = None) -> DataFrame:
    """One row per part, order of the filters and step."""
    total = lambda c, m: F.sum(F.when(c & (F.col("mask") == m), F.col("n")).otherwise(0))
    of = lambda c: F.array(*[total(c, m) for m in range(MASKS)])
    per = counters(docs, labels, id_col, text_col, part_col, ranges).groupBy("part").agg(of(F.lit(True)).alias("n"), of(F.col("good")).alias("good"), of(F.col("toxic")).alias("toxic"))

    def unfolded(batches):
        weight = _weights()
        steps = len(ORDERS) * len(FILTERS)
        order, step = np.repeat(ORDERS, len(FILTERS)), np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))
        for batch in batches:
            for one in batch.to_pylist():
                n, good, toxic = (np.array(one[c], np.int64) for c in ("n", "good", "toxic"))
                columns = {"part": np.repeat(one["part"], steps), "filter_order": order, "step": step} | {c: w @ n for c, w in weight.items()}
                columns |= {"good_lost": weight["removed"] @ good, "toxic_lost": weight["removed"] @ toxic}
                yield pa.RecordBatch.from_arrays([pa.array(v.tolist(), t) for v, t in zip(columns.values(), [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7], strict=True)], names=list(columns))

    return per.mapInArrow(unfolded, "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, shapley bigint, good_lost bigint, toxic_lost bigint")

"""Toxicity scores from subword bags (operator 1).

Words are bags of their hashed byte n-grams, white space as word ends
included. A segment of ``WORDS`` words is the average of its n-grams' embeddings under
a linear softmax; embeddings and softmax are trained jointly in numpy. A text is
as toxic as its most toxic segment, so a few words stand out in a long text,
and in training each document teaches its own greatest segments. Misspelled
or inflected words share most n-grams with those seen.

The model is fitted on the driver to a bounded sample of labelled rows: of each class
at most ``SAMPLE`` rows, lowest hash first, that fit half of ``SAMPLE_BYTES``; a row that does not fit is
passed over. Rows over ``ROW_BYTES`` are scored as all others, but teach only if their class has no shorter one, and
then the shortest that fits. The model's size is fixed, so it is sent to every task.

Defined results: a null or empty text has the score of no segment, that of the softmax's
bias alone. Held out is false for a null id. Null labels are left out, and a row labelled both ways is toxic.
Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, _SPACE, flat, give_back, portions, settle

GRAMS = (3, 4, 5, 6)
BITS, WIDTH, WORDS = 20, 12, 3
SAMPLE, SAMPLE_BYTES, ROW_BYTES = 1500, 6_000_000, 100_000
EPOCHS, RATE = 30, 0.1
#: Bytes whose n-grams are scored at once; a text of any length needs about thirty bytes for each of these, and few for its others.
BLOCK = 1_000_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with one space before each row and at the end, and the places of the rows."""
    low = _LOWER[data]
    low[_SPACE[data]] = 32
    return np.insert(low, offsets, 32), offsets + np.arange(len(offsets))


class Segments:
    """The segments of some texts: the row of each and where it begins. Their n-grams are made for a block of bytes at a time."""

    def __init__(self, values: pa.Array):
        self.text, place = _spaced(*flat(values))
        space = self.text == 32
        start = np.flatnonzero(~space[1:] & space[:-1]) + 1
        row = np.searchsorted(place, start, "right") - 1
        nth = (np.arange(len(start)) - np.searchsorted(start, place[:-1])[row]) // WORDS
        new = np.ones(len(start), bool)
        new[1:] = (np.diff(row) != 0) | (np.diff(nth) != 0)
        self.row, self.begin = row[new], start[new] - 1  # an n-gram belongs where its second byte is

    def grams(self, low: int, high: int):
        """Places (from ``low``, in order) and buckets of the n-grams that begin in [low, high), for each n."""
        text = self.text[low : high + max(GRAMS) - 1]
        spaces = np.zeros(len(text) + 1, np.int32)
        np.cumsum(text == 32, out=spaces[1:])
        h = np.zeros(len(text), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            size = max(0, len(text) - n + 1)
            h = h[:size]
            h *= np.uint64(257)
            h += text[n - 1 :][:size]
            if n in GRAMS:  # white space only at the ends
                size = min(size, high - low)
                at = np.flatnonzero(spaces[n - 1 : n - 1 + size] == spaces[1 : 1 + size])
                bucket = h[at]
                bucket += np.uint64(n)
                bucket *= _PRIME
                bucket >>= np.uint64(64 - BITS)
                yield at, bucket.astype(np.int32)

    def means(self, of_bucket: np.ndarray) -> np.ndarray:
        """Per segment: the average of its n-grams' values."""
        total, count = np.zeros(len(self.row)), np.zeros(len(self.row), np.int64)
        for low in range(0, len(self.text), BLOCK):
            a = max(0, int(np.searchsorted(self.begin, low, "right")) - 1)  # the segment that reaches into the block
            b = int(np.searchsorted(self.begin, low + BLOCK))
            for at, bucket in self.grams(low, low + BLOCK):
                bounds = np.append(np.searchsorted(at, self.begin[a:b] - low), len(at))
                sums = np.zeros(len(bucket) + 1)
                np.cumsum(of_bucket[bucket], dtype=np.float64, out=sums[1:])
                total[a:b] += sums[bounds[1:]] - sums[bounds[:-1]]
                count[a:b] += np.diff(bounds)
        return total / np.maximum(count, 1)


class Grams(Segments):
    """The segments of a bounded sample of texts and, for each n, the buckets of all their n-grams in segment order, as training reads them again and again."""

    def __init__(self, values: pa.Array):
        super().__init__(values)
        parts: list[tuple[list, list, int]] = [([], [], 0) for _ in GRAMS]
        for low in range(0, len(self.text), BLOCK):  # what is made on the way is held for a block only
            begin = self.begin[np.searchsorted(self.begin, low) : np.searchsorted(self.begin, low + BLOCK)]
            for k, (at, bucket) in enumerate(self.grams(low, low + BLOCK)):
                buckets, bounds, n = parts[k]
                buckets.append(bucket)
                bounds.append(np.searchsorted(at, begin - low) + n)
                parts[k] = buckets, bounds, n + len(at)
        self.parts = []
        for buckets, bounds, n in parts:
            self.parts.append((np.concatenate([np.zeros(0, np.int32), *buckets]), np.concatenate([np.zeros(0, np.int64), *bounds, [n]]).astype(np.int64)))
            buckets.clear()  # so that the n-grams of one n only are there twice

    def means(self, of_bucket: np.ndarray) -> np.ndarray:
        total, count = np.zeros(len(self.row)), np.zeros(len(self.row), np.int64)
        for bucket, bounds in self.parts:
            a = 0
            while a < len(self.row):  # segments with about BLOCK n-grams at a time
                b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + BLOCK, "right")) - 1)
                own, cuts = bucket[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
                sums = np.zeros(len(own) + 1)
                np.cumsum(of_bucket[own], dtype=np.float64, out=sums[1:])
                total[a:b] += sums[cuts[1:]] - sums[cuts[:-1]]
                a = b
            count += np.diff(bounds)
        return total / np.maximum(count, 1)

    def of(self, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the n-grams of some segments, and which of them each belongs to."""
        buckets, owners = [], []
        for bucket, bounds in self.parts:
            n = bounds[segments + 1] - bounds[segments]
            at = np.repeat(bounds[segments] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            buckets.append(bucket[at])
            owners.append(np.repeat(np.arange(len(segments)), n))
        return np.concatenate(buckets), np.concatenate(owners)


def _greatest(z: np.ndarray, row: np.ndarray, rows: int, k: int) -> np.ndarray:
    """The ``k`` segments with the greatest value of each row."""
    order = np.lexsort((-z, row))
    first = np.searchsorted(row[order], np.arange(rows))
    return order[np.arange(len(order)) - first[row[order]] < k]


def _sums(rows: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Sums of the rows of each group."""
    return np.stack([np.bincount(group, rows[:, c], groups) for c in range(rows.shape[1])], axis=1)


def fit(texts: list[str], toxic: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, batch: int = 64, seed: int = 1) -> tuple[np.ndarray, float]:
    """Value of each bucket and bias: the trained embeddings times the difference of the softmax's columns."""
    rng = np.random.default_rng(seed)
    table = np.empty((1 << BITS, WIDTH), np.float32)
    for part in np.split(table, 64):  # the numbers of one draw, without all of it in double precision
        part[:] = rng.normal(0, 1 / WIDTH, part.shape)
    softmax, bias = rng.normal(0, 1, (WIDTH, 2)), np.array([2.0, -2.0])
    past = np.full(1 << BITS, 1e-4, np.float32)
    past_softmax, past_bias = 1e-4, 1e-4
    grams = Grams(pa.array(texts, pa.string()))
    row, rows = grams.row, len(texts)
    weight = 0.5 * rows / np.maximum(1, np.where(toxic, toxic.sum(), (~toxic).sum()))
    for epoch in range(epochs):
        if epoch >= 3 and (epoch < 6 or epoch % 2):  # the greatest segments move slowly
            z = grams.means(table @ (softmax[:, 1] - softmax[:, 0]).astype(np.float32))
            lead, top = _greatest(z, row, rows, 1), _greatest(z, row, rows, 3)
        if epoch < 3:  # first any segments, until the greatest ones mean something
            chosen = np.flatnonzero(rng.random(len(row)) < 12 / np.bincount(row, minlength=rows)[row])
        else:
            chosen = np.concatenate((lead[toxic[row[lead]]], top[~toxic[row[top]]], np.flatnonzero(~toxic[row] & (rng.random(len(row)) < 2 / np.bincount(row, minlength=rows)[row]))))
        chosen = rng.permutation(chosen)
        for a in range(0, len(chosen), batch):
            segments = chosen[a : a + batch]
            own, owner = grams.of(segments)
            count = np.maximum(np.bincount(owner, minlength=len(segments)), 1)[:, None]
            mean = _sums(table[own], owner, len(segments)) / count
            logits = mean @ softmax + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            label = toxic[row[segments]].astype(int)
            p[np.arange(len(segments)), label] -= 1
            trust = 1 - np.abs(p[np.arange(len(segments)), label])[:, None]  # a label that the rest contradicts teaches less
            error = p * weight[row[segments]][:, None] * (trust**0.5 if epoch >= 8 else 1 if epoch >= 3 else 0.25)
            back = (error @ softmax.T) / np.sqrt(count)
            step = mean.T @ error
            past_softmax += float((step**2).mean())
            softmax -= 0.1 * step / np.sqrt(past_softmax)
            past_bias += float((error.sum(axis=0) ** 2).mean())
            bias -= 0.1 * error.sum(axis=0) / np.sqrt(past_bias)
            met, at = np.unique(own, return_inverse=True)
            past[met] += np.bincount(at, (back**2).mean(axis=1)[owner]).astype(np.float32)
            table[met] -= (rate * _sums(back[owner], at, len(met)) / np.sqrt(past[met])[:, None]).astype(np.float32)
    return (table @ (softmax[:, 1] - softmax[:, 0]).astype(np.float32)).astype(np.float32), float(bias[1] - bias[0])


def _filled(rows: list, size: int, row_size: int) -> list:
    """Rows in their order, each if it still fits ``size`` bytes; one over ``row_size`` only as the first."""
    out, used = [], 0
    for r in rows:
        if used + r.size <= size and (r.size <= row_size or not out):
            out.append(r)
            used += r.size
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, float]:
    """A model from labelled rows that are not held out. Texts are fetched once the sample is chosen by their sizes."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label is not null").filter(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
    own = own.groupBy("id").agg((F.max("label") == 1).alias("toxic"))
    told = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    sizes = told.select("id", F.octet_length("text").alias("size"), F.xxhash64("text").alias("hash"))
    known = settle(sizes.join(own, "id").distinct())
    order = [F.when(F.col("size") > ROW_BYTES, F.col("size")).otherwise(0), F.xxhash64("id"), "id", "hash"]  # over-long rows last
    chosen = [r for c in ("toxic", "not toxic") for r in _filled(known.filter(c).orderBy(*order).limit(sample).collect(), sample_bytes // 2, ROW_BYTES)]
    if not chosen:
        return np.zeros(1 << BITS, np.float32), -5.0
    names = docs.sparkSession.createDataFrame([(r.id, r.hash) for r in chosen], known.select("id", "hash").schema)
    texts = told.withColumn("hash", F.xxhash64("text")).join(F.broadcast(names), ["id", "hash"]).dropDuplicates(["id", "hash"])
    of = {(r.id, r.hash): r.text for r in texts.toLocalIterator()}
    model = fit([of[r.id, r.hash] for r in chosen], np.array([r.toxic for r in chosen], bool))
    give_back()
    return model


def scores(values: pa.Array, model: tuple[np.ndarray, float]) -> np.ndarray:
    table, bias = model
    out = np.full(len(values), -np.inf)
    segments = Segments(values)
    np.maximum.at(out, segments.row, segments.means(table))
    out = np.where(np.isfinite(out), out, 0) + bias
    return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def scored(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, score: str = "score") -> DataFrame:
    """``docs`` (id only, or the columns ``keep``) with a column ``score``; narrow, no shuffle."""
    keep = keep or [id_col]
    names = [f"c{k}" for k in range(len(keep))]

    def run(batches):
        for batch in portions(batches, text=0):
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores(batch.column(0), model))], names=[*names, "score"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    rows = docs.select(docs[text_col].alias("text"), *[docs[f"`{c}`"].alias(n) for c, n in zip(keep, names, strict=True)])
    out = rows.mapInArrow(run, ", ".join(f"{n} {kinds[c]}" for c, n in zip(keep, names, strict=True)) + ", score double")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], F.col("score").alias(score))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score``, ``predicted``."""
    out = scored(docs, train(docs, labels, id_col, text_col, label_col), id_col, text_col)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select(id_col, held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))

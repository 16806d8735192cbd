"""Language of a text by words first, then by ever shorter character n-grams (operator 11).

A word is a run of letters and marks in lower case. A word that the model knows is scored by its log
frequency in each language. An unseen word is scored by character n-grams: at each of its places by the longest that the
model knows, ``LONGEST`` characters with the word's ends at most and one fewer at each step back. Its
score is the mean over these places, so that it weighs like a known word. A text's score is the sum over its words.

The model is fitted on the driver to a bounded sample: of each language at most ``SAMPLE`` texts, those of least hash, whole, that fit
an equal part of ``SAMPLE_BYTES``; a text that does not fit is passed over, copies of a text count once, and a text over ``ROW_BYTES``
teaches only where its language has no shorter one. The ``LANGUAGES`` languages of most rows are learned, and of words and
n-grams the most frequent in ``CELLS`` numbers; both are bounds of the model's size, and it is sent to every task.

Defined results: a text that is null or has no letter is ``und`` with score 0. The score of another is the share
of the predicted language in the likelihood of all. Languages tied go by name.
Held out is false for a null id. Rows that repeat are predicted alike. Without any row to learn from, every
text is ``und``. An empty table gives an empty one. Further columns are not read.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, flat, mix, portions, powers, settle

LONGEST, SMOOTH = 5, 0.5
SAMPLE, SAMPLE_BYTES, ROW_BYTES = 2000, 4_000_000, 100_000
LANGUAGES, CELLS = 256, 1 << 23
#: Occurrences in the sample that a word or n-gram needs to be known.
LEAST = 2
#: Bytes of a long text that are read at once.
BLOCK = 1_000_000
BITS, SPACE = 20, 32
_RANGE = 1 << 30
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)


@functools.cache
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """For each code point the lower case of a letter or mark, a space for others; and whether it is a letter."""
    low, letter = np.full(0x110000, SPACE, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        x = chr(c)
        kind = unicodedata.category(x)[0]
        if kind in "LM":
            small = x.lower()
            low[c], letter[c] = ord(small) if len(small) == 1 else c, kind == "L"
    return low, letter


class Words:
    """The words of some texts: each word's row, its hash and its place in ``text``, the texts in lower case with spaces between."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low, letter = _alphabet()
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        begins = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
        self.letters = np.add.reduceat(np.append(letter[points], False), begins[:-1], dtype=np.int64) * (np.diff(begins) > 0) if len(begins) > 1 else np.zeros(0, np.int64)
        self.text = np.append(np.insert(low[points], begins[:-1], SPACE), np.uint32(SPACE)).astype(np.uint64)
        inside = self.text != SPACE
        self.start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        self.end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        self.row = np.searchsorted(begins[:-1] + np.arange(len(begins) - 1), self.start, "right") - 1
        forth, back = powers(len(self.text) + 1)
        sums = np.append(np.uint64(0), np.cumsum(mix(self.text + _STEP) * forth[:-1]))
        self.hash = mix((sums[self.end] - sums[self.start]) * back[self.start] + (self.end - self.start).astype(np.uint64))

    def grams(self, of: np.ndarray):
        """For each n, from the longest: where n-grams of the words ``of`` begin, which of the words each belongs to, and their keys."""
        size = self.end[of] - self.start[of] + 1  # a word's places, the space before it included
        owner = np.repeat(np.arange(len(of)), size)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + self.start[of][owner] - 1
        room = self.end[of][owner] + 1 - at
        h = [np.zeros(len(at), np.uint64)]
        for n in range(1, LONGEST + 1):
            h.append(h[-1] * _STEP + mix(self.text[np.minimum(at + n - 1, len(self.text) - 1)]))
        for n in range(LONGEST, 0, -1):
            fits = (room >= n) & ((n > 1) | (self.text[at] != SPACE))
            yield np.flatnonzero(fits), owner[fits], mix(h[n][fits] + np.uint64(n))


def _counted(keys: list[np.ndarray], languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all languages, in order, and how often each language has them."""
    every, column = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_inverse=True)
    owner = np.repeat(np.arange(languages), np.array([len(k) for k in keys], np.int64))
    return every, np.bincount(column * languages + owner, minlength=len(every) * languages).reshape(len(every), languages)


class Model:
    """Languages, and for words and n-grams their keys and log frequencies by language."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        words: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in self.langs]
        grams: list[list[list[np.ndarray]]] = [[[np.zeros(0, np.uint64)] for _ in self.langs] for _ in range(LONGEST)]
        for text, lang in zip(texts, langs, strict=True):
            k = self.langs.index(lang)
            w = Words(*flat(pa.array([text], pa.string())))
            words[k].append(w.hash)
            for n, (_, _, keys) in zip(range(LONGEST, 0, -1), w.grams(np.arange(len(w.start))), strict=True):
                grams[n - 1][k].append(keys)
        cells = CELLS // max(1, len(self.langs))
        self.words, self.word_logs = self._logs([words], cells // 4)
        self.grams, self.gram_logs = self._logs(grams, cells - len(self.words))

    def _logs(self, orders: list, most: int) -> tuple[np.ndarray, np.ndarray]:
        keys, logs, often = [], [], []
        for order in orders:
            every, n = _counted([np.concatenate(k) for k in order], len(self.langs))
            keys.append(every[n.sum(axis=1) >= LEAST])
            logs.append(np.log((n + SMOOTH) / (n.sum(axis=0) + SMOOTH * max(1, len(every))))[n.sum(axis=1) >= LEAST].astype(np.float32))
            often.append(n.sum(axis=1)[n.sum(axis=1) >= LEAST])
        key, log, n = np.concatenate(keys), np.concatenate(logs), np.concatenate(often)
        key, first = np.unique(key[np.lexsort((key, -n))[:most]], return_index=True)
        return key, log[np.lexsort((np.concatenate(keys), -n))[:most]][first]

    @functools.cached_property
    def _places(self) -> np.ndarray:
        """For each hash of a key the n-gram there, the last of those that meet, or -1."""
        out = np.full(1 << BITS, -1, np.int32)
        out[self._hash(self.grams)] = np.arange(len(self.grams), dtype=np.int32)
        return out

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        return (keys * _PRIME) >> np.uint64(64 - BITS)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_places"}

    def known_grams(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key among the n-grams, -1 for those not known."""
        at = self._places[self._hash(keys)]
        return np.where((at >= 0) & (self.grams[at] == keys), at, -1) if len(self.grams) else np.full(len(keys), -1)

    def sums(self, words: Words, rows: int) -> np.ndarray:
        """Per row and language: the sum of the scores of its words."""
        out = np.zeros((rows, len(self.langs)))
        each, first, of = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.words, each), max(0, len(self.words) - 1))
        seen = self.words[at] == each if len(self.words) else np.zeros(len(each), bool)
        unseen = np.flatnonzero(~seen)
        longest = None
        for place, owner, keys in words.grams(first[unseen]):
            if longest is None:
                places = int((words.end - words.start + 1)[first[unseen]].sum())
                longest, owners = np.full(places, -1, np.int64), np.zeros(places, np.int64)
            owners[place] = owner
            open_ = longest[place] < 0
            longest[place[open_]] = self.known_grams(keys[open_])
        hit = np.flatnonzero(longest >= 0)
        met = np.maximum(np.bincount(owners[hit], minlength=len(unseen)), 1)
        score = np.zeros(len(each))
        for k in range(len(self.langs)):  # one language after another bounds the memory
            score[seen] = self.word_logs[at[seen], k]
            score[unseen] = np.bincount(owners[hit], self.gram_logs[longest[hit], k], len(unseen)) / met
            out[:, k] = np.bincount(words.row, score[of], rows)
        return out

    def predicted(self, values: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        if not self.langs:
            return ["und"] * len(values), np.zeros(len(values))
        data, offsets = flat(values)
        sums, letters = np.zeros((len(values), len(self.langs))), np.zeros(len(values), np.int64)
        for a, b in _pieces(data, BLOCK if len(values) == 1 else len(data)):
            words = Words(data[a:b], np.array([0, b - a]) if len(values) == 1 else offsets)
            sums += self.sums(words, len(values))
            letters += words.letters
        best = sums.argmax(axis=1)
        share = 1 / np.exp(np.clip(sums - sums.max(axis=1, keepdims=True), -700, 0)).sum(axis=1)
        return ["und" if not n else self.langs[k] for k, n in zip(best.tolist(), letters.tolist(), strict=True)], np.where(letters > 0, share, 0.0)


def _pieces(data: np.ndarray, size: int):
    """Bounds of pieces of about ``size`` bytes that end after white space; an unbroken run is in one piece."""
    a = 0
    while a < len(data):
        b = a + size
        if b < len(data):
            cut = np.flatnonzero(_SPACE[data[a:b]])
            while not len(cut) and b < len(data):
                cut = np.flatnonzero(_SPACE[data[b : b + size]]) + b - a
                cut, b = cut[:1], b + size
            b = a + int(cut[-1]) + 1 if len(cut) else len(data)
        yield a, min(b, len(data))
        a = b


def _held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, row_bytes: int = ROW_BYTES) -> Model:
    """A model of the rows that are not held out and have a language. Texts are fetched once the sample is chosen by their sizes."""
    told = docs.filter(~_held_out(id_col)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    sizes = told.select("lang", F.octet_length("text").alias("size"), F.xxhash64("text").alias("hash")).filter("size > 0")
    each = settle(sizes.groupBy("lang", "hash").agg(F.max("size").alias("size"), F.count("*").alias("n")))
    short = F.col("size") <= row_bytes
    many = each.groupBy("lang").agg(F.sum("n").alias("n"), F.count_if(short).alias("short"), F.count("*").alias("all")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    langs = [r.lang for r in many]
    # of a language's texts the part whose hashes are expected to hold twice the sample; each is taken where it lies
    bounds = [(r.lang, r.short > 0, min(_RANGE, 2 * sample * _RANGE // (r.short or r.all) + 1)) for r in many]
    bounds = F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, shorter boolean, bound bigint"))
    least = each.join(bounds, "lang").filter((short | ~F.col("shorter")) & (F.pmod("hash", F.lit(_RANGE)) < F.col("bound"))).select("lang", "size", "hash")
    chosen, used, held = [], dict.fromkeys(langs, 0), dict.fromkeys(langs, 0)
    for r in sorted(least.collect(), key=lambda r: (r.lang, r["size"] if r["size"] > row_bytes else 0, r.hash % _RANGE, r.hash)):
        if held[r.lang] < sample and used[r.lang] + r["size"] <= sample_bytes // len(langs):
            used[r.lang] += r["size"]
            held[r.lang] += 1
            chosen.append((r.lang, r.hash))
    if not chosen:
        return Model([], [])
    names = docs.sparkSession.createDataFrame(chosen, "lang string, hash bigint")
    texts = told.withColumn("hash", F.xxhash64("text")).join(F.broadcast(names), ["lang", "hash"]).groupBy("lang", "hash").agg(F.min("text").alias("text")).orderBy("lang", "hash")
    rows = [(r.text, r.lang) for r in texts.toLocalIterator()]
    return Model([t for t, _ in rows], [x for _, x in rows])


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``lang_pred``, ``score``; narrow, no shuffle."""

    def run(batches):
        for batch in portions(batches, text=2):
            lang, score = model.predicted(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score)], names=["id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), _held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Trains and predicts."""
    return identified(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)

"""Quality rules with tokeniser fertility (operator 7).

Two public vocabularies encode each whole text: a multilingual byte-level one gives characters per
token and the entropy of the tokens (over its greatest value for as many), one with byte fallback
the share of bytes that it can only give as byte pieces, those of characters without a piece. Each measure is held against a band of its language.

Entropy falls with length, so a band is a line over the logarithm of the number of tokens, fitted to the
documents of the language that pass the base rules, and reaches ``WIDTH`` interquartile ranges of
their distances from it. Line and range of a language are averaged with those of all documents, which weigh as much as
``PRIOR`` documents, so bands change smoothly with the size of a language and of the table; nothing switches at
a size. A band is never narrower than ``LEAST``.

Defined results: a null or empty text has no words and fails the base rules. A null
language is a language. Repeated rows are judged each. Without documents that pass the base rules there is nothing to judge. Further
columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import WHITE, flat, mix, per_row, portions, settle, word_hashes

WIDTH, PRIOR = 5.0, 50
#: Least half widths of the bands, in the measures' own units.
LEAST = {"chars_per_token": 0.1, "byte_share": 0.02, "entropy": 0.06}
#: Steps of the quartiles' grid in a measure's unit.
GRID = 1 << 14
#: Bytes of a row for each language, and of all of them that are sent to every task at most.
ROW_BYTES, BROADCAST_BYTES = 200, 8_000_000
#: Fixed value: the characters that count as symbols.
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_BLANK = WHITE.decode()


@lru_cache(maxsize=2)
def _coder(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("fertility", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _fallback(path: str) -> tuple[np.ndarray, np.ndarray]:
    """For each code point its UTF-8 bytes, and how many of them the vocabulary can only give as byte pieces: all, if it has no piece for the character, else none."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    point = np.arange(0x110000)
    width = (1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)).astype(np.uint8)
    lost = width.copy()
    # the piece of a space is U+2581
    lost[[ord(p) for p in map(model.id_to_piece, range(model.get_piece_size())) if len(p) == 1] + [ord(" ")]] = 0
    return width, lost


def fertility(text: str, path: str, fallback: str | None = None) -> tuple[int, float, float, float]:
    """Number of tokens, characters per token, share of bytes that fall back to byte pieces in the other vocabulary, entropy over log2 of the number."""
    coder, (width, lost) = _coder(path), _fallback(fallback or bpe.vocabulary_path("piece_bpe_32k.model"))
    found, n, size, fell = [], 0, 0, 0
    for part in bpe.parts(text):
        ids = coder.encode_to_numpy(part, disallowed_special=())
        n += len(ids)
        found.append(np.unique(ids, return_counts=True))
        points = np.frombuffer(part.encode("utf-32-le"), np.uint32)
        size += int(width[points].sum(dtype=np.int64))
        fell += int(lost[points].sum(dtype=np.int64))
    if not n:
        return 0, 0.0, 0.0, 1.0
    if len(found) > 1:
        counts = np.zeros(coder.n_vocab, np.int64)
        for ids, times in found:
            counts[ids] += times
        found = [(None, counts[counts > 0])]
    p = found[0][1] / n
    return n, len(text) / n, fell / size, float(-(p * np.log2(p)).sum() / np.log2(n)) if n > 1 else 1.0


def base_counts(values: pa.Array, texts: list[str]) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    rows = len(values)
    data, offsets = flat(values)
    words, row, _, _ = word_hashes(data, offsets)
    n_words = np.bincount(row, minlength=rows)
    white = np.zeros(256, bool)
    white[list(WHITE)] = True
    white[0x80:0xC0] = True  # nor do bytes within a character begin one
    word_chars = per_row(~white[data], offsets)
    n_symbols = per_row(_SYMBOLS[data], offsets)
    n_repeat = np.zeros(rows, np.int64)
    if len(words) > 2:
        own = mix(row.astype(np.uint64) + np.uint64(1))
        h = mix(words[:-2] + np.uint64(3) * words[1:-1] + np.uint64(9) * mix(words[2:])) + own[:-2]
        h[row[:-2] != row[2:]] = 0
        order = np.argsort(h)
        same = (h[order][1:] == h[order][:-1]) & (h[order][1:] != 0)
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : len(words) - 2 + k] |= twice
        n_repeat = np.bincount(row[covered], minlength=rows)
    lines = [[x for x in t.split("\n") if x.strip(_BLANK)] if "\n" in t else [] for t in texts]
    n_dup = np.array([len(x) - len(set(x)) for x in lines], np.int64)
    return [n_words, word_chars, n_symbols, n_dup, n_repeat]


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MEASURES = ("chars_per_token", "byte_share", "entropy")


def measured(docs: DataFrame, path: str, fallback: str, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    def run(batches):
        for batch in portions(batches):
            texts = batch.column(1).to_pylist()
            counts = base_counts(batch.column(1), texts)
            n, *rest = zip(*[fertility(t, path, fallback) for t in texts], strict=True)
            cols = [batch.column(0), batch.column(2), *[pa.array(np.asarray(c, np.int64)) for c in (*counts, n)], *[pa.array(r, pa.float64()) for r in rest]]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "lang", *_COUNTS, "n_tokens", *_MEASURES])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return rows.mapInArrow(run, f"id {kind}, lang string, {', '.join(f'{c} bigint' for c in (*_COUNTS, 'n_tokens'))}, {', '.join(f'{m} double' for m in _MEASURES)}")


def _small(per_language: DataFrame) -> DataFrame:
    """One row for each language, sent to every task if there are few enough; the same join by a shuffle otherwise."""
    return F.broadcast(per_language) if per_language.count() * ROW_BYTES <= BROADCAST_BYTES else per_language


def _quartiles(off: DataFrame, by: list[str]) -> DataFrame:
    """``<measure>_q``: the three quartiles of each measure, told by counts on a grid, so that they are the same however the rows are dealt."""
    values = off.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.floor(F.col(m) * GRID).alias("at")) for m in _MEASURES])).alias("v")).select(*by, "v.m", "v.at")
    counts = values.filter("at is not null").groupBy(*by, "m", "at").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*by, "m")
    upto = F.sum("n").over(whole.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))  # a row for each step of the grid that is met
    placed = counts.withColumn("upto", upto).withColumn("all", F.sum("n").over(whole))
    quarter = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("all") * k, F.col("at"))) / GRID
    told = placed.groupBy(*by, "m").agg(F.array(quarter(1), quarter(2), quarter(3)).alias("q"))
    return told.groupBy(*by).agg(*[F.max_by(F.when(F.col("m") == m, F.col("q")), F.col("m") == m).alias(f"{m}_q") for m in _MEASURES])


def bands(rows: DataFrame, width: float, prior: float) -> DataFrame:
    """Per language (``of``): ``slope``, ``middle`` and ``half`` of the band of each measure; ``middle`` is where its line is at ``size`` 0.

    All sums combine before the shuffle; a row for each language, and one for all of them under a language of their own.
    """
    good = rows.filter("not base_failed")
    # every document counts for its language and for all
    both = good.select(F.explode(F.array(F.struct(F.lit(False).alias("all"), "lang"), F.struct(F.lit(True).alias("all"), F.lit(None).cast("string").alias("lang")))).alias("of"), "size", *_MEASURES)
    line = [F.struct(F.coalesce(F.regr_slope(m, "size"), F.lit(0.0)).alias("slope"), F.avg(m).alias("mean")).alias(m) for m in _MEASURES]
    lines = settle(both.groupBy("of").agg(F.count("*").cast("double").alias("n"), F.avg("size").alias("at"), *line))
    # the languages' own lines, drawn towards that of all
    told = lines.filter("not of.all").crossJoin(F.broadcast(lines.filter("of.all").select(F.col("at").alias("at0"), *[F.col(m).alias(f"{m}0") for m in _MEASURES])))  # one row
    own = F.col("n") / (F.col("n") + F.lit(float(prior)))
    mixed = lambda a, b: own * a + (1 - own) * b
    start = lambda m, k, at: F.col(f"{m}{k}.mean") - F.col(f"{m}{k}.slope") * F.col(at)
    lined = told.select(F.col("of.lang").alias("of"), own.alias("own"), *[F.struct(mixed(F.col(f"{m}.slope"), F.col(f"{m}0.slope")).alias("slope"), mixed(start(m, "", "at"), start(m, 0, "at0")).alias("start")).alias(m) for m in _MEASURES])
    off = good.join(_small(lined), F.col("lang").eqNullSafe(F.col("of"))).select("lang", *[(good[m] - lined[m]["start"] - lined[m]["slope"] * F.col("size")).alias(m) for m in _MEASURES])
    off = settle(off)
    each, every = _quartiles(off, ["lang"]), _quartiles(off, []).select(*[F.col(f"{m}_q").alias(f"{m}_q0") for m in _MEASURES])
    q = lined.join(each, F.col("of").eqNullSafe(F.col("lang"))).drop("lang").crossJoin(F.broadcast(every))  # one row

    def band(m: str):
        at = lambda k: mixed_by(F.get(f"{m}_q", k), F.get(f"{m}_q0", k))
        mixed_by = lambda a, b: F.col("own") * a + (1 - F.col("own")) * b
        half = F.greatest(F.lit(LEAST[m]), F.lit(width) * (at(2) - at(0)))
        return F.struct(F.col(f"{m}.slope").alias("slope"), (F.col(f"{m}.start") + at(1)).alias("middle"), half.alias("half")).alias(f"{m}_band")

    return settle(q.select("of", *[band(m) for m in _MEASURES]))


def judged(docs: DataFrame, path: str | None = None, fallback: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", width: float = WIDTH, prior: float = PRIOR) -> DataFrame:
    """One row per row of ``docs``: id, the base counts, ``base_failed``, ``kept`` and the measures."""
    path, fallback = path or bpe.vocabulary_path("byte_bpe_multi_50k.tiktoken"), fallback or bpe.vocabulary_path("piece_bpe_32k.model")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = measured(docs, path, fallback, id_col, text_col, lang_col).withColumn("base_failed", failed)
    rows = settle(rows.withColumn("size", F.log2(F.greatest("n_tokens", F.lit(1)))))
    out = rows.join(_small(bands(rows, width, prior)), F.col("lang").eqNullSafe(F.col("of")), "left")
    middle = lambda m: F.col(f"{m}_band.middle") + F.col(f"{m}_band.slope") * F.col("size")
    below = lambda m: F.col(m) < middle(m) - F.col(f"{m}_band.half")
    above = lambda m: F.col(m) > middle(m) + F.col(f"{m}_band.half")
    outside = below("chars_per_token") | above("chars_per_token") | above("byte_share") | below("entropy")
    kept = ~F.col("base_failed") & ~F.coalesce(outside, F.lit(False))
    return out.select(F.col("id").alias(id_col), *_COUNTS, "base_failed", kept.alias("kept"), "n_tokens", *_MEASURES)

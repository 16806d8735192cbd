import re
from collections import Counter

import numpy as np
import pytest
import pyarrow as pa

from lineagelake.llm import quality
from lineagelake.llm.quality import base_counts, fertility, judged


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(tri)
    covered = {i + k for i, t in enumerate(tri) if counts[t] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


ODD = ["", None, " ", "a", "a b a b a b", "x\nx\n x\n\n\nx", "#*$%&|<>é\u00a0b\x1cc", "a b c a b c", "a b c d", "one two three " * 40, "ab\x0bcd\x0cef\r\n"]


def test_counts(spark):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    values = pa.array([t or "" for t in texts])
    got = list(zip(*[c.tolist() for c in base_counts(values, values.to_pylist())], strict=True))
    assert got == [brute(t) for t in texts]


def test_long_texts_in_parts(monkeypatch):
    path = quality.bpe.vocabulary_path("byte_bpe_multi_50k.tiktoken")
    for text in (" ".join(f"wörd{i}, it's" for i in range(3000)), "abcdefghij" * 300, "語" * 5000, "a1" * 4000, " " * 3000 + "x" * 3000 + "  \n" * 999, "-= " * 2000):
        whole = fertility(text, path)
        with monkeypatch.context() as m:
            m.setattr(quality.bpe, "PART", 1000)
            assert fertility(text, path) == pytest.approx(whole), text[:20]


def test_bands_move_smoothly(spark):
    """A language of 49 documents and one of 50 are judged alike, and so is the same table twice over."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en'").orderBy("doc_id").limit(200)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    schema = "doc_id bigint, text string, lang string"
    for n in (49, 50):
        part = {r.doc_id: r.kept for r in judged(spark.createDataFrame(rows[:n], schema)).collect()}
        more = {r.doc_id: r.kept for r in judged(spark.createDataFrame(rows[: n + 1], schema)).collect()}
        assert sum(part[i] != more[i] for i in part) <= 1
    once = {r.doc_id: r.kept for r in judged(spark.createDataFrame(rows, schema)).collect()}
    twice = {r.doc_id: r.kept for r in judged(spark.createDataFrame(rows + [(i + 10_000, t, x) for i, t, x in rows], schema)).collect()}
    assert all(twice[i] == k for i, k in once.items())


def test_fallback_bytes():
    path = quality.bpe.vocabulary_path("byte_bpe_multi_50k.tiktoken")
    assert fertility("plain words", path)[2] == 0 and fertility("\U0001f9ff\U0001f9ff", path)[2] > 0.5


def test_verdicts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = judged(docs).collect()
    assert len(out) == len(texts)
    for r in out:
        n = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.kept and r.base_failed)
    passed = [r for r in out if not r.base_failed and r.doc_id in labels]
    good, bad = [r.kept for r in passed if labels[r.doc_id] == 1], [r.kept for r in passed if labels[r.doc_id] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.4 * len(bad)


def test_odd_rows(spark):
    df = spark.createDataFrame([(i, t, None, 1) for i, t in enumerate(ODD)] + [(None, "x y", "en", 1)] * 2, "doc_id bigint, text string, lang string, band int")
    assert len(judged(df).collect()) == len(ODD) + 2
    assert judged(df.limit(0)).collect() == []


def test_fallback_bytes_like_the_library():
    import duckdb
    import sentencepiece

    path, other = quality.bpe.vocabulary_path("byte_bpe_multi_50k.tiktoken"), quality.bpe.vocabulary_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=other)
    texts = [t or "" for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    texts += ["", " ", "a", " a", "a ", "a  b", "a\nb c\n\nd", "\u2581x \u2581", "é ﬁ Ⅳ \u00a0x", "\t\tx y", "\U0001f9ff 語 語語", "a\u2003b c", "\u0301 e \u0301", "\r\n\x00\x7f"]
    for t in texts:
        want = sum(model.is_byte(i) for i in model.encode(t))
        assert round(fertility(t, path)[2] * len(t.encode())) == want, t[:40]


def test_bands_like_numpy(spark):
    """Lines, ranges and verdicts recomputed in numpy from the measures."""
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = judged(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    good = out[~out.base_failed].copy()
    good["size"], good["lang"] = np.log2(np.maximum(good.n_tokens, 1)), good.lang.fillna("none")

    def line(rows, m):
        x, y = rows["size"], rows[m]
        slope = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum() if x.nunique() > 1 else 0.0
        return slope, y.mean() - slope * x.mean()

    want = good.base_failed == False  # noqa: E712
    for m, least in quality.LEAST.items():
        off, half = good[m] * 0.0, good[m] * 0.0
        every = line(good, m)
        for lang, rows in good.groupby("lang"):
            own = len(rows) / (len(rows) + quality.PRIOR)
            slope, start = [own * a + (1 - own) * b for a, b in zip(line(rows, m), every, strict=True)]
            off[rows.index] = rows[m] - start - slope * rows["size"]
        total = off.quantile([0.25, 0.5, 0.75], interpolation="lower").to_numpy()
        for lang, rows in good.groupby("lang"):
            own = len(rows) / (len(rows) + quality.PRIOR)
            q = own * off[rows.index].quantile([0.25, 0.5, 0.75], interpolation="lower").to_numpy() + (1 - own) * total
            half[rows.index] = max(least, quality.WIDTH * (q[2] - q[0]))
            off[rows.index] -= q[1]
        want &= ~((off.abs() > half) if m == "chars_per_token" else (off > half) if m == "byte_share" else (off < -half))
    assert (want != good.kept).sum() <= 2  # quantiles of Spark are those of a sketch


def test_quartiles_like_sorted_values(spark):
    """However the rows are dealt, the quartiles are those of the sorted values, to a step of the grid."""
    rng = np.random.default_rng(8)
    rows = [(["de", None, "x"][k % 3], *[float(v) for v in rng.normal(0, 1, 3)]) for k in range(500)] + [("one", 0.5, 0.5, -0.5)]
    df = spark.createDataFrame(rows, "lang string, chars_per_token double, byte_share double, entropy double")
    one = {r.lang: r for r in quality._quartiles(df.repartition(1), ["lang"]).collect()}
    assert one == {r.lang: r for r in quality._quartiles(df.repartition(7), ["lang"]).collect()} and len(one) == 4
    for lang, r in one.items():
        for c, m in enumerate(quality._MEASURES):
            own = np.sort([row[c + 1] for row in rows if row[0] == lang])
            want = [own[-(-len(own) * k // 4) - 1] for k in (1, 2, 3)]
            assert np.allclose(r[f"{m}_q"], want, atol=1.1 / quality.GRID)

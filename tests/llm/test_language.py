import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lineagelake.llm import language
from lineagelake.llm.language import LEAST, LONGEST, SMOOTH, Model, identified, languages, train

SF = "/root/testdata/sf0.01"


def words(text):
    out, now = [], ""
    import unicodedata

    for c in (text or "") + " ":
        if unicodedata.category(c)[0] in "LM":
            now += c.lower() if len(c.lower()) == 1 else c
        elif now:
            out.append(now)
            now = ""
    return out


def grams(word, n):
    p = f" {word} "
    return [p[i : i + n] for i in range(len(p) - n + 1) if p[i : i + n] != " "]


class Brute:
    """The same model in dictionaries."""

    def __init__(self, texts, langs):
        self.langs = sorted(set(langs))
        tables = [[words(t) for t in texts]] + [[[g for w in words(t) for g in grams(w, n)] for t in texts] for n in range(1, LONGEST + 1)]
        self.logs = []
        for table in tables:
            counts = {}
            for items, lang in zip(table, langs, strict=True):
                for x in items:
                    counts.setdefault(x, dict.fromkeys(self.langs, 0))[lang] += 1
            total = {k: sum(c[k] for c in counts.values()) for k in self.langs}
            self.logs.append({x: [math.log((c[k] + SMOOTH) / (total[k] + SMOOTH * len(counts))) for k in self.langs] for x, c in counts.items() if sum(c.values()) >= LEAST})

    def sums(self, text):
        out = np.zeros(len(self.langs))
        for w in words(text):
            if w in self.logs[0]:
                out += self.logs[0][w]
                continue
            p, found = f" {w} ", []
            for i in range(len(p) - 1):
                known = [p[i : i + n] for n in range(min(LONGEST, len(p) - i), 0, -1) if p[i : i + n] in self.logs[n]]
                found += [self.logs[len(known[0])][known[0]]] if known else []
            out += np.mean(found, axis=0) if found else 0
        return out


TEXTS = ["Der Hund läuft, der Hund bellt und die Katze schläft.", "The dog runs and the dog barks while the cat sleeps.", "El perro corre y el perro ladra, el gato duerme.", "Größe ǅ İ naïve été"]
ASKED = ["Die Hunde laufen", "dogs barking", "el gato perruno", "", "123 !!", "ÄÖ", "漢字かな", "x", "á́", "́", "der\nthe\tel", "  the  ", "ẞtraße " * 30, "Ω" * 50]


def test_like_brute_force():
    langs = ["de", "en", "es", "de"]
    own, plain = Model(TEXTS, langs), Brute(TEXTS, langs)
    values = pa.array(ASKED, pa.string())
    data, offsets = language.flat(values)
    got = own.sums(language.Words(data, offsets), len(ASKED))
    assert np.allclose(got, [plain.sums(t) for t in ASKED], atol=1e-4)
    lang, score = own.predicted(values)
    for t, x, s in zip(ASKED, lang, score, strict=True):
        assert (x == "und" and s == 0) if not any(c.isalpha() for c in t) else x in plain.langs and 0 < s <= 1


def test_long_text(monkeypatch):
    """Pieces of a long text add up to the whole."""
    model = Model(TEXTS, ["de", "en", "es", "de"])
    text = " ".join(ASKED * 40) + "y" * 500 + " the dog"
    whole = model.predicted(pa.array([text]))
    data, offsets = language.flat(pa.array([text]))
    want = model.sums(language.Words(data, offsets), 1)
    monkeypatch.setattr(language, "BLOCK", 64)
    parts = [language.Words(data[a:b], np.array([0, b - a])) for a, b in language._pieces(data, 64)]
    assert len(parts) > 50 and np.allclose(sum(model.sums(w, 1) for w in parts), want)
    assert model.predicted(pa.array([text]))[0] == whole[0]


def test_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)


def test_learns_only_from_its_rows(spark):
    """Other rows and other columns change nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300).select("doc_id", "text", "lang")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = train(docs)
    moved = train(docs.withColumn("lang", F.when(out, "xx").otherwise(F.col("lang"))).withColumn("text", F.when(out, F.lit("xx xx")).otherwise(F.col("text"))))
    assert model.langs == moved.langs and np.array_equal(model.grams, moved.grams) and np.array_equal(model.gram_logs, moved.gram_logs)


@pytest.mark.parametrize("bound", [{}, {"sample": 3}, {"sample_bytes": 200}, {"row_bytes": 10}])
def test_rows(spark, bound):
    rows = [(k, t, lang, "s") for k, (t, lang) in enumerate(zip(TEXTS * 5, ["de", "en", None, "de"] * 5, strict=True))]
    rows += [(100, None, "de", "s"), (101, "", "en", "s"), (102, "1 2 3", "en", None), (None, "the dog", "en", "s"), (103, "Der Hund", None, "s"), (103, "Der Hund", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string").withColumn("hash", F.lit(1))
    out = {(r.doc_id, r.lang_pred) for r in identified(docs, train(docs, **bound)).collect()}
    assert {(100, "und"), (101, "und"), (102, "und"), (103, "de"), (None, "en")} <= out and not any(x == "es" for _, x in out)


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert languages(empty).collect() == []
    assert [tuple(r) for r in languages(spark.createDataFrame([(1, "the dog", None)], empty.schema)).collect()] == [(1, False, "und", 0.0)]

"""Signed sums of features are told where the text is, without a row for a feature."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lineagelake.functions import hashing
from lineagelake.operators import similar


def test_sums_like_features_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(similar, "PORTION", 40, raising=False)
    texts = ["", "a", "ab ab", "The the THE cat's", "  éàü 日本語テキスト ñandú x ", "one two three " * 30, None, "!?", "İstanbul ǅ ß", "𝔘𝔫𝔦 a𝔘b٣٤٥"]
    docs = spark.createDataFrame([(f"k{i % 8}", t) for i, t in enumerate(texts)], "name string, text string")
    h = docs.select("name", F.explode(hashing.features(F.col("text"))).alias("f")).select("name", hashing.fnv1a_long(F.col("f")).alias("h"))
    want = h.groupBy("name", F.col("h").bitwiseAND(F.lit(255)).alias("bucket")).agg(F.sum(F.when(F.col("h") < 0, -1).otherwise(1)).alias("sum")).filter("sum <> 0")
    got = similar.signed(docs, "name", "text")
    got_rows, want_rows = sorted(map(tuple, got.collect())), sorted(map(tuple, want.collect()))
    assert got_rows == want_rows and len(got_rows) > 30
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()  # no row for a word or feature


def test_no_words():
    assert [len(x) for x in hashing.feature_sums(pa.array(["", " ", "  "], pa.large_string()))] == [0, 0, 0]
    assert [len(x) for x in hashing.feature_sums(pa.array([], pa.large_string()))] == [0, 0, 0]


def test_weights_of_both_sides_from_one_meeting():
    linked = np.random.default_rng(2).random((7, 5)) < 0.4
    for weights in (np.arange(1, 8), np.arange(1, 8) * 2**40 + 1):
        down, across = similar._sums(linked, weights, weights[:5])
        assert down.tolist() == [sum(int(w) for w, x in zip(weights[:5], r, strict=True) if x) for r in linked]
        assert across.tolist() == [sum(int(w) for w, x in zip(weights, c, strict=True) if x) for c in linked.T]


def test_bounds_in_single_precision_let_the_same_through():
    for bound in (0.4, 0.9, 0.5, 0.1):
        around = [np.nextafter(np.float32(bound), np.float32(to)) for to in (0, 1)] + [np.float32(bound)]
        assert all((x >= similar._least32(np.float64(bound))) == (np.float64(x) >= bound) for x in around)

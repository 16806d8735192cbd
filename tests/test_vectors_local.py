"""Features stay where their text is; blocks of whole numbers are narrow; pairs are told once without a shuffle."""

from pyspark.sql import functions as F

from lineagelake.functions import hashing
from lineagelake.operators import similar
from lineagelake.plans import blocks


def test_only_texts_are_shuffled(spark):
    docs = spark.createDataFrame([(1, "one two three two"), (1, "two"), (2, None)], "doc_id bigint, text string")
    told = similar.counted_features(docs, "doc_id", "text").groupBy("key", "feature").agg(F.sum("n").alias("n"))
    assert told._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r.key, r.feature): r.n for r in told.collect()}
    want = docs.select("doc_id", F.explode(hashing.features(F.col("text"))).alias("f")).groupBy("doc_id", "f").count().collect()
    assert got == {(r.doc_id, r.f): r["count"] for r in want}


def test_hash_of_buffers(spark):
    rows = spark.createDataFrame([(t,) for t in ("", "a", "éà", "word", "x" * 300, "日本語")], "t string").repartition(1)
    assert all(r.a == r.b for r in rows.select(F.lpad(F.lower(F.hex(hashing.fnv1a_long(F.col("t")))), 16, "0").alias("a"), hashing.fnv1a_hex(F.col("t")).alias("b")).collect())


def test_blocks_are_narrow(spark):
    rows = spark.createDataFrame([(1, [1, -3, 0]), (2, [0, 0, 100])], "id bigint, vector array<bigint>").repartition(1)
    assert [(r.kind, len(r.parts)) for r in blocks.packed(rows, ["id"], "int64").collect()] == [("int8", 6)]
    wide = rows.withColumn("vector", F.transform("vector", lambda x: x * 2**40))
    assert [(r.kind, len(r.parts)) for r in blocks.packed(wide, ["id"], "int64").collect()] == [("int64", 48)]

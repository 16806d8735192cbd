from pyspark.sql import functions as F

from lineagelake.operators import layers
from lineagelake.streaming import feed


def test_batches_write_what_they_touch(spark, tmp_path):
    source, kept = str(tmp_path / "in"), str(tmp_path / "state")
    rows = spark.range(400).select((F.col("id") % 100).alias("k"), F.col("id").alias("seq"), (F.col("id") * 3).alias("x"))
    rows.filter("seq < 300").write.mode("append").parquet(source)
    run = lambda: feed.maintain(feed.feed(spark, source, 1000), ["k"], "seq", kept, str(tmp_path / "ck"), lambda df: df.agg(F.count("*").alias("n"))).awaitTermination()
    run()
    rows.filter("seq = 301").coalesce(1).write.mode("append").parquet(source)
    run()
    last = max(feed._versions(spark, kept))
    assert len(feed._versions(spark, kept)[last]) == 1
    rows.filter("seq > 301").coalesce(1).write.mode("append").parquet(source)
    run()
    want = {tuple(r) for r in layers.upsert(rows.filter("seq < 300 or seq >= 301"), ["k"], "seq").collect()}
    assert {tuple(r) for r in feed.state(spark, kept).select("k", "seq", "x").collect()} == want
    assert sum(len(b) for b in feed._versions(spark, kept).values()) <= 2 * feed.BUCKETS + 1
    assert spark.read.parquet(f"{kept}/derived{max(feed._versions(spark, kept))}").first().n == 100


def test_correspondences_across_identifiers(spark):
    rows = [(1, "p", "1", ["a", "b"]), (2, "p", "1", ["b"]), (3, "p", "1", ["c"]), (4, "p", "2", ["a"]), (5, "p", "1", ["c", "b"]), (6, "q", "1", None), (7, "q", "1", [None, "a"]), (10, "q", "1", ["a"])]
    out = layers.correspondences(spark.createDataFrame(rows, "row bigint, package string, version string, ids array<string>"))
    assert {tuple(r) for r in out.collect()} == {(1, 1), (2, 1), (3, 1), (5, 1), (4, 4), (6, 6), (7, 7), (10, 7)}

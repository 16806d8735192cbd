import random
import sqlite3

import pytest

from lineagelake import queries, queries_stored
from lineagelake.operators import memory
from lineagelake.sources import snapshot
from lineagelake.streaming import recency

SF = "/root/testdata/sf0.001"


def test_filters_are_left_to_the_files(spark):
    path = queries_stored._snapshot(spark, SF)
    nodes = snapshot.table(spark, path, "nodes")
    found = nodes.filter("type = 'struct' and id > 20 and file_id in (1, 2, 3) and qualified_name is not null")
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [EqualTo(type,struct), GreaterThan(id,20), In(file_id, [1,2,3])]" in plan
    want = nodes.toPandas()
    want = want[(want.type == "struct") & (want.id > 20) & want.file_id.isin([1, 2, 3]) & want.qualified_name.notna()]
    assert {r.id for r in found.collect()} == set(want.id) and len(want)
    assert nodes.rdd.getNumPartitions() == 8 and [tuple(r) for r in snapshot.table(spark, path, "meta").distinct().collect()] == [("snapshot_source_commit", "abc123")]


def test_no_snapshot(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "x.db")
    con.execute("create table files (id integer, path text)")
    con.commit()
    with pytest.raises(Exception, match="no table edges, meta, nodes"):
        snapshot.table(spark, str(tmp_path / "x.db"), "files").collect()


def test_recency_with_forgets(spark, tmp_path):
    """State over four runs of the stream equals the state of the whole log."""
    rng = random.Random(7)
    rows = [(f"k{rng.randrange(8)}", t, rng.choice(["get", "get", "put", "forget"]), rng.choice([None, t * 10])) for t in range(200)]
    schema = "key string, tick bigint, op string, bytes bigint"
    log, was = str(tmp_path / "log"), spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", recency.PROVIDER)
    try:
        for a in range(0, 200, 50):
            spark.createDataFrame(rows[a : a + 50], schema).repartition(3).write.mode("append").parquet(log)
            stream = recency.recency(spark.readStream.schema(schema).parquet(log))
            stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if was is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    got = {tuple(r) for r in recency.latest(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {tuple(r) for r in memory.cache_state(spark.createDataFrame(rows, schema)).select("key", "bytes", "hits", "last_used").collect()}
    assert "cache_recency" in queries.QUERIES

import glob
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from lineagelake.operators import bundles, dispatch, incremental, links
from lineagelake.plans import lineage
from lineagelake.sources import graph, layers

SF = "/root/testdata/sf0.001"


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_only_the_layer_changes(spark, tmp_path):
    e, path = graph.edges(spark, SF), str(tmp_path / "layers")
    layers.rebuild(e, path)
    assert {tuple(x.values()) for x in layers.layers(spark, path)} == {("derived", None), ("authored", None), ("inferred", "embedding:hash/v1")}
    before = files(path)
    layers.replace(e.filter("provenance = 'authored'").limit(5), path)
    after = files(path)
    assert {f for f in before if "provenance=authored" not in f} == {f for f in after if "provenance=authored" not in f}
    assert all(before[f] == after[f] for f in after if f in before) and not any(f in before for f in after if "provenance=authored" in f)
    assert layers.delete(spark, path, provenance="inferred", src_ref="embedding:hash/v1") == 1 and layers.delete(spark, path, src_ref="gone") == 0
    back = layers.read(spark, path, e.schema)
    assert back.columns == e.columns and {r.provenance: r["count"] for r in back.groupBy("provenance").count().collect()} == {"authored": 5, "derived": e.filter("provenance = 'derived'").count()}
    plan = back.filter("provenance = 'authored'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(provenance" in plan
    nodes = spark.createDataFrame([("a",), ("b",)], "key string")
    fresh = spark.createDataFrame([("a", "b", "k", None, "authored", "x/y=z"), ("a", "no", "k", None, "authored", "x/y=z")], "src string, dst string, kind string, confidence double, provenance string, src_ref string")
    assert [tuple(r) for r in layers.reapply(fresh, path, nodes).collect()] == [("authored", "x/y=z", 1, 1)]
    assert layers.delete(spark, path, src_ref="x/y=z") == 1


def test_contexts_like_a_full_build(spark, tmp_path):
    nodes = spark.createDataFrame([(f"n{i}", "k", f"n{i}", "p", str(i)) for i in range(60)] + [("hub", "k", "hub", "p", None)], "key string, kind string, name string, path string, blob_hash string")
    rows = [(f"n{i}", f"n{(i * 7 + 1) % 60}", "calls", "derived", None, None) for i in range(60)] + [("hub", f"n{i}", "contains" if i % 9 else "defines", "authored", None, None) for i in range(60)]
    edges = spark.createDataFrame(rows, "src string, dst string, kind string, provenance string, confidence double, src_ref string")
    path = str(tmp_path / "contexts")
    bundles.store(nodes, edges, path, cap=8, buckets=16)
    hub = bundles.stored(spark, path).filter("key = 'hub'").first()
    assert hub.outgoing.total == 60 and hub.outgoing.truncated and len(hub.outgoing.edges) == 8 and {(o.kind, o.omitted) for o in hub.outgoing.omitted} == {("contains", 49), ("defines", 3)}
    before = files(path)
    now = nodes.filter("key <> 'n5'").withColumn("blob_hash", F.when(F.col("key") == "n3", "new").otherwise(F.col("blob_hash")))
    told = bundles.refresh(now, edges, spark.createDataFrame([("n3",), ("n5",)], "key string"), path, cap=8, buckets=16).first()
    assert told.pruned == 1 and told.rebuilt > 4
    after = files(path)
    assert 0 < len([f for f in after if f in before]) < len(after)
    want = {r.key: r for r in bundles.contexts(now, edges, cap=8).collect()}
    got = {r.key: r for r in bundles.stored(spark, path).drop("bucket").collect()}
    assert got == {k: got[k] for k in want} and {k: (r.fingerprint, r.outgoing, r.incoming) for k, r in got.items()} == {k: (r.fingerprint, r.outgoing, r.incoming) for k, r in want.items()}
    again = bundles.refresh(now, edges, spark.createDataFrame([("n3",)], "key string"), path, cap=8, buckets=16).first()
    assert (again.rebuilt, again.pruned) == (0, 0) and again.reused > 1


def test_batches_like_a_full_run(spark):
    """Ten random batches: functions and calls of some paths change, the rest is not looked at."""
    rng = random.Random(4)
    schema = "path string, key string, name string, scope string"
    called = "path string, caller string, name string, qualifier string"

    def of_path(p):
        functions = [(p, f"{p}#{i}", f"f{rng.randrange(12)}", f"s{rng.randrange(3)}") for i in range(rng.randrange(4))]
        calls = [(p, f"{p}#{rng.randrange(4)}", f"f{rng.randrange(14)}", rng.choice(["Self", "s0", "s1", None])) for _ in range(rng.randrange(6))]
        return functions, calls

    state = {f"p{k}": of_path(f"p{k}") for k in range(10)}
    frames = lambda: (spark.createDataFrame([r for f, _ in state.values() for r in f], schema), spark.createDataFrame([r for _, c in state.values() for r in c], called))
    functions, calls = frames()
    resolved = incremental.resolutions(functions, calls)
    looked = 0
    for batch in range(10):
        touched = rng.sample([f"p{k}" for k in range(12)], 2)
        for p in touched:
            state.pop(p, None)
            if rng.random() < 0.8:
                state[p] = of_path(p)
        old, (functions, calls) = functions, frames()
        paths = spark.createDataFrame([(p,) for p in touched], "path string")
        looked += incremental.changed_calls(old, functions, calls, paths).count() < calls.distinct().count()
        resolved = lineage.settle(incremental.resolved_again(resolved, old, functions, calls, paths))
        assert sorted(map(str, resolved.collect())) == sorted(map(str, incremental.resolutions(functions, calls).collect())), batch
    assert looked > 5
    full = links.resolve_calls(functions.select("key", "name", "scope"), calls.select("caller", "name", "qualifier"))
    assert {tuple(r) for r in full.collect()} == {(r.src, r.dst) for r in incremental.call_edges(resolved).collect()}


def test_graph_again(spark):
    nodes = spark.createDataFrame([("a", "fn", "p"), ("b", "fn", "q"), ("i", "import", None)], "key string, kind string, path string")
    edge = "src string, dst string, kind string, provenance string"
    edges = spark.createDataFrame([("a", "i", "imports", "derived"), ("a", "b", "calls", "derived"), ("b", "b", "uses", "derived")], edge)
    n, e = incremental.graph_again(nodes, edges, spark.createDataFrame([("p",)], "path string"), nodes.filter("key = 'a'"), edges.filter("false"), spark.createDataFrame([("b", "a", "calls", "derived")], edge))
    assert {r.key for r in n.collect()} == {"a", "b"} and {(r.src, r.dst) for r in e.collect()} == {("b", "b"), ("b", "a")}


def test_table_function_in_sql(spark):
    wave = b"RIFF\x00\x00\x00\x00WAVEfmt \x10\x00\x00\x00" + struct.pack("<HHIIHH", 1, 2, 8000, 32000, 4, 16) + b"data" + struct.pack("<I", 16000) + b"\0" * 16000
    flac = b"fLaC\x00\x00\x00\x22" + b"\0" * 10 + ((16000 << 44) | (1 << 41) | (15 << 36) | 4096).to_bytes(8, "big") + b"\0" * 16
    mp3 = b"ID3\x03\x00\x00\x00\x00\x00\x05hello" + b"\xff\xfb\x90\xc0" + b"\0" * 17 + b"Xing\x00\x00\x00\x01" + (100).to_bytes(4, "big") + b"\0" * 50
    rows = [("a.flac", flac), ("b.FLAC", b"fLaC"), ("c.mp3", mp3), ("d.mp3", mp3[:17]), ("e.mp3", b"\xff\xf3\x90\x00" + b"\0" * 40), ("s/a.wav", wave), ("s/bad.wav", b"RIFFxxxx"), ("Dockerfile.dev", b"FROM a:1"), ("x/.github", None), ("n.txt", b"\xff \xc3\xa9"), (".github/a.json", b'{"a": 1}')]
    spark.createDataFrame(rows, "path string, content binary").createOrReplaceTempView("told_files")
    name = dispatch.register(spark)
    got = {tuple(r) for r in spark.sql(f"select path, f.* from told_files, lateral {name}(path, content) f where kind <> 'file'").collect()}
    assert got == {("a.flac", "audio_stream", "2x16000", "256"), ("c.mp3", "audio_stream", "1x44100", "~2612"), ("e.mp3", "audio_stream", "2x22050", None), ("s/a.wav", "audio_stream", "2x8000", "500"), ("Dockerfile.dev", "image_ref", "a:1", None), ("n.txt", "content", "n.txt", "� é")}


def test_cached_facts_are_not_extracted_again(spark):
    rows = spark.createDataFrame([("a.json", '{"a": 1}', "k1"), ("b/a.json", '{"a": 1}', "k2"), ("a.json", '{"a": 1}', "k1")], "path string, content string, cache_key string")
    every, fresh = dispatch.facts_of(rows.filter("cache_key = 'k1'"), None)
    assert every.count() == 2
    cached = lineage.settle(fresh)
    every, fresh = dispatch.facts_of(rows, cached)
    assert {r.cache_key for r in fresh.collect()} == {"k2"} and every.count() == 4
    assert dispatch.facts_of(rows, lineage.settle(every))[1].count() == 0


def test_a_clusters_local_warehouse_is_refused():
    class Jsc:
        def sc(self):
            return self

        getCheckpointDir = isDefined = lambda self: self

        def __bool__(self):
            return False

    class Context:
        master, _jsc = "spark://host:7077", Jsc()

    class Session:
        sparkContext = Context()
        conf = {"spark.sql.warehouse.dir": "file:/home/x/spark-warehouse"}  # noqa: RUF012

    with pytest.raises(ValueError, match="local folder"):
        lineage._folder(Session())

"""Operators that SQL cannot express, against small Python models."""

import random
import struct
from collections import deque

import pytest
from pyspark.sql import functions as F

from lineagelake.functions import hashing, text
from lineagelake.operators import checks, extract, layers, lenses, links, memory, review, similar, traverse
from lineagelake.sources import graph
from lineagelake.streaming import feed


def edge_frame(spark, pairs):
    return spark.createDataFrame([(a, b, k, "derived", None, None) for a, b, k in pairs], "src string, dst string, kind string, provenance string, confidence double, src_ref string")


def bfs(pairs, src, dst):
    steps = {}
    for a, b, k in pairs:
        steps.setdefault(a, []).append((b, k, "derived", "out"))
        steps.setdefault(b, []).append((a, k, "derived", "in"))
    seen, queue = {src: None}, deque([src])
    while queue:
        n = queue.popleft()
        for other, k, p, d in sorted(steps.get(n, [])):
            if other not in seen:
                seen[other] = (n, k, d)
                queue.append(other)
    if dst not in seen or src == dst:
        return []
    path, at = [], dst
    while seen[at]:
        n, k, d = seen[at]
        path.append((n, at, k, d))
        at = n
    return path[::-1]


def test_shortest_path_like_queue(spark):
    rng = random.Random(2)
    names = [f"n{i:02d}" for i in range(30)]
    pairs = [(rng.choice(names), rng.choice(names), rng.choice(["calls", "contains"])) for _ in range(45)]
    nodes = spark.createDataFrame([(n,) for n in names], "key string")
    e = edge_frame(spark, pairs)
    for src, dst in [("n00", "n17"), ("n03", "n29"), ("n05", "n05")]:
        got = [(r.key, r.other, r.kind, r.direction) for r in traverse.shortest_path(nodes, e, src, dst).collect()]
        assert got == bfs(pairs, src, dst)
    assert traverse.shortest_path(nodes, e, "n00", "missing").count() == 0


def test_k_hop_edges_and_depth_cap(spark):
    e = edge_frame(spark, [(f"a{i}", f"a{i + 1}", "calls") for i in range(9)] + [("a0", "a1", "calls")])
    assert traverse.k_hop(e, ["a0"], 50).count() == 6
    assert {(r.src, r.dst) for r in traverse.k_hop_edges(e, ["a1"], 1).collect()} == {("a0", "a1"), ("a1", "a2")}


def test_eviction_like_loop(spark):
    rng = random.Random(1)
    rows = [(f"k{i}", rng.random() < 0.5, rng.randrange(50), rng.randrange(1, 30)) for i in range(200)]
    total, want = sum(r[3] for r in rows), {}
    for key, _, _, size in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        want[key] = total > 900
        total -= size * want[key]
    got = memory.evicted(spark.createDataFrame(rows, "key string, applies boolean, last_used int, bytes int"), 900)
    assert {r.key: r.evict for r in got.collect()} == want


def test_correspondences_are_transitive(spark):
    rows = [("p", "1", 1, ["a"]), ("p", "1", 2, ["a", "b"]), ("p", "1", 3, ["b"]), ("p", "1", 4, ["c"]), ("p", "2", 5, ["a"]), ("p", "2", 6, None)]
    got = layers.correspondences(spark.createDataFrame(rows, "package string, version string, row bigint, ids array<string>"))
    assert {r.row: r.group for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}


def test_greedy_match_and_budget(spark):
    pairs = spark.createDataFrame([("s", "p", 1, 10, 5, 5, 0), ("s", "p", 2, 10, 6, 5, 1), ("s", "p", 2, 11, 6, 9, 3), ("s", "p", 3, 11, 8, 9, 1)], "sha string, path string, row bigint, finding bigint, row_line bigint, line bigint, distance bigint")
    assert {(r.row, r.finding) for r in review.greedy_match(pairs).collect()} == {(1, 10), (3, 11)}
    parts = spark.createDataFrame([("a", 1, "x", 5), ("a", 2, "y", 7), ("a", 3, "z", 4)], "doc string, place bigint, part string, tokens bigint")
    assert [tuple(r) for r in review.budget_fit(parts, ["doc"], 10).collect()] == [("a", 9, "x,z")]


def test_fnv_and_embedding_like_python(spark):
    def fnv(b):
        h = 0xCBF29CE484222325
        for x in b:
            h = (h ^ x) * 0x100000001B3 % 2**64
        return h

    words = ["", "a", "foobar", "éà", "日本", "x" * 300]
    got = {r.text: r.h for r in spark.createDataFrame([(w,) for w in words], "text string").select("text", hashing.fnv1a_hex(F.col("text")).alias("h")).collect()}
    assert got == {w: f"{fnv(w.encode()):016x}" for w in words}
    docs = spark.createDataFrame([(1, "the cat, the hat"), (2, "")], "id bigint, text string")
    out = {r.bucket: r.weight for r in similar.hashed(docs, "id", "text").collect()}
    sums = {}
    for f in ["the", "cat", "the", "hat"] * 2:
        h = fnv(f.encode())
        sums[h & 255] = sums.get(h & 255, 0) + (-1 if h >> 63 else 1)
    length = sum(v * v for v in sums.values()) ** 0.5
    assert out == pytest.approx({k: v / length for k, v in sums.items() if v})


def test_keys_globs_images(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first().x
    assert pick(text.normalised_key(F.lit("Spring.Data-Source__URL"))) == "spring.data.source.url"
    assert pick(text.canonical_key(F.lit("Spring.Data-Source.__.URL"))) == "spring.datasource.url"
    for glob, yes, no in [("src/**/*.py", ["src/a.py", "src/x/y/a.py"], ["src/a.pyc", "a.py"]), ("*.t?t", ["a.txt"], ["x/a.txt"]), ("**/test/**", ["a/test/b", "test/b"], ["atest/b"])]:
        for p in yes:
            assert pick(F.lit(p).rlike(text.glob_regex(glob))), (glob, p)
        for p in no:
            assert not pick(F.lit(p).rlike(text.glob_regex(glob))), (glob, p)
    assert tuple(one.select(*text.image_reference(F.lit("h:5000/a/b:1.2@sha256:ff"))).first()) == ("h:5000/a/b", "1.2", "sha256:ff")


def test_extraction(spark):
    files = spark.createDataFrame(
        [("a.toml", 'x = 1\n[s]\nkey = "v"\n'), ("b.json", '{"a": {"b": null, "c": true}}'), (".env", "# c\nexport A='1'\nB=2\nB=3"), ("bad.json", "{")], "path string, content string"
    )
    got = {(r.path, r.key): r.value for r in extract.config_keys(files).collect()}
    assert got == {("a.toml", "x"): "1", ("a.toml", "s.key"): "v", ("b.json", "a.b"): None, ("b.json", "a.c"): "true", (".env", "A"): "1", (".env", "B"): "3"}
    docs = spark.createDataFrame([("d.md", "# One\ntext\n### Deep\n## Two\n### Three"), ("Dockerfile", "FROM a:1 AS base\nFROM base\nFROM --platform=x b@sha256:1")], "path string, content string")
    assert {(r.title, r.parent) for r in extract.headings(docs).collect()} == {("One", None), ("Deep", "One"), ("Two", "One"), ("Three", "Two")}
    assert {(r.image, r.tag, r.digest) for r in extract.base_images(docs).collect()} == {("a", "1", None), ("b", None, "sha256:1")}
    notes = spark.createDataFrame([("x.rs", "// see @ref:adr-1 and `@ref:no`\nlet a = \"@ref:no\";")], "path string, content string")
    assert [r.id for r in extract.annotations(notes).collect()] == ["adr-1"]
    wav = b"RIFF" + struct.pack("<I", 0) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", 16000)
    assert tuple(extract.wav_facts(spark.createDataFrame([("a.wav", bytearray(wav)), ("b", bytearray(b"x"))], "path string, content binary")).first()) == ("a.wav", 16000, 1, 16, 8000, 500)


def test_faithfulness_and_validity(spark):
    segments = spark.createDataFrame([(1, 0, "claim", "a", ["k"]), (1, 1, "claim", " ", ["k"]), (1, 2, "claim", "b", []), (1, 3, "claim", "c", ["no"]), (1, 4, "structural", "Summary:", None), (1, 5, "structural", "Odd", None)], "rendering bigint, place bigint, kind string, text string, citations array<string>")
    got = {(r.place, r.defect) for r in checks.faithfulness(segments, spark.createDataFrame([("k",)], "key string")).collect()}
    assert got == {(1, "empty"), (2, "uncited"), (3, "dangling"), (5, "unlisted")}
    rows = spark.createDataFrame([("inferred", 0.5), ("inferred", None), ("inferred", 1.5), ("derived", None), ("derived", 0.1), ("other", None)], "provenance string, confidence double")
    assert [r.v for r in rows.select(graph.valid(rows).alias("v")).collect()] == [True, False, False, True, False, False]


def test_limit_zero_is_no_limit(spark):
    df = spark.range(10)
    assert lenses.window(df, [F.col("id")]).count() == 10 and lenses.window(df, [F.col("id")], 3, 8).count() == 2


def test_links(spark):
    hub = spark.createDataFrame([(1, "h", "a.b", "1"), (2, "h", "A-B", "2"), (3, "h", "x.only", "3")], "seq int, file string, key string, value string")
    spokes = spark.createDataFrame([("f", "a_b", "1"), ("f", "a.B", "9"), ("f", "ab", "2"), ("f", "other.only", "3"), ("f", "none", None)], "file string, key string, value string")
    got = {r.key: (r.target, r.tier, r.confidence) for r in links.match_keys(spokes, hub).collect()}
    assert got == {"a_b": ("a.b", 1, 0.98), "a.B": ("a.b", 1, 0.90), "ab": ("A-B", 2, 0.95), "other.only": ("x.only", 3, 0.55), "none": (None, None, None)}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = str(tmp_path / "in")
    events.repartition(4).write.parquet(source)
    stream = feed.feed(spark, source)
    feed.maintain(stream.select("user_id", "event_id", "value"), ["user_id"], "event_id", str(tmp_path / "state"), str(tmp_path / "ck"), lambda df: df.groupBy().agg(F.count("*").alias("n"))).awaitTermination()
    want = {tuple(r) for r in layers.upsert(events.select("user_id", "event_id", "value"), ["user_id"], "event_id").collect()}
    assert {tuple(r) for r in feed.state(spark, str(tmp_path / "state")).collect()} == want
    feed.windowed(stream, "1 hour", late="3650 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    told = [F.col(c).cast("string") for c in ("start", "end", "event_type", "events", "total")]
    assert {tuple(r) for r in spark.table("w").select(*told).collect()} == {tuple(r) for r in feed.windowed(events, "1 hour").select(*told).collect()}
    feed.once(stream.select("ts", "user_id"), ["user_id"], "3650 days").writeStream.format("memory").queryName("o").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("o").count() == events.select("user_id").distinct().count()

import json

import pytest
from pyspark.sql import functions as F

from lineagelake.operators import imports
from lineagelake.sources import artifact, graph

SF = "/root/testdata/sf0.001"


def test_artifact_round_trip(spark, tmp_path):
    n, e = graph.nodes(spark, SF, ("region", "nation", "supplier")), graph.edges(spark, SF, ("contains", "related"))
    artifact.export(n, e, str(tmp_path), "tree1")
    n2, e2 = artifact.load(spark, str(tmp_path))
    assert sorted(map(tuple, n.collect())) == sorted(map(tuple, n2.collect()))
    assert sorted(map(str, e.collect())) == sorted(map(str, e2.collect()))
    spark.range(1).select(F.lit("other").alias("schema")).write.mode("append").json(f"{tmp_path}/nodes")
    with pytest.raises(ValueError):
        artifact.load(spark, str(tmp_path))
    ledger = str(tmp_path / "ledger")
    for i in range(2):
        artifact.append_ledger(spark.createDataFrame([("sent", i)], "entry string, bytes int"), ledger)
        artifact.append_ledger(spark.createDataFrame([("refused", "why")], "entry string, reason string"), ledger)
    assert sorted(r.bytes for r in artifact.read_ledger(spark, ledger, "sent", "bytes int").collect()) == [0, 1]


def test_node_link(spark):
    doc = {
        "nodes": [{"id": "a", "label": "A", "file_type": "doc-x"}, {"id": "b", "label": "B"}, {"id": "c", "label": "C", "file_type": "code"}],
        "links": [{"source": "a", "target": "b", "relation": "cites", "confidence_score": 0.5}, {"source": "a", "target": "c"}, {"source": "a", "target": "b", "_origin": "ast"}],
        "hyperedges": [{"id": "h", "label": "H", "nodes": ["a", "b", "zz"]}],
    }
    nodes, edges, report = imports.node_link(spark.createDataFrame([(json.dumps(doc),)], "json string"))
    assert {(r.key, r.kind) for r in nodes.collect()} == {("import:a", "doc-x"), ("import:b", "doc"), ("import:group:h", "group")}
    assert {(r.src[-1], r.dst[-1], r.kind, r.confidence) for r in edges.collect()} == {("a", "b", "cites", 0.5), ("h", "a", "related", 0.5), ("h", "b", "related", 0.5)}
    assert report == {"nodes": 3, "links": 3, "hyperedges": 1, "code_nodes": 1, "ast_links": 1, "nodes_kept": 2, "edges_kept": 1, "dangling": 1, "groups_kept": 1}
    empty = imports.node_link(spark.createDataFrame([(None,), ("{}",)], "json string"))
    assert empty[0].count() == empty[1].count() == sum(empty[2].values()) == 0


def test_compared(spark):
    ours = spark.createDataFrame([("p", "A::f"), ("p", "g"), ("p", "x"), ("q", "y")], "path string, name string")
    theirs = spark.createDataFrame([("p", "f"), ("p", "g"), ("q", "z")], "path string, name string")
    counts, rows = imports.compared(ours, theirs)
    assert tuple(counts.first()) == (1, 1, 2, 1)
    assert {(r.side, r.leaf) for r in rows.collect()} == {("ours", "x"), ("ours", "y"), ("theirs", "z")}


def test_small_ones(spark):
    lines = spark.createDataFrame([("a", "// @lat: [[k1]] and @lat:[[no]]"), ("a", "// @lat: [[k1]]")], "path string, text string")
    edges, count = imports.back_links(lines, spark.createDataFrame([("k1",)], "key string"))
    assert [tuple(r) for r in edges.collect()] == [("file:a", "k1")] and count.first()[0] == 1
    keys = spark.createDataFrame([("k1", "Db", "url"), ("k2", "Db", "port"), ("k3", "x", "y")], "key string, section string, field string")
    structs = spark.createDataFrame([("s1", "DbConfig", ["url", "port"]), ("s2", "db", ["port"])], "struct string, name string, fields array<string>")
    assert {r.key: r.struct for r in imports.bridged(keys, structs).collect()} == {"k1": "s1", "k2": None, "k3": None}
    src = spark.createDataFrame([("f.rs", i, t) for i, t in enumerate(["// why", "#[inline]", "#[allow(x)]", "fn a()", "#[allow(y)]", "fn b()", "#[allow(z)] // ok"])], "path string, line int, text string")
    assert [r.line for r in imports.unjustified_allows(src).collect()] == [4]
    replies = spark.createDataFrame([(1, "text\nFINDING | line=12 | class=ordering-bug | Off by one\nFINDING | line=3 | plain"), (2, "NO FINDINGS"), (3, None)], "id int, reply string")
    assert {tuple(r) for r in imports.reply_findings(replies).collect()} == {(1, 12, "ordering-bug", False, "Off by one"), (1, 3, None, False, "plain")}
    assert {tuple(r) for r in imports.reply_verdicts(replies).collect()} == {(1, 2, 0, False, False), (2, 0, 0, True, False), (3, 0, 0, False, False)}
    diff = spark.createDataFrame([("f", i, t) for i, t in enumerate(["--- a", "+++ b", "@@ -1,2 +10,3 @@", " x", "-y", "+z", "@@ -9 +30 @@", "+w"])], "file string, place int, text string")
    assert [r.number for r in imports.numbered_diff(diff).orderBy("place").collect()] == [None, None, None, 10, None, 11, None, 30]
    memory = spark.createDataFrame([(1, 3), (2, None), (3, None)], "id int, superseded_by int")
    assert {tuple(r) for r in imports.forgotten(memory, 3).collect()} == {(1, None), (2, None)}
    nodes = spark.createDataFrame([("s", "section", "Law", "l.md"), ("f", "function", "f", "a.rs"), ("x", "external_ref", "x", None)], "key string, kind string, name string, path string")
    authored = spark.createDataFrame([("s", "f", "authored"), ("f", "x", "authored"), ("f", "x", "derived")], "src string, dst string, provenance string")
    assert {r.path: r.sections for r in imports.governing(nodes, authored).collect() if r.path} == {"a.rs": ["Law"]}
    assert imports.external_references(nodes, authored).count() == 1
    one = spark.range(1)
    got = one.select(imports.already_shown(F.lit("s"), F.lit("")), imports.already_shown(F.lit("y" * 70), F.lit("a" + "y" * 60)))
    assert list(got.first()) == [True, True]
    told = imports.caveats(spark.createDataFrame([(2, 3.0, 1), (9, 1.0, 0)], "found int, chance double, singletons int")).collect()
    assert [len(r.caveats) for r in told] == [2, 0]
    assert imports.caveats(spark.createDataFrame([(5, 3.0)], "found int, chance double")).first().caveats == ["recall is not clearly above chance"]

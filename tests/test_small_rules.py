import pytest

from lineagelake.operators import checks, context, layers, lenses, links, media, sync
from pyspark.sql import functions as F


def test_ignore_lists():
    assert lenses.merged_ignore([(None, False), (None, False)]) is None
    assert lenses.merged_ignore([(["a", "b"], False), (["b", "c"], False), (None, False)]) == ["a", "b", "c"]
    assert lenses.merged_ignore([(["a"], False), (["b"], True), (["c"], False)]) == ["b", "c"]
    assert lenses.merged_ignore([(["a"], False), (None, True)]) is None


def test_what_a_sync_does():
    last = {"tree": "t", "env": "e", "worktree": "w"}
    assert sync.decided(None, "t", "e", "w") == "full" and sync.decided(last, "t", "e", "w") == "none" and sync.decided(last, "u", "e", "w") == "incremental"
    assert sync.decided(last, "t", "f", "w") == "full" and sync.decided(last, "t", "e", "x") == "full"


def test_gate_with_stored_records(spark):
    notes = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "3"), ("a", "4"), ("a", "5")], "path string, id string")
    read = spark.createDataFrame([("1", "Rejected"), ("2", "odd")], "id string, status string")
    stored = spark.createDataFrame([("1", "accepted"), ("3", "Superseded"), ("4", "For Review")], "id string, status string")
    links = spark.createDataFrame([], "path string, target string")
    bad = context.gate(notes, read, links, spark.createDataFrame([], "key string"), stored)
    assert {(r.what, r.violation) for r in bad.collect()} == {("1", "inactive_record"), ("3", "inactive_record"), ("5", "unknown_record")}


def test_kinds_of_violations(spark):
    frame = spark.createDataFrame([("p", "w")], "path string, what string")
    assert [r.kind for r in checks.violations(unjustified_allow=frame).collect()] == ["unjustified-allow"]
    with pytest.raises(ValueError):
        checks.violations(other=frame)


def test_trust_and_plans(spark):
    rows = spark.createDataFrame([("d",), ("",), (None,)], "d string").select(media.trust(F.col("d")).alias("t"))
    assert [r.t for r in rows.collect()] == ["pinned_digest", "vendor_asserted", "vendor_asserted"]
    c = spark.createDataFrame([("audio", "x", 0.0, None), ("audio", "y", 1.0, None)], "kind string, blob string, rms double, variance double")
    have = spark.createDataFrame([("x", "p"), ("y", "q")], "blob string, producer string")
    assert {(r.blob, r.step) for r in media.planned(c, have, "p").collect()} == {("x", "existing"), ("y", "generate")}
    assert {(r.blob, r.step, r.reason) for r in media.planned(c, have, "q").collect()} == {("x", "gated", "silence"), ("y", "existing", None)}
    assert {r.step for r in media.planned(c, have, "p", force=True).collect()} == {"generate"}


def test_self_is_the_callers_scope(spark):
    functions = spark.createDataFrame([("a1", "new", "A"), ("b1", "new", "B"), ("a2", "go", "A"), ("b2", "run", "B"), ("c", "only", None)], "key string, name string, scope string")
    calls = spark.createDataFrame([("a2", "new", "Self"), ("b2", "new", "Self"), ("c", "new", "Self"), ("c", "new", "B"), ("b2", "new", None), ("a2", "only", "X")], "caller string, name string, qualifier string")
    assert {tuple(r) for r in links.resolve_calls(functions, calls).collect()} == {("a2", "a1"), ("b2", "b1"), ("c", "b1"), ("a2", "c")}


def test_imports_bring_their_nodes(spark):
    nodes = spark.createDataFrame([("a", "old"), ("b", "b")], "key string, name string")
    edges = spark.createDataFrame([("a", "b", "import:x"), ("a", "b", None)], "src string, dst string, src_ref string")
    facts = spark.createDataFrame([("a", "new"), ("c", "c")], nodes.schema)
    layer = spark.createDataFrame([("a", "c", "import:x"), ("c", "d", "import:x")], edges.schema)
    n, e, counts = layers.import_facts(nodes, edges, facts, layer, "import:x")
    assert {tuple(r) for r in n.collect()} == {("a", "new"), ("b", "b"), ("c", "c")} and {tuple(r) for r in e.collect()} == {("a", "b", None), ("a", "c", "import:x")}
    assert tuple(counts.first()) == (1, 1)

import json

from pyspark.sql import functions as F

from lineagelake.operators import media, reports, sync


def frame(spark, *objects):
    return spark.createDataFrame([(json.dumps(o),) for o in objects], "json string")


def test_adapters(spark):
    semgrep = {"results": [{"check_id": "r", "path": "a.py", "start": {"line": 3, "col": 1}, "extra": {"message": "m", "severity": "WARNING"}}], "errors": []}
    assert [tuple(r)[:6] for r in reports.semgrep(frame(spark, semgrep)).collect()] == [("semgrep", "r", "medium", "m", "a.py", 3)]
    audit = {"vulnerabilities": {"found": True, "list": [{"advisory": {"id": "RUSTSEC-1", "title": "t", "aliases": ["CVE-1"]}, "package": {"name": "p", "version": "1"}}]}}
    row = reports.cargo_audit(frame(spark, audit)).first()
    assert (row.rule, row.package, row.version, row.ids) == ("RUSTSEC-1", "p", "1", ["RUSTSEC-1", "CVE-1"])
    osv = {"results": [{"source": {"path": "l"}, "packages": [{"package": {"name": "p", "version": "1"}, "vulnerabilities": [{"id": "G", "summary": "s", "database_specific": {"severity": "moderate"}}]}]}]}
    assert tuple(reports.osv_scanner(frame(spark, osv)).select("rule", "severity", "path", "ids").first()) == ("G", "medium", "l", ["G"])
    line = {"reason": "compiler-message", "message": {"code": {"code": "c"}, "level": "error", "message": "m", "spans": [{"file_name": "x.rs", "line_start": 2, "is_primary": True}]}}
    other = {"reason": "build-finished"}
    assert [tuple(r)[:6] for r in reports.clippy(frame(spark, line, other)).collect()] == [("clippy", "c", "high", "m", "x.rs", 2)]


def test_keys_round_trip(spark):
    parts = [["a", "b:c", "\\", "d\\:"], ["", "", ""], ["x"]]
    for p in parts:
        row = spark.range(1).select(reports.escaped_key([F.lit(x) for x in p]).alias("k")).select("k", reports.key_parts(F.col("k")).alias("p")).first()
        assert row.p == p


def test_paths_and_coverage(spark):
    paths = {"a/b": True, "/a": False, "../a": False, "a/../b": False, "C:\\x": False, "a..b/c": True, "a/..": False}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", reports.safe_path(F.col("p")).alias("ok")).collect()
    assert {r.p: r.ok for r in got} == paths
    out = reports.coverage(spark.createDataFrame([("audit", "lock", "cargo"), ("lint", "src", "lint")], "adapter string, asset string, program string"), spark.createDataFrame([("lock",), ("lock",)], "asset string"), spark.createDataFrame([("cargo",)], "program string"))
    assert {tuple(r) for r in out.collect()} == {("audit", 2, True, True), ("lint", 0, False, False)}


def test_media_and_sync(spark):
    rec = spark.createDataFrame([("a", "p", 1, "x"), ("a", "q", 4, "y")], "blob string, producer string, generation int, text string")
    new = spark.createDataFrame([("a", "q", 0, "z"), ("b", "q", 0, "n")], "blob string, producer string, generation int, text string")
    assert {tuple(r) for r in media.recorded(rec, new).select("blob", "producer", "generation", "text").collect()} == {("a", "p", 1, "x"), ("a", "q", 2, "z"), ("b", "q", 1, "n")}
    gates = spark.createDataFrame([("audio", 1e-5, None), ("audio", 0.1, None), ("image", None, 0.0), ("image", None, None)], "k string, r double, v double")
    assert [r.g for r in gates.select(media.gate(F.col("k"), F.col("r"), F.col("v")).alias("g")).collect()] == ["silence", None, "uniform", None]
    nodes = spark.createDataFrame([("a", "function", "f1"), ("b", "function", "f2"), ("i", "import", None), ("j", "import", None)], "key string, kind string, path string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "i"), ("b", "j")], "src string, dst string")
    n, e = sync.incremental(nodes, edges, spark.createDataFrame([("f1",)], "path string"), spark.createDataFrame([("c", "function", "f1")], nodes.schema), spark.createDataFrame([("c", "b")], edges.schema))
    assert {r.key for r in n.collect()} == {"b", "c", "j"} and {tuple(r) for r in e.collect()} == {("b", "j"), ("c", "b")}

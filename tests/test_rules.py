"""Fixed rules, case by case as they are stated, not as the operators compute them."""

import json

from pyspark.sql import functions as F

from lineagelake.functions import text
from lineagelake.operators import checks, extract, imports, lenses, links, memory, reports, search, sync, traverse
from lineagelake.sources import graph

SF = "/root/testdata/sf0.001"


def told(spark, make, *values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", make(F.col("v")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


def test_names_of_secrets_and_keys(spark):
    assert told(spark, text.secret_named, "author", "db.pwd", "API-Key", "api_key", "authToken", "pasſword", "Passphrase", "oauth", "private.key") == [False, True, True, True, True, False, True, False, True]
    assert told(spark, text.normalised_key, "SERVE_ADDR", "a--b..c", "größe.x", "_a_") == ["serve.addr", "a.b.c", "gr.e.x", "a"]
    assert told(spark, text.canonical_key, "zerobus.serverEndpoint", "zerobus.server-endpoint", "a..é.B", "._.") == ["zerobus.serverendpoint", "zerobus.serverendpoint", "a.b", ""]
    assert told(spark, text.normal_url, "https://H/A/app.git/", "https://h/a/app") == ["https://h/a/app", "https://h/a/app"]
    assert told(spark, text.repository, "git@host:acme/app.git", "https://h/acme/app/", "git@h:app", "app") == ["app"] * 4


def test_states_of_secrets(spark):
    keys = spark.createDataFrame([("f", "db.token", "<redacted>"), ("f", "pwd", ""), ("g", "secret", None), ("g", "size", "<redacted>"), ("h", "size", "3")], "file string, key string, value string")
    assert tuple(lenses.secret_report(keys).select("keys", "secrets", "declared", "redacted", "present", "redacted_other", "files").first()) == (5, 3, 1, 1, 1, 1, 2)
    assert {(r.key, r.state) for r in lenses.secret_items(keys).collect()} == {("db.token", "redacted"), ("pwd", "present"), ("secret", "declared")}
    stored = keys.select("key", text.redacted(F.col("key"), F.col("value")).alias("v")).collect()
    assert {r.key: r.v for r in stored if r.key != "size"} == {"db.token": "<redacted>", "pwd": "<redacted>", "secret": None}


def test_structural_texts(spark):
    texts = ["Findings:", " In\n summary: ", "findings:", "No findings.", "Here are 3 findings:", "Here are the findings:", "Recommended  next\tsteps:"]
    rows = spark.createDataFrame([("r", i, "structural", t, None) for i, t in enumerate(texts)], "rendering string, place int, kind string, text string, citations array<string>")
    assert sorted(r.place for r in checks.faithfulness(rows, spark.createDataFrame([("k",)], "key string")).collect()) == [2, 3, 4]


def test_generations_of_cache_keys(spark):
    tag = "0123456789abcdef"
    keys = [f"o-ff-v12-e{tag}", f"o-v3-ff-v112-e{tag}", "o-ff-v12-e1", f"o-ff-v+12-e{tag}", f"o-ff-v-e{tag}", f"o-ff-v12-e{tag}0", f"o-ff-v99999999999-e{tag}", f"o-ff-v12-e{tag.upper()}", f"o-v7-e{tag}\n", "x"]
    assert told(spark, sync.generation, *keys) == [12, 12, None, None, None, None, None, 12, None, None]


def test_pins(spark):
    modules = spark.createDataFrame([("a", 1, "https://h/x/other", "s0", "v/o"), ("a", 2, "git@h:me/app.git", "s1", "v/a"), ("b", 1, "https://H/Up/stream.git", "s2", None)], "project string, seq int, url string, sha string, path string")
    images = spark.createDataFrame([("a", 1, "app", "1"), ("c", 1, "r.io/app/web", "1"), ("c", 2, "r.io/acme/app", "2"), ("c", 3, "app", "1"), ("d", 1, "app", "9"), ("e", 1, "app", "3")], "project string, seq int, image string, tag string")
    names = spark.createDataFrame([("v1",), ("rel-2",), ("2",), ("v2",), ("3",)], "name string")
    out = sync.pinned(modules, images, names, "app", "https://h/up/stream", "rel-{tag}")
    assert {tuple(r) for r in out.collect()} == {("a", "s1", "submodule v/a"), ("b", "s2", "submodule ?"), ("c", "rel-2", "image r.io/acme/app:2"), ("e", "3", "image app:3")}
    assert {r.project for r in sync.pinned(modules, images, names, "app").collect()} == {"a", "c", "e"}


def test_links_name_the_hubs_file(spark):
    hub = spark.createDataFrame([(1, "app.toml", "serve.addr", "x"), (2, "app.toml", "db.addr", "y")], "seq int, file string, key string, value string")
    spokes = spark.createDataFrame([("k.yaml", "SERVE_ADDR", "x"), ("k.yaml", "addr", "y")], "file string, key string, value string")
    nodes, edges = links.link_facts(links.match_keys(spokes, hub), "hub")
    assert [tuple(r) for r in nodes.collect()] == [("extref:hub::cfgkey:app.toml#serve.addr", "external_ref", "hub::cfgkey:app.toml#serve.addr", "inferred")]
    assert [tuple(r) for r in edges.collect()] == [("cfgkey:k.yaml#SERVE_ADDR", "extref:hub::cfgkey:app.toml#serve.addr", "references", "inferred", 0.98, "import:links")]


def test_test_paths(spark):
    assert told(spark, search.test_path, "tests/a.rs", "src/Tests/a.rs", "a/test/b", "a/testing/b", None, "test/x") == [False, True, True, False, False, False]


def test_severities(spark):
    frame = lambda *docs: spark.createDataFrame([(json.dumps(d),) for d in docs], "json string")
    words = ["CRITICAL", "ERROR", "high", "WARNING", "MEDIUM", "LOW", "INFO", "INFORMATION", "Experiment"]
    semgrep = {"results": [{"check_id": f"r{i}", "path": "a", "start": {"line": 1}, "extra": {"message": " first\nmore" if i else " \n", "severity": w}} for i, w in enumerate(words)]}
    got = {r.rule: (r.severity, r.title) for r in reports.semgrep(frame(semgrep)).collect()}
    assert [got[f"r{i}"][0] for i in range(9)] == ["critical", "high", "high", "medium", "medium", "low", "info", "info", "experiment"]
    assert got["r0"][1] == "r0" and got["r1"][1] == "first"
    entry = lambda **a: {"advisory": a or None, "package": {"name": "p", "version": ""}}
    audit = {"vulnerabilities": {"list": [entry(id="A", title="t", related=["CVE"]), entry(id="B", informational="unsound")]}, "warnings": {"yanked": [entry()], "notice": [entry(id="C", title="c")], "odd": [entry(id="D")]}}
    rows = {r.rule: r for r in reports.cargo_audit(frame(audit)).collect()}
    assert {k: r.severity for k, r in rows.items()} == {"A": "high", "B": "medium", "yanked": "low", "C": "info", "D": "odd"}
    assert rows["yanked"].title == "p unknown-version is yanked" and rows["A"].ids == ["A", "CVE"] and rows["A"].path == "Cargo.lock"
    line = lambda level, spans, code=None: {"reason": "compiler-message", "message": {"code": code, "level": level, "message": "m", "spans": spans}}
    at = [{"file_name": "./x.rs", "line_start": 2, "is_primary": False}]
    out = reports.clippy(frame(line("failure-note", at), line("ice", at, {"code": "c"}), line("error", []), line("note", [{"file_name": "/abs.rs", "line_start": 1, "is_primary": True}]))).collect()
    assert {(r.rule, r.severity, r.path) for r in out} == {("rustc", "info", "x.rs"), ("c", "ice", "x.rs")}
    vulnerabilities = [{"id": "G1", "aliases": ["R1"], "database_specific": {"severity": "LOW"}}, {"id": "R1", "summary": " s ", "affected": [{"database_specific": {"informational": "unsound"}}]}, {"id": "Z"}]
    osv = {"results": [{"source": {"path": "l"}, "packages": [{"package": {"name": "p", "version": "1"}, "vulnerabilities": vulnerabilities, "groups": [{"ids": ["R1", "G1"], "aliases": ["C1"]}, {"ids": ["Z"]}]}, {"package": {"name": "q", "version": "2"}, "vulnerabilities": [{"id": "Y", "database_specific": {"severity": "Moderate"}}]}]}]}
    rows = {r.rule: r for r in reports.osv_scanner(frame(osv)).collect()}
    assert {k: (r.severity, r.title, r.ids) for k, r in rows.items()} == {"G1": ("medium", "s", ["C1", "G1", "R1"]), "Z": ("high", "p 1 is affected by Z", ["Z"]), "Y": ("medium", "q 2 is affected by Y", ["Y"])}


def test_escalation(spark):
    said = lambda reply, rounds, called, most, floor=16: spark.range(1).select(imports.escalation(F.lit(reply), F.lit(rounds), F.lit(called), most, floor)).first()[0]
    assert said("", 1, True, 4) == "empty_output" and said(" " * 16, 1, True, 4) is None
    assert said("x" * 50, 4, False, 4) == "no_tool_call_after_max_rounds" and said("x" * 50, 0, False, 0) is None
    assert said("short", 1, True, 4) == "below_length_floor" and said("short", 1, True, 4, 0) is None


def test_coupling_by_language(spark):
    calls = [("sym:go:a#f", "sym:go:a#g"), ("sym:go:a#f", "sym:rust:b#g"), ("sym:go:a#f", "sym:go:a#f"), ("file:x", "sym:rust:b#g")]
    e = spark.createDataFrame([(s, d, "calls") for s, d in calls], "src string, dst string, kind string")
    assert tuple(lenses.coupling_counts(e).first()) == (4, 1, 1, 4)
    assert {(r.key, r.fan_in, r.fan_out) for r in lenses.coupling(e).collect()} == {("sym:go:a#f", 0, 1), ("sym:go:a#g", 1, 0), ("file:x", 0, 1), ("sym:rust:b#g", 1, 0)}


def test_marker_texts(spark):
    rows = spark.createDataFrame([("a.c", "x /* deferred\n tbd */ for now\n" + "TODO " + "y" * 300 + "\r\n// BUG\n"), ("b.md", "lineagelake:ignore-file\nTODO")], "path string, content string")
    got = {r.line: (r.category, len(r.text)) for r in lenses.markers(rows).collect()}
    assert got == {1: ("deferred", 13), 2: ("deferred", 14), 3: ("todo", 201), 4: ("fixme", 6)}


def test_paths_of_any_length(spark):
    n = 40
    nodes = spark.createDataFrame([(f"n{i:02}",) for i in range(n + 1)], "key string")
    e = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}", "calls", "derived", None) for i in range(n)], "src string, dst string, kind string, provenance string, confidence double")
    assert traverse.shortest_path(nodes, e, "n00", "n40").count() == n


def test_json_of_any_depth(spark):
    doc = {"a": {"b": {"c": {"d": {"e": 1.5, "f": None, "g": [1, {"x": 2}]}}}}, "t": True, "s": "x", "o": {}}
    out = extract.json_keys(spark.createDataFrame([(1, json.dumps(doc)), (2, "no json"), (3, None)], "id int, j string"), "id", "j")
    assert {(r.file, r.key, r.value) for r in out.collect()} == {(1, "a.b.c.d.e", "1.5"), (1, "a.b.c.d.f", None), (1, "a.b.c.d.g", '[1,{"x":2}]'), (1, "t", "true"), (1, "s", "x")}


def test_filters_reach_the_scans(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,1)" in plan(graph.edges(spark, SF, src="customer:1")) and "EqualTo(p_partkey,7)" in plan(graph.nodes(spark, SF, key="part:7"))
    assert "EqualTo(o_orderstatus,O)" in plan(graph.nodes(spark, SF, path="orders/O"))
    every = graph.nodes(spark, SF)
    for path in ("orders/O", "part/Brand#3", "docs/x/1.txt", *[r.path for r in every.filter("kind in ('region', 'customer', 'file')").select("path").distinct().limit(5).collect()]):
        assert sorted(map(str, graph.nodes(spark, SF, path=path).collect())) == sorted(map(str, every.filter(F.col("path") == path).collect()))
    for key in ("nation:3", "nation:x", "order:007", "nothing", "file:1"):
        assert graph.nodes(spark, SF, key=key).count() == every.filter(F.col("key") == key).count()
        assert graph.edges(spark, SF, dst=key).count() == graph.edges(spark, SF).filter(F.col("dst") == key).count()


def test_pinned_entries_stay(spark):
    rows = [("a", 10, 1, True, 5), ("b", 10, 2, False, 5), ("c", 10, 3, True, 4), ("d", 100, 9, False, 4), ("e", 10, 4, False, 4)]
    cache = spark.createDataFrame(rows, "key string, bytes bigint, last_used bigint, applies boolean, generation int")
    assert {r.key for r in memory.evicted(cache, 120, 5).collect() if r.evict} == {"b", "e"}
    assert {r.key for r in memory.evicted(cache, 0, 5).collect() if r.pinned} == {"a", "d"}
    assert tuple(memory.cache_swept(cache, 0, 5).first()) == (5, 2, 3, 30, 110, True, 6)

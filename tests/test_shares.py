"""Steps whose work and memory follow the input: shares of shuffles, edges dealt by counts, sifted keys, profiles as lists, steps read once."""

import random
from collections import Counter

from lineagelake import queries
from lineagelake.operators import bundles, extract, lenses, review, similar, sync
from lineagelake.plans import shares, skew

SF = "/root/testdata/sf0.001"
EDGE = "src string, dst string, kind string, provenance string, confidence double"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_shuffles_begin_with_shares_of_the_tables(spark, monkeypatch):
    monkeypatch.setattr(shares, "SHARE", 1000)
    try:
        shares.divide(spark, SF)
        few = int(spark.conf.get(shares._BEGIN))
        shares.divide(spark, "/root/testdata/sf0.01")
        assert int(spark.conf.get(shares._BEGIN)) > 2 * few > 16
        monkeypatch.setattr(shares, "SHARE", 10**12)
        queries.QUERIES["coupling"](spark, SF)
        assert spark.conf.get(shares._BEGIN) == spark.conf.get("spark.sql.shuffle.partitions")
    finally:
        spark.conf.unset(shares._BEGIN)


def test_coupling_sends_each_call_once(spark):
    rows = [("a", "b", "calls", "derived", None), ("a", "b", "calls", "authored", None), ("b", "a", "calls", "derived", None), ("a", "c", "calls", "derived", None), ("c", "c", "calls", "derived", None)]
    out = lenses.coupling(spark.createDataFrame(rows, EDGE))
    assert {r.key: (r.fan_in, r.fan_out) for r in out.collect()} == {"a": (1, 2), "b": (1, 1), "c": (1, 0)}
    assert "Join" not in _plan(out)


def test_edges_dealt_by_counts_like_one_after_another(spark):
    rng = random.Random(3)
    rows = [(f"k{k}", f"o{i}", f"t{rng.randrange(rng.choice([1, 3, 9]))}", "derived", None) for k in range(12) for i in range(rng.choice([1, 5, 6, 7, 40]))]
    ends = lenses.endpoints(spark.createDataFrame(rows, EDGE)).filter("direction = 'out'")
    for cap in (2, 6):
        want = {}
        for key in {r[0] for r in rows}:
            of = Counter(r[2] for r in rows if r[0] == key)
            order = sorted((turn, kind) for kind, n in of.items() for turn in range(n))[:cap]
            kept = Counter(kind for _, kind in order)
            want |= {(key, kind): (n, kept[kind]) for kind, n in of.items()}
        told = lenses.dealt(ends, cap)
        assert {(r.key, r.kind): (r.of_kind, r.kept) for r in told.collect()} == want
        assert "Window" not in _plan(told)
        rows_kept = Counter((r.key, r.kind) for r in lenses.round_robin(ends, cap).collect())
        assert rows_kept == Counter({k: n for k, (_, n) in want.items() if n})
        nodes = spark.createDataFrame([(k, "x", k, None) for k in sorted({r[0] for r in rows})], "key string, kind string, name string, path string")
        for r in bundles.bundles(nodes, spark.createDataFrame(rows, EDGE), cap).collect():
            own = {kind: v for (key, kind), v in want.items() if key == r.key}
            assert r.outgoing.total == sum(n for n, _ in own.values()) and len(r.outgoing.edges) == min(cap, r.outgoing.total) and r.incoming.total == 0
            assert [tuple(o) for o in r.outgoing.omitted] == sorted((k, n - c) for k, (n, c) in own.items() if 0 < c < n)
    assert "Window" not in _plan(queries.QUERIES["capped_context"](spark, SF))


def test_sifts_lose_no_key_and_keep_few_others(spark):
    rows, wanted = spark.range(40_000).selectExpr("concat('k', id) as key").unionByName(spark.sql("select cast(null as string) as key")), spark.range(0, 40_000, 40).selectExpr("concat('k', id) as key")
    kept = skew.sifted(rows, "key", wanted)
    assert kept.join(wanted, "key", "left_semi").count() == 1000 and 1000 <= kept.count() < 1400
    edges = spark.createDataFrame([("a", "b", "calls", "derived", None), ("c", "a", "calls", "derived", None), ("b", "c", "calls", "derived", None)], EDGE)
    nodes = spark.createDataFrame([("a", "f", "n", "p"), ("b", "f", "n", "q"), ("c", "f", "n", "r")], "key string, name string, kind string, path string")
    out = sync.impact(spark.createDataFrame([("p", "modified")], "path string, status string"), nodes, edges)
    assert sorted(r.key for r in out.collect()) == ["b", "c"] and "_marks" in _plan(out)
    pairs = spark.createDataFrame([("b", "a"), ("a", "c"), ("a", "d"), ("b", "c")], "src string, dst string")
    apart = similar.not_connected(pairs, edges)
    assert [tuple(r) for r in apart.collect()] == [("a", "d")]
    assert "Aggregate [a" not in _plan(apart)  # the edges are not made distinct


def test_profiles_come_as_one_list(spark):
    sites = spark.createDataFrame([(1, "s", "x", True), (1, "s", "y", False), (2, "s", None, True), (3, None, "x", False)], "site bigint, sha string, platform string, tests boolean")
    runs = spark.createDataFrame([("s", "x", False, "success", "j1"), ("s", "y", True, "success", "j2"), ("s", None, True, "failure", "j3"), ("s", "x", True, "success", None), (None, "x", True, "success", "j0")], "sha string, platform string, tests boolean, conclusion string, job string")
    out = review.claim_coverage(sites, runs)
    assert {r.site: (r.job, r.reason) for r in out.collect()} == {1: ("j2", "covered"), 2: ("j2", "covered"), 3: (None, "no_run")}
    assert "collect_list" in _plan(out)


def test_steps_over_structs_read_their_fields_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [("p", "A", True, "b", "B"), ("p", "B", False, "c", "C"), ("p", "C", False, "a", "A"), ("p", "C", False, "x", None)]
    fields = spark.createDataFrame(rows, "path string, struct string, root boolean, field string, type string")
    out = extract.struct_keys(fields.mapInArrow(counted, fields.schema))
    assert {(r.key, r.struct) for r in out.collect()} == {("b.c.a", "A"), ("b.c.x", "A")}
    assert read.value == len(rows)

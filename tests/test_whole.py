"""Coverage, spans and correspondences over whole tables."""

import random

from lineagelake import queries
from lineagelake.operators import checks, review
from lineagelake.sources.graph import read

SF = "/root/testdata/sf0.001"


def test_every_site_is_judged_and_every_link_seen(spark):
    orders = read(spark, SF, "orders")
    sites = queries.QUERIES["claim_coverage_all"](spark, SF)
    assert sites.count() == orders.count()
    links = queries.QUERIES["correspondence_all"](spark, SF)
    assert links.select("src").distinct().count() == orders.selectExpr("o_custkey", "month(o_orderdate)").distinct().count()


def test_innermost_like_a_scan(spark):
    rng = random.Random(5)
    spans = [(f"k{i}", rng.choice("ab"), a, a + rng.choice([0, 1, 2, 3, 4, 5, 60, 64, 65, 500])) for i in range(120) for a in [rng.randrange(-300, 300)]]
    points = [(i, rng.choice("abc"), rng.randrange(-350, 850)) for i in range(600)]
    out = checks.innermost(spark.createDataFrame(points, "id bigint, path string, at bigint"), spark.createDataFrame(spans, "key string, path string, start bigint, end bigint"))
    want = {}
    for i, path, at in points:
        held = [(end - start, key) for key, p, start, end in spans if p == path and start <= at < end]
        if held:
            want[i] = min(held)[1]
    assert {r.id: r.key for r in out.collect()} == want
    assert "block" in out._jdf.queryExecution().toString()


def test_sites_meet_profiles_not_runs(spark):
    sites = spark.createDataFrame([(1, "s", "x", None, None), (2, "s", "y", "f", None), (3, "s", "z", None, None), (4, "t", None, None, None), (5, "u", "x", None, None)], "site bigint, sha string, platform string, features string, toolchain string")
    runs = spark.createDataFrame([("s", "x", "f", None, "success", f"j{i}") for i in range(100, 300)] + [("s", "y", "g", None, "success", "a"), ("t", None, None, None, "failure", "b")], "sha string, platform string, features string, toolchain string, conclusion string, job string")
    out = review.claim_coverage(sites, runs)
    assert {r.site: (r.job, r.reason) for r in out.collect()} == {1: ("j100", "covered"), 2: (None, "not_compiled"), 3: (None, "not_compiled"), 4: (None, "not_green"), 5: (None, "no_run")}
    assert "agg" in out._jdf.queryExecution().optimizedPlan().toString().lower().split("join")[-1]  # below the join

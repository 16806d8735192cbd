import re
from itertools import permutations

import duckdb
import pytest

from lineagelake.llm.filter_audit import audit
from lineagelake.llm.queries import SQL, op12_filter_audit

SF = "/root/testdata/sf0.001"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(rows, labels):
    """Every order applied to the documents themselves."""
    fails = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        bad = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        bad += "E" * any(i is not None and j is not None and j < i and (u or "") == t for j, u, _ in rows)
        says = [x for x in labels if x[0] == i and i is not None]
        fails.append((lang or "", bad, any(x[1] == 1 for x in says), any(x[2] == 1 for x in says)))
    out, won = [], {}
    for part in {f[0] for f in fails}:
        for order in permutations("ABCDE"):
            left = [f for f in fails if f[0] == part]
            gone = []
            for step, f in enumerate(order):
                now = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                out.append([part, "".join(order), step + 1, len(left), len(now), sum(f in x[1] for x in gone), sum(x[0] == part and x[1] == f for x in fails), sum(x[2] for x in now), sum(x[3] for x in now)])
                won[part, f] = won.get((part, f), 0) + len(now)
                gone += now
    return sorted(tuple([*r, won[r[0], r[1][r[2] - 1]]]) for r in out)


LONG = " ".join(f"w{k}" for k in range(300))


@pytest.mark.parametrize("ranges", [None, 7])
def test_like_brute_force(spark, ranges):
    rows = [(k, f"copy {LONG}", "en") for k in range(60)] + [(5, f"copy {LONG}", "de")] * 30 + [(None, f"copy {LONG}", "en")] * 3
    rows += [(100 + k, t, lang) for k, (t, lang) in enumerate([("", "en"), (None, None), ("", ""), (LONG, "en"), (LONG + " #", "en"), ("A B C", "fr"), ("a " * 500, "fr"), (LONG.upper(), "fr"), ("x" * 200_000, "es"), (LONG * 200, "es")])]
    rows += [(1, "other", "en"), (1, "other", "en"), (2, "other", None)]
    labels = [(100, 1, 0), (100, None, 1), (1, 1, 1), (5, 1, 0), (103, 0, None), (None, 1, 1), (104, 1, 0)]
    docs = spark.createDataFrame([(*r, 0, "k") for r in rows], "doc_id bigint, text string, lang string, mask int, key string")
    out = audit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), ranges=ranges)
    assert sorted(tuple(r) for r in out.select(*COLUMNS).collect()) == brute(rows, labels)


def test_like_duckdb(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(f"select {', '.join(COLUMNS)} from ({SQL['op12_filter_audit']})").fetchall()
    assert sorted(tuple(r) for r in op12_filter_audit(spark, SF).select(*COLUMNS).collect()) == sorted(want)


def test_empty(spark):
    docs, labels = spark.createDataFrame([], "doc_id bigint, text string, lang string"), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audit(docs, labels).collect() == []

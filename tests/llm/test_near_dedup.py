import re

import pytest

from lineagelake.llm import near_dedup
from lineagelake.llm.near_dedup import near_duplicates

SCHEMA = "doc_id bigint, text string, id string, digest string, n_shingles string"


def brute(rows, k=3, percent=85):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def got(spark, rows):
    df = spark.createDataFrame([(i, t, "x", None, "y") for i, t in rows], SCHEMA)
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}


@pytest.mark.parametrize(("block", "direct"), [(1024, 8), (4, 100), (4, 1)])
def test_like_brute_force(spark, monkeypatch, block, direct):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "DIRECT", direct)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    base = " ".join(f"w{i}" for i in range(120)).split()
    for v in range(30):  # a chain of near copies: neighbours are linked, ends are not
        rows.append((10_000 + v, " ".join(["x%d" % i if i < 2 * v else w for i, w in enumerate(base)])))
    rows += [(20_000 + v, "Same  TEXT\tagain") for v in range(20)] + [(30_000, None), (30_001, ""), (30_002, " \n"), (30_003, "one"), (30_004, "ONE"), (30_005, "one two"), (30_006, "É two"), (30_007, "é two")]
    assert got(spark, rows) == brute(rows)


def test_empty_null_and_repeated(spark):
    assert got(spark, []) == {}
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "a b c d")], "doc_id bigint, text string")
    out = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert out == [(0, None, True), (0, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]

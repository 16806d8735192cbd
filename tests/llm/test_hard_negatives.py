import duckdb
import numpy as np
import pytest

from lineagelake.llm import hard_negatives as hn
from lineagelake.llm.queries import SQL, op13_hard_negatives

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, anchors, positives=5, negatives=3, low=50, high=95):
    """Python's whole numbers, all rows."""
    out = []
    dot = lambda a, b: max(hn.LEAST + 1, min(hn.MOST, sum(x * y for x, y in zip(a, b, strict=False))))
    for i, label, v in anchors:
        scored = sorted((-dot(v, w), j, other) for j, other, w in rows if j != i)
        for p, pid, _ in [x for x in scored if x[2] == label][:positives]:
            found = [(n, j) for n, j, other in scored if other != label and low * -p <= 100 * -n <= high * -p][:negatives]
            out += [(i, pid, r + 1, j, -p, -n) for r, (n, j) in enumerate(found)]
    return sorted(out)


def usable(rows):
    return [r for r in rows if None not in r and None not in r[2]]


def table(seed, n, wide, spread):
    rng = np.random.default_rng(seed)
    return [(int(i), int(rng.integers(0, 4)), [int(x) for x in rng.normal(0, 1, wide) * rng.integers(1, spread)]) for i in range(n)]


@pytest.mark.parametrize("kind", ["plain", "large", "ties"])
def test_like_brute_force(spark, kind, monkeypatch):
    for name, value in {"BUCKET": 16, "BLOCK": 7, "ANCHORS": 10, "SHARE": 50}.items():
        monkeypatch.setattr(hn, name, value)
    rows = table(1, 300, 8, 60)
    if kind == "large":  # beyond exact doubles, and beyond 64 bits
        rows = [(i, k, [x * 10 ** (3 + 3 * (i % 3)) for x in v]) for i, k, v in rows] + [(900, 1, [2**62] * 8), (901, 2, [2**62 - 1] * 8)]
    if kind == "ties":
        rows = [(i, k, [20, 1, 0, 0]) if i % 3 else (i, k, v[:4]) for i, k, v in rows] + [(7, 2, [20, 1, 0, 0])] * 3
        rows += [(None, 1, [1]), (800, None, [1]), (801, 1, None), (850, 1, [1, None]), (860, 1, []), (870, 2, [5]), (900, 3, [3, 4, 5, 6, 7, 8])]
    df = spark.createDataFrame([(*r, 0.5, "k") for r in rows], "id bigint, label bigint, vector array<bigint>, norm double, block string")
    out = hn.hard_negatives(df, df.filter("id % 10 = 0"))
    assert sorted(tuple(r) for r in out.select(*COLUMNS).collect()) == brute(usable(rows), [r for r in usable(rows) if r[0] % 10 == 0])


def test_like_duckdb(spark):
    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    want = con.sql(f"select {', '.join(COLUMNS)} from ({SQL['op13_hard_negatives']})").fetchall()
    assert want and sorted(tuple(r) for r in op13_hard_negatives(spark, "/root/testdata/sf0.01").select(*COLUMNS).collect()) == sorted(want)


def test_quantised(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, [0.5, -0.001]), (2, 0, [nan]), (3, 0, [inf]), (4, 0, [None]), (5, None, [1.0]), (6, 0, None), (7, 1, []), (None, 1, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    assert sorted(map(tuple, hn.quantised(df).collect())) == [(1, 0, [128, -1]), (7, 1, [])]


def test_pruned(spark):
    """A bucket of small norm is passed over, and nothing is lost."""
    rows = [(i, i % 2, [1000, i % 50]) for i in range(100)] + [(1000 + i, i % 2, [1, 1]) for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, label bigint, vector array<bigint>")
    out = hn.hard_negatives(df, df.filter("id < 4"), low=90, high=100)
    assert sorted(tuple(r) for r in out.select(*COLUMNS).collect()) == brute(rows, rows[:4], low=90, high=100)


def test_empty(spark):
    df = spark.createDataFrame([], "id bigint, label bigint, vector array<bigint>")
    full = spark.createDataFrame([(1, 1, [1])], df.schema)
    assert hn.hard_negatives(df, df).collect() == hn.hard_negatives(full, df).collect() == hn.hard_negatives(df, full).collect() == []

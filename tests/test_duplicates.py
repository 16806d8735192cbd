import numpy as np
import pytest
from pyspark.sql import functions as F

from lineagelake import queries
from lineagelake.operators import similar
from lineagelake.plans import blocks


@pytest.fixture(autouse=True)
def small(monkeypatch):
    for name, value in {"BLOCK": 8, "GROUP": 20, "SHARE": 20}.items():
        monkeypatch.setattr(blocks, name, value)


def test_equal_vectors_are_all_told(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(120)] + [(500, [0.0, 1.0])], "id bigint, vector array<double>")
    got = similar.near_duplicates(df, df.filter("id in (7, 500)")).collect()
    assert [tuple(r) for r in got] == [(0, 0, 1.0, 120, 120)]
    assert {tuple(r) for r in similar.members(df).collect()} == {(i, 0) for i in range(120)} | {(500, 500)}
    docs = df.select(F.col("id").cast("string").alias("key"), F.when(F.col("id") < 500, "same words here").alias("text"), F.concat(F.lit("b"), F.col("id") % 2).alias("blob"))
    got = {r.key: (r.links, r.exact, r.component) for r in similar.duplicates(docs).collect()}
    assert got.pop("500") == (60, 60, "0") and set(got.values()) == {(120 - (k % 2), 60 - (k % 2), "0") for k in range(2)}


def brute(docs, percent):
    vectors = {}
    for r in similar.signed(docs, "key", "text").collect():
        vectors.setdefault(r.key, np.zeros(256, object))[r.bucket] = r["sum"]
    rows = [(r.key, r.blob) for r in docs.collect()]
    links = {k: set() for k, _ in rows}
    exact = {k: 0 for k, _ in rows}
    for k, b in rows:
        for j, c in rows:
            if j == k:
                continue
            v, w = vectors.get(k), vectors.get(j)
            same = b is not None and b == c
            dot = 0 if v is None or w is None else (v * w).sum()
            if same or (dot > 0 and 10_000 * dot * dot >= percent * percent * (v * v).sum() * (w * w).sum()):
                links[k].add(j)
            exact[k] += same
    out = {}
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[k] = (len(links[k]), exact[k], min(seen))
    return out


@pytest.mark.parametrize("percent", [50, 90])
def test_like_brute_force(spark, percent):
    rows = [(f"k{i:03}", t, f"b{i % 40}" if i % 3 else None) for i, t in enumerate(["one two three four five six", "one two three four five seven", "", None, "alpha beta", "alpha beta", "alpha gamma"] * 12)]
    rows += [(f"w{i:03}", " ".join(f"word{(i + j) % 30}" for j in range(20)), None) for i in range(30)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "key string, text string, blob string, number int, links int")
    got = {r.key: (r.links, r.exact, r.component) for r in similar.duplicates(docs, percent).collect()}
    assert got == brute(docs.select("key", "text", "blob"), percent)


def test_bound_is_exact():
    """Cosine 3/5 is no less than 60 percent, however large the numbers."""
    a, b = np.array([[3, 4], [3 * 10**6, 4 * 10**6], [300_000_001, 400_000_000]]), np.array([[1, 0]])
    assert similar._alike(a, b, 60)[:, 0].tolist() == [True, True, True] and similar._alike(a - [[1, 0], [0, 0], [2, 0]], b, 60)[:, 0].tolist() == [False, True, False]


def test_forest_joins_all_that_is_linked():
    rng = np.random.default_rng(3)
    for n in range(60):
        linked = rng.random((rng.integers(1, 12), rng.integers(1, 12))) < n / 120
        join = lambda pairs: _classes(linked.shape, pairs)
        assert join(similar._forest(linked)) == join(list(zip(*np.nonzero(linked), strict=True)))


def _classes(shape, pairs):
    label = {(s, i): (s, i) for s in (0, 1) for i in range(shape[s])}
    for _ in range(sum(shape)):
        for x, y in pairs:
            label[0, x] = label[1, y] = min(label[0, x], label[1, y])
    return label


def test_neighbours_like_numpy(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(0, 1, (100, 5)).round(1)
    m[50:60] = m[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id bigint, vector array<double>")
    got = {(r.src, r.dst) for r in similar.neighbours_of(df.filter("id % 9 = 0"), df, 4, 0.2).collect()}
    unit = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    want = set()
    for i in range(0, 100, 9):
        sim = np.clip(unit @ unit[i], 0, 1)
        want |= {(i, j) for j in [j for j in np.lexsort((np.arange(100), -sim.round(5))) if j != i][:4] if sim[j] >= 0.2}
    assert got == want


def test_no_files(spark):
    assert similar.duplicates(spark.createDataFrame([], "key string, text string, blob string")).collect() == []
    empty = spark.createDataFrame([], "id bigint, vector array<double>")
    assert similar.near_duplicates(empty, empty).collect() == similar.neighbours_of(empty, empty, 3, 0.5).collect() == []
    assert queries.SQL["duplicate_links"]

import zlib

import numpy as np

from lineagelake.llm.sharding import _assign, shards


def rows_of(spark):
    return [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]


def test_laws(spark):
    rows = rows_of(spark) + [(5000, None), (5001, ""), (None, "x"), (None, "x"), (5002, "y"), (5002, "y")]
    rows += [(10_000 + i, "copied text " * 40) for i in range(1000)]  # a third of all bytes and more
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, shard string")
    out = shards(df).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in out) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    total = sum(r.size for r in out)
    groups = {}
    for r in out:
        groups[r.text_crc32] = groups.get(r.text_crc32, 0) + r.size
    largest = max(n for c, n in groups.items() if c != zlib.crc32(("copied text " * 40).encode()))
    for s in range(16):
        mine = [r for r in out if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        # a shard ends at the nearest edge of a range: half a document, or a small group of equal texts, at each end
        assert abs(sum(r.size for r in mine) - total / 16) <= largest + 0.002 * total / 16
    assert {r.law for r in out} == {"bytes"} and {r.grown_shard for r in out} == {None}
    homes = {}
    for r in out:
        homes.setdefault(r.text_crc32, set()).add(r.shard)
    hot = zlib.crc32(("copied text " * 40).encode())
    assert len(homes[hot]) > 1 and sum(len(h) - 1 for h in homes.values()) <= 15  # a shard's end divides one group


def test_few_rows(spark):
    for n in (0, 1, 3):
        df = spark.createDataFrame([(i, "same") for i in range(n)], "doc_id bigint, text string")
        out = shards(df).collect()
        assert len(out) == n
        for s in range(16):
            mine = [r for r in out if r.shard == s]
            assert sorted(r.slot for r in mine) == list(range(len(mine)))


def test_one_document_over_several_shards(spark):
    rows = [(i, f"text {i}") for i in range(500)] + [(1000, "x" * 1_000_000)]
    out = shards(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(out) == len(rows)
    for s in range(16):
        mine = [r for r in out if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))


def test_even_shards_of_many_documents(spark):
    rows = spark.range(40_000).selectExpr("id as doc_id", "repeat('ab ', cast(id % 97 as int)) || id as text")
    sizes = {r.shard: r.n for r in shards(rows).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "n").collect()}
    share = sum(sizes.values()) / 16
    assert len(sizes) == 16 and all(abs(n - share) < 0.003 * share for n in sizes.values())


def test_one_row_repeated(spark):
    """Rows of one id and text are divided as others are."""
    rows = spark.range(20_000).selectExpr("cast(if(id % 2 = 0, 7, id) as bigint) as doc_id", "if(id % 2 = 0, 'the same row', 'row ' || id) as text")
    out = shards(rows).groupBy("shard").agg({"size": "sum", "slot": "max", "*": "count"}).collect()
    share = sum(r["sum(size)"] for r in out) / 16
    assert len(out) == 16 and all(abs(r["sum(size)"] - share) < 0.01 * share and r["max(slot)"] + 1 == r["count(1)"] for r in out)


def test_what_is_missing_is_told(spark, caplog):
    shards(spark.createDataFrame([(i, f"text {i}") for i in range(5)] + [(9, "x" * 1000)], "doc_id bigint, text string"))
    assert "off its share" in caplog.text


def brute(held, n_shards):
    total, before, out, at = sum(held), [sum(held[:k]) for k in range(len(held) + 1)], [0] * len(held), 0
    for s in range(1, n_shards):
        at = min(range(at, len(held) + 1), key=lambda k: abs(before[k] - s * total / n_shards))
        out[at:] = [s] * (len(held) - at)
    return out


def test_ends_like_brute_force():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 5, 30, 200):
        held = rng.integers(1, 50, n).tolist() if n else []
        got, want = _assign([(h, 1) for h in held], 4), brute(held, 4)
        size = lambda a: sorted(sum(h for h, s in zip(held, a, strict=True) if s == k) for k in range(4))
        assert size(got) == size(want)

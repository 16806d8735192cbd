import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lineagelake.llm.exact_dedup import exact_duplicates


def brute(rows):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    out = []
    for i, t in rows:
        g = groups[low(t)]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=str), {low(t): 1 for _, t in rows}


@pytest.mark.parametrize("route", [F.xxhash64, lambda b: F.octet_length(b) % 3, lambda b: F.lit(1)])
@pytest.mark.parametrize("block", [4096, 7])
def test_like_brute_force(spark, route, block):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40 if block == 7 else 200).select("doc_id", "text").collect()]
    rows += [(1000 + i, t) for i, t in enumerate(["", None, "A", "a", "ÄB", "äb", "Äb", "abcdefg" * 3, "ABCDEFG" * 3, "abcdefg" * 2 + "abcdefh", "abcdefg" * 4, "x" * 50, "x" * 50, "x" * 49])]
    rows += [(None, "a"), (None, "only null"), (None, "only null"), (7777, "twice"), (7777, "twice"), (7777, "other")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id bigint, text string, keep_id string")
    out = exact_duplicates(df, block=block, route=route).collect()
    want, texts = brute(rows)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out], key=str) == want
    kept = [r for r in out if r.kept]
    assert len(kept) == len(texts) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_empty(spark):
    assert exact_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []

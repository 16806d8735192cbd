"""Review operators over whole tables."""

import random

from lineagelake import queries
from lineagelake.operators import review
from lineagelake.sources.graph import read

SF = "/root/testdata/sf0.001"
PAIR = "sha string, path string, row bigint, finding bigint, row_line bigint, line bigint, distance bigint"


def greedy(pairs):
    used, out = set(), set()
    for sha, path, row, finding, _, line, distance in sorted(pairs, key=lambda p: (p[6], p[2], p[5], p[3])):
        mine = {(sha, path, "row", row), (sha, path, "finding", finding)}
        if not mine & used:
            used |= mine
            out.add((row, finding, distance))
    return out


def test_every_row_reaches_the_review(spark):
    rows, found = queries._review(spark, SF)
    assert rows.count() == read(spark, SF, "orders").count() and found.count() == read(spark, SF, "lineitem").count()
    want = greedy([tuple(r) for r in review.band_pairs(rows, found).select("sha", "path", "row", "finding", "row_line", "line", "distance").collect()])
    got = [tuple(r) for r in queries.QUERIES["greedy_match"](spark, SF).select("row", "finding", "distance").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_greedy_match_of_one_large_file(spark):
    rng = random.Random(3)
    row, finding = [rng.randrange(400) for _ in range(150)], [rng.randrange(400) for _ in range(300)]
    pairs = [("s", "p", i, 1000 + j, a, b, abs(a - b)) for i, a in enumerate(row) for j, b in enumerate(finding) if abs(a - b) <= 10]
    out = review.greedy_match(spark.createDataFrame(pairs, PAIR))
    assert "Pandas" not in out._jdf.queryExecution().toString()
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == greedy(pairs)

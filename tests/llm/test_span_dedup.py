import hashlib
import random

from lineagelake.llm import span_dedup
from lineagelake.llm.span_dedup import remove_repeats


def brute(rows, length):
    seen, out = set(), []
    for _, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = [True] * length
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(span_dedup, "CHUNK", 700)
    rng = random.Random(3)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows = sorted(rows)[:150]
    page = "".join(rng.choice("abcdefgh é") for _ in range(400))
    for i in range(40):
        a, b = sorted(rng.sample(range(400), 2))
        rows.append((1000 + i, "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 90))) + page[a:b] + "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 90))) + page[: b // 2]))
    rows += [(2000, "a" * 350), (2001, "ab" * 200), (2002, None), (2003, ""), (2004, "z" * 99), (2005, "z" * 100), (2006, "é" * 80), (2007, page * 3)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame([(i, t, "k", 0) for i, t in shuffled], "doc_id bigint, text string, at string, n int")
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept_bytes)) for r in remove_repeats(df).collect()}
    want = dict(zip([i for i, _ in rows], brute(rows, 100), strict=True))
    assert out == want
    monkeypatch.setattr(span_dedup, "BROADCAST_IDS", 0)
    assert {r.doc_id: r.kept_sha256 for r in remove_repeats(df, keep_text=False).collect()} == {i: w[3] for i, w in want.items()}


def test_repeated_and_null_ids(spark):
    rng = random.Random(4)
    t = "".join(rng.choice("abcdefgh") for _ in range(300))
    df = spark.createDataFrame([(1, t), (1, t), (None, t[50:]), (2, t), (2, "short"), (2, "short")], "doc_id bigint, text string")
    out = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in remove_repeats(df).collect())
    assert out == [(-1, 250, 0), (1, 300, 250), (1, 300, 300), (2, 5, 0), (2, 5, 0), (2, 300, 300)]
    assert remove_repeats(df.limit(0)).collect() == []

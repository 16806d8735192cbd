import random
import zlib

import numpy as np

from lineagelake.llm.toxicity import fit, scored, scores, toxicity
import pyarrow as pa


def corpus(n, seed):
    rng = random.Random(seed)
    bad = ["vilesome", "grubhead", "scornful"]
    texts, toxic = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(5, 150))]
        toxic.append(i % 4 == 0)
        if toxic[-1]:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "s", "ly"]))
        texts.append(" ".join(words))
    return texts, np.array(toxic)


def test_held_out_and_misspelled():
    texts, toxic = corpus(500, 1)
    model = fit(texts, toxic)
    new, truth = corpus(300, 2)
    guess = scores(pa.array(new), model) >= 0.5
    assert guess[truth].mean() > 0.95 and guess[~truth].mean() < 0.03
    misspelt = scores(pa.array(["no vilesoome", "the grubheadd", "de GRUBHEAD"]), model)
    assert (misspelt > scores(pa.array(["rain", "", "  "]), model).max()).all()


def test_batches_do_not_matter():
    texts, toxic = corpus(60, 3)
    model = fit(texts, toxic, epochs=3)
    one = np.concatenate([scores(pa.array([t]), model) for t in texts])
    assert np.allclose(one, scores(pa.array(texts), model))


def test_operator(spark):
    texts, toxic = corpus(300, 4)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "x"), (None, "grubhead", None), (900, "", "y"), (901, None, "y"), (901, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, int(x), 1) for i, x in enumerate(toxic)] + [(None, 1, 1), (900, None, 1)], "doc_id bigint, toxic int, quality int")
    out = toxicity(docs, labels).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in out if r.held_out and r.doc_id < 300]
    assert sum(r.predicted == int(toxic[r.doc_id]) for r in held) > 0.9 * len(held)
    assert toxicity(docs.limit(0), labels.limit(0)).collect() == []
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic", "quality")
    again = {(r.doc_id, r.score) for r in toxicity(docs, flipped).collect()}
    assert again == {(r.doc_id, r.score) for r in out}  # held-out labels teach nothing
    assert scored(docs, (np.zeros(1 << 20, np.float32), -1.0)).count() == len(rows)

import numpy as np

from lineagelake.llm import toxicity


def taught(monkeypatch, docs, labels, **bounds):
    got = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: got.append((texts, toxic)) or (np.zeros(1, np.float32), 0.0))
    toxicity.train(docs, labels, **bounds)
    return got[0]


def test_a_very_long_text_does_not_end_the_sample(spark, monkeypatch):
    ids = [r.id for r in spark.range(100).selectExpr("id").filter("crc32(cast(cast(id as string) as binary)) % 5 <> 0").orderBy("id").collect()]
    first = spark.createDataFrame([(i,) for i in ids], "doc_id bigint").selectExpr("doc_id", "xxhash64(doc_id) as h").orderBy("h").first().doc_id
    labels = spark.createDataFrame([(i, int(i % 2)) for i in ids], "doc_id bigint, toxic int")
    docs = spark.createDataFrame([(i, "long " * 1_300_000 if i == first else f"short {i}") for i in ids], "doc_id bigint, text string")
    texts, toxic = taught(monkeypatch, docs, labels)
    assert len(texts) == len(ids) - 1 and max(map(len, texts)) < 20
    assert toxic.sum() == sum(i % 2 for i in ids if i != first)


def test_each_class_is_filled_and_a_lone_long_row_teaches(spark, monkeypatch):
    ids = [r.id for r in spark.range(200).filter("crc32(cast(cast(id as string) as binary)) % 5 <> 0").collect()]
    labels = spark.createDataFrame([(i, int(i == ids[0])) for i in ids], "doc_id bigint, toxic int")
    docs = spark.createDataFrame([(i, "x" * (120_000 if i == ids[0] else 9_000)) for i in ids], "doc_id bigint, text string")
    texts, toxic = taught(monkeypatch, docs.unionByName(docs), labels, sample_bytes=300_000)
    assert toxic.sum() == 1 and len(texts) == 1 + 150_000 // 9_000
    texts, toxic = taught(monkeypatch, docs, labels, sample=4)
    assert len(texts) == 5

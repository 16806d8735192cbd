"""Corpus pipeline: from raw documents to packed token sequences.

Toxic documents go, then exact copies, then near copies (five-word shingles,
similarity 0.8); owner-specific secrets are replaced in the texts; what is left
is tokenised and packed. Every stage but the last returns the columns of its input,
whatever further ones there are and whatever their names: columns that a stage needs for itself get names that are free.

No SQL can express the trained classifier, min-max hashing and first-fit
decreasing, so ``ORACLE_SQL`` is None; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineagelake.llm import exact_dedup, near_dedup, packing, secrets, toxicity
from lineagelake.llm.common import settle, table

#: Keys of dropped rows that are sent to every task rather than joined by a shuffle of texts, at most.
BROADCAST_BYTES = 8_000_000
SHINGLE, PERCENT = 5, 80
#: Bytes of a batch of rows on its way to a Python worker, where the cluster's own setting says nothing.
BATCH_BYTES = 4_000_000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bounded(spark: SparkSession) -> None:
    if not spark.sparkContext.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, BATCH_BYTES)


def _free(docs: DataFrame, name: str) -> str:
    """``name``, made longer until ``docs`` has no such column."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def _without(docs: DataFrame, dropped: DataFrame, on: dict[str, Column], width: int) -> DataFrame:
    """``docs`` but for the rows that ``dropped`` names: its columns against those expressions over ``docs``, nulls equal; ``width`` bytes a row."""
    keys = [_free(docs, f"dropped_{k}") for k in range(len(on))]
    names = settle(dropped.select(*[F.col(c).alias(k) for c, k in zip(on, keys, strict=True)]))
    names = F.broadcast(names) if names.count() * width <= BROADCAST_BYTES else names
    same = [own.eqNullSafe(F.col(k)) for own, k in zip(on.values(), keys, strict=True)]
    return docs.join(names, same, "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under one half; labels teach the model, but never decide.

    Null and empty texts have the score of the bias alone and stay where that is under one half. Repeated rows are scored alike. An empty table gives an empty one.
    """
    _bounded(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = _free(docs, "score")
    return toxicity.scored(docs, model, keep=docs.columns, score=score).filter(F.col(score) < 0.5).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that of the greatest id; nulls count as empty texts and as the least id.

    Of rows that repeat both id and text one stays. An empty table gives an empty one.
    """
    _bounded(spark)
    found = settle(exact_dedup.exact_duplicates(docs))
    if found.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        return _without(docs, found.filter("not kept"), {"doc_id": docs["doc_id"]}, 8)
    digest = _free(docs, "text_digest")
    told = docs.withColumn(digest, F.unhex(F.sha2(exact_dedup.ascii_lower(F.coalesce(docs["text"], F.lit(""))), 256))).dropDuplicates(["doc_id", digest])
    best = found.groupBy("doc_id", F.unhex("text_sha256").alias("digest")).agg(F.max("kept").alias("kept"))
    return _without(told, best.filter("not kept"), {"doc_id": told["doc_id"], "digest": told[digest]}, 40).drop(digest)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id.

    Null ids, and texts that are null or have no word, are near to nothing and stay. Rows that repeat an id stay together if one of them stays. An empty table gives an empty one.
    """
    _bounded(spark)
    found = settle(near_dedup.near_duplicates(docs, k=SHINGLE, percent=PERCENT))
    gone = found.filter("not kept").select("doc_id").join(found.filter("kept and doc_id is not null").select("doc_id"), "doc_id", "left_anti").distinct()
    return _without(docs, gone, {"doc_id": docs["doc_id"]}, 8)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, owner-specific secrets replaced; ``n_chars``, where there is such a column, follows texts that change.

    Null and empty texts stay as they are, repeated rows are treated alike, a null source is an owner, and without a column of sources there is one owner. An empty table gives an empty one.
    """
    _bounded(spark)
    before = _free(docs, "text_before")
    out = secrets.redacted(docs.withColumn(before, F.xxhash64("text")))
    if "n_chars" in docs.columns:
        changed = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.xxhash64("text") == F.col(before), F.col("n_chars")).otherwise(changed))
    return out.drop(before)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their ids, in sequences of at most 1024 ids.

    Null and empty texts give the end id alone, rows that repeat are packed each, an empty table gives no piece.
    """
    _bounded(spark)
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("secrets", redact_secrets), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

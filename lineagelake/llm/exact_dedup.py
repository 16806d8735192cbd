"""Exact duplicates by deterministic block naming (operator 2), with DataFrame functions only.

Each normalised text is cut into fixed-size blocks. The distinct blocks are
sorted within their partitions and get integer names; then adjacent names are paired and the
distinct pairs named, until each document has one name. Equal texts, and no
others, end with the same (rounds, name).

Blocks travel once: they are grouped under a 64-bit routing hash with their
least and greatest bytes. Where both agree, all blocks under that hash are the
same and documents fetch the name by the hash alone; hashes that hold
different blocks are resolved by the blocks themselves. The result doesn't
depend on the hash.

Defined results: null text counts as empty; equality is after lowering A-Z.
The greatest id of a group stays, nulls count as less than any id. Of rows that repeat both id and
text one stays. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import resettled
from .common import ascii_lower, settle

BLOCK = 4096
_DOC = ["id", "h", "size", "n"]


def _named(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Integer names of distinct rows, in sorted order within each partition."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _block_names(blocks: DataFrame) -> DataFrame:
    """The rows of ``blocks`` with the name of their block instead of ``key`` and ``block``."""
    ends = blocks.groupBy("key").agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
    names = settle(_named(ends, ["lo"]).select("key", "name", (F.col("lo") != F.col("hi")).alias("clash")))
    rows = blocks.drop("block").join(names.filter("not clash").drop("clash"), "key").drop("key")
    if names.filter("clash").isEmpty():
        return rows
    odd = blocks.join(names.filter("clash").select("key"), "key", "left_semi")
    own = settle(_named(odd.select("block").distinct(), ["block"]).withColumn("name", -1 - F.col("name")))
    return rows.unionByName(odd.drop("key").join(own, "block").drop("block"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, route=F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    text = docs.select(F.col(id_col).alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    size = F.octet_length("text")
    text = text.select("id", F.xxhash64("text").alias("h"), size.alias("size"), F.greatest(F.lit(1), F.ceil(size / block)).cast("int").alias("n"), F.sha2("text", 256).alias("sha"), F.col("text").cast("binary").alias("raw"))
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.substring(F.col("raw"), k * block + 1, F.lit(block)))
    blocks = text.select(*_DOC, "sha", F.posexplode(cut).alias("pos", "block"))
    blocks = blocks.select(*_DOC, F.when(F.col("pos") == 0, F.col("sha")).alias("sha"), "pos", "block", route(F.col("block")).alias("key"))
    now = settle(_block_names(blocks))
    documents = now.filter("pos = 0").groupBy(*_DOC).agg(F.count("*").alias("copies"), F.first("sha").alias("sha"), F.first("name").alias("name"))
    found = [documents.filter("n = 1").withColumn("rounds", F.lit(0))]
    longest = now.agg(F.max("n")).first()[0] or 1
    now, rounds = now.filter("n > 1").select(*_DOC, "pos", "name"), 0
    rest = documents.filter("n > 1").drop("name")
    while 1 << rounds < longest:
        rounds += 1
        side = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
        pairs = now.groupBy(*_DOC, F.expr("pos div 2").cast("int").alias("pos2")).agg(side(0).alias("a"), side(1).alias("b"))
        # a last name without a partner: no name, as names of any round are never the least long
        pairs = pairs.select(*_DOC, F.col("pos2").alias("pos"), "a", F.coalesce("b", F.lit(-(2**63))).alias("b"))
        names = settle(_named(pairs.select("a", "b").distinct(), ["a", "b"]))
        now = resettled(pairs.join(names, ["a", "b"]).select(*_DOC, "pos", "name"))
        done = now.filter(f"n <= {1 << rounds}").select(*[F.col(c).alias(f"_{c}") for c in _DOC], "name")
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _DOC]
        found.append(rest.filter(f"n <= {1 << rounds} and n > {1 << (rounds - 1)}").join(done, same).select(*_DOC, "copies", "sha", "name", F.lit(rounds).alias("rounds")))
        now = now.filter(f"n > {1 << rounds}")
    every = found[0].select(*_DOC, "copies", "sha", "name", "rounds")
    for part in found[1:]:
        every = every.unionByName(part)
    every = settle(every)
    groups = settle(every.groupBy("rounds", "name").agg(F.max("id").alias("keep_id"), F.sum("copies").alias("group_size")))
    out = every.join(groups, ["rounds", "name"]).withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))

"""Episodic memory and the bounded cache: recall, anchor states, eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import settle

#: What the state of an anchor multiplies a memory's score by.
PENALTY = {"valid": 1.0, "unanchored": 0.9, "unverifiable": 0.5, "vanished": 0.35, "drifted": 0.25}
SPAN, HALF_LIFE = 200, 50


def anchor_state(anchor: Column, anchor_blob: Column, node_key: Column, node_blob: Column) -> Column:
    """State of a memory's anchor against the node it names (null: no such node)."""
    return (
        F.when(anchor.isNull(), "unanchored").when(node_key.isNull(), "vanished").when(anchor_blob.isNull() | node_blob.isNull(), "unverifiable")
        .when(anchor_blob == node_blob, "valid").otherwise("drifted")
    )


def applies(state: Column) -> Column:
    """Whether what is anchored still speaks of this tree."""
    return state.isin("unanchored", "valid")


def stale(state: Column) -> Column:
    """Whether the anchor's content changed or is gone."""
    return state.isin("drifted", "vanished")


def resolved(memory: DataFrame, nodes: DataFrame) -> DataFrame:
    """``memory`` with ``state``; columns id, anchor_key, anchor_blob are needed."""
    known = nodes.select(F.col("key").alias("node_key"), F.col("blob_hash").alias("node_blob"))
    joined = memory.join(known, F.col("anchor_key") == F.col("node_key"), "left")
    return joined.withColumn("state", anchor_state(F.col("anchor_key"), F.col("anchor_blob"), F.col("node_key"), F.col("node_blob"))).drop("node_key", "node_blob")


def decay(age: Column, kind: str = "none", parameter: float | None = None) -> Column:
    """Factor for an age in ids; a parameter of 0 is no decay."""
    if kind == "linear":
        span = SPAN if parameter is None else parameter
        return F.greatest(F.lit(0.0), 1 - age / F.lit(float(span))) if span else F.lit(1.0)
    if kind == "exponential":
        half = HALF_LIFE if parameter is None else parameter
        return F.pow(F.lit(0.5), age / F.lit(float(half))) if half else F.lit(1.0)
    return F.lit(1.0)


def recall(memory: DataFrame, nodes: DataFrame, kind: str = "none", parameter: float | None = None) -> DataFrame:
    """Live memories with ``state, age, score``; age counts from the greatest id of all rows, live or not."""
    newest = memory.agg(F.max("id").alias("newest"))
    live = resolved(memory.filter("superseded_by is null"), nodes).crossJoin(F.broadcast(newest))  # one row
    penalty = F.lit(1.0)
    for state, factor in PENALTY.items():
        penalty = F.when(F.col("state") == state, factor).otherwise(penalty)
    out = live.withColumn("age", F.col("newest") - F.col("id")).drop("newest")
    return out.withColumn("score", F.coalesce("confidence", F.lit(0.5)) * penalty * decay(F.col("age"), kind, parameter))


def evicted(cache: DataFrame, budget: int, generation: int | None = None) -> DataFrame:
    """Entries with ``pinned`` and ``evict``: those that do not apply first, then least recently used, then by key, until the total fits.

    With a generation, the most recently used entry and those of this generation or later that apply are pinned and never go.
    The running total is global by definition: the order's prefix sums come from sorted ranges, each with the sum of those before it. The
    ranges are settled, so sums and rows agree.
    """
    names = cache.columns
    if generation is None:
        cache = cache.withColumn("pinned", F.lit(False))
    else:
        newest = cache.agg(F.max_by("key", F.struct("last_used", "key")).alias("newest"))
        cache = cache.crossJoin(F.broadcast(newest)).withColumn("pinned", (F.col("key") == F.col("newest")) | ((F.col("generation") >= generation) & F.col("applies")))  # one row
    order = ["pinned", "applies", "last_used", "key"]  # the pinned come last, so all of them count for each candidate
    parts = int(cache.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = settle(cache.select(*names, "pinned").repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    sums = ranges.groupBy("part").agg(F.sum("bytes").alias("bytes"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    before = sums.select("part", F.coalesce(F.sum("bytes").over(upto), F.lit(0)).alias("before"))
    total = ranges.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranges.join(F.broadcast(before), "part").crossJoin(F.broadcast(total))  # one row for each partition; one row
    gone = F.col("before") + F.coalesce(F.sum("bytes").over(inside), F.lit(0))
    return out.withColumn("evict", ~F.col("pinned") & (F.col("total") - gone > budget)).select(*names, "pinned", "evict")


def cache_swept(cache: DataFrame, budget: int, generation: int) -> DataFrame:
    """One row: entries, pinned ones, those that go, bytes freed and kept, whether the rest is over the budget, and the next generation."""
    told = evicted(cache, budget, generation)
    size = F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint")
    freed = F.coalesce(F.sum(F.when(F.col("evict"), F.col("bytes"))), F.lit(0)).cast("bigint")
    return told.agg(
        F.count("*").alias("scanned"), F.count_if("pinned").alias("pinned"), F.count_if("evict").alias("evicted"), freed.alias("freed_bytes"), (size - freed).alias("retained_bytes"),
        (size - freed > budget).alias("over_budget"), F.lit(generation + 1).alias("generation"),
    )


def cache_state(log: DataFrame) -> DataFrame:
    """Cache entries from a log of ``key, tick, op, bytes``: the latest put with the gets since the first put. What comes before a key's last ``forget`` doesn't count."""
    gone = log.filter("op = 'forget'").groupBy("key").agg(F.max("tick").alias("gone"))
    log = log.filter("op <> 'forget'").join(gone, "key", "left").filter("gone is null or tick > gone").drop("gone")
    puts = log.filter("op = 'put'").groupBy("key").agg(F.max_by("bytes", "tick").alias("bytes"), F.min("tick").alias("first_put"))
    gets = log.groupBy("key").agg(F.max("tick").alias("last_used"))
    hits = log.filter("op = 'get'").join(puts.select("key", "first_put"), "key").filter("tick > first_put").groupBy("key").agg(F.count("*").alias("hits"))
    return puts.join(gets, "key").join(hits, "key", "left").fillna(0, ["hits"]).select("key", "bytes", "hits", "last_used")


#: Bytes of a scope and of a body at most.
MAX_SCOPE, MAX_BODY = 128, 64 * 1024


def write_fault(scope: Column, body: Column, confidence: Column) -> Column:
    """Why a memory can't be recorded, or null: its scope, its body or its confidence."""
    scoped = (F.octet_length(scope) > 0) & (F.octet_length(scope) <= MAX_SCOPE) & ~scope.rlike(r"^\s|\s\z|\p{Cntrl}")
    said = ~body.rlike(r"^\s*\z") & (F.octet_length(body) <= MAX_BODY)
    sure = confidence.isNull() | (confidence.between(0, 1) & ~F.isnan(confidence))
    ok = lambda c: F.coalesce(c, F.lit(False))
    return F.when(~ok(scoped), "scope").when(~ok(said), "body").when(~ok(sure), "confidence")


def recorded(memory: DataFrame, writes: DataFrame, nodes: DataFrame, tree: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``memory`` after ``writes`` (id, scope, kind, anchor_key, body, confidence, supersedes), and the writes with their ``fault``.

    A write with a fault changes nothing: its own, ``not_found`` for a memory to supersede that isn't there, ``superseded`` for one that already is or
    that an earlier write supersedes. Blob and path of the anchor come from the graph, null where it names no node.
    """
    old = memory.select(F.col("id").alias("supersedes"), F.col("superseded_by").alias("by"), F.lit(True).alias("there"))
    own = write_fault(F.col("scope"), F.col("body"), F.col("confidence"))
    told = writes.withColumn("own", own).join(old, "supersedes", "left")
    first = told.filter("own is null and supersedes is not null").groupBy("supersedes").agg(F.min("id").alias("first"))
    told = told.join(first, "supersedes", "left")
    late = F.col("by").isNotNull() | (F.col("first") != F.col("id"))
    fault = F.coalesce("own", F.when(F.col("supersedes").isNotNull() & F.col("there").isNull(), "not_found").when(F.col("supersedes").isNotNull() & late, "superseded"))
    told = told.select(*writes.columns, fault.alias("fault"))
    good = told.filter("fault is null")
    anchors = nodes.select(F.col("key").alias("anchor_key"), F.col("blob_hash").alias("anchor_blob"), F.col("path").alias("anchor_path"))
    fresh = good.join(anchors, "anchor_key", "left").withColumn("tree", F.lit(tree).cast("string")).withColumn("superseded_by", F.lit(None).cast(memory.schema["superseded_by"].dataType))
    over = good.filter("supersedes is not null").select(F.col("supersedes").alias("id"), F.col("id").alias("now"))
    kept = memory.join(over, "id", "left").withColumn("superseded_by", F.coalesce("superseded_by", "now")).select(*memory.columns)
    return kept.unionByName(fresh.select(*memory.columns)), told


def cached(cache: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cache entries (key, anchor_key, anchor_blob) with the ``state`` of their anchor and whether it ``applies``."""
    return resolved(cache, nodes).withColumn("applies", applies(F.col("state")))


def filtered(memory: DataFrame, scope=None, kind: str | None = None, anchor: str | None = None, superseded: bool = False) -> DataFrame:
    """Memories newest first, of a scope, kind and anchor where given; superseded ones only if asked for."""
    out = memory if superseded else memory.filter("superseded_by is null")
    for column, value in (("scope", scope), ("kind", kind), ("anchor_key", anchor)):
        out = out if value is None else out.filter(F.col(column) == value)
    return out.orderBy(F.desc("id"))

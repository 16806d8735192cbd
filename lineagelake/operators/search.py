"""Literal token search with additive scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, capped, collapsed, tokens


def _has(column: str, part: str) -> Column:
    return F.coalesce(F.lower(column).contains(part), F.lit(False))


def overview_path(path: Column) -> Column:
    return F.coalesce(F.lower(basename(path)).rlike("^(readme|overview)"), F.lit(False))


def test_path(path: Column) -> Column:
    """Whether a folder inside the path is named test or tests, in any case; the first segment doesn't count."""
    return F.coalesce(F.lower(path).rlike("/tests?/"), F.lit(False))


def graph_search(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes that hold every token, scored; the order is score descending, key.

    A query without tokens finds nothing. ``nodes`` needs key, name, path, provenance and content.
    """
    parts, whole = tokens(query), query.strip().lower()
    if not parts:
        return nodes.withColumn("score", F.lit(0).cast("bigint")).filter("false")
    fields = ("name", "key", "path", "content")
    matches = reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [_has(f, p) for f in fields]) for p in parts])
    score = F.when(F.lower("name") == whole, 100).when(_has("name", whole), 60).when(_has("content", whole), 25).otherwise(0)
    for p in parts:
        score = score + F.when(_has("name", p), 12).when(_has("key", p), 6).when(_has("content", p), 8).otherwise(3)
    score = score + F.when(F.col("provenance") == "authored", 40).otherwise(0) + F.when(overview_path(F.col("path")), 30).otherwise(0) - F.when(test_path(F.col("path")), 60).otherwise(0)
    return nodes.filter(matches).withColumn("score", F.greatest(F.lit(0), score).cast("bigint"))


def snippet(text: Column, limit: int = 300) -> Column:
    return capped(collapsed(text), limit)


def content_search(records: DataFrame, query: str) -> DataFrame:
    """Generated texts that hold every token in text or path; skipped records are never found."""
    parts, whole = tokens(query), query.strip().lower()
    if not parts:
        return records.withColumn("score", F.lit(0).cast("bigint")).filter("false")
    matches = reduce(lambda a, b: a & b, [_has("text", p) | _has("path", p) for p in parts])
    score = F.when(_has("text", whole), 25).otherwise(0)
    for p in parts:
        score = score + F.when(_has("text", p), 8).otherwise(3)
    return records.filter(matches & ~F.col("skipped")).withColumn("score", score.cast("bigint"))

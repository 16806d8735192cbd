"""Drift, version and faithfulness checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapsed

#: Structural texts that need no citation; they claim nothing, so none counts findings or denies them.
STRUCTURAL = ("Findings:", "Here are the findings:", "In summary:", "Summary:", "Details:", "Recommended next steps:")


def unresolved_links(links: DataFrame, keys: DataFrame) -> DataFrame:
    """Links (src, target) whose target is no key."""
    return links.join(keys.select(F.col("key").alias("target")), "target", "left_anti")


def duplicate_ids(docs: DataFrame) -> DataFrame:
    """Ids with more than one path: how many, and the first and last."""
    return docs.groupBy("id").agg(F.countDistinct("path").alias("paths"), F.min("path").alias("first"), F.max("path").alias("last")).filter("paths > 1")


def version_breaks(history: DataFrame) -> DataFrame:
    """Rows (doc, place, major, minor) whose version isn't above the one before."""
    order = Window.partitionBy("doc").orderBy("place")
    now = F.struct("major", "minor")
    return history.withColumn("before", F.lag(now).over(order)).filter(F.col("before").isNotNull() & (now <= F.col("before"))).select("doc", "place", "major", "minor")


def faithfulness(segments: DataFrame, findings: DataFrame) -> DataFrame:
    """Defects of rendered segments: ``rendering, place, defect``.

    A claim without text is empty, one without citations uncited, a citation of no finding dangling; structural text
    must be listed, in this case and with any white space. ``segments``: rendering, place, kind, text, citations; ``findings``: key.
    """
    claims = segments.filter("kind = 'claim'")
    empty = claims.filter(F.trim("text") == "").select("rendering", "place", F.lit("empty").alias("defect"))
    uncited = claims.filter(F.coalesce(F.size("citations"), F.lit(0)) <= 0).select("rendering", "place", F.lit("uncited").alias("defect"))
    cited = claims.select("rendering", "place", F.explode("citations").alias("key"))
    dangling = cited.join(findings.select("key"), "key", "left_anti").select("rendering", "place", F.lit("dangling").alias("defect")).distinct()
    unlisted = segments.filter("kind = 'structural'").filter(~collapsed(F.col("text")).isin(*STRUCTURAL)).select("rendering", "place", F.lit("unlisted").alias("defect"))
    return empty.unionByName(uncited).unionByName(dangling).unionByName(unlisted)


def innermost(points: DataFrame, spans: DataFrame) -> DataFrame:
    """For each point (id, path, at) the shortest span [start, end) of its path that holds it, ties by key.

    A span of up to 2**level places lies in at most two blocks of that size; a point looks in its block of each level that its path has.
    """
    n = F.col("end") - F.col("start")
    level = F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)
    block = lambda place: F.expr(f"shiftright(cast({place} as bigint), cast(level as int))")
    one = spans.filter(n > 0).groupBy("path", "start", "end").agg(F.min("key").alias("key")).withColumn("level", level)
    held = one.withColumn("block", F.explode(F.array_distinct(F.array(block("start"), block("end - 1")))))
    asked = points.join(one.select("path", "level").distinct(), "path").withColumn("block", block("at"))
    inside = asked.join(held, ["path", "level", "block"]).filter((F.col("at") >= F.col("start")) & (F.col("at") < F.col("end")))
    return inside.groupBy("id").agg(F.min_by("key", F.struct(n.alias("n"), "key")).alias("key"))


#: Fixed value: characters of a marker's name.
MARKER_NAME = 80


def marker_facts(files: DataFrame, found: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and ``contains`` edges of markers (path, line, category, text) in files (path, content).

    A marker's span are its line's bytes. It lies in the innermost of the ``symbols`` (path, key, start, end) that holds its first byte that is no white space, or else in its file. Only the lengths of lines are moved.
    """
    told = F.transform(F.split("content", "\n"), lambda t: F.struct(F.octet_length(t).alias("n"), F.octet_length(F.regexp_extract(t, "^[ \\t\\f\\r]*", 0)).alias("lead")))
    lines = files.select("path", F.posexplode(told).alias("place", "l")).select("path", (F.col("place") + 1).cast("bigint").alias("line"), "l.n", "l.lead")
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("start", F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0))).withColumn("end", F.col("start") + F.col("n")).withColumn("anchor", F.col("start") + F.col("lead"))
    key = F.concat(F.lit("marker:"), "path", F.lit("#"), F.col("line").cast("string"))
    marks = found.join(placed, ["path", "line"]).withColumn("key", key)
    name = F.when(F.char_length("text") > MARKER_NAME, F.concat(F.substring("text", 1, MARKER_NAME), F.lit("…"))).otherwise(F.col("text"))
    nodes = marks.select("key", F.lit("marker").alias("kind"), name.alias("name"), "path", F.lit("derived").alias("provenance"), "category", "text", "line", "start", "end")
    inside = innermost(marks.select(F.col("key").alias("id"), "path", F.col("anchor").alias("at")), symbols).select(F.col("id").alias("dst"), F.col("key").alias("container"))
    edges = marks.select(F.col("key").alias("dst"), "path").join(inside, "dst", "left").select(F.coalesce("container", F.concat(F.lit("file:"), "path")).alias("src"), "dst", F.lit("contains").alias("kind"), F.lit("derived").alias("provenance"))
    return nodes, edges


def version_drift(docs: DataFrame, history: DataFrame, notes: DataFrame) -> DataFrame:
    """Contradictions in documents' versions: ``path, rule, said, other``.

    ``docs``: path, front and summary versions, modified date; ``history``: path, place, version, date; ``notes``: path, line, version. Versions are
    structs of major and minor, so 1.10 follows 1.9. Rules: the front matter differs from the summary; a history row isn't above the one before it;
    a note names a version that the history lacks; the front matter differs from the history's highest; the document was last modified before a
    change that it lists. The last three need a history.
    """
    told = lambda v: F.concat_ws(".", v["major"].cast("string"), v["minor"].cast("string"))
    row = lambda df, rule, said, other: df.select("path", F.lit(rule).alias("rule"), said.cast("string").alias("said"), other.cast("string").alias("other"))
    summary = row(docs.filter("front is not null and summary is not null and front <> summary"), "summary", told(F.col("front")), told(F.col("summary")))
    before = F.lag("version").over(Window.partitionBy("path").orderBy("place"))
    order = row(history.withColumn("before", before).filter("before is not null and version <= before"), "order", told(F.col("version")), told(F.col("before")))
    known = history.select("path", "version").distinct()
    with_history = history.groupBy("path").agg(F.max("version").alias("highest"), F.max("date").alias("newest"))
    note = row(notes.join(with_history, "path").join(known, ["path", "version"], "left_anti"), "note", told(F.col("version")), F.col("line"))
    both = docs.join(with_history, "path")
    behind = row(both.filter("front is not null and front <> highest"), "history", told(F.col("front")), told(F.col("highest")))
    late = row(both.filter("modified < newest"), "modified", F.col("modified"), F.col("newest"))
    return summary.unionByName(order).unionByName(note).unionByName(behind).unionByName(late)


#: The kinds of violations.
VIOLATIONS = ("malformed-adr", "broken-link", "unknown-adr", "inactive-adr", "duplicate-adr-id", "adr-version-drift", "malformed-site-page", "duplicate-site-slug", "unjustified-allow")


def violations(**frames: DataFrame) -> DataFrame:
    """``kind, path, what`` of frames (path, what) under the names of :data:`VIOLATIONS`, dashes as underscores."""
    out = None
    for name, df in frames.items():
        kind = name.replace("_", "-")
        if kind not in VIOLATIONS:
            raise ValueError(f"no kind of violation: {kind}")
        one = df.select(F.lit(kind).alias("kind"), "path", F.col("what").cast("string").alias("what"))
        out = one if out is None else out.unionByName(one)
    return out


def enclosing(spans: DataFrame) -> DataFrame:
    """For each definition (key, path, start, end) the smallest other one of its path that holds it and is larger, ties by key: ``key, parent``."""
    begin = spans.select(F.col("key").alias("id"), "path", F.col("start").alias("at"), F.col("end").alias("upto"))
    level = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)
    block = lambda place: F.expr(f"shiftright(cast({place} as bigint), cast(level as int))")
    one = spans.withColumn("n", F.col("end") - F.col("start")).filter("n > 0").withColumn("level", level)
    held = one.withColumn("block", F.explode(F.array_distinct(F.array(block("start"), block("end - 1")))))
    asked = begin.join(one.select("path", "level").distinct(), "path").withColumn("block", block("at"))
    inside = asked.join(held, ["path", "level", "block"]).filter((F.col("start") <= F.col("at")) & (F.col("end") >= F.col("upto")) & (F.col("n") > F.col("upto") - F.col("at")))
    return inside.groupBy(F.col("id").alias("key")).agg(F.min_by("key", F.struct("n", "key")).alias("parent"))

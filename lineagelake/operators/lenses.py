"""Whole-graph lenses: listings, counts, coupling, hotspots, markers, config secrets, explanation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import REDACTED, glob_regex, rounded, secret_named


def window(df: DataFrame, order: list[Column], limit: int = 0, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in an order; a limit of 0 is no limit."""
    df = df.orderBy(*order)
    df = df.offset(offset) if offset else df
    return df.limit(limit) if limit else df


def endpoints(edges: DataFrame) -> DataFrame:
    """Both ends of every edge: ``key, other, kind, provenance, confidence, direction``. The edges are read once."""
    end = lambda a, b, direction: F.struct(F.col(a).alias("key"), F.col(b).alias("other"), F.lit(direction).alias("direction"))
    both = edges.select("kind", "provenance", "confidence", F.explode(F.array(end("src", "dst", "out"), end("dst", "src", "in"))).alias("e"))
    return both.select("e.key", "e.other", "kind", "provenance", "confidence", "e.direction")


def listing(nodes: DataFrame, kinds: list[str], needle: str = "", provenance: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of nodes by kind, provenance and a part of name or key, with the ``total`` before the cut."""
    found = nodes.filter(F.col("kind").isin(*kinds))
    if provenance:
        found = found.filter(F.col("provenance") == provenance)
    if needle:
        found = found.filter(F.lower("name").contains(needle.lower()) | F.lower("key").contains(needle.lower()))
    total = found.agg(F.count("*").alias("total"))
    page = window(found, [F.col("key").asc()], limit, offset)
    return page.select("key", "kind", "name", "path", "lang").crossJoin(F.broadcast(total))  # one row


def language(key: Column) -> Column:
    """Language of a symbol's key, null for other keys."""
    return F.nullif(F.regexp_extract(key, "^sym:([^:]+):", 1), F.lit(""))


def same_language(a: Column, b: Column) -> Column:
    """Whether two keys may call each other: equal languages, or one has none."""
    return F.coalesce(language(a) == language(b), F.lit(True))


def coupling(edges: DataFrame) -> DataFrame:
    """Distinct partners by ``calls``: fan_in, fan_out, total, instability. Self calls and calls from one language to another are left out."""
    calls = edges.filter("kind = 'calls' and src <> dst").filter(same_language(F.col("src"), F.col("dst"))).select("src", "dst").distinct()
    ends = calls.select(F.explode(F.array(F.struct(F.col("dst").alias("key"), F.lit(True).alias("called")), F.struct(F.col("src").alias("key"), F.lit(False).alias("called")))).alias("e")).select("e.*")
    both = ends.groupBy("key").agg(F.count_if("called").alias("fan_in"), F.count_if(~F.col("called")).alias("fan_out"))
    total = F.col("fan_in") + F.col("fan_out")
    return both.select("key", "fan_in", "fan_out", total.alias("total"), rounded(F.col("fan_out") / total).alias("instability"))


def coupling_counts(edges: DataFrame) -> DataFrame:
    """One row: edges of kind ``calls``, how many are self calls or cross languages, and the nodes that the others couple."""
    calls = edges.filter("kind = 'calls'").select("src", "dst", (F.col("src") == F.col("dst")).alias("own"))
    calls = calls.withColumn("cross", ~F.col("own") & ~same_language(F.col("src"), F.col("dst")))
    nodes = calls.filter("not own and not cross").select(F.explode(F.array("src", "dst")).alias("key")).distinct().agg(F.count("*").alias("coupled_nodes"))
    sums = calls.agg(F.count("*").alias("call_edges"), F.count_if("own").alias("self_calls"), F.count_if("cross").alias("cross_language_calls"))
    return sums.crossJoin(nodes)  # one row each


def coupling_order(by: str = "total") -> list[Column]:
    """By total, fan_in or fan_out, ties by key."""
    return [F.desc(by), F.asc("key")]


def counted(frames: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``what, kind, n``: rows of each frame by a column of it, in one listing."""
    out = [df.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n") for what, (df, kind) in frames.items()]
    return reduce(DataFrame.unionByName, out)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge ends per node over all kinds, self loops twice, nodes without edges 0."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("key"))
    return nodes.select("key", "kind").join(ends.groupBy("key").agg(F.count("*").alias("degree")), "key", "left").fillna(0, ["degree"])


def neighbours(edges: DataFrame, keys: list[str], direction: str = "both") -> DataFrame:
    """Keys one edge away from some keys."""
    ends = endpoints(edges.filter(F.col("src").isin(*keys) | F.col("dst").isin(*keys))).filter(F.col("key").isin(*keys))
    if direction != "both":
        ends = ends.filter(F.col("direction") == direction)
    return ends.select(F.col("other").alias("key")).distinct()


def explained(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node with sorted lists of what leads out of it and into it."""
    entry = F.struct("kind", "other", "provenance", "confidence")
    ends = endpoints(edges).join(nodes.select("key"), "key", "left_semi")
    per = ends.groupBy("key").agg(F.array_sort(F.collect_list(F.when(F.col("direction") == "out", entry))).alias("outgoing"), F.array_sort(F.collect_list(F.when(F.col("direction") == "in", entry))).alias("incoming"))
    return nodes.join(per, "key", "left")


#: The rules of the marker scan in their order: text, category, mode, and whether only comments count in code.
MARKER_RULES = (
    ("todo!(", "stub", "text", False), ("unimplemented!(", "stub", "text", False), ("todo", "todo", "phrase", False), ("fixme", "fixme", "phrase", False), ("BUG", "fixme", "word", False),
    ("HACK", "hack", "word", False), ("XXX", "hack", "word", False), ("bug", "fixme", "annotation", False), ("hack", "hack", "annotation", False), ("xxx", "hack", "annotation", False),
    ("not yet implemented", "stub", "phrase", True), ("not implemented", "stub", "phrase", True), ("placeholder implementation", "stub", "phrase", True), ("returns a placeholder", "stub", "phrase", True),
    ("for now", "deferred", "phrase", True), ("deferred", "deferred", "phrase", True), ("follow-up", "deferred", "phrase", True), ("followup", "deferred", "phrase", True), ("tbd", "deferred", "phrase", True),
)
#: Fixed value: an open item of a Markdown list is deferred work where no rule matches.
OPEN_ITEM = ("deferred", r"^\s*[-*+] \[ \]")
#: Extensions of code by the start of a line comment and whether ``/* */`` are comments too; other files are prose.
COMMENTS = {
    ("//", True): ("rs", "c", "h", "cc", "cpp", "cxx", "hpp", "hh", "js", "jsx", "mjs", "cjs", "ts", "tsx", "go", "java", "kt", "kts", "swift", "scala", "cs", "php", "m", "mm", "rust", "dart", "zig", "v"),
    ("#", False): ("py", "rb", "sh", "bash", "zsh", "pl", "pm", "tcl", "r", "nim"),
    ("--", True): ("sql",),
    ("--", False): ("lua", "hs", "elm", "adb", "ads"),
    (";", False): ("el", "lisp", "clj", "cljs", "cljc", "scm", "ss", "rkt"),
}
IGNORE_LINE, IGNORE_FILE = "lineagelake:ignore", "lineagelake:ignore-file"


def rule_pattern(needle: str, mode: str) -> str:
    """Pattern of a rule: text as it is, a word in its case, a phrase in any, or an annotation, which a colon or bracket follows; ``pattern`` is one already."""
    quoted = re.sub(r"([^A-Za-z0-9 _-])", r"\\\1", needle)
    start, end = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
    return {"text": quoted, "word": start + quoted + end, "phrase": f"(?i){start}{quoted}{end}", "annotation": f"(?i){start}{quoted}[:(]", "pattern": needle}[mode]


def comments_only(path: Column, content: Column) -> Column:
    """``content`` without its code: all but comments goes, line ends stay. Texts of no known language are comments as a whole.

    String literals are not told apart, so a comment's start inside one begins a comment.
    """
    out = content
    ending = F.lower(F.substring_index(path, ".", -1))
    for (line, block), names in COMMENTS.items():
        comment = f"({line}[^\\n]*)" + (r"|/\*([\s\S]*?)(?:\*/|\z)" if block else "|(\\b\\B)")
        first = re.escape(line[0]) + ("/" if block else "")
        out = F.when(ending.isin(*names), F.regexp_replace(content, f"{comment}|[^\\n{first}]+|[{first}]", "$1$2")).otherwise(out)
    return out


def markers(files: DataFrame, rules: tuple[tuple, ...] = MARKER_RULES, ignore: tuple[str, ...] = (), items: bool = True) -> DataFrame:
    """Lines of file contents that match a rule, the first of them for each line: ``path, line, category, text``.

    A rule's text must occur for it to match; a rule that is a pattern names such texts, in lower case, as its fifth part. Files and lines without
    any are passed over by plain search. Each line is classified once, and only the lines that match are laid out as rows. A line with :data:`IGNORE_LINE` and a file with :data:`IGNORE_FILE` are passed over.
    """
    for glob in ignore:
        files = files.filter(~F.col("path").rlike(glob_regex(glob)))
    patterns = [(name, rule_pattern(needle, mode), inside, hints[0] if hints else (needle.lower(),)) for needle, name, mode, inside, *hints in rules]
    patterns += [(*OPEN_ITEM, False, (" [ ]",))] if items else []
    some = lambda low, hints: reduce(lambda a, b: a | b, [low.contains(h) for h in hints])
    hints = sorted({h for *_, hs in patterns for h in hs})
    content = F.col("content")
    # in a lambda, so that the text is lowered once
    found = files.filter(F.exists(F.array(F.lower(content)), lambda low: some(low, hints)) & ~content.contains(IGNORE_FILE))
    parts = [F.split(content, "\n").alias("text"), F.split(F.lower(content), "\n").alias("low")]
    if any(only for _, _, only, _ in patterns):
        parts.append(F.split(comments_only(F.col("path"), content), "\n").alias("comment"))

    def category(line: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern, only, of in reversed(patterns):
            out = F.when(some(line["low"], of) & line["comment" if only else "text"].rlike(pattern), name).otherwise(out)
        return F.when(~line["text"].contains(IGNORE_LINE), out)

    told = F.transform(F.arrays_zip(*parts), lambda line, at: F.struct((at + 1).cast("bigint").alias("line"), category(line).alias("category"), line["text"].alias("text")))
    # the outer form, as the plain one would evaluate the array once more to pass over empty ones
    rows = found.select("path", F.explode_outer(F.filter(told, lambda m: m["category"].isNotNull())).alias("m")).filter("m is not null").select("path", "m.*")
    text = F.regexp_replace("text", r"(?U)^\s+|\s+\z", "")
    return rows.withColumn("text", F.when(F.char_length(text) > MARKER_TEXT, F.concat(F.substring(text, 1, MARKER_TEXT), F.lit("…"))).otherwise(text))


#: Fixed value: characters of a marked line that are kept.
MARKER_TEXT = 200


def marker_items(found: DataFrame, categories: tuple[str, ...] = ()) -> DataFrame:
    """Markers by path, line and key, of some categories or all."""
    found = found.filter(F.col("category").isin(*categories)) if categories else found
    return found.select(F.concat(F.lit("marker:"), "path", F.lit("#"), F.col("line").cast("string")).alias("key"), F.coalesce("category", F.lit("other")).alias("category"), "text", "path", "line").orderBy(F.asc_nulls_first("path"), F.asc_nulls_first("line"), "key")


def marker_inventory(found: DataFrame) -> DataFrame:
    return found.groupBy(F.coalesce("category", F.lit("other")).alias("category")).agg(F.count("*").alias("markers"), F.countDistinct("path").alias("files"))


def density(found: DataFrame, files: DataFrame, min_lines: int = 50) -> DataFrame:
    """Markers per thousand lines of files with at least ``min_lines``, with the markers of each category."""
    per = found.groupBy("path", "category").agg(F.count("*").alias("n")).groupBy("path").agg(F.sum("n").alias("markers"), F.array_sort(F.collect_list(F.struct("category", "n"))).alias("by_category"))
    rate = F.col("markers") / F.col("lines")
    return per.join(files.select("path", "lines"), "path").filter((F.col("lines") >= min_lines) & (F.col("lines") > 0)).select("path", "markers", "lines", rounded(rate * 1000).alias("per_kloc"), rate.alias("rate"), "by_category")


def density_order(by: str = "rate") -> list[Column]:
    """By rate, markers or lines, ties by path."""
    return [F.desc(by), F.asc("path")]


def density_totals(found: DataFrame, files: DataFrame, min_lines: int = 50) -> DataFrame:
    """One row: files ranked, too short or of unknown length, and the ratio over those ranked."""
    per = found.groupBy("path").agg(F.count("*").alias("markers")).join(files.select("path", "lines"), "path", "left")
    ranked = (F.col("lines") >= min_lines) & (F.col("lines") > 0)
    sums = per.agg(
        F.count_if(ranked).alias("ranked"), F.count_if(~ranked).alias("short"), F.count_if(F.col("lines").isNull()).alias("unknown"),
        F.coalesce(F.sum(F.when(ranked, F.col("markers"))), F.lit(0)).alias("markers"), F.coalesce(F.sum(F.when(ranked, F.col("lines"))), F.lit(0)).alias("lines"),
    )
    return sums.withColumn("per_kloc", F.when(F.col("lines") > 0, rounded(F.col("markers") * 1000 / F.col("lines"))))


def secret_state(value: Column) -> Column:
    """State of a secret-named key: declared without a value, redacted, or present, also if empty."""
    return F.when(value.isNull(), "declared").when(value == REDACTED, "redacted").otherwise("present")


def secret_items(keys: DataFrame) -> DataFrame:
    """Secret-named keys (file, key, value) with their state instead of the value."""
    return keys.filter(secret_named(F.col("key"))).select("file", "key", secret_state(F.col("value")).alias("state"))


def secret_report(keys: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row, or one for each of ``by``: keys, secret-named ones by state, values redacted under other names, files with secret-named keys.

    ``keys``: file, key, value; a null value is unknown, which is not an empty one.
    """
    secret, state = secret_named(F.col("key")), secret_state(F.col("value"))
    return keys.groupBy(*(by or [])).agg(
        F.count("*").alias("keys"), F.count_if(secret).alias("secrets"), *[F.count_if(secret & (state == s)).alias(s) for s in ("declared", "redacted", "present")],
        F.count_if(~secret & (state == "redacted")).alias("redacted_other"), F.countDistinct(F.when(secret, F.col("file"))).alias("files"),
    )


def round_robin(ends: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` edges per key and direction, dealt one per kind and round, and what each kind leaves out: ``key, direction, kind, other, provenance, turn, omitted``.

    How many of each kind are dealt follows from their numbers, see :func:`dealt`. The window is limited to ``cap`` rows of each kind before its shuffle, so a hub sends ``cap`` rows a task.
    """
    kind = ["key", "direction", "kind"]
    turn = F.row_number().over(Window.partitionBy(*kind).orderBy("other", "provenance"))
    first = ends.select(*kind, "other", "provenance").withColumn("turn", turn).filter(F.col("turn") <= cap)
    return first.join(dealt(ends, cap), kind).filter("turn <= kept").select(*kind, "other", "provenance", "turn", (F.col("of_kind") - F.col("kept")).alias("omitted"))


def dealt(ends: DataFrame, cap: int) -> DataFrame:
    """``key, direction, kind, of_kind, kept``: the edges of each kind, and how many of them are among the first ``cap`` of their key and direction where kinds take turns in their order.

    All kinds have their whole rounds; of the round that the cap cuts, the first kinds that still have edges. From counts alone: what a key has here are its kinds.
    """
    per = ends.groupBy("key", "direction", "kind").agg(F.count("*").alias("n")).groupBy("key", "direction").agg(F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("kinds"))
    taken = lambda t: F.aggregate("kinds", F.lit(0).cast("bigint"), lambda s, k: s + F.least(k["n"], t))
    rounds = F.when(taken(F.lit(cap)) <= cap, cap).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.lit(cap)), lambda t: taken(t) <= cap)))
    told = per.withColumn("rounds", rounds).withColumn("rest", F.lit(cap) - taken(F.col("rounds")))
    more = F.filter(F.transform("kinds", lambda k, i: F.when(k["n"] > F.col("rounds"), i)), lambda i: i.isNotNull())
    kept = lambda k, i: F.least(k["n"], F.col("rounds")) + F.when(F.array_contains(F.slice("more", 1, F.col("rest").cast("int")), i), 1).otherwise(0)
    each = F.transform("kinds", lambda k, i: F.struct(k["kind"].alias("kind"), k["n"].alias("of_kind"), kept(k, i).alias("kept")))
    return told.withColumn("more", more).select("key", "direction", F.explode(each).alias("k")).select("key", "direction", "k.*")


def merged_ignore(layers: list[tuple[list[str] | None, bool]]) -> list[str] | None:
    """Glob lists of nearer and nearer layers in one, each pattern once, inherited first; a layer that resets drops what it inherits. None if no layer has a list."""
    out: list[str] | None = None
    for globs, reset in layers:
        if reset:
            out = None if globs is None else list(globs)
        elif globs is not None:
            out = list(dict.fromkeys([*(out or []), *globs]))
    return out

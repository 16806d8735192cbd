"""Importers of other tools' graphs, their comparison with ours, and references that leave the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..plans.lineage import settle
from .lenses import IGNORE_FILE

_LINKS = (
    "nodes array<struct<id:string,label:string,file_type:string,source_file:string,_origin:string>>, links array<struct<source:string,target:string,relation:string,confidence:string,confidence_score:double,_origin:string>>, "
    "hyperedges array<struct<id:string,label:string,nodes:array<string>,confidence_score:double>>"
)
#: Relations that have an edge kind of their own; any other is the kind. The confidence of an edge that tells none.
RELATED, REFERENCES, CONFIDENCE = ("conceptually_related_to", "semantically_similar_to", ""), ("references", "rationale_for"), 0.5


def node_link(documents: DataFrame, prefix: str = "import") -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Nodes, inferred edges and a report of node-link JSON in column ``json``.

    Code nodes go, and links that come from syntax trees unless they are marked as inferred; a link to a node that went is dangling. A hyperedge with
    an imported member becomes a group related to its members. The JSON is read once: what is in it is laid out, counted while it is written, and
    the rest works on that. Of nodes of one id the last counts.
    """
    empty = F.array().cast("array<string>")
    text = lambda c: F.coalesce(c, F.lit(""))

    def parts(name, a, b, c, d, many=empty, score=None):
        none = F.lit(None).cast("double")
        at = lambda x, i: F.struct(F.lit(name).alias("what"), i.alias("place"), *[text(f(x)).alias(n) for f, n in ((a, "a"), (b, "b"), (c, "c"), (d, "d"))], x["_origin" if name != "group" else "id"].alias("origin"), (many(x) if callable(many) else many).alias("many"), (none if score is None else x[score]).alias("score"))
        return lambda column: F.transform(F.coalesce(F.col(column), F.array().cast(kinds[column])), at)

    doc = documents.select(F.from_json("json", _LINKS).alias("d")).select("d.*")
    kinds = dict(doc.dtypes)
    rows = [
        parts("node", lambda x: x["id"], lambda x: x["label"], lambda x: x["file_type"], lambda x: x["source_file"])("nodes"),
        parts("link", lambda x: x["source"], lambda x: x["target"], lambda x: x["relation"], lambda x: x["confidence"], score="confidence_score")("links"),
        parts("group", lambda x: x["id"], lambda x: x["label"], lambda x: F.lit(""), lambda x: F.lit(""), lambda x: F.coalesce(x["nodes"], empty), "confidence_score")("hyperedges"),
    ]
    what = F.col("what")
    code = (what == "node") & (F.col("c") == "code")
    syntax = (what == "link") & F.coalesce(F.col("origin") == "ast", F.lit(False)) & (F.lower("d") != "inferred")
    laid = doc.select(F.explode(F.concat(*rows)).alias("r")).select("r.*")
    counted = Observation()
    totals = [F.count_if(c).alias(n) for n, c in (("nodes", what == "node"), ("links", what == "link"), ("hyperedges", what == "group"), ("code_nodes", code), ("ast_links", syntax))]
    kept = settle(laid.observe(counted, *totals).filter(~code & ~syntax))
    key = lambda c, more="": F.concat(F.lit(f"{prefix}:{more}"), c)
    named = lambda: F.when(F.col("b") == "", F.col("a")).otherwise(F.col("b"))
    node = kept.filter("what = 'node'").groupBy(key(F.col("a")).alias("key")).agg(F.max_by(F.struct(F.when(F.col("c").isin("document", ""), "doc").otherwise(F.col("c")).alias("kind"), named().alias("name"), F.nullif("d", F.lit("")).alias("path")), "place").alias("n")).select("key", "n.*")
    node = settle(node)
    keys = node.select("key")
    sure = F.least(F.greatest(F.coalesce("score", F.lit(CONFIDENCE)), F.lit(0.0)), F.lit(1.0)).alias("confidence")
    kind = F.when(F.col("c").isin(*RELATED), "related").when(F.col("c").isin(*REFERENCES), "references").otherwise(F.col("c"))
    links = kept.filter("what = 'link'").select(key(F.col("a")).alias("src"), key(F.col("b")).alias("dst"), kind.alias("kind"), sure)
    told = Observation()
    links = settle(links.join(keys, F.col("src") == keys["key"], "left_semi").join(keys, F.col("dst") == keys["key"], "left_semi").observe(told, F.count("*").alias("edges")))
    group = kept.filter("what = 'group'")
    members = group.select(key(F.col("a"), "group:").alias("src"), named().alias("name"), sure, F.explode("many").alias("m")).select("src", "name", key(F.col("m")).alias("dst"), "confidence")
    members = settle(members.join(keys, members["dst"] == keys["key"], "left_semi"))
    groups = members.groupBy(F.col("src").alias("key")).agg(F.max("name").alias("name")).select("key", F.lit("group").alias("kind"), "name", F.lit(None).cast("string").alias("path"))
    edges = links.unionByName(members.select("src", "dst", F.lit("related").alias("kind"), "confidence"))
    n = counted.get
    report = {**n, "nodes_kept": n["nodes"] - n["code_nodes"], "edges_kept": told.get["edges"], "dangling": n["links"] - n["ast_links"] - told.get["edges"], "groups_kept": groups.count()}
    return node.unionByName(groups).withColumn("provenance", F.lit("inferred")), edges.withColumn("provenance", F.lit("inferred")).withColumn("src_ref", F.lit(f"import:{prefix}")), report


def compared(ours: DataFrame, theirs: DataFrame, samples: int = 25) -> tuple[DataFrame, DataFrame]:
    """Symbols (path, name) of two graphs: one row of counts, and samples of each side's surplus by (path, leaf).

    What differs only in its scope has the same path and leaf on both sides.
    """
    a, b = ours.select("path", "name").distinct(), theirs.select("path", "name").distinct()
    matched = a.join(b, ["path", "name"], "left_semi").agg(F.count("*").alias("matched"))
    leaf = F.substring_index("name", "::", -1)
    left, right = a.join(b, ["path", "name"], "left_anti").withColumn("leaf", leaf), b.join(a, ["path", "name"], "left_anti").withColumn("leaf", leaf)
    both = left.groupBy("path", "leaf").agg(F.count("*").alias("l")).join(right.groupBy("path", "leaf").agg(F.count("*").alias("r")), ["path", "leaf"], "full_outer").fillna(0, ["l", "r"])
    sums = both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in ((F.least("l", "r"), "scope_difference"), (F.greatest(F.lit(0), F.col("l") - F.col("r")), "only_ours"), (F.greatest(F.lit(0), F.col("r") - F.col("l")), "only_theirs"))])
    surplus = both.filter("l <> r").select(F.when(F.col("l") > F.col("r"), "ours").otherwise("theirs").alias("side"), "path", "leaf", F.abs(F.col("l") - F.col("r")).alias("n"))
    order = Window.partitionBy("side").orderBy("path", "leaf")
    top = [surplus.filter(F.col("side") == s).orderBy("path", "leaf").limit(samples) for s in ("ours", "theirs")]
    return matched.crossJoin(sums), top[0].unionByName(top[1]).withColumn("place", F.row_number().over(order))


def back_links(lines: DataFrame, keys: DataFrame, tag: str = "@lat") -> tuple[DataFrame, DataFrame]:
    """Distinct edges of ``@lat: [[target]]`` annotations (path, text) to known keys, and one row with the number that resolve to none."""
    found = lines.select("path", F.explode(F.regexp_extract_all("text", F.lit(rf"{tag}:\s*\[\[([^\]]+)\]\]"), 1)).alias("target")).distinct()
    joined = found.join(keys.select(F.col("key").alias("target"), F.lit(True).alias("there")), "target", "left")
    return joined.filter("there").select(F.concat(F.lit("file:"), "path").alias("src"), F.col("target").alias("dst")), joined.agg(F.count_if(F.col("there").isNull()).alias("unresolved"))


def external_references(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges into nodes outside the graph that are not derived."""
    out = nodes.filter("kind = 'external_ref'").select(F.col("key").alias("dst"))
    return edges.filter("provenance <> 'derived'").join(out, "dst", "left_semi")


def bridged(keys: DataFrame, structs: DataFrame) -> DataFrame:
    """Each config key (key, section, field) with the one struct that has the field and is named like the section, or section + ``config``.

    ``structs``: struct, name, fields. No or several structs give null.
    """
    fields = structs.select("struct", F.lower("name").alias("name"), F.explode("fields").alias("field"))
    names = keys.select("key", "field", F.explode(F.array(F.lower("section"), F.concat(F.lower("section"), F.lit("config")))).alias("name"))
    hits = names.join(fields, ["name", "field"]).groupBy("key").agg(F.countDistinct("struct").alias("n"), F.min("struct").alias("struct"))
    return keys.join(hits, "key", "left").select("key", F.when(F.col("n") == 1, F.col("struct")).alias("struct"))


def governing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per path the sorted names of sections with an authored edge to one of its symbols."""
    laws = edges.filter("provenance = 'authored'")
    at = laws.join(nodes.select(F.col("key").alias("dst"), "path"), "dst").join(nodes.select(F.col("key").alias("src"), F.col("name").alias("section")), "src")
    return at.groupBy("path").agg(F.array_sort(F.collect_set("section")).alias("sections"))


def forgotten(memory: DataFrame, ident: int) -> DataFrame:
    """``memory`` without one row; what that row superseded is live again."""
    revive = F.when(F.col("superseded_by") == ident, None).otherwise(F.col("superseded_by"))
    return memory.filter(F.col("id") != ident).withColumn("superseded_by", revive)


def escalation(reply: Column, rounds: Column, called: Column, most: int, floor: int = 16) -> Column:
    """Why a reply should go to a stronger model, or null; the first reason counts. ``most`` or ``floor`` 0 is none."""
    stalled = (rounds >= most) & ~called if most > 0 else F.lit(False)
    return F.when(F.char_length(reply) == 0, "empty_output").when(stalled, "no_tool_call_after_max_rounds").when(F.char_length(reply) < floor, "below_length_floor")


def already_shown(body: Column, signature: Column, probe: int = 60) -> Column:
    """Whether a document's opening stands in a diff's signature; short ones count as shown."""
    return (F.char_length(body) < probe) | signature.contains(F.substring(body, 1, probe))


def caveats(score: DataFrame) -> DataFrame:
    """``score`` with the sentences its counts call for.

    Read where they are there: ``attempted`` of ``corpus`` commits, ``singletons`` (classes of one row), ``found`` with ``chance`` (matches that
    chance would give), ``unadjudicated`` findings, ``suppressed_real`` rows. Up to twice chance is not clearly above it.
    """
    has = lambda *names: all(n in score.columns for n in names)
    number = lambda c: F.col(c).cast("string")
    parts = []
    if has("attempted", "corpus"):
        parts.append(F.when(F.col("attempted") < F.col("corpus"), F.concat(F.lit("partial run: "), number("attempted"), F.lit(" of "), number("corpus"), F.lit(" commits"))))
    if has("singletons"):
        parts.append(F.when(F.col("singletons") > 0, F.concat(number("singletons"), F.lit(" classes have one row"))))
    if has("found", "chance"):
        parts.append(F.when(F.col("found") <= 2 * F.col("chance"), "recall is not clearly above chance"))
    if has("unadjudicated"):
        parts.append(F.when(F.col("unadjudicated") > 0, F.concat(number("unadjudicated"), F.lit(" findings are unadjudicated"))))
    if has("suppressed_real"):
        parts.append(F.when(F.col("suppressed_real") > 0, F.concat(number("suppressed_real"), F.lit(" real rows were suppressed"))))
    return score.withColumn("caveats", F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>"))


def unjustified_allows(lines: DataFrame) -> DataFrame:
    """``path, line`` of Rust lines that begin with ``#[allow(`` or ``#![allow(``, without a comment behind the last bracket or right above their run of attributes.

    ``lines``: path, line, text. A file that holds :data:`IGNORE_FILE` is passed over.
    """
    lines = lines.filter(F.lower("path").rlike(r"(?s).[^/]*\.rs\z|/[^/]+\.rs\z"))
    order = Window.partitionBy("path").orderBy("line")
    attribute, comment = F.col("text").rlike(r"(?U)^\s*#!?\["), F.col("text").rlike(r"(?U)^\s*//")
    marked = lines.withColumn("attribute", attribute).withColumn("above", F.lag(comment).over(order))
    marked = marked.withColumn("exempt", F.max(F.col("text").contains(IGNORE_FILE)).over(Window.partitionBy("path")))
    run = F.sum(F.when(~F.col("attribute"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = marked.withColumn("run", run).filter("attribute and not exempt")
    first = F.first("above").over(Window.partitionBy("path", "run").orderBy("line"))
    behind = F.col("text").rlike(r"(?s)\][^\]]*//[^\]]*\z")
    return runs.withColumn("told", F.coalesce(first, F.lit(False))).filter(F.col("text").rlike(r"(?U)^\s*#!?\[allow\(") & ~F.col("told") & ~behind).select("path", "line")


#: The words of the reply format, the marks it may wear, the classes of findings, and what stands for yes.
FINDING, CLEAN, THINKING = "finding", "no findings", "<think>"
CLASSES = (
    "cleanup-gap", "contract-drift", "error-text-drift", "false-compile-claim", "lint-convention", "lossy-identity", "missing-event", "ordering-bug", "perf-contract", "permissive-constraint",
    "prose-clarity", "silent-truncation", "ux-diagnostic", "vacuous-test",
)
YES = ("yes", "true", "y", "1")
UNDESCRIBED = "(no description given)"


def reply_lines(replies: DataFrame) -> DataFrame:
    """The lines of model replies (id, reply) that say something: ``id, place, what, line, class, compile, description``.

    ``what`` is ``finding``, ``unparsed`` (a finding without a line number that can be read) or ``clean``. A finding is a line of fields between bars: ``line=``, ``class=`` and
    ``compile=`` in any order, the last of each counts, and a description, whose parts are kept as they are. Bullets, quotes, bold and code marks around lines and fields don't matter.
    """
    trimmed = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")
    rows = replies.select("id", F.posexplode(F.split("reply", "\n")).alias("place", "text"))
    bare = F.regexp_replace(F.regexp_replace(trimmed(F.col("text")), r"^[-*># ]+", ""), r"^`+", "")
    rows = rows.withColumn("text", trimmed(F.regexp_replace(trimmed(bare), r"\*\*\z", "")))
    said = rows.filter((F.lower("text") == CLEAN) | F.lower("text").startswith(FINDING))

    def field(f):
        own = trimmed(F.regexp_replace(trimmed(f), r"`+\z", ""))
        plain = F.replace(own, F.lit("**"), F.lit(""))
        name = F.when(plain.contains("="), F.lower(trimmed(F.substring_index(plain, "=", 1))))
        return F.struct(own.alias("own"), name.alias("name"), trimmed(F.regexp_replace(plain, r"(?s)^[^=]*=", "")).alias("value"))

    cells = F.transform(F.slice(F.split("text", r"\|"), 2, 1_000_000), field)
    last = lambda name: F.try_element_at(F.filter("cells", lambda c: c["name"] == name), F.lit(-1))["value"]
    number = F.when(last("line").rlike(r"^\+?[0-9]+\z"), F.expr("try_cast(regexp_replace(value, '^[+]', '') as bigint)"))
    known = F.array(*[F.lit(n) for n in ("line", "class", "compile")])
    prose = F.aggregate(F.filter("cells", lambda c: ~F.coalesce(F.array_contains(known, c["name"]), F.lit(False))), F.lit(""), lambda all_, c: F.when(all_ != "", F.concat(all_, F.lit(" | "), c["own"])).otherwise(c["own"]))
    out = said.withColumn("cells", cells).withColumn("value", last("line")).withColumn("line", number).withColumn("line", F.when(F.col("line").between(1, 2**32 - 1), F.col("line")))
    out = out.withColumn("class", F.lower(last("class"))).withColumn("class", F.when(F.col("class").isin(*CLASSES), F.col("class"))).withColumn("compile", F.coalesce(F.lower(last("compile")).isin(*YES), F.lit(False)))
    clean = F.lower("text") == CLEAN
    what = F.when(clean, "clean").when(F.col("line").isNull(), "unparsed").otherwise("finding")
    told = F.when(trimmed(prose) == "", UNDESCRIBED).otherwise(trimmed(prose))
    own = what == "finding"
    return out.select("id", "place", what.alias("what"), F.when(own, F.col("line")).alias("line"), F.when(own, F.col("class")).alias("class"), (own & F.col("compile")).alias("compile"), F.when(own, told).when(~clean, F.col("text")).alias("description"))


def reply_findings(replies: DataFrame) -> DataFrame:
    """``id, line, class, compile, description`` of the findings of model replies."""
    return reply_lines(replies).filter("what = 'finding'").select("id", "line", "class", "compile", "description")


def reply_verdicts(replies: DataFrame) -> DataFrame:
    """``id, findings, unparsed, clean, cut_off`` of every reply; cut off is one that ended while it was still thinking."""
    per = reply_lines(replies).groupBy("id").agg(*[F.count_if(F.col("what") == w).alias(n) for w, n in (("finding", "findings"), ("unparsed", "unparsed"), ("clean", "declared"))])
    out = replies.select("id", F.coalesce(F.col("reply").contains(THINKING), F.lit(False)).alias("cut_off")).join(per, "id", "left").fillna(0, ["findings", "unparsed", "declared"])
    return out.select("id", "findings", "unparsed", (F.col("declared") > 0).alias("clean"), "cut_off")


def numbered_diff(lines: DataFrame) -> DataFrame:
    """Lines of unified diffs (file, place, text) with their number in the new file; removed lines and headers have none."""
    order = Window.partitionBy("file").orderBy("place")
    start = F.nullif(F.regexp_extract("text", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1), F.lit("")).cast("bigint")
    hunk = F.count(start).over(order.rowsBetween(Window.unboundedPreceding, 0))
    body = lines.withColumn("start", start).withColumn("hunk", hunk)
    counts = (F.col("hunk") > 0) & F.col("start").isNull() & ~F.col("text").startswith("-")
    within = Window.partitionBy("file", "hunk").orderBy("place")
    seen = F.sum(F.when(counts, 1).otherwise(0)).over(within.rowsBetween(Window.unboundedPreceding, 0))
    return body.select("file", "place", "text", F.when(counts, F.first("start", ignorenulls=True).over(within) + seen - 1).alias("number"))

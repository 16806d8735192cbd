"""Analyzer reports: native formats to one findings shape, validation, layers' age, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layers import severity_rank

#: The normalised shape that every adapter returns.
FINDING = ["analyzer", "rule", "severity", "title", "path", "line", "package", "version", "ids"]
_SEMGREP = "results array<struct<check_id:string,path:string,start:struct<line:bigint>,extra:struct<message:string,severity:string>>>"
_ENTRY = "struct<advisory:struct<id:string,title:string,aliases:array<string>,related:array<string>,informational:string>,package:struct<name:string,version:string>>"
_AUDIT = f"vulnerabilities struct<list:array<{_ENTRY}>>, warnings map<string,array<{_ENTRY}>>"
_VULNERABILITY = "struct<id:string,summary:string,aliases:array<string>,database_specific:struct<severity:string>,affected:array<struct<database_specific:struct<informational:string>>>>"
_OSV = f"results array<struct<source:struct<path:string>,packages:array<struct<package:struct<name:string,version:string>,vulnerabilities:array<{_VULNERABILITY}>,groups:array<struct<ids:array<string>,aliases:array<string>>>>>>>"
_CLIPPY = "reason string, message struct<code:struct<code:string>,level:string,message:string,spans:array<struct<file_name:string,line_start:bigint,is_primary:boolean>>>"

# Severity words of each analyzer in the normalised scale; other words stay as they are.
_LEVELS = {
    "semgrep": {"critical": "critical", "error": "high", "high": "high", "warning": "medium", "medium": "medium", "low": "low", "info": "info", "information": "info"},
    "clippy": {"error": "high", "error: internal compiler error": "high", "warning": "medium", "note": "info", "help": "info", "failure-note": "info"},
    "github": {"critical": "critical", "high": "high", "moderate": "medium", "medium": "medium", "low": "low"},
    "rustsec": {"vulnerability": "high", "unsound": "medium", "unmaintained": "low", "yanked": "low", "notice": "info"},
}
#: Fixed value: the rule of a diagnostic without a code.
UNCODED = "rustc"


def level(of: str, word: Column) -> Column:
    """The normalised level of an analyzer's word, else the word itself."""
    out = word
    for name, value in _LEVELS[of].items():
        out = F.when(word == name, value).otherwise(out)
    return out


def _filled(text: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def _first_line(text: Column) -> Column:
    return _filled(F.substring_index(text, "\n", 1))


def _ids(*parts: Column) -> Column:
    """Distinct identifiers of some arrays, in their order."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.transform(F.concat(*[F.coalesce(p, none) for p in parts]), lambda i: F.trim(i)), lambda i: i != ""))


def _shaped(df: DataFrame, analyzer: str, **columns: Column) -> DataFrame:
    kinds = {"line": "bigint", "ids": "array<string>"}
    return df.select(*[(F.lit(analyzer) if c == "analyzer" else columns.get(c, F.lit(None)).cast(kinds.get(c, "string"))).alias(c) for c in FINDING])


def semgrep(reports: DataFrame) -> DataFrame:
    """Findings of semgrep reports in column ``json``; the title is the message's first line, else the check's id."""
    r = reports.select(F.explode(F.from_json("json", _SEMGREP)["results"]).alias("r"))
    title = F.coalesce(_first_line(F.col("r.extra.message")), F.col("r.check_id"))
    return _shaped(r, "semgrep", rule=F.col("r.check_id"), severity=level("semgrep", F.lower("r.extra.severity")), title=title, path=F.col("r.path"), line=F.col("r.start.line"), ids=F.array(F.col("r.check_id")))


def cargo_audit(reports: DataFrame) -> DataFrame:
    """Vulnerabilities, and warnings by their kind; an advisory's own informational kind counts before that of its list."""
    doc = reports.select(F.from_json("json", _AUDIT).alias("d"))
    listed = doc.select(F.lit("vulnerability").alias("kind"), F.explode("d.vulnerabilities.list").alias("v"))
    warned = doc.select(F.explode("d.warnings").alias("kind", "entries")).select("kind", F.explode("entries").alias("v"))
    v = listed.unionByName(warned)
    a, name = F.col("v.advisory"), F.col("v.package.name")
    version = F.coalesce(F.when(_filled(F.col("v.package.version")).isNotNull(), F.col("v.package.version")), F.lit("unknown-version"))
    title = F.coalesce(_filled(a["title"]), F.concat_ws(" ", name, version, F.lit("is"), "kind"))
    rule = F.coalesce(F.when(_filled(a["id"]).isNotNull(), a["id"]), F.col("kind"))
    ids = _ids(F.array(rule), a["aliases"], a["related"])
    return _shaped(v, "cargo-audit", rule=rule, severity=level("rustsec", F.coalesce(a["informational"], "kind")), title=title, path=F.lit("Cargo.lock"), package=name, version=version, ids=ids)


def osv_scanner(reports: DataFrame) -> DataFrame:
    """One finding for each group of identifiers of a package, or for each vulnerability where a package has no groups.

    The least identifier names the group; its severity is the greatest that any of its records publishes, high if none does.
    """
    s = reports.select(F.explode(F.from_json("json", _OSV)["results"]).alias("s"))
    p = s.select(F.col("s.source.path").alias("path"), F.explode("s.packages").alias("p"))
    own = F.transform("p.vulnerabilities", lambda v: F.struct(F.array(v["id"]).alias("ids"), v["aliases"].alias("aliases")))
    groups = F.when(F.coalesce(F.size("p.groups"), F.lit(0)) > 0, F.col("p.groups")).otherwise(own)
    g = p.select("path", "p.package", "p.vulnerabilities", F.explode(groups).alias("g")).withColumn("named", F.array_sort(_ids(F.col("g.ids"))))
    g = g.withColumn("members", F.filter("vulnerabilities", lambda v: F.array_contains("named", F.trim(v["id"])))).withColumn("rule", F.get("named", 0))

    def levels(v):
        told = F.filter(F.transform(v["affected"], lambda x: _filled(x["database_specific"]["informational"])), lambda x: x.isNotNull())
        graded = F.filter(F.array(level("github", F.lower(_filled(v["database_specific"]["severity"])))), lambda x: x.isNotNull())
        return F.concat(graded, F.coalesce(F.transform(told, lambda x: level("rustsec", x)), F.array().cast("array<string>")))

    ranked = F.transform(F.flatten(F.transform("members", levels)), lambda x: F.struct(severity_rank(x).alias("rank"), x.alias("level")))
    # of equal ranks the first published counts
    worst = F.aggregate(ranked, F.struct(F.lit(-1).alias("rank"), F.lit("high").alias("level")), lambda best, x: F.when(x["rank"] > best["rank"], x).otherwise(best))["level"]
    name, version = F.col("package.name"), F.coalesce(_filled(F.col("package.version")), F.lit("unknown-version"))
    summary = F.get(F.filter(F.transform("members", lambda v: _filled(v["summary"])), lambda t: t.isNotNull()), 0)
    title = F.coalesce(summary, F.concat_ws(" ", name, version, F.lit("is affected by"), "rule"))
    own = F.flatten(F.transform("members", lambda v: F.coalesce(v["aliases"], F.array().cast("array<string>"))))
    ids = F.array_sort(_ids(F.col("named"), F.col("g.aliases"), own))
    return _shaped(g, "osv-scanner", rule=F.col("rule"), severity=worst, title=title, path=F.col("path"), package=name, version=version, ids=ids)


def clippy(lines: DataFrame) -> DataFrame:
    """Findings of clippy's JSON lines at their primary span, else their first; messages without a span are left out."""
    m = lines.select(F.from_json("json", _CLIPPY).alias("j")).filter("j.reason = 'compiler-message'")
    at = m.select("j.message", F.coalesce(F.get(F.filter("j.message.spans", lambda s: s["is_primary"]), 0), F.get("j.message.spans", 0)).alias("at")).filter("at is not null")
    rule, title = F.coalesce(_filled(F.col("message.code.code")), F.lit(UNCODED)), F.coalesce(_first_line(F.trim("message.message")), F.col("at.file_name"))
    out = at.withColumn("path", F.regexp_replace("at.file_name", r"^\./", "")).filter(safe_path(F.col("path")))
    return _shaped(out, "clippy", rule=rule, severity=level("clippy", F.lower(F.trim("message.level"))), title=title, path=F.col("path"), line=F.col("at.line_start"), ids=F.array(rule))


ADAPTERS = {"semgrep": semgrep, "cargo-audit": cargo_audit, "osv-scanner": osv_scanner, "clippy": clippy}


def safe_path(path: Column) -> Column:
    """Whether a reported path is relative and stays inside the tree."""
    return ~path.rlike(r"^(/|\\|[A-Za-z]:)|(^|[/\\])\.\.([/\\]|$)")


def faults(findings: DataFrame, ident: str = "id") -> DataFrame:
    """Each finding's first fault, or null: missing fields, unsafe path, an id that occurs twice."""
    twice = findings.groupBy(ident).count().filter("count > 1").select(ident, F.lit(True).alias("twice"))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    fault = F.when(blank("rule"), "rule").when(blank("title"), "title").when(F.col("path").isNotNull() & ~safe_path(F.col("path")), "path").when(F.col("twice"), "duplicate")
    return findings.join(twice, ident, "left").withColumn("fault", fault).drop("twice")


def escaped_key(parts: list[Column]) -> Column:
    """Key parts joined by colons; backslashes and colons inside parts are escaped."""
    return F.concat_ws(":", *[F.replace(F.replace(p, F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:")) for p in parts])


def key_parts(key: Column) -> Column:
    """Parts of an escaped key: a fold over its characters, as an escape may itself be escaped."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(False).alias("esc"))

    def step(s, c):
        plain = F.struct(s["done"].alias("done"), F.concat(s["now"], c).alias("now"), F.lit(False).alias("esc"))
        cut = F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), F.lit("").alias("now"), F.lit(False).alias("esc"))
        escape = F.struct(s["done"].alias("done"), s["now"].alias("now"), F.lit(True).alias("esc"))
        return F.when(s["esc"], plain).when(c == "\\", escape).when(c == ":", cut).otherwise(plain)

    return F.aggregate(F.filter(F.split(key, ""), lambda c: c != ""), start, step, lambda s: F.concat(s["done"], F.array(s["now"])))


def staleness(layers: DataFrame, now: str) -> DataFrame:
    """Age of each layer's advisory data in days; null where its time can't be read."""
    at = F.try_to_timestamp("updated")
    return layers.select("layer", F.datediff(F.lit(now).cast("date"), at.cast("date")).cast("bigint").alias("age_days"))


def coverage(adapters: DataFrame, assets: DataFrame, programs: DataFrame) -> DataFrame:
    """Per adapter: assets of its kind, whether its program is there, and if it is ready."""
    count = assets.groupBy("asset").agg(F.count("*").alias("assets"))
    out = adapters.join(count, "asset", "left").join(programs.select("program", F.lit(True).alias("there")), "program", "left").fillna(0, ["assets"])
    there = F.coalesce("there", F.lit(False))
    return out.select("adapter", "assets", there.alias("there"), ((F.col("assets") > 0) & there).alias("ready"))


#: Findings of a report at most, its schema, and the pattern of an analyzer's id.
MAX_FINDINGS, SCHEMA, ANALYZER = 100_000, "findings-report/v1", r"[a-z0-9._-]{1,64}"
_REPORT = (
    "schema string, analyzer string, analyzer_version string, started_at string, ended_at string, "
    "findings array<struct<rule:string,severity:string,title:string,path:string,span:struct<start:bigint,end:bigint>,identity:array<string>>>"
)


def normalised(reports: DataFrame, ident: str = "report") -> DataFrame:
    """Reports in the normalised shape from JSON in column ``json``: the id and the parsed fields, all null where it can't be read."""
    return reports.select(ident, F.from_json("json", _REPORT).alias("r")).select(ident, "r.*")


def report_faults(reports: DataFrame, requested: str, ident: str = "report") -> DataFrame:
    """Each report's first fault, or null: its schema, its analyzer's id or that another was asked for, empty fields, too many findings."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    fault = F.when(~F.col("schema").eqNullSafe(F.lit(SCHEMA)), "schema").when(~F.coalesce(F.col("analyzer").rlike(rf"^{ANALYZER}\z"), F.lit(False)), "analyzer_id").when(F.col("analyzer") != requested, "analyzer_mismatch")
    for c in ("analyzer_version", "started_at", "ended_at"):
        fault = fault.when(blank(F.col(c)), c)
    return reports.select(ident, fault.when(F.size("findings") > MAX_FINDINGS, "too_many").alias("fault"))


def report_findings(reports: DataFrame, ident: str = "report") -> DataFrame:
    """Findings of normalised reports with their rendered ``key`` and first ``fault``, or null: rule, title, path, span, identity or a key that occurs before in its report."""
    rows = reports.select(ident, "analyzer", F.posexplode("findings").alias("place", "f")).select(ident, "analyzer", "place", "f.*")
    each = F.transform("identity", lambda p: F.replace(F.replace(p, F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:")))
    key = F.concat(F.lit("finding:"), "analyzer", F.lit(":"), F.array_join(each, ":"))
    first = F.min("place").over(Window.partitionBy(ident, "key"))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    unnamed = (F.coalesce(F.size("identity"), F.lit(0)) <= 0) | F.exists("identity", lambda p: F.trim(p) == "")
    fault = (
        F.when(blank("rule"), "rule").when(blank("title"), "title").when(F.col("path").isNotNull() & ~safe_path(F.col("path")), "path").when(F.col("span.end") < F.col("span.start"), "span")
        .when(unnamed, "identity").when(F.col("place") > first, "duplicate")
    )
    return rows.withColumn("key", key).withColumn("fault", fault)

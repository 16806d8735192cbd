"""Queries over rules whose results are told by hand: each row of a table gets one of some cases, and the SQL joins what the rules say of it."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .functions import text
from .operators import checks, context, extract, imports, lenses, links, sync
from .queries import _search_sql, _searchable, query
from .sources.graph import edges, nodes, places, read

col, lit = F.col, F.lit


def _quoted(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool | int | float):
        return str(v).lower()
    return "'" + v.replace("'", "''") + "'"


def _cases(spark, sf, texts: list[str], column: str = "content"):
    """Documents with one of some texts each, by their id; ``%`` in a text is the id."""
    own = F.get(F.array(*[lit(t) for t in texts]), (col("doc_id") % len(texts)).cast("int"))
    d = read(spark, sf, "documents").filter("doc_id is not null")
    return d.select("doc_id", F.replace(own, lit("%"), col("doc_id").cast("string")).alias(column))


def _says(cases: int, columns: str, rows: list[tuple], select: str) -> str:
    """SQL over what is told of each case; ``n`` is the case of a document."""
    values = ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows)
    return f"with t(n, {columns}) as (values {values}), d as (select doc_id, doc_id % {cases} as n from documents where doc_id is not null) select {select} from d join t using (n)"


# ---- markers, headings, annotations

_MARKED = ["\tTODO tabbed\t\nplain", "   FIXME x ", "nothing", "a\r\n\t- [ ] open item \r\n\x0bTBD\x0c", "HACK " + "y" * 250]
_MARKED_SAYS = [(0, 1, "todo", "TODO tabbed"), (1, 1, "fixme", "FIXME x"), (3, 2, "deferred", "- [ ] open item"), (3, 3, "deferred", "TBD"), (4, 1, "hack", "HACK " + "y" * 195 + "…")]


@query(_says(5, "line, category, text", _MARKED_SAYS, "concat('n/', doc_id, '.txt') as path, cast(line as bigint) as line, category, text"))
def marker_texts(spark, sf):
    f = _cases(spark, sf, _MARKED)
    return lenses.markers(f.select(F.concat(lit("n/"), col("doc_id").cast("string"), lit(".txt")).alias("path"), "content")).select("path", "line", "category", "text")


_OUTLINES = [
    "# One\n```\n# not a heading\n```\n### Deep\n## Two\n### Three",
    "```sh\n# never closed\n# so none",
    "## Low\n# Top\n  ```\n## no\n  ```\n###### Six\n####### seven\n#none\n##\ttab",
    "#  Spaced  \r\n## Next\r\n",
]
_OUTLINES_SAY = [
    (0, 0, 1, "One", "one", None), (0, 4, 3, "Deep", "deep", "One"), (0, 5, 2, "Two", "two", "One"), (0, 6, 3, "Three", "three", "Two"),
    (2, 0, 2, "Low", "low", None), (2, 1, 1, "Top", "top", None), (2, 5, 6, "Six", "six", "Top"), (3, 0, 1, "Spaced", "spaced", None), (3, 1, 2, "Next", "next", "Spaced"),
]


@query(_says(4, "place, level, title, slug, parent", _OUTLINES_SAY, "cast(doc_id as varchar) as path, cast(place as int) as place, cast(level as int) as level, title, slug, parent"))
def heading_outline(spark, sf):
    return extract.headings(_cases(spark, sf, _OUTLINES).select(col("doc_id").cast("string").alias("path"), "content"))


_NOTES = ["// ``see @ref:no`` and @ref:a-1", "x = 1  # @ref:no", "<!-- @ref:b_2 @ref:c --> `@ref:no`", "  ; @ref:d.e\n-- @ref:f\n* ```@ref:no``` @ref:g `unclosed @ref:h", "@ref:no"]
_NOTES_SAY = [(0, "a-1"), (2, "b_2"), (2, "c"), (3, "d"), (3, "f"), (3, "g"), (3, "h")]


@query(_says(5, "id", _NOTES_SAY, "cast(doc_id as varchar) as path, id"))
def annotation_spans(spark, sf):
    return extract.annotations(_cases(spark, sf, _NOTES).select(col("doc_id").cast("string").alias("path"), "content"))


# ---- sections of notes and their links

_SECTIONS = [
    "intro [[n%#Alpha]]\n# Alpha\n[[src/a.rs#run]] and `[[no]]`\n```\n[[no]]\n# no\n```\n### Deep part\n[[n%]] [[src/Makefile]]",
    "no heading [[N%.MD#x#Deep Part]] [[gone#y]] [[a.toml]]",
    "# Same\n# same!\n[[#x]] [[lib.rs]]",
]
_SECTION_NODES = [(0, "", "doc", "Alpha"), (0, "#alpha", "lat_section", "Alpha"), (0, "#deep-part", "lat_section", "Deep part"), (1, "", "doc", "n%"), (2, "", "doc", "Same"), (2, "#same", "lat_section", "same!")]
_SECTION_EDGES = [
    (0, "", "lat:notes/n%.md#alpha", "references"), (0, "", "lat:notes/n%.md#alpha", "contains"), (0, "#alpha", "sym:rust:src/a.rs#run", "references"), (0, "#alpha", "lat:notes/n%.md#deep-part", "contains"),
    (0, "#deep-part", "lat:notes/n%.md", "references"), (0, "#deep-part", "file:src/Makefile", "references"),
    (1, "", "lat:notes/n%.md#deep-part", "references"), (1, "", "sym:text:gone#y", "references"), (1, "", "file:a.toml", "references"), (2, "", "lat:notes/n%.md#same", "contains"), (2, "#same", "file:lib.rs", "references"),
]


def _sections(spark, sf):
    f = _cases(spark, sf, _SECTIONS)
    return extract.sections(f.select(F.concat(lit("notes/n"), col("doc_id").cast("string"), lit(".md")).alias("path"), "content"))


@query(_says(3, "more, kind, name", _SECTION_NODES, "concat('lat:notes/n', doc_id, '.md', more) as key, kind, replace(name, '%', doc_id::varchar) as name, concat('notes/n', doc_id, '.md') as path, 'authored' as provenance"))
def section_nodes(spark, sf):
    return _sections(spark, sf)[0]


@query(_says(3, "more, dst, kind", _SECTION_EDGES, "concat('lat:notes/n', doc_id, '.md', more) as src, replace(dst, '%', doc_id::varchar) as dst, kind, 'authored' as provenance"))
def section_edges(spark, sf):
    return _sections(spark, sf)[1]


# ---- checks of sources, replies and scores

_RUST = [
    "// why\n#[derive(Debug)]\n#[allow(x)]\nstruct S;\n#![allow(y)]",
    'let s = "// no";\n    #[allow(a[0])] // told\n#[allow(b)] x = "//"; ]\n  #[allow(c)]\nfn f() { #[allow(d)] }',
    "// prose\n\n#[allow(x)]\n/// doc\n#[allow(y)]",
    "#[allow(x)]\n// lineagelake:ignore-file",
]
_RUST_SAY = [(0, 5), (1, 3), (1, 4), (2, 3)]


@query(_says(8, "line", _RUST_SAY, "concat('s/', doc_id, '.RS') as path, cast(line as int) as line"))
def bare_allows(spark, sf):
    f = _cases(spark, sf, _RUST + _RUST)
    ending = F.when(col("doc_id") % 8 < 4, ".RS").otherwise(".txt")
    lines = f.select(F.concat(lit("s/"), col("doc_id").cast("string"), ending).alias("path"), F.posexplode(F.split("content", "\n")).alias("place", "text"))
    return imports.unjustified_allows(lines.select("path", (col("place") + 1).alias("line"), "text"))


_REPLIES = [
    "Let me see.\n- **FINDING | line=42 | class=**contract-drift** | compile=No | drops **all** rows | at a = b**\nfinding|LINE=7|bare",
    "**NO FINDINGS**\n",
    "FINDING | line=0 | zero\n> FINDING | class=nope | line=x1 | no number\nFINDING: line 3 in prose",
    "<think>FINDING | line=1",
    "`FINDING | line=+9 | compile=YES | class=Vacuous-Test`\nFINDING | line=3 | line=5 | | x | | y",
    "",
]
_REPLIES_SAY = [
    (0, 42, "contract-drift", False, "drops **all** rows | at a = b"), (0, 7, None, False, "bare"), (4, 9, "vacuous-test", True, "(no description given)"), (4, 5, None, False, "x |  | y"),
]


@query(_says(6, "line, class, compile, description", _REPLIES_SAY, "doc_id as id, cast(line as bigint) as line, class, compile, description"))
def model_replies(spark, sf):
    return imports.reply_findings(_cases(spark, sf, _REPLIES, "reply").withColumnRenamed("doc_id", "id"))


@query(_says(6, "findings, unparsed, clean, cut_off", [(0, 2, 0, False, False), (1, 0, 0, True, False), (2, 0, 3, False, False), (3, 0, 0, False, True), (4, 2, 0, False, False), (5, 0, 0, False, False)], "doc_id as id, cast(findings as bigint) as findings, cast(unparsed as bigint) as unparsed, clean, cut_off"))
def model_reply_verdicts(spark, sf):
    return imports.reply_verdicts(_cases(spark, sf, _REPLIES, "reply").withColumnRenamed("doc_id", "id"))


@query("""select p_partkey, array_to_string(list_filter([case when p_size % 3 < 2 then concat('partial run: ', p_size % 3, ' of 2 commits') end, case when p_size % 2 = 1 then concat(p_size % 2, ' classes have one row') end,
  case when p_size <= p_partkey % 50 or p_size - p_partkey % 50 <= p_partkey % 50 then 'recall is not clearly above chance' end, case when p_size % 5 > 0 then concat(p_size % 5, ' findings are unadjudicated') end,
  case when p_size % 7 > 0 then concat(p_size % 7, ' real rows were suppressed') end], lambda x: x is not null), '; ') as caveats from part""")
def review_caveats(spark, sf):
    size = col("p_size")
    p = read(spark, sf, "part").select("p_partkey", (size % 3).alias("attempted"), lit(2).alias("corpus"), (size % 2).alias("singletons"), size.alias("found"), (col("p_partkey") % 50).cast("double").alias("chance"), (size % 5).alias("unadjudicated"), (size % 7).alias("suppressed_real"))
    return imports.caveats(p).select("p_partkey", F.array_join("caveats", "; ").alias("caveats"))


# ---- overrides

# a key's matches in order: spoke, value, measured, unknown, file; and the cells and row they make where the hub's value is 'h'
_MATCHES = [
    [("a", "h", None, False, "x.toml"), ("a", "o", None, False, "x.toml"), ("b", "h", None, False, "")],
    [("a", "o", "o", False, "x.toml"), ("b", "o", None, True, "y.toml"), ("b", "p", None, False, "x.toml")],
    [("a", "o", "m", False, ""), ("a", "q", None, False, "")],
    [("a", "o", None, False, "z.toml")],
]
_CELLS = [
    (0, "a", "o", True, None, False), (0, "b", "h", False, None, False), (1, "a", "o", False, "o", False), (1, "b", "p", True, None, False), (2, "a", "o", True, "m", False), (3, "a", "o", False, None, True),
]


def _overrides(spark, sf):
    """Hub keys, every fourth of unknown value, and what spokes set."""
    p = read(spark, sf, "part")
    case = (col("p_partkey") % 4).cast("int")
    hub = p.select(F.concat(lit("k"), col("p_partkey").cast("string")).alias("key"), F.when(case != 3, "h").alias("value"))
    rows = [(n, i, *m) for n, ms in enumerate(_MATCHES) for i, m in enumerate(ms)]
    told = F.broadcast(spark.createDataFrame(rows, "case int, seq int, spoke string, value string, measured string, unknown boolean, file string"))
    return hub, p.select(F.concat(lit("k"), col("p_partkey").cast("string")).alias("key"), case.alias("case")).join(told, "case").drop("case")


def _of_parts(columns: str, rows: list[tuple], select: str) -> str:
    return _says(4, columns, rows, select).replace("select doc_id, doc_id % 4 as n from documents where doc_id is not null", "select p_partkey, p_partkey % 4 as n from part")


@query(_of_parts("spoke, value, differs, baseline, baseline_unknown", _CELLS, "concat('k', p_partkey) as key, spoke, value, differs, baseline, baseline_unknown"))
def override_cells(spark, sf):
    return links.override_cells(*_overrides(spark, sf)).drop("spoke_key", "confidence", "provenance")


@query(_of_parts("hub_value, file, overrides", [(0, "h", "x.toml", 3), (1, "h", "", 3), (2, "h", "", 2), (3, "", "z.toml", 1)], "concat('k', p_partkey) as key, hub_value, file, cast(overrides as bigint) as overrides"))
def override_rows(spark, sf):
    return links.override_rows(*_overrides(spark, sf))


# ---- imported graphs

_GRAPHS = [
    json.dumps({
        "nodes": [{"id": "a%", "label": "A", "file_type": "concept", "source_file": "d/a.md"}, {"id": "b%", "file_type": "document"}, {"id": "c%", "label": "C", "file_type": "code"}],
        "links": [
            {"source": "a%", "target": "b%", "relation": "conceptually_related_to", "confidence_score": 0.82}, {"source": "c%", "target": "b%", "_origin": "ast"}, {"source": "a%", "target": "c%", "relation": "references"},
            {"source": "b%", "target": "a%", "relation": "rationale_for", "confidence": "inferred", "confidence_score": 7, "_origin": "ast"}, {"source": "b%", "target": "group:h%"},
        ],
        "hyperedges": [{"id": "h%", "label": "H", "nodes": ["a%", "b%", "c%"], "confidence_score": 0.9}, {"id": "e%", "nodes": ["c%"]}],
    }),
    json.dumps({"nodes": [{"id": "z%", "label": "first", "file_type": "image"}, {"id": "z%", "label": "last"}], "links": [{"source": "z%", "target": "z%", "relation": "cites"}]}),
    "no json",
]
_GRAPH_NODES = [(0, "a%", "concept", "A", "d/a.md"), (0, "b%", "doc", "b%", None), (0, "group:h%", "group", "H", None), (1, "z%", "doc", "last", None)]
_GRAPH_EDGES = [(0, "a%", "b%", "related", 0.82), (0, "b%", "a%", "references", 1.0), (0, "group:h%", "a%", "related", 0.9), (0, "group:h%", "b%", "related", 0.9), (1, "z%", "z%", "cites", 0.5)]
_KEY = "concat('import:', replace({0}, '%', doc_id::varchar))"


def _graphs(spark, sf):
    return imports.node_link(_cases(spark, sf, _GRAPHS, "json").select("json"))


@query(_says(3, "id, kind, name, path", _GRAPH_NODES, _KEY.format("id") + " as key, kind, replace(name, '%', doc_id::varchar) as name, path, 'inferred' as provenance"))
def imported_nodes(spark, sf):
    return _graphs(spark, sf)[0]


@query(_says(3, "a, b, kind, confidence", _GRAPH_EDGES, f"{_KEY.format('a')} as src, {_KEY.format('b')} as dst, kind, cast(confidence as double) as confidence, 'inferred' as provenance, 'import:import' as src_ref"))
def imported_edges(spark, sf):
    return _graphs(spark, sf)[1]


@query("""with c as (select count(*) filter (where doc_id % 3 = 0) as x, count(*) filter (where doc_id % 3 = 1) as y from documents), l as (select unnest(['nodes', 'links', 'hyperedges', 'code_nodes', 'ast_links', 'nodes_kept', 'edges_kept', 'dangling', 'groups_kept']) as what,
  unnest([3 * x + 2 * y, 5 * x + y, 2 * x, x, x, 2 * x + 2 * y, 2 * x + y, 2 * x, x]) as n from c) select what, cast(n as bigint) as n from l""")
def import_report(spark, sf):
    return spark.createDataFrame(list(_graphs(spark, sf)[2].items()), "what string, n bigint")


# ---- topics

_TOP = "with g as ({0}), best as (select key, score from g order by score desc, key limit 30), x as (select key from best where key like '{1}:%' order by score desc, key limit 10)"


@query(_TOP.format(_search_sql("widget"), "part") + " select key, 'calls' as relation, dst as other from edges join x on src = key where kind = 'calls' union select key, 'called_by', src from edges join x on dst = key where kind = 'calls' union select key, 'authored_by', src from edges join x on dst = key where provenance = 'authored'")
def topic_edges(spark, sf):
    e = edges(spark, sf)
    return context.topic_edges(context.topic(_searchable(spark, sf), e, "widget", ("part",), 10), e)


@query(_TOP.format(_search_sql("urgent"), "order") + ", y as (select key from (" + _search_sql("txt") + ") where key like 'file:%' order by score desc, key limit 10) select distinct src as key from edges join x on dst = key where provenance = 'authored' union select key from y")
def topic_records(spark, sf):
    """Records of a topic of orders, with files as its records."""
    e, n = edges(spark, sf), _searchable(spark, sf)
    return context.topic_records(context.topic(n, e, "urgent", ("order",), 10), context.topic_documents(n, "txt", ("file",), 10).withColumn("kind", lit("adr")), e)


# ---- dates and reviews

_DATES = ["2025-08-15T09:00:00Z", "2025-08-15", "1970-01-01 00:00:01", "2024-02-30", "2024-13-01", "2025-8-15", "2025-08-15T24:00:00Z", "2025-08-15Tx", "1969-12-31T23:59:59Z", "2025-08-15T11:00:00.5+02:00"]
_DATES_SAY = [(0, 1755248400, "2025-08-15T09:00:00Z"), (1, 1755216000, "2025-08-15T00:00:00Z"), (2, 1, "1970-01-01T00:00:01Z"), (3, 1709251200, "2024-03-01T00:00:00Z"), (4, None, None), (5, None, None), (6, None, None), (7, None, None), (8, -1, "1970-01-01T00:00:00Z"), (9, 1755248400, "2025-08-15T09:00:00Z")]


@query(_says(10, "seconds, again", _DATES_SAY, "doc_id, cast(seconds as varchar) as seconds, again, cast(cast(trunc((1755248400 - seconds) / 86400) as bigint) as varchar) as age"))
def date_texts(spark, sf):
    d = _cases(spark, sf, _DATES, "date")
    at = text.unix_seconds(col("date"))
    return d.select("doc_id", at.cast("string").alias("seconds"), text.rfc3339(at).alias("again"), text.age_in_days(col("date"), lit("2025-08-15T09:00:00Z")).cast("string").alias("age"))


@query("""with ch as (select concat(r_name, '/', n_name, '/supplier') as path, case when n_nationkey % 4 = 0 then 'deleted' else 'modified' end as status from nation join region on n_regionkey = r_regionkey where n_nationkey % 2 = 0),
  own as (select key, path, status from nodes join ch using (path)), e as (select own.*, e.other, e.kind, e.provenance, e.confidence, e.direction from own join ends e on own.key = e.key where status <> 'deleted')
  select path, status, key, 'caller' as relation, other, cast(null as double) as confidence from e where direction = 'in' and kind = 'calls' union all select path, status, key, 'callee', other, null from e where direction = 'out' and kind = 'calls'
  union all select path, status, key, 'governed_by', other, null from e where direction = 'in' and provenance = 'authored' union all select path, status, key, 'related', other, confidence from e where kind = 'related'
  union all select path, status, key, 'symbol', null, null from own where status <> 'deleted' union all select path, status, null, 'deleted', null, null from ch where status = 'deleted'
  union all select path, status, null, 'marker', concat('TODO ', n_name), null from ch join nation on path like concat('%/', n_name, '/supplier') where status <> 'deleted' and n_nationkey % 3 = 0""")
def review_items(spark, sf):
    p = places(spark, sf).select("n_nationkey", "n_name", F.concat_ws("/", "r_name", "n_name", lit("supplier")).alias("path"))
    changes = p.filter("n_nationkey % 2 = 0").select("path", F.when(col("n_nationkey") % 4 == 0, "deleted").otherwise("modified").alias("status"))
    sources = p.filter("n_nationkey % 3 = 0").select("path", F.concat(lit("x\n  TODO "), "n_name", lit("\t")).alias("content"))
    return sync.review_items(changes, nodes(spark, sf), edges(spark, sf), lenses.markers(sources))


# ---- markers as nodes

# symbols of each text of _MARKED by bytes, and where its markers lie: line, name, start, end, container
_SPANS = [(0, "s:a", 0, 20), (0, "s:b", 1, 13), (0, "s:c", 1, 13), (1, "s:d", 0, 1), (3, "s:e", 4, 40), (3, "s:f", 22, 30)]
_MARKER_FACTS = [
    (0, 1, "TODO tabbed", 0, 13, "s:b"), (1, 1, "FIXME x", 0, 14, None), (3, 2, "- [ ] open item", 3, 21, "s:e"), (3, 3, "TBD", 22, 27, "s:f"), (4, 1, "HACK " + "y" * 75 + "…", 0, 255, None),
]


def _marker_facts(spark, sf):
    f = _cases(spark, sf, _MARKED).select("doc_id", F.concat(lit("n/"), col("doc_id").cast("string"), lit(".txt")).alias("path"), "content")
    spans = F.broadcast(spark.createDataFrame(_SPANS, "n int, key string, start bigint, end bigint"))  # the cases above
    symbols = f.join(spans, col("doc_id") % 5 == col("n")).select("path", "key", "start", "end")
    return checks.marker_facts(f, lenses.markers(f), symbols)


_MARKER_KEY = "concat('marker:n/', doc_id, '.txt#', line)"


@query(_says(5, "line, name, s, e, container", _MARKER_FACTS, f"{_MARKER_KEY} as key, name, cast(s as bigint) as \"start\", cast(e as bigint) as \"end\""))
def marker_nodes(spark, sf):
    return _marker_facts(spark, sf)[0].select("key", "name", "start", "end")


@query(_says(5, "line, name, s, e, container", _MARKER_FACTS, f"coalesce(container, concat('file:n/', doc_id, '.txt')) as src, {_MARKER_KEY} as dst"))
def marker_edges(spark, sf):
    return _marker_facts(spark, sf)[1].select("src", "dst")

"""Further registered queries: fact sets, imports, memory writes, media plans, scores, versions, reports and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text
from .operators import checks, context, extract, layers, lenses, links, media, memory, reports, review, sync
from .queries import SQL, _CACHE, _FINDINGS, _MEMORY, _REVIEW, _anchors, _findings, _log, _memory, _review, _search_sql, _searchable, query
from .sources import graph
from .sources.graph import edges, nodes, read

col, lit = F.col, F.lit


def _text(column: str):
    return F.col(column).cast("string")


def _one_of(values, index):
    return F.get(F.array(*[lit(v) for v in values]), index.cast("int"))


# ---- paths and scalars

_PATHS = ("src/a.TOML", ".github/x.yml", "./.github/a.json", "x/.env", ".env.local", "a.env", "env", ".cargo/config", "v/.cargo/config.toml", ".cargo/app.toml", "sub/Cargo.toml", ".config/n.toml", "r/readme.MD", "n.rst", "s/a.Flac", "i.jpeg", "i.gif", ".md", "deny.toml", "x/.gitlab-ci.yml", "a.b/c", "pic.png.txt")
_IS_CONFIG = (1, 0, 1, 1, 1, 1, 0, 0, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 1, 1, 0, 0)
_IS_TOOLING = (0, 1, 1, 0, 0, 0, 0, 1, 1, 0, 1, 1, 0, 0, 0, 0, 0, 0, 1, 1, 0, 0)
_KIND = (None,) * 12 + ("prose", "prose", "audio", "image") + (None,) * 5 + ("prose",)


def _told(values) -> str:
    return "[" + ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


@query(f"select doc_id, {_told(_PATHS)}[doc_id % {len(_PATHS)} + 1] as path, {_told(_IS_CONFIG)}[doc_id % {len(_PATHS)} + 1] = 1 as config, {_told(_IS_TOOLING)}[doc_id % {len(_PATHS)} + 1] = 1 as tooling, {_told(_KIND)}[doc_id % {len(_PATHS)} + 1] as kind from documents")
def path_kinds(spark, sf):
    p = read(spark, sf, "documents").select("doc_id", _one_of(_PATHS, col("doc_id") % len(_PATHS)).alias("path"))
    path = col("path")
    return p.select("doc_id", "path", text.config_path(path).alias("config"), text.tooling_path(path).alias("tooling"), text.path_kind(path).alias("kind"))


@query("""select doc_id, cast(octet_length(encode(text)) // 4 as bigint) as tokens, trim(substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 1500)) as content, substring(sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), 1, 16) as snippet,
  concat(octet_length(encode(lang)), ':', lang, octet_length(encode(source)), ':', source) as canonical from documents""")
def text_scalars(spark, sf):
    t = col("text")
    return read(spark, sf, "documents").select("doc_id", text.token_estimate(t).alias("tokens"), text.captured(t).alias("content"), text.snippet_hash(t).alias("snippet"), text.canonical_parts([col("lang"), col("source")]).alias("canonical"))


@query("""select p_partkey, case p_size % 5 when 0 then concat(p_name, '|', p_type) when 1 then concat('x [[', p_name, '|y') when 2 then '' when 3 then p_name else '' end as links from part""")
def wiki_links(spark, sf):
    p = read(spark, sf, "part")
    n, name = col("p_size") % 5, col("p_name")
    line = (
        F.when(n == 0, F.concat(lit("see [["), name, lit("]] and `[[no]]` ``[[n`o]]`` [[ "), "p_type", lit(" ]]"))).when(n == 1, F.concat(lit("[[x [["), name, lit("|y]] [[ ]]")))
        .when(n == 2, F.concat(lit("[["), name)).when(n == 3, F.concat(lit("``odd` [["), name, lit("]]"))).otherwise(lit("none"))
    )
    return p.select("p_partkey", F.array_join(text.wiki_links(line), "|").alias("links"))


@query("select event_id, regexp_extract(props, '-?[0-9]+') as k, 'none' as other from events")
def json_fields(spark, sf):
    return read(spark, sf, "events").select("event_id", text.json_field(col("props"), ["$.missing", "$.k"]).alias("k"), F.coalesce(text.json_field(col("props"), ["$.x", "$.y"]), lit("none")).alias("other"))


# ---- facts and imports

_FACTS = """with n as (select key, name, provenance from nodes where kind in ('part', 'supplier')), f as (select concat('part:', p_partkey) as key, concat('new ', p_name) as name, 'derived' as provenance from part where p_partkey % 3 = 0 union all select concat('part:x', s_suppkey), s_name, 'authored' from supplier) """


def _facts(spark, sf):
    n = nodes(spark, sf, ("part", "supplier"))
    p, s = read(spark, sf, "part"), read(spark, sf, "supplier")
    blank = lambda key, name, provenance, seq, ident: [key.alias("key"), lit("part").alias("kind"), name.alias("name"), *[lit(None).cast("string").alias(c) for c in ("path", "lang", "blob_hash")], lit(provenance).alias("provenance"), (ident * 2 + seq).alias("seq")]
    key = graph.keyed("part", "p_partkey")
    some = p.filter("p_partkey % 3 = 0")
    facts = graph.union(
        some.select(*blank(key, lit("old"), "authored", 0, col("p_partkey"))), some.select(*blank(key, F.concat(lit("new "), "p_name"), "derived", 1, col("p_partkey"))),
        s.select(*blank(F.concat(lit("part:x"), _text("s_suppkey")), col("s_name"), "authored", 0, col("s_suppkey"))),
    )
    return n, facts


@query(_FACTS + "select * from n where key not in (select key from f) union all select * from f")
def applied_nodes(spark, sf):
    n, facts = _facts(spark, sf)
    none = edges(spark, sf, ("related",)).filter("false")
    return layers.apply_facts(n, none, facts, none.withColumn("seq", lit(0)))[0].select("key", "name", "provenance")


@query("""with e as (select src, dst, kind, provenance from edges where kind = 'calls' and src like 'part:%'), f as (select distinct concat('part:', p_partkey) as src, concat('supplier:', p_size % 10 + 1) as dst, 'calls' as kind, 'derived' as provenance from part)
  select * from e union select * from f""")
def applied_edges(spark, sf):
    n, facts = _facts(spark, sf)
    e = edges(spark, sf, ("calls",)).filter("src like 'part:%'")
    p = read(spark, sf, "part")
    new = p.select(graph.keyed("part", "p_partkey").alias("src"), F.concat(lit("supplier:"), (col("p_size") % 10 + 1).cast("string")).alias("dst"), lit("calls").alias("kind"), lit("derived").alias("provenance"), F.when(col("p_size") < 0, 0.5).alias("confidence"), lit(None).cast("string").alias("src_ref"), col("p_partkey").alias("seq"))
    return layers.apply_facts(n, e, facts, new)[1].select("src", "dst", "kind", "provenance")


_IMPORTS = """with ln as (select concat('concept:', s_suppkey % 50) as key, concat('c', s_suppkey) as name, case when s_suppkey % 2 = 0 then 'derived' else 'inferred' end as provenance, concat('import:', s_suppkey % 3, '/', lpad(cast(s_suppkey as varchar), 6, '0')) as src_ref from supplier),
  le as (select concat('concept:', s_suppkey % 60) as src, concat('nation:', s_nationkey + s_suppkey % 4 * 10) as dst from supplier), best as (select key, name, case when provenance = 'derived' then 'authored' else provenance end as provenance from ln qualify row_number() over (partition by key order by src_ref desc) = 1),
  k as (select key from nodes where kind = 'nation' union all select key from best) """


def _imports(spark, sf):
    s = read(spark, sf, "supplier")
    i = col("s_suppkey")
    ref = F.concat(lit("import:"), (i % 3).cast("string"), lit("/"), F.lpad(i.cast("string"), 6, "0"))
    none = lambda *names: [lit(None).cast("string").alias(c) for c in names]
    ln = s.select(F.concat(lit("concept:"), (i % 50).cast("string")).alias("key"), lit("concept").alias("kind"), F.concat(lit("c"), i.cast("string")).alias("name"), *none("path", "lang", "blob_hash"), F.when(i % 2 == 0, "derived").otherwise("inferred").alias("provenance"), ref.alias("src_ref"))
    le = s.select(F.concat(lit("concept:"), (i % 60).cast("string")).alias("src"), F.concat(lit("nation:"), (col("s_nationkey") + i % 4 * 10).cast("string")).alias("dst"), lit("related").alias("kind"), lit("authored").alias("provenance"), lit(None).cast("double").alias("confidence"), ref.alias("src_ref"))
    return layers.reapply_imports(nodes(spark, sf, ("nation",)), edges(spark, sf, ("related",)), ln, le)


@query(_IMPORTS + "select key, name, provenance from best")
def reapplied_nodes(spark, sf):
    return _imports(spark, sf)[0].filter("kind = 'concept'").select("key", "name", "provenance")


@query(_IMPORTS + ", a as (select count(*) as applied from le where src in (select key from k) and dst in (select key from k)) select (select count(distinct src_ref) from ln) as layers, (select count(*) from ln) as nodes, applied, (select count(*) from le) - applied as pruned from a")
def reapplied_counts(spark, sf):
    return _imports(spark, sf)[2]


@query("""with f as (select case when p_size % 3 = 0 then 'audit' else 'osv' end as analyzer, p_brand, case when p_size % 3 = 0 then concat('RUSTSEC-', p_size % 7) else p_type end as rule from part)
  select p_brand, count(distinct analyzer) as confirmed_by, array_to_string(list_sort(list_distinct(list(rule))), '|') as aliases, coalesce(min(rule) filter (where starts_with(rule, 'RUSTSEC-')), min(rule)) as canonical from f group by p_brand""")
def across_analyzers(spark, sf):
    p = read(spark, sf, "part")
    audit = col("p_size") % 3 == 0
    f = p.select(F.when(audit, "audit").otherwise("osv").alias("analyzer"), "p_brand", F.when(audit, F.concat(lit("RUSTSEC-"), (col("p_size") % 7).cast("string"))).otherwise(col("p_type")).alias("rule"))
    return layers.across_analyzers(f, ["p_brand"]).withColumn("aliases", F.array_join("aliases", "|"))


@query("""select 'node' as what, kind, count(*) as n from nodes group by kind union all select 'edge', kind, count(*) from edges group by kind union all select 'finding', severity, count(*) from (select ['info', 'low', 'medium', 'high', 'critical'][doc_id % 5 + 1] as severity from labels) group by severity
  union all select 'memory', event_type, count(*) from events group by event_type""")
def all_counts(spark, sf):
    return lenses.counted({"node": (nodes(spark, sf), "kind"), "edge": (edges(spark, sf), "kind"), "finding": (_findings(spark, sf), "severity"), "memory": (_memory(spark, sf), "kind")})


# ---- memory

_WRITES = """with m as (select event_id as id, case when event_id % 9 = 0 then event_id - 1 end as superseded_by from events),
  w as (select 10000000 + o_orderkey as id, case when o_orderkey % 7 = 0 then ' s' else 'scope' end as scope, case when o_orderkey % 11 = 0 then ' ' else o_orderpriority end as body, case when o_orderkey % 13 = 0 then 1.5 else 0.5 end as confidence, case when o_orderkey % 3 > 0 then o_custkey * 5 end as supersedes from orders),
  v as (select w.*, case when scope = ' s' then 'scope' when body = ' ' then 'body' when confidence > 1 then 'confidence' end as own, m.id as there, m.superseded_by as taken from w left join m on w.supersedes = m.id),
  f as (select *, min(case when own is null then id end) over (partition by supersedes) as first from v),
  t as (select *, coalesce(own, case when supersedes is null then null when there is null then 'not_found' when taken is not null or first <> id then 'superseded' end) as fault from f) """


def _recorded(spark, sf):
    m = _memory(spark, sf).select("id", col("scope").cast("string").alias("scope"), "kind", "anchor_key", "anchor_blob", lit(None).cast("string").alias("anchor_path"), lit("b").alias("body"), "confidence", lit(None).cast("string").alias("tree"), "superseded_by")
    o = read(spark, sf, "orders")
    i = col("o_orderkey")
    w = o.select((i + 10_000_000).alias("id"), F.when(i % 7 == 0, " s").otherwise("scope").alias("scope"), lit("note").alias("kind"), F.concat(lit("part:"), (i % 300).cast("string")).alias("anchor_key"), F.when(i % 11 == 0, " ").otherwise(col("o_orderpriority")).alias("body"), F.when(i % 13 == 0, 1.5).otherwise(0.5).alias("confidence"), F.when(i % 3 > 0, col("o_custkey") * 5).alias("supersedes"))
    return memory.recorded(m, w, nodes(spark, sf, ("part",)), "tree1")


@query(_WRITES + "select id, fault from t")
def memory_write_faults(spark, sf):
    return _recorded(spark, sf)[1].select("id", "fault")


@query(_WRITES + """, g as (select * from t where fault is null) select m.id, coalesce(m.superseded_by, g.id) as superseded_by, cast(null as varchar) as anchor_path from m left join g on g.supersedes = m.id
  union all select g.id, null, p.path from g left join nodes p on p.kind = 'part' and p.key = concat('part:', (g.id - 10000000) % 300)""")
def memory_recorded(spark, sf):
    return _recorded(spark, sf)[0].select("id", "superseded_by", "anchor_path")


@query(_MEMORY + "select id as key, state, state in ('unanchored', 'valid') as applies from r")
def cached_states(spark, sf):
    c = _memory(spark, sf).select(col("id").alias("key"), "anchor_key", "anchor_blob")
    return memory.cached(c, _anchors(spark, sf)).select("key", "state", "applies")


# ---- media

_TREE = """with t as (select concat('a/', doc_id, case doc_id % 4 when 0 then '.wav' when 1 then '.PNG' when 2 then '.txt' else '.jpeg' end) as path, md5(cast(doc_id // 3 as varchar)) as blob, length(text) as bytes, doc_id % 4 as k from documents),
  b as (select case when k = 0 then 'audio' else 'image' end as kind, blob, min(path) as path from t where k <> 2 and coalesce(bytes, 0) <= case when k = 0 then 3000 else 2000 end group by 1, 2) """


def _blobs(spark, sf):
    i = col("doc_id")
    tree = read(spark, sf, "documents").select(F.concat(lit("a/"), i.cast("string"), _one_of((".wav", ".PNG", ".txt", ".jpeg"), i % 4)).alias("path"), F.md5(F.floor(i / 3).cast("string")).alias("blob"), F.coalesce(F.char_length("text"), lit(0)).alias("bytes"))
    return media.blobs(tree, {"audio": 3000, "image": 2000})


@query(_TREE + "select kind, blob, path from b")
def media_blobs(spark, sf):
    return _blobs(spark, sf)


@query(_TREE + """, s as (select *, case when substring(blob, 1, 1) < '4' then 0.00001 when substring(blob, 1, 1) < 'c' then 0.5 end as level from b)
  select kind, blob, case when substring(blob, 2, 1) < '6' then 'existing' when level <= 0.0001 and kind = 'audio' then 'gated' when level <= 0.00001 and kind = 'image' then 'gated' else 'generate' end as step,
  case when substring(blob, 2, 1) < '6' then null when level <= 0.0001 and kind = 'audio' then 'silence' when level <= 0.00001 and kind = 'image' then 'uniform' end as reason from s""")
def media_plan(spark, sf):
    b = _blobs(spark, sf)
    first = F.substring("blob", 1, 1)
    level = F.when(first < "4", 0.00001).when(first < "c", 0.5)
    have = b.filter(F.substring("blob", 2, 1) < "6").select("blob", lit("p").alias("producer"), "kind")
    return media.planned(b.select("kind", "blob", level.alias("rms"), level.alias("variance")), media.narrowed(have, producer="p"), "p")


@query(SQL["media_plan"].replace("select kind, blob, case when substring(blob, 2, 1)", ", p as (select kind, blob, case when substring(blob, 2, 1)", 1) + ") select count(*) as candidates, count(*) filter (where step = 'generate' and substring(blob, 3, 1) >= '4') as generated, count(*) filter (where step = 'existing') as existing, count(*) filter (where step = 'gated') as gated, count(*) filter (where step = 'generate' and substring(blob, 3, 1) < '4') as empty from p")
def media_build(spark, sf):
    plan, third = media_plan(spark, sf), F.substring("blob", 3, 1)
    replies = plan.filter(third >= "2").select("kind", "blob", F.when(third >= "4", "a text").otherwise(" \n\t").alias("text"))
    return media.build_counts(media.built(plan, replies))


@query("select p_brand as producer, p_type as kind, concat('m', p_size % 3) as model, 'q4' as quantisation, count(*) as records, count(*) filter (where p_size % 4 = 0) as skips, max(p_partkey) as latest from part group by p_brand, p_type, p_size % 3")
def producer_models(spark, sf):
    p = read(spark, sf, "part")
    return media.summary(p.select(col("p_brand").alias("producer"), col("p_type").alias("kind"), F.concat(lit("m"), (col("p_size") % 3).cast("string")).alias("model"), lit("q4").alias("quantisation"), (col("p_size") % 4 == 0).alias("skipped"), col("p_partkey").alias("created")))


@query("""select p_partkey, case when p_size % 2 = 0 then 'pinned_digest' else 'vendor_asserted' end as trust, p_size % 2 = 1 as caveat, concat('instruction', case when p_size % 3 > 0 then '|node keys|node names' else '' end, case when p_size % 5 = 0 then '|repository-relative paths' else '' end, case when p_size % 7 = 0 then '|captured prose excerpts' else '' end) as fields from part""")
def disclosures(spark, sf):
    size = col("p_size")
    level = media.trust(F.when(size % 2 == 0, "d").otherwise(""))
    fields = media.disclosed(size % 3, F.when(size % 5 == 0, 1).otherwise(0), F.when(size % 7 == 0, 1).otherwise(0))
    return read(spark, sf, "part").select("p_partkey", level.alias("trust"), media.trust_caveat(level).isNotNull().alias("caveat"), F.array_join(fields, "|").alias("fields"))


# ---- scores

_NEAREST = _REVIEW + """, p as (select r.id as rid, f.id as fid, abs(r.line - f.line) as d from r join f on r.sha = f.sha and r.path = f.path and abs(r.line - f.line) <= 10), m as (select rid, fid from p qualify row_number() over (partition by rid order by d, fid) = 1) """


def _nearest(spark, sf):
    rows, found = _review(spark, sf)
    pairs = review.band_pairs(rows, found).groupBy("row").agg(F.min_by("finding", F.struct("distance", "finding")).alias("finding"))
    priority = _one_of(("1-URGENT", "2-HIGH", None), col("id") % 3)
    return rows, pairs, found.withColumn("class", priority)


@query(_NEAREST + """, x as (select m.*, ['1-URGENT', '2-HIGH', null][fid % 3 + 1] as said from m) select class, count(r.id) as real, count(x.rid) as found, count(r.id) - count(x.rid) as missed, case when count(r.id) > 0 then count(x.rid) / count(r.id) end as recall, count(*) filter (where said <> class) as misclassified from r left join x on r.id = x.rid where verdict = 'real' group by class""")
def class_scores(spark, sf):
    rows, matched, found = _nearest(spark, sf)
    return review.class_scores(rows, matched, found, rows.select("class").distinct())


@query(_NEAREST + """, s as (select count(*) filter (where verdict = 'real') as real, count(*) filter (where verdict = 'false') as known_false, count(rid) filter (where verdict = 'real') as found, count(rid) filter (where verdict = 'false') as known_false_reproduced from r left join m on r.id = m.rid)
  select real, known_false, found, known_false_reproduced, (select count(*) from f) - (select count(*) from m) as unadjudicated, found / (found + known_false_reproduced) as corpus_precision from s""")
def corpus_score(spark, sf):
    rows, matched, found = _nearest(spark, sf)
    return review.score(rows, matched, found)


@query("""with c as (select distinct o_custkey % 40 as n from orders), a as (select distinct o_custkey % 50 as n from orders where o_custkey % 50 > 5), f as (select distinct l_suppkey % 60 as n from lineitem)
  select 'unknown_sha' as error, concat('s', n) as sha from (select n from a union select n from f) where n not in (select n from c) union all select 'undeclared_sha', concat('s', n) from f where n in (select n from c) and n not in (select n from a)""")
def score_preconditions(spark, sf):
    o = read(spark, sf, "orders")
    sha = lambda c, k: F.concat(lit("s"), (col(c) % k).cast("string")).alias("sha")
    return review.preconditions(o.filter("o_custkey % 50 > 5").select(sha("o_custkey", 50)), read(spark, sf, "lineitem").select(sha("l_suppkey", 60)), o.select(sha("o_custkey", 40)))


@query("""with s as (select o_orderkey as site, o_custkey // 15 as sha, case when o_orderkey % 3 > 0 then o_orderstatus end as platform, o_orderkey % 2 = 0 as tests from orders), r as (select distinct l_suppkey as sha, l_linestatus as p, l_linenumber % 2 = 0 as t, concat('job', l_orderkey % 5) as job from lineitem)
  select site, string_agg(distinct job, '|' order by job) as jobs from s join r on s.sha = r.sha and (platform is null or p is null or platform = p) and (not tests or t) group by site""")
def jobs_covering(spark, sf):
    o, l = read(spark, sf, "orders"), read(spark, sf, "lineitem")  # noqa: E741
    i = col("o_orderkey")
    sites = o.select(i.alias("site"), F.floor(col("o_custkey") / 15).alias("sha"), F.when(i % 3 > 0, col("o_orderstatus")).alias("platform"), (i % 2 == 0).alias("tests"))
    runs = l.select(col("l_suppkey").alias("sha"), col("l_linestatus").alias("platform"), (col("l_linenumber") % 2 == 0).alias("tests"), F.concat(lit("job"), (col("l_orderkey") % 5).cast("string")).alias("job"))
    return review.jobs_covering(sites, runs).withColumn("jobs", F.array_join("jobs", "|"))


@query("""with recursive i as (select l_orderkey as file, l_linenumber as place, cast(l_partkey as varchar) as part, cast(floor(l_quantity) as bigint) * 40 as tokens, least(4000, 2 * (l_orderkey % 1500)) as cap from lineitem),
  p as (select *, row_number() over (partition by file order by place, part, tokens) as n from i), w as (select file, n, cap, case when tokens <= cap then tokens else 0 end as used, case when tokens <= cap then part else '' end as kept, case when tokens <= cap then 0 else 1 end as dropped from p where n = 1
  union all select p.file, p.n, p.cap, case when used + tokens <= p.cap then used + tokens else used end, case when used + tokens <= p.cap then (case when kept = '' then part else concat(kept, ',', part) end) else kept end, case when used + tokens <= p.cap then dropped else dropped + 1 end from w join p on w.file = p.file and p.n = w.n + 1)
  select file, cap, used, kept, dropped from w qualify row_number() over (partition by file order by n desc) = 1""")
def context_fit(spark, sf):
    l = read(spark, sf, "lineitem")  # noqa: E741
    items = l.select(col("l_orderkey").alias("file"), col("l_linenumber").alias("place"), _text("l_partkey").alias("part"), (F.floor("l_quantity") * 40).alias("tokens"), (col("l_orderkey") % 1500).alias("diff_tokens"))
    return review.context_fit(items).withColumn("kept", F.array_join("kept", ","))


# ---- versions and definitions

_VERSIONS = """with h as (select o_custkey as path, o_orderkey as place, month(o_orderdate) as major, day(o_orderdate) % 12 as minor, cast(o_orderdate as date) as day from orders),
  d as (select c_custkey as path, c_custkey % 12 + 1 as fa, c_custkey % 5 as fb, case when c_custkey % 4 > 0 then c_custkey % 12 + 1 end as sa, case when c_custkey % 4 > 0 then c_custkey % 6 end as sb, date '1996-01-01' as modified from customer),
  t as (select path, max(major * 100 + minor) as top, max(day) as newest from h group by path), n as (select o_custkey as path, o_orderkey as line, o_orderkey % 12 + 1 as major, o_orderkey % 12 as minor from orders),
  b as (select *, lag(major * 100 + minor) over (partition by path order by place) as was from h) """


@query(_VERSIONS + """select path, 'summary' as rule, concat(fa, '.', fb) as said, concat(sa, '.', sb) as other from d where sa is not null and (fa <> sa or fb <> sb)
  union all select path, 'order', concat(major, '.', minor), concat(was // 100, '.', was % 100) from b where was is not null and major * 100 + minor <= was
  union all select n.path, 'note', concat(n.major, '.', n.minor), cast(line as varchar) from n where not exists (select 1 from h where h.path = n.path and h.major = n.major and h.minor = n.minor)
  union all select d.path, 'history', concat(fa, '.', fb), concat(top // 100, '.', top % 100) from d join t using (path) where fa * 100 + fb <> top
  union all select d.path, 'modified', cast(modified as varchar), cast(newest as varchar) from d join t using (path) where modified < newest""")
def version_contradictions(spark, sf):
    o, c = read(spark, sf, "orders"), read(spark, sf, "customer")
    version = lambda a, b: F.struct(a.cast("int").alias("major"), b.cast("int").alias("minor"))
    i, k = col("c_custkey"), col("o_orderkey")
    docs = c.select(i.alias("path"), version(i % 12 + 1, i % 5).alias("front"), F.when(i % 4 > 0, version(i % 12 + 1, i % 6)).alias("summary"), lit("1996-01-01").cast("date").alias("modified"))
    history = o.select(col("o_custkey").alias("path"), k.alias("place"), version(F.month("o_orderdate"), F.dayofmonth("o_orderdate") % 12).alias("version"), col("o_orderdate").cast("date").alias("date"))
    notes = o.select(col("o_custkey").alias("path"), k.alias("line"), version(k % 12 + 1, k % 12).alias("version"))
    return checks.version_drift(docs, history, notes)


@query("""with s as (select concat('o', o_orderkey) as key, o_custkey as path, cast(floor(o_totalprice) as bigint) % 4000 as a, 10 + o_orderkey % 3000 as n from orders)
  select x.key, y.key as parent from s x join s y on x.path = y.path and y.a <= x.a and y.a + y.n >= x.a + x.n and y.n > x.n qualify row_number() over (partition by x.key order by y.n, y.key) = 1""")
def enclosing_definitions(spark, sf):
    o = read(spark, sf, "orders")
    start = F.floor("o_totalprice") % 4000
    spans = o.select(F.concat(lit("o"), _text("o_orderkey")).alias("key"), col("o_custkey").alias("path"), start.alias("start"), (start + 10 + col("o_orderkey") % 3000).alias("end"))
    return checks.enclosing(spans)


@query("select 'broken-link' as kind, concat('docs/', doc_id) as path, source as what from documents where doc_id % 5 = 0 union all select 'unknown-adr', concat('src/', doc_id), cast(doc_id as varchar) from documents where doc_id % 7 = 0")
def violation_kinds(spark, sf):
    d = read(spark, sf, "documents")
    return checks.violations(broken_link=d.filter("doc_id % 5 = 0").select(F.concat(lit("docs/"), _text("doc_id")).alias("path"), col("source").alias("what")), unknown_adr=d.filter("doc_id % 7 = 0").select(F.concat(lit("src/"), _text("doc_id")).alias("path"), "doc_id").withColumnRenamed("doc_id", "what"))


# ---- trees and changes

_CHANGES = """with base as (select concat('p', p_partkey) as path, p_brand as blob from part where p_partkey % 7 > 0), head as (select concat('p', p_partkey) as path, case when p_partkey % 5 = 0 then 'x' else p_brand end as blob from part where p_partkey % 11 > 0),
  dirty as (select concat('p', p_partkey) as path, case when p_partkey % 6 > 0 then 'y' end as blob from part where p_partkey % 3 = 0), w as (select path, blob from head where path not in (select path from dirty) union all select path, blob from dirty where blob is not null) """


@query(_CHANGES + "select coalesce(base.path, w.path) as path, case when base.path is null then 'added' when w.path is null then 'deleted' else 'modified' end as status from base full outer join w on base.path = w.path where base.blob is distinct from w.blob")
def changed_files(spark, sf):
    p = read(spark, sf, "part")
    i, path = col("p_partkey"), F.concat(lit("p"), _text("p_partkey")).alias("path")
    base = p.filter(i % 7 > 0).select(path, col("p_brand").alias("blob"))
    head = p.filter(i % 11 > 0).select(path, F.when(i % 5 == 0, "x").otherwise(col("p_brand")).alias("blob"))
    return sync.changed_files(base, head, p.filter(i % 3 == 0).select(path, F.when(i % 6 > 0, "y").alias("blob")))


@query("""with m as (select concat('vendor/', p_partkey) as path, concat('https://h/', p_brand) as url from part where p_partkey % 3 > 0), l as (select concat('vendor/', p_partkey) as path, md5(p_name) as sha from part where p_partkey % 2 = 0)
  select coalesce(m.path, l.path) as path, url, sha from m full outer join l on m.path = l.path""")
def submodules(spark, sf):
    p = read(spark, sf, "part")
    i = _text("p_partkey")
    content = F.concat(lit('[core]\n path = no\n[submodule "m'), i, lit('"]\n\tpath = vendor/'), i, F.when(col("p_partkey") % 3 > 0, F.concat(lit("\n\turl=https://h/"), "p_brand", lit("\n"))).otherwise("\n[x]\n url = no"))
    return sync.submodules(p.select(content.alias("content")), p.filter("p_partkey % 2 = 0").select(F.concat(lit("vendor/"), i).alias("path"), F.md5("p_name").alias("sha")))


_CHANGED = "with ch as (select concat('part/Brand#', n) as path, case when n = 2 then 'deleted' else 'modified' end as status from (values (1), (2), (3)) v(n)), own as (select key from nodes where kind = 'part' and path in (select path from ch where status <> 'deleted')) "


def _changed(spark):
    return spark.createDataFrame([("part/Brand#1", "modified"), ("part/Brand#2", "deleted"), ("part/Brand#3", "modified")], "path string, status string")


@query(_CHANGED + "select distinct n.key, n.name, n.kind from nodes n join ends e on n.key = e.key where e.other in (select key from own) and n.path not in (select path from ch)")
def blast_radius(spark, sf):
    return sync.impact(_changed(spark), nodes(spark, sf), edges(spark, sf))


@query(_CHANGED + """, v as (select 'broken-link' as kind, case when p_partkey % 2 = 0 then concat('part/', p_brand) else concat('docs/', p_partkey) end as path, concat('part:', p_partkey) as what from part)
  select kind, path, what from v where path in (select path from ch) or what in (select key from nodes where path in (select path from ch))""")
def touched_violations(spark, sf):
    p = read(spark, sf, "part")
    i = col("p_partkey")
    v = p.select(lit("broken-link").alias("kind"), F.when(i % 2 == 0, F.concat(lit("part/"), "p_brand")).otherwise(F.concat(lit("docs/"), i.cast("string"))).alias("path"), F.concat(lit("part:"), i.cast("string")).alias("what"))
    return sync.touched(v, _changed(spark), nodes(spark, sf, ("part",)))


# ---- reports

_REPORTS = """with r as (select o_orderkey as report, case when o_orderkey % 17 = 0 then 'other/v1' else 'findings-report/v1' end as schema, case when o_orderkey % 13 = 0 then 'Bad Id' when o_orderkey % 11 = 0 then 'odd' else 'audit' end as analyzer, case when o_orderkey % 7 = 0 then ' ' else '1.0' end as version from orders) """


def _reports(spark, sf):
    o, l = read(spark, sf, "orders"), read(spark, sf, "lineitem")  # noqa: E741
    i, n = col("l_orderkey"), col("l_linenumber")
    span = F.struct((n * 10).alias("start"), F.when(n == 5, 1).otherwise(n * 10 + 5).alias("end"))
    identity = F.array(F.when(n == 6, "").otherwise(F.concat(lit("r:"), _text("l_suppkey"))), F.when(n == 3, "1").otherwise(F.least(n, lit(2)).cast("string")))
    f = F.struct(F.when(n == 7, " ").otherwise("rule").alias("rule"), lit("high").alias("severity"), lit("t").alias("title"), F.when(i % 19 == 0, "../x").otherwise("a/b").alias("path"), span.alias("span"), identity.alias("identity"))
    lists = l.groupBy(i.alias("report")).agg(F.transform(F.array_sort(F.collect_list(F.struct(n.alias("n"), f.alias("f")))), lambda x: x["f"]).alias("findings"))
    k = col("o_orderkey")
    head = o.select(k.alias("report"), F.when(k % 17 == 0, "other/v1").otherwise("findings-report/v1").alias("schema"), F.when(k % 13 == 0, "Bad Id").when(k % 11 == 0, "odd").otherwise("audit").alias("analyzer"), F.when(k % 7 == 0, " ").otherwise("1.0").alias("analyzer_version"), lit("s").alias("started_at"), lit("e").alias("ended_at"))
    whole = head.join(lists, "report", "left")
    json = F.to_json(F.struct(*[c for c in whole.columns if c != "report"]))
    return reports.normalised(whole.select("report", json.alias("json")))


@query(_REPORTS + "select report, case when schema = 'other/v1' then 'schema' when analyzer = 'Bad Id' then 'analyzer_id' when analyzer = 'odd' then 'analyzer_mismatch' when version = ' ' then 'analyzer_version' end as fault from r")
def report_source_faults(spark, sf):
    return reports.report_faults(_reports(spark, sf), "audit")


@query(_REPORTS + """, f as (select l_orderkey as report, l_linenumber as n, analyzer, case when l_linenumber = 6 then '' else concat('r\\:', l_suppkey) end as one, case when l_linenumber = 3 then '1' else cast(least(l_linenumber, 2) as varchar) end as two from lineitem join r on report = l_orderkey),
  k as (select *, concat('finding:', analyzer, ':', one, ':', two) as key, cast(row_number() over (partition by report order by n, one) - 1 as integer) as place from f), m as (select *, min(place) over (partition by report, key) as first from k)
  select report, place, key, case when n = 7 then 'rule' when report % 19 = 0 then 'path' when n = 5 then 'span' when one = '' then 'identity' when place > first then 'duplicate' end as fault from m""")
def report_source_findings(spark, sf):
    return reports.report_findings(_reports(spark, sf)).select("report", "place", "key", "fault")


# ---- hubs, configuration

@query("select cast(null as varchar) as hub")
def hub_suppressed(spark, sf):
    keys = read(spark, sf, "part").select(col("p_brand").alias("project"))
    return links.hub_by_keys(keys, edges(spark, sf, ("related",)))


@query("""with t as (select doc_id, source, lang from documents) select concat('k/', doc_id, '.yaml') as path, 'LANG' as key, coalesce(lang, 'none') as value from t union all select concat('k/', doc_id, '.yaml'), 'api_token', '<redacted>' from t union all select concat('k/', doc_id, '.yaml'), 'container.web.image', concat('reg/', source, ':1') from t
  union all select concat('k/', doc_id, '.yaml'), 'server.max-size', cast(doc_id as varchar) from t union all select concat('k/', doc_id, '.yaml'), 'server.hosts', '[a, b]' from t union all select concat('k/', doc_id, '.yaml'), 'user', '<redacted>' from t""")
def yaml_config(spark, sf):
    d = read(spark, sf, "documents")
    name, of = F.coalesce("lang", lit("none")), F.coalesce("source", lit(""))
    content = F.concat(
        lit("# settings\nserver:\n  max-size: "), _text("doc_id"), lit("\n  hosts: [a, 'b']\n---\napiVersion: v1\nkind: Secret\ndata:\n  user: eA==\n---\napiVersion: apps/v1\nkind: Deployment\nspec:\n  template:\n    spec:\n      containers:\n        - name: web\n          image: reg/"),
        of, lit(":1\n          env:\n            - name: LANG\n              value: \""), name, lit("\"\n            - name: api_token\n              value: abc\n            - name: FROM\n              valueFrom: {x: 1}\n"),
    )
    out = extract.config_keys(d.select(F.concat(lit("k/"), _text("doc_id"), lit(".yaml")).alias("path"), content.alias("content")))
    return out.withColumn("value", text.redacted(col("key"), col("value")))


# ---- hub contexts, cache keys, layers, documents


@query("""with r as (select key, direction, kind, other, provenance, row_number() over (partition by key, direction, kind order by other, provenance) as turn from ends), p as (select *, row_number() over (partition by key, direction order by turn, kind) as place from r)
  select key, direction, kind, other, provenance from p where place <= 20""")
def capped_edges(spark, sf):
    return lenses.round_robin(lenses.endpoints(edges(spark, sf)), 20).select("key", "direction", "kind", "other", "provenance")


@query("""with t as (select distinct p_partkey, concat('src/', p_brand) as text, md5(p_name) as oid, p_size * 4294967297 as env from part), h as (select *, lower(lpad(to_hex(cast(list_reduce(list_concat([14695981039346656037::uhugeint], list_transform(
  generate_series(1, cast(length(hex(encode(text))) / 2 as bigint)), lambda i: cast(concat('0x', substring(hex(encode(text)), cast(2 * i - 1 as bigint), 2)) as uhugeint))), lambda h, b: (xor(h, b) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint) as uhugeint)), 16, '0')) as fnv from t)
  select p_partkey, concat(oid, '-', fnv, '-v107-e', lower(lpad(to_hex(env), 16, '0'))) as key, 7 as generation from h""")
def cache_keys(spark, sf):
    p = read(spark, sf, "part")
    key = sync.cache_key(F.concat(lit("src/"), "p_brand"), F.md5("p_name"), 107, col("p_size") * lit(4294967297))
    return p.select("p_partkey", key.alias("key")).withColumn("generation", sync.generation(col("key")))


@query(_CACHE.replace("with g as (select concat", "with l as (select concat").replace("as bytes from events),", """as bytes, event_id % 17 = 0 as forget from events), lost as (select key, max(tick) as gone from l where forget group by key),
  g as (select l.key, tick, op, bytes from l left join lost on l.key = lost.key where not forget and (gone is null or tick > gone)),""") + "select key, bytes, hits, last_used from c")
def cache_forgotten(spark, sf):
    log = _log(spark, sf).withColumn("op", F.when(col("tick") % 17 == 0, "forget").otherwise(col("op")))
    return memory.cache_state(log)


@query(_FINDINGS + ", n as (select 'labels/1' as layer, concat('finding:', doc_id * 3) as key, 'low' as severity from labels where doc_id % 2 = 0) select layer, key, severity from f where layer <> 'labels/1' union all select * from n")
def replaced_layer(spark, sf):
    new = read(spark, sf, "labels").filter("doc_id % 2 = 0").select(lit("labels/1").alias("layer"), F.concat(lit("finding:"), (col("doc_id") * 3).cast("string")).alias("key"), lit("low").alias("severity"))
    return layers.replaced_layer(_findings(spark, sf), "labels/1", new)[0]


@query("""select concat(case doc_id % 4 when 0 then 'docs/adr/0001-x' when 1 then 'Docs/Blueprints/b' else 'notes/n' end, doc_id, '.md') as path, case when doc_id % 4 = 0 then 'adr' when doc_id % 3 = 0 then 'page' when doc_id % 4 = 1 or doc_id % 5 = 0 then 'blueprint' else 'plain' end as kind from documents""")
def document_kinds(spark, sf):
    i = col("doc_id")
    path = F.concat(F.when(i % 4 == 0, "docs/adr/0001-x").when(i % 4 == 1, "Docs/Blueprints/b").otherwise("notes/n"), i.cast("string"), lit(".md"))
    body = F.concat(F.when(i % 3 == 0, "---\nsite-page: slug\n---\n").otherwise("---\nsite-page:\n---\nsite-page: no\n"), lit("```\n# Code — Technical Implementation Plan\n```\n"), F.when(i % 5 == 0, "# X — Technical Implementation Plan\n").otherwise("# X\n"))
    return extract.document_kinds(read(spark, sf, "documents").select(path.alias("path"), body.alias("content")))


@query("""with recursive f as (select distinct concat('f', l_suppkey) as path, concat('S', l_linenumber) as struct, l_linenumber <= 2 as root, concat('k', l_partkey % 7) as field, case when l_partkey % 7 < 3 then concat('S', l_linenumber + 1 + l_partkey % 7) when l_partkey % 7 = 3 then concat('S', l_linenumber - 1) end as type from lineitem),
  s as (select distinct path, struct from f), n as (select path, struct as src, field as key, type, [struct] as seen from f where root
  union all select n.path, src, concat(key, '.', field), f.type, list_append(seen, n.type) from n join f on n.path = f.path and n.type = f.struct and not list_contains(seen, n.type)),
  leaf as (select n.* from n left join s on n.path = s.path and n.type = s.struct where s.struct is null or list_contains(seen, n.type)) select path, key, min(src) as struct from leaf group by path, key""")
def struct_keys(spark, sf):
    n, k = col("l_linenumber"), col("l_partkey") % 7
    named = lambda x: F.concat(lit("S"), x.cast("string"))
    fields = read(spark, sf, "lineitem").select(F.concat(lit("f"), _text("l_suppkey")).alias("path"), named(n).alias("struct"), (n <= 2).alias("root"), F.concat(lit("k"), k.cast("string")).alias("field"), F.when(k < 3, named(n + 1 + k)).when(k == 3, named(n - 1)).alias("type"))
    return extract.struct_keys(fields.distinct())


@query("with g as (" + _search_sql("txt") + "), best as (select key, score from g order by score desc, key limit 30) select key, score from best where key like 'file:%' order by score desc, key limit 10")
def topic_documents(spark, sf):
    return context.topic_documents(_searchable(spark, sf), "txt", ("file",), 10)

"""Queries over what is kept: facts by a table function and its cache, layers on disk, contexts, calls resolved again."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import bundles, dispatch, extract, incremental
from .plans.lineage import shared_path
from .queries import _CACHE, _log, query
from .queries_told import _cases, _says
from .sources import graph, layers, snapshot
from .sources.graph import edges, nodes, read
from .streaming import recency

col, lit = F.col, F.lit

# ---- facts of files

_KINDS = ["conf/a.yaml", "Dockerfile", "notes/r.md", "src/m.rs", "b.json", "conf/bad.yml", "x/app.toml", ".env"]
_CONTENTS = [
    "base: &b {host: h%, port: 1}\nuse:\n  <<: *b\nlist: &l\n- x\n- !t y\nagain: *l\nsecret: !!str 5\n",
    "FROM --platform=x rust:1.80 AS build\nFROM build\nfrom scratch\nFROM debian@sha256:ab\n",
    "# T%\n\n two   words\t",
    "fn f() {}\n",
    '{"a": {"b": [1, 2], "c": null}}',
    "a: [1\n",
    "[t]\nx = 1\n",
    "export A=1\n#B=2\nC='q'\n",
]
_FACTS = [
    (0, "file", "a.yaml", "8"), (0, "config_key", "base.host", "h%"), (0, "config_key", "base.port", "1"), (0, "config_key", "use.<<.host", "h%"), (0, "config_key", "use.<<.port", "1"), (0, "config_key", "list", "[x, y]"),
    (0, "config_key", "again", "[x, y]"), (0, "config_key", "secret", "5"), (1, "file", "dockerfile", "4"), (1, "image_ref", "rust:1.80", None), (1, "image_ref", "debian@sha256:ab", None),
    (2, "file", "r.md", "2"), (2, "content", "r.md", "# T% two words"), (3, "file", "m.rs", "1"), (4, "file", "b.json", "0"), (4, "config_key", "a.b", "[1,2]"), (4, "config_key", "a.c", None),
    (5, "file", "bad.yml", "1"), (5, "unread", "ValueError", "not closed: [1"), (6, "file", "app.toml", "2"), (6, "config_key", "t.x", "1"), (7, "file", ".env", "3"), (7, "config_key", "A", "1"), (7, "config_key", "C", "q"),
]
_FACT_COLUMNS = "concat(doc_id, '/', ['" + "', '".join(_KINDS) + "'][n + 1]) as path, kind, name, replace(value, '%', doc_id::varchar) as value"


def _blobs(spark, sf):
    d = _cases(spark, sf, _CONTENTS)
    path = F.concat(col("doc_id").cast("string"), lit("/"), F.get(F.array(*[lit(k) for k in _KINDS]), (col("doc_id") % len(_KINDS)).cast("int")))
    return d.select("doc_id", path.alias("path"), "content").withColumn("cache_key", dispatch.key_of(col("path"), col("content")))


@query(_says(8, "kind, name, value", _FACTS, _FACT_COLUMNS))
def file_facts(spark, sf):
    return dispatch.extracted(_blobs(spark, sf)).drop("cache_key")


@query(_says(8, "kind, name, value", _FACTS, _FACT_COLUMNS))
def file_facts_cached(spark, sf):
    """The same facts, those of every other file from the cache that an earlier call has written."""
    blobs, path = _blobs(spark, sf), shared_path(spark, "facts")
    _, fresh = dispatch.facts_of(blobs.filter("doc_id % 2 = 0"), None)
    fresh.write.parquet(path)
    return dispatch.facts_of(blobs, spark.read.parquet(path))[0].drop("cache_key")


@query("select count(*) filter (where doc_id % 2 = 1) as first, 0 as again from documents where doc_id is not null")
def file_facts_misses(spark, sf):
    """How many files are extracted by a call whose cache has every other one, and by the call after it."""
    blobs, path = _blobs(spark, sf), shared_path(spark, "facts")
    dispatch.facts_of(blobs.filter("doc_id % 2 = 0"), None)[1].write.parquet(path)
    fresh = dispatch.facts_of(blobs, spark.read.parquet(path))[1]
    fresh.write.mode("append").parquet(path)
    count = lambda df: df.select("path").distinct().agg(F.count("*"))
    again = dispatch.facts_of(blobs, spark.read.parquet(path))[1]
    first = spark.read.parquet(path).join(blobs.filter("doc_id % 2 = 1").select("path"), "path", "left_semi")
    return count(first).toDF("first").crossJoin(count(again).select(F.col("count(1)").cast("int").alias("again")))  # one row each


@query(_says(8, "reason", [(5, "ValueError: not closed: [1")], "concat(doc_id, '/conf/bad.yml') as path, reason"))
def unread_files(spark, sf):
    b = _blobs(spark, sf)
    return extract.unread(b.filter("doc_id % 8 not in (1, 2, 3)"))


# ---- layers on disk


@query("""select provenance, src_ref, count(*) as edges, count(distinct src) as sources from (select src, dst, provenance, src_ref from edges where provenance = 'derived'
  union all select src, dst, provenance, src_ref from edges where provenance = 'authored' and cast(substr(dst, 7) as bigint) % 3 = 0 union all select concat('part:', p_partkey), concat('file:', p_partkey % 7), 'authored', 'import:notes' from part) group by all""")
def layers_on_disk(spark, sf):
    """Edges in layers: one replaced by fewer edges, one new, and one deleted."""
    e, path = edges(spark, sf), shared_path(spark, "layers")
    layers.rebuild(e, path)
    authored = e.filter("provenance = 'authored' and cast(substring(dst, 7) as bigint) % 3 = 0")
    notes = read(spark, sf, "part").select(graph.keyed("part", "p_partkey").alias("src"), F.concat(lit("file:"), (col("p_partkey") % 7).cast("string")).alias("dst"), lit("references").alias("kind"), lit("authored").alias("provenance"), lit(None).cast("double").alias("confidence"), lit("import:notes").alias("src_ref"))
    layers.replace(authored.unionByName(notes), path)
    layers.delete(spark, path, provenance="inferred")
    return layers.read(spark, path, e.schema).groupBy("provenance", "src_ref").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"))


# ---- calls resolved again


def _functions(spark, sf, name: str, where: str = "true"):
    s = read(spark, sf, "supplier").filter(where)
    return s.select(F.concat(lit("n"), (col("s_suppkey") % 10).cast("string")).alias("path"), graph.keyed("supplier", "s_suppkey").alias("key"), F.expr(name).alias("name"), F.concat(lit("s"), (col("s_suppkey") % 3).cast("string")).alias("scope"))


@query("""with f as (select concat('supplier:', s_suppkey) as key, concat('s', s_suppkey % 3) as scope, case when s_suppkey % 10 < 3 then concat('f', s_nationkey) else concat('f', s_suppkey % 97) end as name from supplier where s_suppkey % 10 <> 4),
  c as (select concat('customer:', c_custkey) as caller, concat('f', c_custkey % 97) as name, case when c_custkey % 4 > 0 then concat('s', c_custkey % 3) end as qualifier from customer where c_custkey % 10 <> 4
    union select key, concat('f', (cast(substr(key, 10) as bigint) + 1) % 97), 'Self' from f),
  own as (select c.*, case when qualifier = 'Self' then f.scope else qualifier end as within from c left join f on caller = f.key),
  one as (select name, count(*) as n, min(key) as alone from f group by name), sc as (select scope as within, name, min(key) as inside from f group by scope, name having count(*) = 1)
  select distinct caller as src, coalesce(case when n = 1 then alone end, inside) as dst, 'calls' as kind, 'derived' as provenance from own join one using (name) left join sc on own.within = sc.within and own.name = sc.name where coalesce(case when n = 1 then alone end, inside) is not null""")
def calls_again(spark, sf):
    """Calls after the functions of some paths have got other names and one path was deleted, from the calls resolved before."""
    before = "concat('f', s_suppkey % 97)"
    old, now = _functions(spark, sf, before), _functions(spark, sf, f"if(s_suppkey % 10 < 3, concat('f', s_nationkey), {before})", "s_suppkey % 10 <> 4")

    def calls(functions, where: str):
        c = read(spark, sf, "customer").filter(where)
        plain = c.select(F.concat(lit("n"), (col("c_custkey") % 10).cast("string")).alias("path"), graph.keyed("customer", "c_custkey").alias("caller"), F.concat(lit("f"), (col("c_custkey") % 97).cast("string")).alias("name"), F.when(col("c_custkey") % 4 > 0, F.concat(lit("s"), (col("c_custkey") % 3).cast("string"))).alias("qualifier"))
        ident = F.substring_index("key", ":", -1).cast("bigint")
        return plain.unionByName(functions.select("path", col("key").alias("caller"), F.concat(lit("f"), ((ident + 1) % 97).cast("string")).alias("name"), lit("Self").alias("qualifier")))

    touched = spark.range(5).select(F.concat(lit("n"), col("id").cast("string")).alias("path")).filter("path <> 'n3'")
    resolved = incremental.resolutions(old, calls(old, "true"))
    return incremental.call_edges(incremental.resolved_again(resolved, old, now, calls(now, "c_custkey % 10 <> 4"), touched))


# ---- contexts


def _told(side: str):
    e = col(side)
    joined = lambda items, *names: F.array_join(F.transform(items, lambda x: F.concat_ws(" ", *[x[n].cast("string") for n in names])), ",")
    return [e["total"].alias(f"{side}_total"), e["truncated"].alias(f"{side}_cut"), joined(e["edges"], "kind", "other", "provenance").alias(f"{side}_edges"), joined(e["omitted"], "kind", "omitted").alias(f"{side}_omitted")]


_BUNDLE = """with r as (select key, direction, kind, other, provenance, row_number() over (partition by key, direction, kind order by other, provenance) as turn, count(*) over (partition by key, direction, kind) as of_kind, count(*) over (partition by key, direction) as total from ends),
  k as (select *, row_number() over (partition by key, direction order by turn, kind) as place from r), o as (select key, direction, any_value(total) as total, string_agg(concat(kind, ' ', other, ' ', provenance), ',' order by kind, other, provenance) as edges from k where place <= 50 group by key, direction),
  g as (select key, direction, kind, any_value(of_kind) - count(*) as omitted from k where place <= 50 group by key, direction, kind), m as (select key, direction, string_agg(concat(kind, ' ', omitted), ',' order by kind) as omitted from g where omitted > 0 group by key, direction),
  s as (select o.*, coalesce(m.omitted, '') as omitted from o left join m using (key, direction))
  select n.key, coalesce(a.total, 0) as outgoing_total, coalesce(a.total, 0) > 50 as outgoing_cut, coalesce(a.edges, '') as outgoing_edges, coalesce(a.omitted, '') as outgoing_omitted,
    coalesce(b.total, 0) as incoming_total, coalesce(b.total, 0) > 50 as incoming_cut, coalesce(b.edges, '') as incoming_edges, coalesce(b.omitted, '') as incoming_omitted
  from nodes n left join s a on a.key = n.key and a.direction = 'out' left join s b on b.key = n.key and b.direction = 'in'"""


@query(_BUNDLE)
def context_bundles(spark, sf):
    return bundles.bundles(nodes(spark, sf), edges(spark, sf)).select("key", *_told("outgoing"), *_told("incoming"))


@query("select count(*) as rebuilt, cast(0 as bigint) as reused, cast(0 as bigint) as pruned from (select 'nation:3' as key union select other from ends where key = 'nation:3')")
def contexts_refreshed(spark, sf):
    """What is done when contexts of all nodes are refreshed after a nation has got another content: it and all around it are built again, nothing else is looked at."""
    n, e, path = nodes(spark, sf), edges(spark, sf), shared_path(spark, "contexts")
    bundles.store(n, e, path)
    now = n.withColumn("blob_hash", F.when(col("key") == "nation:3", F.md5(lit("new"))).otherwise(col("blob_hash"))).withColumn("name", F.when(col("key") == "nation:3", "new").otherwise(col("name")))
    return bundles.refresh(now, e, spark.createDataFrame([("nation:3",)], "key string"), path)


# ---- a cache's log as a stream


@query(_CACHE + "select key, bytes, hits, last_used from c")
def cache_recency(spark, sf):
    """The entries of a cache from its log as a stream in three batches, each continuing the state of the one before."""
    log, path = _log(spark, sf).select("key", "tick", "op", "bytes"), shared_path(spark, "log")
    ends = log.agg(F.percentile_approx("tick", F.array(lit(0.3), lit(0.7)), 100).alias("q")).first()[0] or [0, 0]
    setting, was = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(setting, recency.PROVIDER)
    try:
        for low, high in ((-(2**62), ends[0]), (ends[0], ends[1]), (ends[1], 2**62)):
            log.filter((col("tick") > low) & (col("tick") <= high)).write.mode("append").parquet(f"{path}/log")
            stream = recency.recency(spark.readStream.schema(log.schema).parquet(f"{path}/log"))
            stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/entries").awaitTermination()
    finally:
        spark.conf.unset(setting) if was is None else spark.conf.set(setting, was)
    return recency.latest(spark.read.parquet(f"{path}/entries"))


# ---- snapshots of another tool


def _snapshot(spark, sf) -> str:
    """A snapshot in which customers and suppliers are symbols of their nation's files."""
    path = shared_path(spark, "snapshot")
    n = read(spark, sf, "nation")
    files = n.select(col("n_nationkey").cast("bigint").alias("id"), F.concat(lit("src/"), "n_name", F.get(F.array(lit(".rs"), lit(".RS"), lit(".py")), col("n_nationkey") % 3)).alias("path"))

    def symbols(name: str, key: str, nation: str, ident):
        kind = F.get(F.array(*[lit(k) for k in ("function", "function", "struct", "constant", "trait")]), (col(key) % 5).cast("int"))
        return read(spark, sf, name).select(ident.cast("bigint").alias("id"), col(nation).cast("bigint").alias("file_id"), kind.alias("type"), F.concat(lit(f"{name}_"), col(key).cast("string")).alias("name"), F.when(col(key) % 4 > 0, F.concat(lit("a.b."), col(key).cast("string"))).alias("qualified_name"))

    own = symbols("customer", "c_custkey", "c_nationkey", col("c_custkey") * 2).unionByName(symbols("supplier", "s_suppkey", "s_nationkey", col("s_suppkey") * 2 + 1))
    o = read(spark, sf, "orders").select(col("o_orderkey").alias("id"), (col("o_custkey") * 2).alias("source_id"), ((col("o_orderkey") % 90 + 1) * 2 + 1).alias("target_id"), F.when(col("o_orderkey") % 3 > 0, "calls").otherwise("imports").alias("relation"))
    snapshot.write(files, own, o, path, "abc123")
    return path


_SNAPSHOT = """with n as (select c_custkey * 2 as id, c_nationkey as file, c_custkey as k, 'customer' as t from customer union all select s_suppkey * 2 + 1, s_nationkey, s_suppkey, 'supplier' from supplier),
  y as (select id, ['function', 'function', 'struct', 'constant', 'trait'][k % 5 + 1] as type, concat('src/', n_name, case n_nationkey % 3 when 0 then '.rs' else '.RS' end) as path, case when k % 4 > 0 then concat('a::b::', k) else concat(t, '_', k) end as name from n join nation on file = n_nationkey where n_nationkey % 3 < 2 and k % 5 <> 3),
  z as (select distinct concat('sym:rust:', a.path, '#', a.name) as src, concat('sym:rust:', b.path, '#', b.name) as dst from orders join y a on a.id = o_custkey * 2 join y b on b.id = (o_orderkey % 90 + 1) * 2 + 1 where o_orderkey % 3 > 0 and a.type = 'function' and b.type = 'function') """


@query(_SNAPSHOT + "select id, type, path, name, concat('sym:rust:', path, '#', name) as key from y")
def snapshot_symbols(spark, sf):
    path = _snapshot(spark, sf)
    return snapshot.symbols(snapshot.table(spark, path, "files"), snapshot.table(spark, path, "nodes"))


@query(_SNAPSHOT + "select (select count(*) from z where length(src) % 2 = 0) as matched, (select count(distinct dst) from z where length(src) % 2 = 0) as only_ours, (select count(*) from z where length(src) % 2 = 1) as only_theirs")
def call_agreement(spark, sf):
    """Calls of a snapshot against ours, which lack some of them and have others."""
    path = _snapshot(spark, sf)
    theirs = snapshot.calls(snapshot.symbols(snapshot.table(spark, path, "files"), snapshot.table(spark, path, "nodes")), snapshot.table(spark, path, "edges"))
    some = theirs.filter(F.length("src") % 2 == 0)
    return snapshot.call_agreement(some.unionByName(some.select(lit("sym:rust:ours.rs#f").alias("src"), "dst")), theirs)

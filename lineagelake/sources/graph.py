"""Nodes and edges of the provenance graph, bound to plain Parquet tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = ["key", "kind", "name", "path", "lang", "blob_hash", "provenance"]
EDGE = ["src", "dst", "kind", "provenance", "confidence", "src_ref"]
PROVENANCE = ("derived", "authored", "inferred")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def keyed(kind: str, column: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def _node(df: DataFrame, kind: str, ident: str, name: str, path: Column, lang: Column | None = None, blob: Column | None = None, provenance: str = "derived", extra: list[Column] | None = None) -> DataFrame:
    return df.select(
        keyed(kind, ident).alias("key"), F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"), path.alias("path"),
        (F.lit(None).cast("string") if lang is None else lang).alias("lang"), F.md5(F.coalesce(F.col(name).cast("string") if blob is None else blob, F.lit(""))).alias("blob_hash"), F.lit(provenance).alias("provenance"), *(extra or []),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with the name of their region; 25 rows in every size of the tables."""
    region = read(spark, sf_dir, "region")
    return read(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))


#: The table, id column and provenance of each kind of node.
KINDS = {
    "region": ("region", "r_regionkey", "derived"), "nation": ("nation", "n_nationkey", "derived"), "customer": ("customer", "c_custkey", "derived"), "supplier": ("supplier", "s_suppkey", "derived"),
    "part": ("part", "p_partkey", "derived"), "order": ("orders", "o_orderkey", "authored"), "file": ("documents", "doc_id", "derived"),
}


def parsed(key: str) -> tuple[str, int | None]:
    """Kind and id of a key; the id is null where the key can name no row."""
    kind, _, ident = key.partition(":")
    return kind, int(ident) if kind in KINDS and ident.removeprefix("-").isdecimal() and str(int(ident)) == ident else None


def nodes(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] | None = None, key: str | None = None, path: str | None = None, provenance: str | None = None) -> DataFrame:
    """All nodes, or those of some kinds, of one key, path or provenance; only the tables that can hold them are read.

    Filters by key and path are on the tables' own columns where they can be, so that the scan gets them.
    """
    place = places(spark, sf_dir)
    inside = F.concat_ws("/", "r_name", "n_name")
    only, ident = parsed(key) if key is not None else (None, None)
    # what a path beginning with this word says of a column
    told = {"part": ("part/", "p_brand"), "order": ("orders/", "o_orderstatus")}

    def rows(kind: str) -> DataFrame:
        table, column, _ = KINDS[kind]
        df = read(spark, sf_dir, table)
        if only is not None:
            df = df.filter(F.col(column) == ident)
        if path is not None and kind in told:
            start, field = told[kind]
            df = df.filter(F.col(field) == path.removeprefix(start) if path.startswith(start) else F.lit(False))
        if path is not None and kind == "file":
            name = path.rpartition("/")[2].removesuffix(".txt")
            df = df.filter(F.col("doc_id") == int(name) if name.isdecimal() else F.lit(False))
        return df

    made = {
        "region": lambda df: _node(df, "region", "r_regionkey", "r_name", F.col("r_name")),
        "nation": lambda df: _node(df.join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")), "nation", "n_nationkey", "n_name", inside),
        "customer": lambda df: _node(df.join(place, F.col("c_nationkey") == F.col("n_nationkey")), "customer", "c_custkey", "c_name", F.concat(inside, F.lit("/customer"))),
        "supplier": lambda df: _node(df.join(place, F.col("s_nationkey") == F.col("n_nationkey")), "supplier", "s_suppkey", "s_name", F.concat(inside, F.lit("/supplier"))),
        "part": lambda df: _node(df, "part", "p_partkey", "p_name", F.concat(F.lit("part/"), F.col("p_brand"))),
        "order": lambda df: _node(df, "order", "o_orderkey", "o_orderpriority", F.concat(F.lit("orders/"), F.col("o_orderstatus")), provenance="authored"),
        "file": lambda df: _file(df).select(*NODE),
    }
    wanted = [k for k in made if (kinds is None or k in kinds) and (only is None or (k == only and ident is not None)) and (provenance is None or KINDS[k][2] == provenance)]
    if not wanted:
        return made["region"](read(spark, sf_dir, "region")).filter("false")
    out = union(*[made[k](rows(k)) for k in wanted])
    return out if path is None else out.filter(F.col("path") == path)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File nodes with ``content`` and ``lines``."""
    return _file(read(spark, sf_dir, "documents"))


def _file(docs: DataFrame) -> DataFrame:
    path = F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    lines = F.char_length("text") - F.char_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return _node(docs.withColumn("file", name), "file", "doc_id", "file", path, F.col("lang"), F.col("text"), extra=[F.col("text").alias("content"), lines.cast("bigint").alias("lines")])


def _edge(df: DataFrame, src: Column, dst: Column, kind: str, provenance: str = "derived", confidence: Column | None = None, src_ref: str | None = None) -> DataFrame:
    none = F.lit(None).cast("double")
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), F.lit(provenance).alias("provenance"), (none if confidence is None else confidence).alias("confidence"), F.lit(src_ref).cast("string").alias("src_ref"))


def edges(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] | None = None, src: str | None = None, dst: str | None = None, provenance: str | None = None) -> DataFrame:
    """All edges, or those of some kinds, of one source or target key or of one provenance.

    A key filters the id column of the tables that hold edges of its kind, so the scan gets it and no other table is read.
    """
    table = lambda name: read(spark, sf_dir, name)

    def ends(df: DataFrame, a: str, b: str, ident_a: int | None, ident_b: int | None) -> DataFrame:
        for column, ident in ((a, ident_a), (b, ident_b)):
            df = df if ident is None else df.filter(F.col(column) == ident)
        return df

    def bought(ident_a: int | None, ident_b: int | None) -> DataFrame:
        orders, line = table("orders").select("o_orderkey", "o_custkey"), table("lineitem").select("l_orderkey", "l_partkey")
        orders = orders if ident_a is None else orders.filter(F.col("o_custkey") == ident_a)
        line = line if ident_b is None else line.filter(F.col("l_partkey") == ident_b)
        return orders.join(line, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey").distinct()

    def plain(name: str, a: str, b: str):
        return lambda x, y: ends(table(name), a, b, x, y)

    share = (F.col("s_suppkey") % 100) / F.lit(100.0)
    # kind, source's kind and column, target's kind and column, provenance, confidence, reference, rows
    made = [
        ("contains", "region", "n_regionkey", "nation", "n_nationkey", "derived", None, None, plain("nation", "n_regionkey", "n_nationkey")),
        ("contains", "nation", "c_nationkey", "customer", "c_custkey", "derived", None, None, plain("customer", "c_nationkey", "c_custkey")),
        ("contains", "nation", "s_nationkey", "supplier", "s_suppkey", "derived", None, None, plain("supplier", "s_nationkey", "s_suppkey")),
        ("calls", "customer", "o_custkey", "part", "l_partkey", "derived", None, None, bought),
        ("calls", "part", "l_partkey", "supplier", "l_suppkey", "derived", None, None, lambda x, y: ends(table("lineitem").select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey", x, y).distinct()),
        ("references", "customer", "o_custkey", "order", "o_orderkey", "authored", None, None, plain("orders", "o_custkey", "o_orderkey")),
        ("related", "supplier", "s_suppkey", "region", "n_regionkey", "inferred", share, "embedding:hash/v1", lambda x, y: ends(table("supplier").join(table("nation"), F.col("s_nationkey") == F.col("n_nationkey")), "s_suppkey", "n_regionkey", x, y)),
    ]
    (src_kind, src_id), (dst_kind, dst_id) = [parsed(k) if k is not None else (None, None) for k in (src, dst)]
    out = []
    for kind, a_kind, a, b_kind, b, prov, confidence, ref, rows in made:
        if (kinds and kind not in kinds) or (provenance and prov != provenance) or (src is not None and (src_kind != a_kind or src_id is None)) or (dst is not None and (dst_kind != b_kind or dst_id is None)):
            continue
        out.append(_edge(rows(src_id, dst_id), keyed(a_kind, a), keyed(b_kind, b), kind, prov, confidence, ref))
    return union(*out) if out else _edge(table("nation"), keyed("region", "n_regionkey"), keyed("nation", "n_nationkey"), "contains").filter("false")


def valid(edge: DataFrame) -> Column:
    """The store's rule: a confidence in [0, 1] exactly where an edge is inferred."""
    inferred = F.col("provenance") == "inferred"
    return F.when(inferred, F.coalesce(F.col("confidence").between(0, 1), F.lit(False))).otherwise(F.col("confidence").isNull()) & F.col("provenance").isin(*PROVENANCE)

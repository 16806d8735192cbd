"""Fact layers: upserts, reconciliation, imports, findings and their correspondence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.components import components
from ..sources.graph import valid


def upsert(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Last write of each key; ``max_by`` combines before the shuffle, so hot keys cost a row a task."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*key, "r.*")


def insert_edges(rows: DataFrame, seq: str) -> DataFrame:
    """Valid edges, the first write of each (src, dst, kind, provenance)."""
    quad = ["src", "dst", "kind", "provenance"]
    rest = [c for c in rows.columns if c not in quad]
    return rows.filter(valid(rows)).groupBy(*quad).agg(F.min_by(F.struct(*rest), seq).alias("r")).select(*quad, "r.*")


def reconcile(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``op`` (insert, update, delete, keep) per key that turns ``old`` into ``new``."""
    rest = [c for c in new.columns if c not in key]
    a = old.select(*key, F.struct(*rest).alias("was"), F.lit(True).alias("in_old"))
    b = new.select(*key, F.struct(*rest).alias("now"), F.lit(True).alias("in_new"))
    op = F.when(F.col("in_old").isNull(), "insert").when(F.col("in_new").isNull(), "delete").when(F.col("was").eqNullSafe(F.col("now")), "keep").otherwise("update")
    return a.join(b, key, "full_outer").select(*key, op.alias("op"))


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, status`` of changed paths between two listings of ``path, blob``; a rename is a delete and an add."""
    both = old.select("path", F.col("blob").alias("was")).join(new.select("path", F.col("blob").alias("now")), "path", "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").otherwise("modified")
    return both.filter(~F.col("was").eqNullSafe(F.col("now"))).select("path", status.alias("status"))


def import_layer(edges: DataFrame, nodes: DataFrame, layer: DataFrame, src_ref: str) -> tuple[DataFrame, DataFrame]:
    """Edges after an import layer replaced its own, and one row with what was kept and pruned for missing ends."""
    keys = nodes.select("key")
    kept = layer.join(keys, layer["src"] == keys["key"], "left_semi").join(keys, layer["dst"] == keys["key"], "left_semi")
    out = edges.filter(~F.col("src_ref").eqNullSafe(F.lit(src_ref))).unionByName(kept)
    counts = layer.agg(F.count("*").alias("total")).crossJoin(kept.agg(F.count("*").alias("kept")))  # one row each
    return out, counts.select("kept", (F.col("total") - F.col("kept")).alias("pruned"))


def import_facts(nodes: DataFrame, edges: DataFrame, facts: DataFrame, layer: DataFrame, src_ref: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`import_layer` with the layer's own nodes, which replace those of their keys before its edges are judged."""
    every = nodes.join(facts.select("key"), "key", "left_anti").select(*nodes.columns).unionByName(facts.select(*nodes.columns).dropDuplicates(["key"]))
    out, counts = import_layer(edges, every, layer, src_ref)
    return every, out, counts


#: Severities from worst to least.
SEVERITY = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}


def severity_rank(level: Column) -> Column:
    rank = F.lit(0)
    for name, value in SEVERITY.items():
        rank = F.when(F.lower(level) == name, value).otherwise(rank)
    return rank


def page_findings(findings: DataFrame, size: int) -> DataFrame:
    """The first ``size`` findings of each layer by severity and key, with what is left out."""
    order = Window.partitionBy("layer").orderBy(severity_rank(F.col("severity")).desc(), F.asc("key"))
    out = findings.withColumn("place", F.row_number().over(order)).join(findings.groupBy("layer").agg(F.count("*").alias("n")), "layer")
    return out.filter(F.col("place") <= size).select("layer", "key", "severity", F.col("place").cast("bigint").alias("place"), F.greatest(F.lit(0), F.col("n") - size).alias("omitted"))


def corroborated(findings: DataFrame, by: list[str]) -> DataFrame:
    """Correspondences across analyzers: aliases, canonical id and how many analyzers agree."""
    preferred = F.min(F.when(F.col("rule").startswith("RUSTSEC-"), F.col("rule")))
    out = findings.groupBy(*by).agg(F.countDistinct("analyzer").alias("confirmed_by"), F.array_sort(F.collect_set("rule")).alias("aliases"), F.coalesce(preferred, F.min("rule")).alias("canonical"))
    return out.filter("confirmed_by >= 2")


def correspondences(findings: DataFrame) -> DataFrame:
    """``row, group`` of findings that share an identifier within (package, version), transitively; the group is named by its least row.

    Rows and identifiers are the two sides of a graph whose components are the groups, so a package that holds a third of all rows is no single task's work.
    """
    named = F.concat_ws("\x1f", F.lit("i"), F.col("package").cast("string"), F.col("version").cast("string"), F.col("i"))
    told = findings.select("row", "package", "version", F.explode("ids").alias("i")).filter("i is not null")
    links = told.select(F.concat(F.lit("r"), F.lpad(F.col("row").cast("string"), 20, "0")).alias("u"), named.alias("v"), "row")
    of = components(links.select("u", "v"))
    labelled = links.select("u", "row").distinct().join(of, F.col("u") == F.col("node")).select("row", "label")
    groups = labelled.groupBy("label").agg(F.min("row").alias("group"))
    found = labelled.join(groups, "label").select("row", "group").distinct()
    return findings.select("row").distinct().join(found, "row", "left").select("row", F.coalesce("group", "row").alias("group"))


def apply_facts(nodes: DataFrame, edges: DataFrame, facts: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after a set of facts: its nodes replace those of their keys, and its valid edges are added where there is none of their (src, dst, kind, provenance).

    ``facts`` and ``links`` carry ``seq``; of nodes the last, of edges the first counts. Edges whose ends are missing then are an error of the
    caller, told by :func:`dangling`.
    """
    fresh = upsert(facts, ["key"], "seq").select(*nodes.columns)
    quad = ["src", "dst", "kind", "provenance"]
    new = insert_edges(links, "seq").select(*edges.columns)
    return nodes.join(fresh.select("key"), "key", "left_anti").select(*nodes.columns).unionByName(fresh), edges.unionByName(new.join(edges.select(*quad), quad, "left_anti").select(*edges.columns))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    keys = nodes.select("key")
    there = edges.join(keys, edges["src"] == keys["key"], "left_semi").join(keys, edges["dst"] == keys["key"], "left_semi")
    return edges.join(there.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select(*edges.columns)


def reapply_imports(nodes: DataFrame, edges: DataFrame, layer_nodes: DataFrame, layer_edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph with all import layers applied again, and one row: layers, nodes, edges applied and pruned.

    All layers' nodes come first, so layers may refer to each other; of a key in several layers that of the last ``src_ref`` counts. A node tagged
    ``derived`` becomes ``authored``, as no layer derives. Edges whose ends are missing are pruned.
    """
    told = F.when(F.col("provenance") == "derived", "authored").otherwise(F.col("provenance"))
    fresh = upsert(layer_nodes.withColumn("provenance", told), ["key"], "src_ref").select(*nodes.columns)
    every = nodes.join(fresh.select("key"), "key", "left_anti").select(*nodes.columns).unionByName(fresh)
    keys = every.select("key")
    kept = layer_edges.join(keys, layer_edges["src"] == keys["key"], "left_semi").join(keys, layer_edges["dst"] == keys["key"], "left_semi")
    refs = layer_nodes.select("src_ref").unionByName(layer_edges.select("src_ref")).agg(F.countDistinct("src_ref").alias("layers"))
    counts = refs.crossJoin(layer_nodes.agg(F.count("*").alias("nodes"))).crossJoin(layer_edges.agg(F.count("*").alias("all"))).crossJoin(kept.agg(F.count("*").alias("applied")))  # one row each
    return every, edges.unionByName(kept.select(*edges.columns)), counts.select("layers", "nodes", "applied", (F.col("all") - F.col("applied")).alias("pruned"))


def across_analyzers(findings: DataFrame, by: list[str]) -> DataFrame:
    """Correspondences with any number of analyzers, those that most confirm first; none unless two analyzers occur at all."""
    preferred = F.min(F.when(F.col("rule").startswith("RUSTSEC-"), F.col("rule")))
    out = findings.groupBy(*by).agg(F.countDistinct("analyzer").alias("confirmed_by"), F.array_sort(F.collect_set("rule")).alias("aliases"), F.coalesce(preferred, F.min("rule")).alias("canonical"))
    several = findings.agg((F.countDistinct("analyzer") >= 2).alias("several"))
    return out.crossJoin(F.broadcast(several)).filter("several").drop("several").orderBy(F.desc("confirmed_by"), *by)  # one row


def without_layer(edges: DataFrame, src_ref: str) -> DataFrame:
    """Edges but for those of one layer."""
    return edges.filter(~F.col("src_ref").eqNullSafe(F.lit(src_ref)))


def listed_layers(findings: DataFrame, analyzer: str | None = None) -> DataFrame:
    """Findings of an analyzer or all, by layer and key."""
    return (findings if analyzer is None else findings.filter(F.col("analyzer") == analyzer)).orderBy("layer", "key")


def replaced_layer(stored: DataFrame, layer: str, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings with those of a layer replaced, and one row: how many went, how many came, and how many keys are in both."""
    old, rest = stored.filter(F.col("layer") == layer), stored.filter(~F.col("layer").eqNullSafe(F.lit(layer)))
    new = fresh.select(*stored.columns)
    both = old.select("key").join(new.select("key"), "key", "left_semi")
    counts = old.agg(F.count("*").alias("removed")).crossJoin(new.agg(F.count("*").alias("inserted"))).crossJoin(both.agg(F.count("*").alias("replaced")))  # one row each
    return rest.unionByName(new), counts

"""Keeping a derived graph in step with its sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fnv1a_hex
from ..functions.text import normal_url, repository
from ..plans.lineage import settle
from ..plans.skew import sifted
from .layers import tree_diff
from .lenses import endpoints


def to_extract(blobs: DataFrame, cached: DataFrame) -> DataFrame:
    """Blobs whose cache key isn't there yet."""
    return blobs.join(cached.select("cache_key"), "cache_key", "left_anti")


def incremental(nodes: DataFrame, edges: DataFrame, touched: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after the facts of touched paths are replaced; edges to what is gone go with it, imports without an edge are pruned."""
    gone = nodes.join(touched.select("path"), "path", "left_semi").select("key")
    kept = nodes.join(touched.select("path"), "path", "left_anti").unionByName(new_nodes)
    rest = edges.join(gone, edges["src"] == gone["key"], "left_anti").join(gone, edges["dst"] == gone["key"], "left_anti").unionByName(new_edges)
    targets = rest.select(F.col("dst").alias("key")).distinct()
    loose = kept.filter("kind = 'import' and path is null").join(targets, "key", "left_anti").select("key")
    return kept.join(loose, "key", "left_anti"), rest


def cache_key(path: Column, oid: Column, version: int, env: Column) -> Column:
    """Key of a blob's facts at a path: its oid, a hash of the path, the extractor's version and its environment (a 64-bit number)."""
    return F.concat(oid, F.lit("-"), fnv1a_hex(path), F.lit(f"-v{version}-e"), F.lpad(F.lower(F.hex(env)), 16, "0"))


#: Fixed value: versions count features in steps of this above the generation.
STRIDE = 100


def generation(key: Column) -> Column:
    """Generation in a cache key that ends in ``-v<number>-e<16 hex digits>``, without the feature namespace; null for any other key."""
    number = F.nullif(F.regexp_extract(key, r"-v([0-9]+)-e[0-9A-Fa-f]{16}\z", 1), F.lit("")).try_cast("bigint")
    return F.when(number < 2**32, (number % STRIDE).cast("int"))


def sweep(keys: DataFrame, current: int, recent: int) -> DataFrame:
    """``key, fate``: current, recent, ahead and unrecognised keys stay, superseded ones go."""
    v = generation(F.col("key"))
    fate = F.when(v.isNull(), "unrecognised").when(v == current, "current").when(v > current, "ahead").when(v >= max(0, current - recent), "recent").otherwise("superseded")
    return keys.select("key", fate.alias("fate"))


def swept(keys: DataFrame, current: int, recent: int) -> DataFrame:
    """One row: keys by why they stay, those that go, and all."""
    fates = sweep(keys, current, recent)
    return fates.agg(*[F.count_if(F.col("fate") == f).alias(f) for f in ("current", "recent", "ahead", "unrecognised", "superseded")], F.count("*").alias("scanned"))


def reviewed(changes: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per changed path: its symbols (no file or marker), their distinct callers and callees, documents that govern them, and what is related."""
    own = nodes.filter("kind not in ('file', 'marker')").join(changes.select("path"), "path", "left_semi").select("key", "path")
    calls = edges.filter("kind = 'calls'")
    outs = calls.join(own, calls["src"] == own["key"]).select("path", F.col("dst").alias("o"), F.lit("callee").alias("what"))
    ins = calls.join(own, calls["dst"] == own["key"]).select("path", F.col("src").alias("o"), F.lit("caller").alias("what"))
    laws = edges.filter("provenance = 'authored'").join(own, edges["dst"] == own["key"]).select("path", F.col("src").alias("o"), F.lit("law").alias("what"))
    alike = edges.filter("kind = 'related'")
    near = [alike.join(own, alike[a] == own["key"]).select("path", F.col(b).alias("o"), F.lit("related").alias("what")) for a, b in (("src", "dst"), ("dst", "src"))]
    names = (("caller", "callers"), ("callee", "callees"), ("law", "governed_by"), ("related", "related"))
    ends = outs.unionByName(ins).unionByName(laws).unionByName(near[0]).unionByName(near[1]).distinct()
    ends = ends.groupBy("path").agg(*[F.count_if(F.col("what") == w).alias(n) for w, n in names])
    symbols = own.groupBy("path").agg(F.count("*").alias("symbols"))
    return symbols.join(ends, "path", "left").fillna(0, [n for _, n in names])


def review_items(changes: DataFrame, nodes: DataFrame, edges: DataFrame, markers: DataFrame) -> DataFrame:
    """``path, status, key, relation, other, confidence``: all that a review of changed paths (path, status) shows, one row each, however long a list is.

    Of each symbol (no file or marker) of a path that is there its ``caller``, ``callee``, ``governed_by`` and ``related`` ends, ``symbol`` for itself, and ``marker`` for the texts of ``markers`` (path, text), which are those
    that the inventory retains. A path that was deleted is a row of its own.
    """
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    there = changes.filter("status <> 'deleted'").select("path", "status")
    own = nodes.filter("kind not in ('file', 'marker')").select("key", "path").join(there, "path")
    entry = lambda name, confidence: F.struct(F.lit(name).alias("relation"), confidence.alias("confidence"))
    ends, inward = endpoints(edges).join(own, "key"), F.col("direction") == "in"
    told = F.array_compact(
        F.array(
            F.when(inward & (F.col("kind") == "calls"), entry("caller", none)), F.when(~inward & (F.col("kind") == "calls"), entry("callee", none)),
            F.when(inward & (F.col("provenance") == "authored"), entry("governed_by", none)), F.when(F.col("kind") == "related", entry("related", F.col("confidence"))),
        )
    )
    around = ends.select("path", "status", "key", "other", F.explode(told).alias("t")).select("path", "status", "key", "t.relation", "other", "t.confidence")
    selves = own.select("path", "status", "key", F.lit("symbol").alias("relation"), text.alias("other"), none.alias("confidence"))
    debt = markers.join(there, "path").select("path", "status", text.alias("key"), F.lit("marker").alias("relation"), F.col("text").alias("other"), none.alias("confidence"))
    gone = changes.filter("status = 'deleted'").select("path", "status", text.alias("key"), F.lit("deleted").alias("relation"), text.alias("other"), none.alias("confidence"))
    return around.unionByName(selves).unionByName(debt).unionByName(gone)


def decided(state: dict | None, tree: str, env: str, worktree: str) -> str:
    """What a committed sync has to do, from the state of the last one (tree, env, worktree): nothing, the changes, or all."""
    if not state or state.get("env") != env or state.get("worktree") != worktree:
        return "full"
    return "none" if state.get("tree") == tree else "incremental"


def overlaid(tree: DataFrame, dirty: DataFrame) -> DataFrame:
    """A listing (path, blob) with uncommitted changes over it: ``dirty`` has the blob of each changed path, null where it is deleted."""
    return tree.join(dirty.select("path"), "path", "left_anti").unionByName(dirty.filter("blob is not null").select("path", "blob"))


def changed_files(base: DataFrame, head: DataFrame, dirty: DataFrame | None = None) -> DataFrame:
    """Changes from a base to a head, or with ``dirty`` to the working tree over it."""
    return tree_diff(base, head if dirty is None else overlaid(head, dirty))


def submodules(files: DataFrame, links: DataFrame) -> DataFrame:
    """``path, url, sha`` of submodules: sections of ``.gitmodules`` contents with the commits of the tree's links (path, sha), either side alone too."""
    section = F.explode(F.split("content", r"(?m)^\s*(?=\[)"))
    parts = files.select(section.alias("s")).filter(F.col("s").startswith("[submodule"))
    field = lambda name: F.nullif(F.trim(F.regexp_extract("s", rf"(?m)^\s*{name}\s*=(.*)$", 1)), F.lit(""))
    told = parts.select(field("path").alias("path"), field("url").alias("url")).filter("path is not null and url is not null").dropDuplicates(["path"])
    return told.join(links.select("path", "sha"), "path", "full_outer")


def impact(changes: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``key, name, kind`` of nodes one edge from the symbols of changed paths that still exist, but for what lies in a changed path itself."""
    own = nodes.filter("kind not in ('file', 'marker')").join(changes.filter("status <> 'deleted'").select("path"), "path", "left_semi").select("key")
    own = settle(own)
    near = sifted(endpoints(edges).select("key", "other"), "key", own).join(own, "key", "left_semi").select(F.col("other").alias("key")).distinct()
    return nodes.join(near, "key", "left_semi").join(changes.select("path"), "path", "left_anti").select("key", "name", "kind")


def touched(violations: DataFrame, changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Violations (kind, path, what) of a changed path, or whose subject is a node in one."""
    paths = changes.select("path").distinct()
    subject = nodes.join(paths, "path", "left_semi").select(F.col("key").alias("what"))
    direct = violations.join(paths, "path", "left_semi").select("kind", "path", "what")
    return direct.unionByName(violations.join(paths, "path", "left_anti").join(subject, "what", "left_semi").select("kind", "path", "what"))


def pinned(submodules: DataFrame, images: DataFrame, revisions: DataFrame, hub: str, origin: str | None = None, template: str | None = None) -> DataFrame:
    """``project, revision, via``: the revision of the hub that each project deploys; projects that pin none are left out.

    A submodule whose url is the hub's origin, or whose repository is named like the hub, gives its commit. Else the tag of an image named
    like the hub, as the first that is one of ``revisions`` (name): the template with ``{tag}`` filled in, the tag, ``v`` and the tag.
    ``submodules``: project, seq, url, sha, path; ``images``: project, seq, image, tag; the first of each by ``seq`` counts.
    """
    url = F.col("url")
    named = repository(url) == hub
    ours = named | (normal_url(url) == normal_url(F.lit(origin))) if origin else named
    by_url = submodules.filter(ours & F.col("sha").isNotNull()).groupBy("project").agg(F.min_by(F.struct("sha", "path"), "seq").alias("m"))
    by_url = by_url.select("project", F.col("m.sha").alias("revision"), F.concat(F.lit("submodule "), F.coalesce("m.path", F.lit("?"))).alias("via"))
    mine = images.filter((F.substring_index("image", "/", -1) == hub) & F.col("tag").isNotNull())
    tries = [F.replace(F.lit(template), F.lit("{tag}"), F.col("tag"))] if template else []
    tries = F.array(*tries, F.col("tag"), F.concat(F.lit("v"), F.col("tag")))
    told = mine.select("project", "seq", "image", "tag", F.posexplode(tries).alias("turn", "name")).join(revisions.select("name").distinct(), "name", "left_semi")
    by_tag = told.groupBy("project").agg(F.min_by(F.struct("name", "image", "tag"), F.struct("seq", "turn")).alias("m"))
    by_tag = by_tag.select("project", F.col("m.name").alias("revision"), F.concat(F.lit("image "), "m.image", F.lit(":"), "m.tag").alias("via"))
    return by_url.unionByName(by_tag.join(by_url, "project", "left_anti"))


__all__ = ["changed_files", "decided", "generation", "impact", "incremental", "overlaid", "pinned", "reviewed", "submodules", "sweep", "swept", "to_extract", "touched", "tree_diff"]

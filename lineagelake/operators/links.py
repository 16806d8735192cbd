"""Cross-project key matching, call resolution, override matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_key, normalised_key


def match_keys(spokes: DataFrame, hub: DataFrame) -> DataFrame:
    """Best tier for each spoke key against hub keys: ``target, hub_file, tier, confidence``, nulls for orphans.

    Tier 1: equal normalised key (0.98 with equal values, else 0.90), the first hub row of a key. Tier 2: equal
    canonical key that names one key text (0.95 or 0.85). Tier 3: last token that names one key (0.55).
    ``spokes``: file, key, value; ``hub``: seq, file, key, value. The hub's maps hold one row for each key. Null values agree with nothing.
    """
    h = hub.select("seq", "file", "key", "value", normalised_key(F.col("key")).alias("norm"), canonical_key(F.col("key")).alias("canon"))
    first = F.min_by(F.struct("key", "value", "file"), "seq")
    by_norm = h.groupBy("norm").agg(first.alias("t1"))
    by_canon = h.groupBy("canon").agg(first.alias("t2"), F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo = hi").select("canon", "t2")
    last = F.substring_index("norm", ".", -1)
    by_last = h.groupBy(last.alias("last")).agg(first.alias("t3"), F.count("*").alias("n")).filter("n = 1").select("last", "t3")
    s = spokes.withColumn("norm", normalised_key(F.col("key"))).withColumn("canon", canonical_key(F.col("key"))).withColumn("last", F.substring_index("norm", ".", -1))
    s = s.join(by_norm, "norm", "left").join(by_canon, "canon", "left").join(by_last, "last", "left")
    same = lambda t: F.coalesce(F.col("value") == F.col(f"{t}.value"), F.lit(False))
    tier = F.when(F.col("t1").isNotNull(), 1).when(F.col("t2").isNotNull(), 2).when(F.col("t3").isNotNull(), 3)
    confidence = F.when(tier == 1, F.when(same("t1"), 0.98).otherwise(0.90)).when(tier == 2, F.when(same("t2"), 0.95).otherwise(0.85)).when(tier == 3, 0.55)
    return s.select("file", "key", F.coalesce("t1.key", "t2.key", "t3.key").alias("target"), F.when(F.col("t1").isNotNull(), F.col("t1.file")).when(F.col("t2").isNotNull(), F.col("t2.file")).otherwise(F.col("t3.file")).alias("hub_file"), tier.cast("int").alias("tier"), confidence.alias("confidence"))


#: Fixed value: the reference that inferred links carry as a layer.
LINKS = "import:links"


def link_facts(matches: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """Placeholder nodes of the hub's keys, and inferred ``references`` edges of matched keys to them."""
    there = F.concat(F.lit(f"{project}::cfgkey:"), "hub_file", F.lit("#"), "target")
    found = matches.filter("target is not null").withColumn("there", there)
    nodes = found.select(F.concat(F.lit("extref:"), "there").alias("key"), F.lit("external_ref").alias("kind"), F.col("there").alias("name"), F.lit("inferred").alias("provenance")).distinct()
    edges = found.select(F.concat(F.lit("cfgkey:"), "file", F.lit("#"), "key").alias("src"), F.concat(F.lit("extref:"), "there").alias("dst"), F.lit("references").alias("kind"), F.lit("inferred").alias("provenance"), "confidence", F.lit(LINKS).alias("src_ref"))
    return nodes, edges


def resolve_calls(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Distinct (caller, callee) of calls that name one function, alone or within their qualifier's scope; ``Self`` is the caller's own.

    ``functions``: key, name, scope; ``calls``: caller, name, qualifier.
    """
    own = functions.groupBy(F.col("key").alias("caller")).agg(F.min("scope").alias("own"))
    calls = calls.join(own, "caller", "left").withColumn("qualifier", F.when(F.col("qualifier") == "Self", F.col("own")).otherwise(F.col("qualifier"))).drop("own")
    one = functions.groupBy("name").agg(F.count("*").alias("n"), F.min("key").alias("alone")).withColumn("alone", F.when(F.col("n") == 1, F.col("alone"))).drop("n")
    scoped = functions.groupBy(F.col("scope").alias("qualifier"), "name").agg(F.count("*").alias("n"), F.min("key").alias("inside")).filter("n = 1").drop("n")
    found = calls.join(one, "name").join(scoped, ["qualifier", "name"], "left")
    return found.select("caller", F.coalesce("alone", "inside").alias("callee")).filter("callee is not null").distinct()


def override_cells(hub: DataFrame, matches: DataFrame) -> DataFrame:
    """One cell per hub key and spoke: ``key, spoke, value, spoke_key, confidence, provenance, differs, baseline, baseline_unknown``.

    ``hub``: key, value; ``matches``: spoke, key, value, seq and, where known, spoke_key, confidence, provenance, and ``measured`` with ``unknown``: the
    hub's value at the spoke's own revision, and whether it could not be read. Without ``measured`` a cell is held against the hub's value, which is empty where the hub lacks it.
    What is unknown differs from nothing; a null value of the hub is unknown. ``baseline`` is told where it is another than the hub's. Of several
    matches the first that differs counts, else the first.
    """
    for name, kind in (("measured", "string"), ("unknown", "boolean"), ("spoke_key", "string"), ("confidence", "double"), ("provenance", "string")):
        matches = matches if name in matches.columns else matches.withColumn(name, F.lit(None).cast(kind))
    own = hub.select("key", F.coalesce("value", F.lit("")).alias("hub_value"), F.col("value").isNull().alias("hub_unknown"))
    cells = matches.join(own, "key", "left").withColumn("hub_value", F.coalesce("hub_value", F.lit("")))
    unknown = F.coalesce("unknown", F.lit(False)) | (F.col("measured").isNull() & F.coalesce("hub_unknown", F.lit(False)))
    against = F.coalesce("measured", "hub_value")
    cells = cells.select("key", "spoke", "seq", "value", "spoke_key", "confidence", "provenance", (~unknown & ~against.eqNullSafe(F.col("value"))).alias("differs"), F.when(~unknown & (against != F.col("hub_value")), against).alias("baseline"), unknown.alias("baseline_unknown"))
    fields = ["value", "spoke_key", "confidence", "provenance", "differs", "baseline", "baseline_unknown"]
    best = F.min_by(F.struct(*fields), F.struct((~F.col("differs")).alias("same"), "seq"))
    return cells.groupBy("key", "spoke").agg(best.alias("c")).select("key", "spoke", *[F.col(f"c.{f}").alias(f) for f in fields])


def override_rows(hub: DataFrame, matches: DataFrame) -> DataFrame:
    """``key, hub_value, file, overrides``: each hub key that a spoke sets with its file, empty where matches name several, and the number of its matches."""
    named = F.when(F.col("file") != "", F.col("file"))
    per = matches.groupBy("key").agg(F.min(named).alias("least"), F.max(named).alias("most"), F.count("*").alias("overrides"))
    one = F.when(F.col("least") == F.col("most"), F.col("least")).otherwise("")
    return per.join(hub.select("key", "value"), "key", "left").select("key", F.coalesce("value", F.lit("")).alias("hub_value"), F.coalesce(one, F.lit("")).alias("file"), "overrides")


def override_matrix(hub: DataFrame, spokes: DataFrame) -> DataFrame:
    """The cells of keys that the hub has: ``key, spoke, value, differs``."""
    return override_cells(hub, spokes.join(hub.select("key"), "key", "left_semi")).select("key", "spoke", "value", "differs")


def drift_rows(hub: DataFrame, spokes: DataFrame) -> DataFrame:
    """Keys of spokes that the hub lacks, with their distinct values and whether they conflict."""
    rest = spokes.join(hub.select("key"), "key", "left_anti")
    values = F.array_sort(F.collect_set(F.when(F.col("value") != "", F.col("value"))))
    return rest.groupBy("key").agg(F.array_join(values, " | ").alias("values"), (F.size(values) > 1).alias("conflict"))


def hub_by_references(refs: DataFrame, projects: DataFrame) -> DataFrame:
    """The hosted project that most references name; ties go to the greatest name."""
    counts = refs.join(projects, refs["target"] == projects["project"], "left_semi").groupBy("target").agg(F.count("*").alias("n"))
    return counts.agg(F.max_by("target", F.struct("n", "target")).alias("hub"))


def hub_by_keys(keys: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """The project with most keys, ties to the smallest name; none unless two projects have keys, nor where there are external references at all."""
    counts = keys.groupBy("project").agg(F.count("*").alias("n"))
    if refs is not None:
        counts = counts.crossJoin(F.broadcast(refs.agg(F.count("*").alias("refs")))).filter("refs = 0")  # one row
    return counts.agg(F.when(F.count("*") >= 2, F.min_by("project", F.struct((-F.col("n")).alias("n"), "project"))).alias("hub"))


def topology(keys: DataFrame, matches: DataFrame) -> DataFrame:
    """Keys, links and drift of each project."""
    linked = matches.groupBy("project").agg(F.count("target").alias("links"), F.count_if(F.col("target").isNull()).alias("drift"))
    return keys.groupBy("project").agg(F.count("*").alias("keys")).join(linked, "project", "left").fillna(0, ["links", "drift"])


def correspond(persisted: DataFrame, live: DataFrame) -> DataFrame:
    """Persisted links, and live ones of keys that no persisted link covers."""
    rest = live.join(persisted.select("src").distinct(), "src", "left_anti")
    every = persisted.withColumn("rank", F.lit(0)).unionByName(rest.withColumn("rank", F.lit(1)))
    order = Window.partitionBy("src", "target").orderBy("rank", F.desc("confidence"))
    return every.withColumn("n", F.row_number().over(order)).filter("n = 1").select("src", "target", "confidence", (F.col("rank") == 0).alias("persisted"))

"""Calls that are resolved again only where a change can reach.

What a call names depends on the functions of its name alone and, for ``Self``, on its caller's scope. So after some paths have changed, the calls to look at
are those of these paths and those that name a function which was or is there. All others keep what they had.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALL = ["path", "caller", "name", "qualifier"]


def resolutions(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Each distinct call (path, caller, name, qualifier) with the one function it names, alone or within its qualifier's scope, or null.

    ``functions``: path, key, name, scope. ``Self`` is the caller's own scope.
    """
    functions = functions.select("path", "key", "name", "scope").distinct()
    own = functions.groupBy(F.col("key").alias("caller")).agg(F.min("scope").alias("own"))
    told = calls.select(*CALL).distinct().join(own, "caller", "left").withColumn("within", F.when(F.col("qualifier") == "Self", F.col("own")).otherwise(F.col("qualifier")))
    alone = functions.groupBy("name").agg(F.count("*").alias("n"), F.min("key").alias("alone")).filter("n = 1").drop("n")
    inside = functions.groupBy("name", F.col("scope").alias("within")).agg(F.count("*").alias("n"), F.min("key").alias("inside")).filter("n = 1").drop("n")
    out = told.join(alone, "name", "left").join(inside, ["name", "within"], "left")
    return out.select(*CALL, F.coalesce("alone", "inside").alias("callee"))


def changed_calls(old_functions: DataFrame, functions: DataFrame, calls: DataFrame, touched: DataFrame) -> DataFrame:
    """The calls, of those there are now, that changes of the paths ``touched`` can resolve otherwise."""
    paths = touched.select("path").distinct()
    moved = old_functions.join(paths, "path", "left_semi").select("key", "name").unionByName(functions.join(paths, "path", "left_semi").select("key", "name"))
    rows = calls.select(*CALL)
    of_path = rows.join(paths, "path", "left_semi")
    of_name = rows.join(moved.select("name").distinct(), "name", "left_semi")
    of_self = rows.filter("qualifier = 'Self'").join(moved.select(F.col("key").alias("caller")).distinct(), "caller", "left_semi")
    return of_path.unionByName(of_name).unionByName(of_self).distinct()


def resolved_again(resolved: DataFrame, old_functions: DataFrame, functions: DataFrame, calls: DataFrame, touched: DataFrame) -> DataFrame:
    """``resolutions(functions, calls)`` from the ``resolved`` ones of before, of which only those that can change are looked at again.

    Functions and calls hold all paths, as they are now; ``touched`` names the paths that were added, changed or deleted.
    """
    again = changed_calls(old_functions, functions, calls, touched)
    own = functions.join(again.select("name").distinct(), "name", "left_semi")
    callers = functions.join(again.filter("qualifier = 'Self'").select(F.col("caller").alias("key")).distinct(), "key", "left_semi")
    few = own.unionByName(callers).distinct()
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"a.{c}")) for c in CALL]
    kept = resolved.join(touched.select("path").distinct(), "path", "left_anti").alias("r").join(again.alias("a"), same, "left_anti")
    return kept.select(*CALL, "callee").unionByName(resolutions(few, again))


def call_edges(resolved: DataFrame) -> DataFrame:
    """The distinct derived ``calls`` of resolved calls."""
    return resolved.filter("callee is not null").select(F.col("caller").alias("src"), F.col("callee").alias("dst"), F.lit("calls").alias("kind"), F.lit("derived").alias("provenance")).distinct()


def graph_again(nodes: DataFrame, edges: DataFrame, touched: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The derived graph after the facts of touched paths were replaced: their nodes and the edges at these go, imports without an edge go, and ``calls`` are put in the place of the old ones."""
    from .sync import incremental

    rest, kept = incremental(nodes, edges.filter("kind <> 'calls'"), touched, new_nodes, new_edges)
    return rest, kept.unionByName(calls.select(*kept.columns))

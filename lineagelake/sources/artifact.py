"""Fact sets as JSON artifacts, and the append-only ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import EDGE, NODE

SCHEMA = "graph/v1"


def export(nodes: DataFrame, edges: DataFrame, path: str, tree: str) -> None:
    """Writes sorted nodes and edges as JSON lines with the schema tag and tree id in every row; both are sorted by range, not in one task."""
    tagged = lambda df: df.withColumn("schema", F.lit(SCHEMA)).withColumn("tree", F.lit(tree))
    tagged(nodes.select(*NODE).orderBy("key")).write.mode("overwrite").json(f"{path}/nodes")
    tagged(edges.select(*EDGE).orderBy("src", "dst", "kind", "provenance")).write.mode("overwrite").json(f"{path}/edges")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of an artifact; raises if any row has another schema tag."""
    kinds = {"confidence": "double"}
    out = []
    for name, columns in (("nodes", NODE), ("edges", EDGE)):
        rows = spark.read.schema(", ".join(f"{c} {kinds.get(c, 'string')}" for c in [*columns, "schema", "tree"])).json(f"{path}/{name}")
        if not rows.filter(~F.col("schema").eqNullSafe(F.lit(SCHEMA))).isEmpty():
            raise ValueError(f"{path}: not an artifact of {SCHEMA}")
        out.append(rows.select(*columns))
    return out[0], out[1]


def append_ledger(entries: DataFrame, path: str) -> None:
    """Appends entries; the column ``entry`` tells the variants apart."""
    entries.write.mode("append").json(path)


def read_ledger(spark: SparkSession, path: str, entry: str, schema: str) -> DataFrame:
    return spark.read.schema(f"entry string, {schema}").json(path).filter(F.col("entry") == entry).drop("entry")

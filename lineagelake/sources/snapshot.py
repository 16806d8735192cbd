"""Snapshots of another tool's graph: SQLite files with tables files, nodes, edges and meta, as a data source.

``spark.dataSource.register(Snapshot)``, then ``spark.read.format("graph_snapshot").option("table", "nodes").load(folder)``. A folder holds one
or more such files, each read by a task of its own; comparisons of a column with values are left to SQLite. The folder must be one that driver and executors share, as SQLite opens files by itself.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

#: The tables of a snapshot and their columns.
TABLES = {
    "files": "id bigint, path string", "nodes": "id bigint, file_id bigint, type string, name string, qualified_name string",
    "edges": "id bigint, source_id bigint, target_id bigint, relation string", "meta": "key string, value string",
}
#: The types of symbols that are compared.
SYMBOLS = ("function", "struct", "enum", "trait")
_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
ROWS = 10_000


class Snapshot(DataSource):
    @classmethod
    def name(cls) -> str:
        return "graph_snapshot"

    def schema(self) -> str:
        return TABLES[self.options["table"]]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"].removeprefix("file://").removeprefix("file:"), self.options["table"], schema)


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType):
        self.path, self.table, self.schema = path, table, schema
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in _COMPARED and len(f.attribute) == 1 and f.value is not None:
                self.where.append(f'"{f.attribute[0]}" {_COMPARED[type(f)]} ?')
                self.values.append(f.value)
            elif isinstance(f, In) and len(f.attribute) == 1 and f.value and None not in f.value:
                self.where.append(f'"{f.attribute[0]}" in ({", ".join("?" * len(f.value))})')
                self.values += f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if os.path.isfile(self.path):
            return [InputPartition(self.path)]
        return [InputPartition(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if f.endswith((".sqlite", ".db"))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        con = sqlite3.connect(f"file:{partition.value}?mode=ro", uri=True)
        try:
            there = {r[0] for r in con.execute("select name from sqlite_master where type = 'table'")}
            if missing := set(TABLES) - there:
                raise ValueError(f"{partition.value} is no snapshot: it has no table {', '.join(sorted(missing))}")
            names = [c.name for c in self.schema]
            where = f" where {' and '.join(self.where)}" if self.where else ""
            rows = con.execute(f"select {', '.join(names)} from {self.table}{where}", self.values)
            kinds = [pa.int64() if c.dataType.simpleString() == "bigint" else pa.string() for c in self.schema]
            while some := rows.fetchmany(ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*some, strict=True), kinds, strict=True)], names=names)
        finally:
            con.close()


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the snapshot at ``path``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Snapshot)
    return spark.read.format("graph_snapshot").option("table", name).load(path)


def write(files: DataFrame, nodes: DataFrame, edges: DataFrame, path: str, commit: str, shards: int = 8) -> None:
    """Writes a snapshot as ``shards`` files into a shared folder, dealt by id; a task that is run again writes its file again."""
    frames = {"files": files, "nodes": nodes, "edges": edges}
    rows = None
    for name, df in frames.items():
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        one = df.select(F.pmod(F.col("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(name).alias("name"), F.array(*[F.col(c).cast("string") for c in columns]).alias("row"))
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.unionByName(files.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit("meta").alias("name"), F.array(F.lit("snapshot_source_commit"), F.lit(commit)).alias("row")))
    target = path.removeprefix("file://").removeprefix("file:")

    def save(batches):
        shard, con, part = None, None, ""

        def done():
            if con is not None:
                con.commit()
                con.close()
                os.replace(part, f"{target}/part-{shard:05d}.sqlite")

        for batch in batches:
            for s, name, row in zip(*[batch.column(c).to_pylist() for c in ("shard", "name", "row")], strict=True):
                if s != shard:
                    done()
                    os.makedirs(target, exist_ok=True)
                    shard, part = s, f"{target}/.part-{s:05d}-{os.getpid()}-{id(batch)}"
                    con = sqlite3.connect(part)
                    for t, columns in TABLES.items():
                        con.execute(f"create table {t} ({columns.replace('bigint', 'integer').replace('string', 'text')})")
                con.execute(f"insert into {name} values ({', '.join('?' * len(row))})", row)
        done()
        yield from ()

    rows.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(save, "shard int").write.format("noop").mode("overwrite").save()


def symbols(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, type, path, name, key`` of the symbols in Rust files that are compared."""
    rust = files.filter(F.lower("path").endswith(".rs")).select(F.col("id").alias("file_id"), "path")
    full = F.replace(F.coalesce("qualified_name", "name"), F.lit("."), F.lit("::"))
    return nodes.filter(F.col("type").isin(*SYMBOLS)).join(rust, "file_id").select("id", "type", "path", full.alias("name"), F.concat(F.lit("sym:rust:"), "path", F.lit("#"), full).alias("key"))


def calls(found: DataFrame, edges: DataFrame) -> DataFrame:
    """``src, dst``: the distinct calls between functions among the :func:`symbols`."""
    own = found.filter("type = 'function'")
    src, dst = own.select(F.col("id").alias("source_id"), F.col("key").alias("src")), own.select(F.col("id").alias("target_id"), F.col("key").alias("dst"))
    return edges.filter("relation = 'calls'").select("source_id", "target_id").join(src, "source_id").join(dst, "target_id").select("src", "dst").distinct()


def call_agreement(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """One row: calls (src, dst) that both graphs have, and those of one alone."""
    both = ours.select("src", "dst").distinct().withColumn("o", F.lit(1)).join(theirs.select("src", "dst").distinct().withColumn("t", F.lit(1)), ["src", "dst"], "full_outer")
    return both.agg(F.count_if(F.col("o").isNotNull() & F.col("t").isNotNull()).alias("matched"), F.count_if(F.col("t").isNull()).alias("only_ours"), F.count_if(F.col("o").isNull()).alias("only_theirs"))

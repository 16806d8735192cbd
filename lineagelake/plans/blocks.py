"""One set of vectors against another, block to block.

Rows are packed into blocks, one row each with its numbers and components as bytes. A cell is a group of blocks of
the asked side and a share of the blocks of the other side; a task reads it as a stream, first the asked blocks, at most about ``GROUP`` rows (more, if blocks are kept narrower than their kind), then
one block after another. So a task's memory is bounded by its group, whatever the number of rows, and no row is made for a pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import settle

BLOCK, GROUP, SHARE = 1024, 16_384, 16_384


def packed(rows: DataFrame, numbers: list[str], kind: str = "float32") -> DataFrame:
    """Blocks of ``rows``: bigint columns ``numbers`` and an array ``vector``; those shorter than a block's longest end in zeros. Settled, with the number ``block``. Of whole numbers (``int64``) a block has the narrowest kind that holds all of its."""
    size = BLOCK

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                lists = part.column("vector")
                length = lists.value_lengths().to_numpy(zero_copy_only=False)
                matrix = np.zeros((part.num_rows, int(length.max())), kind)
                matrix[np.arange(matrix.shape[1]) < length[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
                own = kind if kind != "int64" else next(k for k in ("int8", "int16", "int32", "int64") if matrix.size == 0 or (np.iinfo(k).min <= matrix.min() and matrix.max() <= np.iinfo(k).max))
                columns = np.stack([part.column(c).to_numpy() for c in numbers]).astype(np.int64)
                room = part.num_rows * np.dtype(own).itemsize / np.dtype(kind).itemsize  # in rows of ``kind``
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows]), pa.array([room]), pa.array([own]), pa.array([columns.tobytes()]), pa.array([matrix.astype(own).tobytes()])], names=["n", "room", "kind", "numbers", "parts"])

    out = rows.select(*numbers, "vector").mapInArrow(run, "n bigint, room double, kind string, numbers binary, parts binary")
    return settle(out.withColumn("block", F.monotonically_increasing_id()))


class Block:
    """A block's numbers, a row for each column, and its matrix."""

    def __init__(self, row: dict):
        self.number, n = row["block"], row["n"]
        self.numbers = np.frombuffer(row["numbers"], np.int64).reshape(-1, n)
        self.parts = np.frombuffer(row["parts"], row["kind"]).reshape(n, -1)

    def products(self, other: Block) -> np.ndarray:
        """Inner products of all rows of two blocks."""
        wide = min(self.parts.shape[1], other.parts.shape[1])
        return self.parts[:, :wide] @ other.parts[:, :wide].T


def held_against(asked: DataFrame, others: DataFrame, work: Callable[[list[Block], Iterator[Block]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work(asked blocks, stream of blocks)`` in every cell: each asked block meets each other block once."""
    spark = asked.sparkSession
    many = math.ceil(asked.agg(F.coalesce(F.sum("room"), F.lit(0.0))).first()[0])
    rows, blocks = others.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = max(1, -(-many // GROUP))
    shares = max(1, min(tasks, max(-(-rows // SHARE), min(blocks, -(-tasks // groups)))))  # as many cells as tasks, if there are blocks enough

    def run(batches):
        rows = (({c: batch.column(c)[i].as_py() for c in batch.schema.names}) for batch in batches for i in range(batch.num_rows))
        now = next(rows, None)

        def rest():
            nonlocal now
            while now is not None and (now["i"], now["j"]) == cell and now["other"]:
                one = Block(now)
                now = next(rows, None)
                yield one

        while now is not None:
            cell, mine = (now["i"], now["j"]), []
            while now is not None and (now["i"], now["j"]) == cell and not now["other"]:
                mine.append(Block(now))
                now = next(rows, None)
            stream = rest()
            if mine:
                yield from work(mine, stream)
            for _ in stream:
                pass

    columns = ["n", "kind", "numbers", "parts", "block"]
    left = asked.select(F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("j"), F.lit(False).alias("other"), *columns)
    right = others.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("i"), F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int").alias("j"), F.lit(True).alias("other"), *columns)
    cells = left.unionByName(right).repartition(min(tasks, groups * shares), "i", "j").sortWithinPartitions("i", "j", "other", "block")
    return cells.mapInArrow(run, schema)

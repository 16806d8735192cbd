"""Joins on keys of which a few hold many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more than this share of all rows go by broadcast: there are at most as many as its inverse.
HOT = 1000


def counted_join(rows: DataFrame, per_key: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined with ``per_key``, one row for each value of ``key`` that says in ``count`` how many rows have it, of ``total`` in all.

    Keys with over a thousandth of the rows, of which there are fewer than a thousand in tables of any size, are joined where their rows are; the rest by a shuffle. So
    no task gets all rows of a hot key. Both frames should be settled, as each is read twice.
    """
    hot = F.col(count) * HOT > total
    few = F.broadcast(per_key.filter(hot))
    rest = rows.join(F.broadcast(per_key.filter(hot).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(per_key.filter(~hot), key))


#: Words of 64 bits in which the keys of a sift are marked: a table of this many rows, about 10 MB, is broadcast, however many keys there are.
WORDS = 1 << 18


def sift(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` with a column ``maybe``: false only where ``wanted`` (its first column) surely lacks the value of ``key``.

    Each wanted key marks a bit of a table of fixed size by its hash, so with few keys nearly all other rows are told without a shuffle; with very many most
    are true. An exact join of the true ones decides. ``wanted`` should be settled.
    """
    hashed = F.xxhash64(F.col(wanted.columns[0]).cast(rows.schema[key].dataType))
    word, bit = lambda h: F.pmod(h, F.lit(WORDS)), lambda h: F.pmod(F.shiftright(h, 18), F.lit(64)).cast("int")
    marks = wanted.select(word(hashed).alias("_word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(hashed)).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_marks"))
    told = rows.join(F.broadcast(marks), word(F.xxhash64(key)) == F.col("_word"), "left")
    return told.withColumn("maybe", F.coalesce(F.getbit("_marks", bit(F.xxhash64(key))) == 1, F.lit(False))).select(*rows.columns, "maybe")


def sifted(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` but for those of which :func:`sift` says that ``wanted`` lacks their key."""
    return sift(rows, key, wanted).filter("maybe").drop("maybe")

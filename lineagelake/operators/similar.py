"""Hashed embeddings and similar pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import DIMENSIONS, feature_sums, spaced_words, word_features, words
from ..functions.text import stem
from ..plans.blocks import held_against, packed
from ..plans.components import components
from ..plans.lineage import settle
from ..plans.skew import counted_join, sifted


def counted_features(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, feature, n``: how often each text has a feature; one that is in several words of a text has several rows.

    The texts are dealt by key, so what groups by key and feature shuffles no features. Words are counted before their trigrams are laid out.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).repartition("key")
    counts = rows.select("key", F.explode(words(F.col("text"))).alias("word")).groupBy("key", "word").agg(F.count("*").alias("n"))
    return counts.select("key", F.explode(word_features(F.col("word"))).alias("feature"), "n")


#: Bytes of texts whose features a task holds at once, or one text if it is longer.
PORTION = 2_000_000


def signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, bucket, sum``: the signed feature counts of each text, without zeros. They are summed where the text is; rows that repeat a key are added."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string()).fill_null("")
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            at = 0
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PORTION, "right")) - 1)
                row, bucket, total = feature_sums(texts.slice(at, to - at))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + at)), pa.array(bucket), pa.array(total)], names=["key", "bucket", "sum"])
                at = to

    rows = docs.select(F.col(key).alias("key"), spaced_words(F.col(text)).alias("text"))
    found = rows.mapInArrow(run, f"key {dict(docs.dtypes)[key]}, bucket bigint, sum bigint")
    return found.groupBy("key", "bucket").agg(F.sum("sum").alias("sum")).filter("sum <> 0")


def _dense(buckets: Column, values: Column, kind: str) -> Column:
    """All dimensions of sparse vectors, given as arrays of buckets and of their values."""

    def laid(at: pa.Array, of: pa.Array) -> pa.Array:
        out = np.zeros((len(at), DIMENSIONS), kind)
        row = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy(zero_copy_only=False))
        out[row, at.flatten().to_numpy(zero_copy_only=False)] = of.flatten().to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * DIMENSIONS), pa.array(out.ravel()))

    laid.__annotations__ = {"at": pa.Array, "of": pa.Array, "return": pa.Array}
    return F.arrow_udf(laid, f"array<{'bigint' if kind == 'int64' else 'double'}>")(buckets, values)


def _vectors(sparse: DataFrame, value: str, kind: str) -> DataFrame:
    """``key, vector`` of ``key, bucket`` and a value."""
    per = sparse.groupBy("key").agg(F.collect_list(F.struct("bucket", value)).alias("m"))
    return per.select("key", _dense(F.col("m.bucket"), F.col(f"m.{value}"), kind).alias("vector"))


def hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, bucket, weight``: the signed feature counts of each text, scaled to length 1; sparse, without zeros."""
    length = F.sqrt(F.sum(F.col("sum").cast("double") * F.col("sum")).over(Window.partitionBy("key")))
    return signed(docs, key, text).select("key", "bucket", (F.col("sum") / length).alias("weight"))


def _unit(parts: np.ndarray) -> np.ndarray:
    return parts / np.maximum(np.linalg.norm(parts, axis=1, keepdims=True), 1e-12)


def _least32(bound: np.ndarray) -> np.ndarray:
    """The least numbers of single precision that are no less."""
    near = bound.astype(np.float32)
    return np.where(near.astype(np.float64) < bound, np.nextafter(near, np.float32(np.inf)), near)


def _pairs(queries: DataFrame, base: DataFrame, numbers: list[str], chosen, schema: str, base_numbers: list[str] | None = None) -> DataFrame:
    """``chosen(asked block, stream of (block, similarities))`` of unit vectors; a row's similarity with its own id is -1."""

    def work(asked, others):
        for b in asked:
            b.parts = _unit(b.parts)
        held = [chosen(b) for b in asked]
        for other in others:
            other.parts = _unit(other.parts)
            for b, h in zip(asked, held, strict=True):
                sim = b.products(other)
                np.clip(sim, 0, 1, out=sim)
                if np.isin(b.numbers[0], other.numbers[0]).any():
                    sim[b.numbers[0][:, None] == other.numbers[0]] = -1
                yield from h.met(other, sim)
        for h in held:
            yield from h.told()

    return held_against(packed(queries, numbers), packed(base, base_numbers or numbers), work, schema)


def neighbours_of(queries: DataFrame, base: DataFrame, k: int, least: float) -> DataFrame:
    """For each query vector the ``k`` most similar base vectors other than itself, exactly.

    Both: ``id, vector``. Queries are the stated side and meet all rows block to block; a cell keeps the best ``k`` of each of its queries, so
    shares times queries times ``k`` rows meet, not all pairs.
    """

    class Best:
        def __init__(self, block):
            self.ids = block.numbers[0]
            self.sim, self.dst = np.full((len(self.ids), k), -1.0), np.zeros((len(self.ids), k), np.int64)

        def met(self, other, sim):
            floor = _least32(np.maximum(self.sim[:, -1], least))
            row, column = np.nonzero(sim >= floor[:, None])
            if len(row) > 8 * k * len(sim):  # as in the first blocks: of each row the best ``k`` of this block are enough, ties included
                floor = np.maximum(floor, np.partition(sim, -k, axis=1)[:, -k]) if sim.shape[1] > k else floor
                row, column = np.nonzero(sim >= floor[:, None])
            if not len(row):
                return ()
            more = np.unique(row)
            old = np.repeat(more, k)
            owner, value = np.concatenate((old, row)), np.concatenate((self.sim[more].ravel(), sim[row, column].astype(np.float64)))
            which = np.concatenate((self.dst[more].ravel(), other.numbers[0][column]))
            order = np.lexsort((which, -value, owner))
            owner, value, which = owner[order], value[order], which[order]
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            keep = place < k
            self.sim[owner[keep], place[keep]], self.dst[owner[keep], place[keep]] = value[keep], which[keep]
            return ()

        def told(self):
            row, place = np.nonzero(self.sim >= max(least, 0))
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(self.dst[row, place]), pa.array(self.sim[row, place])], names=["src", "dst", "similarity"])

    found = _pairs(queries, base, ["id"], Best, "src bigint, dst bigint, similarity double")
    order = Window.partitionBy("src").orderBy(F.desc("similarity"), "dst")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def exact_duplicates(files: DataFrame) -> DataFrame:
    """Files of the same content: one row per file of a group with its first path and the group's size; pairs are not expanded."""
    groups = files.groupBy("blob_hash").agg(F.min("key").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    return files.select("key", "blob_hash").join(groups, "blob_hash").select("key", "first", "copies")


def not_connected(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (src, dst) without an edge in either direction. Edges that none of the pairs can be are left where they are."""
    ends = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    asked = settle(pairs.select(F.xxhash64(*ends).alias("pair")))
    known = sifted(edges.select(*ends).withColumn("pair", F.xxhash64("a", "b")), "pair", asked).select("a", "b")
    return pairs.join(known, (F.least(pairs["src"], pairs["dst"]) == known["a"]) & (F.greatest(pairs["src"], pairs["dst"]) == known["b"]), "left_anti")


def node_text(name: Column, path: Column, content: Column) -> Column:
    """What of a node is embedded: its name, its file's stem and its content."""
    return F.concat_ws(" ", name, stem(path), content)


def embedded(docs: DataFrame, key: str, text: str, embed=hashed) -> DataFrame:
    """``id, vector`` of texts by an embedder: a function of (docs, key, text) that returns ``key, bucket, weight``. Texts without a weight have no vector."""
    return _vectors(embed(docs, key, text), "weight", "float64").select(F.col("key").alias("id"), "vector")


def top_and_total(rows: DataFrame, order: list[Column], limit: int) -> tuple[DataFrame, DataFrame]:
    """The best ``limit`` rows, and one row with the number of all; a limit of 0 gives no rows, but the number."""
    return (rows.orderBy(*order).limit(limit) if limit else rows.filter("false")), rows.agg(F.count("*").alias("total"))


def near_duplicates(vectors: DataFrame, asked: DataFrame, least: float = 0.9) -> DataFrame:
    """``a, b, similarity, a_copies, b_copies``: the distinct vectors of ``asked``, rows of ``vectors``, with each distinct vector at ``least`` or more, each pair once.

    A vector is named by the least id that has it, and its copies are counted; a vector of several rows is also paired with itself. No
    partner is left out; :func:`members` tells the rows of each vector.
    """
    classes = settle(vectors.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    own = settle(classes.join(asked.select("vector"), "vector", "left_semi"))
    told = classes.join(own.select("id", F.lit(1).cast("bigint").alias("own")), "id", "left").fillna(0, ["own"])

    bound = _least32(np.float64(least))

    class Every:
        def __init__(self, block):
            self.ids, self.copies = block.numbers

        def met(self, other, sim):
            ids, copies, own = other.numbers
            row, column = np.nonzero(sim >= bound)
            if (own_ := sim < 0).any():  # a vector and itself
                more = np.nonzero(own_ & (self.copies > 1)[:, None])
                row, column = np.append(row, more[0]), np.append(column, more[1])
            keep = (own[column] == 0) | (self.ids[row] <= ids[column])  # of two that are asked the lesser one tells the pair
            row, column = row[keep], column[keep]
            src, dst, mine, theirs = self.ids[row], ids[column], self.copies[row], copies[column]
            first = src <= dst
            columns = [np.where(first, src, dst), np.where(first, dst, src), np.abs(sim[row, column]).astype(np.float64), np.where(first, mine, theirs), np.where(first, theirs, mine)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "b", "similarity", "a_copies", "b_copies"])

        def told(self):
            return ()

    return _pairs(own, told, ["id", "copies"], Every, "a bigint, b bigint, similarity double, a_copies bigint, b_copies bigint", ["id", "copies", "own"])


def members(vectors: DataFrame) -> DataFrame:
    """``id, name``: each row with the least id of its vector."""
    rows = settle(vectors.select("id", F.sha2(F.array_join("vector", ","), 256).alias("vector")))
    per = settle(rows.groupBy("vector").agg(F.min("id").alias("name"), F.count("*").alias("copies")))
    return counted_join(rows, per, "vector", "copies", rows.count()).select("id", "name")


def duplicates(docs: DataFrame, percent: int = 90) -> DataFrame:
    """Near duplicates of all against all: ``key, links, exact, component`` for every row of ``docs(key, text, blob)``.

    Two rows are linked if they have the same blob, or if the cosine of their hashed embeddings is at least ``percent`` / 100, told from the
    whole counts without rounding. ``links`` is the number of rows linked with this one, ``exact`` those of them with its blob, ``component`` the
    least key that links lead to, its own included. Rows of equal vector and blob are one class, counted, never paired; classes meet block to
    block. A null blob is no one's; a null text, or one without words, is like no other.
    """
    told = docs.select("key", F.coalesce("text", F.lit("")).alias("text"), "blob")
    none = F.array_repeat(F.lit(0).cast("bigint"), DIMENSIONS)
    rows = docs.select("key", "blob").join(_vectors(signed(told, "key", "text"), "sum", "int64"), "key", "left").withColumn("vector", F.coalesce("vector", none))
    half = lambda n: F.conv(F.substring(F.md5("blob"), 1 + 15 * n, 15), 16, 10).cast("bigint")
    rows = settle(rows.withColumn("class", F.sha2(F.concat_ws("|", F.array_join("vector", ","), F.coalesce("blob", F.concat(F.lit("key "), "key"))), 256)))
    classes = rows.groupBy("class").agg(F.count("*").alias("copies"), F.min("key").alias("least"), F.first("vector").alias("vector"), F.coalesce(F.min(half(0)), F.lit(-1)).alias("b1"), F.coalesce(F.min(half(1)), F.lit(-1)).alias("b2"))
    classes = settle(classes.withColumn("number", F.monotonically_increasing_id()))
    side = packed(classes, ["number", "copies", "b1", "b2"], "int64")

    def work(asked, others):
        up: dict[int, int] = {}

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def roots(labels):
            some, place = np.unique(labels, return_inverse=True)
            return np.array([root(int(x)) for x in some], np.int64)[place]

        def batch(number, n, ends):
            columns = [np.append(number, [x for x, _ in ends]), np.append(n[0], [0] * len(ends)), np.append(n[1], [0] * len(ends))]
            root_ = pa.array([None] * len(number) + [r for _, r in ends], pa.int64())
            return pa.RecordBatch.from_arrays([*[pa.array(c.astype(np.int64)) for c in columns], root_], names=["number", "links", "exact", "root"])

        links = [np.zeros((2, len(b.numbers[0])), np.int64) for b in asked]
        mine, units = [b.numbers[0] for b in asked], [_lengths(b.parts) for b in asked]
        known = [b.numbers[2][b.numbers[2] >= 0] for b in asked]
        for other in others:
            theirs, unit, back = other.numbers[0], _lengths(other.parts), np.zeros((2, len(other.numbers[0])), np.int64)
            for k, (b, n) in enumerate(zip(asked, links, strict=True)):
                # two blocks meet as either side's asked one; the lesser asks where their numbers' sum is even, the greater where it is odd
                if b.number != other.number and ((b.number + other.number) % 2 == 0) != (b.number < other.number):
                    continue
                linked, same = _alike(b.parts, other.parts, percent, units[k], unit), None
                if np.isin(known[k], other.numbers[2]).any():
                    same = (b.numbers[2][:, None] == other.numbers[2]) & (b.numbers[3][:, None] == other.numbers[3]) & (b.numbers[2] >= 0)[:, None]
                    linked |= same
                if b.number == other.number:
                    linked &= b.numbers[0][:, None] != other.numbers[0]
                rows, columns = linked.any(axis=1), linked.any(axis=0)
                if not rows.any():
                    continue
                for place, some in ((0, linked), (1, None if same is None else linked & same)):
                    if some is not None:
                        down, across = _sums(some, b.numbers[1], other.numbers[1])
                        n[place] += down
                        if b.number != other.number:
                            back[place] += across
                if len(np.unique(np.concatenate((mine[k][rows], theirs[columns])))) < 2:
                    continue  # joined before
                mine[k], theirs = roots(mine[k]), roots(theirs)
                apart = linked & (mine[k][:, None] != theirs)
                for x, y in _forest(apart):
                    x, y = root(int(b.numbers[0][x])), root(int(other.numbers[0][y]))
                    if x != y:
                        up[max(x, y)] = min(x, y)
            if len(told := np.flatnonzero(back[0])):
                yield batch(other.numbers[0][told], back[:, told], [])
        for b, n in zip(asked, links, strict=True):
            yield batch(b.numbers[0], n, [])
        yield batch(np.zeros(0), np.zeros((2, 0)), [(x, root(x)) for x in up if root(x) != x])

    found = settle(held_against(side, side, work, "number bigint, links bigint, exact bigint, root bigint"))
    counts = found.groupBy("number").agg(F.sum("links").alias("links"), F.sum("exact").alias("exact"))
    label = components(found.filter("root is not null").select(F.col("number").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("number"), "label")
    named = settle(classes.select("number", "class", "least", "copies").join(label, "number", "left").withColumn("label", F.coalesce("label", "number")))
    per = settle(named.groupBy("label").agg(F.min("least").alias("component"), F.count("*").alias("held")))
    whole = counted_join(named, per, "label", "held", named.count()).join(counts, "number").select("class", "copies", "links", "exact", "component")
    out = counted_join(rows.select("key", "blob", "class"), settle(whole), "class", "copies", rows.count())
    more = F.col("copies") - 1
    return out.select("key", (F.col("links") + more).alias("links"), (F.col("exact") + more).alias("exact"), "component")


def _lengths(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared lengths of rows of whole numbers, and the rows scaled to length 1."""
    wide = parts.astype(np.float64)
    square = (wide**2).sum(axis=1)
    return square, (wide / np.sqrt(np.maximum(square, 1))[:, None]).astype(np.float32)


def _alike(a: np.ndarray, b: np.ndarray, percent: int, of_a: tuple | None = None, of_b: tuple | None = None) -> np.ndarray:
    """Whether the cosine of rows is at least ``percent`` / 100, exactly, for whole numbers; what is too near for floats is told again, in 64 bits and then in whole numbers."""
    (na, ua), (nb, ub) = of_a or _lengths(a), of_b or _lengths(b)
    cosine = ua @ ub.T
    near = 2e-5  # above the error of single precision
    bound = max(percent / 100, near)
    out = cosine >= np.float32(bound + 2 * near)
    open_ = np.flatnonzero(out != (cosine > np.float32(bound - 2 * near)))  # what is left is told exactly
    row, column = np.divmod(open_, cosine.shape[1])
    for at in range(0, len(row), 65_536):
        i, j = row[at : at + 65_536], column[at : at + 65_536]
        dot = np.einsum("ij,ij->i", a[i].astype(np.float64), b[j].astype(np.float64))
        ratio = dot / np.sqrt(np.maximum(na[i] * nb[j], 1))
        out[i, j] = (ratio >= percent / 100) & (dot > 0)
        for k in np.flatnonzero(np.abs(ratio - percent / 100) < 1e-9):  # too near for floats
            x, y = a[i[k]].tolist(), b[j[k]].tolist()
            d = sum(p * q for p, q in zip(x, y, strict=True))
            out[i[k], j[k]] = d > 0 and 10_000 * d * d >= percent * percent * sum(p * p for p in x) * sum(q * q for q in y)
    return out


def _sums(linked: np.ndarray, of_rows: np.ndarray, of_columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the weights of the columns linked with it, and the other way round; whole numbers."""
    kind = np.float32 if max(of_rows.sum(), of_columns.sum()) < 2**24 else np.float64
    part = linked.astype(kind)
    return (part @ of_columns.astype(kind)).astype(np.int64), (of_rows.astype(kind) @ part).astype(np.int64)


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all that ``linked`` joins: a row with its first column, and each column with the least row that leads to it."""
    rows = np.flatnonzero(linked.any(axis=1))
    m = linked[rows][:, columns] if len(columns := np.flatnonzero(linked.any(axis=0))) else linked[:0, :0]
    label, out = np.arange(len(rows)), []
    while len(rows):
        low = np.where(m, label[:, None], len(rows)).min(axis=0)
        new = np.where(m, low, len(rows)).min(axis=1)
        if (new == label).all():
            first = np.full(len(rows), -1)
            np.maximum.at(first, low, np.arange(len(columns)))  # a column of each group of rows
            out = [(int(rows[i]), int(columns[first[g]])) for i, g in enumerate(label)] + [(int(rows[g]), int(columns[c])) for c, g in enumerate(low)]
            break
        label = new
    return out

"""Hard negatives by norm-bucketed search (operator 13).

Vectors have integer components; a row's score is its inner product with the
anchor. Rows are sorted by norm and cut into buckets; a bucket's greatest norm
times the anchor's bounds every score in it. Anchors (the stated queries) are held
against the buckets in blocks, buckets of great norm first: a bucket is passed over where its bound is below the least score that is still of use,
which is the running k-th best or a window's lower limit.

1. Positives: the best rows of the anchor's label.
2. Negatives: for each positive the best rows of other labels whose score lies in the window that the positive's score sets.

A cell is a group of anchor blocks and a share of the buckets. One task reads it as a stream: the blocks, at most
about ``ANCHORS`` anchors, then bucket after bucket. It emits one row per block with the best of each anchor, and these rows are merged by block.
So no task holds more than its anchors and one bucket, and no row is made for a pair.

Defined results: rows without an id, a label or a vector, or with a null component, take no part. Components that a
shorter vector lacks count as zero, an empty vector is all zeros. A row with the anchor's own id is neither
positive nor negative to it. Rows that repeat are candidates each; repeated anchors give their rows again.
Scores that 64 bits can't hold saturate. Without anchors or rows there are none. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, settle

BUCKET, BLOCK, ANCHORS = 2048, 512, 16_384
#: Rows that a share of the buckets holds at least.
SHARE = 16_384
LEAST = np.iinfo(np.int64).min + 1
MOST = np.iinfo(np.int64).max


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """``id, label, vector`` with components floor(scale * x); rows with a null or non-finite component, or without id, label or vector, take no part."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.transform(x, lambda v: F.floor(v * scale)).alias("vector"))


def _packed(ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> list:
    """Bytes of a block, its rows by id; components as wide as they must be."""
    order = np.argsort(ids, kind="stable")
    top = max(int(matrix.max(initial=0)), -int(matrix.min(initial=0)))
    kind = next(t for t in ("<i2", "<i4", "<i8") if top <= np.iinfo(t).max or t == "<i8")
    return [ids[order].tobytes(), labels[order].tobytes(), matrix[order].astype(kind).tobytes(), kind]


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Vectors sorted by norm and cut into blocks of ``size``: the greatest norm, the number of rows, their ids, labels and components, and the block's number."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    rows = vectors.select("id", "label", "vector", norm.alias("norm"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(F.desc("norm"), F.asc("id"), F.asc("row")).sortWithinPartitions(F.desc("norm"), "id", "row")

    def cut(batches):
        held: list[pa.RecordBatch] = []
        n = 0

        def block(t):
            lists = t.column("vector").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            width = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            matrix = np.zeros((len(width), int(width.max(initial=0))), np.int64)
            matrix[np.arange(matrix.shape[1]) < width[:, None]] = flat
            whole = [float(t.column("norm")[0].as_py()), len(width), *_packed(t.column("id").to_numpy(), t.column("label").to_numpy(), matrix)]
            return pa.RecordBatch.from_pylist([dict(zip(("norm", "n", "ids", "labels", "parts", "kind"), whole, strict=True))], schema=schema)

        schema = pa.schema([("norm", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("parts", pa.binary()), ("kind", pa.string())])
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= size:
                t = pa.Table.from_batches(held)
                yield block(t.slice(0, size))
                held, n = t.slice(size).to_batches(), n - size
        if n:
            yield block(pa.Table.from_batches(held))

    out = rows.drop("row").mapInArrow(cut, "norm double, n int, ids binary, labels binary, parts binary, kind string")
    return settle(out.withColumn("block", F.monotonically_increasing_id()))


class _Block:
    """The rows of a block as arrays."""

    def __init__(self, row: dict):
        self.number, self.norm = row["block"], row["norm"]
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.parts = np.frombuffer(row["parts"], row["kind"]).reshape(len(self.ids), -1)
        self.top = max(int(self.parts.max(initial=0)), -int(self.parts.min(initial=0)))

    def floats(self) -> np.ndarray:
        return self.parts.astype(np.float64)


def products(a: _Block, b: _Block) -> np.ndarray:
    """Exact inner products of all rows of two blocks."""
    width = min(a.parts.shape[1], b.parts.shape[1])
    if width * a.top * b.top < 2**53:
        return (a.floats()[:, :width] @ b.floats()[:, :width].T).astype(np.int64)
    whole = a.parts[:, :width].astype(object) @ b.parts[:, :width].T.astype(object) if width else np.zeros((len(a.ids), len(b.ids)), object)
    return np.clip(whole, LEAST + 1, MOST).astype(np.int64)


class Best:
    """The best ``k`` (score, id) of each of ``n`` queries so far: greater scores first, then lesser ids. Free places have the score ``LEAST``."""

    def __init__(self, n: int, k: int, scores: bytes | None = None, ids: bytes | None = None):
        self.k = k
        self.scores = np.full((n, k), LEAST) if scores is None else np.frombuffer(scores, np.int64).reshape(n, k).copy()
        self.ids = np.zeros((n, k), np.int64) if ids is None else np.frombuffer(ids, np.int64).reshape(n, k).copy()

    def needed(self) -> np.ndarray:
        """The least score that can still be of use to each query."""
        return self.scores[:, -1]

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates in columns, ``LEAST`` where they don't count."""
        least = self.needed()
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k])
        row, column = np.nonzero((scores >= least[:, None]) & (scores > LEAST))
        if not len(row):
            return
        met = np.unique(row)
        old_row = np.repeat(met, self.k)
        row = np.concatenate((old_row, row))
        score = np.concatenate((self.scores[met].ravel(), scores[row[len(old_row) :], column]))
        which = np.concatenate((self.ids[met].ravel(), ids[column]))
        order = np.lexsort((which, -score, row))
        row, score, which = row[order], score[order], which[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.scores[row[keep], place[keep]], self.ids[row[keep], place[keep]] = score[keep], which[keep]


def _limits(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest score of each positive's window; free places have an empty one."""
    p = scores.astype(object)
    lows, highs = -((-low * p) // 100), (high * p) // 100
    lows[scores == LEAST], highs[scores == LEAST] = MOST, LEAST
    return np.clip(lows, LEAST, MOST).astype(np.int64), np.clip(highs, LEAST, MOST).astype(np.int64)


def _searched(anchors: DataFrame, buckets: DataFrame, k: int, negatives: int, low: int, high: int, shares: int, groups: int) -> DataFrame:
    """``block, scores, ids``: the best of each anchor block, in all shares. Blocks with positives get negatives for each of their windows, others positives."""

    def work(batches):
        cell, blocks, best, windows = None, [], [], []

        def told():
            for b, found in zip(blocks, best, strict=True):
                scores, ids = (np.concatenate([getattr(f, c) for f in found], axis=1).tobytes() for c in ("scores", "ids"))
                yield pa.RecordBatch.from_pylist([{"block": b.number, "scores": scores, "ids": ids}], schema=pa.schema([("block", pa.int64()), ("scores", pa.binary()), ("ids", pa.binary())]))

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if (row["i"], row["j"]) != cell:
                    yield from told()
                    cell, blocks, best, windows = (row["i"], row["j"]), [], [], []
                one = _Block(row)
                if not row["candidate"]:
                    blocks.append(one)
                    if row["pscores"] is None:
                        windows.append(None)
                        best.append([Best(len(one.ids), k)])
                    else:
                        p = np.frombuffer(row["pscores"], np.int64).reshape(len(one.ids), k)
                        windows.append(_limits(p, low, high))
                        best.append([Best(len(one.ids), negatives) for _ in range(k)])
                    continue
                for b, found, window in zip(blocks, best, windows, strict=True):
                    bound = b.norm * one.norm * (1 + 1e-9) + 1  # no score is greater
                    useful = [f.needed() if window is None else np.maximum(f.needed(), window[0][:, w]) for w, f in enumerate(found)]
                    if not any((u <= bound).any() for u in useful):
                        continue
                    scores = products(b, one)
                    same = b.labels[:, None] == one.labels
                    own = b.ids[:, None] == one.ids
                    for w, (f, u) in enumerate(zip(found, useful, strict=True)):
                        rows = np.flatnonzero(u <= bound)
                        if not len(rows):
                            continue
                        s = scores[rows]
                        counts = (same[rows] if window is None else ~same[rows] & (s >= u[rows, None]) & (s <= window[1][rows, w : w + 1])) & ~own[rows]
                        part = Best(len(rows), f.k)
                        part.scores, part.ids = f.scores[rows], f.ids[rows]
                        part.add(np.where(counts, s, LEAST), one.ids)
                        f.scores[rows], f.ids[rows] = part.scores, part.ids
        yield from told()

    columns = ["norm", "ids", "labels", "parts", "kind", "block"]
    left = anchors.select("i", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("j"), F.lit(False).alias("candidate"), *columns, "pscores")
    right = buckets.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("i"), F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int").alias("j"), F.lit(True).alias("candidate"), *columns, F.lit(None).cast("binary").alias("pscores"))
    cells = left.unionByName(right).repartition(min(partitions(anchors), shares * groups), "i", "j").sortWithinPartitions("i", "j", "candidate", F.desc("norm"), "block")
    return cells.mapInArrow(work, "block bigint, scores binary, ids binary")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """``block, scores, ids`` of all shares put together, ``k`` best for each query or window."""

    def work(batches):
        number, best = None, None
        schema = pa.schema([("block", pa.int64()), ("scores", pa.binary()), ("ids", pa.binary())])

        def told():
            if best is not None:
                yield pa.RecordBatch.from_pylist([{"block": number, "scores": best.scores.tobytes(), "ids": best.ids.tobytes()}], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["scores"]) // (8 * k)
                if row["block"] != number:
                    yield from told()
                    number, best = row["block"], Best(n, k, row["scores"], row["ids"])
                    continue
                more = Best(n, k, row["scores"], row["ids"])
                score, ids = np.concatenate((best.scores, more.scores), axis=1), np.concatenate((best.ids, more.ids), axis=1)
                order = np.lexsort((ids, -score), axis=1)[:, :k]
                best.scores, best.ids = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
        yield from told()

    return settle(found.repartition("block").sortWithinPartitions("block").mapInArrow(work, "block bigint, scores binary, ids binary"))


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """For each anchor and each of its first positives, the first negatives whose score is ``low`` to ``high`` percent of the positive's.

    Both frames: ``id, label, vector`` with integers; anchors are the stated queries. Returns ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.
    """
    own = lambda df: df.select("id", "label", "vector").filter("id is not null and label is not null and vector is not null and not exists(vector, v -> v is null)")
    buckets, asked = _blocks(own(vectors), BUCKET), _blocks(own(anchors), BLOCK)
    rows, many = (df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for df in (buckets, asked))
    shares, groups = min(partitions(vectors), max(1, -(-rows // SHARE))), max(1, -(-many // ANCHORS))
    asked = asked.withColumn("i", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    search = lambda df: _searched(df, buckets, positives, negatives, low, high, shares, groups)
    top = _merged(search(asked.withColumn("pscores", F.lit(None).cast("binary"))), positives)
    asked = asked.join(top.select("block", F.col("scores").alias("pscores"), F.col("ids").alias("pids")), "block")
    found = _merged(search(asked), negatives)

    def unfolded(batches):
        for batch in batches:
            for row in batch.to_pylist():
                anchor = np.frombuffer(row["anchors"], np.int64)
                score, which = (np.frombuffer(row[c], np.int64).reshape(-1, positives, negatives) for c in ("scores", "ids"))
                pscore, pid = (np.frombuffer(row[c], np.int64).reshape(-1, positives) for c in ("pscores", "pids"))
                a, p, n = np.nonzero(score > LEAST)
                columns = [anchor[a], pid[a, p], (n + 1).astype(np.int32), which[a, p, n], pscore[a, p], score[a, p, n]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    both = asked.select("block", F.col("ids").alias("anchors"), "pscores", "pids").join(found, "block").select("anchors", "pscores", "pids", "scores", "ids")
    return both.mapInArrow(unfolded, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")

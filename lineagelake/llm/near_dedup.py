"""Near-duplicate groups by min-max hashing (operator 9).

Each permutation of the shingle hashes gives a document both its least and its
greatest value, so ``PERMUTATIONS`` evaluations make a signature of twice that
length. Bands of ``ROWS`` values name buckets. A pair at similarity 0.85 is
missed with probability (1 - 0.85**4)**20, below 1e-6.

1. Documents with equal shingle sets become one class (digest of the set).
2. Classes that share a bucket are joined into candidate clusters over stars
   to the bucket's least class; no pairs are emitted.
3. Small clusters: each shingle set is sent once, and all links of the cluster
   are confirmed on full sets in one task.
4. Large clusters (over ``BLOCK`` classes or ``BLOCK_HASHES`` hashes) are checked in pairs of
   blocks of bounded size. Over ``DIRECT`` blocks the stars are
   confirmed first: what they join needs no further check, and every other class
   is held against all classes of its cluster.

Defined results: words are compared after lowering A-Z. A text without words,
or null, has no shingles, is linked with nothing and stays. A row whose id is
null is linked with nothing and stays, its component is null. Rows that repeat
an id share its result. Further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import components
from ..plans.skew import counted_join
from .common import by_group, flat, group_bounds, lowered, mix, partitions, portions, settle, word_hashes

PERMUTATIONS, ROWS = 40, 4
BANDS = 2 * PERMUTATIONS // ROWS
BLOCK, BLOCK_HASHES = 1024, 1_000_000
#: Clusters of at most this many blocks are checked block by block at once.
DIRECT = 8
#: Ids that are sent to every task rather than joined by a shuffle, at most: 8 MB.
BROADCAST_IDS = 1_000_000
_A = np.random.default_rng(9).integers(0, 2**63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(10).integers(0, 2**63, PERMUTATIONS, np.uint64)
_C = np.random.default_rng(11).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(values: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the shingles of each row, one row after another, and each row's offsets in them."""
    data, offsets = flat(values)
    words, row, _, _ = word_hashes(lowered(data), offsets)
    n = np.bincount(row, minlength=len(values))
    first = np.cumsum(n) - n
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.cumsum(count) - count
    at = np.arange(int(count.sum())) + np.repeat(first - begin, count)
    h = np.zeros(len(at), np.uint64)
    if len(at):
        last = np.repeat(first + n, count)
        for j in range(k):
            h += np.where(at + j < last, words[np.minimum(at + j, len(words) - 1)], np.uint64(j + 1)) * _C[j]
        h = mix(h)
    for a, b in zip(begin.tolist(), (begin + count).tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[begin[count > 0]] = True
    owner = np.repeat(np.arange(len(values)), count)
    return h[new], np.append(0, np.cumsum(np.bincount(owner[new], minlength=len(values))))


def band_keys(sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have shingles and the keys of their bands."""
    filled = np.flatnonzero(np.diff(offsets))
    start = offsets[:-1][filled]
    signature = np.empty((2 * PERMUTATIONS, len(filled)), np.uint64)
    for p in range(PERMUTATIONS if len(filled) else 0):
        v = sets * _A[p] + _B[p]
        signature[p] = np.minimum.reduceat(v, start) >> np.uint64(32)
        signature[PERMUTATIONS + p] = np.maximum.reduceat(v, start) >> np.uint64(32)
    keys = np.zeros((BANDS, len(filled)), np.uint64)
    for b in range(BANDS):
        for j in range(ROWS):
            keys[b] = mix(keys[b] * _C[40] + signature[b * ROWS + j] + np.uint64(b + 1))
    return filled, keys.T.view(np.int64)


def _digests(sets: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    return [hashlib.md5(sets[a:b].tobytes()).digest() if b > a else None for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """Per row: id, ``n_shingles``, ``digest`` of the shingle set (null if it is empty) and its ``bands``."""

    def run(batches):
        for batch in portions(batches):
            sets, offsets = shingle_sets(batch.column(1), k)
            filled, keys = band_keys(sets, offsets)
            lengths = np.zeros(batch.num_rows + 1, np.int32)
            lengths[1:][filled] = BANDS
            bands = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), pa.array(keys.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(_digests(sets, offsets), pa.binary()), bands], names=["id", "n_shingles", "digest", "bands"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_shingles bigint, digest binary, bands array<bigint>")


def _sets(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """Per row: ``digest`` and ``hashes``, its shingle set as bytes."""

    def run(batches):
        for batch in portions(batches):
            sets, offsets = shingle_sets(batch.column(1), k)
            rows = [sets[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(_digests(sets, offsets), pa.binary()), pa.array(rows, pa.binary())], names=["digest", "hashes"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "digest binary, hashes binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct hashes."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def linked(sets: list[np.ndarray], percent: int, left: int | None = None) -> np.ndarray:
    """Index pairs of similar sets; with ``left``, only pairs of the first ``left`` sets with any set."""
    m = len(sets)
    if m < 2:
        return np.zeros((0, 2), np.int64)
    if m == 2:
        return np.array([[0, 1]]) if similar(sets[0], sets[1], percent) else np.zeros((0, 2), np.int64)
    left = m if left is None else left
    size = np.array([len(s) for s in sets])
    value, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), size)
    shared = count[inverse] > 1
    column = (np.cumsum(count > 1) - 1)[inverse[shared]]
    owner = owner[shared]
    common = np.zeros((left, m), np.float32)
    width = max(1, 4_000_000 // m)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        part = np.zeros((m, width), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        common += part[:left] @ part.T
    found = 100 * common >= percent * (size[:left, None] + size[None, :] - common)
    i, j = np.nonzero(found)
    return np.stack((i[i != j], j[i != j]), axis=1)


def _union(m: int, pairs: np.ndarray) -> list[int]:
    """The least index that each of ``m`` is joined with."""
    up = list(range(m))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in pairs.tolist():
        i, j = root(i), root(j)
        if i != j:
            up[max(i, j)] = min(i, j)
    return [root(x) for x in range(m)]


def _rows(batch: pa.RecordBatch, column: int = 2) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in batch.column(column).to_pylist()]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id``, ``kept``; links are 100 * intersection >= percent * union of k-word shingle sets."""
    sketch = settle(sketches(docs, id_col, text_col, k))
    nodes = sketch.filter("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    in_band = nodes.select("digest", F.explode("bands").alias("band"))
    pivots = in_band.groupBy("band").agg(F.min("digest").alias("pivot"), F.max("digest").alias("other")).filter("pivot <> other").drop("other")
    stars = settle(in_band.join(pivots, "band").filter("digest <> pivot").select(F.col("digest").alias("u"), F.col("pivot").alias("v")).distinct())
    nodes = nodes.drop("bands")
    members = settle(components(stars).select(F.col("node").alias("digest"), F.col("label").alias("cluster")).join(nodes, "digest"))
    totals = members.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    totals = settle(totals).withColumn("large", (F.col("size") > BLOCK) | ((F.col("size") > 2) & (F.col("total") > BLOCK_HASHES)))
    many = members.count()
    ids = members.select("id").distinct()
    wanted = F.broadcast(ids) if many <= BROADCAST_IDS else ids
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted, "id", "left_semi")
    sets = _sets(texts, "id", "text", k).dropDuplicates(["digest"])
    sets = settle(counted_join(members, totals, "cluster", "size", many).join(sets, "digest"))
    label = _small(sets.filter("not large").select("cluster", "digest", "hashes"), percent)
    if not totals.filter("large").isEmpty():
        label = label.unionByName(_large(sets.filter("large").select("cluster", "digest", "n", "size", "total", "hashes"), stars, percent))
    labelled = settle(nodes.select("digest", "id").join(label, "digest", "left").withColumn("label", F.coalesce("label", "digest")))
    per = settle(labelled.groupBy("label").agg(F.min("id").alias("component"), F.count("*").alias("held")))
    named = counted_join(labelled, per, "label", "held", labelled.count()).select("digest", "component")
    out = sketch.filter("digest is not null and id is not null").select("id", "n_shingles", "digest").join(named, "digest").select("id", "n_shingles", "component")
    alone = sketch.filter("digest is null or id is null").select("id", "n_shingles", F.col("id").alias("component"))
    kept = F.col("id").isNull() | (F.col("id") == F.col("component"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


def _small(sets: DataFrame, percent: int) -> DataFrame:
    """``digest, label`` in clusters that fit a task: all links, confirmed on full sets."""

    def work(batch):
        bounds = group_bounds(batch.column(0)).tolist()
        digest, hashes = batch.column(1).to_pylist(), _rows(batch)
        label = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            label += [digest[a + r] for r in _union(b - a, linked(hashes[a:b], percent))]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(label, pa.binary())], names=["digest", "label"])

    return by_group(sets, "cluster", ["digest"], work, "digest binary, label binary", size=2_000)


def _large(sets: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """``digest, label`` in large clusters, of the classes that have a link."""
    sets = sets.withColumn("blocks", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("total") / BLOCK_HASHES)))
    direct, huge = sets.filter(F.col("blocks") <= DIRECT), sets.filter(F.col("blocks") > DIRECT)
    # every block meets every block, each pair of blocks in one cell
    own = direct.select("digest", "cluster", _at("digest", 1, "blocks").alias("b"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("o"))
    cells = own.select(_cell(F.least("b", "o"), F.greatest("b", "o")).alias("cell"), "digest", (F.col("b") <= F.col("o")).alias("outer"))
    links = _held_against(cells, sets, percent)
    if not huge.isEmpty():
        links = links.unionByName(_huge_links(huge, stars, percent))
    return components(links).select(F.col("node").alias("digest"), "label")


def _at(column: str, salt: int, n: str):
    return F.pmod(F.xxhash64(column, F.lit(salt)), F.col(n))


def _cell(i, j):
    return F.concat_ws(":", F.hex("cluster"), i, j)


def _held_against(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the ``outer`` sets of each cell and all of its sets, as a forest."""

    def work(batch):
        bounds = group_bounds(batch.column(0)).tolist()
        digest, inner, hashes = batch.column(1).to_pylist(), batch.column(2).to_pylist(), _rows(batch, 3)
        u, v = [], []
        for a, b in zip(bounds, bounds[1:], strict=False):
            left = b - a - sum(inner[a:b])  # the outer ones come first
            for i, r in enumerate(_union(b - a, linked(hashes[a:b], percent, left))):
                if digest[a + i] != digest[a + r]:
                    u.append(digest[a + i])
                    v.append(digest[a + r])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    full = cells.withColumn("inner", ~F.col("outer")).join(sets.select("digest", "hashes"), "digest").select("cell", "digest", "inner", "hashes")
    return by_group(full, "cell", ["inner", "digest"], work, "u binary, v binary", size=BLOCK)


def _huge_links(sets: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """Links in clusters of many blocks: first the stars, then all classes outside a cluster's main component against all."""

    def confirm(batches):
        for batch in batches:
            ok = [similar(a, b, percent) for a, b in zip(_rows(batch, 2), _rows(batch, 3), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    def ends(name):
        return sets.select(F.col("digest").alias(name), F.col("hashes").alias(f"h{name}"))

    pairs = stars.join(ends("u"), "u").join(ends("v"), "v").select("u", "v", "hu", "hv")
    links = settle(pairs.mapInArrow(confirm, "u binary, v binary"))
    first = components(links).select(F.col("node").alias("digest"), "label")
    first = settle(sets.drop("hashes").join(first, "digest", "left").withColumn("label", F.coalesce("label", "digest")))
    main = first.groupBy("cluster", "label").agg(F.count("*").alias("c")).groupBy("cluster").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("held"))
    main, many = settle(main), first.count()
    first = settle(counted_join(first, main, "cluster", "held", many).withColumn("outer", F.col("label") != F.col("main")).drop("main", "held"))
    outer = first.filter("outer").groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_HASHES)).alias("rows"))
    grid = counted_join(first, settle(outer.join(main.select("cluster", "held"), "cluster")), "cluster", "held", many)
    across = grid.filter("outer").select("digest", F.lit(True).alias("outer"), _at("digest", 1, "rows").alias("i"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("j"), "cluster")
    down = grid.select("digest", F.lit(False).alias("outer"), F.explode(F.expr("sequence(0, rows - 1)")).alias("i"), _at("digest", 2, "blocks").alias("j"), "cluster")
    cells = across.unionByName(down).select(_cell("i", "j").alias("cell"), "digest", "outer")
    return links.unionByName(_held_against(cells, sets, percent))

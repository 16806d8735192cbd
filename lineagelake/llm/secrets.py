"""Secret scans with corpus-wide ownership frequency (operator 3).

Each text is scanned once for assignments, access keys and hexadecimal runs,
and for long mixed tokens as further candidates. Every candidate value is
hashed, and the hashes are counted by distinct repositories (documents, by their ids) and
distinct owners (sources). A value is a widely copied example if ``COPIED`` owners hold it, or if more than one
does and ``WIDE`` repositories do; every other is owner-specific and looks live, in however many of its owner's repositories
it stands. Long tokens become spans only where they are owner-specific; the base spans always stay.

Pairs of value and repository, and of value and owner, are made distinct before values meet, so a value that a
third of all rows hold is counted in all tasks and costs its own a row for each of them.

Defined results: null text counts as empty. Rows whose id is null
are repositories of their own, and a null owner is an owner. Positions are code points,
ends are exclusive. Further columns are not read by :func:`scan`; :func:`redacted` passes them on, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import counted_join
from .common import portions, settle

COPIED, WIDE = 3, 20
KINDS = ("assign", "access", "hex", "token")
# The patterns of the base kinds and the words that an assignment needs.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_LONG = re.compile(r"[A-Za-z0-9+/_-]{16,}")


def _mixed(value: str) -> bool:
    """Whether a token of 24 characters or more has digits, both cases and an entropy of 3.5 bits a character."""
    if len(value) < 24 or not (any(c.isdigit() for c in value) and any(c.isupper() for c in value) and any(c.islower() for c in value)):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= 3.5


def find(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, kind's place in KINDS, end, value)`` of all candidates of a text, in order."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    # access keys and hexadecimal runs lie within runs of the wider class
    for run in _LONG.finditer(text):
        a, b = run.span()
        inner = [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text, a, b) if m.end() - m.start() >= 16]
        inner += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text, a, b)]
        if not inner and _mixed(run[0]) and not any(s < b and a < e for s, _, e, _ in out):
            inner = [(a, 3, b, run[0])]
        out += inner
    return sorted(out)


def _scanned(docs: DataFrame, keep: list[str], id_col: str, text_col: str, owner_col: str | None) -> DataFrame:
    """The columns ``keep`` (as c0, c1, ...) with ``repository``, ``owner``, base counts and digest, and ``found`` candidates."""

    def run(batches):
        span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.binary())])
        for batch in portions(batches, text=0):
            rows = [find(t) for t in batch.column(0).to_pylist()]
            base = [[f for f in r if f[1] < 3] for r in rows]
            cols = [pa.array([sum(f[1] == k for f in r) for r in base], pa.int64()) for k in range(3)]
            cols.append(pa.array([hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in r).encode()).hexdigest() for r in base]))
            cols.append(pa.array([[(a, k, b, hashlib.md5(v.encode()).digest()) for a, k, b, v in r] for r in rows], pa.list_(span)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], names=[*batch.schema.names[1:], *[f"n_{k}" for k in KINDS[:3]], "base_sha256", "found"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    kept = [docs[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(keep)]
    schema = ", ".join(f"c{k} {kinds[c]}" for k, c in enumerate(keep))
    owner = docs[owner_col].cast("string") if owner_col in docs.columns else F.lit(None).cast("string")
    return docs.select(docs[text_col].alias("text"), *kept, docs[id_col].alias("repository"), owner.alias("owner")).mapInArrow(
        run, f"{schema}, repository {kinds[id_col]}, owner string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, found array<struct<start:bigint,kind:int,end:bigint,value:binary>>"
    )


_SPAN = "struct<start:bigint,kind:int,end:bigint,repositories:bigint,owners:bigint,live:boolean>"


def _judged(scanned: DataFrame, copied: int, wide: int) -> DataFrame:
    """``row`` and ``spans`` (start, kind, end, repositories, owners, live) of rows with candidates."""
    held = scanned.filter("size(found) > 0")
    each = held.select("row", F.explode("found").alias("f")).select("row", "f.*")
    values = F.explode(F.array_distinct(F.transform("found", lambda f: f["value"])))
    repository = F.coalesce(F.col("repository").cast("string"), F.concat(F.lit("row "), F.col("row").cast("string")))
    once = held.select(repository.alias("repository"), F.col("repository").isNull().alias("own"), "owner", values.alias("value"))
    repositories = once.select("value", "own", "repository").distinct().groupBy("value").agg(F.count("*").alias("repositories"))
    owners = once.select("value", "owner").distinct().groupBy("value").agg(F.count("*").alias("owners"))
    held_by = each.groupBy("value").agg(F.count("*").alias("held"))
    counts = settle(repositories.join(owners, "value").join(held_by, "value"))
    many = (F.col("owners") >= copied) | ((F.col("owners") > 1) & (F.col("repositories") >= wide))
    judged = counted_join(each, counts, "value", "held", each.count()).withColumn("live", ~many)
    return judged.filter("kind < 3 or live").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "repositories", "owners", "live"))).alias("spans"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", copied: int = COPIED, wide: int = WIDE) -> DataFrame:
    """One row per row of ``docs``: id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` and ``spans``."""
    scanned = settle(_scanned(docs, [id_col], id_col, text_col, owner_col).withColumn("row", F.monotonically_increasing_id()))
    out = scanned.drop("found", "owner", "repository").join(_judged(scanned, copied, wide), "row", "left")
    none = F.array().cast(f"array<{_SPAN}>")
    return out.select(F.col("c0").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", none).alias("spans"))


def described(spans):
    """Column: ``kind:start:end`` of all spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", copied: int = COPIED, wide: int = WIDE, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every owner-specific span replaced by ``mark``; texts without one are as they were.

    The candidates are found once and settled with the rows; a second pass over these replaces. Without a column ``owner_col`` all rows have one owner.
    """
    keep = docs.columns
    scanned = settle(_scanned(docs, keep, id_col, text_col, owner_col).withColumn("row", F.monotonically_increasing_id()))
    at = keep.index(text_col)

    def replace(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(len(keep)).to_pylist(), strict=True):
                parts, done = [], 0
                for s in spans or ():
                    if s["live"] and s["start"] >= done:
                        parts += [text[done : s["start"]], mark]
                    if s["live"]:
                        done = max(done, s["end"])
                texts.append("".join(parts) + text[done:] if parts else text)
            yield batch.set_column(at, batch.schema.names[at], pa.array(texts, pa.string())).select(list(range(len(keep))))

    names = [f"c{k}" for k in range(len(keep))]
    # rows that have candidates go through the join and the replacement, the others through neither
    held = scanned.filter("size(found) > 0").select("row", *names).join(_judged(scanned, copied, wide), "row", "left").select(*names, "spans")
    schema = ", ".join(f"{n} {docs.schema[k].dataType.simpleString()}" for k, n in enumerate(names))
    out = scanned.filter("size(found) = 0").select(*names).unionByName(held.mapInArrow(replace, schema))
    return out.toDF(*keep)

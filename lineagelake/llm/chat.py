"""Chat formatting by columnar byte assembly (operator 4).

All turns of a batch are laid out as segments (mark, role, mark, text, end).
Segment lengths give cumulative offsets, these give the index each output
byte is copied from, and one gather fills one preallocated Arrow
buffer for all conversations of the batch.

Template: ``<|role|>\\n`` text ``</s>\\n`` per turn. Inside roles and texts a
backslash is doubled, and one is put after the first character of each control
string, so none of them occurs there; :func:`unescape` takes both back.

Defined results: turns go by ``turn`` (nulls first), ties by role and text;
null roles and texts are empty; rows with a null conversation form one
conversation. A conversation without rows doesn't exist, so an empty table
gives none. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, flat, group_bounds, per_row

#: Strings that mark turns here or in other common templates.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]")
_FIXED = (b"<|", b"|>\n", b"</s>\n")
#: Output bytes that are gathered at once, and bytes of turns that a task holds, if no single conversation has more.
BLOCK, HELD = 1_000_000, 16_000_000
_TURN = re.compile(r"<\|(.*?)\|>\n(.*?)</s>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(values: pa.Array) -> pa.Array:
    values = pc.replace_substring(pc.fill_null(values, ""), "\\", "\\\\")
    for c in CONTROL:
        values = pc.replace_substring(values, c, f"{c[0]}\\{c[1:]}")
    return values


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def assemble(role: pa.Array, text: pa.Array, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted conversations, and where each turn's text begins and ends in its conversation, in code points."""
    parts = [escape(role), escape(text)]
    (roles, role_at), (texts, text_at) = map(flat, parts)
    fixed = np.frombuffer(b"".join(_FIXED), np.uint8)
    source = np.concatenate((fixed, roles, texts))
    fixed_at = np.cumsum([0, *map(len, _FIXED)])
    n = len(role)
    begin, length = np.empty((n, 5), np.int64), np.empty((n, 5), np.int64)
    for column, k in ((0, 0), (2, 1), (4, 2)):
        begin[:, column], length[:, column] = fixed_at[k], len(_FIXED[k])
    begin[:, 1], length[:, 1] = len(fixed) + role_at[:-1], np.diff(role_at)
    begin[:, 3], length[:, 3] = len(fixed) + len(roles) + text_at[:-1], np.diff(text_at)
    begin, length = begin.ravel(), length.ravel()
    to = np.append(0, np.cumsum(length))
    out = np.empty(to[-1], np.uint8)
    a = 0
    while a < len(length):  # the indices take eight bytes for one, so they are made for a block of segments at once; a longer segment is copied
        b = max(a + 1, int(np.searchsorted(to, to[a] + BLOCK, "right")) - 1)
        if b == a + 1:
            out[to[a] : to[b]] = source[begin[a] : begin[a] + length[a]]
        else:
            index = np.repeat(begin[a:b] - (to[a:b] - to[a]), length[a:b])
            index += np.arange(len(index))
            out[to[a] : to[b]] = source[index]
        a = b
    offsets = to[5 * bounds]
    points = np.append(0, np.cumsum(per_row((out & 0xC0) != 0x80, to)))  # at the ends of segments
    first = np.repeat(points[5 * bounds[:-1]], np.diff(bounds))
    formatted = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out))
    return formatted, points[3:-1:5] - first, points[4::5] - first


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: id, ``n_turns``, ``formatted`` and ``loss_spans`` (code points of the texts of role ``learn``)."""

    def work(batch):
        bounds = group_bounds(batch.column(0))
        role, text = batch.column(2), batch.column(3)
        out, begin, end = assemble(role, text, bounds)
        under = pc.fill_null(pc.equal(role, learn), False).to_numpy(zero_copy_only=False)
        per = np.add.reduceat(under.astype(np.int64), bounds[:-1])
        pairs = pa.StructArray.from_arrays([pa.array(begin[under]), pa.array(end[under])], names=["start", "end"])
        spans = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)).astype(np.int32)), pairs)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(bounds[:-1])), pa.array(np.diff(bounds)), out.cast(pa.string()), spans], names=["conv", "n_turns", "formatted", "loss_spans"])

    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["conv"]
    out = by_group(rows, "conv", ["turn", "role", "text"], work, f"conv {kind}, n_turns bigint, formatted string, loss_spans array<struct<start:bigint,end:bigint>>", size=10_000, held=HELD)
    return out.withColumnRenamed("conv", conv_col)


def read_back(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(text)]


def digests(out: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What the contract asks for, read back from formatted conversations."""

    def run(batches):
        for batch in batches:
            turns, chars, loss = [], [], []
            texts = batch.column("formatted").to_pylist()
            for text, spans in zip(texts, batch.column("loss_spans").to_pylist(), strict=True):
                turns.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in read_back(text)).encode()).hexdigest())
                learned = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                chars.append(len(learned))
                loss.append(hashlib.sha256(learned.encode()).hexdigest())
            cols = [batch.column(0), batch.column(1), pa.array(turns, pa.string()), pa.array(chars, pa.int64()), pa.array(loss, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = dict(out.dtypes)[conv_col]
    return out.mapInArrow(run, f"`{conv_col}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")

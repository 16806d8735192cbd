"""Byte-level BPE encoding and decoding (operator 6).

Each short word is held as a contiguous rank array: a row of part ids and, next
to it, a row with the merge rank of every adjacent pair. The row's minimum is
found by a scan, that boundary is deleted by shifting the row left, and only
the two neighbouring ranks are looked up again. Rows of many words are kept in
one numpy matrix, so one step of Python advances all words of a batch. Words
over ``SHORT`` bytes go through a heap of (rank, boundary) instead, as repeated
scans of a long row cost its square.

The ids are those of the ``tokenizers`` library for the same file with
``add_special_tokens=False``: added tokens that occur in a text are taken out
first, longest and leftmost, and the rest is split by the byte-level pattern.

Null texts count as empty: no ids, decoded to the empty string. Ties of ranks
go to the leftmost pair.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions

SHORT = 32
NO_RANK = np.int32(2**31 - 1)
#: Cached pieces per Python worker; past it the older half is forgotten.
CACHE = 400_000
#: Fixed value: the pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file of that name is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = {chr(b): b for b in own}
    rest = [b for b in range(256) if b not in set(own)]
    return stand_in | {chr(256 + k): b for k, b in enumerate(rest)}


#: Characters of a text that are coded at once; longer texts go in parts.
PART = 1_000_000
_SAFE = regex.compile(r"(?<=[\p{L}\p{N}]) (?=[\p{L}\p{N}])|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


def parts(text: str, size: int | None = None) -> list[str]:
    """``text`` in parts of about ``size`` characters, cut only where a word of the pattern begins.

    That is at a space between two letters or digits, and between a letter and a digit. Where none is in reach the part grows to the next one,
    so only an unbroken run of letters, or of digits, or of other characters is held as a whole, however long it is.
    """
    out, at, size = [], 0, size or PART
    while len(text) - at > size:
        cut = at + size
        near = max(at + 1, cut - 4096)
        places = [m.start() for m in _SAFE.finditer(text, near, cut)]
        if places and places[-1] > at:
            cut = places[-1]
        else:
            m = _SAFE.search(text, cut)
            if m is None:
                break
            cut = m.start()
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def tokens(spec: dict) -> tuple[list[bytes], dict[str, int]]:
    """The bytes of each id of a vocabulary file, and the ids of its added tokens."""
    alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    out = [b""] * (max([*vocab.values(), *added.values()]) + 1)
    for token, i in vocab.items():
        out[i] = bytes(alphabet[c] for c in token)
    for token, i in added.items():
        out[i] = token.encode()
    return out, added


def read_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def never_cut(added: dict[str, int]) -> bool:
    """Whether a cut of :func:`parts` might fall into an added token."""
    return any(_SAFE.search(f"a{a}a") for a in added)


class ByteBPE:
    def __init__(self, path: str):
        spec = read_spec(path)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.token_bytes, self.added = tokens(spec)
        self.byte_id = np.zeros(256, np.int32)
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        key = left << 17 | right
        self._fill(key, np.arange(len(key), dtype=np.int32))
        self.pairs = dict(zip(key.tolist(), range(len(key)), strict=True))
        self.split = regex.compile(PATTERN)
        self.whole = never_cut(self.added)
        self.at_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.cache: dict[str, bytes] = {}

    # ranks of pairs: open addressing, all probes at once
    def _fill(self, key: np.ndarray, value: np.ndarray) -> None:
        bits = int(np.ceil(np.log2(len(key) * 8 + 16)))
        self.shift = np.uint64(64 - bits)
        self.slots = np.full((1 << bits) + 64, -1, np.int64)
        self.values = np.full((1 << bits) + 64, NO_RANK, np.int32)
        home = self._home(key)
        self.probes = 1
        for k, v, h in zip(key.tolist(), value.tolist(), home.tolist(), strict=True):
            p = h
            while self.slots[p] != -1:
                p += 1
            self.slots[p], self.values[p] = k, v
            self.probes = max(self.probes, p - h + 1)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 17 | right
        at = self._home(key)
        found = self.slots[at]
        out = np.where(found == key, self.values[at], NO_RANK)
        open_ = np.flatnonzero((found != key) & (found != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] += 1
            found, want = self.slots[at[open_]], key.ravel()[open_] if key.ndim > 1 else key[open_]
            hit = found == want
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def encode_words(self, raw: bytes, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words that lie one after another in ``raw``, one after another, and how many each word has."""
        flat = self.byte_id[np.frombuffer(raw, np.uint8)]
        start = np.cumsum(length) - length
        count = np.zeros(len(length), np.int64)
        done = []
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            if n > SHORT:
                for k in at.tolist():
                    ids = self._long(raw[start[k] : start[k] + n])
                    count[k] = len(ids)
                    done.append((at[at == k], ids, np.array([len(ids)])))
            elif n:
                ids, used = self._short(flat[start[at][:, None] + np.arange(n)])
                count[at] = used
                done.append((at, ids, used))
        out = np.empty(int(count.sum()), np.uint32)
        begin = np.cumsum(count) - count
        for at, ids, used in done:
            to = np.repeat(begin[at] - (np.cumsum(used) - used), used)
            out[to + np.arange(len(ids))] = ids
        return out, count

    def _short(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, n = ids.shape
        done = np.zeros((m, n), np.uint32)
        length = np.full(m, n)
        if n == 1:
            done[:] = ids
        else:
            rank = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(m, n - 1)
            rows = np.arange(m)
            while len(rows):
                col = rank.argmin(axis=1)
                here = np.arange(len(rows))
                least = rank[here, col]
                over = least == NO_RANK
                if over.any():
                    end = rows[over]
                    done[end, : ids.shape[1]] = ids[over]
                    length[end] = ids.shape[1]
                    go = ~over
                    rows, ids, rank, col, least = rows[go], ids[go], rank[go], col[go], least[go]
                    here = np.arange(len(rows))
                    if not len(rows):
                        break
                width = ids.shape[1]
                keep = np.ones(ids.shape, bool)  # delete the boundary between col and col + 1
                keep[here, col + 1] = False
                ids = ids[keep].reshape(len(rows), width - 1)
                ids[here, col] = self.merged[least]
                if width == 2:
                    done[rows, 0], length[rows] = ids[:, 0], 1
                    break
                keep = np.ones(rank.shape, bool)
                keep[here, np.minimum(col, width - 2)] = False
                rank = rank[keep].reshape(len(rows), width - 2)
                a = np.flatnonzero(col > 0)
                rank[a, col[a] - 1] = self.ranks(ids[a, col[a] - 1], ids[a, col[a]])
                a = np.flatnonzero(col < width - 2)
                rank[a, col[a]] = self.ranks(ids[a, col[a]], ids[a, col[a] + 1])
        return done[np.arange(n) < length[:, None]], length

    def _long(self, word: bytes) -> np.ndarray:
        ids: list[int] = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before, get = list(range(1, n + 1)), list(range(-1, n - 1)), self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 17 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.merged[r]), -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get(ids[i] << 17 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            if (k := before[i]) >= 0 and (r := get(ids[k] << 17 | ids[i])) is not None:
                heapq.heappush(heap, (r, k, ids[k], ids[i]))
        return np.array([x for x in ids if x >= 0], np.uint32)

    # pieces: what stands between single spaces. A space between two characters that
    # are no space always begins a word of the pattern, and so does a lone newline.
    def _pieces(self, text: str) -> list[str]:
        """Keys of the pieces of a text without added tokens: the space before a piece is left out; \x00 marks one that has none."""
        plain = text.replace("\n", "").isprintable()  # then all white space is space or newline
        if not plain or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[-1] in " \n":
            return ["\x00" + w for w in self.split.findall(text)]
        parts = text.replace("\n", " \n").split(" ")
        if parts[0]:
            parts[0] = "\x00" + parts[0]
        else:
            del parts[0]
        return parts

    def _learn(self, keys: set[str]) -> None:
        """Adds the ids of these pieces to the cache."""
        whole = [k for k in keys if k[0] == "\x00" or k[0] == "\n"]  # without a space before them
        spaced = list(keys.difference(whole)) if whole else list(keys)
        words, n_words = [], []
        for k in whole:
            found = self.split.findall(k[1:] if k[0] == "\x00" else k)
            words += found
            n_words.append(len(found))
        if spaced:
            found = self.split.findall(" " + " ".join(spaced))
            begins = np.flatnonzero(np.fromiter([w[0] == " " for w in found], bool, len(found)))
            n_words += np.diff(np.append(begins, len(found))).tolist()
            words += found
        coded = list(map(str.encode, words))
        ids, count = self.encode_words(b"".join(coded), np.fromiter(map(len, coded), np.int64, len(coded)))
        ends = np.cumsum(np.append(0, count))[np.cumsum(n_words)] * 4
        raw = ids.astype("<u4").tobytes()
        ends = ends.tolist()
        self.cache.update(zip(whole + spaced, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if any(len(t or "") > PART for t in texts) and not self.whole:
            return [b"".join(self._encode([p])[0] for p in parts(t)) if len(t or "") > PART else self._encode([t])[0] for t in texts]
        out: list[bytes] = []
        for at in self._portions(texts):
            out += self._encode(at)
        return out

    @staticmethod
    def _portions(texts: list[str | None], size: int = 4_000_000):
        now, n = [], 0
        for t in texts:
            now.append(t)
            n += len(t or "")
            if n >= size:
                yield now
                now, n = [], 0
        if now:
            yield now

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        split: list[list] = []
        want: set[str] = set()
        for t in texts:
            if not t:
                split.append([])
            elif self.at_added and any(a in t for a in self.added):
                parts = self.at_added.split(t)
                got = [self.added[p] if k % 2 else self._pieces(p) for k, p in enumerate(parts) if p]
                for p in got:
                    if isinstance(p, list):
                        want.update(p)
                split.append(got)
            else:
                p = self._pieces(t)
                want.update(p)
                split.append([p])
        want.difference_update(self.cache)
        if want:
            if len(self.cache) + len(want) > CACHE:  # forget the older half, but nothing that this portion needs
                keep = {k for s in split for p in s if isinstance(p, list) for k in p} - want
                self.cache = {k: v for n, (k, v) in enumerate(self.cache.items()) if n >= CACHE // 2 or k in keep}
            self._learn(want)
        get = self.cache.__getitem__
        return [b"".join([np.array([p], "<u4").tobytes() if isinstance(p, int) else b"".join(map(get, p)) for p in s]) if len(s) != 1 or isinstance(s[0], int) else b"".join(map(get, s[0])) for s in split]

    def decode(self, ids: bytes) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD."""
        table = self.token_bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    """The coder of a vocabulary file, once per Python worker."""
    return ByteBPE(path)


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, ``ids`` (array of int) and ``decoded`` text, or only their digests if not ``keep_ids``.

    Narrow: no shuffle. Texts over ``PART`` characters are coded in parts, which end where a word begins. An empty table gives an empty result; further columns of ``docs`` are not read.
    """
    path = path or vocabulary_path()

    def run(batches):
        coder = load(path)
        for batch in portions(batches):
            key, texts = batch.column(0), batch.column(1).to_pylist()
            ids = coder.encode_batch(texts)
            decoded = [coder.decode(x) for x in ids]
            cols = [key, pa.array([len(x) // 4 for x in ids], pa.int64())]
            if keep_ids:
                cols += [pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names = ["key", "n_tokens", "ids", "decoded"]
            else:
                cols += [pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])]
                names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = dict(docs.dtypes)[id_col]
    rest = "ids array<int>, decoded string" if keep_ids else "ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(run, f"key {kind}, n_tokens bigint, {rest}").withColumnRenamed("key", id_col)


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)

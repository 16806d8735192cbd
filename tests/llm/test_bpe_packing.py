import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from lineagelake.llm import bpe
from lineagelake.llm.bpe import encode_decode, vocabulary_path
from lineagelake.llm.packing import coder, first_fit_decreasing, pack, sequences

ODD = [
    "", " ", "  ", "\n", " \n ", "a", " a", "a ", "it's 'll 12 3a  b\n\nc \n d\te", "\x00 a\x00b", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "é ÉÀ ß", " x y \u0085z\x1c q", "日本語 テスト", "🙂🙂 x",
    "a" * 3000, "ab " * 400, "​﻿", "x́ y", "१२३ ٣", "don't can't'S", " 　", "\r\n a\r", "a  b   c", "\n\n\n", "\tx", "-- -- ---", "1234567890" * 20, "Ⅷ ² ½",
]


def library():
    return Tokenizer.from_file(vocabulary_path())


def texts(spark):
    own = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(300).collect()]
    rng = random.Random(5)
    pool = "aZ é\n\t'sll<|endoftext|>  09,.!ß日🙂 "
    return ODD + own + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(500)]


def test_ids_like_the_library(spark):
    lib, own, fast = library(), bpe.load(vocabulary_path()), coder(vocabulary_path())
    all_texts = texts(spark)
    for t, ids in zip(all_texts, own.encode_batch(all_texts), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(t)
        assert fast(t).tolist() == want, repr(t)
        assert own.decode(ids) == t == lib.decode(want, skip_special_tokens=False)


def test_every_character(spark):
    lib, own, fast = library(), bpe.load(vocabulary_path()), coder(vocabulary_path())
    for low in range(0, 0x110000, 0x800):
        chars = [chr(c) for c in range(low, low + 0x800) if not 0xD800 <= c < 0xE000]
        if low >= 0x30000 and low < 0xE0000 or not chars:
            continue
        t = "".join(f"a{c}1 {c} " for c in chars)
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode_batch([t])[0], "<u4").tolist() == want
        assert fast(t).tolist() == want


def test_small_cache(monkeypatch, spark):
    own, all_texts = bpe.ByteBPE(vocabulary_path()), texts(spark)
    want = own.encode_batch(all_texts)
    monkeypatch.setattr(bpe, "CACHE", 50)
    own.cache = {}
    assert [x for t in all_texts for x in own.encode_batch([t])] == want


def test_operator(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(None, None, 1)], "doc_id bigint, text string, ids int")
    for r in encode_decode(df).collect():
        assert r.decoded == (ODD[r.doc_id] if r.doc_id is not None else "") and r.n_tokens == len(r.ids)
    for r in encode_decode(df, keep_ids=False).collect():
        t = ODD[r.doc_id] if r.doc_id is not None else ""
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(np.array(library().encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    assert encode_decode(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_first_fit_decreasing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 200):
        lengths = rng.integers(1, 100, n)
        bins, offsets = first_fit_decreasing(lengths, 100)
        room = []
        for i in np.argsort(-lengths, kind="stable").tolist():
            k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
            room += [100] * (k == len(room))
            assert (bins[i], offsets[i]) == (k, 100 - room[k])
            room[k] -= lengths[i]


def test_pack(spark):
    lib = library()
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300).unionByName(spark.createDataFrame([(10**6, None, "a", "b", 1), (10**6 + 1, "", "a", "b", 1), (None, "x y", None, None, None), (None, "x y", None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    out = pack(df, group=64, keep_ids=True).collect()
    assert {r.ids_crc32 for r in out} == {r.ids_crc32 for r in pack(df, group=64).collect()}
    texts_ = {r.doc_id: r.text for r in df.collect()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert set(by_doc) == set(texts_)
    for i, rows in by_doc.items():
        want = lib.encode(texts_[i] or "", add_special_tokens=False).ids + [0]
        rows.sort(key=lambda r: r.start)
        if i is not None:
            assert sum((r.ids for r in rows), []) == want
            assert [r.start for r in rows] == list(np.cumsum([0, *[r.length for r in rows]])[:-1])
        assert all(r.doc_tokens == len(want) for r in rows)
    for rows in by_seq.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == list(np.cumsum([0, *[r.length for r in rows]])[:-1]) and sum(r.length for r in rows) <= 1024
    total = sum(r.length for r in out)
    assert total > 0.9 * 1024 * len(by_seq)
    made = {r.sequence_id: r.ids for r in sequences(pack(df, group=64, keep_ids=True)).collect()}
    assert all(made[k] == sum((r.ids for r in rows), []) for k, rows in by_seq.items())
    assert pack(df.limit(0)).collect() == []


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "same text", 0), (1, "same text", 0), (None, None, 0), (None, None, 0)], "doc_id bigint, text string, n_tokens int")
    rows = encode_decode(df).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in rows) == [(0, 0, "")] * 2 + [(1, 2, "same text")] * 2
    many = spark.range(3000).selectExpr("1L as doc_id", "'same text' as text")
    packed = pack(many, group=64).collect()
    assert len(packed) == 3000 and len({r.sequence_id >> 32 for r in packed}) > 20

"""Long texts: few bytes of memory for each of their own, and the results of short portions."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lineagelake.llm import bpe, chat, common, near_dedup, packing, quality, secrets, span_dedup, toxicity

rng = random.Random(1)
WORDS = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 8))) for _ in range(20_000)]
TEXT = " ".join(rng.choice(WORDS) for _ in range(2_000_000))
PATH = bpe.vocabulary_path()


@pytest.mark.parametrize(
    "name, most, work",
    [
        ("toxicity", 10, lambda v: toxicity.scores(v, (np.zeros(1 << toxicity.BITS, np.float32), 0.0))),
        ("counts", 16, lambda v: quality.base_counts(v, [TEXT])),
        ("shingles", 15, lambda v: near_dedup.shingle_sets(v, 3)),
        ("tokens", 10, lambda v: bpe.load(PATH).encode_batch([TEXT])),
        ("packing", 6, lambda v: packing.coder(PATH)(TEXT)),
        ("chat", 8, lambda v: chat.assemble(pa.array(["user"]), v, np.array([0, 1]))),
        ("secrets", 4, lambda v: secrets.find(TEXT)),
    ],
)
def test_memory(name, most, work):
    values = pa.array([TEXT])
    bpe.load(PATH), packing.coder(PATH)
    tracemalloc.start()
    work(values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < most * len(TEXT), (name, peak / len(TEXT))


def test_parts_begin_words():
    coder = bpe.load(PATH)
    text = TEXT[:50_000] + " don't 12ab3 x" + "q" * 3000 + "1" * 2500 + "  \n\n é" * 400
    cut = bpe.parts(text, 1000)
    assert "".join(cut) == text and len(cut) > 20
    assert b"".join(coder.encode_batch(cut)) == coder.encode_batch([text])[0]
    assert bpe.parts("y" * 5000, 1000) == ["y" * 5000]


def test_words_of_any_length():
    """A word of 600,000 letters has the tokens it has as a whole, in every coder."""
    word = "abcdefghij" * 60_000
    whole = bpe.load(PATH)._long(word.encode())
    assert np.array_equal(np.frombuffer(bpe.load(PATH).encode_batch([word])[0], "<u4"), whole)
    assert np.array_equal(packing.coder(PATH)(word), whole)


def test_seeds_do_not_depend_on_portions(monkeypatch):
    """With hashes that tie often, a passage chooses the same seeds wherever and beside whatever it stands."""
    plain = span_dedup.seed_hashes
    monkeypatch.setattr(span_dedup, "seed_hashes", lambda data, seed: plain(data, seed) >> np.uint64(59) << np.uint64(59))
    page = np.frombuffer(TEXT[:3000].encode(), np.uint8)
    long = np.concatenate((np.frombuffer(TEXT[5000:400_000].encode(), np.uint8), page))

    def seeds(data, offsets, shift):
        row, start, count, before, *_ = span_dedup.runs(data, offsets, 100, 32)
        inside = start >= shift
        return [(s - shift, n, b) for s, n, b in zip(start[inside], count[inside], before[inside], strict=True)]

    alone = seeds(page, np.array([0, len(page)]), 0)
    assert seeds(long, np.array([0, len(long) - len(page), len(long)]), len(long) - len(page)) == alone


def test_counts_of_rows():
    marks = np.array([1, 0, 1, 1, 0, 1, 1], bool)
    for offsets in ([0, 7], [0, 0, 3, 3, 7, 7], [0, 2, 4, 7]):
        want = [int(marks[a:b].sum()) for a, b in zip(offsets, offsets[1:])]
        assert common.per_row(marks, np.array(offsets), 3).tolist() == want and common.per_row(marks, np.array(offsets), 7).tolist() == want
    assert common.per_row(marks[:0], np.array([0, 0])).tolist() == [0]

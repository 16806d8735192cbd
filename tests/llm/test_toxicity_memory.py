"""What training needs on the driver: the model itself, and of the sample's n-grams a block at a time on the way."""

import tracemalloc

import numpy as np
import pyarrow as pa

from lineagelake.llm import toxicity


def _peak(f):
    tracemalloc.start()
    f()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_sample_is_made_in_blocks():
    words = ["".join(chr(97 + (i * k) % 26) for k in range(1, 9)) for i in range(400)]
    texts = pa.array([" ".join(words[(i + j) % 400] for j in range(600)) for i in range(600)], pa.string())
    assert _peak(lambda: toxicity.Grams(texts)) < 30 * texts.nbytes


def test_blocks_change_no_bounds(monkeypatch):
    texts = pa.array(["one two three four five six seven eight", "", None, "nine ten   eleven", "x" * 50 + " y"])
    want = toxicity.Grams(texts).parts
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    got = toxicity.Grams(texts).parts
    assert all((a == c).all() and (b == d).all() for (a, b), (c, d) in zip(got, want, strict=True))


def test_table_is_drawn_in_parts():
    assert _peak(lambda: toxicity.fit(["good words", "bad words"], np.array([False, True]), epochs=1)) < 1.6 * 4 * toxicity.WIDTH * (1 << toxicity.BITS)

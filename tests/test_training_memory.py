"""Training of operator 1 holds its n-grams once and sums them in blocks."""

import tracemalloc

import numpy as np
import pyarrow as pa

from lineagelake.llm import toxicity


def test_ngrams_are_held_once_and_summed_in_blocks():
    rng = np.random.default_rng(1)
    words = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(2, 12, 500)]
    texts = pa.array([" ".join(rng.choice(words, 4000)) for _ in range(150)])
    values = rng.random(1 << toxicity.BITS).astype(np.float32)
    tracemalloc.start()
    grams = toxicity.Grams(texts)
    held = sum(b.nbytes + c.nbytes for b, c in grams.parts)
    made = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    means = grams.means(values)
    summed = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert made < 1.7 * held + 30e6, (made, held)
    assert summed < 8 * len(grams.row) * 8 + 14 * toxicity.BLOCK, summed
    plain = toxicity.Segments(texts).means(values)
    assert np.allclose(means, plain, rtol=1e-12, atol=1e-12)

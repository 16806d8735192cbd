"""What a packing worker holds beside its rows."""

import pyarrow as pa

from lineagelake.llm import bpe, common, packing

PATH = bpe.vocabulary_path()


def test_tables_of_long_words_only_for_long_words():
    bpe.load.cache_clear()
    packing.coder.cache_clear()
    ids = packing.coder(PATH)("some words, and some more")
    assert bpe.load.cache_info().currsize == 0
    assert list(ids) == list(memoryview(bpe.load(PATH).encode_batch(["some words, and some more"])[0]).cast("I"))


def test_groups_come_and_go_in_parts(spark):
    """Batches that were joined aren't held on, and results leave in slices whose rows are all there."""
    held = [pa.RecordBatch.from_pydict({"k": [1, 2]}), pa.RecordBatch.from_pydict({"k": [3]})]
    assert common._joined(held).column(0).to_pylist() == [1, 2, 3] and held == []
    whole = pa.RecordBatch.from_pydict({"k": list(range(2000)), "ids": [[k] * 1000 for k in range(2000)]})
    parts = list(common._sent(whole))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([whole])) and max(p.nbytes for p in parts) <= common.SENT
    rows = spark.createDataFrame([(g, g * 100 + k) for g in range(40) for k in range(50)], "g int, x int")

    def work(batch):
        assert len(set(batch.column(0).to_pylist())) * 50 == batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column(1)], names=["x"])

    got = common.by_group(rows, "g", ["x"], work, "x int", count=2, size=120).collect()
    assert sorted(r.x for r in got) == sorted(g * 100 + k for g in range(40) for k in range(50))

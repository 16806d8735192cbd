import re

import corpus_pipeline as pipeline
from lineagelake.llm import secrets
from lineagelake.llm.bpe import vocabulary_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LIVE = "xK9mQ2vT7bLw4ZrN8cYd3HsJ"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def fixture(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    base = " ".join(f"word{i}" for i in range(200))
    rows += [(900, base, "en", "a", 1), (901, base.upper(), "en", "b", 1), (902, base.replace("word7 ", "other "), "en", "a", 1), (903, f"x {LIVE} token={LIVE}", "en", "a", 1), (904, None, None, None, None), (905, "", "en", "a", 0), (None, "no id", "en", "a", 5), (906, "twice", "en", "a", 5), (906, "twice", "en", "a", 5)]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_stages_like_brute_force(spark):
    docs, rows = fixture(spark)
    names = docs.columns
    out = pipeline.drop_copies(spark, docs, SF)
    assert out.columns == names
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    best = {}
    for i, t, *_ in rows:
        k = low(t)
        if k not in best or (i is not None and (best[k][0] is None or i > best[k][0])):
            best[k] = (i, t)
    assert len(got) == len(best) and {(i, low(t)) for i, t in got} == {(i, low(t)) for i, t in best.values()}

    near = pipeline.drop_near_copies(spark, out, SF)
    assert near.columns == names
    kept = {r.doc_id for r in near.collect()}
    ids = sorted(i for i, _ in got if i is not None)
    sets, up = {i: shingles(t) for i, t in got if i is not None}, {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    assert kept == {i for i in ids if root(i) == i} | {None}

    clean = pipeline.redact_secrets(spark, near, SF)
    assert clean.columns == names
    texts = {r.doc_id: r for r in clean.collect()}
    assert texts[903].text == "x [SECRET] [SECRET]" and texts[903].n_chars == len("x [SECRET] [SECRET]")
    before = {r.doc_id: r.text for r in near.collect()}
    assert set(texts) == set(before)
    for i, r in texts.items():
        if not secrets.find(before[i] or ""):
            assert r.text == before[i]

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary_path())
    packed = pipeline.pack(spark, clean, SF).collect()
    assert {r.doc_id: r.doc_tokens for r in packed} == {i: len(lib.encode(r.text or "", add_special_tokens=False).ids) + 1 for i, r in texts.items()}


CLASHES = ["score", "text_sha256", "_doc_id", "dropped_0", "text_before", "text_digest", "c0", "row", "spans", "owner", "repository", "id", "label"]


def test_other_columns_stay(spark):
    docs, _ = fixture(spark)
    wide = docs
    for c in CLASHES:
        wide = wide.withColumn(c, docs["doc_id"] * 1000)
    for name, stage in pipeline.STAGES[:-1]:
        narrow = sorted(map(str, stage(spark, docs, SF).collect()))
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert sorted(str(r) for r in out.select(*docs.columns).collect()) == narrow, name
        assert all(r[c] == (None if r.doc_id is None else r.doc_id * 1000) for r in rows for c in CLASHES), name
    assert sorted(map(str, pipeline.pack(spark, wide, SF).drop("sequence_id", "offset").collect())) == sorted(map(str, pipeline.pack(spark, docs, SF).drop("sequence_id", "offset").collect()))


def test_empty_tables_and_no_sources(spark):
    docs, _ = fixture(spark)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []
    out = pipeline.redact_secrets(spark, docs.drop("source", "n_chars"), SF)
    assert out.columns == ["doc_id", "text", "lang"] and out.count() == docs.count()
    kept = {r.doc_id: r.n_chars for r in pipeline.redact_secrets(spark, docs, SF).collect()}
    assert kept[900] == 1 and kept[903] == len("x [SECRET] [SECRET]") and kept[904] is None


def test_repeats_of_ids(spark):
    rows = [(1, "a b", None, "s", 1), (1, "A b", None, "s", 1), (2, "a b", None, "s", 1), (2, "a b", None, "s", 1), (None, "a b", None, "s", 1), (3, "", None, "s", 1), (4, None, None, "s", 1)]
    out = pipeline.drop_copies(spark, spark.createDataFrame(rows, SCHEMA), SF)
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(2, "a b"), (4, "")]


def test_toxic_documents_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.01")
    assert out.columns == docs.columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    stay = {r.doc_id for r in out.collect()}
    clean, toxic = [i for i, t in labels.items() if not t], [i for i, t in labels.items() if t]
    assert sum(i in stay for i in clean) > 0.95 * len(clean) and sum(i in stay for i in toxic) < 0.3 * len(toxic)


def test_run(spark):
    rows = pipeline.run(spark, SF).collect()
    assert rows and {r.start for r in rows if r.doc_tokens <= 1024} == {0}

import json
import random

import numpy as np
import pytest

from lineagelake.functions.yaml import documents
from lineagelake.operators import extract, similar


def test_documents():
    text = "a: 1\nb:\n  - x\n  - y: 2\n    z: 'q # r' # c\nc: {k: v, l: [1, 'p, q']}\nd: |\n  line1\n   line2 # no comment\n\ne: \"a\\nb\"\nf:\n- 1\n- 2\ng: ~\nh: http://x:1/y\n---\n- 1\n-\n  k: v\n---\njust\n"
    want = [{"a": "1", "b": ["x", {"y": "2", "z": "q # r"}], "c": {"k": "v", "l": ["1", "p, q"]}, "d": "line1\n line2 # no comment\n", "e": "a\nb", "f": ["1", "2"], "g": "null", "h": "http://x:1/y"}, ["1", {"k": "v"}], "just"]
    assert documents(text) == want
    assert documents("# only\n---\n") == []
    for bad in ("a: [1, 2", "a:\n  b: 1\n    c: 2", "a: *x"):
        with pytest.raises(ValueError):
            documents(bad)


def test_anchors_and_tags():
    text = "a: &x 1\nb: *x\nc: &m\n  k: !!str v\n  l: &s [p, *x, &q {r: *x}]\nd: *m\ne: !tag\n- &i one\n- *i\n- &j\n  z: *s\n- *j\nf: &t |\n  text\ng: *t\nh: *q\n"
    seq = ["p", "1", {"r": "1"}]
    m = {"k": "v", "l": seq}
    assert documents(text) == [{"a": "1", "b": "1", "c": m, "d": m, "e": ["one", "one", {"z": seq}, {"z": seq}], "f": "text\n", "g": "text\n", "h": {"r": "1"}}]
    assert documents("&top\na: 1\n") == [{"a": "1"}] and documents("x: &e\ny: *e") == [{"x": "null", "y": "null"}]
    for bad in ("a: *none", "---\na: &x 1\n---\nb: *x", "*a : 1"):
        with pytest.raises(ValueError):
            documents(bad)


def test_json_is_yaml():
    rng = random.Random(1)

    def value(depth):
        kind = rng.randrange(4 if depth else 2)
        return str(rng.randrange(99)) if kind == 0 else rng.choice(["a b", "x:y", "it's", "#no"]) if kind == 1 else [value(depth - 1) for _ in range(rng.randrange(3))] if kind == 2 else {f"k{i}": value(depth - 1) for i in range(rng.randrange(3))}

    for _ in range(200):
        v = {"top": value(4)}
        assert documents(json.dumps(v)) == [v]


def test_resources(spark):
    files = {
        "m.yaml": "apiVersion: v1\nkind: ConfigMap\ndata:\n  A: x\n  N:\n    deep: 1\n  A2: 3\n",
        "s.yml": "kind: Secret\napiVersion: v1\nstringData: {user: me}\ndata:\n  list: [1]\n",
        "p.yaml": "apiVersion: batch/v1\nkind: CronJob\nspec:\n  jobTemplate:\n    spec:\n      template:\n        spec:\n          initContainers:\n          - image: i:1\n          containers:\n          - name: c\n            env:\n            - {name: E, value: v}\n            - name: F\n              valueFrom: {x: y}\n",
        "svc.yaml": "apiVersion: v1\nkind: Service\nspec:\n  port: 1\n",
        "plain.yaml": "a:\n  b: true\n  l: [1, 2]\n  m:\n  - x: 1\n  - y\na2: 1\n---\na2: 2\n",
        "bad.yaml": "a: [1",
        "x.json": '{"l": ["a", 1, true], "o": {"p": 1.5}}',
        "x.toml": 'l = ["a", "b"]\nt = true\n',
    }
    frame = spark.createDataFrame(list(files.items()), "path string, content string")
    assert [tuple(r) for r in extract.unread(frame).collect()] == [("bad.yaml", "ValueError: not closed: [1")]
    got = {(r.path, r.key): r.value for r in extract.config_keys(frame).collect()}
    assert got == {
        ("m.yaml", "A"): "x", ("m.yaml", "A2"): "3", ("s.yml", "list"): "<redacted>", ("s.yml", "user"): "<redacted>", ("p.yaml", "container.container.image"): "i:1", ("p.yaml", "E"): "v",
        ("plain.yaml", "a.b"): "true", ("plain.yaml", "a.l"): "[1, 2]", ("plain.yaml", "a.m"): "[<2 items>]", ("plain.yaml", "a2"): "2", ("x.json", "l"): '["a",1,true]', ("x.json", "o.p"): "1.5", ("x.toml", "l"): '["a", "b"]', ("x.toml", "t"): "true",
    }


def test_near_duplicates_like_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(20, 16))
    vectors = np.concatenate((base, base + rng.normal(size=base.shape) * 0.15, rng.normal(size=(20, 16))))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if unit[i] @ unit[j] >= 0.9 and (i % 2 == 0 or j % 2 == 0)}
    got = similar.near_duplicates(df, df.filter("id % 2 = 0"))
    assert {(r.a, r.b) for r in got.collect()} == want and want
    top, total = similar.top_and_total(got, [got["similarity"].desc()], 0)
    assert top.count() == 0 and total.first().total == len(want)


def test_embedding_text(spark):
    rows = spark.createDataFrame([("f", "a/b.tar.gz", "text"), ("g", None, None)], "n string, p string, c string")
    assert [r.t for r in rows.select(similar.node_text(rows.n, rows.p, rows.c).alias("t")).collect()] == ["f b.tar text", "g"]

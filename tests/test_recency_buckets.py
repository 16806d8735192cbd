"""A call of the cache's state folds a whole bucket of keys, not one key."""

import pandas as pd

from lineagelake.streaming import recency


class Value:
    """A value state without a stream."""

    def __init__(self):
        self.value = None

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def test_many_keys_in_one_call():
    state, fold = Value(), recency.Recency()
    fold.init(state)

    def call(*rows):
        frames = [pd.DataFrame([r], columns=["key", "tick", "op", "bytes"]) for r in rows]
        out = pd.concat(list(fold.handleInputRows((0,), iter(frames), None)))
        return {r.key: tuple(None if pd.isna(x) else int(x) for x in (r.tick, r.bytes, r.hits, r.last_used, r.there)) for r in out.itertuples()}

    assert call(("a", 3, "get", None), ("b", 2, "put", 7), ("a", 1, "put", 5), ("c", 4, "get", None)) == {"a": (3, 5, 1, 3, 1), "b": (2, 7, 0, 2, 1), "c": (4, None, 0, 4, 0)}
    assert call(("b", 6, "get", None), ("a", 5, "forget", None), ("b", 7, "put", None)) == {"b": (7, None, 1, 7, 1), "a": (5, None, 0, None, 0)}
    assert call(("c", 8, "put", 1)) == {"c": (8, 1, 0, 8, 1)}
    assert call(("b", 9, "forget", None), ("c", 10, "forget", None)) == {"b": (9, None, 0, None, 0), "c": (10, None, 0, None, 0)} and state.value is None

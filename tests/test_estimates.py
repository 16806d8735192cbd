"""Loops with joins leave no estimates that grow from round to round."""

import pytest

from lineagelake.plans.components import components


@pytest.mark.parametrize("kind", ["bigint", "string", "binary"])
def test_estimated_sizes_do_not_grow_with_rounds(spark, kind):
    way = spark.range(400).selectExpr(f"cast(cast(10000 + (id * 37) % 401 as string) as {kind}) as u" if kind != "bigint" else "(id * 37) % 401 as u", f"cast(cast(10000 + ((id + 1) * 37) % 401 as string) as {kind}) as v" if kind != "bigint" else "((id + 1) * 37) % 401 as v")
    out = components(way)
    least = {"bigint": 0, "string": "10000", "binary": b"10000"}[kind]
    assert {r.label if kind != "binary" else bytes(r.label) for r in out.collect()} == {least} and out.count() == 401
    assert out.schema["node"].dataType == way.schema["u"].dataType
    assert out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 2000

"""Review queries on tables with gaps: keys and lines that aren't there."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

ORDERS = {"o_orderkey": "Int64", "o_custkey": "Int64", "o_totalprice": "Float64", "o_orderpriority": "string"}
LINES = {"l_orderkey": "Int64", "l_suppkey": "Int64", "l_linenumber": "Int32", "l_extendedprice": "Float64"}


def same(spark, folder, name: str, orders: list[tuple], lines: list[tuple]):
    """The query's rows and those of its SQL, which are told by one thread."""
    con = duckdb.connect()
    con.execute("set threads = 1")
    for table, rows, types in (("orders", orders, ORDERS), ("lineitem", lines, LINES)):
        pd.DataFrame({c: pd.array([r[i] for r in rows], dtype=t) for i, (c, t) in enumerate(types.items())}).to_parquet(folder / f"{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = entry.queries()[name](spark, str(folder)).select(*columns).collect()
    return sorted(map(repr, map(tuple, got))), sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", ["merged_intervals", "merged_intervals_all"])
def test_findings_without_a_key_or_line(spark, tmp_path, name):
    lines = [(20, 1, 1, 50.0), (20, 1, 2, None), (40, 1, 3, 390.0), (60, 1, 4, None)]  # the last island has those without a line
    lines += [(20, 2, 5, None), (40, 2, 6, None)]  # no finding has a line, so none merge
    lines += [(20, None, 1, 7.0), (20, None, 2, 30.0), (None, 3, 1, 80.0), (None, None, 1, 90.0)]
    got, want = same(spark, tmp_path, name, [], lines)
    assert got == want
    assert repr(("sha0", "f1", 380, 400, 3)) in got and got.count(repr(("sha0", "f2", None, None, 1))) == 2


@pytest.mark.parametrize("name", ["chance_baseline", "chance_baseline_all"])
def test_rows_without_a_key_and_with_wide_ones(spark, tmp_path, name):
    wide = 3 * 2**53 // 15 + 1  # as doubles, its customers fall to its neighbours
    orders = [(20, wide * 15 + 14, 5.0, "a"), (40, None, 5.0, "a"), (None, 30, 5.0, "a"), (80, -7, 5.0, "a"), (100, 45, 5.0, "a")]
    lines = [(20, path, n, at) for path in (wide, wide + 1, None, 0) for n, at in ((1, 50.0), (2, 390.0 - (path or 0) % 7))]
    lines += [(None, 2, n, at) for n, at in ((1, 10.0), (2, 200.0))]
    got, want = same(spark, tmp_path, name, orders, lines)
    assert got == want
    assert repr((40, 0.123167)) in got

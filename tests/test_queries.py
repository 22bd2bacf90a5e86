"""Every core query against its SQL on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from lodestrata.plans import registry

Q, O = registry.queries(), registry.oracle_sql()  # noqa: E741


@pytest.fixture(scope="session")
def sql(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{data}/{f}')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(O))
def test_same_rows(spark, sql, data, name):
    got = Q[name](spark, data)
    cols = sorted(got.columns)
    want = sql.execute(O[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted([tuple(norm(r[c]) for c in cols) for r in got.collect()]) == sorted([tuple(norm(r[i]) for i in at) for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(Q) - set(O)))
def test_runs(spark, data, name):
    assert Q[name](spark, data).columns

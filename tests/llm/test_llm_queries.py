"""Every query of the package on the smallest tables, against its SQL where there is one."""

import os

import duckdb
import pytest

from lodestrata.llm import queries as L


@pytest.mark.parametrize("name", sorted(L.QUERIES))
def test_query(spark, data, name):
    got = L.QUERIES[name](spark, data)
    rows = sorted(tuple(str(r[c]) for c in sorted(got.columns)) for r in got.collect())
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
    if name in L.ORACLE:
        con = duckdb.connect()
        for f in os.listdir(data):
            con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{data}/{f}')")
        want = con.execute(L.ORACLE[name])
        names = [d[0] for d in want.description]
        assert rows == sorted(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in want.fetchall())

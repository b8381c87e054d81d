"""Every registered query of the analytics package against its SQL on the smallest tables."""

import os
from functools import cache

import duckdb
import pytest

from tidemark import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@cache
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, columns, order):
    cell = lambda v: "NULL" if v is None or v != v else repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    at = [columns.index(c) for c in order]
    return sorted(tuple(cell(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    df = plans.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name in plans.ORACLE:
        result = database().execute(plans.ORACLE[name])
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert plain(got, df.columns, sorted(columns)) == plain(result.fetchall(), columns, sorted(columns))
    else:
        assert got

"""Every registered query against its DuckDB SQL."""

import datetime
import decimal
import os

import duckdb
import pytest

from tapeframe import plans
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    return con


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v) + 0.0:.5f}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    want = duck.execute(plans.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(tuple(norm(r[c]) for c in columns) for r in got.collect())
    assert rows == sorted(tuple(map(norm, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_other_queries_give_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0

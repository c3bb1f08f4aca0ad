"""Every query with SQL gives the rows of that SQL in DuckDB."""

import os

import duckdb
import pytest

from pgq import catalog_queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_same_rows(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    sql = duck.sql(Q.ORACLE[name])
    assert sorted(sql.columns) == cols
    ours = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
    assert ours == sorted(map(repr, sql.select(", ".join(f'"{c}"' for c in cols)).fetchall()))


def test_filters_reach_the_scan(spark):
    plan = Q.QUERIES["rel_lookup_2hop"](spark, SF)._jdf.queryExecution().toString()
    assert "EqualTo(r_name,ASIA)" in plan and "GreaterThan(c_acctbal,5000" in plan
    assert "TakeOrderedAndProject" in Q.QUERIES["simple_ranking_desc"](spark, SF)._jdf.queryExecution().toString()

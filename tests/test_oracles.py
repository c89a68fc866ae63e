"""Every registered core query against its SQL in another engine."""

import math

import duckdb
import pytest

from meshlark.plans.oracles import ORACLE_SQL
from meshlark.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(values):
    return tuple(None if isinstance(v, float) and math.isnan(v) else v for v in values)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF)
    order = sorted(got.columns)
    want = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == order
    expected = sorted((plain(r[columns.index(c)] for c in order) for r in want.fetchall()), key=str)
    assert sorted((plain(r) for r in got.select(*[f"`{c}`" for c in order]).collect()), key=str) == expected
    assert expected


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)

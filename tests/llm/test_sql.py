"""Queries against their SQL in another engine."""

import duckdb
import pytest

from meshlark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    order = sorted(got.columns)
    want = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == order
    assert sorted(map(tuple, got.select(*order).collect())) == sorted(tuple(r[columns.index(c)] for c in order) for r in want.fetchall())


@pytest.mark.parametrize("name", ["op1_fingerprints", "op3_pii", "op7_mixing", "op8_chat", "op10_secrets"])
def test_native_operators_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "MapInArrow"))

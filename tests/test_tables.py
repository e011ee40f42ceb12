"""Every table query against DuckDB, where the driver's tables are at hand."""

from __future__ import annotations

import datetime
import math
import os

import pytest

from tessera.plans import ORACLE_SQL, QUERIES, tables

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name not in ORACLE_SQL:
        assert got
        return
    rel = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in rel.fetchall())
    assert sorted(df.columns) == sorted(names) and got == want


def test_orders_of_a_task_are_bounded(spark, monkeypatch):
    few = QUERIES["A12_A13_form"](spark, SF).collect()
    monkeypatch.setattr(tables, "ORDERS_A_TASK", 100)
    parts = -(-tables.table(spark, SF, "orders").count() // 100)
    dealt = tables.matches(spark, SF)
    tasks = dealt.groupBy(tables.F.spark_partition_id()).count().collect()
    assert parts > 4 and len(tasks) > parts / 2 and max(r["count"] for r in tasks) < 200
    assert sorted(QUERIES["A12_A13_form"](spark, SF).collect()) == sorted(few)

from collections import Counter

import duckdb
import pytest

import __spark_entry__
from loomkv.catalogue import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events", "lineitem", "nation"):
        con.execute(f"CREATE VIEW {t} AS FROM '{DIR}/{t}.parquet'")
    got = QUERIES[name](spark, DIR)
    want = con.execute(ORACLE[name])
    assert got.columns == [c[0] for c in want.description]
    rows = Counter(map(tuple, got.collect()))
    assert rows and rows == Counter(want.fetchall())


def test_totals_are_not_all_nothing(spark):
    rows = {r.key: int(r.total) for r in QUERIES["mr_sum_by_key"](spark, DIR).collect()}
    assert any(v > 0 for v in rows.values()) and any(k.startswith("bad ") and v == 0 for k, v in rows.items()) and "" in rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE) == set(QUERIES)

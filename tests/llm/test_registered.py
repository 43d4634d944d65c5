from collections import Counter

import pytest

from tradepost.llm.queries import QUERIES
from tradepost.llm.sql import SQL

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "conversations", "pages"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    result = con.execute(SQL[name])
    columns = [c[0] for c in result.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(result.fetchall())

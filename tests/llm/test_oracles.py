"""The queries that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from quern.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = c.execute(oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(map(str, (tuple(r[n] for n in names) for r in queries()[name](spark, SF).collect()))) == sorted(map(str, found.fetchall()))


def test_one_query_an_operator():
    assert [n for i in range(1, 11) for n in queries() if n.startswith(f"op{i}_")] == list(queries())

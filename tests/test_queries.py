"""Every query with an oracle against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from quern.queries import ORACLES, QUERIES, TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLES[name])
    assert canonical(df.columns, df.collect()) == canonical([d[0] for d in found.description], found.fetchall())


@pytest.mark.parametrize("name", ["graph_scc", "graph_label_propagation", "ml_kmeans", "ml_table_stages", "sample_rows"])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_streaming_kmeans_reads_every_line(spark, duck):
    rows = duck.execute("SELECT l_linenumber % 7, l_quantity::DOUBLE FROM lineitem").fetchall()
    centres, weights = [10.0, 40.0], [1.0, 1.0]
    for k in range(7):
        batch = [x for n, x in rows if n == k]
        near = [min((0, 1), key=lambda c, x=x: abs(x - centres[c])) for x in batch]
        for c in (0, 1):
            of = [x for x, i in zip(batch, near) if i == c]
            weights[c] *= 0.5
            centres[c] = (centres[c] * weights[c] + sum(of)) / (weights[c] + len(of))
            weights[c] += len(of)
    assert sorted(r.centre for r in QUERIES["ml_streaming_kmeans"](spark, SF).collect()) == pytest.approx(sorted(centres), rel=1e-6)


def test_statistics_give_the_correlations(spark, duck):
    got = {r.test: r["values"] for r in QUERIES["ml_statistics"](spark, SF).collect()}
    for a, b in (("l_discount", "l_quantity"), ("l_tax", "l_quantity"), ("l_tax", "l_discount")):
        assert got[f"corr {a} {b}"] == [pytest.approx(duck.execute(f"SELECT corr({a}::DOUBLE, {b}::DOUBLE) FROM lineitem").fetchone()[0], abs=1e-8)]


def test_models_predict_after_a_fixpoint(spark):
    """What a fixpoint leaves in a session must not break models that hold the session."""
    assert QUERIES["rsql_reach"](spark, SF).count() > 0
    assert QUERIES["ml_logistic_regression"](spark, SF).count() > 0

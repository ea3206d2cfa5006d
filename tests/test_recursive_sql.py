"""Recursive SQL against hand-made answers."""

import pytest

from quern.plans.fixpoint import MIN, Diverged, Predicate, Stats, closure, written
from quern.plans.recursive_sql import RecursiveSQL, SyntaxProblem, parse, references

EDGES = [(0, 1, 4), (0, 2, 1), (2, 1, 1), (1, 3, 1), (3, 0, 1), (4, 5, 1)]


@pytest.fixture
def sql(spark):
    spark.createDataFrame(EDGES, "Src int, Dst int, Cost int").createOrReplaceTempView("edge")
    return RecursiveSQL(spark)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_shortest_paths_on_a_cycle(sql):
    for head in ("mmin AS Cost", "min() AS Cost", "MIN () as Cost"):
        text = f"WITH RECURSIVE path (Dst, {head}) AS (SELECT 0, 0) UNION (SELECT edge.Dst, path.Cost + edge.Cost FROM path, edge WHERE path.Dst = edge.Src) SELECT Dst, Cost FROM path"
        assert rows(sql.sql(text)) == [(0, 0), (1, 2), (2, 1), (3, 3)]
    assert sql.stats["path"].iterations >= 4


def test_reach_and_final_query(sql):
    text = "WITH RECURSIVE r (x) AS (SELECT 4) UNION (SELECT e.Dst FROM r, edge e WHERE r.x = e.Src) SELECT count(*) FROM r"
    assert rows(sql.sql(text)) == [(2,)]


def test_longest_and_sums_on_a_dag(sql, spark):
    spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 3)], "Src int, Dst int").createOrReplaceTempView("dag")
    text = "WITH RECURSIVE p (x, {}) AS (SELECT 0, {}) UNION (SELECT dag.Dst, {} FROM p JOIN dag ON p.x = dag.Src) SELECT * FROM p"
    assert rows(sql.sql(text.format("mmax AS d", 0, "p.d + 1"))) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert rows(sql.sql(text.format("sum() AS n", 1, "p.n"))) == [(0, 1), (1, 1), (2, 2), (3, 2)]
    assert rows(sql.sql(text.format("mcount AS n", "1", "p.x"))) == [(0, 1), (1, 1), (2, 2), (3, 2)]  # over all derivations


def test_set_recursion_with_two_references(sql):
    text = "WITH RECURSIVE tc (a, b) AS (SELECT Src, Dst FROM edge) UNION (SELECT x.a, y.b FROM tc x, tc AS y WHERE x.b = y.a) SELECT count(*) FROM tc"
    assert rows(sql.sql(text)) == [(17,)]


def test_several_tables_and_union_inside(sql):
    text = "WITH RECURSIVE r (x) AS (SELECT 4 UNION SELECT edge.Dst FROM r, edge WHERE r.x = edge.Src), s (y) AS (SELECT x + 1 FROM r) SELECT y FROM s"
    assert rows(sql.sql(text)) == [(5,), (6,)]


def test_null_keys_settle(sql, spark):
    spark.createDataFrame([(1, None), (None, 1)], "a int, b int").createOrReplaceTempView("holes")
    text = "WITH RECURSIVE r (x) AS (SELECT 1) UNION (SELECT holes.b FROM r, holes WHERE r.x <=> holes.a) SELECT x FROM r"
    assert sql.sql(text).count() == 2


def test_divergence_is_an_error(sql):
    sql.most_iterations = 6
    with pytest.raises(Diverged):
        sql.sql("WITH RECURSIVE p (x, sum() AS n) AS (SELECT 0, 1) UNION (SELECT edge.Dst, p.n FROM p, edge WHERE p.x = edge.Src) SELECT * FROM p")


@pytest.mark.parametrize("text", ["WITH RECURSIVE AS (SELECT 1) SELECT 1", "WITH RECURSIVE r (x) AS (SELECT 1 SELECT 1", "WITH RECURSIVE r (mmin AS a, mmax AS b) AS (SELECT 1, 1) SELECT 1", "WITH RECURSIVE r (x) AS (SELECT x FROM r) SELECT 1", "WITH RECURSIVE r (x y z) AS (SELECT 1) SELECT 1"])
def test_text_that_is_no_query(sql, text):
    with pytest.raises(SyntaxProblem):
        sql.sql(text)


def test_plain_sql_passes_through(sql):
    assert rows(sql.sql("SELECT count(*) FROM edge")) == [(6,)]


def test_parsing():
    tables, final = parse("with recursive a (x, mmin as y) as ((select 'a)b', 1)) union all (select x, y from a where x > ')') select 1;")
    assert tables[0].columns == ["x", "y"] and tables[0].mode == "min" and len(tables[0].branches) == 2 and final == "select 1"
    assert len(references("SELECT a.x FROM a, b JOIN a y ON a.x = y.x WHERE a.x > 1", "a")) == 2


def test_fixpoint_directly(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)], "a int, b int")
    s = Stats()
    out = closure(spark.createDataFrame([(0,)], "a int"), lambda d: d.join(e, "a").select("b"), stats=s)
    assert out.count() == 31 and s.iterations == 32  # past a compaction


def test_known_rows_are_not_shuffled(spark):
    p = Predicate("p", ["a", "b"], [], [], MIN, "b")
    for lo in (0, 50):
        p.changes.append(written(p.combined(spark.range(lo, lo + 60).selectExpr("id AS a", "id * 2 AS b")), p.keys)[0])
    fresh = p.fresh(spark.range(100, 130).selectExpr("id AS a", "id AS b"))
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Bucketed: true") == 2
    assert rows(fresh) == [(a, a) for a in range(100, 130)]
    p.compact()
    assert rows(p.known()) == [(a, 2 * a) for a in range(110)]

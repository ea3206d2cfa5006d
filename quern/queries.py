"""The library's operators as queries over the tables of a folder, each with its SQL oracle.

A query is Spark SQL or a function; where both engines read the same text, one text is
the query and the oracle.  All queries read whole tables.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import ml
from quern.operators.graph import Graph
from quern.operators.relational import except_keeping_duplicates, filter_by_range, histogram, subtract_by_key
from quern.plans.datalog import Datalog
from quern.plans.recursive_sql import RecursiveSQL
from quern.session import shared_dir, ship
from quern.sources import files
from quern.streaming import counts

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Temporary views of the tables that a text names."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            table(spark, sf_dir, name).createOrReplaceTempView(name)


def from_sql(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, text)
        return spark.sql(text)

    return run


def shipped(f: Query) -> Query:
    """The query, with the package on the workers."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def add(name: str, spark_query: Query | str, oracle: str | None = None) -> None:
    """Register a query; a text without an oracle is its own."""
    QUERIES[name] = shipped(from_sql(spark_query) if isinstance(spark_query, str) else spark_query)
    if oracle is None and isinstance(spark_query, str):
        oracle = spark_query
    if oracle:
        ORACLES[name] = oracle


def query(oracle: str | None = None):
    """Register a function under its own name."""

    def register(f: Query) -> Query:
        add(f.__name__, f, oracle)
        return f

    return register


# Graphs: which part follows which in an order, with the least quantity as cost; and customers to nations to regions.

FOLLOWS = """SELECT src, dst, min(cost) AS cost FROM (
  SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS dst, CAST(l_quantity AS BIGINT) AS cost FROM lineitem) x
  WHERE dst IS NOT NULL AND dst <> src GROUP BY src, dst"""


def follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(FOLLOWS)(spark, sf_dir)


def ready_edges(spark: SparkSession, sf_dir: str, partition: str = "src") -> DataFrame:
    """The edges, computed once and dealt by the column that every step joins on."""
    e = follows(spark, sf_dir).repartition(partition).persist()
    e.createOrReplaceTempView("follows")
    return e


def recursive(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ready_edges(spark, sf_dir)
        views(spark, sf_dir, text)
        return RecursiveSQL(spark).sql(text)

    return run


WITH_E = f"WITH RECURSIVE e AS MATERIALIZED ({FOLLOWS})"
FIRST = "(SELECT min(l_partkey) FROM lineitem)"

add(
    "rsql_sssp",
    recursive(f"WITH RECURSIVE path (id, mmin AS cost) AS (SELECT min(src), 0 FROM follows) UNION (SELECT follows.dst, path.cost + follows.cost FROM path, follows WHERE path.id = follows.src) SELECT id, cost FROM path"),
    f"{WITH_E}, r(id, d) USING KEY (id) AS (SELECT (SELECT min(src) FROM e), 0::BIGINT UNION SELECT e.dst, min(r.d + e.cost) FROM r JOIN e ON e.src = r.id LEFT JOIN recurring.r o ON o.id = e.dst WHERE o.id IS NULL OR r.d + e.cost < o.d GROUP BY e.dst) SELECT id, d AS cost FROM r",
)
add(
    "rsql_reach",
    recursive("WITH RECURSIVE reach (id) AS (SELECT min(src) FROM follows) UNION (SELECT follows.dst FROM reach, follows WHERE reach.id = follows.src) SELECT id FROM reach"),
    f"{WITH_E}, r(id) AS (SELECT (SELECT min(src) FROM e) UNION SELECT e.dst FROM r JOIN e ON e.src = r.id) SELECT id FROM r",
)
add(
    "rsql_cc_directed",
    recursive("WITH RECURSIVE cc (id, mmin AS label) AS (SELECT src, src FROM follows) UNION (SELECT follows.dst, cc.label FROM cc, follows WHERE cc.id = follows.src) SELECT count(DISTINCT cc.label) AS components FROM cc"),
    f"{WITH_E}, r(id, d) USING KEY (id) AS (SELECT DISTINCT src, src FROM e UNION SELECT e.dst, min(r.d) FROM r JOIN e ON e.src = r.id LEFT JOIN recurring.r o ON o.id = e.dst WHERE o.id IS NULL OR r.d < o.d GROUP BY e.dst) SELECT count(DISTINCT d) AS components FROM r",
)
TREE = """SELECT 'R' || CAST(r_regionkey AS STRING) AS src, 'N' || CAST(n_nationkey AS STRING) AS dst FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT 'N' || CAST(s_nationkey AS STRING), 'S' || CAST(s_suppkey AS STRING) FROM supplier
  UNION ALL SELECT DISTINCT 'S' || CAST(l_suppkey AS STRING), 'P' || CAST(l_partkey AS STRING) FROM lineitem"""


def over_tree(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from_sql(TREE)(spark, sf_dir).repartition("src").persist().createOrReplaceTempView("tree")
        views(spark, sf_dir, "region")
        return RecursiveSQL(spark).sql(text)

    return run


TREE_E = f"WITH RECURSIVE t AS MATERIALIZED ({TREE})"
ROOTS = "SELECT 'R' || CAST(r_regionkey AS STRING) AS id, 1 AS n FROM region"
add(
    "rsql_count_paths",
    over_tree(f"WITH RECURSIVE p (id, sum() AS cnt) AS ({ROOTS}) UNION (SELECT tree.dst, p.cnt FROM p, tree WHERE p.id = tree.src) SELECT id, cnt FROM p"),
    f"{TREE_E}, p(id, n) AS ({ROOTS} UNION ALL SELECT t.dst, p.n FROM p JOIN t ON t.src = p.id) SELECT id, CAST(sum(n) AS BIGINT) AS cnt FROM p GROUP BY id",
)
add(
    "rsql_max_depth",
    over_tree("WITH RECURSIVE p (id, mmax AS depth) AS (SELECT 'R' || CAST(r_regionkey AS STRING), 0 FROM region) UNION (SELECT tree.dst, p.depth + 1 FROM p, tree WHERE p.id = tree.src) SELECT id, depth FROM p"),
    f"{TREE_E}, p(id, n) AS (SELECT 'R' || CAST(r_regionkey AS STRING), 0 FROM region UNION SELECT t.dst, p.n + 1 FROM p JOIN t ON t.src = p.id) SELECT id, CAST(max(n) AS BIGINT) AS depth FROM p GROUP BY id",
)
add(
    "rsql_mcount",
    over_tree("WITH RECURSIVE p (id, mcount AS n) AS (SELECT 'R' || CAST(r_regionkey AS STRING), 1 FROM region) UNION (SELECT tree.dst, p.id FROM p, tree WHERE p.id = tree.src) SELECT id, n FROM p"),
    f"{TREE_E} SELECT id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'R' || CAST(r_regionkey AS STRING) AS id, 1 AS n FROM region UNION ALL SELECT dst, 1 FROM t) GROUP BY id",
)
add(
    "rsql_nonlinear_closure",
    over_tree("WITH RECURSIVE tc (a, b) AS (SELECT src, dst FROM tree) UNION (SELECT x.a, y.b FROM tc x, tc y WHERE x.b = y.a) SELECT a, b FROM tc"),
    f"{TREE_E}, tc(a, b) AS (SELECT src, dst FROM t UNION SELECT tc.a, t.dst FROM tc JOIN t ON t.src = tc.b) SELECT a, b FROM tc",
)

# Datalog


def datalog(program: str, goal: str, *names: str, **relations: str) -> Query:
    """A goal over relations given as SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = Datalog(spark, program)
        for name, text in relations.items():
            d.load(name, from_sql(text)(spark, sf_dir).persist())
        return d.query(goal).toDF(*names)

    return run


ARC = {"arc": f"SELECT src, dst, cost FROM ({FOLLOWS}) f"}
D_ARC = "database({arc(X: long, Y: long, D: long)}).\n"
D_TREE = "database({arc(X: string, Y: string)}).\n"
add("datalog_tc_left", datalog(D_TREE + "tc(A,B) <- arc(A,B). tc(A,B) <- tc(A,C), arc(C,B).", "tc(A,B)", "a", "b", arc=TREE), ORACLES["rsql_nonlinear_closure"])
add("datalog_tc_right", datalog(D_TREE + "tc(A,B) <- arc(A,B). tc(A,B) <- arc(A,C), tc(C,B).", "tc(A,B)", "a", "b", arc=TREE), ORACLES["rsql_nonlinear_closure"])
add("datalog_tc_nonlinear", datalog(D_TREE + "tc(A,B) <- arc(A,B). tc(A,B) <- tc(A,C), tc(C,B).", "tc(A,B)", "a", "b", arc=TREE), ORACLES["rsql_nonlinear_closure"])
add("datalog_bound_goal", datalog(D_TREE + "tc(A,B) <- arc(A,B). tc(A,B) <- tc(A,C), arc(C,B).", "tc('R0',B)", "a", "b", arc=TREE), f"{TREE_E}, tc(a, b) AS (SELECT src, dst FROM t WHERE src = 'R0' UNION SELECT tc.a, t.dst FROM tc JOIN t ON t.src = tc.b) SELECT a, b FROM tc")
add("datalog_sssp", datalog(D_ARC + "first(min<X>) <- arc(X,_,_). sp(X, mmin<D>) <- first(X), D=0. sp(B, mmin<D>) <- sp(A,C), arc(A,B,E), D=C+E.", "sp(A,D)", "id", "cost", **ARC), ORACLES["rsql_sssp"])
add("datalog_cc", datalog(D_ARC + "both(X,Y) <- arc(X,Y,_). both(X,Y) <- arc(Y,X,_). cc(X, mmin<X>) <- both(X,_). cc(Y, mmin<L>) <- cc(X,L), both(X,Y). n(countd<L>) <- cc(_,L).", "n(C)", "components", **ARC),
    f"WITH RECURSIVE f AS MATERIALIZED ({FOLLOWS}), e AS MATERIALIZED (SELECT src, dst FROM f UNION SELECT dst, src FROM f), r(id, d) USING KEY (id) AS (SELECT DISTINCT src, src FROM e UNION SELECT e.dst, min(r.d) FROM r JOIN e ON e.src = r.id LEFT JOIN recurring.r o ON o.id = e.dst WHERE o.id IS NULL OR r.d < o.d GROUP BY e.dst) SELECT count(DISTINCT d) AS components FROM r")
add("datalog_mutual", datalog(D_TREE + "odd(X,Y) <- arc(X,Y). even(X,Y) <- odd(X,Z), arc(Z,Y). odd(X,Y) <- even(X,Z), arc(Z,Y).", "even(X,Y)", "a", "b", arc=TREE),
    f"{TREE_E}, tc(a, b, n) AS (SELECT src, dst, 1 FROM t UNION SELECT tc.a, t.dst, 1 - tc.n FROM tc JOIN t ON t.src = tc.b) SELECT DISTINCT a, b FROM tc WHERE n = 0")
add("datalog_same_generation", datalog("database({pc(P: string, C: string)}). sg(X,Y) <- pc(P,X), pc(P,Y), X ~= Y. sg(X,Y) <- pc(A,X), sg(A,B), pc(B,Y).", "sg(X,Y)", "a", "b", pc="SELECT 'R' || CAST(n_regionkey AS STRING) AS p, 'N' || CAST(n_nationkey AS STRING) AS c FROM nation UNION ALL SELECT 'N' || CAST(s_nationkey AS STRING), 'S' || CAST(s_suppkey AS STRING) FROM supplier"),
    "WITH RECURSIVE pc AS MATERIALIZED (SELECT 'R' || CAST(n_regionkey AS STRING) AS p, 'N' || CAST(n_nationkey AS STRING) AS c FROM nation UNION ALL SELECT 'N' || CAST(s_nationkey AS STRING), 'S' || CAST(s_suppkey AS STRING) FROM supplier), sg(a, b) AS (SELECT x.c, y.c FROM pc x JOIN pc y ON x.p = y.p WHERE x.c <> y.c UNION SELECT x.c, y.c FROM sg JOIN pc x ON x.p = sg.a JOIN pc y ON y.p = sg.b) SELECT a, b FROM sg")
add("datalog_negation", datalog("database({part(P: long), sold(P: long, S: long)}). unsold(P) <- part(P), ~sold(P,_).", "unsold(P)", "p", part="SELECT p_partkey AS p FROM part", sold="SELECT l_partkey AS p, l_suppkey AS s FROM lineitem"), "SELECT p_partkey AS p FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
add("datalog_aggregates", datalog("database({o(C: long, P: double, S: string)}). t(C, count<_>, countd<S>, min<P>, max<P>) <- o(C,P,S).", "t(C,N,D,L,H)", "c", "n", "d", "low", "high", o="SELECT o_custkey, o_totalprice, o_orderpriority FROM orders"),
    "SELECT o_custkey AS c, count(*) AS n, count(DISTINCT o_orderpriority) AS d, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1")
add("datalog_sort_limit", datalog("database({o(C: long, K: long)}). n(C, count<K>) <- o(C,K). top(C,N) <- n(C,N), sort((N,desc),(C,asc)), limit(10).", "top(C,N)", "c", "n", o="SELECT o_custkey, o_orderkey FROM orders"),
    "SELECT o_custkey AS c, count(o_orderkey) AS n FROM orders GROUP BY 1 ORDER BY n DESC, c LIMIT 10")
add("datalog_comparison", datalog("database({l(O: long, Q: double, P: double, S: datetime)}). r(O,V) <- l(O,Q,P,S), Q >= 45, S <= '1996-12-31', V = Q * P.", "r(O,V)", "o", "v", l="SELECT l_orderkey, l_quantity, l_extendedprice, CAST(l_shipdate AS DATE) FROM lineitem"),
    "SELECT DISTINCT l_orderkey AS o, l_quantity * l_extendedprice AS v FROM lineitem WHERE l_quantity >= 45 AND l_shipdate < DATE '1997-01-01'")
add("datalog_triangles", datalog(D_ARC + "t(count<_>) <- arc(X,Y,_), X < Y, arc(Y,Z,_), Y < Z, arc(X,Z,_).", "t(C)", "triangles", **ARC), f"WITH e AS MATERIALIZED ({FOLLOWS}) SELECT count(*) AS triangles FROM e a JOIN e b ON a.dst = b.src JOIN e c ON c.src = a.src AND c.dst = b.dst WHERE a.src < a.dst AND b.src < b.dst")

# Graph algorithms


def graph(f: Callable[[Graph], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(Graph.from_edges(ready_edges(spark, sf_dir)))


PAGE_RANK_STEPS = 5


def _page_rank_oracle(steps: int) -> str:
    text = f"WITH e AS MATERIALIZED ({FOLLOWS}), v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e), o AS MATERIALIZED (SELECT src, count(*) AS k FROM e GROUP BY src), r0 AS (SELECT id, 0.15::DOUBLE AS rank FROM v)"
    for i in range(1, steps + 1):
        text += f", r{i} AS MATERIALIZED (SELECT v.id, 0.15 + 0.85 * coalesce(s.x, 0) AS rank FROM v LEFT JOIN (SELECT e.dst, sum(p.rank / o.k) AS x FROM e JOIN o ON o.src = e.src JOIN r{i - 1} p ON p.id = e.src GROUP BY e.dst) s ON s.dst = v.id)"
    return f"{text} SELECT id, round(rank, 6) AS rank FROM r{steps}"


add("graph_page_rank", graph(lambda g: g.page_rank(PAGE_RANK_STEPS).select("id", F.round("rank", 6).alias("rank"))), _page_rank_oracle(PAGE_RANK_STEPS))
add("graph_page_rank_converged", graph(lambda g: g.page_rank(tolerance=1e-3)))
add("graph_connected_components", graph(lambda g: g.connected_components()),
    f"WITH RECURSIVE f AS MATERIALIZED ({FOLLOWS}), e AS MATERIALIZED (SELECT src, dst FROM f UNION SELECT dst, src FROM f), r(id, d) USING KEY (id) AS (SELECT DISTINCT src, src FROM e UNION SELECT e.dst, min(r.d) FROM r JOIN e ON e.src = r.id LEFT JOIN recurring.r o ON o.id = e.dst WHERE o.id IS NULL OR r.d < o.d GROUP BY e.dst) SELECT id, d AS component FROM r")
add("graph_scc", graph(lambda g: g.strongly_connected_components()))
add("graph_triangles", graph(lambda g: g.triangles()),
    f"WITH f AS MATERIALIZED ({FOLLOWS}), e AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM f), t AS MATERIALIZED (SELECT x.a, x.b, y.b AS c FROM e x JOIN e y ON y.a = x.b JOIN e z ON z.a = x.a AND z.b = y.b), n AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY id), v AS (SELECT src AS id FROM f UNION SELECT dst FROM f) SELECT v.id, coalesce(n.n, 0) AS triangles FROM v LEFT JOIN n ON n.id = v.id")
add("graph_degrees", graph(lambda g: g.degrees()), f"WITH f AS ({FOLLOWS}) SELECT id, count(*) AS degree FROM (SELECT src AS id FROM f UNION ALL SELECT dst FROM f) GROUP BY id")
add("graph_in_degrees", graph(lambda g: g.in_degrees()), f"SELECT dst AS id, count(*) AS degree FROM ({FOLLOWS}) f GROUP BY dst")
add("graph_out_degrees", graph(lambda g: g.out_degrees()), f"SELECT src AS id, count(*) AS degree FROM ({FOLLOWS}) f GROUP BY src")
add("graph_label_propagation", graph(lambda g: g.label_propagation(2)))
add("graph_distances", graph(lambda g: g.distances(g.edges.agg(F.min("src").alias("id")))),
    f"{WITH_E}, r(id, d) USING KEY (id) AS (SELECT (SELECT min(src) FROM e), 0::BIGINT UNION SELECT e.dst, min(r.d + 1) FROM r JOIN e ON e.src = r.id LEFT JOIN recurring.r o ON o.id = e.dst WHERE o.id IS NULL OR r.d + 1 < o.d GROUP BY e.dst) SELECT id, d AS distance FROM r")
add("graph_canonical_edges", graph(lambda g: g.canonical(cost=F.min("cost")).edges), f"SELECT least(src, dst) AS src, greatest(src, dst) AS dst, min(cost) AS cost FROM ({FOLLOWS}) f GROUP BY 1, 2")
add("graph_messages", graph(lambda g: g.aggregate_messages(F.max, to_dst=F.col("cost"))), f"SELECT dst AS id, max(cost) AS message FROM ({FOLLOWS}) f GROUP BY dst")
add("graph_reverse", graph(lambda g: g.reverse().edges), f"SELECT dst AS src, src AS dst, cost FROM ({FOLLOWS}) f")
add("graph_pregel_min", graph(lambda g: g.pregel(F.col("id"), lambda v, m: F.least(v, m), F.min, to_src=F.when(F.col("dst_value") < F.col("src_value"), F.col("dst_value")), to_dst=F.when(F.col("src_value") < F.col("dst_value"), F.col("src_value")), most_iterations=100).withColumnRenamed("value", "component")), ORACLES["graph_connected_components"])

# Relational operators

CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
add("pricing_summary", f"SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty, CAST(sum({CENTS}) AS BIGINT) AS sum_cents, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '2000-09-02' GROUP BY l_returnflag, l_linestatus")
add("project_filter", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice, l_extendedprice FROM lineitem WHERE l_discount > 0.05 AND l_quantity < 10")
add("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS code FROM orders")
add("distinct_rows", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
add("count_distinct_groups", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS numbers FROM lineitem GROUP BY l_returnflag")
add("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
add("union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation")
add("union_distinct", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT n_name FROM nation")
add("intersect_rows", "SELECT l_partkey AS k FROM lineitem INTERSECT SELECT p_partkey FROM part")
add("except_rows", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
add("except_keeping_duplicates", lambda s, d: except_keeping_duplicates(table(s, d, "orders").select("o_custkey", "o_orderpriority"), table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderpriority")),
    "SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderpriority <> '1-URGENT'")
add("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
add("global_sort", lambda s, d: table(s, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").select("c_custkey", "c_acctbal"), "SELECT c_custkey, c_acctbal FROM customer ORDER BY 2 DESC, 1")
add("sort_within_partitions", lambda s, d: table(s, d, "customer").repartition("c_nationkey").sortWithinPartitions("c_acctbal").select("c_custkey", "c_nationkey"), "SELECT c_custkey, c_nationkey FROM customer")
add("join_inner", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
add("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY c_custkey")
add("join_right", "SELECT s.s_suppkey, n.n_name FROM supplier s RIGHT JOIN nation n ON n.n_nationkey = s.s_nationkey")
add("join_full", "SELECT a.k AS left_key, b.k AS right_key FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity < 3) a FULL OUTER JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 48) b ON a.k = b.k")
add("join_semi", "SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
add("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON o_custkey = c_custkey", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
add("join_semi_theta", "SELECT s_suppkey FROM supplier LEFT SEMI JOIN nation ON n_nationkey > s_nationkey AND n_regionkey = 1", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey > s_nationkey AND n_regionkey = 1)")
add("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey")
add("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
add("join_null_safe", "SELECT a.k, count(*) AS n FROM (SELECT nullif(l_returnflag, 'R') AS k FROM lineitem) a JOIN (SELECT DISTINCT nullif(l_returnflag, 'R') AS k FROM lineitem) b ON a.k <=> b.k GROUP BY a.k", "SELECT a.k, count(*) AS n FROM (SELECT nullif(l_returnflag, 'R') AS k FROM lineitem) a JOIN (SELECT DISTINCT nullif(l_returnflag, 'R') AS k FROM lineitem) b ON a.k IS NOT DISTINCT FROM b.k GROUP BY a.k")
add("join_using", "SELECT k, x, y FROM (SELECT n_nationkey AS k, n_name AS x FROM nation) a JOIN (SELECT s_nationkey AS k, s_name AS y FROM supplier) b USING (k)")
add("join_broadcast_hint", "SELECT /*+ BROADCAST(region) */ n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey", "SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
add("join_merge_hint", "SELECT /*+ MERGE(customer) */ o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
add("join_self_alias", lambda s, d: table(s, d, "nation").alias("a").join(table(s, d, "nation").alias("b"), F.expr("a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")).select(F.col("a.n_name").alias("x"), F.col("b.n_name").alias("y")), "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
add("subquery_in", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
add("subquery_not_exists", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.09)")
add("subquery_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
add("rollup", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
add("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
add("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
add("pivot", lambda s, d: table(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0), "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
add("window_ranks", f"SELECT o_orderkey, CAST(row_number() {W}) AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS dr, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 6) AS pr, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority), 6) AS cd, CAST(ntile(4) {W}) AS BIGINT) AS nt FROM orders")
add("window_lead_lag", f"SELECT o_orderkey, lag(o_orderkey, 1) {W}) AS before, lead(o_orderkey, 2, -1) {W}) AS after FROM orders")
add("window_rows", f"SELECT o_orderkey, max(o_totalprice) {W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS m, count(*) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM orders")
add("window_range", "SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_suppkey ORDER BY CAST(l_quantity AS BIGINT) RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS n FROM lineitem")
add("window_range_desc", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_custkey DESC RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM orders")
add("window_first_last", f"SELECT o_orderkey, first_value(o_orderkey) {W}) AS f, last_value(o_orderkey) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM orders")
add("lateral_view", "SELECT p_partkey, w FROM part LATERAL VIEW explode(split(p_name, ' ')) t AS w", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part")
add("lateral_view_outer", "SELECT n_nationkey, w FROM nation LATERAL VIEW OUTER explode(CASE WHEN n_regionkey = 0 THEN array() ELSE split(n_name, '_') END) t AS w", "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN NULL ELSE w END AS w FROM nation, LATERAL (SELECT unnest(CASE WHEN n_regionkey = 0 THEN [NULL] ELSE string_split(n_name, '_') END) AS w)")
add("collect_sorted", "SELECT n_regionkey, concat_ws(',', sort_array(collect_list(n_name))) AS names, size(collect_set(n_regionkey)) AS k FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, CAST(1 AS INTEGER) AS k FROM nation GROUP BY n_regionkey")

# Aggregates, functions, API

add("aggregates", "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS lo, max(l_quantity) AS hi, round(stddev(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_quantity), 5) AS vs, round(var_pop(l_quantity), 5) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS co FROM lineitem GROUP BY l_returnflag")
add("aggregates_moments", "SELECT l_returnflag, round(skewness(l_extendedprice), 6) AS sk, round(kurtosis(l_extendedprice), 6) AS ku FROM lineitem GROUP BY l_returnflag",
    "WITH m AS (SELECT l_returnflag AS f, avg(l_extendedprice) AS a FROM lineitem GROUP BY 1) SELECT l_returnflag, round(avg(power(l_extendedprice - a, 3)) / power(avg(power(l_extendedprice - a, 2)), 1.5), 6) AS sk, round(avg(power(l_extendedprice - a, 4)) / power(avg(power(l_extendedprice - a, 2)), 2) - 3, 6) AS ku FROM lineitem JOIN m ON f = l_returnflag GROUP BY 1")
add("aggregates_approximate", "SELECT l_returnflag, approx_count_distinct(l_partkey) BETWEEN 0.85 * count(DISTINCT l_partkey) AND 1.15 * count(DISTINCT l_partkey) AS near FROM lineitem GROUP BY l_returnflag", "SELECT DISTINCT l_returnflag, true AS near FROM lineitem")
add("first_last", "SELECT k, first(v) AS f, last(v) AS l, first_value(v) AS fv, last_value(v) AS lv FROM (SELECT DISTINCT n_nationkey AS k, n_name AS v FROM nation) GROUP BY k", "SELECT n_nationkey AS k, n_name AS f, n_name AS l, n_name AS fv, n_name AS lv FROM nation")
X = "(p_size / 60.0)"
add("functions_math", f"SELECT p_partkey, round(acos({X}), 6) AS acos_, round(asin({X}), 6) AS asin_, round(atan({X}), 6) AS atan_, round(atan2({X}, 2.0), 6) AS atan2_, bin(p_partkey) AS bin_, round(cbrt({X}), 6) AS cbrt_, CAST(ceil({X}) AS BIGINT) AS ceil_, CAST(ceiling({X}) AS BIGINT) AS ceiling_, round(cos({X}), 6) AS cos_, round(cosh({X}), 6) AS cosh_, round(exp({X}), 6) AS exp_, CAST(floor({X}) AS BIGINT) AS floor_, round(ln({X} + 1), 6) AS ln_, round(log10({X} + 1), 6) AS log10_, round(log2({X} + 1), 6) AS log2_, round(pow({X}, 2), 6) AS pow_, round(power({X}, 3), 6) AS power_, round(sin({X}), 6) AS sin_, round(sinh({X}), 6) AS sinh_, round(tan({X}), 6) AS tan_, round(tanh({X}), 6) AS tanh_, round(degrees({X}), 6) AS degrees_, round(radians({X}), 6) AS radians_, round(sqrt({X}), 6) AS sqrt_, round(pi(), 6) AS pi_, abs(p_size - 25) AS abs_, hex(p_partkey) AS hex_ FROM part".replace("p_size / 60.0", "CAST(p_size AS DOUBLE) / 60"))
add("functions_math_more", "SELECT p_partkey, factorial(p_size % 10) AS f, round(hypot(p_size, 3), 6) AS h, round(expm1(p_size / 100D), 6) AS em, round(log1p(p_size), 6) AS lp, round(log(2D, p_size + 1D), 6) AS lb, rint(p_size / 2D) AS ri, round(p_retailprice, 0) AS ro, pmod(p_size - 25, 7) AS pm, negative(p_size) AS ne, positive(p_size) AS po, shiftleft(p_size, 2) AS sl, shiftright(p_size - 25, 1) AS sr, shiftrightunsigned(p_size, 1) AS su, sign(p_size - 25) AS si, signum(p_size - 25) AS sg, conv('ff', 16, 10) AS co, round(e(), 6) AS ee FROM part",
    "SELECT p_partkey, CAST(factorial(p_size % 10) AS BIGINT) AS f, round(sqrt(p_size * p_size + 9.0), 6) AS h, round(exp(CAST(p_size AS DOUBLE) / 100) - 1, 6) AS em, round(ln(1 + CAST(p_size AS DOUBLE)), 6) AS lp, round(log2(p_size + 1), 6) AS lb, round_even(CAST(p_size AS DOUBLE) / 2, 0) AS ri, round(p_retailprice, 0) AS ro, ((p_size - 25) % 7 + 7) % 7 AS pm, -p_size AS ne, p_size AS po, p_size * 4 AS sl, CAST(floor((p_size - 25) / 2.0) AS INTEGER) AS sr, p_size // 2 AS su, CAST(sign(p_size - 25) AS DOUBLE) AS si, CAST(sign(p_size - 25) AS DOUBLE) AS sg, '255' AS co, CAST(2.718282 AS DOUBLE) AS ee FROM part")
add("functions_null_safe", "SELECT o_orderkey, try_divide(o_totalprice, o_custkey % 3) AS q, coalesce(nullif(o_orderstatus, 'F'), 'none') AS c, nvl(nullif(o_orderstatus, 'O'), 'x') AS n, greatest(o_orderkey, o_custkey) AS g, least(o_orderkey, o_custkey) AS l, if(o_custkey > 500, 1, 0) AS i, isnull(nullif(o_orderstatus, 'P')) AS isn, isnotnull(nullif(o_orderstatus, 'P')) AS inn FROM orders",
    "SELECT o_orderkey, o_totalprice / nullif(o_custkey % 3, 0) AS q, coalesce(nullif(o_orderstatus, 'F'), 'none') AS c, coalesce(nullif(o_orderstatus, 'O'), 'x') AS n, greatest(o_orderkey, o_custkey) AS g, least(o_orderkey, o_custkey) AS l, CASE WHEN o_custkey > 500 THEN 1 ELSE 0 END AS i, nullif(o_orderstatus, 'P') IS NULL AS isn, nullif(o_orderstatus, 'P') IS NOT NULL AS inn FROM orders")
add("functions_nan", "SELECT o_orderkey, nanvl(CASE WHEN o_orderstatus = 'F' THEN double('NaN') ELSE o_totalprice END, -1D) AS v, isnan(CASE WHEN o_orderstatus = 'F' THEN double('NaN') ELSE 0D END) AS n FROM orders", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE o_totalprice END AS v, o_orderstatus = 'F' AS n FROM orders")
add("functions_string", "SELECT p_partkey, ascii(p_name) AS a, concat(p_name, '-', p_brand) AS c, concat_ws('|', p_name, p_type) AS cw, lower(p_type) AS lo, lcase(p_type) AS lc, upper(p_name) AS up, ucase(p_name) AS uc, length(p_name) AS le, levenshtein(p_name, p_brand) AS lv, regexp_extract(p_brand, '([0-9]+)', 1) AS re, instr(p_name, ' ') AS i, locate('i', p_name) AS lt, lpad(p_brand, 10, '*') AS lp, rpad(p_brand, 10, '*') AS rp, ltrim('  x') AS l, rtrim('x  ') AS r, trim(' x ') AS t, repeat('ab', 2) AS rr, reverse(p_name) AS rv, substring(p_name, 2, 3) AS ss, substr(p_name, 3) AS sb, substring_index(p_name, ' ', 1) AS si, translate(p_name, 'aei', 'AEI') AS tr, regexp_replace(p_name, '[aeiou]', '_') AS rg, split(p_name, ' ')[0] AS sp, space(2) AS sc FROM part",
    "SELECT p_partkey, ascii(p_name) AS a, concat(p_name, '-', p_brand) AS c, concat_ws('|', p_name, p_type) AS cw, lower(p_type) AS lo, lower(p_type) AS lc, upper(p_name) AS up, upper(p_name) AS uc, CAST(length(p_name) AS INTEGER) AS le, CAST(levenshtein(p_name, p_brand) AS INTEGER) AS lv, regexp_extract(p_brand, '([0-9]+)', 1) AS re, CAST(instr(p_name, ' ') AS INTEGER) AS i, CAST(instr(p_name, 'i') AS INTEGER) AS lt, lpad(p_brand, 10, '*') AS lp, rpad(p_brand, 10, '*') AS rp, 'x' AS l, 'x' AS r, 'x' AS t, 'abab' AS rr, reverse(p_name) AS rv, substring(p_name, 2, 3) AS ss, substring(p_name, 3) AS sb, split_part(p_name, ' ', 1) AS si, translate(p_name, 'aei', 'AEI') AS tr, regexp_replace(p_name, '[aeiou]', '_', 'g') AS rg, split_part(p_name, ' ', 1) AS sp, '  ' AS sc FROM part")
add("functions_string_more", "SELECT n_nationkey, initcap(lower(n_name)) AS ic, soundex('Robert') AS sx, find_in_set('b', 'a,b,c') AS fs, format_number(n_nationkey * 1000.5, 2) AS fn, format_string('%05d', n_nationkey) AS fm, printf('%s!', n_name) AS pf, base64(encode(n_name, 'UTF-8')) AS b, decode(unbase64(base64(encode(n_name, 'UTF-8'))), 'UTF-8') AS ub, hex(encode(n_name, 'UTF-8')) AS hx, decode(unhex(hex(encode(n_name, 'UTF-8'))), 'UTF-8') AS ux FROM nation",
    "SELECT n_nationkey, upper(lower(n_name)[1]) || lower(n_name)[2:] AS ic, 'R163' AS sx, 2 AS fs, format('{:,.2f}', n_nationkey * 1000.5::DOUBLE) AS fn, printf('%05d', n_nationkey) AS fm, n_name || '!' AS pf, to_base64(encode(n_name)) AS b, n_name AS ub, hex(encode(n_name)) AS hx, n_name AS ux FROM nation")
add("functions_json", "SELECT event_id, get_json_object(props, '$.k') AS a, t.k AS b FROM events LATERAL VIEW json_tuple(props, 'k') t AS k", "SELECT event_id, json_extract_string(props, '$.k') AS a, json_extract_string(props, '$.k') AS b FROM events")
add("functions_datetime", "SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofmonth(o_orderdate) AS dm, dayofyear(o_orderdate) AS dy, weekofyear(o_orderdate) AS w, date_add(CAST(o_orderdate AS DATE), 10) AS da, date_sub(CAST(o_orderdate AS DATE), 10) AS ds, datediff(CAST(o_orderdate AS DATE), DATE '1995-01-01') AS dd, add_months(CAST(o_orderdate AS DATE), 1) AS am, last_day(CAST(o_orderdate AS DATE)) AS ld, trunc(CAST(o_orderdate AS DATE), 'MM') AS tr, date_format(o_orderdate, 'yyyy-MM-dd') AS df, to_date('1999-01-02') AS td, next_day(DATE '2024-01-01', 'TU') AS nd, months_between(DATE '2024-03-31', DATE '2024-02-29') AS mb FROM orders",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(day(o_orderdate) AS INTEGER) AS dm, CAST(dayofyear(o_orderdate) AS INTEGER) AS dy, CAST(weekofyear(o_orderdate) AS INTEGER) AS w, CAST(o_orderdate AS DATE) + 10 AS da, CAST(o_orderdate AS DATE) - 10 AS ds, CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS dd, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS am, last_day(CAST(o_orderdate AS DATE)) AS ld, CAST(date_trunc('month', o_orderdate) AS DATE) AS tr, strftime(o_orderdate, '%Y-%m-%d') AS df, DATE '1999-01-02' AS td, DATE '2024-01-02' AS nd, CAST(1 AS DOUBLE) AS mb FROM orders")
add("functions_time", "SELECT event_id, hour(ts) AS h, minute(ts) AS m, second(ts) AS s, unix_timestamp('2000-01-02 00:00:00') - unix_timestamp('2000-01-01 00:00:00') AS u, to_unix_timestamp('2000-01-02 00:00:00') - to_unix_timestamp('2000-01-01 00:00:00') AS t, date_format(from_unixtime(unix_timestamp('2001-02-03 04:05:06')), 'HH:mm:ss') AS f, datediff(current_date(), to_date(now())) AS z, current_timestamp() = now() AS n, date_format(from_utc_timestamp(TIMESTAMP '2020-06-01 12:00:00', 'Asia/Tokyo'), 'HH') AS j, date_format(to_utc_timestamp(TIMESTAMP '2020-06-01 12:00:00', 'Asia/Tokyo'), 'HH') AS k FROM events",
    "SELECT event_id, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS m, CAST(second(ts) AS INTEGER) AS s, CAST(86400 AS BIGINT) AS u, CAST(86400 AS BIGINT) AS t, '04:05:06' AS f, 0 AS z, true AS n, '21' AS j, '03' AS k FROM events")
add("functions_collection", "SELECT p_partkey, size(split(p_name, ' ')) AS n, array_contains(split(p_name, ' '), 'ring') AS c, concat_ws(' ', sort_array(split(p_name, ' '))) AS s, concat_ws(' ', sort_array(split(p_name, ' '), false)) AS r, element_at(map('a', p_size), 'a') AS m, named_struct('x', p_size).x AS x, struct(p_size).p_size AS y, array(p_size, 1)[0] AS z FROM part",
    "SELECT p_partkey, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS n, list_contains(string_split(p_name, ' '), 'ring') AS c, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS s, array_to_string(list_reverse_sort(string_split(p_name, ' ')), ' ') AS r, p_size AS m, p_size AS x, p_size AS y, p_size AS z FROM part")
add("functions_hash", "SELECT n_nationkey, md5(n_name) AS m, sha1(n_name) AS s1, sha(n_name) AS s, sha2(n_name, 256) AS s2, crc32('123456789') AS c FROM nation", "SELECT n_nationkey, md5(n_name) AS m, sha1(n_name) AS s1, sha1(n_name) AS s, sha256(n_name) AS s2, CAST(3421780262 AS BIGINT) AS c FROM nation")
add("functions_misc", "SELECT count(DISTINCT id) = count(*) AS ids, max(p) >= 0 AS parts, min(length(f)) > 0 AS files, min(r) >= 0 AND max(r) < 1 AS uniform, count(g) = count(*) AS normal FROM (SELECT monotonically_increasing_id() AS id, spark_partition_id() AS p, input_file_name() AS f, rand(7) AS r, randn(7) AS g FROM orders)", "SELECT true AS ids, true AS parts, true AS files, true AS uniform, true AS normal")
add("predicates", "SELECT p_partkey FROM part WHERE (p_name LIKE '%ring%' OR p_type RLIKE '^ECO') AND p_size IN (1, 2, 3, 5, 8, 13, 21, 34) AND NOT p_brand = 'Brand#1' AND p_size BETWEEN 2 AND 40", "SELECT p_partkey FROM part WHERE (p_name LIKE '%ring%' OR regexp_matches(p_type, '^ECO')) AND p_size IN (1, 2, 3, 5, 8, 13, 21, 34) AND NOT p_brand = 'Brand#1' AND p_size BETWEEN 2 AND 40")
add("bitwise", "SELECT o_orderkey, o_orderkey & 255 AS a, o_orderkey | 255 AS b, o_orderkey ^ 255 AS c, ~o_orderkey AS d FROM orders", "SELECT o_orderkey, o_orderkey & 255 AS a, o_orderkey | 255 AS b, xor(o_orderkey, 255) AS c, ~o_orderkey AS d FROM orders")
add("na_drop_fill_replace", lambda s, d: table(s, d, "orders").select("o_orderkey", F.expr("nullif(o_orderstatus, 'F')").alias("st"), F.expr("nullif(o_orderpriority, '5-LOW')").alias("pr")).na.drop("all", subset=["st", "pr"]).na.fill("none", subset=["st"]).na.replace("2-HIGH", "high", subset=["pr"]),
    "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS st, CASE WHEN o_orderpriority = '2-HIGH' THEN 'high' ELSE nullif(o_orderpriority, '5-LOW') END AS pr FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '5-LOW')")
add("stat_crosstab", lambda s, d: table(s, d, "lineitem").crosstab("l_returnflag", "l_linestatus").withColumnRenamed("l_returnflag_l_linestatus", "flag").select("flag", "F", "O"), "SELECT l_returnflag AS flag, count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1")
add("stat_cov_corr", lambda s, d: s.createDataFrame([((li := table(s, d, "lineitem")).cov("l_quantity", "l_extendedprice"), li.corr("l_quantity", "l_extendedprice"))], "c double, r double").select(F.round("c", 2).alias("c"), F.round("r", 6).alias("r")), "SELECT round(covar_samp(l_quantity, l_extendedprice), 2) AS c, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
add("describe_numbers", lambda s, d: table(s, d, "customer").describe("c_acctbal").where("summary IN ('count', 'min', 'max')").select("summary", F.col("c_acctbal").cast("double").alias("v")), "SELECT 'count' AS summary, CAST(count(c_acctbal) AS DOUBLE) AS v FROM customer UNION ALL SELECT 'min', min(c_acctbal) FROM customer UNION ALL SELECT 'max', max(c_acctbal) FROM customer")
add("sample_rows", lambda s, d: table(s, d, "lineitem").sample(0.1, seed=3))
add("random_split", lambda s, d: (lambda a, b: a.select(F.lit("rows").alias("what"), "n_nationkey").union(b.select(F.lit("rows"), "n_nationkey")).union(a.intersect(b).select(F.lit("both"), "n_nationkey")))(*(x.select("n_nationkey") for x in table(s, d, "nation").randomSplit([0.5, 0.5], seed=1))), "SELECT 'rows' AS what, n_nationkey FROM nation")
add("map_in_pandas", lambda s, d: table(s, d, "customer").select("c_custkey", "c_acctbal").mapInPandas(lambda it: (x.assign(c_acctbal=x.c_acctbal.round(0)) for x in it), "c_custkey long, c_acctbal double"), "SELECT c_custkey, round_even(c_acctbal, 0) AS c_acctbal FROM customer")


def _range_of(pdf):
    return pdf.groupby("c_nationkey", as_index=False).agg(lo=("c_acctbal", "min"), hi=("c_acctbal", "max"))


def _joined(left, right):
    return left.assign(n=len(right))[["k", "n"]]


add("map_groups", lambda s, d: table(s, d, "customer").select("c_nationkey", "c_acctbal").groupBy("c_nationkey").applyInPandas(_range_of, "c_nationkey int, lo double, hi double"), "SELECT c_nationkey, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1")
add("cogroup", lambda s, d: table(s, d, "nation").select(F.col("n_nationkey").alias("k")).groupBy("k").cogroup(table(s, d, "supplier").select(F.col("s_nationkey").alias("k")).groupBy("k")).applyInPandas(_joined, "k int, n long"), "SELECT n_nationkey AS k, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
add("pandas_udf", lambda s, d: table(s, d, "part").select("p_partkey", F.pandas_udf(lambda x: x * 2, "int")("p_size").alias("twice")), "SELECT p_partkey, p_size * 2 AS twice FROM part")
add("cached_table", lambda s, d: (lambda t: t.groupBy("o_orderstatus").agg(F.count("*").alias("n")))(table(s, d, "orders").persist()), "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
add("repartition_coalesce", lambda s, d: table(s, d, "orders").repartition(7, "o_custkey").coalesce(2).select("o_orderkey"), "SELECT o_orderkey FROM orders")


# Sources, sinks, streams, commands


def round_trip_of(kind: str, name: str, partition_by: list[str] | None = None, columns: list[str] | None = None) -> Query:
    """A table written to the shared folder in a format, and read back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, name)
        df = df.select(*columns) if columns else df
        return files.round_trip(df, kind, f"{shared_dir(spark)}/trip-{kind}-{uuid.uuid4().hex}", partition_by)

    return run


add("source_parquet", round_trip_of("parquet", "customer"), "SELECT * FROM customer")
add("source_json", round_trip_of("json", "customer"), "SELECT * FROM customer")
add("source_orc", round_trip_of("orc", "customer"), "SELECT * FROM customer")
add("source_csv", round_trip_of("csv", "customer"), "SELECT * FROM customer")
add("source_text", lambda s, d: files.round_trip(table(s, d, "part").select(F.col("p_name").alias("value")), "text", f"{shared_dir(s)}/trip-text-{uuid.uuid4().hex}"), "SELECT p_name AS value FROM part")
add("source_partitioned", round_trip_of("parquet", "customer", ["c_mktsegment"]), "SELECT * FROM customer")
add("source_pushdown", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_orderstatus IN ('F', 'O') AND o_orderpriority IS NOT NULL AND o_orderpriority LIKE '1%'")


@query(f"SELECT src, dst FROM ({FOLLOWS}) f")
def source_edge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges through a text file."""
    path = f"{shared_dir(spark)}/edges-{uuid.uuid4().hex}"
    files.save_edges(follows(spark, sf_dir).select("src", "dst"), path)
    return files.edge_list(spark, path)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a file stream, drained."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events")
    e.repartition(3).write.parquet(path)
    return counts.drain(counts.running_counts(counts.file_stream(spark, path, e.schema), "event_type"), f"counts_{uuid.uuid4().hex}")


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of a file stream with a watermark, drained."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events")
    e.orderBy("ts").coalesce(1).write.parquet(path)
    out = counts.windowed_counts(counts.file_stream(spark, path, e.schema).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "2 hours", "event_type")
    return counts.drain(out, f"windows_{uuid.uuid4().hex}").select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CACHE, SET, SHOW, DESCRIBE, EXPLAIN, CREATE VIEW, REFRESH and UNCACHE around a query."""
    path = f"{sf_dir}/orders.parquet"
    for text in (
        f"CREATE OR REPLACE TEMPORARY VIEW cmd_orders USING parquet OPTIONS (path '{path}')", "CACHE LAZY TABLE cmd_orders", "SET spark.sql.adaptive.enabled", "SHOW TABLES", "SHOW FUNCTIONS",
        "DESCRIBE FUNCTION abs", "DESCRIBE cmd_orders", "REFRESH TABLE cmd_orders", "EXPLAIN SELECT * FROM cmd_orders", "UNCACHE TABLE cmd_orders",
    ):
        spark.sql(text).count()
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM cmd_orders GROUP BY 1")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1")
def udtf_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python table function."""

    @F.udtf(returnType="word string")
    class Words:
        def eval(self, text: str):
            for w in text.split(" "):
                yield (w,)

    spark.udtf.register("words_of_text", Words)
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql("SELECT word, count(*) AS n FROM part, LATERAL words_of_text(p_name) GROUP BY word")


@query("SELECT c_nationkey, max(c_acctbal) - min(c_acctbal) AS spread FROM customer GROUP BY 1")
def udaf_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grouped aggregate in Python, Arrow batched."""

    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(spread("c_acctbal").alias("spread"))


add("script_transform", "SELECT TRANSFORM (n_name) USING 'cat' AS (name STRING) FROM nation", "SELECT n_name AS name FROM nation")
add("source_whole_text", lambda s, d: (lambda p: (table(s, d, "nation").select(F.col("n_name").alias("value")).coalesce(1).write.text(p), s.read.text(p, wholetext=True).select(F.size(F.regexp_extract_all("value", F.lit(r"\S+"), F.lit(0))).alias("n")))[1])(f"{shared_dir(s)}/whole-{uuid.uuid4().hex}"), "SELECT CAST(count(*) AS INTEGER) AS n FROM nation")
add("source_binary_files", lambda s, d: (lambda p: (table(s, d, "region").select(F.col("r_name").alias("value")).coalesce(1).write.text(p), s.read.format("binaryFile").option("pathGlobFilter", "part-*").load(p).select((F.length("content") == F.col("length")).alias("same")))[1])(f"{shared_dir(s)}/binary-{uuid.uuid4().hex}"), "SELECT true AS same")
add("graph_partition_2d", graph(lambda g: g.dealt("2d").edges), FOLLOWS)
add("graph_map_triplets", graph(lambda g: g.map_vertices(w=F.col("id") % 7).map_triplets(cost=F.col("src_attr.w") + F.col("dst_attr.w")).edges), f"SELECT src, dst, src % 7 + dst % 7 AS cost FROM ({FOLLOWS}) f")
add("graph_subgraph", graph(lambda g: g.subgraph(edge=F.col("cost") < 10).edges), f"SELECT src, dst, cost FROM ({FOLLOWS}) f WHERE cost < 10")
add("graph_neighbour_ids", graph(lambda g: g.neighbour_ids("out").select("id", F.concat_ws(",", "neighbours").alias("to"))), f"SELECT src AS id, string_agg(dst, ',' ORDER BY dst) AS to FROM ({FOLLOWS}) f GROUP BY src".replace(" AS to ", ' AS "to" '))
add("rdd_zip_with_index", lambda s, d: table(s, d, "nation").select("n_nationkey").orderBy("n_nationkey").rdd.zipWithIndex().map(lambda x: (x[0][0], x[1])).toDF("k int, i long"), "SELECT n_nationkey AS k, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation")
add("rdd_histogram", lambda s, d: histogram(table(s, d, "lineitem"), "l_quantity", [0.0, 10.0, 20.0, 30.0, 40.0, 50.0]),
    "SELECT CAST(least(4, floor(l_quantity / 10)) AS INTEGER) AS bucket, count(*) AS count FROM lineitem GROUP BY 1")
add("rdd_filter_by_range", lambda s, d: filter_by_range(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 10, 50), "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 10 AND 50")
add("rdd_subtract_by_key", lambda s, d: subtract_by_key(table(s, d, "part").select("p_partkey"), table(s, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey"), ORACLES["datalog_negation"].replace(" AS p", ""))
add("checkpointed", lambda s, d: (shared_dir(s), table(s, d, "nation").select("n_nationkey").checkpoint())[1], "SELECT n_nationkey FROM nation")
for _name, _make in ml.QUERIES.items():
    add(_name, lambda s, d, f=_make: f(lambda name: table(s, d, name)))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest paths by recursive SQL."""
    return QUERIES["rsql_sssp"](spark, sf_dir)


from quern import api_queries  # noqa: E402, F401  registers more

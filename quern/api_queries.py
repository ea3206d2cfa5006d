"""More queries by name: the DataFrame and RDD API, table commands, JDBC, graph structure, Datalog."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import graph as g_
from quern.operators import relational as rel
from quern.operators.graph import Graph
from quern.queries import D_TREE, FOLLOWS, ORACLES, TREE, TREE_E, WITH_E, add, datalog, follows, graph, query, table
from quern.session import shared_dir
from quern.sources import files

# DataFrame API

add("drop_duplicates", lambda s, d: table(s, d, "orders").select("o_custkey", "o_orderpriority").dropDuplicates(["o_custkey", "o_orderpriority"]), "SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
add("aggregates_more", "SELECT l_returnflag, round(mean(l_quantity), 6) AS m, round(variance(l_quantity), 5) AS v, round(stddev_samp(l_quantity), 6) AS s, CAST(count(l_tax) AS BIGINT) AS n, round(covar_pop(l_quantity, l_tax), 6) AS cp, round(covar_samp(l_quantity, l_tax), 6) AS cs FROM lineitem GROUP BY l_returnflag")
add("decimals", "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2))) AS DECIMAL(22, 2)) AS total, max(CAST(l_extendedprice AS DECIMAL(12, 2))) AS top, min(CAST(l_extendedprice AS DECIMAL(12, 2)) - CAST(l_tax AS DECIMAL(4, 2))) AS low, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * CAST(l_discount AS DECIMAL(4, 2))) AS DECIMAL(28, 4)) AS saved FROM lineitem GROUP BY l_returnflag")
add("array_of_structs_field", lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("o")).select("o_custkey", F.concat_ws(",", F.col("o.o_orderkey")).alias("orders_"), F.col("o")[0]["o_orderpriority"].alias("first_")),
    "SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS orders_, arg_min(o_orderpriority, o_orderkey) AS first_ FROM orders GROUP BY 1")
add("join_with", lambda s, d: rel.join_with(table(s, d, "nation"), table(s, d, "region"), lambda a, b: a["n_regionkey"] == b["r_regionkey"]).select("_1.n_name", "_2.r_name"), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
add("stat_freq_items", lambda s, d: table(s, d, "lineitem").stat.freqItems(["l_returnflag", "l_linestatus"], 0.05).select(F.array_join(F.array_sort("l_returnflag_freqItems"), ",").alias("flags"), F.array_join(F.array_sort("l_linestatus_freqItems"), ",").alias("states")),
    "SELECT (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT l_returnflag AS x FROM lineitem)) AS flags, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT l_linestatus AS x FROM lineitem)) AS states")
add("stat_sample_by", lambda s, d: table(s, d, "lineitem").sampleBy("l_returnflag", {"A": 1.0, "N": 0.0}, seed=1).select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A'")
add("to_json", lambda s, d: table(s, d, "nation").select(F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey")).alias("row")), "SELECT CAST(to_json({n_nationkey: n_nationkey, n_name: n_name, n_regionkey: n_regionkey}) AS VARCHAR) AS row FROM nation")
add("flat_map", lambda s, d: table(s, d, "part").select("p_partkey", "p_name").mapInPandas(lambda it: (x.assign(word=x.p_name.str.split(" ")).explode("word")[["p_partkey", "word"]] for x in it), "p_partkey long, word string"), "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
add("dataset_reduce", lambda s, d: rel.reduce_rows(table(s, d, "orders"), "o_totalprice", max), "SELECT max(o_totalprice) AS o_totalprice FROM orders")
add("grouped_reduce", lambda s, d: rel.aggregate_with(table(s, d, "orders"), ["o_orderstatus"], "o_orderkey", lambda: 0, max, max, lambda b: b, "top", "long", "long"), "SELECT o_orderstatus, max(o_orderkey) AS top FROM orders GROUP BY 1")
add("typed_aggregator", lambda s, d: rel.aggregate_with(table(s, d, "orders"), ["o_orderpriority"], "o_custkey", lambda: [0, 0], lambda b, x: [b[0] + x, b[1] + 1], lambda a, b: [a[0] + b[0], a[1] + b[1]], lambda b: float(b[0]) / b[1], "mean", "array<long>", "double").select("o_orderpriority", F.round("mean", 6).alias("mean")),
    "SELECT o_orderpriority, round(avg(o_custkey), 6) AS mean FROM orders GROUP BY 1")
add("source_pushdown_more", "SELECT o_orderkey FROM orders WHERE o_custkey <=> 7 OR o_orderpriority LIKE '%LOW' AND o_orderstatus LIKE '%F%' AND o_custkey < 50", "SELECT o_orderkey FROM orders WHERE o_custkey IS NOT DISTINCT FROM 7 OR o_orderpriority LIKE '%LOW' AND o_orderstatus LIKE '%F%' AND o_custkey < 50")


@query("SELECT p_partkey, p_size * 3 AS thrice FROM part")
def udf_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function that SQL knows by name."""

    @F.pandas_udf("int")
    def thrice(x: pd.Series) -> pd.Series:
        return x * 3

    spark.udf.register("thrice_of", thrice)
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql("SELECT p_partkey, thrice_of(p_size) AS thrice FROM part")


# RDDs

add("rdd_sum_and_mean_approx", lambda s, d: (lambda x: s.createDataFrame([(round(float(x.sumApprox(600_000)), 2), round(float(x.meanApprox(600_000)), 4))], "total double, mean double"))(table(s, d, "orders").select("o_totalprice").rdd.map(lambda r: r[0])), "SELECT round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM orders")


@query("SELECT n_name AS name FROM nation")
def source_hadoop_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by a Hadoop input format."""
    path = f"{shared_dir(spark)}/hadoop-{uuid.uuid4().hex}"
    table(spark, sf_dir, "nation").select("n_name").write.text(path)
    kinds = "org.apache.hadoop.mapreduce.lib.input.TextInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text"
    return spark.sparkContext.newAPIHadoopFile(path, *kinds).map(lambda x: (x[1],)).toDF("name string")


# Tables and JDBC


@query("SELECT n_regionkey, 2 * count(*) AS n FROM nation GROUP BY 1")
def table_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE AS SELECT, INSERT, saveAsTable, insertInto, CREATE VIEW, ANALYZE, and DROP of what isn't read any more."""
    name, path = f"t_{uuid.uuid4().hex}", f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{path}/a' AS SELECT n_nationkey, n_regionkey FROM nation")
    spark.table("nation").select("n_nationkey", "n_regionkey").write.insertInto(name)
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR COLUMNS n_regionkey")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name}_v AS SELECT n_regionkey, count(*) AS n FROM {name} GROUP BY n_regionkey")
    spark.table(f"{name}_v").write.option("path", f"{path}/b").saveAsTable(f"{name}_b")
    spark.sql(f"INSERT OVERWRITE TABLE {name}_b SELECT n_regionkey, n FROM {name}_v")
    spark.sql(f"DROP VIEW {name}_v")
    for t in (name, f"{name}_b"):
        spark.sql(f"DROP TABLE {t}")
    return spark.read.parquet(f"{path}/b")  # external: the files stay


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")
def source_jdbc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written over JDBC to an embedded database, which executors read in ranges and again by predicates."""
    name, how = "nations", {"driver": files.DERBY}
    url = files.derby_snapshot(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), name)
    ranged = files.jdbc(spark, url, name, column="n_nationkey", low=0, high=25, parts=3, **how)
    return ranged.union(files.jdbc(spark, url, name, predicates=['"n_nationkey" < 9', '"n_nationkey" >= 9'], **how))


# Graph structure

V = f"SELECT src AS id FROM ({FOLLOWS}) a UNION SELECT dst FROM ({FOLLOWS}) b"
add("graph_mask", graph(lambda g: g.mask(g.subgraph(edge=F.col("cost") < 10)).edges), f"SELECT src, dst, cost FROM ({FOLLOWS}) f WHERE cost < 10")
add("graph_join_vertices", graph(lambda g: g.map_vertices(n=F.lit(0).cast("bigint")).join_vertices(g.out_degrees().withColumnRenamed("degree", "n"), "n").vertices), f"SELECT v.id, coalesce(k, 0) AS n FROM ({V}) v LEFT JOIN (SELECT src, count(*) AS k FROM ({FOLLOWS}) f GROUP BY src) o ON o.src = v.id")
add("graph_vertex_sets", graph(lambda g: g_.vertex_minus(g.vertices, g.out_degrees()).select("id", F.lit("minus").alias("what")).union(g_.vertex_inner_join(g.vertices, g.in_degrees()).select("id", F.lit("inner")))), f"SELECT id, 'minus' AS what FROM ({V}) v WHERE id NOT IN (SELECT src FROM ({FOLLOWS}) f) UNION ALL SELECT DISTINCT dst, 'inner' FROM ({FOLLOWS}) f")
add("graph_edge_inner_join", graph(lambda g: g_.edge_inner_join(g.edges, g.reverse().edges.select("src", "dst", F.col("cost").alias("back")))), f"SELECT a.src, a.dst, a.cost, b.cost AS back FROM ({FOLLOWS}) a JOIN ({FOLLOWS}) b ON a.src = b.dst AND a.dst = b.src")
add("graph_collect_edges", graph(lambda g: g.edges_of("out").select("id", F.size("edges").alias("n"), F.array_join("edges.dst", ",").alias("to_"))), f"SELECT src AS id, CAST(count(*) AS INTEGER) AS n, string_agg(dst, ',' ORDER BY dst) AS to_ FROM ({FOLLOWS}) f GROUP BY src")


@query(f"{WITH_E}, m AS (SELECT min(src) AS x FROM e), r(id, d) USING KEY (id) AS (SELECT x, 0::BIGINT FROM m UNION SELECT e.src, min(r.d + 1) FROM r JOIN e ON e.dst = r.id LEFT JOIN recurring.r o ON o.id = e.src WHERE o.id IS NULL OR r.d + 1 < o.d GROUP BY e.src) SELECT id, (SELECT x FROM m) AS landmark, d AS hops FROM r")
def graph_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops to a landmark along the edges."""
    g = Graph.from_edges(follows(spark, sf_dir).persist())
    first = g.edges.agg(F.min("src")).first()[0]
    return g.shortest_paths([first]).select("id", F.explode("distances").alias("landmark", "hops"))


def _personal_oracle(steps: int) -> str:
    text = f"WITH e AS MATERIALIZED ({FOLLOWS}), s AS (SELECT min(src) AS x FROM e), v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e), o AS MATERIALIZED (SELECT src, count(*) AS k FROM e GROUP BY src), r0 AS (SELECT id, CASE WHEN id = (SELECT x FROM s) THEN 1.0::DOUBLE ELSE 0 END AS rank FROM v)"
    for i in range(1, steps + 1):
        text += f", r{i} AS MATERIALIZED (SELECT v.id, CASE WHEN v.id = (SELECT x FROM s) THEN 0.15 ELSE 0 END + 0.85 * coalesce(t.y, 0) AS rank FROM v LEFT JOIN (SELECT e.dst, sum(p.rank / o.k) AS y FROM e JOIN o ON o.src = e.src JOIN r{i - 1} p ON p.id = e.src GROUP BY e.dst) t ON t.dst = v.id)"
    return f"{text} SELECT id, round(rank, 6) AS rank FROM r{steps}"


@query(_personal_oracle(3))
def graph_page_rank_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps of PageRank that resets to one vertex."""
    g = Graph.from_edges(follows(spark, sf_dir).persist())
    return g.page_rank(3, source=g.edges.agg(F.min("src")).first()[0]).select("id", F.round("rank", 6).alias("rank"))


# Datalog

LENGTHS = D_TREE + "p(A,B,N) <- arc(A,B), N = 1. p(A,B,N) <- p(A,C,M), arc(C,B), N = M + 1."
add("datalog_ternary", datalog(LENGTHS, "p(A,B,N)", "a", "b", "n", arc=TREE), f"{TREE_E}, p(a, b, n) AS (SELECT src, dst, 1 FROM t UNION SELECT p.a, t.dst, p.n + 1 FROM p JOIN t ON t.src = p.b) SELECT a, b, CAST(n AS BIGINT) AS n FROM p")
add("datalog_aggregate_over_recursion", datalog(LENGTHS + " d(A, max<N>, countd<B>) <- p(A,B,N).", "d(A,N,C)", "a", "depth", "n", arc=TREE), f"{TREE_E}, p(a, b, n) AS (SELECT src, dst, 1 FROM t UNION SELECT p.a, t.dst, p.n + 1 FROM p JOIN t ON t.src = p.b) SELECT a, CAST(max(n) AS BIGINT) AS depth, count(DISTINCT b) AS n FROM p GROUP BY a")


@query(ORACLES["datalog_tc_left"])
def datalog_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program and its relation from files."""
    from quern.plans.datalog import Datalog
    from quern.queries import from_sql

    at = f"{shared_dir(spark)}/datalog-{uuid.uuid4().hex}"
    from_sql(TREE)(spark, sf_dir).select(F.concat_ws("\t", "src", "dst").alias("value")).write.text(f"{at}/arc")
    spark.createDataFrame([(D_TREE + "tc(A,B) <- arc(A,B). tc(A,B) <- tc(A,C), arc(C,B).",)], "value string").coalesce(1).write.text(f"{at}/program")
    return Datalog(spark).load_file(f"{at}/program").load_table("arc", f"{at}/arc").query("tc(A,B)").toDF("a", "b")

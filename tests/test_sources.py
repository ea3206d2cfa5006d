"""Sources, sinks, streams, relational operators and the command line."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest

from quern.cli import main
from quern.operators import relational as r
from quern.sources import files
from quern.streaming import counts

ROOT = Path(__file__).resolve().parent.parent


def test_edge_files(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# head\n1 2\n\n 2\t3 7\n")
    assert sorted(map(tuple, files.edge_list(spark, str(tmp_path / "e.txt"), cost=True).collect())) == [(1, 2, 1), (2, 3, 7)]
    (tmp_path / "t.txt").write_text("% head\n1\t2\n\n2\t3\n")
    assert sorted(map(tuple, files.tab_edges(spark, str(tmp_path / "t.txt")).collect())) == [(1, 2, 1), (2, 3, 1)]


@pytest.mark.parametrize("kind", ["parquet", "json", "orc", "csv"])
def test_round_trips(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, None), (3, "c d", -2.0)], "k int, s string, x double")
    back = files.round_trip(df, kind, str(tmp_path / kind), partition_by=["k"] if kind != "csv" else None)
    assert sorted(back.collect(), key=lambda x: x.k) == sorted(df.collect(), key=lambda x: x.k)
    with pytest.raises(Exception, match="already exists"):
        files.write(df, kind, str(tmp_path / kind))
    files.write(df, kind, str(tmp_path / kind), mode="ignore")


def test_relational(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    assert sorted(x.k or 0 for x in r.except_keeping_duplicates(a, spark.createDataFrame([(2,), (None,)], "k int")).collect()) == [1, 1]
    assert r.at_least_non_null(a, 1).count() == 3
    assert {x["bucket"]: x["count"] for x in r.histogram(spark.createDataFrame([(0.0,), (5.0,), (10.0,), (11.0,)], "x double"), "x", [0.0, 5.0, 10.0]).collect()} == {0: 1, 1: 2}


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, v int")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    got = counts.drain(counts.running_counts(counts.file_stream(spark, str(tmp_path / "in"), df.schema), "k"), "drained")
    assert dict(got.collect()) == {"a": 2, "b": 1}
    seen = []
    counts.each_batch(counts.file_stream(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "check"), lambda d, _: seen.append(d.count())).awaitTermination()
    assert sum(seen) == 3
    counts.each_batch(counts.file_stream(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "check"), lambda d, _: seen.append(d.count())).awaitTermination()
    assert sum(seen) == 3  # what was handled isn't handled again


def test_jdbc_and_tables(spark):
    url = "jdbc:derby:memory:quern;create=true"
    df = spark.createDataFrame([(i, f"n{i}") for i in range(20)], "k int, s string")
    df.write.jdbc(url, "t", mode="overwrite", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    how = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    assert files.jdbc(spark, url, "t", **how).count() == 20
    ranged = files.jdbc(spark, url, "t", column="k", low=0, high=20, parts=4, **how)
    assert ranged.rdd.getNumPartitions() == 4 and ranged.count() == 20
    assert files.jdbc(spark, url, "t", predicates=['"k" < 5', '"k" >= 15'], **how).count() == 10


def test_jdbc_snapshot_is_read_by_other_processes(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else "" if i % 7 == 1 else f"é'\n{i}", 10**12 + i if i % 5 else None, i % 2 == 0, i / 4) for i in range(2500)]
    url = files.derby_snapshot(spark.createDataFrame(rows, "k int, s string, n bigint, b boolean, x double").repartition(3), "t")
    got = files.jdbc(spark, url, "t", column="k", low=0, high=2500, parts=4, driver=files.DERBY)
    assert got.dtypes == [("k", "int"), ("s", "string"), ("n", "bigint"), ("b", "boolean"), ("x", "double")]
    assert sorted(map(tuple, got.collect())) == rows
    code = """if 1:
        import sys
        from pyspark.sql import SparkSession
        import __spark_entry__
        s = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "512m").config("spark.checkpoint.dir", sys.argv[1]).config("spark.ui.enabled", "false").getOrCreate()
        print(sorted(map(tuple, __spark_entry__.queries()["source_jdbc"](s, sys.argv[2]).repartition(2).collect())))
    """
    shared, data = spark.conf.get("spark.checkpoint.dir"), "/root/testdata/sf0.001"
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))}
    for p in Path(pyspark.__file__).parent.iterdir():  # a home of its own: the workers' folders go there
        (tmp_path / p.name).symlink_to(p)
    (tmp_path / "work").is_symlink() and (tmp_path / "work").unlink()
    env["SPARK_HOME"] = str(tmp_path)
    ran = subprocess.run([sys.executable, "-c", code, f"file://{shared}/two processes", data], cwd=ROOT, env=env, capture_output=True, text=True, timeout=180)
    nations = spark.read.parquet(f"{data}/nation*").select("n_nationkey", "n_name").collect()
    assert ran.returncode == 0 and ran.stdout.strip().endswith(str(sorted([tuple(r) for r in nations] * 2))), ran.stderr[-3000:]


def test_saved_tables(spark, tmp_path):
    spark.sql(f"CREATE TABLE saved (k INT, s STRING) USING parquet LOCATION '{tmp_path}/saved'")
    try:
        spark.createDataFrame([(1, "a")], "k int, s string").write.insertInto("saved")
        spark.sql("INSERT INTO saved SELECT 2, 'b'")
        spark.sql("ANALYZE TABLE saved COMPUTE STATISTICS")
        assert spark.table("saved").count() == 2 and spark.sql("DESCRIBE EXTENDED saved").count() > 2
    finally:
        spark.sql("DROP TABLE saved")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "g.txt").write_text("1\t2\n2\t3\n3\t1\n")
    for q, n in (("sssp", "3 rows"), ("reach", "3 rows"), ("cc", "1 rows"), ("SELECT * FROM edge", "3 rows")):
        main(["-g", str(tmp_path / "g.txt"), "-q", q])
        assert n in capsys.readouterr().out

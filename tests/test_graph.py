"""Graph algorithms on small graphs with known answers."""

import pytest
from pyspark.sql import functions as F

from quern.operators import graph as g


@pytest.fixture
def make(spark):
    return lambda edges: g.Graph.from_edges(spark.createDataFrame(edges, "src bigint, dst bigint"))


def rows(df):
    return sorted(map(tuple, df.collect()))


ROADS = [(1, 2), (1, 5), (2, 3), (2, 5), (3, 4), (4, 5), (4, 6)]


def test_shortest_paths_to_landmarks(make):
    found = dict(make(ROADS + [(b, a) for a, b in ROADS]).shortest_paths([1, 4]).collect())
    assert found == {1: {1: 0, 4: 2}, 2: {1: 1, 4: 2}, 3: {1: 2, 4: 1}, 4: {1: 2, 4: 0}, 5: {1: 1, 4: 1}, 6: {1: 3, 4: 1}}


@pytest.mark.parametrize(("edges", "expected"), [([(0, 1), (1, 2), (2, 0)], {0: 1, 1: 1, 2: 1}), ([(0, 1), (1, 2), (2, 0), (0, -1), (-1, -2), (-2, 0)], {0: 2, 1: 1, 2: 1, -1: 1, -2: 1}), ([(0, 1), (1, 2)], {0: 0, 1: 0, 2: 0}), ([(0, 1), (1, 0), (1, 2), (2, 0), (0, 2), (1, 1)], {0: 1, 1: 1, 2: 1})])
def test_triangles(make, edges, expected):
    assert dict(make(edges).triangles().collect()) == expected


def test_components(make):
    assert dict(make([(1, 2), (3, 2), (7, 8)]).connected_components().collect()) == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    assert dict(make([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3), (5, 6)]).strongly_connected_components().collect()) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6}


def test_page_rank(make, spark):
    star = g.Graph.from_edges(g.star(spark, 10))
    ranks = dict(star.page_rank(tolerance=1e-9).collect())
    assert ranks[0] == pytest.approx(0.15 + 0.85 * 9 * 0.15) and ranks[3] == pytest.approx(0.15)
    assert dict(star.page_rank(5).collect())[0] == pytest.approx(ranks[0])
    mine = dict(make([(0, 1), (1, 2)]).page_rank(tolerance=1e-9, source=0).collect())
    assert mine[2] == pytest.approx(0.15 * 0.85**2) and make([(0, 1)]).page_rank(3).count() == 2


def test_labels_and_pregel(make):
    two = make([(0, 1), (1, 2), (0, 2), (5, 6), (6, 7), (5, 7)])
    assert dict(two.label_propagation(4).collect()) == {0: 0, 1: 0, 2: 0, 5: 5, 6: 5, 7: 5}
    least = two.pregel(F.col("id"), lambda v, m: F.least(v, m), F.min, to_src=F.when(F.col("dst_value") < F.col("src_value"), F.col("dst_value")), to_dst=F.when(F.col("src_value") < F.col("dst_value"), F.col("src_value")))
    assert dict(least.collect()) == {0: 0, 1: 0, 2: 0, 5: 5, 6: 5, 7: 5}


def test_structure(make, spark):
    a = make(ROADS)
    assert a.reverse().edges.where("src = 5 and dst = 4").count() == 1
    assert rows(a.subgraph(F.col("id") < 4).edges) == [(1, 2), (2, 3)]
    assert rows(a.mask(make([(1, 2), (9, 9)])).edges) == [(1, 2)]
    assert dict(a.in_degrees().collect())[5] == 3 and dict(a.out_degrees().collect())[1] == 2 and dict(a.degrees().collect())[4] == 3
    assert dict(a.neighbour_ids("out").collect())[1] == [2, 5]
    assert rows(make([(2, 1), (1, 2)]).canonical(n=F.count("*")).edges) == [(1, 2, 2)]
    assert a.map_vertices(x=F.col("id") * 2).triplets().where("src_attr.x = 2").count() == 2
    v = a.map_vertices(x=F.lit(0)).join_vertices(spark.createDataFrame([(1, 7)], "id bigint, x int"), "x").vertices
    assert dict(v.collect())[1] == 7 and dict(v.collect())[2] == 0
    assert a.aggregate_messages(F.sum, to_dst=F.lit(1)).where("id = 5").first().message == 3
    assert g.vertex_minus(a.vertices, spark.createDataFrame([(1,)], "id bigint")).count() == 5
    assert rows(a.reachable(spark.createDataFrame([(3,)], "id bigint"))) == [(3,), (4,), (5,), (6,)]


def test_generators(spark):
    assert g.grid(spark, 3, 4).count() == 17 and g.star(spark, 5).count() == 4
    assert g.rmat(spark, 4, 50).where("src < 16 and dst < 16 and src >= 0").count() == 50
    assert g.log_normal(spark, 10).where("dst between 0 and 9").count() > 0


def test_label_propagation_of_text_ids(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "src string, dst string")
    assert {r.id: r.label for r in g.Graph.from_edges(e).label_propagation(1).collect()} == {"a": "b", "b": "a", "c": "b", "x": "y", "y": "x"}

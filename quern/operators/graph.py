"""Graph algorithms on edge DataFrames.

Edges have columns src and dst (and others that pass through).  Every loop cuts lineage
with a checkpoint in the shared folder and aggregates messages before any join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans import fixpoint as fx
from quern.session import shared_dir


class Graph:
    """Vertices (id, ...) and edges (src, dst, ...)."""

    def __init__(self, vertices: DataFrame, edges: DataFrame):
        self.vertices, self.edges = vertices, edges

    @classmethod
    def from_edges(cls, edges: DataFrame) -> Graph:
        return cls(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), edges)

    # structure

    def reverse(self) -> Graph:
        return Graph(self.vertices, self.edges.select(*(F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in self.edges.columns)))

    def subgraph(self, vertex: Column | None = None, edge: Column | None = None) -> Graph:
        """The vertices that fit, and the edges that fit and join two of them."""
        v = self.vertices.where(vertex) if vertex is not None else self.vertices
        e = self.edges.where(edge) if edge is not None else self.edges
        for end in ("src", "dst"):
            e = e.join(v.select(F.col("id").alias(end)), end, "left_semi")
        return Graph(v, e.select(*self.edges.columns))

    def mask(self, other: Graph) -> Graph:
        """What other has too, with this graph's attributes."""
        return Graph(self.vertices.join(other.vertices.select("id"), "id", "left_semi"), self.edges.join(other.edges.select("src", "dst"), ["src", "dst"], "left_semi"))

    def map_vertices(self, **columns: Column) -> Graph:
        return Graph(self.vertices.withColumns(columns), self.edges)

    def map_edges(self, **columns: Column) -> Graph:
        return Graph(self.vertices, self.edges.withColumns(columns))

    def triplets(self) -> DataFrame:
        """Edges with their ends' attributes as structs `src_attr` and `dst_attr`."""
        names = [c for c in self.vertices.columns if c != "id"]
        v = self.vertices.select("id", F.struct(*names).alias("attr") if names else F.lit(None).alias("attr"))
        e = self.edges
        for end in ("src", "dst"):
            e = e.join(v.select(F.col("id").alias(end), F.col("attr").alias(f"{end}_attr")), end)
        return e

    def map_triplets(self, **columns: Column) -> Graph:
        """Edge columns computed from the edge and its ends (src_attr, dst_attr)."""
        e = self.triplets().withColumns(columns)
        return Graph(self.vertices, e.select(*self.edges.columns, *(c for c in columns if c not in self.edges.columns)))

    def filter(self, make: Callable[[Graph], Graph], vertex: Column | None = None, edge: Column | None = None) -> Graph:
        """This graph restricted to what passes the tests in a graph computed from it."""
        return self.mask(make(self).subgraph(vertex, edge))

    def edges_of(self, direction: str = "either") -> DataFrame:
        """(id, edges): the edges at each vertex, as an array of structs in order."""
        one = F.struct(*self.edges.columns).alias("e")
        out, into = self.edges.select(F.col("src").alias("id"), one), self.edges.select(F.col("dst").alias("id"), one)
        every = {"out": out, "in": into, "either": out.union(into)}[direction]
        return every.groupBy("id").agg(F.sort_array(F.collect_list("e")).alias("edges"))

    def dealt(self, strategy: str = "canonical", parts: int | None = None) -> Graph:
        """The edges repartitioned: by source (1d), by both ends (random), by both ends in either direction (canonical), or in a grid of blocks (2d)."""
        n = parts or int(self.edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        side = max(1, int(n**0.5))
        keys = {
            "1d": [F.col("src")], "random": [F.col("src"), F.col("dst")], "canonical": [F.least("src", "dst"), F.greatest("src", "dst")],
            "2d": [F.pmod(F.xxhash64("src"), F.lit(side)), F.pmod(F.xxhash64("dst"), F.lit(side))],
        }[strategy]
        return Graph(self.vertices, self.edges.repartition(n, *keys))

    def group_edges(self, **merged: Column) -> Graph:
        """Parallel edges as one."""
        return Graph(self.vertices, self.edges.groupBy("src", "dst").agg(*(c.alias(n) for n, c in merged.items())) if merged else self.edges.select("src", "dst").distinct())

    def canonical(self, **merged: Column) -> Graph:
        """Every edge from its lesser to its greater end, merged."""
        e = self.edges.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
        return Graph(self.vertices, e).group_edges(**merged)

    def outer_join_vertices(self, other: DataFrame) -> Graph:
        return Graph(self.vertices.join(other, "id", "left"), self.edges)

    def join_vertices(self, other: DataFrame, value: str) -> Graph:
        """`value` of the vertices that `other` (id, value) has is replaced."""
        new = other.select("id", F.col(value).alias("__new"), F.lit(True).alias("__has"))
        return Graph(self.vertices.join(new, "id", "left").withColumn(value, F.when(F.col("__has"), F.col("__new")).otherwise(F.col(value))).drop("__new", "__has"), self.edges)

    # neighbourhoods

    def in_degrees(self) -> DataFrame:
        return self.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))

    def out_degrees(self) -> DataFrame:
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))

    def degrees(self) -> DataFrame:
        return self._ends().groupBy("id").agg(F.count("*").alias("degree"))

    def _ends(self) -> DataFrame:
        return self.edges.select(F.col("src").alias("id"), F.col("dst").alias("to")).union(self.edges.select("dst", "src"))

    def neighbour_ids(self, direction: str = "either") -> DataFrame:
        """(id, neighbours), sorted, with repeats."""
        e = {"out": self.edges.select(F.col("src").alias("id"), F.col("dst").alias("to")), "in": self.edges.select(F.col("dst").alias("id"), F.col("src").alias("to")), "either": self._ends()}[direction]
        return e.groupBy("id").agg(F.sort_array(F.collect_list("to")).alias("neighbours"))

    def aggregate_messages(self, merge: Callable[[Column], Column], to_src: Column | None = None, to_dst: Column | None = None) -> DataFrame:
        """(id, message): messages computed on triplets, merged at the vertices they go to."""
        t = self.triplets()
        sent = [t.select(F.col(end).alias("id"), m.alias("message")) for end, m in (("src", to_src), ("dst", to_dst)) if m is not None]
        every = sent[0] if len(sent) == 1 else sent[0].union(sent[1])
        return every.where("message is not null").groupBy("id").agg(merge(F.col("message")).alias("message"))

    def pregel(self, first: Column, program: Callable[[Column, Column], Column], merge: Callable[[Column], Column], to_src: Column | None = None, to_dst: Column | None = None, most_iterations: int = 20) -> DataFrame:
        """(id, value): vertex programs over (value, message) until no message is sent.

        Messages see src_value and dst_value; only edges with an end that got a message in
        the last step send.
        """
        shared_dir(self.vertices.sparkSession)
        state = self.vertices.select("id", first.alias("value"), F.lit(True).alias("active")).checkpoint()
        e = self.edges
        for _ in range(most_iterations):
            t = e.join(state.select(F.col("id").alias("src"), F.col("value").alias("src_value"), F.col("active").alias("sa")), "src")
            t = t.join(state.select(F.col("id").alias("dst"), F.col("value").alias("dst_value"), F.col("active").alias("da")), "dst").where("sa or da")
            sent = [t.select(F.col(end).alias("id"), m.alias("message")) for end, m in (("src", to_src), ("dst", to_dst)) if m is not None]
            every = sent[0] if len(sent) == 1 else sent[0].union(sent[1])
            got = every.where("message is not null").groupBy("id").agg(merge(F.col("message")).alias("message"), F.lit(True).alias("got"))
            state = state.join(got, "id", "left").select("id", F.when(F.col("got"), program(F.col("value"), F.col("message"))).otherwise(F.col("value")).alias("value"), F.coalesce("got", F.lit(False)).alias("active")).checkpoint()
            if state.where("active").isEmpty():
                break
        return state.select("id", "value")

    # algorithms

    def connected_components(self) -> DataFrame:
        """(id, component): the least id that undirected edges lead to."""
        both = self._ends()
        base = self.vertices.select("id", F.col("id").alias("component"))
        return fx.closure(base, lambda d: d.join(both, "id").select(F.col("to").alias("id"), "component"), fx.MIN, "component")

    def reachable(self, start: DataFrame) -> DataFrame:
        """The vertices that edges lead to from those of `start` (id), which are among them."""
        e = self.edges.select(F.col("src").alias("id"), "dst")
        return fx.closure(start.select("id"), lambda d: d.join(e, "id").select(F.col("dst").alias("id")))

    def distances(self, start: DataFrame, cost: str | None = None, **how) -> DataFrame:
        """(id, distance): the least cost of a path from a vertex of `start` (id); a step costs 1 without `cost`."""
        e = self.edges.select(F.col("src").alias("id"), "dst", (F.col(cost) if cost else F.lit(1)).cast("bigint").alias("step"))
        base = start.select("id", F.lit(0).cast("bigint").alias("distance"))
        return fx.closure(base, lambda d: d.join(e, "id").select(F.col("dst").alias("id"), (F.col("distance") + F.col("step")).alias("distance")), fx.MIN, "distance", **how)

    def shortest_paths(self, landmarks: list) -> DataFrame:
        """(id, distances): hops along out-edges to each landmark that can be reached, as a map."""
        spark = self.vertices.sparkSession
        kind = self.edges.schema["src"].dataType
        base = spark.createDataFrame([(x,) for x in landmarks], "x string").select(F.col("x").cast(kind).alias("id"), F.col("x").cast(kind).alias("landmark"), F.lit(0).cast("bigint").alias("hops"))
        e = self.edges.select(F.col("dst").alias("id"), "src")
        found = fx.closure(base, lambda d: d.join(e, "id").select(F.col("src").alias("id"), "landmark", (F.col("hops") + 1).alias("hops")), fx.MIN, "hops")
        return found.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("landmark", "hops")))).alias("distances"))

    def strongly_connected_components(self, most_rounds: int = 50) -> DataFrame:
        """(id, component): the least id of those that are reached from and reach a vertex.

        Rounds of trimming, of the least id forward, and of that colour's vertices backward;
        each settles at least one component a colour.
        """
        shared_dir(self.vertices.sparkSession)
        left = self.vertices.select("id").checkpoint()
        done = None
        for _ in range(most_rounds):
            if left.isEmpty():
                break
            e = self.edges.select("src", "dst").distinct()
            for end in ("src", "dst"):
                e = e.join(left.select(F.col("id").alias(end)), end, "left_semi")
            e = e.checkpoint()
            colour = fx.closure(left.select("id", F.col("id").alias("c")), lambda d, e=e: d.join(e, d["id"] == e["src"]).select(F.col("dst").alias("id"), "c"), fx.MIN, "c").checkpoint()
            inner = e.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd")
            inner = inner.select("src", "dst").checkpoint()
            back = fx.closure(colour.where("id = c").select("id", "c"), lambda d, i=inner: d.join(i, d["id"] == i["dst"]).select(F.col("src").alias("id"), "c"))
            back = back.select("id", F.col("c").alias("component")).checkpoint()
            done = back if done is None else done.union(back)
            left = left.join(back.select("id"), "id", "left_anti").checkpoint()
        else:
            raise fx.Diverged("strongly connected components did not settle")
        return done if done is not None else self.vertices.select("id", F.col("id").alias("component"))

    def triangles(self) -> DataFrame:
        """(id, triangles) of every vertex.

        Edges point from the end of lower degree to the other, so that no vertex opens
        more wedges than the square root of twice the edges for each edge it has.
        """
        e = self.canonical().edges.where("src <> dst")
        degree = Graph(self.vertices, e).degrees()
        e = e.join(degree.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(degree.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
        up = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
        e = e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b"))
        wedge = e.join(e.select("a", F.col("b").alias("c")), "a").where("b < c")
        closed = e.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("c"))
        found = wedge.join(closed, ["b", "c"]).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
        return self.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("triangles", F.lit(0)).alias("triangles"))

    def label_propagation(self, steps: int) -> DataFrame:
        """(id, label): each step a vertex takes its neighbours' most common label, the least of those that tie."""
        shared_dir(self.vertices.sparkSession)
        both = self._ends()
        state = self.vertices.select("id", F.col("id").alias("label"))
        for _ in range(steps):
            votes = both.join(state.withColumnRenamed("id", "to"), "to").groupBy("id", "label").agg(F.count("*").alias("n"))
            best = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("votes"), "label")).alias("m")).select("id", F.col("m.label").alias("new"))
            state = state.join(best, "id", "left").select("id", F.coalesce("new", "label").alias("label")).checkpoint()
        return state

    def page_rank(self, iterations: int | None = None, tolerance: float = 1e-4, reset: float = 0.15, source=None, most_iterations: int = 500) -> DataFrame:
        """(id, rank), unnormalised.

        With `iterations`, so many synchronous steps from rank `reset`; else steps until no
        rank changes by `tolerance`.  With `source`, only that vertex is reset to.
        """
        shared_dir(self.vertices.sparkSession)
        out = self.out_degrees().select(F.col("id").alias("src"), "degree")
        links = self.edges.select("src", "dst").join(out, "src").select("src", "dst", (1.0 / F.col("degree")).alias("share")).checkpoint()
        back = F.lit(reset) if source is None else F.when(F.col("id") == source, reset).otherwise(0.0)
        state = self.vertices.select("id", back.alias("back"), (F.lit(reset) if source is None else F.when(F.col("id") == source, 1.0).otherwise(0.0)).alias("rank"))
        for _ in range(iterations if iterations is not None else most_iterations):
            got = links.join(state.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("sum"))
            new = state.join(got, "id", "left").select("id", "back", (F.col("back") + (1 - reset) * F.coalesce("sum", F.lit(0.0))).alias("rank"), F.col("rank").alias("old")).checkpoint()
            state = new.drop("old")
            if iterations is None and new.where(F.abs(F.col("rank") - F.col("old")) >= tolerance).isEmpty():
                break
        return state.select("id", "rank")


def vertex_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """The vertices of a that b lacks."""
    return a.join(b.select("id"), "id", "left_anti")


def vertex_diff(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """The vertices of both whose value differs, with b's."""
    return b.join(a.select("id", F.col(value).alias("__a")), "id").where(~F.col("__a").eqNullSafe(F.col(value))).drop("__a")


def vertex_left_join(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "id", "left")


def vertex_inner_join(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "id")


def aggregate_using_index(vertices: DataFrame, messages: DataFrame, value: Column) -> DataFrame:
    """Messages (id, ...) to the given vertices alone, merged to (id, value)."""
    return messages.join(vertices.select("id"), "id", "left_semi").groupBy("id").agg(value.alias("value"))


def edge_inner_join(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, ["src", "dst"])


def star(spark, n: int) -> DataFrame:
    """Edges from 1..n-1 to 0."""
    return spark.range(1, n).select(F.col("id").alias("src"), F.lit(0).cast("bigint").alias("dst"))


def grid(spark, rows: int, columns: int) -> DataFrame:
    """Edges right and down in a grid; a vertex's id is row * columns + column."""
    v = spark.range(rows * columns).select(F.col("id").alias("src"), (F.col("id") % columns).alias("c"))
    right = v.where(f"c < {columns - 1}").select("src", (F.col("src") + 1).alias("dst"))
    return right.union(v.where(f"src < {(rows - 1) * columns}").select("src", (F.col("src") + columns).alias("dst")))


def log_normal(spark, n: int, mu: float = 4.0, sigma: float = 1.3, seed: int = 1) -> DataFrame:
    """Edges to random vertices, with log-normally many from each of n vertices."""
    v = spark.range(n).select(F.col("id").alias("src"), F.least(F.lit(n), F.exp(mu + sigma * F.randn(seed)).cast("bigint")).alias("k"))
    return v.where("k > 0").select("src", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("i")).select("src", F.floor(F.rand(seed + 1) * n).cast("bigint").alias("dst"))


def rmat(spark, scale: int, n_edges: int, a: float = 0.45, b: float = 0.15, c: float = 0.15, seed: int = 1) -> DataFrame:
    """n_edges recursive-matrix edges over 2^scale vertices."""
    e = spark.range(n_edges).select(F.lit(0).cast("bigint").alias("src"), F.lit(0).cast("bigint").alias("dst"), "id")
    for i in range(scale):
        e = e.withColumn("r", F.rand(seed * 1000 + i))
        e = e.select("id", (F.col("src") * 2 + (F.col("r") >= a + b).cast("bigint")).alias("src"), (F.col("dst") * 2 + (((F.col("r") >= a) & (F.col("r") < a + b)) | (F.col("r") >= a + b + c)).cast("bigint")).alias("dst"))
    return e.select("src", "dst")


def top_neighbours(edges: DataFrame, k: int) -> DataFrame:
    """(src, dst, rank): each vertex's k least neighbours."""
    return edges.select("src", "dst").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(f"rank <= {k}")

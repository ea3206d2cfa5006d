"""Datalog: language features on small relations, and recursion against naive evaluation."""

import random

import pytest

from quern.plans.datalog import Datalog, Problem
from quern.plans.fixpoint import Diverged

DAG = [(0, 1), (1, 2), (2, 3), (3, 4), (1, 5), (5, 6), (6, 7), (7, 8), (8, 9), (9, 10)]
ARC = "database({arc(X: integer, Y: integer)}).\n"


def rows(df):
    return sorted(map(tuple, df.collect()))


def closure(edges):
    found = set(edges)
    while True:
        more = {(a, d) for a, b in found for c, d in edges if b == c} - found
        if not more:
            return sorted(found)
        found |= more


def engine(spark, program, **relations):
    d = Datalog(spark, program)
    for name, r in relations.items():
        d.load_rows(name, r)
    return d


def arcs(edges):
    return [f"{a},{b}" for a, b in edges]


@pytest.mark.parametrize("rule", ["tc(A,C), arc(C,B)", "arc(A,C), tc(C,B)", "tc(A,C), tc(C,B)"])
@pytest.mark.parametrize("edges", [DAG, [(1, 2), (2, 3), (3, 1), (3, 4)], []])
def test_closure(spark, rule, edges):
    d = engine(spark, ARC + f"tc(A,B) <- arc(A,B). tc(A,B) <- {rule}.", arc=arcs(edges)) if edges else Datalog(spark, ARC + f"tc(A,B) <- arc(A,B). tc(A,B) <- {rule}.").load("arc", spark.createDataFrame([], "a int, b int"))
    assert rows(d.query("tc(A,B)")) == closure(edges)


def test_closure_on_random_graphs(spark):
    r = random.Random(4)
    edges = sorted({(r.randrange(12), r.randrange(12)) for _ in range(18)})
    d = engine(spark, ARC + "tc(A,B) <- arc(A,B). tc(A,B) <- tc(A,C), tc(C,B).", arc=arcs(edges))
    assert rows(d.query("tc(A,B)")) == closure(edges)


def test_bound_goal_and_stats(spark):
    d = engine(spark, ARC + "tc(A,B) <- arc(A,B). tc(A,B) <- tc(A,C), arc(C,B).", arc=arcs(DAG))
    assert [b for _, b in rows(d.query("tc(5, B)"))] == [6, 7, 8, 9, 10]
    assert d.stats["tc"].iterations > 1


def test_mutual_recursion(spark):
    d = engine(spark, ARC + "odd(X,Y) <- arc(X,Y). even(X,Y) <- odd(X,Z), arc(Z,Y). odd(X,Y) <- even(X,Z), arc(Z,Y).", arc=arcs([(1, 2), (2, 3), (3, 4)]))
    assert rows(d.query("even(X,Y)")) == [(1, 3), (2, 4)]
    assert rows(d.query("odd(X,Y)")) == [(1, 2), (1, 4), (2, 3), (3, 4)]


def test_monotonic_minimum(spark):
    p = "database({arc(X: integer, Y: integer, D: integer)}). sp(B, mmin<D>) <- B=0, D=0. sp(B, mmin<D>) <- sp(A,C), arc(A,B,E), D = C + E."
    d = engine(spark, p, arc=["0,1,5", "0,2,1", "2,1,1", "1,3,1", "3,0,1", "0,1,9"])
    assert rows(d.query("sp(A,D)")) == [(0, 0), (1, 2), (2, 1), (3, 3)]


def test_all_pairs_nonlinear(spark):
    p = "database({arc(X: integer, Y: integer, D: integer)}). p(A, B, mmin<D>) <- arc(A,B,D). p(A, B, mmin<D>) <- p(A,C,E), p(C,B,F), D = E + F."
    d = engine(spark, p, arc=["0,1,1", "1,2,1", "0,2,5", "2,0,1"])
    assert (0, 2, 2) in rows(d.query("p(A,B,D)"))


def test_counts_on_a_cycle_diverge(spark):
    p = ARC + "n(B, msum<C>) <- B=1, C=1. n(B, msum<C>) <- n(A,C), arc(A,B)."
    d = engine(spark, p, arc=["1,2", "2,1"])
    d.most_iterations = 5
    with pytest.raises(Diverged):
        d.query("n(A,C)")


def test_same_generation(spark):
    p = "database({pc(P: integer, C: integer)}). sg(X,Y) <- pc(P,X), pc(P,Y), X ~= Y. sg(X,Y) <- pc(A,X), sg(A,B), pc(B,Y)."
    d = engine(spark, p, pc=["1,2", "1,3", "2,4", "3,5"])
    assert rows(d.query("sg(X,Y)")) == [(2, 3), (3, 2), (4, 5), (5, 4)]


STAFF = "database({emp(Id: integer, Dept: integer, Name: string), dept(Dept: integer, Title: string), pay(Id: integer, Amount: double, Start: datetime)}).\n"
FACTS = {"emp": ["1, 10, Bob", "2, 20, Ann", "3, 10, Cy"], "dept": ["10, shop", "20, lab", "30, yard"], "pay": ["1, 5.5, 2009-01-01", "2, 7.0, 2011-06-01"]}


@pytest.mark.parametrize(
    ("rules", "goal", "expected"),
    [
        ("", "emp(A, B, 'Bob')", [(1, 10, "Bob")]),
        ("q(N, T) <- emp(_, D, N), dept(D, T). % join", "q(N, T)", [("Ann", "lab"), ("Bob", "shop"), ("Cy", "shop")]),
        ("q(T) <- dept(D, T), ~emp(_, D, _).", "q(T)", [("yard",)]),
        ("q(I) <- pay(I, _, S), S <= '2010-12-31'.", "q(I)", [(1,)]),
        ("q(I, V) <- pay(I, A, _), V = A * 2 + 1.", "q(I, V)", [(1, 12.0), (2, 15.0)]),
        ("q(I) <- emp(I, _, _). q(I) <- pay(I, _, _).", "q(I)", [(1,), (2,), (3,)]),
        ("q(D, count<_>, min<I>, max<I>) <- emp(I, D, _).", "q(D, A, B, C)", [(10, 2, 1, 3), (20, 1, 2, 2)]),
        ("q(sum<A>, avg<A>, countd<I>) <- pay(I, A, _).", "q(A, B, C)", [(12.5, 6.25, 2)]),
        ("q(I) <- emp(I, _, _), I > 1, I ~= 2.", "q(I)", [(3,)]),
        ("q(X) <- X = 1.", "q(X)", [(1,)]),
        ("q(I, N) <- emp(I, _, N), sort((I, desc)), limit(1).", "q(I, N)", [(3, "Cy")]),
        ("q(N) <- emp(_, _, N), N = 'Cy'.", "q(N)", [("Cy",)]),
    ],
)
def test_language(spark, rules, goal, expected):
    assert rows(engine(spark, STAFF + rules, **FACTS).query(goal)) == expected


@pytest.mark.parametrize("text", ["p(X) <- q(X)", "p(X <- q(X).", "database({p(X: blob)}).", "p(X) <- q(X), ?."])
def test_text_that_is_no_program(spark, text):
    with pytest.raises(Problem):
        Datalog(spark, text)


@pytest.mark.parametrize("rules", ["p(X) <- arc(X,_), ~p(X).", "p(X, count<Y>) <- arc(X,Y). p(X, count<Y>) <- p(X,Y), arc(X,Y).", "p(X,Y) <- arc(X,_).", "p(X) <- arc(X,_), X < Z."])
def test_programs_without_meaning(spark, rules):
    with pytest.raises(Problem):
        engine(spark, ARC + rules, arc=["1,2"]).query("p(X)" if "Y)" not in rules else "p(X,Y)").collect()


def test_files(spark, tmp_path):
    (tmp_path / "arc.csv").write_text("% a comment\n1, 2\n\n2, 3\n")
    (tmp_path / "p.dl").write_text(ARC + "tc(A,B) <- arc(A,B). tc(A,B) <- tc(A,C), arc(C,B).")
    d = Datalog(spark).load_file(str(tmp_path / "p.dl")).load_table("arc", str(tmp_path / "arc.csv"))
    assert rows(d.query("tc(A,B)")) == [(1, 2), (1, 3), (2, 3)]
    d.reset()
    assert not d.rules

"""Datalog programs over DataFrames.

    database({arc(X: integer, Y: integer)}).
    tc(A, B) <- arc(A, B).
    tc(A, B) <- tc(A, C), arc(C, B).

Bodies hold atoms, negated atoms (~p(X)), comparisons (= ~= < <= > >=), arithmetic
(Z = X + Y), sort((Z, desc)) and limit(n).  Heads may aggregate: min<X>, max<X>, sum<X>,
count<X>, count<_>, avg<X>, countd<X> over finished relations, and mmin, mmax, msum and
mcount inside a recursion.  Names that begin in lower case are constants, `_` is any
value, `%` begins a comment.  Several rules of a head are a set union; an aggregate takes
its body's rows as they come.  Relations are evaluated stratum by stratum; those that
depend on each other are one semi-naive fixpoint.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.plans import fixpoint as fx

#: The declared types.
TYPES = {
    "byte": T.ByteType(), "short": T.ShortType(), "int": T.IntegerType(), "integer": T.IntegerType(), "long": T.LongType(),
    "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "datetime": T.DateType(),
}
AGGREGATES = ("mmin", "mmax", "msum", "mcount", "countd", "count", "min", "max", "sum", "avg")
_TOKEN = re.compile(r"\s+|%[^\n]*|(?P<string>'[^']*')|(?P<number>\d+\.\d+|\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op><-|<=|>=|~=|[-+*/=<>~(){},.:])")


class Problem(ValueError):
    """A program that can't be read or evaluated."""


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Agg:
    name: str
    of: Var | None


@dataclass(frozen=True)
class Op:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Atom:
    name: str
    args: tuple
    negated: bool = False


@dataclass(frozen=True)
class Compare:
    op: str
    left: object
    right: object


@dataclass
class Rule:
    head: Atom
    body: list
    sort: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None

    @property
    def aggregates(self) -> list[Agg]:
        return [a for a in self.head.args if isinstance(a, Agg)]

    @property
    def monotonic(self) -> bool:
        return any(a.name.startswith("m") and a.name not in ("min", "max") for a in self.aggregates)


class Parser:
    """Recursive descent over the tokens of a program."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise Problem(f"can't read: {text[at : at + 20]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.fresh = 0, 0

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k][1] if self.at + k < len(self.tokens) else ""

    def take(self, what: str | None = None) -> str:
        got = self.peek()
        if not got or what and got != what:
            raise Problem(f"expected {what or 'more'}, found {got or 'the end'}")
        self.at += 1
        return got

    def list_of(self, item, end: str) -> list:
        out = []
        while self.peek() != end:
            out.append(item())
            if self.peek() == ",":
                self.take()
        self.take(end)
        return out

    def term(self):
        kind, got = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if got == "-":
            self.take()
            x = self.term()
            return Const(-x.value) if isinstance(x, Const) else Op("-", Const(0), x)
        if got == "(":
            self.take()
            x = self.expression()
            self.take(")")
            return x
        self.take()
        if kind == "string":
            return Const(got[1:-1])
        if kind == "number":
            return Const(float(got) if "." in got else int(got))
        if kind != "name":
            raise Problem(f"not a term: {got}")
        if got == "_":
            self.fresh += 1
            return Var(f"_{self.fresh}")
        return Var(got) if got[0].isupper() or got[0] == "_" else Const(got)

    def product(self):
        x = self.term()
        while self.peek() in ("*", "/"):
            x = Op(self.take(), x, self.term())
        return x

    def expression(self):
        x = self.product()
        while self.peek() in ("+", "-"):
            x = Op(self.take(), x, self.product())
        return x

    def argument(self):
        if self.peek() in AGGREGATES and self.peek(1) == "<":
            name = self.take()
            self.take("<")
            of = self.term()
            self.take(">")
            return Agg(name, None if isinstance(of, Var) and of.name.startswith("_") else of)
        return self.expression()

    def atom(self) -> Atom:
        negated = self.peek() == "~"
        if negated:
            self.take()
        name = self.take()
        args = []
        if self.peek() == "(":
            self.take()
            args = self.list_of(self.argument, ")")
        return Atom(name, tuple(args), negated)

    def rule(self) -> Rule:
        r = Rule(self.atom(), [])
        if self.peek() == "<-":
            self.take()
            while self.peek() != ".":
                self.literal(r)
                if self.peek() == ",":
                    self.take()
        self.take(".")
        return r

    def literal(self, r: Rule) -> None:
        if self.peek() == "~" or self.peek(1) == "(" and self.tokens[self.at][0] == "name" and self.peek() not in ("sort", "limit"):
            r.body.append(self.atom())
        elif self.peek() == "sort":
            self.take()
            self.take("(")

            def one():
                self.take("(")
                name = self.take()
                self.take(",")
                order = self.take()
                self.take(")")
                return name, order == "asc"

            r.sort = self.list_of(one, ")")
        elif self.peek() == "limit":
            self.take()
            self.take("(")
            r.limit = int(self.take())
            self.take(")")
        else:
            left = self.expression()
            op = self.take()
            if op not in ("=", "~=", "<", "<=", ">", ">="):
                raise Problem(f"not a comparison: {op}")
            r.body.append(Compare(op, left, self.expression()))

    def program(self) -> tuple[dict[str, T.StructType], list[Rule]]:
        schemas, rules = {}, []
        while self.at < len(self.tokens):
            if self.peek() == "database":
                self.take()
                self.take("(")
                self.take("{")
                for name, fields in self.list_of(self.relation, "}"):
                    schemas[name] = T.StructType(fields)
                self.take(")")
                self.take(".")
            else:
                rules.append(self.rule())
        return schemas, rules

    def relation(self):
        name = self.take()
        self.take("(")

        def column():
            c = self.take()
            self.take(":")
            kind = self.take().lower()
            if kind not in TYPES:
                raise Problem(f"not a type: {kind}")
            return T.StructField(c, TYPES[kind], True)

        return name, self.list_of(column, ")")


def variables(x) -> set[str]:
    if isinstance(x, Var):
        return {x.name}
    if isinstance(x, Op | Compare):
        return variables(x.left) | variables(x.right)
    if isinstance(x, Agg):
        return variables(x.of) if x.of else set()
    return set()


def column(x) -> Column:
    if isinstance(x, Var):
        return F.col(f"`{x.name}`")
    if isinstance(x, Const):
        return F.lit(x.value)
    a, b = column(x.left), column(x.right)
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[x.op]()


def components(graph: dict[str, set[str]]) -> list[list[str]]:
    """Strongly connected components, dependencies first (Tarjan)."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    out: list[list[str]] = []

    def visit(v: str) -> None:
        index[v] = low[v] = len(index)
        stack.append(v)
        for w in sorted(graph.get(v, ())):
            if w not in index:
                visit(w)
                low[v] = min(low[v], low[w])
            elif w in stack:
                low[v] = min(low[v], index[w])
        if low[v] == index[v]:
            k = stack.index(v)
            out.append(stack[k:])
            del stack[k:]

    for v in sorted(graph):
        if v not in index:
            visit(v)
    return out


class Datalog:
    """A program and its relations; query() gives a goal's rows.  `stats` has the fixpoints of the last query."""

    def __init__(self, spark: SparkSession, program: str = "", most_iterations: int = fx.MOST_ITERATIONS):
        self.spark, self.most_iterations = spark, most_iterations
        self.schemas: dict[str, T.StructType] = {}
        self.rules: list[Rule] = []
        self.relations: dict[str, DataFrame] = {}
        self.stats: dict[str, fx.Stats] = {}
        if program:
            self.load_program(program)

    def load_program(self, text: str) -> Datalog:
        schemas, rules = Parser(text).program()
        self.schemas |= schemas
        self.rules += rules
        return self

    def load_file(self, path: str) -> Datalog:
        """A program in a text file that Spark can read."""
        return self.load_program("\n".join(r.value for r in self.spark.read.text(path, wholetext=True).collect()))

    def load_rows(self, name: str, rows: list[str]) -> Datalog:
        """A base relation from comma-separated rows; cells are trimmed and cast to the declared types."""
        cells = self.spark.createDataFrame([(r,) for r in rows], "r string").select(F.split("r", ",").alias("c"))
        return self.load(name, cells.select(*(F.trim(F.get("c", i)).cast(f.dataType).alias(f.name) for i, f in enumerate(self.schemas[name]))))

    def load_table(self, name: str, path: str) -> Datalog:
        """A base relation from a file: commas in .csv, tabs otherwise; blank lines and those that begin with % are skipped."""
        kind = "," if path.endswith(".csv") else "\t"
        text = T.StructType([T.StructField(f.name, T.StringType()) for f in self.schemas[name]])
        df = self.spark.read.csv(path, sep=kind, comment="%", schema=text)
        return self.load(name, df.select(*(F.trim(f.name).cast(f.dataType).alias(f.name) for f in self.schemas[name])))

    def load(self, name: str, df: DataFrame) -> Datalog:
        """A base relation from a DataFrame, by position."""
        if name in self.schemas:
            s = self.schemas[name]
            df = df.toDF(*s.names).select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in s))
        self.relations[name] = df
        return self

    def reset(self) -> None:
        self.schemas, self.rules, self.relations, self.stats = {}, [], {}, {}

    # evaluation

    def query(self, goal: str) -> DataFrame:
        """Rows of a goal such as tc(1, B), with a column for each of its arguments."""
        p = Parser(goal.strip().rstrip("."))
        atom = p.atom()
        done = self._evaluate(atom.name)
        if atom.name not in done:
            raise Problem(f"no relation {atom.name}")
        df = done[atom.name]
        args = atom.args or tuple(Var(c) for c in df.columns)
        if len(args) != len(df.columns):
            raise Problem(f"{atom.name} has {len(df.columns)} arguments")
        names, first, conditions = [], {}, []
        for i, (c, a) in enumerate(zip(df.columns, args, strict=True)):
            name = a.name if isinstance(a, Var) and a.name not in first else f"{c}_{i}" if isinstance(a, Var) else c
            names.append(name)
            if isinstance(a, Const):
                conditions.append((name, F.lit(a.value)))
            elif a.name in first:
                conditions.append((name, F.col(f"`{first[a.name]}`")))
            else:
                first[a.name] = name
        df = df.toDF(*names)
        for name, value in conditions:
            df = df.where(F.col(f"`{name}`") == value)
        return df

    def _needed(self, goal: str) -> dict[str, set[str]]:
        heads = {r.head.name for r in self.rules}
        graph: dict[str, set[str]] = {}
        todo = [goal]
        while todo:
            n = todo.pop()
            if n in graph or n not in heads:
                continue
            graph[n] = {b.name for r in self.rules if r.head.name == n for b in r.body if isinstance(b, Atom) and b.name in heads}
            todo += graph[n]
        return graph

    def _evaluate(self, goal: str) -> dict[str, DataFrame]:
        done = dict(self.relations)
        self.stats = {}
        for part in components(self._needed(goal)):
            rules = {n: [r for r in self.rules if r.head.name == n] for n in part}
            if len(part) == 1 and not any(isinstance(b, Atom) and b.name == part[0] for r in rules[part[0]] for b in r.body):
                done[part[0]] = self._plain(rules[part[0]], done)
            else:
                done |= self._recursive(part, rules, done)
        return done

    def _plain(self, rules: list[Rule], done: dict[str, DataFrame]) -> DataFrame:
        found = [self._head(r, self._body(r, done)) for r in rules]
        names = found[0].columns
        if len(found) == 1 and (rules[0].sort or rules[0].limit is not None):
            return found[0]
        return reduce(DataFrame.union, [f.toDF(*names) for f in found]).distinct()

    def _recursive(self, part: list[str], rules: dict[str, list[Rule]], done: dict[str, DataFrame]) -> dict[str, DataFrame]:
        predicates = []
        for n in part:
            heads = rules[n]
            names = [f"c{i}" for i in range(len(heads[0].head.args))]
            mode, value = fx.SET, None
            for r in heads:
                for i, a in enumerate(r.head.args):
                    if isinstance(a, Agg):
                        if not r.monotonic:
                            raise Problem(f"{n}: {a.name} can't be part of its own recursion")
                        mode, value = a.name[1:], names[i]
                if any(isinstance(b, Atom) and b.negated and b.name in part for b in r.body):
                    raise Problem(f"{n}: negation inside its own recursion")
            base, steps = [], []
            for r in heads:
                places = [i for i, b in enumerate(r.body) if isinstance(b, Atom) and b.name in part]
                if not places:
                    base.append(lambda r=r, names=names: self._head(r, self._body(r, done), grouped=False).toDF(*names))
                    continue
                if len(places) > 1 and mode in (fx.SUM, fx.COUNT):
                    raise Problem(f"{n}: sums and counts need linear rules")
                steps += [self._step(r, i, places, names, done) for i in places]
            predicates.append(fx.Predicate(n, names, base, steps, mode, value))
        stats = fx.Stats()
        out = fx.run(predicates, self.most_iterations, stats)
        self.stats |= dict.fromkeys(part, stats)
        for n in part:
            if n not in out:
                raise Problem(f"{n} has no rule to begin with")
        return out

    def _step(self, r: Rule, at: int, places: list[int], names: list[str], done):
        def derive(delta, known):
            sources = {i: (delta.get(r.body[i].name) if i == at else known.get(r.body[i].name)) for i in places}
            if any(s is None for s in sources.values()):
                return None
            return self._head(r, self._body(r, done, sources, at), grouped=False).toDF(*names)

        return derive

    def _atom(self, a: Atom, df: DataFrame) -> DataFrame:
        """The relation's rows that fit the atom, one column a variable."""
        if len(a.args) != len(df.columns):
            raise Problem(f"{a.name} has {len(df.columns)} arguments")
        df = df.toDF(*(f"__{i}" for i in range(len(df.columns))))
        seen: dict[str, int] = {}
        for i, x in enumerate(a.args):
            if isinstance(x, Var):
                if x.name in seen:
                    df = df.where(F.col(f"__{i}") == F.col(f"__{seen[x.name]}"))
                elif not x.name.startswith("_"):
                    seen[x.name] = i
            elif isinstance(x, Const):
                df = df.where(F.col(f"__{i}") == F.lit(x.value))
            else:
                raise Problem("an atom's argument is a variable or a constant")
        return df.select(*(F.col(f"__{i}").alias(v) for v, i in seen.items()))

    def _body(self, r: Rule, done, sources: dict[int, DataFrame] | None = None, first: int | None = None) -> DataFrame:
        sources = sources or {}

        def rows(i: int, a: Atom) -> DataFrame:
            df = sources.get(i, done.get(a.name))
            if df is None:
                raise Problem(f"no relation {a.name}")
            return self._atom(a, df)

        atoms = {i: rows(i, b) for i, b in enumerate(r.body) if isinstance(b, Atom) and not b.negated}
        tests = [b for b in r.body if isinstance(b, Compare)]
        negated = [(i, b) for i, b in enumerate(r.body) if isinstance(b, Atom) and b.negated]
        out, bound = None, set()

        def settle(df: DataFrame | None) -> DataFrame | None:
            """Apply what is bound by now: assignments, comparisons, negations."""
            again = True
            while again:
                again = False
                for t in list(tests):
                    free = variables(t) - bound
                    for target, source in ((t.left, t.right), (t.right, t.left)):
                        if t.op == "=" and isinstance(target, Var) and free == {target.name} and target.name not in variables(source):
                            df = (self.spark.range(1).select() if df is None else df).withColumn(target.name, column(source))
                            bound.add(target.name)
                            break
                    else:
                        if free or df is None:
                            continue
                        a, b = column(t.left), column(t.right)
                        df = df.where({"=": a == b, "~=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[t.op])
                    tests.remove(t)
                    again = True
                for i, a in list(negated):
                    other = rows(i, a)
                    if df is not None and set(other.columns) <= bound:
                        if other.columns:
                            named = other.toDF(*(f"__n_{c}" for c in other.columns)).distinct()
                            df = df.join(named, reduce(lambda x, y: x & y, [F.col(f"`{c}`").eqNullSafe(F.col(f"`__n_{c}`")) for c in other.columns]), "left_anti")
                        else:
                            df = df.join(other.limit(1), F.lit(True), "left_anti")
                        negated.remove((i, a))
                        again = True
            return df

        out = settle(out)
        while atoms:
            shared = [i for i in atoms if bound & set(atoms[i].columns)]
            i = first if out is None and first in atoms else (shared or list(atoms))[0]
            df = atoms.pop(i)
            if out is None:
                out = df
            else:
                on = [c for c in df.columns if c in bound]
                out = out.join(df, on) if on else out.crossJoin(df)
            bound |= set(df.columns)
            out = settle(out)
        if tests or negated:
            raise Problem(f"{r.head.name}: a variable of {(tests or negated)[0]} isn't bound")
        return out if out is not None else self.spark.range(1).select()

    def _head(self, r: Rule, body: DataFrame, grouped: bool = True) -> DataFrame:
        """The head's columns; with `grouped`, aggregated and, without aggregates, as a set."""
        names, columns = [], []
        for i, a in enumerate(r.head.args):
            name = a.name if isinstance(a, Var) else a.of.name if isinstance(a, Agg) and isinstance(a.of, Var) else f"c{i}"
            names.append(f"{name}_{i}" if name in names else name)
            if variables(a) - set(body.columns):
                raise Problem(f"{r.head.name}: {name} isn't bound")
            columns.append(a)
        if r.aggregates and grouped:
            plain = [(n, a) for n, a in zip(names, columns, strict=True) if not isinstance(a, Agg)]
            make = {"min": F.min, "max": F.max, "sum": F.sum, "avg": F.avg, "count": F.count, "countd": F.count_distinct, "mmin": F.min, "mmax": F.max, "msum": F.sum, "mcount": F.count}
            aggs = [make[a.name](column(a.of) if a.of else F.lit(1)).alias(n) for n, a in zip(names, columns, strict=True) if isinstance(a, Agg)]
            out = body.groupBy(*(column(a).alias(n) for n, a in plain)).agg(*aggs).select(*(f"`{n}`" for n in names))
        else:
            value = lambda a: (F.when(column(a.of).isNotNull(), 1).otherwise(0) if a.of else F.lit(1)).cast("bigint") if a.name == "mcount" else column(a.of)
            out = body.select(*((value(a) if isinstance(a, Agg) else column(a)).alias(n) for n, a in zip(names, columns, strict=True)))
            if grouped:
                out = out.distinct()
        if r.sort:
            out = out.orderBy(*((F.col(f"`{n}`").asc() if up else F.col(f"`{n}`").desc()) for n, up in r.sort))
        return out.limit(r.limit) if r.limit is not None else out

"""WITH RECURSIVE whose heads may carry monotonic aggregates.

    WITH RECURSIVE path (Dst, mmin AS Cost) AS
      (SELECT 1, 0) UNION
      (SELECT edge.Dst, path.Cost + edge.Cost FROM path, edge WHERE path.Dst = edge.Src)
    SELECT Dst, Cost FROM path

A head column is a name, or an aggregate of a name: `mmin AS c` or `min() AS c`, and
likewise max, sum and count.  Without one, the recursion is a set over all columns.
Branches that don't name the head are its base.  A branch may name the head more than
once.  Several common tables, recursive or plain, may follow one another.  Bodies and
the final query are Spark SQL.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans import fixpoint as fx

_HEAD = re.compile(r"(?:(m?(?:min|max|sum|count))\s*(?:\(\s*\))?\s+AS\s+)?(\w+)$", re.IGNORECASE)
_FROM = re.compile(r"\bFROM\b(.*?)(?=\bWHERE\b|\bGROUP\b|\bHAVING\b|\bORDER\b|\bLIMIT\b|\bUNION\b|\Z)", re.IGNORECASE | re.DOTALL)


class SyntaxProblem(ValueError):
    """Text that is no recursive query."""


@dataclass
class Table:
    name: str
    columns: list[str]
    mode: str
    value: str | None
    branches: list[str]


def _closing(text: str, at: int) -> int:
    """The place of the parenthesis that closes the one at `at`; those in quotes don't count."""
    depth, quote = 0, ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return i
    raise SyntaxProblem("a parenthesis isn't closed")


def _split(text: str, word: str) -> list[str]:
    """Split at a keyword or comma outside parentheses and quotes."""
    out, depth, quote, last, i = [], 0, "", 0, 0
    pattern = re.compile(word, re.IGNORECASE)
    while i < len(text):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif not depth and (m := pattern.match(text, i)):
            out.append(text[last:i])
            last = i = m.end()
            continue
        i += 1
    return [*out, text[last:]]


def _bare(text: str) -> str:
    text = text.strip()
    while text.startswith("(") and _closing(text, 0) == len(text) - 1:
        text = text[1:-1].strip()
    return text


def parse(text: str) -> tuple[list[Table], str]:
    """The common tables and the final query."""
    text = re.sub(r"--[^\n]*", "", text).strip().rstrip(";")
    m = re.match(r"WITH\s+RECURSIVE\s+", text, re.IGNORECASE)
    if not m:
        raise SyntaxProblem("a recursive query begins WITH RECURSIVE")
    tables, at = [], m.end()
    while True:
        m = re.compile(r"\s*(\w+)\s*(?=\()").match(text, at)
        if not m:
            raise SyntaxProblem("a common table needs a name and a head")
        end = _closing(text, m.end())
        columns, mode, value = [], fx.SET, None
        for head in text[m.end() + 1 : end].split(","):
            h = _HEAD.match(head.strip())
            if not h:
                raise SyntaxProblem(f"not a head column: {head.strip()}")
            columns.append(h[2])
            if h[1]:
                if value:
                    raise SyntaxProblem("a head has one aggregate at most")
                mode, value = h[1].lower().removeprefix("m") if h[1].lower() not in ("min", "max") else h[1].lower(), h[2]
        name, at = m[1], end + 1
        m = re.compile(r"\s*AS\s*(?=\()", re.IGNORECASE).match(text, at)
        if not m:
            raise SyntaxProblem(f"AS and a parenthesis should follow the head of {name}")
        branches = []
        at = m.end()
        while True:
            end = _closing(text, at)
            branches += [_bare(b) for b in _split(_bare(text[at : end + 1]), r"\bUNION\b(?:\s+ALL\b|\s+DISTINCT\b)?")]
            at = end + 1
            m = re.compile(r"\s*UNION(?:\s+ALL|\s+DISTINCT)?\s*(?=\()", re.IGNORECASE).match(text, at)
            if not m:
                break
            at = m.end()
        tables.append(Table(name, columns, mode, value, branches))
        m = re.compile(r"\s*,").match(text, at)
        if not m:
            return tables, text[at:].strip()
        at = m.end()


def references(body: str, name: str) -> list[tuple[int, int]]:
    """Where a body's FROM clauses name a table."""
    out = []
    for clause in _FROM.finditer(body):
        for m in re.finditer(rf"(?:\A|\bJOIN\b|,|\()\s*({re.escape(name)})\b(?!\s*\.)", clause[1], re.IGNORECASE):
            out.append((clause.start(1) + m.start(1), clause.start(1) + m.end(1)))
    return out


def _bind(body: str, name: str, views: list[str]) -> str:
    """The body with each reference to `name` reading the view of its place, under its old name or alias."""
    out, last = [], 0
    for (a, b), view in zip(references(body, name), views, strict=True):
        alias = re.match(r"\s+(?:AS\s+)?(?!(?:JOIN|ON|USING|INNER|LEFT|RIGHT|FULL|CROSS|WHERE|UNION)\b)\w+", body[b:], re.IGNORECASE)
        out += [body[last:a], view, "" if alias else f" AS {body[a:b]}"]
        last = b
    return "".join([*out, body[last:]])


class RecursiveSQL:
    """Runs recursive queries over a session's tables and views; `stats` has the last query's fixpoints by table."""

    def __init__(self, spark: SparkSession, most_iterations: int = fx.MOST_ITERATIONS):
        self.spark, self.most_iterations, self.stats = spark, most_iterations, {}

    def sql(self, text: str) -> DataFrame:
        """The final query's rows; text that isn't recursive goes to Spark as it is."""
        if not re.match(r"\s*WITH\s+RECURSIVE\b", text, re.IGNORECASE):
            return self.spark.sql(text)
        tables, final = parse(text)
        self.stats = {}
        made = []
        try:
            for t in tables:
                self._table(t).createOrReplaceTempView(t.name)
                made.append(t.name)
            return self.spark.sql(final)
        finally:
            for name in made:
                self.spark.catalog.dropTempView(name)

    def _table(self, t: Table) -> DataFrame:
        spark = self.spark
        base = [b for b in t.branches if not references(b, t.name)]
        recursive = [b for b in t.branches if references(b, t.name)]
        if not base:
            raise SyntaxProblem(f"{t.name} has no branch without itself")

        def widened(df: DataFrame) -> DataFrame:
            """An aggregated whole number is kept as a bigint, and a count counts rows that have a value."""
            df = df.toDF(*t.columns)
            if t.mode == fx.COUNT:
                return df.withColumn(t.value, F.when(F.col(t.value).isNotNull(), 1).otherwise(0).cast("bigint"))
            if t.value and df.schema[t.value].dataType.typeName() in ("byte", "short", "integer"):
                return df.withColumn(t.value, F.col(t.value).cast("bigint"))
            return df

        def rule(body: str):
            n = len(references(body, t.name))
            changed, known_as = f"__changed_{t.name}", f"__known_{t.name}"

            def derive(delta, known):
                if t.name not in delta:
                    return None
                delta[t.name].createOrReplaceTempView(changed)
                out = None
                try:
                    if n > 1:
                        if t.mode in (fx.SUM, fx.COUNT):
                            raise SyntaxProblem("sum and count need a linear recursion")
                        known[t.name].createOrReplaceTempView(known_as)
                    for i in range(n):
                        found = widened(spark.sql(_bind(body, t.name, [changed if j == i else known_as for j in range(n)])))
                        out = found if out is None else out.union(found)
                finally:
                    spark.catalog.dropTempView(changed)
                    spark.catalog.dropTempView(known_as)
                return out

            return derive

        self.stats[t.name] = fx.Stats()
        p = fx.Predicate(t.name, t.columns, [lambda b=b: widened(spark.sql(b)) for b in base], [rule(b) for b in recursive], t.mode, t.value)
        return fx.run([p], self.most_iterations, self.stats[t.name])[t.name]

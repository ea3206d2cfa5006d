"""Semi-naive fixpoints over DataFrames.

A predicate is a relation with key columns and at most one aggregated column (min, max,
sum or count).  Rules derive candidate rows from the last iteration's changes; what is
new or better is the next change, until nothing changes.

Candidates meet what is known in one aggregation on the keys, not in a join: it treats
nulls as equal.  Every change is written to the shared folder in buckets of its keys, as
many as there are shuffle partitions, so that what is known is read as it lies: only the
candidates are shuffled, combined on the map side before.  Lineage stays short and a lost
executor costs a read.  What is known is the union of the changes, compacted now and
then; files that a compaction replaces are deleted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import remove, shared_path

COMPACT = 8
MOST_ITERATIONS = 10_000
SET, MIN, MAX, SUM, COUNT = "set", "min", "max", "sum", "count"


class Diverged(RuntimeError):
    """A fixpoint that has not settled in its number of iterations."""


@dataclass
class Predicate:
    """`base` makes the first rows; each of `rules` derives rows from environments of changed and known relations."""

    name: str
    columns: list[str]
    base: list[Callable[[], DataFrame]]
    rules: list[Callable[[dict[str, DataFrame], dict[str, DataFrame]], DataFrame | None]]
    mode: str = SET
    value: str | None = None
    changes: list[DataFrame] = field(default_factory=list)
    replaced: list[DataFrame] = field(default_factory=list)

    @property
    def keys(self) -> list[str]:
        return [c for c in self.columns if c != self.value]

    def combined(self, df: DataFrame) -> DataFrame:
        """One row a key."""
        if self.mode == SET:
            return df.distinct()
        if self.mode == COUNT:
            f = F.sum(self.value)
        else:
            f = {MIN: F.min, MAX: F.max, SUM: F.sum}[self.mode](self.value)
        out = df.groupBy(*self.keys).agg(f.alias(self.value)) if self.keys else df.agg(f.alias(self.value))
        return out.where(F.col(self.value).isNotNull()).select(*self.columns)

    def known(self) -> DataFrame:
        every = reduce(DataFrame.unionByName, self.changes)
        return every if self.mode == SET or len(self.changes) == 1 else self.combined(every)

    def fresh(self, candidates: DataFrame) -> DataFrame:
        """The candidates that are not known, or better than what is."""
        if not self.changes:
            return self.combined(candidates)
        candidates = self.combined(candidates)
        if self.mode in (SUM, COUNT):
            return candidates
        every = reduce(DataFrame.unionByName, self.changes)
        if self.mode == SET:
            both = every.withColumn("__old", F.lit(1)).unionByName(candidates.withColumn("__old", F.lit(0)))
            return both.groupBy(*self.columns).agg(F.max("__old").alias("__old")).where("__old = 0").select(*self.columns)
        f = F.min if self.mode == MIN else F.max
        v = F.col(self.value)
        none = F.lit(None).cast(every.schema[self.value].dataType)
        both = every.select(*self.keys, v.alias("__old"), none.alias("__new")).unionByName(candidates.select(*self.keys, none.alias("__old"), v.alias("__new")))
        best = both.groupBy(*self.keys).agg(f("__old").alias("__old"), f("__new").alias("__new"))
        better = F.col("__new") < F.col("__old") if self.mode == MIN else F.col("__new") > F.col("__old")
        return best.where(F.col("__new").isNotNull() & (F.col("__old").isNull() | better)).select(*self.keys, F.col("__new").alias(self.value)).select(*self.columns)

    def compact(self) -> None:
        """The changes as one; the last stays readable, as the next step starts from it."""
        old, self.changes = self.changes, [written(self.known(), self.keys)[0]]
        for df in self.replaced + old[:-1]:
            remove(df.sparkSession, df._quern_path)
        self.replaced = old[-1:]


@dataclass
class Stats:
    """Rows that changed, by iteration and predicate."""

    changed: list[dict[str, int]] = field(default_factory=list)

    @property
    def iterations(self) -> int:
        return len(self.changed)


def written(df: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """The rows, cut from their lineage and in buckets of their keys, and how many they are; the count reads the files' footers alone."""
    spark = df.sparkSession
    path = shared_path(spark, "fixpoint")
    if keys:
        place = {c: f"c{i}" for i, c in enumerate(df.columns)}
        name = f"fixpoint_{uuid.uuid4().hex}"
        writer = df.toDF(*place.values()).write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *(place[k] for k in keys))
        writer.format("parquet").option("path", path).saveAsTable(name)
        out = spark.table(name).toDF(*df.columns)
        spark.sql(f"DROP TABLE {name}")  # the plan holds the buckets, and the files stay
    else:
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    n = out.count()
    out._quern_path = path
    return out, n


def run(predicates: list[Predicate], most_iterations: int = MOST_ITERATIONS, stats: Stats | None = None) -> dict[str, DataFrame]:
    """The fixpoint of mutually recursive predicates; all are evaluated once an iteration on the last one's changes.

    Sum and count accumulate over all derivations, so on cycles they have no fixpoint:
    Diverged is raised after `most_iterations`.
    """
    stats = stats if stats is not None else Stats()

    def change(p: Predicate, found: list[DataFrame]) -> tuple[DataFrame, int] | None:
        if not found:
            return None
        rows = reduce(DataFrame.union, [f.toDF(*p.columns) for f in found])
        if p.changes:
            kinds = p.changes[0].schema
            rows = rows.select(*(F.col(c).cast(kinds[c].dataType).alias(c) for c in p.columns))
        elif p.value and rows.schema[p.value].dataType.typeName() in ("byte", "short", "integer"):
            rows = rows.withColumn(p.value, F.col(p.value).cast("bigint"))  # sums of steps outgrow an int
        return written(p.fresh(rows), p.keys)

    delta = {p.name: c for p in predicates if (c := change(p, [f() for f in p.base]))}
    for p in predicates:
        if p.name in delta:
            p.changes.append(delta[p.name][0])
    for _ in range(most_iterations):
        stats.changed.append({n: k for n, (_, k) in delta.items()})
        changed = {n: d for n, (d, k) in delta.items() if k}
        if not changed:
            break
        known = {p.name: p.known() if p.changes else None for p in predicates}
        delta = {p.name: c for p in predicates if (c := change(p, [r for f in p.rules if (r := f(changed, known)) is not None]))}
        for p in predicates:
            if p.name in delta:
                p.changes.append(delta[p.name][0])
                if len(p.changes) > COMPACT:
                    p.compact()
    else:
        raise Diverged(f"{', '.join(p.name for p in predicates)}: no fixpoint after {most_iterations} iterations")
    return {p.name: p.known() for p in predicates if p.changes}


def closure(base: DataFrame, step: Callable[[DataFrame], DataFrame], mode: str = SET, value: str | None = None, most_iterations: int = MOST_ITERATIONS, stats: Stats | None = None) -> DataFrame:
    """The fixpoint of one linear rule: `step` makes candidates (in base's columns) of the last changes."""
    p = Predicate("p", base.columns, [lambda: base], [lambda delta, _: step(delta["p"]) if "p" in delta else None], mode, value)
    return run([p], most_iterations, stats)["p"]

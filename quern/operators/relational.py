"""Relational operators whose older semantics differ from Spark's own."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def except_keeping_duplicates(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of left that right lacks, repeats and all; nulls are equal."""
    other = right.toDF(*(f"__r{i}" for i in range(len(right.columns)))).distinct()
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"__r{i}")) for i, c in enumerate(left.columns)])
    return left.join(other, same, "left_anti")


def at_least_non_null(df: DataFrame, n: int, columns: list[str] | None = None) -> DataFrame:
    """The rows with at least n values that are neither null nor NaN."""
    return df.dropna(thresh=n, subset=columns)


def filter_by_range(df: DataFrame, key: str, low, high) -> DataFrame:
    return df.where(F.col(key).between(low, high))


def subtract_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def histogram(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """(bucket, count) over the intervals between edges, the last one closed; empty ones are there too."""
    n = len(edges) - 1
    x = F.col(column)
    inside = df.where(x.between(edges[0], edges[-1]))
    place = F.least(F.lit(n - 1), reduce(lambda a, b: a + b, [(x >= e).cast("int") for e in edges[1:]]))
    counts = inside.groupBy(place.alias("bucket")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("count"))


def join_with(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Pairs (_1, _2) of whole rows, as structs; a side without a match is null."""
    a, b = left.select(F.struct(*left.columns).alias("_1")), right.select(F.struct(*right.columns).alias("_2"))
    return a.join(b, on(F.col("_1"), F.col("_2")), how)


def aggregate_with(df: DataFrame, keys: list[str], column: str, zero, reduce_, merge, finish, name: str, buffer: str, result: str) -> DataFrame:
    """A typed aggregate: per batch from zero() by reduce_(buffer, value), buffers by merge(a, b), then finish(buffer).

    The buffers, a row a key and batch, are all that is shuffled.
    """
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def partial(batches):
        for pdf in batches:
            rows = []
            for key, values in pdf.groupby(keys, dropna=False)[column]:
                rows.append((*key, reduce(reduce_, values, zero())))
            yield pd.DataFrame(rows, columns=[*keys, name])

    def final(key, pdf):
        return pd.DataFrame([(*key, finish(reduce(merge, pdf[name], zero())))], columns=[*keys, name])

    return df.select(*keys, column).mapInPandas(partial, f"{kinds}, `{name}` {buffer}").groupBy(*keys).applyInPandas(final, f"{kinds}, `{name}` {result}")


def reduce_rows(df: DataFrame, column: str, f) -> DataFrame:
    """One row: the values (not null) of a column folded by an associative and commutative f, per batch and then over the batches' results."""
    kind = f"`{column}` {df.schema[column].dataType.simpleString()}"

    def fold(batches):
        got = [reduce(f, pdf[column]) for pdf in batches if len(pdf)]
        if got:
            yield pd.DataFrame({column: [reduce(f, got)]})

    return df.select(column).where(F.col(column).isNotNull()).mapInPandas(fold, kind).coalesce(1).mapInPandas(fold, kind)

"""Scalar and grouped aggregates. All are partial before the shuffle and final after it; null keys form a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyjoin.names import col, free, own


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def sum_col(df: DataFrame, column: str, name: str = "total") -> DataFrame:
    """Integers are summed as 64-bit."""
    return df.agg(F.sum(F.col(column).cast("bigint")).alias(name))


def max_col(df: DataFrame, column: str, name: str = "largest") -> DataFrame:
    """The true maximum, also where all values are negative; null of no rows."""
    return df.agg(F.max(column).alias(name))


def group(df: DataFrame, keys: Sequence[str], how: str, column: str, name: str) -> DataFrame:
    """how: sum, count, product, max or min of column by keys. Products are doubles."""
    made: dict[str, Column] = {
        "sum": F.sum(F.col(column).cast("bigint")) if dict(df.dtypes)[column] in ("tinyint", "smallint", "int", "bigint") else F.sum(column),
        "count": F.count("*"),
        "product": F.product(F.col(column).cast("double")),
        "max": F.max(column),
        "min": F.min(column),
    }
    return df.groupBy(*keys).agg(made[how].alias(name))


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def is_key_unique(df: DataFrame, keys: Sequence[str], name: str = "is_unique") -> DataFrame:
    """One row: whether no key has two rows."""
    return df.groupBy(*keys).count().agg((F.coalesce(F.max("count"), F.lit(0)) <= 1).alias(name))


def max_degree(df: DataFrame, keys: Sequence[str], name: str = "max_degree") -> DataFrame:
    return df.groupBy(*keys).count().agg(F.max("count").alias(name))


def dedup_last_of_run(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key the last row in a total order.

    As a maximum over a struct this is a partial aggregate, so one row a key and task is shuffled, and a hot key has no
    group of its own. Order columns must be comparable; they and the keys need not be all columns.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    last = free("_last", df)
    made = df.groupBy(*map(col, keys)).agg(F.max(F.struct(*(col(c).alias(f"c{i}") for i, c in enumerate([*order, *rest])))).alias(last))
    at = {c: F.col(last)[f"c{i}"] for i, c in enumerate([*order, *rest])}
    return made.select(*(at[c].alias(c) if c in at else col(c) for c in df.columns))


def group_count_broadcast(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Every row with its key's number of rows, by one join with the partial counts; null keys count as a key.

    A window over the keys would hold a hot key in one task; here AQE can split it.
    """
    theirs = [free(f"_key{i}", df, [name]) for i in range(len(keys))]
    counts = df.groupBy(*(col(k).alias(c) for k, c in zip(keys, theirs, strict=True))).agg(F.count("*").alias(name))
    same = [col(k).eqNullSafe(F.col(c)) for k, c in zip(keys, theirs, strict=True)]
    return df.join(counts, same).select(*own(df), name)


def group_count_window(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """The same in one pass, for keys of bounded size."""
    return df.withColumn(name, F.count("*").over(W.partitionBy(*keys)))

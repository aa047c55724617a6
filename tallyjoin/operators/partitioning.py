"""Sorting and placing rows: random, by key, by number, by range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyjoin.names import col, free, own
from tallyjoin.operators.scan import numbered


def sort_multi(df: DataFrame, *order: str) -> DataFrame:
    """Total order over all partitions: sampled ranges, then a sort in each."""
    return df.orderBy(*map(col, order))


def sort_within(df: DataFrame, *order: str) -> DataFrame:
    return df.sortWithinPartitions(*map(col, order))


def shuffle_random(df: DataFrame, parts: int) -> DataFrame:
    """Even, random placement by a hash of the whole row, so that a task run again deals the same rows."""
    return df.repartition(parts, F.xxhash64(*own(df)))


def shuffle_by_key(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    return df.repartition(parts, *map(col, keys))


def shuffle_by_col(df: DataFrame, parts: int, column: str) -> DataFrame:
    """Row to the partition of the number in column, which must lie in 0 .. parts - 1."""
    return df.repartitionById(parts, col(column).cast("int"))


def range_partition(df: DataFrame, parts: int, *order: str) -> DataFrame:
    return df.repartitionByRange(parts, *map(col, order))


def placement(df: DataFrame, *columns: str) -> DataFrame:
    """Per partition that has rows: part, n, and low and high, the least and greatest of those columns."""
    at = F.struct(*map(col, columns))
    return df.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.min(at).alias("low"), F.max(at).alias("high"))


def key_hash_partition(df: DataFrame, parts: int, keys: Sequence[str], name: str = "part") -> DataFrame:
    """The partition number that a key's hash gives."""
    return df.withColumn(name, F.pmod(F.xxhash64(*map(col, keys)), F.lit(parts)))


def assign_round_robin(df: DataFrame, order: Sequence[str], parts: int, name: str = "part") -> DataFrame:
    """Row number in a total order, modulo parts."""
    n = free("_n", df, [name])
    return numbered(df, order, n).withColumn(name, ((F.col(n) - 1) % parts).cast("bigint")).drop(n)


def quantile_buckets(df: DataFrame, order: Sequence[str], parts: int, name: str = "bucket") -> DataFrame:
    """Equal buckets 1 .. parts in a total order, the first (n mod parts) of them one row larger, as NTILE has it."""
    n, every = free("_n", df, [name]), free("_every", df, [name])
    rows = numbered(df, order, n)
    rows = rows.join(F.broadcast(rows.agg(F.count("*").alias(every))))  # one row
    small, more = F.floor(F.col(every) / parts), F.col(every) % parts
    head, at = more * (small + 1), F.col(n) - 1
    bucket = F.when(at < head, F.floor(at / (small + 1))).otherwise(more + F.floor((at - head) / F.greatest(small, F.lit(1))))
    return rows.withColumn(name, (bucket + 1).cast("bigint")).drop(n, every)


def quantile_pivots(df: DataFrame, order: Sequence[str], parts: int) -> DataFrame:
    """First row (its order columns) of each bucket but the first: parts - 1 pivots."""
    bucket = free("bucket", df)
    rows = quantile_buckets(df, order, parts, bucket).filter(F.col(bucket) > 1)
    first = rows.groupBy(bucket).agg(F.min(F.struct(*map(col, order))).alias("first"))
    return first.select(F.col(bucket).alias("bucket"), *(F.col("first")[c].alias(c) for c in order))


def by_pivots(df: DataFrame, column: str, pivots: Sequence, name: str = "part") -> DataFrame:
    """Partition number by sorted pivots: as many as are not above the value, so ties go right."""
    return df.withColumn(name, sum(((col(column) >= p).cast("bigint") for p in pivots), F.lit(0).cast("bigint")))


def rank_in_order(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """row_number() over the whole table without its single task: sort_multi() and each row's place in it."""
    return numbered(df, order, name)


def within_part(df: DataFrame, part: str, order: Sequence[str], name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(col(part)).orderBy(*map(col, order))))

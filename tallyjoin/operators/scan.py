"""Prefix and suffix aggregates: by key in windows, over a whole table or keys of any size in two phases.

Two phases: rows are dealt out by ranges of the order and written to the shared folder, as both phases must see the same
ranges; each range is scanned by itself, and adds what the ranges before it hold, one row a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyjoin.names import col, free, own
from tallyjoin.storage import materialize

HOW = {"sum": F.sum, "min": F.min, "max": F.max, "product": F.product, "count": F.count}
WHOLE = ("tinyint", "smallint", "int", "bigint")
#: monotonically_increasing_id() has the partition above so many bits.
ID_BITS = 33


def _value(df: DataFrame, how: str, column: str) -> Column:
    """Sums of integers are 64-bit, products doubles."""
    if how == "product":
        return col(column).cast("double")
    return col(column).cast("bigint") if how == "sum" and dict(df.dtypes)[column] in WHOLE else col(column)


def by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], how: str, column: str, name: str, reverse: bool = False) -> DataFrame:
    """how over the rows of the key up to this one (from this one on, if reverse) in a total order."""
    window = W.partitionBy(*map(col, keys)).orderBy(*map(col, order))
    frame = window.rowsBetween(0, W.unboundedFollowing) if reverse else window.rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, HOW[how](_value(df, how, column)).over(frame))


def _in_ranges(df: DataFrame, keys: Sequence[str], along: Sequence[Column], local: Column, total: Column, gather, both, name: str) -> DataFrame:
    """df with name: local over a range's share of the key, joined by both() with what gather() makes of earlier ranges' totals.

    Only the first key of a range can go on from another, so there are at most as many carries as ranges.
    """
    part, mine, sum_, carry, cpart = (free(c, df, [name]) for c in ("_part", "_local", "_total", "_carry", "_cpart"))
    ckeys = [free(f"_key{i}", df, [name]) for i in range(len(keys))]
    dealt = materialize(df.repartitionByRange(*map(col, keys), *along).withColumn(part, F.spark_partition_id()), "ranges")
    upto = W.partitionBy(part, *map(col, keys)).orderBy(*along).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*ckeys).orderBy(cpart).rowsBetween(W.unboundedPreceding, -1)  # a row for each range with the key
    totals = dealt.groupBy(F.col(part).alias(cpart), *(col(k).alias(c) for k, c in zip(keys, ckeys, strict=True))).agg(total.alias(sum_))
    carries = totals.withColumn(carry, gather(sum_).over(before)).filter(F.col(carry).isNotNull()).drop(sum_)
    same = [F.col(part) == F.col(cpart), *(col(k).eqNullSafe(F.col(c)) for k, c in zip(keys, ckeys, strict=True))]
    met = dealt.withColumn(mine, local.over(upto)).join(F.broadcast(carries), same, "left")
    out = F.when(F.col(mine).isNull(), F.col(carry)).when(F.col(carry).isNull(), F.col(mine)).otherwise(both(F.col(mine), F.col(carry)))
    return met.select(*(c for c, n in zip(own(df), df.columns, strict=True) if n != name), out.alias(name))


def by_key_split(df: DataFrame, keys: Sequence[str], order: Sequence[str], how: str, column: str, name: str, reverse: bool = False) -> DataFrame:
    """by_key() for keys of any size: a key's rows may fill many tasks. The order must be unique within a key."""
    along = [col(o).desc() if reverse else col(o).asc() for o in order]
    value = HOW[how](_value(df, how, column))
    both = {"product": lambda a, b: a * b, "min": F.least, "max": F.greatest}.get(how, lambda a, b: a + b)
    return _in_ranges(df, keys, along, value, value, HOW["sum" if how == "count" else how], both, name)


def row_number_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "row_number") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*map(col, keys)).orderBy(*map(col, order))))


def row_number_by_key_split(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "row_number") -> DataFrame:
    """The same, as 64-bit, for keys of any size. The order must be unique within a key."""
    along = [col(o).asc() for o in order]
    return _in_ranges(df, keys, along, F.count(F.lit(1)), F.count(F.lit(1)), F.sum, lambda a, b: a + b, name)


def fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str, backward: bool = False) -> DataFrame:
    """column, or the nearest value before it (after it, if backward) in the key's order where it is null."""
    window = W.partitionBy(*map(col, keys)).orderBy(*map(col, order))
    if backward:
        made = F.first(col(column), ignorenulls=True).over(window.rowsBetween(0, W.unboundedFollowing))
    else:
        made = F.last(col(column), ignorenulls=True).over(window.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn(name, made)


def fill_split(df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str, backward: bool = False) -> DataFrame:
    """fill() for keys of any size. The order must be unique within a key, and its columns comparable."""
    along = [col(o).desc() if backward else col(o).asc() for o in order]
    at = F.struct(*map(col, order))
    held = F.when(col(column).isNotNull(), at)
    newest = (F.min_by if backward else F.max_by)(col(column), held)
    last = lambda c: F.last(c, ignorenulls=True)
    return _in_ranges(df, keys, along, last(col(column)), newest, last, lambda a, b: a, name)


def prefix_sum_global(df: DataFrame, order: Sequence[str], column: str, name: str) -> DataFrame:
    """Running sum of column over the whole table in a total (unique) order, without gathering it in one task."""
    total = F.sum(col(column).cast("bigint"))
    return _in_ranges(df, [], [col(o).asc() for o in order], total, total, F.sum, lambda a, b: a + b, name)


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Rows numbered from 1 in a total order: the table is sorted and written once, and numbers follow from the places in it."""
    at, part, before = (free(c, df, [name]) for c in ("_at", "_numbered_part", "_before"))
    there = materialize(df.orderBy(*map(col, order)).withColumn(at, F.monotonically_increasing_id()), "sorted")
    of_part = F.shiftright(at, ID_BITS)
    counts = there.groupBy(of_part.alias(part)).agg(F.count("*").alias(before))
    earlier = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    offsets = counts.select(part, F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    number = F.col(before) + F.col(at).bitwiseAND((1 << ID_BITS) - 1) + 1
    return there.join(F.broadcast(offsets), of_part == F.col(part)).select(*own(df), number.alias(name))

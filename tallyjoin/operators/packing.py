"""Packing keys into bins by a running sum: the greedy assignment that bounds a block of a join by degrees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyjoin.names import col

#: Most rows: they are folded in one row's array, whose list of bins is copied in each step.
MOST_ROWS = 50_000


def greedy_bins(df: DataFrame, order: Sequence[str], weight: str, room: int, name: str = "bin") -> DataFrame:
    """Rows in a total order go into the bin at hand until their weights exceed room; then the next bin begins.

    Each bin depends on the one before, so this is a sequential fold, made in one row's array: it is for tables of few
    keys, such as the degrees of a key column's heavy hitters, and raises beyond MOST_ROWS. A row heavier than room has a
    bin of its own; null counts 0.
    """
    columns = df.columns
    item = F.struct(*(col(c).alias(f"c{columns.index(c)}") for c in [*order, *(c for c in columns if c not in order)]))
    w = f"c{columns.index(weight)}"
    every = df.agg(F.count("*").alias("n"), F.sort_array(F.collect_list(item)).alias("rows"))
    every = every.select(F.when(F.col("n") <= MOST_ROWS, F.col("rows")).otherwise(F.raise_error(F.concat(F.col("n").cast("string"), F.lit(f" rows are more than {MOST_ROWS}")))).alias("rows"))
    start = F.struct(F.lit(0).cast("bigint").alias("bin"), F.lit(0).cast("bigint").alias("held"), F.array().cast("array<bigint>").alias("bins"))

    def put(state, row):
        mine = F.coalesce(row[w].cast("bigint"), F.lit(0).cast("bigint"))
        full = (state["held"] > 0) & (state["held"] + mine > room)
        bin_ = state["bin"] + full.cast("bigint")
        return F.struct(bin_.alias("bin"), (F.when(full, F.lit(0)).otherwise(state["held"]) + mine).cast("bigint").alias("held"), F.concat(state["bins"], F.array(bin_)).alias("bins"))

    packed = every.select("rows", F.aggregate("rows", start, put).alias("state"))
    rows = packed.select(F.inline(F.arrays_zip(F.col("rows").alias("row"), F.col("state.bins").alias("bin"))))
    return rows.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(columns)), F.col("bin").alias(name))

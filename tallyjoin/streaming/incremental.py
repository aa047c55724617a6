"""The joins and aggregates on streams: the same plans, kept up as rows arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyjoin.operators.joins import inner_join


def pk_join_stream(r: DataFrame, s: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A stream R against a table S of unique keys; stateless."""
    return inner_join(r, s, keys)


def group_sum_stream(r: DataFrame, keys: Sequence[str], column: str, name: str, time: str | None = None, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Sums by keys; with a time column, by tumbling windows whose state goes once they are late."""
    total = F.sum(F.col(column)).alias(name)
    if time is None:
        return r.groupBy(*keys).agg(total)
    return r.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(total)

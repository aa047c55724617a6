"""Dummy rows that hide how many rows a partition has. Nothing more is hidden; see the README."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyjoin.names import col
from tallyjoin.operators.expand import with_numbers

DUMMY = "_is_dummy"


def pad_to_size(df: DataFrame, part: str, size: int) -> DataFrame:
    """df with _is_dummy, and dummies (null but for part) up to size rows in each part that occurs.

    A part with more rows than size keeps them all. Only counts are shuffled. df must have no column _is_dummy.
    """
    if DUMMY in df.columns:
        raise ValueError(f"{DUMMY} is there already")
    lack = df.groupBy(col(part).alias("part")).agg((F.lit(size) - F.count("*")).alias("lack"))
    dummies = with_numbers(lack, F.lit(0), F.col("lack"), "i")
    dummies = dummies.select(*((F.col("part") if c == part else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in df.columns), F.lit(True).alias(DUMMY))
    return df.withColumn(DUMMY, F.lit(False)).unionAll(dummies)


def remove_dummy(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(DUMMY)).drop(DUMMY)


def real_rows(df: DataFrame, name: str = "n") -> DataFrame:
    """One row: how many rows are no dummies."""
    return df.agg(F.count_if(~F.col(DUMMY)).alias(name))

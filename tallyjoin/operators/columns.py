"""Projection and column operators. Names are the API; positions serve only where a column is put."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns in the given order; one that is named again gets _2, _3, ... after its name."""
    seen: dict[str, int] = {}
    out = []
    for c in columns:
        seen[c] = seen.get(c, 0) + 1
        out.append(F.col(c).alias(c if seen[c] == 1 else f"{c}_{seen[c]}"))
    return df.select(*out)


def join_cols_first(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key columns in the given order, then the others in theirs."""
    return df if df.columns[: len(keys)] == list(keys) else df.select(*keys, *(c for c in df.columns if c not in keys))


def insert_col(df: DataFrame, name: str, value: object, at: int = -1) -> DataFrame:
    """A column of a constant or expression, put before position at, or last if at is -1."""
    made = (value if isinstance(value, Column) else F.lit(value)).alias(name)
    i = len(df.columns) if at == -1 else at
    return df.select(*df.columns[:i], made, *df.columns[i:])


def append_col(df: DataFrame, name: str, value: object) -> DataFrame:
    return insert_col(df, name, value)


def copy_col(df: DataFrame, source: str, name: str, at: int = -1) -> DataFrame:
    return insert_col(df, name, F.col(source), at)


def delete_col(df: DataFrame, name: str | None = None) -> DataFrame:
    """Without the column of that name; without the last one if no name is given."""
    return df.drop(name or df.columns[-1])


def copy_table(df: DataFrame, alias: str) -> DataFrame:
    """The same rows under an alias of their own, as a self-join needs them; frames never change, so nothing is copied."""
    return df.alias(alias)


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bag union by position; both must have as many columns."""
    if len(a.columns) != len(b.columns):
        raise ValueError(f"{len(a.columns)} columns against {len(b.columns)}")
    return a.unionAll(b)


def union_aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bag union by name; a column that one side lacks is null there."""
    return a.unionByName(b, allowMissingColumns=True)


def compact(df: DataFrame, mark: str) -> DataFrame:
    """Rows whose mark is 1."""
    return df.filter(F.col(mark) == 1)


def print_limit(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a total order, as a top-n heap in each task; exactly n."""
    return df.orderBy(*order).limit(n)


def sample_modulus(df: DataFrame, key: str, of: int, at: int = 0) -> DataFrame:
    """A repeatable sample: rows whose integer key leaves the rest ``at``."""
    return df.filter(F.pmod(F.col(key), F.lit(of)) == at)


def sample(df: DataFrame, rate: float, seed: int) -> DataFrame:
    """Bernoulli sample."""
    return df.sample(rate, seed)

"""Column names: helpers' names that no column of the caller's has, and quoting."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free(name: str, *taken: DataFrame | Iterable[str]) -> str:
    """name with as many underscores before it as it takes to differ, in any case, from all columns and names given."""
    used = {c.lower() for t in taken for c in (t.columns if isinstance(t, DataFrame) else t)}
    while name.lower() in used:
        name = "_" + name
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A top-level column of that very name, whatever characters it has."""
    return F.col(quoted(name))


def own(df: DataFrame) -> list[Column]:
    """All columns of df."""
    return [col(c) for c in df.columns]

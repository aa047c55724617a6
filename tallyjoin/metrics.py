"""Wall time of phases, and the plan's shuffles."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame


class Phases:
    """seconds of each named phase, in order."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    @property
    def total(self) -> float:
        return sum(self.seconds.values())


def plan_of(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df: DataFrame) -> int:
    """Shuffles in df's physical plan."""
    return len(re.findall(r"\bExchange (?:hash|range|Single|RoundRobin)", plan_of(df)))

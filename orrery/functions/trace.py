"""Traces of iterative runs, as rows and as a summary table."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Trace:
    """Collects reports; with ``show`` they are also printed as they come, to a depth of ``level``."""

    def __init__(self, show: Callable[[dict], None] | None = None, level: int = 2):
        self.rows: list[dict] = []
        self.show, self.level, self.depth = show, level, 0
        self.last = time.perf_counter()

    def report(self, name: str, iteration: int = 0, value: float = 0.0) -> None:
        now = time.perf_counter()
        row = {"name": name, "level": self.depth, "iteration": iteration, "value": float(value), "seconds": now - self.last}
        self.last = now
        self.rows.append(row)
        if self.show and self.depth <= self.level:
            self.show(row)

    @contextmanager
    def function(self, name: str) -> Iterator[None]:
        """Reports inside are one level deeper; the whole is reported at its end."""
        begun = time.perf_counter()
        self.depth += 1
        try:
            yield
        finally:
            self.depth -= 1
            self.last = begun
            self.report(name)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "name string, level int, iteration int, value double, seconds double")

    def summary(self, spark: SparkSession) -> DataFrame:
        """(name, calls, seconds, mean_seconds)."""
        return self.frame(spark).groupBy("name").agg(F.count("*").alias("calls"), F.sum("seconds").alias("seconds"), F.avg("seconds").alias("mean_seconds"))


def either(*rules: Callable[[float, float, int], bool]) -> Callable[[float, float, int], bool]:
    """A stop rule that holds when one of several does. Rules see the value before, the value now, the step."""
    return lambda before, now, k: any(r(before, now, k) for r in rules)


def max_iterations(n: int) -> Callable[[float, float, int], bool]:
    return lambda before, now, k: k >= n


def below(limit: float) -> Callable[[float, float, int], bool]:
    return lambda before, now, k: now < limit


def relative(tolerance: float) -> Callable[[float, float, int], bool]:
    return lambda before, now, k: before != float("inf") and 2 * abs(now - before) < tolerance * (abs(now) + abs(before) + 1e-18)


def grows(before: float, now: float, k: int) -> bool:
    return now > before


def no_progress(before: float, now: float, k: int) -> bool:
    return now == before


def iterate(step: Callable, stop: Callable[[float, float, int], bool], x0, value: Callable = float, trace: Trace | None = None, name: str = "iterate"):
    """x0, step(x0), ... until the stop rule holds for the last two values; gives the last state."""
    state, before, k = x0, float("inf"), 0
    if trace:
        trace.report(name, 0, value(state))
    while True:
        state, before, k = step(state), value(state), k + 1
        if trace:
            trace.report(name, k, value(state))
        if stop(before, value(state), k):
            return state

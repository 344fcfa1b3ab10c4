"""Aggregates of a user's own: a map of rows to a state, a merge of two states, and perhaps the inverse of it.

A state is a vector of doubles. Tasks map their rows by group a batch at a time and merge the batches; partial states of a
group are merged in SALTS parts first and then across them, so a group with a third of all rows is no task of its own. States
are plain tables (keys, state): they merge, and subtract where there is an inverse, without their rows.

Defined results: null keys are a group; a map sees all rows, nulls among them; an empty table has no groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

State = np.ndarray
#: Parts in which the partial states of a group are merged first, and states that a task holds before it passes them on.
SALTS, HELD = 32, 10_000


@dataclass(frozen=True)
class Aggregate:
    """``columns`` are those that ``map`` needs of a frame of rows; ``each`` gives the states of single rows, a line for each, at once."""

    columns: tuple[str, ...]
    map: Callable[[pd.DataFrame], State]
    merge: Callable[[State, State], State]
    inverse: Callable[[State, State], State] | None = None
    each: Callable[[pd.DataFrame], np.ndarray] | None = None


def _keyed(df: DataFrame, keys: list[str]) -> str:
    return ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "state array<double>"])


def _frame(held: dict[tuple, State], keys: list[str]) -> pd.DataFrame:
    out = pd.DataFrame({k: pd.Series([key[i] for key in held], dtype=object) for i, k in enumerate(keys)})
    return out.assign(state=[s.tolist() for s in held.values()])


def _plain(key: tuple) -> tuple:
    return tuple(None if k is None or k is pd.NaT or (isinstance(k, float) and k != k) else k for k in key)


def states(df: DataFrame, aggregate: Aggregate, keys: list[str]) -> DataFrame:
    """(keys, state): the state of each group's rows; without keys, one row, or none of an empty table."""
    wanted = [*keys, *(c for c in aggregate.columns if c not in keys)]

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, State] = {}
        for pdf in frames:
            groups = pdf.groupby(keys, dropna=False, sort=False) if keys else [((), pdf)]
            for key, rows in groups:
                if len(rows):
                    key = _plain(key if isinstance(key, tuple) else (key,))
                    new = np.asarray(aggregate.map(rows), dtype=float)
                    held[key] = aggregate.merge(held[key], new) if key in held else new
            if len(held) >= HELD:
                yield _frame(held, keys)
                held = {}
        if held:
            yield _frame(held, keys)

    schema = _keyed(df, keys)
    parts = df.select(*wanted).mapInPandas(partial, schema)
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("state"), F.lit(SALTS)))
    return _reduced(_reduced(salted, aggregate, [*keys, "_salt"]).drop("_salt"), aggregate, keys)


def _reduced(table: DataFrame, aggregate: Aggregate, keys: list[str]) -> DataFrame:
    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        # in order of the values, so that reruns add up alike
        total = reduce(aggregate.merge, [np.asarray(s, dtype=float) for s in sorted(map(tuple, pdf["state"]))])
        return pdf[keys].iloc[:1].assign(state=[np.asarray(total, dtype=float).tolist()])

    return table.groupBy(*keys).applyInPandas(whole, _keyed(table, keys))


def merged(aggregate: Aggregate, keys: list[str], *tables: DataFrame) -> DataFrame:
    """The states of all tables' rows together, by key."""
    return _reduced(reduce(DataFrame.unionByName, (t.select(*keys, "state") for t in tables)), aggregate, keys)


def subtracted(aggregate: Aggregate, keys: list[str], whole: DataFrame, part: DataFrame) -> DataFrame:
    """The states of whole's rows without those of part; a key that part lacks stays as it is."""
    inverse = aggregate.inverse
    if inverse is None:
        raise ValueError("this aggregate has no inverse")

    @F.pandas_udf("array<double>")
    def left(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([x if y is None else np.asarray(inverse(np.asarray(x, float), np.asarray(y, float)), float).tolist() for x, y in zip(a, b, strict=True)])

    both = whole.select(*keys, "state").alias("a").join(part.select(*keys, F.col("state").alias("_part")).alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left")
    return both.select(*(F.col(f"a.{k}").alias(k) for k in keys), left("state", "_part").alias("state"))


def finished(table: DataFrame, finish: Callable[[State], State], out: str = "result") -> DataFrame:
    """The table with an array of doubles made of each state."""

    @F.pandas_udf("array<double>")
    def f(column: pd.Series) -> pd.Series:
        return column.map(lambda s: np.asarray(finish(np.asarray(s, float)), float).tolist())

    return table.withColumn(out, f("state"))


def centred_moments(column: str) -> Aggregate:
    """(n, mean, sum of squared deviations), merged and taken apart by differences of means."""

    def rows(pdf: pd.DataFrame) -> State:
        x = pdf[column].to_numpy(float)
        x = x[~np.isnan(x)]
        return np.array([len(x), x.mean(), ((x - x.mean()) ** 2).sum()]) if len(x) else np.zeros(3)

    def merge(a: State, b: State) -> State:
        n = a[0] + b[0]
        if not n:
            return np.zeros(3)
        apart = b[1] - a[1]
        return np.array([n, a[1] + apart * b[0] / n, a[2] + b[2] + apart * apart * a[0] * b[0] / n])

    def inverse(whole: State, b: State) -> State:
        n = whole[0] - b[0]
        if n <= 0:
            return np.zeros(3)
        mean = whole[1] + (whole[1] - b[1]) * b[0] / n
        return np.array([n, mean, max(0.0, whole[2] - b[2] - (mean - b[1]) ** 2 * n * b[0] / whole[0])])

    def each(pdf: pd.DataFrame) -> np.ndarray:
        x = pdf[column].to_numpy(float)
        known = ~np.isnan(x)
        return np.column_stack([known, np.where(known, x, 0.0), np.zeros(len(x))]).astype(float)

    return Aggregate((column,), rows, merge, inverse, each=each)


def largest(column: str, k: int) -> Aggregate:
    """The k largest values, in falling order."""
    return Aggregate((column,), lambda pdf: np.sort(pdf[column].dropna().to_numpy(float))[::-1][:k], lambda a, b: np.sort(np.concatenate([a, b]))[::-1][:k])


def histogram(column: str, edges: list[float]) -> Aggregate:
    """Counts of values in [edge, next edge), the last interval closed; what lies outside has no count."""
    return Aggregate((column,), lambda pdf: np.histogram(pdf[column].dropna().to_numpy(float), edges)[0].astype(float), lambda a, b: a + b, lambda a, b: a - b)


def normal_equations(features: list[str], target: str) -> Aggregate:
    """Products of a row's features, a constant among them, and its target: all that least squares needs. Rows with nulls take no part."""

    def rows(pdf: pd.DataFrame) -> State:
        x = pdf[[*features, target]].to_numpy(float)
        x = np.column_stack([np.ones(len(x)), x])[~np.isnan(x).any(axis=1)]
        return (x.T @ x).ravel()

    def each(pdf: pd.DataFrame) -> np.ndarray:
        x = pdf[[*features, target]].to_numpy(float)
        x = np.column_stack([np.ones(len(x)), x])
        x[np.isnan(x).any(axis=1)] = 0
        return (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)

    return Aggregate((*features, target), rows, lambda a, b: a + b, lambda a, b: a - b, each)


def least_squares(state: State, ridge: float = 0.0) -> State:
    """Weights (constant first) of the least squares that the products allow."""
    d = int(round(len(state) ** 0.5))
    products = np.asarray(state, float).reshape(d, d)
    return np.linalg.lstsq(products[:-1, :-1] + ridge * np.eye(d - 1), products[:-1, -1], rcond=None)[0]

"""Cross-validation of any model whose state merges: each fold is judged by the merge of all other folds' states.

No state is subtracted, so aggregates without an inverse, such as a top-k, validate as well. The merge of all others is that of
a prefix and a suffix: chunks of CHUNK states are merged, the chunk totals validate each other by the same step, and
in a chunk every state gets the rest of its chunk and all other chunks. So leave-one-out over n rows merges about
four states a row, in tasks of CHUNK states.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import grids, sampling
from orrery.operators.mergeable import Aggregate, State, states

CHUNK = 2048

#: loss(state of the other folds, rows) -> a number for each row
Loss = Callable[[State, pd.DataFrame], np.ndarray]


@dataclass(frozen=True)
class KFold:
    """k folds of n div k rows in hash order; the rows left over train every model and are not judged."""

    k: int
    seed: int = 0


@dataclass(frozen=True)
class LeaveOneOut:
    """A fold for each row."""

    seed: int = 0


@dataclass(frozen=True)
class Groups:
    """A fold for each value of a column; rows without one train every model and are not judged."""

    column: str


def others(table: DataFrame, aggregate: Aggregate) -> DataFrame:
    """(place, state): for each row of (place, state) the merge of all other rows' states, null where there are none.

    Places are whole numbers from 0, without repeats; merges follow their order.
    """
    merge = aggregate.merge

    def arrays(column: pd.Series) -> list[State]:
        return [np.asarray(s, dtype=float) for s in column]

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        out = None
        for s in arrays(pdf.sort_values("place")["state"]):
            out = s if out is None else merge(out, s)
        return pd.DataFrame({"place": pdf["chunk"].iloc[:1], "state": [out.tolist()]})

    def rest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        own, outer = arrays(pdf["state"]), pdf["outer"].iloc[0]
        n = len(own)
        before: list[State | None] = [None] * n
        after: list[State | None] = [None] * n
        run = None if outer is None else np.asarray(outer, dtype=float)
        for i in range(n):
            before[i] = run
            run = own[i] if run is None else merge(run, own[i])
        run = None
        for i in range(n - 1, -1, -1):
            after[i] = run
            run = own[i] if run is None else merge(own[i], run)
        joined = [a if b is None else b if a is None else merge(a, b) for a, b in zip(before, after, strict=True)]
        return pd.DataFrame({"place": pdf["place"], "state": [None if s is None else s.tolist() for s in joined]})

    schema = "place long, state array<double>"
    chunked = grids.cut(table.select("place", "state", F.expr(f"place div {CHUNK}").alias("chunk")))
    if (chunked.agg(F.max("chunk")).first()[0] or 0) == 0:
        return chunked.withColumn("outer", F.lit(None).cast("array<double>")).groupBy("chunk").applyInPandas(rest, schema)
    outer = others(chunked.groupBy("chunk").applyInPandas(total, schema), aggregate)
    wide = chunked.join(outer.select(F.col("place").alias("chunk"), F.col("state").alias("outer")), "chunk")
    return wide.groupBy("chunk").applyInPandas(rest, schema)


def folded(df: DataFrame, id_col: str, folds: KFold | LeaveOneOut | Groups) -> DataFrame:
    """df with ``fold``, a whole number from 0; null where a row is not judged."""
    if isinstance(folds, KFold):
        return sampling.kfold(df, id_col, folds.k, folds.seed).withColumn("fold", F.col("fold").cast("long"))
    if isinstance(folds, LeaveOneOut):
        return sampling.positioned(df, id_col, folds.seed, "fold")
    names = df.select(F.col(folds.column).alias("_name")).filter("_name IS NOT NULL").distinct()
    numbers = sampling.positioned(names, "_name", 0, "fold")
    return df.join(numbers, F.col(folds.column) == F.col("_name"), "left").drop("_name")


def cross_validate(df: DataFrame, id_col: str, folds: KFold | LeaveOneOut | Groups, aggregate: Aggregate, loss: Loss) -> DataFrame:
    """(id, fold, loss) of all judged rows: each by the model of the rows of all other folds.

    A row whose model has no rows at all has a null loss. The frame that ``loss`` gets has the aggregate's columns.
    """
    columns = list(aggregate.columns)
    rows = grids.cut(folded(df.select(id_col, *(c for c in {*columns, *([folds.column] if isinstance(folds, Groups) else [])} if c != id_col)), id_col, folds))
    placed = rows.withColumn("place", F.coalesce("fold", F.lit(-1)) + 1)

    def single(frames):
        for pdf in frames:
            if len(pdf):
                yield pd.DataFrame({"place": pdf["place"], "state": list(aggregate.each(pdf))})

    if isinstance(folds, LeaveOneOut) and aggregate.each:  # a fold is a row: nothing to group
        by_fold = placed.select("place", *(c for c in columns if c != "place")).mapInPandas(single, "place long, state array<double>")
    else:
        by_fold = states(placed, aggregate, ["place"])
    models = others(by_fold, aggregate).select((F.col("place") - 1).alias("fold"), F.col("state").alias("_state"))

    def judged(frames):
        for pdf in frames:
            out = np.full(len(pdf), np.nan)
            for _, at in pdf.groupby("fold", sort=False).indices.items():
                state = pdf["_state"].iloc[at[0]]
                if state is not None:
                    out[at] = loss(np.asarray(state, dtype=float), pdf.iloc[at])
            yield pd.DataFrame({id_col: pdf[id_col], "fold": pdf["fold"], "loss": out})

    kind = df.schema[id_col].dataType.simpleString()
    joined = grids.by_key(rows.filter("fold IS NOT NULL"), grids.cut(models), ["fold"])
    found = joined.select(id_col, "fold", "_state", *(c for c in columns if c != id_col)).mapInPandas(judged, f"`{id_col}` {kind}, fold long, loss double")
    return found.withColumn("loss", F.when(~F.isnan("loss"), F.col("loss")))


def squared_error_of_mean(column: str) -> Loss:
    """For states whose second number is a mean."""
    return lambda state, rows: (rows[column].to_numpy(float) - state[1]) ** 2

"""Splits for evaluation, by hash order: the same on every run and on any cluster.

A table's order is that of md5(id, seed). Positions come from per-range counts and an offset, so no
window runs over a whole table in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 4096


def order_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}")).cast("binary"))


def positioned(df: DataFrame, id_col: str, seed: int, out: str = "pos", by: list[str] | None = None) -> DataFrame:
    """df with each row's 0-based place in the hash order (within the columns of ``by``)."""
    by = by or []
    keyed = df.withColumn("_order", order_key(id_col, seed)).withColumn("_bucket", F.conv(F.substring("_order", 1, 3), 16, 10).cast("int"))
    counts = keyed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # BUCKETS rows a group
    within = Window.partitionBy(*by, "_bucket").orderBy("_order", id_col)
    placed = keyed.withColumn("_at", F.row_number().over(within) - 1).join(counts, [*by, "_bucket"])
    return placed.withColumn(out, (F.col("_base") + F.col("_at")).cast("long")).drop("_order", "_bucket", "_at", "_base")


def shuffled(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    return df.orderBy(order_key(id_col, seed), id_col)


def kfold(df: DataFrame, id_col: str, k: int, seed: int) -> DataFrame:
    """df with ``fold``: step = n div k rows are tested in each fold; the n mod k last ones never (null)."""
    n = df.count()
    step = n // k
    fold = F.expr(f"pos div {max(step, 1)}").cast("int")
    return positioned(df, id_col, seed).withColumn("fold", F.when((fold < k) & F.lit(step > 0), fold)).drop("pos")


def holdout(df: DataFrame, id_col: str, share: float, seed: int) -> DataFrame:
    """df with ``side``: the first round(share * n) rows in hash order train, the rest test."""
    n = round(share * df.count())
    return positioned(df, id_col, seed).withColumn("side", F.when(F.col("pos") < n, "train").otherwise("test")).drop("pos")


def repeated(df: DataFrame, id_col: str, times: int, share: float, seed: int) -> DataFrame:
    """A hold-out split for each of ``times`` repetitions, each in its own order."""
    n = round(share * df.count())
    every = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    keyed = every.withColumn("_id", F.concat(F.col(id_col).cast("string"), F.lit("/"), F.col("rep").cast("string")))
    placed = positioned(keyed, "_id", seed, by=["rep"])
    return placed.withColumn("side", F.when(F.col("pos") < n, "train").otherwise("test")).drop("pos", "_id")


def first_n(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """The first n rows in hash order; a top-k, not a sort of the table."""
    return df.orderBy(order_key(id_col, seed), id_col).limit(n)


def accuracy(df: DataFrame, predicted: str, actual: str, keys: list[str] | None = None) -> DataFrame:
    right = F.avg((F.col(predicted) == F.col(actual)).cast("double"))
    return df.groupBy(*(keys or [])).agg(right.alias("accuracy"), (1 - right).alias("error_rate"))


def squared_loss(predicted: Column, actual: Column) -> Column:
    return (actual - predicted) * (actual - predicted)

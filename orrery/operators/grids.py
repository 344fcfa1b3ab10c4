"""Joins of two tables by group in blocks of bounded size, and cuts of lineage.

A group of any size on either side is dealt out over a grid: rows of the left side get a row of the grid by hash, those of
the right side a column, and each meets all blocks of the other side. A task holds one block of either side,
so a group that has a third of all rows is many tasks.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a block, and of a table of group sizes up to which it is broadcast.
CHUNK, FEW = 4096, 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode a folder of its own where none is named."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster spark.checkpoint.dir has to name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="orrery-checkpoint-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read from there: its lineage ends, and its size is known again.

    A loop that checkpoints instead carries an estimate of the size that grows with every join.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def by_key(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with one row a key; groups are broadcast while they are FEW, which is counted first."""
    return rows.join(F.broadcast(groups) if groups.count() <= FEW else groups, keys, how)


def grid_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, work, schema: str, chunk: int = CHUNK) -> DataFrame:
    """work(left block, right block) -> frame for all blocks of the groups that both sides have, of at most about ``chunk`` rows.

    Ids spread the rows of a group; rows of both sides with equal ``keys`` meet in exactly one call.
    """
    a = left.groupBy(*keys).agg(F.ceil(F.count("*") / chunk).cast("int").alias("_a"))
    b = right.groupBy(*keys).agg(F.ceil(F.count("*") / chunk).cast("int").alias("_b"))
    sizes = cut(a.join(b, keys))

    def dealt(df: DataFrame, own: str, other: str, id_col: str, here: str, there: str) -> DataFrame:
        with_sizes = by_key(df, sizes, keys).withColumn(here, F.pmod(F.xxhash64(id_col), F.col(own)).cast("int"))  # both sides of one type: groups meet by hash
        return with_sizes.withColumn(there, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_a", "_b")

    rows = dealt(left, "_a", "_b", left_id, "_i", "_j")
    columns = dealt(right, "_b", "_a", right_id, "_j", "_i")
    # new names and columns: both sides may come from one table
    columns = columns.select(*(F.col(c).alias(f"r_{c}" if c in (*keys, "_i", "_j") else c) for c in columns.columns))
    return rows.groupBy(*keys, "_i", "_j").cogroup(columns.groupBy(*(f"r_{c}" for c in (*keys, "_i", "_j")))).applyInPandas(work, schema)

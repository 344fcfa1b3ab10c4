"""Streaming twins of the batch operators: running summaries, and a reference set that grows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import metric_join, moments


def running_moments(stream: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """The summary by key of all rows so far; use output mode complete or update."""
    return moments.summary(stream, value, keys)


def windowed_moments(stream: DataFrame, value: str, time: str, width: str, late: str, keys: list[str] | None = None) -> DataFrame:
    """Summaries of tumbling event-time windows; rows later than ``late`` are left out, state is bounded."""
    w = F.window(time, width)
    x = F.col(value).cast("double")
    rows = stream.withWatermark(time, late).groupBy(w, *(keys or []))
    return rows.agg(F.count(x).cast("double").alias("m0"), F.sum(x).alias("m1"), F.sum(x * x).alias("m2"))


def nearest_so_far(path: str, k: int = 1, id_col: str = "vec_id", vec_col: str = "embedding"):
    """A foreachBatch function: each batch is answered against the rows stored before it, then stored too.

    Answers go to ``path``/answers, vectors to ``path``/vectors; a batch that is run again replaces its own.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = f"{path}/vectors"
        if number:
            refs = spark.read.option("basePath", held).parquet(held).filter(F.col("batch") < number)
            found = metric_join.knn(batch, refs, k, id_col, vec_col)
            found.write.mode("overwrite").parquet(f"{path}/answers/batch={number}")
        batch.select(id_col, vec_col).write.mode("overwrite").parquet(f"{held}/batch={number}")

    return each


def run_to_files(frame: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now; its result as Parquet files under ``path``, read again.

    Each batch has a folder of its own, which it replaces when it is run again. In mode complete the last one is the result, in
    the others all of them together. A stream without input gives an empty table.
    """
    last: list[int] = []

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/result/batch={number}")
        last.append(number)

    run = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(each).start()
    run.awaitTermination()
    spark = frame.sparkSession
    if not last:
        return spark.createDataFrame([], frame.schema)
    if mode == "complete":
        return spark.read.parquet(f"{path}/result/batch={max(last)}")
    return spark.read.parquet(f"{path}/result").drop("batch")

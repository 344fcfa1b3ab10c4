"""A two-level metric index as plain tables: every point belongs to its nearest pivot.

It stands where a tree of nested balls would: buckets with tight radii prune searches by the triangle
inequality, and being tables they are built, merged, kept up to date and measured by joins and
aggregations. Node table: (node_id, parent_id, level, far): pivots have no parent, points have their pivot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.operators import metric_join


def build(df: DataFrame, pivots: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, pivot, far): each row with its nearest pivot (ties to the smaller id)."""
    near = metric_join.knn(df, pivots, 1, id_col, vec_col, exclude_zero=False)
    return near.select(F.col("q").alias("id"), F.col("r").alias("pivot"), F.col("dist").alias("far"))


def insert(index: DataFrame, df: DataFrame, pivots: DataFrame, **columns) -> DataFrame:
    """The index with new rows; the old ones stay where they are."""
    return index.unionByName(build(df, pivots, **columns))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two indexes over the same pivots as one; of rows in both the nearer placing counts."""
    both = a.unionByName(b)
    return both.groupBy("id").agg(F.min(F.struct("far", "pivot")).alias("x")).select("id", "x.pivot", "x.far")


def adopt(index: DataFrame, df: DataFrame, pivots: DataFrame, **columns) -> DataFrame:
    """Rows that another pivot is nearer to move there."""
    return merge(index, build(df, pivots, **columns))


def buckets(index: DataFrame) -> DataFrame:
    """(pivot, n, radius, mean): the size of each bucket, its largest and its mean distance."""
    return index.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.avg("far").alias("mean"))


def ordered(index: DataFrame, by: str = "n", ascending: bool = False) -> DataFrame:
    """Buckets in the order of a comparator: their size (``n``) or radius."""
    return buckets(index).orderBy(F.col(by).asc() if ascending else F.col(by).desc(), "pivot")


def packed(index: DataFrame) -> DataFrame:
    """Rows of a bucket side by side in one partition, nearest first."""
    return index.repartition("pivot").sortWithinPartitions("pivot", "far", "id")


def nodes(index: DataFrame) -> DataFrame:
    """The node table."""
    top = index.select(F.col("pivot").alias("node_id")).distinct().select("node_id", F.lit(None).cast("long").alias("parent_id"), F.lit(1).alias("level"), F.lit(0.0).alias("far"))
    below = index.filter("id <> pivot").select(F.col("id").alias("node_id"), F.col("pivot").alias("parent_id"), F.lit(2).alias("level"), "far")
    return top.unionByName(below)


def statistics(node_table: DataFrame) -> DataFrame:
    """One row: points, nodes with children, leaves, depth, and figures on children."""
    kids = node_table.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("k"))
    joined = node_table.select("node_id", "level").join(kids, "node_id", "left").fillna(0, ["k"])
    inner = F.when(F.col("k") > 0, F.col("k"))
    return joined.agg(
        F.count("*").alias("points"), F.count(inner).alias("inner_nodes"), F.count_if(F.col("k") == 0).alias("leaves"), F.max("level").alias("depth"),
        F.max("k").alias("most_children"), F.avg(inner).alias("mean_children"), F.count_if(F.col("k") == 1).alias("single_child"),
    )


def descendants(node_table: DataFrame) -> DataFrame:
    """(node_id, n): how many nodes lie below each one."""
    below = node_table.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n"))
    return node_table.select("node_id").join(below, "node_id", "left").fillna(0, ["n"])


def invariants(index: DataFrame, pivots: DataFrame, cover: float, separation: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row: covering (all rows within ``cover`` of their pivot), separating (no two pivots nearer than
    ``separation``), nearest (the radius bounds every row), and the largest and mean cover ratio."""
    apart = metric_join.knn(pivots, None, 1, id_col, vec_col).agg(F.min("dist").alias("least"))
    ratio = F.col("radius") / F.lit(cover)
    found = buckets(index).agg(F.max("radius").alias("radius"), F.max(ratio).alias("most_cover"), F.avg(ratio).alias("mean_cover"))
    return found.join(apart, how="cross").select(
        (F.col("radius") <= cover).alias("covering"), F.coalesce(F.col("least") >= separation, F.lit(True)).alias("separating"), "most_cover", "mean_cover"
    )


def movable(df: DataFrame, pivots: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cover: float = 1.3) -> DataFrame:
    """(pivot, n, movable): rows of each bucket that the second nearest pivot covers too."""
    two = metric_join.knn(df, pivots, 2, id_col, vec_col, exclude_zero=False)
    own = Window.partitionBy("q").orderBy("rank")
    second = two.withColumn("next", F.lead("dist").over(own)).filter("rank = 1")
    return second.groupBy(F.col("r").alias("pivot")).agg(F.count("*").alias("n"), F.count_if(F.col("next") <= cover).alias("movable"))

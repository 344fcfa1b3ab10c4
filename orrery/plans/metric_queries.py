"""Queries over the embeddings table: nearest neighbours, range search, counts and densities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.operators import cover_tree, grids, metric_join, pruned_join
from orrery.plans.registry import query

PAIRS = """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id AS q, b.vec_id AS r, a.label AS q_label, b.label AS r_label, list_distance(a.v, b.v) AS dist
      FROM e a, e b {where})
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def _near(where: str, k: int, columns: str) -> str:
    return PAIRS.format(where=where) + f"""
SELECT {columns} FROM (
  SELECT q, r, round(dist, 6) AS dist, row_number() OVER (PARTITION BY q ORDER BY dist, r) AS rank FROM p WHERE dist > 0
) WHERE rank <= {k}"""


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("allknn_k1", _near("", 1, "q, r, dist"))
def allknn_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metric_join.knn(vectors(spark, sf_dir)), "dist").select("q", "r", "dist")


@query("allknn_k5", _near("", 5, "q, CAST(rank AS INTEGER) AS rank, r, dist"))
def allknn_k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metric_join.knn(vectors(spark, sf_dir), k=5), "dist")


@query("knn_bichromatic", _near("WHERE a.vec_id % 10 = 0 AND b.vec_id % 10 <> 0", 1, "q, r, dist"))
def knn_bichromatic(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return rounded(metric_join.knn(v.filter("vec_id % 10 = 0"), v.filter("vec_id % 10 <> 0")), "dist").select("q", "r", "dist")


@query("knn_first_references", _near("WHERE a.vec_id < 200 AND b.vec_id < 200", 1, "q, r, dist"))
def knn_first_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The option that takes the first n reference rows; queries shrink with them."""
    v = vectors(spark, sf_dir).orderBy("vec_id").limit(200)
    return rounded(metric_join.knn(v), "dist").select("q", "r", "dist")


@query("knn_self_included", PAIRS.format(where="") + "SELECT q, r, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, r) AS k FROM p) WHERE k <= 2")
def knn_self_included(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metric_join.knn(vectors(spark, sf_dir), k=2, exclude_zero=False), "dist").select("q", "r", "dist")


@query("knn_all_ties", PAIRS.format(where="") + "SELECT q, r, round(dist, 6) AS dist FROM (SELECT *, rank() OVER (PARTITION BY q ORDER BY dist) AS k FROM p) WHERE k <= 3")
def knn_all_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows as near as the third nearest, the query itself included."""
    v = vectors(spark, sf_dir)
    third = metric_join.knn(v, k=3, exclude_zero=False).filter("rank = 3").select("q", F.col("dist").alias("most"))
    limit = third.agg(F.max("most")).first()[0] or 0.0
    near = metric_join.within(v, None, limit, closed=True)
    return rounded(near.join(third, "q").filter("dist <= most").drop("most"), "dist")


@query("range_search", PAIRS.format(where="") + "SELECT q, r, round(dist, 6) AS dist FROM p WHERE dist < 1.2 AND dist > 0")
def range_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs below the radius, without those at distance zero."""
    return rounded(metric_join.within(vectors(spark, sf_dir), None, 1.2, include_zero=False), "dist")


@query("range_search_closed", PAIRS.format(where="") + "SELECT q, r, round(dist, 6) AS dist FROM p WHERE dist <= 1.1")
def range_search_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metric_join.within(vectors(spark, sf_dir), None, 1.1, closed=True), "dist")


@query("range_nearest", PAIRS.format(where="") + "SELECT q, min(round(dist, 6)) AS nearest, max(round(dist, 6)) AS farthest FROM p WHERE dist < 1.2 AND dist > 0 GROUP BY q")
def range_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rounded(metric_join.within(vectors(spark, sf_dir), None, 1.2, include_zero=False), "dist")
    return found.groupBy("q").agg(F.min("dist").alias("nearest"), F.max("dist").alias("farthest"))


@query("range_count", PAIRS.format(where="") + "SELECT q, count(*) AS n FROM p WHERE dist < 1.2 GROUP BY q")
def range_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pruned_join.range_counts(vectors(spark, sf_dir), None, 1.2).filter("n > 0").select("q", "n")


@query("two_point_correlation", PAIRS.format(where="") + "SELECT radius, count(*) FILTER (dist < radius) AS n FROM p, (VALUES (1.1::DOUBLE), (1.2::DOUBLE), (1.3::DOUBLE)) t(radius) GROUP BY radius")
def two_point_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pruned_join.pair_counts(vectors(spark, sf_dir), [1.1, 1.2, 1.3]).select("radius", "n")


for _kernel, _sql in {
    "gaussian": "exp(-dist * dist / 0.5)",
    "epanechnikov": "CASE WHEN dist < 1.25 THEN 0.75 * (1 - (dist / 1.25) * (dist / 1.25)) ELSE 0 END",
    "uniform": "CASE WHEN dist < 1.25 THEN 0.5 ELSE 0 END",
}.items():

    @query(f"density_{_kernel}", PAIRS.format(where="") + f"SELECT q, round(sum({_sql}), 6) AS density FROM p GROUP BY q")
    def density(spark: SparkSession, sf_dir: str, kernel: str = _kernel) -> DataFrame:
        h = 0.5 if kernel == "gaussian" else 1.25
        return rounded(pruned_join.density(vectors(spark, sf_dir), None, h, kernel), "density").select("q", "density")


@query("nearest_label_error", PAIRS.format(where="") + """
SELECT q_label AS label, count(*) AS n, count(*) FILTER (q_label = r_label) AS correct,
       round(1 - count(*) FILTER (q_label = r_label) / count(*), 6) AS error_rate
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, r) AS k FROM p WHERE dist > 0) WHERE k = 1 GROUP BY q_label""")
def nearest_label_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-out error of the nearest-neighbour label."""
    v = vectors(spark, sf_dir)
    labels = v.select(F.col("vec_id").alias("id"), "label")
    near = metric_join.knn(v).select("q", "r")
    both = near.join(labels.withColumnsRenamed({"id": "q", "label": "label"}), "q").join(labels.withColumnsRenamed({"id": "r", "label": "found"}), "r")
    right = F.count_if(F.col("label") == F.col("found"))
    return both.groupBy("label").agg(F.count("*").alias("n"), right.alias("correct"), F.round(1 - right / F.count("*"), 6).alias("error_rate"))


@query("knn_merged", _near("", 3, "q, CAST(rank AS INTEGER) AS rank, r, dist"))
def knn_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours in three overlapping parts of the references, merged."""
    v = vectors(spark, sf_dir)
    parts = [metric_join.knn(v, v.filter(f"vec_id % 4 IN ({a}, {b})"), k=3) for a, b in ((0, 1), (1, 2), (2, 3))]
    return rounded(metric_join.merge_neighbours(3, *parts), "dist")


@query("correlation_algebra", PAIRS.format(where="WHERE a.vec_id % 2 <> b.vec_id % 2") + "SELECT radius, count(*) FILTER (dist < radius) AS n FROM p, (VALUES (1.1::DOUBLE), (1.2::DOUBLE), (1.3::DOUBLE)) t(radius) GROUP BY radius")
def correlation_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs across two halves: the counts of the whole without those of each half."""
    v, radii = vectors(spark, sf_dir), [1.1, 1.2, 1.3]
    halves = [metric_join.negated(pruned_join.pair_counts(v.filter(f"vec_id % 2 = {k}"), radii), "n") for k in (0, 1)]
    return metric_join.merge_sums("n", ["radius"], pruned_join.pair_counts(v, radii), *halves)


@query("density_merged", PAIRS.format(where="") + "SELECT q, round(sum(exp(-dist * dist / 0.5)), 6) AS density FROM p GROUP BY q")
def density_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Densities over two halves of the references, added up."""
    v = vectors(spark, sf_dir)
    halves = [pruned_join.density(v, v.filter(f"vec_id % 2 = {k}"), 0.5) for k in (0, 1)]
    return rounded(metric_join.merge_sums("density", ["q"], *halves), "density")


@query("vector_algebra", """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), a AS (SELECT vec_id, v[1:2] AS x, v[3:4] AS y FROM e)
SELECT vec_id, round(x[1] - y[1], 6) + 0.0 AS minus_1, round(x[2] - y[2], 6) + 0.0 AS minus_2, round(2.5 * x[1], 6) + 0.0 AS scaled_1, round(x[2] / (y[2] + 3), 6) + 0.0 AS over_2,
       round(x[1] * x[1] * y[1] + x[1] * x[2] * y[2], 6) + 0.0 AS matrix_vector_1, round(ln(exp(x[1]) + exp(x[2])), 6) + 0.0 AS log_sum_exp,
       round(-1 / (1 + exp(x[1])), 6) AS loss_slope, round(1 / (1 + exp(x[1])) / (1 + exp(-x[1])), 6) AS loss_curve, round(pow(1.3, vec_id % 5), 6) AS separation FROM a""")
def vector_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.doubles("embedding")
    a = vectors(spark, sf_dir).select("vec_id", F.slice(v, 1, 2).alias("x"), F.slice(v, 3, 2).alias("y"))
    shifted = F.transform("y", lambda t: t + 3)
    cells = {
        "minus_1": V.minus("x", "y")[0], "minus_2": V.minus("x", "y")[1], "scaled_1": V.scaled("x", 2.5)[0], "over_2": V.over(F.col("x"), shifted)[1],
        "matrix_vector_1": V.matrix_vector(V.outer("x", "x"), "y")[0], "log_sum_exp": V.log_sum_exp_list(F.col("x")), "loss_slope": V.log_loss_slope(F.col("x")[0]),
        "loss_curve": V.log_loss_curve(F.col("x")[0]), "separation": V.separation_distance(F.col("vec_id") % 5),
    }
    return a.select("vec_id", *((F.round(c, 6) + 0.0).alias(n) for n, c in cells.items()))


_THREE = "WITH e AS (SELECT vec_id, (embedding::DOUBLE[])[1:3] AS v FROM embeddings), p AS (SELECT a.vec_id AS q, b.vec_id AS r, list_distance(a.v, b.v) AS dist FROM e a, e b)"


def three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three components, in which buckets are much smaller than the whole."""
    return vectors(spark, sf_dir).select("vec_id", F.slice(V.doubles("embedding"), 1, 3).alias("embedding"))


@query("knn_approximate", _THREE + ", k AS (SELECT q, min(dist) AS dist FROM p WHERE dist > 0 GROUP BY q) SELECT q, round(dist, 6) AS nearest, true AS within, true AS saved FROM k")
def knn_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours at most 1.5 times as far as the nearest, which stands beside, with less than half of all distances computed."""
    v = three(spark, sf_dir)
    found = grids.cut(pruned_join.knn(v, epsilon=1.5).select("q", "dist", "computed"))
    mean = found.agg(F.avg("computed").alias("mean"))  # one row
    exact = pruned_join.knn(v).select("q", F.col("dist").alias("exact"))
    within = F.col("dist") <= 1.5 * F.col("exact") * (1 + 1e-12)
    both = found.join(exact, "q").join(F.broadcast(mean), how="cross")
    return both.select("q", F.round("exact", 6).alias("nearest"), within.alias("within"), (F.col("mean") < v.count() / 2).alias("saved"))


@query("density_bounded", _THREE + "SELECT q, round(sum(exp(-dist * dist / 2)), 6) AS density, true AS within, true AS saved FROM p GROUP BY q")
def density_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact density, whether the one with an error of a twentieth of the references is so near, and whether it saved distances."""
    v = three(spark, sf_dir)
    error = v.count() / 20
    near = pruned_join.density(v, bandwidth=1.0, error=error).select("q", F.col("density").alias("near"), "computed")
    every = near.agg(F.sum("computed").alias("all"))  # one row
    exact = pruned_join.density(v, bandwidth=1.0).select("q", "density").join(near, "q").join(F.broadcast(every), how="cross")
    return exact.select("q", F.round("density", 6).alias("density"), (F.abs(F.col("density") - F.col("near")) <= error).alias("within"), (F.col("all") < v.count() ** 2).alias("saved"))


@query("pair_counts_included", _THREE + "SELECT radius, count(*) FILTER (dist < radius) AS n, true AS saved FROM p, (VALUES (0.05::DOUBLE), (0.2::DOUBLE), (2.0::DOUBLE)) t(radius) GROUP BY radius")
def pair_counts_included(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts to which buckets wholly inside or outside the radius give no distances."""
    v = three(spark, sf_dir)
    return pruned_join.pair_counts(v, [0.05, 0.2, 2.0]).select("radius", "n", (F.col("computed") < v.count() ** 2).alias("saved"))


@query("cover_tree_invariants", "SELECT true AS covering, true AS tight, true AS separating, true AS levelled, true AS nearest, count(*) AS points, count(*) - 1 AS below_root FROM embeddings")
def cover_tree_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of nested balls keeps its rules at every level, holds every point once, and its root is above all others."""
    tree = cover_tree.build(three(spark, sf_dir), ratio=2.0, leaf=8)
    points = tree.members.agg(F.count_distinct("id").alias("points"))
    below = tree.nodes.filter("parent IS NULL").join(cover_tree.descendants(tree), ["node", "level"]).agg(F.count("*").alias("below_root"))
    return cover_tree.invariants(tree).join(points, how="cross").join(below, how="cross")  # one row each


@query("cover_tree_knn", _near("", 3, "q, CAST(rank AS INTEGER) AS rank, r, dist"))
def cover_tree_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours through the tree with leaf arrays of up to 32 points."""
    v = vectors(spark, sf_dir)
    return rounded(cover_tree.knn(cover_tree.build(v, leaf=32), v, 3), "dist")


@query("cover_tree_collapsed", _THREE + "SELECT q, r, round(dist, 6) AS dist, true AS smaller FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, r) AS k FROM p WHERE dist > 0) WHERE k = 1")
def cover_tree_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same neighbours after subtrees of up to 16 nodes became leaf arrays, with fewer than half of the nodes."""
    v = three(spark, sf_dir)
    tree = cover_tree.build(v, ratio=2.0, leaf=4)
    small = cover_tree.collapsed(tree, 16)
    smaller = 2 * small.nodes.count() < tree.nodes.count()
    return rounded(cover_tree.knn(small, v), "dist").select("q", "r", "dist", F.lit(smaller).alias("smaller"))


@query("knn_bounded", _near("", 2, "q, CAST(rank AS INTEGER) AS rank, r, dist, true AS saved"))
def knn_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by distances that are broken off once they pass the bound; on the whole fewer components are read."""
    v = vectors(spark, sf_dir)
    found = pruned_join.bounded_knn(v, k=2)
    read = found.groupBy("q").agg(F.max("components").alias("c")).agg(F.sum("c").alias("read"))  # one row
    saved = F.col("read") < v.count() ** 2 * 64
    return rounded(found.join(F.broadcast(read), how="cross"), "dist").select("q", "rank", "r", "dist", saved.alias("saved"))

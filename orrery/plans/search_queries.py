"""Queries on minimisers by row: each row's problem has a minimum that SQL knows in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import search
from orrery.plans.metric_queries import table
from orrery.plans.registry import query


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems dealt over all cores: their file is small, their work is not."""
    rows = table(spark, sf_dir, "supplier").repartition(spark.sparkContext.defaultParallelism, "s_suppkey")
    return rows.select("s_suppkey", (F.floor(F.col("s_acctbal").cast("double") / 100) / 10).alias("at"), (F.col("s_nationkey") + 1).cast("double").alias("steep"))


def _bowl(x):
    """Unimodal, and no parabola: its least point is the row's ``at``."""
    return F.col("steep") * F.cosh((x - F.col("at")) / 4) + F.col("steep")


_AT = "SELECT s_suppkey, floor(s_acctbal::DOUBLE / 100) / 10 + 0.0 AS x FROM supplier"


@query("minimum_golden_section", _AT)
def minimum_golden_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suppliers(spark, sf_dir).select("s_suppkey", (F.round(search.golden_section(_bowl, F.lit(-20.0), F.lit(30.0)), 3) + 0.0).alias("x"))


@query("minimum_brent", _AT)
def minimum_brent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suppliers(spark, sf_dir).select("s_suppkey", (F.round(search.brent(_bowl, F.lit(-20.0), F.lit(30.0)), 3) + 0.0).alias("x"))


@query("maximum_golden_section", _AT)
def maximum_golden_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suppliers(spark, sf_dir).select("s_suppkey", (F.round(search.maximum(search.golden_section, lambda x: -_bowl(x), F.lit(-20.0), F.lit(30.0)), 3) + 0.0).alias("x"))


@query("minimum_bracket", "SELECT s_suppkey, true AS inside FROM supplier")
def minimum_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _suppliers(spark, sf_dir).withColumn("i", search.bracket(_bowl, F.lit(-5.0), 0.1))
    return found.select("s_suppkey", ((F.col("i.lo") <= F.col("at")) & (F.col("at") <= F.col("i.hi"))).alias("inside"))


def _distance(v):
    x, y, z = v[0] - F.col("at"), v[1] - F.col("steep"), v[2] + 1
    return x * x + 5 * y * y + 20 * z * z + x * y


def _its_gradient(v):
    x, y, z = v[0] - F.col("at"), v[1] - F.col("steep"), v[2] + 1
    return F.array(2 * x + y, 10 * y + x, 40 * z)


def _several(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    start = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    found = _suppliers(spark, sf_dir).withColumn("v", search.conjugate_gradient(_distance, _its_gradient, start, **options))
    return found.select("s_suppkey", *((F.round(F.col("v")[k], 3) + 0.0).alias(c) for k, c in enumerate("xyz")))


_THREE = "SELECT s_suppkey, floor(s_acctbal::DOUBLE / 100) / 10 + 0.0 AS x, (s_nationkey + 1)::DOUBLE AS y, -1.0::DOUBLE AS z FROM supplier"


@query("minimum_conjugate_gradient", _THREE)
def minimum_conjugate_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _several(spark, sf_dir, steps=12)


@query("minimum_fletcher_reeves", _THREE)
def minimum_fletcher_reeves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _several(spark, sf_dir, rule="fletcher-reeves", steps=12)


@query("minimum_hestenes_stiefel", _THREE)
def minimum_hestenes_stiefel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _several(spark, sf_dir, rule="hestenes-stiefel", steps=12)


@query("minimum_backtracking", _THREE)
def minimum_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steepest descent with step halving."""
    return _several(spark, sf_dir, rule="steepest", steps=400, search=search.backtracking)


@query("minimum_brent_slope", _AT)
def minimum_brent_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    def slope(x):
        return F.col("steep") * F.sinh((x - F.col("at")) / 4) / 4

    return _suppliers(spark, sf_dir).select("s_suppkey", (F.round(search.brent_with_slope(_bowl, slope, F.lit(-20.0), F.lit(30.0)), 3) + 0.0).alias("x"))


@query("minimum_unbracketed", "SELECT s_suppkey, least(v / 2, v * 2) AS lo, greatest(v / 2, v * 2) AS hi FROM (SELECT s_suppkey, floor(s_acctbal::DOUBLE / 100) AS v FROM supplier)")
def minimum_unbracketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval from half a start to twice the start."""
    start = table(spark, sf_dir, "supplier").select("s_suppkey", F.floor(F.col("s_acctbal").cast("double") / 100).cast("double").alias("v"))
    return start.withColumn("i", search.unbracket(F.col("v"))).select("s_suppkey", "i.lo", "i.hi")


@query("minimum_nelder_mead", _THREE.replace("floor", "round(floor").replace(" + 0.0 AS x", ", 2) + 0.0 AS x"))
def minimum_nelder_mead(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    found = _suppliers(spark, sf_dir).withColumn("v", search.nelder_mead(_distance, start, steps=250))
    return found.select("s_suppkey", *((F.round(F.col("v")[k], 2) + 0.0).alias(c) for k, c in enumerate("xyz")))


def _by_wolfe(strong: bool):
    def along(f, slope, x, fx, d):
        return search.wolfe(f, _its_gradient, slope, x, d, strong)

    return along


@query("minimum_wolfe", _THREE)
def minimum_wolfe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conjugate gradients whose steps pass the weak Wolfe tests."""
    return _several(spark, sf_dir, steps=60, search=_by_wolfe(False))


@query("minimum_strong_wolfe", _THREE)
def minimum_strong_wolfe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _several(spark, sf_dir, steps=60, search=_by_wolfe(True))

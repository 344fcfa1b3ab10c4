"""Mergeable statistics: counts, sums and sums of products.

A summary of a table is (m0, m1, m2); summaries add, subtract and scale as their tables do, so a summary
table can be rolled up, a group can be taken out again without reading its rows, and rows can be weighted.
All functions are plain aggregations with partial sums.

Raw sums lose a variance that is small beside the mean. Where variances are wanted, summaries are centred: (n, mean, s2) with
the sum of squared deviations. They merge, and are taken apart, by differences of means, never by squares of raw values.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(df: DataFrame, value: str, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(keys, m0, m1, m2) of a numeric column; rows with a null value or weight take no part."""
    x = F.col(value).cast("double")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    w = F.when(x.isNotNull() & w.isNotNull(), w)
    sums = (F.coalesce(F.sum(e), F.lit(0.0)) for e in (w, w * x, w * x * x))
    return df.groupBy(*(keys or [])).agg(*(s.alias(n) for s, n in zip(sums, ("m0", "m1", "m2"), strict=True)))


def merge(*summaries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The summary of all tables together, by key."""
    every = reduce(DataFrame.unionByName, summaries)
    return every.groupBy(*(keys or [])).agg(*(F.sum(c).alias(c) for c in ("m0", "m1", "m2")))


def negated(s: DataFrame) -> DataFrame:
    return scale(s, -1.0)


def subtract(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """a without b: the summary of the rows of a that are not in b."""
    return merge(a, negated(b), keys=keys)


def scale(s: DataFrame, r: float) -> DataFrame:
    return s.withColumns({c: F.col(c) * F.lit(float(r)) for c in ("m0", "m1", "m2")})


def combine(a: DataFrame, b: DataFrame, op: str, keys: list[str]) -> DataFrame:
    """Component-wise product or quotient of two summary tables."""
    right = b.withColumnsRenamed({c: f"{c}_" for c in ("m0", "m1", "m2")})
    expr = {c: F.col(c) * F.col(f"{c}_") if op == "*" else F.col(c) / F.col(f"{c}_") for c in ("m0", "m1", "m2")}
    return a.join(right, keys).select(*keys, *(e.alias(c) for c, e in expr.items()))


def without_each(df: DataFrame, value: str, key: str) -> DataFrame:
    """For every group the summary of all other rows, from one pass over the table."""
    groups = summary(df, value, [key])
    whole = groups.agg(*(F.sum(c).alias(f"t{c}") for c in ("m0", "m1", "m2")))  # one row
    return groups.join(F.broadcast(whole), how="cross").select(key, *((F.col(f"t{c}") - F.col(c)).alias(c) for c in ("m0", "m1", "m2")))


def mean() -> Column:
    return F.col("m1") / F.col("m0")


def centred(df: DataFrame, value: str, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(keys, n, mean, s2): size, mean and summed squared deviations; rows with a null value or weight take no part.

    Without weights in one pass; with weights the means come first, and deviations from them are summed in a second one.
    A group without values has n of 0 and a null mean.
    """
    keys = keys or []
    x = F.col(value).cast("double")
    if weight is None:
        n = F.count(x).cast("double")
        return df.groupBy(*keys).agg(n.alias("n"), F.avg(x).alias("mean"), F.coalesce(F.var_pop(x) * n, F.lit(0.0)).alias("s2"))
    w = F.when(x.isNotNull(), F.col(weight).cast("double"))
    rows = df.select(*keys, F.when(w.isNotNull(), x).alias("_x"), w.alias("_w"))
    sizes = rows.groupBy(*keys).agg(F.coalesce(F.sum("_w"), F.lit(0.0)).alias("n"), (F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("mean"))
    right = sizes.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    apart = (rows.join(right, same) if keys else rows.join(right, how="cross")).withColumn("_d", F.col("_x") - F.col("mean"))
    return apart.groupBy(*keys, "n", "mean").agg(F.coalesce(F.sum(F.col("_w") * F.col("_d") * F.col("_d")), F.lit(0.0)).alias("s2"))


def merge_centred(*summaries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The centred summary of all tables together, by key: deviations add up, and so do those of the means from the common one."""
    keys = keys or []
    every = reduce(DataFrame.unionByName, summaries)
    whole = every.groupBy(*keys).agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    right = whole.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = every.join(right, same) if keys else every.join(right, how="cross")
    apart = F.coalesce(F.col("mean") - F.col("_mean"), F.lit(0.0))
    found = joined.groupBy(*keys, F.col("_n").alias("n"), F.col("_mean").alias("mean")).agg(F.sum(F.col("s2") + F.col("n") * apart * apart).alias("s2"))
    return found.select(*keys, "n", "mean", "s2")


def subtract_centred(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The centred summary of a's rows without those of b, the inverse of the merge; keys that b lacks stay."""
    keys = keys or []
    right = b.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("n").alias("_n"), F.col("mean").alias("_mean"), F.col("s2").alias("_s2"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = a.join(right, same, "left") if keys else a.join(right, how="cross")
    gone = F.coalesce("_n", F.lit(0.0))
    n = F.col("n") - gone
    mean = F.when(n > 0, F.when(gone > 0, F.col("mean") + (F.col("mean") - F.col("_mean")) * gone / n).otherwise(F.col("mean")))
    apart = F.coalesce(mean - F.col("_mean"), F.lit(0.0))
    s2 = F.when(n > 0, F.greatest(F.lit(0.0), F.col("s2") - F.coalesce("_s2", F.lit(0.0)) - apart * apart * n * gone / F.col("n"))).otherwise(0.0)
    return joined.select(*keys, n.alias("n"), mean.alias("mean"), s2.alias("s2"))


def variance() -> Column:
    """Population variance of a centred summary."""
    return F.when(F.col("n") > 0, F.col("s2") / F.col("n"))


def normal_pdf(x: str | Column, mu: Column, spread: Column) -> Column:
    """Normal density whose variance has one added, as in the vector form (identity plus covariance)."""
    x = F.col(x) if isinstance(x, str) else x
    s = 1.0 + spread
    return F.exp(-0.5 * (x - mu) * (x - mu) / s) / F.sqrt(2 * F.pi() * s)


def products(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, m0, mi, mj, mij): second moments of all pairs of columns, in one pass."""
    aggs, cells = [F.count("*").cast("double").alias("n")], []
    for c in columns:
        aggs.append(F.sum(F.col(c).cast("double")).alias(f"s_{c}"))
    for a, i in enumerate(columns):
        for j in columns[a:]:
            aggs.append(F.sum(F.col(i).cast("double") * F.col(j).cast("double")).alias(f"p_{i}_{j}"))
    for a, i in enumerate(columns):
        for b, j in enumerate(columns):
            name = f"p_{i}_{j}" if a <= b else f"p_{j}_{i}"
            cells.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col("n").alias("m0"), F.col(f"s_{i}").alias("mi"), F.col(f"s_{j}").alias("mj"), F.col(name).alias("mij")))
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, cov): population covariances, by centred sums in one pass."""
    pairs = [(i, j) for a, i in enumerate(columns) for j in columns[a:]]
    found = df.agg(*(F.covar_pop(F.col(i).cast("double"), F.col(j).cast("double")).alias(f"c{k}") for k, (i, j) in enumerate(pairs)))
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{k}").alias("cov")) for k, pair in enumerate(pairs) for i, j in sorted({pair, pair[::-1]})]
    return found.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def by_dimension(df: DataFrame, vec_col: str, dim: int) -> DataFrame:
    """(dim, n, mean, var): statistics of each of the first ``dim`` components of a vector column.

    Components are summed within a task; one row a component leaves it.
    """
    cells = df.select(F.posexplode(F.slice(F.col(vec_col).cast("array<double>"), 1, dim)).alias("dim", "x"))
    return cells.groupBy("dim").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"))


def variance_order(df: DataFrame, vec_col: str, dim: int) -> DataFrame:
    """(dim, var, pos): components by falling variance, ties in component order."""
    cells = F.expr("transform(array_sort(c, (x, y) -> CASE WHEN x.var > y.var THEN -1 WHEN x.var < y.var THEN 1 ELSE x.dim - y.dim END), (x, i) -> struct(x.dim AS dim, x.var AS var, i AS pos))")
    return by_dimension(df, vec_col, dim).agg(F.collect_list(F.struct("dim", "var")).alias("c")).select(F.explode(cells).alias("x")).select("x.*")


def reordered(df: DataFrame, vec_col: str, order: list[int], out: str = "reordered") -> DataFrame:
    """Vectors with their components in the given order."""
    v = F.col(vec_col)
    return df.withColumn(out, F.array(*(v[k] for k in order)))


def mean_centred(df: DataFrame, vec_col: str, dim: int, out: str = "centred") -> DataFrame:
    """Vectors minus the mean vector; the mean is one row and is broadcast."""
    v = F.col(vec_col).cast("array<double>")
    means = df.agg(F.array(*(F.avg(v[k]) for k in range(dim))).alias("_mean"))
    return df.join(F.broadcast(means), how="cross").withColumn(out, F.zip_with(v, F.col("_mean"), lambda x, m: x - m)).drop("_mean")


def rotated(df: DataFrame, vec_col: str, dim: int, out: str = "rotated") -> DataFrame:
    """Centred vectors in the base of their principal components, all of them; distances stay as they are."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = mean_centred(df, vec_col, dim, "_centred").withColumn("_features", array_to_vector("_centred"))
    model = PCA(k=dim, inputCol="_features", outputCol="_rotated").fit(ready)
    return model.transform(ready).withColumn(out, vector_to_array("_rotated")).drop("_centred", "_features", "_rotated")


def normal_densities(df: DataFrame, columns: list[str], out: str = "pdf") -> DataFrame:
    """df with the density of each row under the normal model of its columns: their means, and identity plus covariance.

    The model has one number a pair of columns; its inverse is taken on the driver. Null in any column gives null.
    """
    whole = df.dropna(subset=columns)
    cov = {(r["i"], r["j"]): r["cov"] for r in covariance(whole, columns).collect()}
    means = whole.agg(*(F.avg(F.col(c).cast("double")) for c in columns)).first()
    if means[0] is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    mu = dict(zip(columns, means, strict=True))
    sigma = np.eye(len(columns)) + np.array([[cov[i, j] for j in columns] for i in columns])
    inverse = np.linalg.inv(sigma)
    size = float(np.linalg.det(sigma)) * (2 * np.pi) ** len(columns)
    apart = {c: F.col(c).cast("double") - F.lit(float(mu[c])) for c in columns}
    form = sum(float(inverse[a, b]) * apart[i] * apart[j] for a, i in enumerate(columns) for b, j in enumerate(columns))
    return df.withColumn(out, F.exp(-0.5 * form) / F.lit(size**0.5))


def nearest_semidefinite(df: DataFrame, matrix_col: str, out: str = "projected") -> DataFrame:
    """df with the nearest positive semidefinite matrix of each row's symmetric one (an array of rows): negative eigenvalues become 0.

    Rows of any sizes of matrices; a null or empty matrix gives null. Work is by batches of rows.
    """

    @F.pandas_udf("array<array<double>>")
    def project(cells: pd.Series) -> pd.Series:
        def one(m) -> list | None:
            if m is None or not len(m):
                return None
            values, axes = np.linalg.eigh(np.stack([np.asarray(row, dtype=float) for row in m]))
            return ((axes * np.maximum(values, 0)) @ axes.T).tolist()

        return cells.map(one)

    return df.withColumn(out, project(F.col(matrix_col).cast("array<array<double>>")))

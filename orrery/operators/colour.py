"""Colours and colour signatures as points of a metric space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the sRGB to CIELab conversion: XYZ matrix by rows, white points of x and z, toe.
TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE_X, WHITE_Z, TOE = 0.950456, 1.088754, 0.008856


def lab(r: Column, g: Column, b: Column) -> Column:
    """struct(l, a, b) of colour values between 0 and 1."""
    x, y, z = (p * r + q * g + s * b for p, q, s in TO_XYZ)

    def bend(t: Column) -> Column:
        return F.when(t > TOE, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)

    light = F.when(y > TOE, 116 * F.pow(y, F.lit(1 / 3)) - 16).otherwise(903.3 * y)
    return F.struct(light.alias("l"), (500 * (bend(x / WHITE_X) - bend(y))).alias("a"), (200 * (bend(y) - bend(z / WHITE_Z))).alias("b"))


def rgb_distance(p: Column, q: Column) -> Column:
    """Euclidean distance of two struct(r, g, b)."""
    return F.sqrt(sum((p[c] - q[c]) * (p[c] - q[c]) for c in ("r", "g", "b")))


def lab_distance(p: Column, q: Column) -> Column:
    return F.sqrt(sum((p[c] - q[c]) * (p[c] - q[c]) for c in ("l", "a", "b")))


def signature(rows: DataFrame, id_col: str, lab_col: str, weight_col: str) -> DataFrame:
    """(id, sig): weighted colours of each id, weights summing to one, in colour order."""
    total = rows.groupBy(id_col).agg(F.sum(weight_col).alias("_t"), F.sort_array(F.collect_list(F.struct(F.col(f"{lab_col}.l").alias("l"), F.col(f"{lab_col}.a").alias("a"), F.col(f"{lab_col}.b").alias("b"), F.col(weight_col).alias("w")))).alias("_s"))
    return total.select(F.col(id_col).alias("id"), F.transform("_s", lambda c: F.struct(c["l"].alias("l"), c["a"].alias("a"), c["b"].alias("b"), (c["w"] / F.col("_t")).alias("w"))).alias("sig"))


def centroids(rows: DataFrame, id_col: str, lab_col: str, weight_col: str) -> DataFrame:
    """(id, l, a, b): the weighted mean colour of each id, from sums alone; an id of any number of colours is no array."""
    w = F.when(F.col(lab_col).isNotNull(), F.col(weight_col))
    means = ((F.sum(w * F.col(f"{lab_col}.{c}")) / F.sum(w)).alias(c) for c in ("l", "a", "b"))
    return rows.groupBy(F.col(id_col).alias("id")).agg(*means)


def centroid(sig: Column) -> Column:
    """The weighted mean colour of a signature."""

    def mean(c: str) -> Column:
        return F.aggregate(sig, F.lit(0.0), lambda s, x: s + x[c] * x["w"])

    return F.struct(*(mean(c).alias(c) for c in ("l", "a", "b")))


def lower_bound(p: Column, q: Column) -> Column:
    """The distance of the centroids, never above the earth mover's distance of the signatures."""
    return lab_distance(centroid(p), centroid(q))


def transport_cost(supply: np.ndarray, demand: np.ndarray, cost: np.ndarray) -> float:
    """The least cost of moving supply to demand (both sum to one): cheapest augmenting paths."""
    supply, demand, (n, m) = supply.astype(float).copy(), demand.astype(float).copy(), cost.shape
    flow, total = np.zeros((n, m)), 0.0
    while supply.max() > 1e-12 and demand.max() > 1e-12:
        left, right = np.where(supply > 1e-12, 0.0, np.inf), np.full(m, np.inf)
        from_left, from_right = np.full(m, -1), np.full(n, -1)
        for _ in range(n + m):
            reach = left[:, None] + cost
            new = reach.min(axis=0)
            closer = new < right - 1e-12
            from_left[closer] = reach.argmin(axis=0)[closer]
            right = np.minimum(right, new)
            back = np.where(flow > 1e-12, right[None, :] - cost, np.inf)
            new = back.min(axis=1)
            closer_left = new < left - 1e-12
            from_right[closer_left] = back.argmin(axis=1)[closer_left]
            left = np.minimum(left, new)
            if not closer.any() and not closer_left.any():
                break
        j = int(np.where(demand > 1e-12, right, np.inf).argmin())
        path, amount, end = [], demand[j], j
        while True:
            i = int(from_left[j])
            path.append((i, j, 1))
            if from_right[i] < 0:
                break
            j = int(from_right[i])
            path.append((i, j, -1))
            amount = min(amount, flow[i, j])
        amount = min(amount, supply[path[-1][0]])
        for i, j, way in path:
            flow[i, j] += way * amount
            total += way * amount * cost[i, j]
        supply[path[-1][0]] -= amount
        demand[end] -= amount
    return float(total)


def earth_movers(pairs: DataFrame, a: str = "a", b: str = "b", out: str = "emd") -> DataFrame:
    """pairs with the earth mover's distance of two signature columns, over CIELab ground distances.

    Filter pairs by ``lower_bound`` first: it is exact about what can be near.
    """

    def points(sig) -> tuple[np.ndarray, np.ndarray]:
        return np.array([[c["l"], c["a"], c["b"]] for c in sig]), np.array([c["w"] for c in sig])

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            cost = []
            for x, y in zip(pdf[a], pdf[b], strict=True):
                (p, u), (q, v) = points(x), points(y)
                cost.append(transport_cost(u, v, np.sqrt(((p[:, None] - q[None]) ** 2).sum(axis=2))))
            yield pdf.drop(columns=[a, b]).assign(**{out: np.array(cost, dtype=float)})

    rest = [f"{x.name} {x.dataType.simpleString()}" for x in pairs.schema.fields if x.name not in (a, b)]
    return pairs.mapInPandas(f, ", ".join([*rest, f"{out} double"]))

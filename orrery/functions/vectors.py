"""Column builders for vectors (arrays of doubles) and the scalar functions that models use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(c: str | Column) -> Column:
    return col(c).cast("array<double>")


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product."""
    return total(F.zip_with(col(a), col(b), lambda x, y: x * y))


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)))


def distance(a: str | Column, b: str | Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(squared_distance(a, b))


def distance_unrolled(a: str | Column, b: str | Column, dim: int) -> Column:
    """The same for a known dimension as one flat expression, which stays inside generated code."""
    out = F.lit(0.0)
    for k in range(dim):
        d = col(a)[k] - col(b)[k]
        out = out + d * d
    return F.sqrt(out)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: str | Column, r: Column | float) -> Column:
    return F.transform(col(a), lambda x: x * r)


def plus(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x + y)


def minus(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x - y)


def times(a: str | Column, b: str | Column) -> Column:
    """Component-wise product."""
    return F.zip_with(col(a), col(b), lambda x, y: x * y)


def over(a: str | Column, b: str | Column) -> Column:
    """Component-wise quotient."""
    return F.zip_with(col(a), col(b), lambda x, y: x / y)


def outer(a: str | Column, b: str | Column) -> Column:
    """Outer product, an array of rows."""
    return F.transform(col(a), lambda x: F.transform(col(b), lambda y: x * y))


def matrix_vector(m: str | Column, v: str | Column) -> Column:
    return F.transform(col(m), lambda row: total(F.zip_with(row, col(v), lambda x, y: x * y)))


def kernel_distance(k_aa: Column, k_bb: Column, k_ab: Column) -> Column:
    """Distance that a kernel induces, from its three values."""
    return F.sqrt(F.greatest(k_aa + k_bb - 2 * k_ab, F.lit(0.0)))


def sign_of(condition: Column) -> Column:
    """1 for true, -1 for false."""
    return F.when(condition, 1.0).otherwise(-1.0)


def indicator(condition: Column) -> Column:
    return condition.cast("int")


def inverse_logit(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def log_sum_exp(a: Column, b: Column) -> Column:
    """log(e^a + e^b) without overflow."""
    return F.greatest(a, b) + F.log1p(F.exp(F.least(a, b) - F.greatest(a, b)))


def log_sum_exp_list(xs: Column) -> Column:
    """The same over an array."""
    m = F.array_max(xs)
    return m + F.log(F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.exp(x - m)))


def log_loss(x: Column) -> Column:
    """log(1 + e^-x)."""
    return log_sum_exp(F.lit(0.0), -x)


def log_loss_slope(x: Column) -> Column:
    return -inverse_logit(-x)


def log_loss_curve(x: Column) -> Column:
    return inverse_logit(x) * inverse_logit(-x)


#: Kernels of a distance and a bandwidth, for density sums.
KERNELS = {
    "gaussian": lambda d, h: F.exp(-d * d / (2 * h * h)),
    "epanechnikov": lambda d, h: F.when(d < h, 0.75 * (1 - (d / h) * (d / h))).otherwise(0.0),
    "uniform": lambda d, h: F.when(d < h, 0.5).otherwise(0.0),
}


def cover_distance(level: Column, ratio: float = 1.3) -> Column:
    return F.pow(F.lit(ratio), level + 1)


def separation_distance(level: Column, ratio: float = 1.3) -> Column:
    return F.pow(F.lit(ratio), level)


def level_down(d: Column, ratio: float = 1.3) -> Column:
    return F.floor(F.log(d) / F.log(F.lit(ratio)))


def level_up(d: Column, ratio: float = 1.3) -> Column:
    return F.ceil(F.log(d) / F.log(F.lit(ratio)))


def digits_only(c: str | Column) -> Column:
    """Digits, points, commas and minus signs of a string."""
    return F.regexp_replace(col(c), "[^0-9.,-]", "")

"""Linear classifiers, one against the rest, with pluggable losses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.functions.trace import Trace
from orrery.operators import objective as O

#: A model has one weight vector a class; more classes than this are an error.
MAX_CLASSES = 10_000


def classes_of(df: DataFrame, label_col: str) -> list:
    """The distinct labels, in order."""
    found = df.select(label_col).where(F.col(label_col).isNotNull()).distinct().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    return sorted(r[0] for r in found)


def train(df: DataFrame, vec_col: str, label_col: str, ridge: float = 1e-3, loss: str | O.Loss = "logistic", optimiser: str = "fletcher-reeves", iterations: int = 50, tolerance: float = 1e-9, trace: Trace | None = None) -> DataFrame:
    """(label, weights): minimises sum of losses + ridge / 2 |w|^2 for each class but the first, which has zeros.

    No intercept. All classes are optimised side by side, so a step costs two passes whatever their number. ``loss``: a
    name of ``objective.LOSSES`` or a function of margins and signs that gives values, slopes and curvatures.
    """
    spark = df.sparkSession
    labels = classes_of(df, label_col)
    rows = df.select(V.doubles(vec_col).alias("x"), F.col(label_col).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL").persist()
    try:
        dim = rows.select(F.max(F.size("x"))).first()[0] or 0
        weights: dict = {c: [0.0] * dim for c in labels}
        if len(labels) > 1:
            goal = O.RowObjective(rows, dim, labels[1:], O.LOSSES[loss] if isinstance(loss, str) else loss, ridge)
            if optimiser == "newton":
                w = O.newton(goal, iterations, tolerance, trace)
            elif optimiser == "bfgs":
                w = O.bfgs(goal, iterations, tolerance, trace)
            else:
                w = O.conjugate_gradient(goal, optimiser, iterations, tolerance, trace)
            weights |= {c: [float(v) for v in row] for c, row in zip(labels[1:], w, strict=True)}
    finally:
        rows.unpersist()
    kind = df.schema[label_col].dataType.simpleString()
    return spark.createDataFrame([(c, w) for c, w in weights.items()], f"label {kind}, weights array<double>")


def centroids(df: DataFrame, vec_col: str, label_col: str, dim: int) -> DataFrame:
    """(label, weights): each class's mean vector, as weights of a simple linear model."""
    v = V.doubles(vec_col)
    return df.groupBy(F.col(label_col).alias("label")).agg(F.array(*(F.avg(v[k]) for k in range(dim))).alias("weights"))


def scores(df: DataFrame, model: DataFrame, vec_col: str, keep: list[str]) -> DataFrame:
    """(keep, class, score) of every row and class; the model has MAX_CLASSES rows at most and is broadcast."""
    m = F.broadcast(model.select(F.col("label").alias("class"), "weights"))
    return df.select(*keep, V.doubles(vec_col).alias("_x")).join(m, how="cross").select(*keep, "class", V.dot("weights", "_x").alias("score"))


def _judged(df: DataFrame, model: DataFrame, vec_col: str, columns: list[str]) -> DataFrame:
    """``columns`` of df with ``predicted`` and its score ``_best``."""
    packed = model.agg(F.sort_array(F.collect_list(F.struct("label", "weights"))).alias("_m"))
    scored = F.transform(F.col("_m"), lambda c: F.struct(V.total(F.zip_with(c["weights"], F.col("_x"), lambda a, b: a * b)).alias("s"), c["label"].alias("label")))
    rows = df.select(*columns, V.doubles(vec_col).alias("_x")).join(F.broadcast(packed), how="cross")
    rows = rows.withColumn("_s", scored).withColumn("_best", F.aggregate("_s", F.lit(float("-inf")), lambda a, c: F.greatest(a, c["s"])))
    return rows.withColumn("predicted", F.filter("_s", lambda c: c["s"] == F.col("_best"))[0]["label"]).drop("_x", "_m", "_s")


def classify(df: DataFrame, model: DataFrame, vec_col: str, id_col: str, keep: list[str] | None = None) -> DataFrame:
    """df's id, the columns of ``keep`` and ``predicted``: the class of the largest score, ties to the smallest class.

    All classes of a row are compared within the row: the model travels as one array.
    """
    return _judged(df, model, vec_col, [id_col, *(keep or [])]).drop("_best")


def loss_column(name: str | Callable[[Column, Column], Column], margin: Column, sign: Column) -> Column:
    """A loss of w.x and a sign (1 or -1), by name or as a function of both columns."""
    if not isinstance(name, str):
        return name(margin, sign)
    return {
        "squared": lambda: 0.5 * (margin - sign) * (margin - sign),
        "logistic": lambda: V.log_loss(sign * margin),
        "hinge": lambda: F.greatest(F.lit(0.0), 1 - sign * margin),
    }[name]()


def validate(df: DataFrame, model: DataFrame, vec_col: str, label_col: str, losses: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """One row: rows, errors (0/1 loss), and the summed losses of each row's predicted class, a user's own ``losses`` among them."""
    judged = _judged(df, model, vec_col, [label_col])
    margin, sign = F.col("_best"), V.sign_of(F.col("predicted") == F.col(label_col))
    return judged.select(margin.alias("m"), sign.alias("s")).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("s") < 0, 1).otherwise(0)).alias("errors"),
        *(F.sum(loss_column(k, F.col("m"), F.col("s"))).alias(k) for k in ("squared", "logistic", "hinge")),
        *(F.sum(loss_column(f, F.col("m"), F.col("s"))).alias(k) for k, f in (losses or {}).items()),
    )

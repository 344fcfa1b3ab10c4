"""Objectives that are sums over the rows of a table, and minimisers that drive them.

Every evaluation is one aggregation: tasks sum values and gradients over their rows (for several weight
vectors at once), and only those sums, of the model's size, reach the driver. Line searches evaluate all
their step lengths in one job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.trace import Trace

#: loss(margin, sign) -> (value, slope, curvature), for arrays; margin is w.x and sign is 1 or -1.
Loss = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def logistic(m: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(np.clip(s * m, -700, 700)))
    return np.logaddexp(0, -s * m), -s * p, p * (1 - p)


def squared(m: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return 0.5 * (m - s) ** 2, m - s, np.ones_like(m)


def hinge(m: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = s * m < 1
    return np.maximum(0, 1 - s * m), np.where(inside, -s, 0.0), np.zeros_like(m)


def huber(width: float = 1.0) -> Loss:
    """Squared near the sign, linear beyond ``width``: an example of a loss of one's own."""

    def f(m: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r = m - s
        near = np.abs(r) <= width
        return np.where(near, 0.5 * r * r, width * (np.abs(r) - 0.5 * width)), np.where(near, r, width * np.sign(r)), near.astype(float)

    return f


LOSSES: dict[str, Loss] = {"logistic": logistic, "squared": squared, "hinge": hinge}


def _vectors(x: pa.Array) -> np.ndarray:
    """Rows of one length as a matrix, without an object for each row; a null component is no number."""
    if x.null_count or len(set(pc.unique(pc.list_value_length(x)).to_pylist())) > 1:
        raise ValueError("vectors must not be null, and of one length")
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(x), -1)


@dataclass
class RowObjective:
    """Sum over rows of loss(w.x, sign) + ridge / 2 |w|^2, for several one-vs-rest problems side by side.

    ``rows`` has a vector column x and a label y; problem c has sign 1 where y equals ``classes[c]``.
    """

    rows: DataFrame
    dim: int
    classes: list
    loss: Loss
    ridge: float = 0.0
    jobs: int = field(default=0, init=False)

    def _sums(self, work, width: int) -> np.ndarray:
        """The sum over all rows of arrays of shape (classes, width), added up in the JVM by cell."""
        self.jobs += 1

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for batch in batches:
                if len(batch):
                    total = total + work(_vectors(batch.column("x")), batch.column("y").to_pandas().to_numpy())
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "value"])

        rows = self.rows.select(F.col("x").cast("array<double>").alias("x"), "y")
        found = rows.mapInArrow(f, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
        out = np.zeros(len(self.classes) * width)
        for r in found:
            out[r["cell"]] = r["value"]
        return out.reshape(len(self.classes), width)

    def value_and_gradient(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For weights of shape (classes, dim): values by class, and gradients."""
        loss, classes = self.loss, self.classes

        def work(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            m = x @ w.T
            s = np.where(y[:, None] == np.array(classes, dtype=object)[None, :], 1.0, -1.0)
            value, slope, _ = loss(m, s)
            return np.hstack([value.sum(axis=0)[:, None], slope.T @ x])

        sums = self._sums(work, 1 + self.dim)
        return sums[:, 0] + 0.5 * self.ridge * (w * w).sum(axis=1), sums[:, 1:] + self.ridge * w

    def along(self, w: np.ndarray, d: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """Values at w + a d for every step a (classes, steps), in one job."""
        loss, classes = self.loss, self.classes

        def work(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            m, t = x @ w.T, x @ d.T
            s = np.where(y[:, None] == np.array(classes, dtype=object)[None, :], 1.0, -1.0)
            return np.stack([loss(m + a[None, :] * t, s)[0].sum(axis=0) for a in steps.T], axis=1)

        values = self._sums(work, steps.shape[1])
        moved = w[:, None, :] + steps[:, :, None] * d[:, None, :]
        return values + 0.5 * self.ridge * (moved * moved).sum(axis=2)

    def hessian(self, w: np.ndarray) -> np.ndarray:
        loss, classes = self.loss, self.classes

        def work(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            s = np.where(y[:, None] == np.array(classes, dtype=object)[None, :], 1.0, -1.0)
            curve = loss(x @ w.T, s)[2]
            return np.stack([((x * c[:, None]).T @ x).ravel() for c in curve.T])

        return self._sums(work, self.dim**2).reshape(-1, self.dim, self.dim) + self.ridge * np.eye(self.dim)


def _step(objective: RowObjective, w: np.ndarray, d: np.ndarray, f: np.ndarray, slope: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Step lengths by class: the lowest value on a geometric grid, then on a finer grid around it.

    A step must pass the Armijo test; without one the step is zero.
    """
    steps = start[:, None] * 2.0 ** np.arange(-8, 8)[None, :]
    for spread in (np.linspace(0.5, 2.0, 13), None):
        values = objective.along(w, d, steps)
        ok = values <= f[:, None] + 1e-4 * steps * slope[:, None]
        best = np.where(ok, values, np.inf).argmin(axis=1)
        picked = steps[np.arange(len(w)), best]
        reached = values[np.arange(len(w)), best]
        if spread is not None:
            steps = picked[:, None] * spread[None, :]
    fine = ok.any(axis=1)
    return np.where(fine, picked, 0.0), np.where(fine, reached, f)


def conjugate_beta(method: str, g: np.ndarray, old: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The weight of the old direction, by class."""
    if method == "steepest":
        return np.zeros(len(g))
    y = g - old
    top, bottom = {
        "fletcher-reeves": ((g * g).sum(1), (old * old).sum(1)),
        "polak-ribiere": ((g * y).sum(1), (old * old).sum(1)),
        "hestenes-stiefel": ((g * y).sum(1), (d * y).sum(1)),
    }[method]
    return np.maximum(0.0, top / np.where(bottom == 0, np.inf, bottom))


def conjugate_gradient(objective: RowObjective, method: str = "fletcher-reeves", iterations: int = 50, tolerance: float = 1e-9, trace: Trace | None = None) -> np.ndarray:
    w = np.zeros((len(objective.classes), objective.dim))
    f, g = objective.value_and_gradient(w)
    d, start = -g, 1 / np.maximum(1.0, np.linalg.norm(g, axis=1))
    for k in range(iterations):
        slope = (d * g).sum(axis=1)
        d = np.where(slope[:, None] < 0, d, -g)
        slope = np.minimum(slope, -(g * g).sum(axis=1) * (slope >= 0))
        a, _ = _step(objective, w, d, f, slope, start)
        w = w + a[:, None] * d
        before, old = f, g
        f, g = objective.value_and_gradient(w)
        if trace:
            trace.report("conjugate_gradient", k, float(f.sum()))
        if (2 * np.abs(before - f) <= tolerance * (np.abs(f) + np.abs(before) + 1e-18)).all():
            break
        d = -g + conjugate_beta(method, g, old, d)[:, None] * d
        start = np.where(a > 0, a, start)
    return w


def newton(objective: RowObjective, iterations: int = 20, tolerance: float = 1e-9, trace: Trace | None = None) -> np.ndarray:
    w = np.zeros((len(objective.classes), objective.dim))
    f, g = objective.value_and_gradient(w)
    for k in range(iterations):
        h = objective.hessian(w)
        d = -np.stack([np.linalg.solve(a + 1e-10 * np.eye(len(a)), b) for a, b in zip(h, g, strict=True)])
        a, _ = _step(objective, w, d, f, (d * g).sum(axis=1), np.ones(len(w)))
        if (a == 0).any():  # no curvature here: down the gradient instead
            d = np.where(a[:, None] == 0, -g, d)
            down, _ = _step(objective, w, d, f, (d * g).sum(axis=1), 1 / np.maximum(1.0, np.linalg.norm(g, axis=1)))
            a = np.where(a == 0, down, a)
        w, before = w + a[:, None] * d, f
        f, g = objective.value_and_gradient(w)
        if trace:
            trace.report("newton", k, float(f.sum()))
        if (np.abs(before - f) <= tolerance * (np.abs(f) + 1e-18)).all():
            break
    return w


def bfgs(objective: RowObjective, iterations: int = 50, tolerance: float = 1e-9, trace: Trace | None = None) -> np.ndarray:
    n = len(objective.classes)
    w = np.zeros((n, objective.dim))
    f, g = objective.value_and_gradient(w)
    h = np.stack([np.eye(objective.dim)] * n)
    start = 1 / np.maximum(1.0, np.linalg.norm(g, axis=1))
    for k in range(iterations):
        d = -np.einsum("cij,cj->ci", h, g)
        a, _ = _step(objective, w, d, f, (d * g).sum(axis=1), start)
        s, before, old = a[:, None] * d, f, g
        w = w + s
        f, g = objective.value_and_gradient(w)
        if trace:
            trace.report("bfgs", k, float(f.sum()))
        if (2 * np.abs(before - f) <= tolerance * (np.abs(f) + np.abs(before) + 1e-18)).all():
            break
        for c in range(n):
            y, rho = g[c] - old[c], s[c] @ (g[c] - old[c])
            if rho > 1e-12:
                if k == 0:  # the scale of the curvature along the first step
                    h[c] = np.eye(objective.dim) * rho / (y @ y)
                e = np.eye(objective.dim) - np.outer(s[c], y) / rho
                h[c] = e @ h[c] @ e.T + np.outer(s[c], s[c]) / rho
        start = np.ones(n)
    return w


RATES = {"const": lambda t, lr=0.001: lr, "linear": lambda t, lr=0.001, gamma=0.1: lr / (1 + gamma * t)}


class ComponentRates:
    """A step size for each weight: it grows while the weight's gradients keep their sign, and shrinks when they turn.

    The agreement is that of the gradient with a running mean of those before, over a running mean of its square; so the rate
    does not depend on the scale of a weight. A rate changes at most by the factors of ``limits`` in a step.
    """

    def __init__(self, start: float = 0.01, gain: float = 0.5, memory: float = 0.9, limits: tuple[float, float] = (0.5, 1.5)):
        self.start, self.gain, self.memory, self.limits = start, gain, memory, limits
        self.rates: np.ndarray | None = None

    def __call__(self, t: int, g: np.ndarray) -> np.ndarray:
        if self.rates is None:
            self.rates, self.mean, self.square = np.full(g.shape, self.start), np.zeros(g.shape), g * g
        agreement = g * self.mean / np.where(self.square > 0, self.square, 1.0)
        self.rates = self.rates * np.clip(1 + self.gain * agreement, *self.limits)
        self.mean = self.memory * self.mean + (1 - self.memory) * g
        self.square = self.memory * self.square + (1 - self.memory) * g * g
        return self.rates


#: Which rows step t uses: a condition, and the share of all rows that it takes.
Sampling = Callable[[int], tuple[Column, float]]


def slices(id_col: str, batches: int) -> Sampling:
    """Slices of the rows by a hash of their id, one after the other."""
    return lambda t: (F.pmod(F.xxhash64(id_col), F.lit(batches)) == t % batches, 1 / batches)


def draws(id_col: str, share: float, seed: int = 0) -> Sampling:
    """An independent draw of about a share of the rows in each step, the same in every run."""
    return lambda t: (F.pmod(F.xxhash64(id_col, F.lit(seed), F.lit(t)), F.lit(1 << 30)) < int(share * (1 << 30)), share)


def stochastic_gradient(objective: RowObjective, sample: Sampling, steps: int, rate: Callable[[int], float] | ComponentRates = RATES["linear"], trace: Trace | None = None) -> np.ndarray:
    """Steps along the gradients of samples of the rows; ``rate`` gives one number a step, or one for each weight."""
    w = np.zeros((len(objective.classes), objective.dim))
    for t in range(steps):
        keep, share = sample(t)
        part = RowObjective(objective.rows.filter(keep), objective.dim, objective.classes, objective.loss, objective.ridge * share)
        f, g = part.value_and_gradient(w)
        w = w - (rate(t, g) if isinstance(rate, ComponentRates) else rate(t)) * g
        if trace:
            trace.report("stochastic_gradient", t, float(f.sum()))
    return w


def minimise_column(spark, f: Callable, lo: float, hi: float, rounds: int = 12, points: int = 64, trace: Trace | None = None) -> tuple[float, float]:
    """The minimum of a function of one variable, given as a Column expression, between lo and hi.

    Each round is one job that evaluates a grid and keeps the two cells around its lowest point, which
    holds the minimum of a unimodal function; the interval shrinks by a factor of points / 2.
    """
    best = (lo, float("inf"))
    for k in range(rounds):
        grid = spark.range(points + 1).select((F.lit(lo) + F.col("id") * F.lit((hi - lo) / points)).alias("x"))
        found = grid.select(F.min(F.struct(f(F.col("x")).alias("fx"), "x")).alias("m")).select("m.*").first()
        if found["fx"] < best[1]:
            best = found["x"], found["fx"]
        if trace:
            trace.report("minimise_column", k, best[1])
        cell = (hi - lo) / points
        if cell == 0 or lo + cell == lo:
            break
        lo, hi = found["x"] - cell, found["x"] + cell
    return best


def bracket(spark, f: Callable, x0: float, scale: float = 1.0, reach: int = 60) -> tuple[float, float]:
    """An interval around a minimum of a Column function: points at growing distances, one job."""
    offsets = spark.range(-reach, reach + 1).select((F.lit(x0) + F.lit(scale) * F.signum("id") * (F.pow(F.lit(1.618034), F.abs("id")) - 1)).alias("x"))
    best = offsets.select(F.min(F.struct(f(F.col("x")).alias("fx"), "x")).alias("m")).first()["m"]
    step = abs(best["x"] - x0) * 0.75 + scale
    return best["x"] - step, best["x"] + step


#: Test functions of one variable, as Column expressions.
def slopes(x):
    return F.when(x < 0, -2 * x).when(x < 30, -x).otherwise(x - 60)


def slopes_with_gap(x):
    return F.when(x < 0, -2 * x).when(x < 30, -x).otherwise(x - 50)


def sine_and_line(x):
    return -13 / 6 * x + F.sin(13 / 4 * (2 * x + 5)) - 53 / 12


def surface(name: str, x, y):
    """Test functions of two variables, as Column expressions."""
    if name == "sphere":
        return x * x + y * y + 3
    if name == "ackley":
        tau = 2 * F.pi()
        return -20 * F.exp(-0.2 * F.sqrt(0.5 * (x * x + y * y))) - F.exp(0.5 * F.cos(tau * x) + 0.5 * F.cos(tau * y)) + F.exp(F.lit(1.0)) + 20
    if name == "beale":
        return F.pow(1.5 - x + x * y, 2) + F.pow(2.25 - x + x * y * y, 2) + F.pow(2.625 - x + x * y * y * y, 2)
    if name == "rosenbrock":
        return 100 * F.pow(y - x * x, 2) + F.pow(x - 1, 2)
    raise ValueError(name)


def minimise_surface(spark, f: Callable, centre: tuple[float, float], width: float, rounds: int = 12, points: int = 80) -> tuple[float, float, float]:
    """The minimum of a Column function of two variables: a grid around the lowest point, shrunk when it stays inside."""
    (x0, y0), best = centre, None
    for _ in range(rounds):
        cell = 2 * width / points
        n = points + 1
        grid = spark.range(n * n).select((F.lit(x0 - width) + F.expr(f"id div {n}") * cell).alias("x"), (F.lit(y0 - width) + (F.col("id") % n) * cell).alias("y"))
        m = grid.select(F.min(F.struct(f(F.col("x"), F.col("y")).alias("fx"), "x", "y")).alias("m")).first()["m"]
        if best is None or m["fx"] <= best[2]:
            best = (m["x"], m["y"], m["fx"])
        edge = max(abs(m["x"] - x0), abs(m["y"] - y0)) > width - 1.5 * cell
        x0, y0, width = best[0], best[1], width if edge else width / 8
    return best

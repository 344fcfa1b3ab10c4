"""A quality classifier: kernel ridge regression by random Fourier features, calibrated by isotonic regression.

Every text gives a vector of statistics over its whole length (sizes, shares of character classes, word and
line repetition, byte entropy). Standardised, they go through random Fourier features of a Gaussian kernel.
Tasks sum the normal equations of their labelled rows; the driver adds at most PARTS such sums and solves a
ridge system. Raw scores of labelled rows that were not fitted on are summed into BINS bins, from which
isotonic regression makes the calibration. What reaches the driver has a fixed size.

At most ``max_rows`` labelled rows are used, drawn by a hash of the id; with fewer rows all are.

Defined results: a null text counts as empty and is scored as such; labels of one id are averaged (0.5 and
more count as 1), null labels and ids are left out; without labelled rows every score is 0.5; with labels of
one class every score is that class; an empty table gives an empty result; extra columns are ignored, or
carried by ``keep_good``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm import common as C

FOURIER, RIDGE, PARTS, BINS, SEED = 320, 1e-3, 16, 1000, 11
_CLASS = np.zeros(256, dtype=np.int64)  # 0 other symbols
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:!?'\"-()"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 6
#: The statistics, in order.
NAMES = (
    "log_chars", "log_words", "word_mean", "word_sd", "word_most", "lower", "upper", "digit", "space", "mark", "other", "high", "entropy",
    "distinct", "commonest", "doubled", "log_lines", "line_distinct", "line_words", "capital", "ended", "odd_words",
)
_ODD = np.frombuffer(bytes(1 if c == 0 else 0 for c in _CLASS), np.uint8)


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, in the order of NAMES."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = text.split()
    n, size = len(words), len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if size else np.zeros(256, np.int64)
    share = np.bincount(_CLASS, counts, 7) / max(1, size)
    p = counts[counts > 0] / max(1, size)
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    most = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    doubled = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        np.log1p(len(text)), np.log1p(n), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        share[1], share[2], share[3], share[4], share[5], share[0], share[6], -(p * np.log2(p)).sum(),
        len(most) / max(1, n), max(most.values(), default=0) / max(1, n), doubled / max(1, n - 1),
        np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
        sum(w[0].isupper() for w in words) / max(1, n), sum(w[-1] in ".!?" for w in words) / max(1, n),
        sum(not w[-1].isalnum() and w[-1] not in ".,;:!?'\"-()" for w in words) / max(1, n),
    ]


@dataclass
class Model:
    """What scoring needs; a few thousand numbers."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values)


def fourier(x: np.ndarray) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel, beside the statistics themselves and a constant."""
    rng = np.random.default_rng(SEED)
    d = x.shape[1]
    w, b = rng.normal(size=(d, FOURIER)) / np.sqrt(2 * d), rng.uniform(0, 2 * np.pi, FOURIER)
    x = np.clip(x, -6, 6)
    return np.hstack([np.sqrt(2 / FOURIER) * np.cos(x @ w + b), x, np.ones((len(x), 1))])


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to y under weights w (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for value, weight in zip(y, w, strict=True):
        blocks.append([value * weight, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, v, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + v, blocks[-1][2] + k]
    return np.repeat([s / v for s, v, _ in blocks], [k for *_, k in blocks])


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.array(pdf["x"].tolist(), dtype=np.float64).reshape(len(pdf), len(NAMES))


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, x): the statistics of every row's text."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "row_key", "x"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), C.row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    return slim.mapInArrow(C.lean(f), "doc_id long, row_key binary, x array<double>")


def fit(rows: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", train: Column | None = None, max_rows: int = 200_000) -> Model | None:
    """A model from statistics (doc_id, x) and a label table; None without labelled rows.

    ``train`` says by id which rows may be learned from. A fifth of them, by a hash of the id, is kept
    for the calibration.
    """
    told = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL")
    told = told.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    if train is not None:
        told = told.filter(train)
    told = C.cut(told)
    share = min(1.0, max_rows / max(1, told.count()))
    pick = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) < int(share * 1_000_000)
    known = rows.join(told.filter(pick), "doc_id").select("x", "y", (F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(5)) == 0).alias("spare"))
    known = C.cut(known.repartition(PARTS))
    moments = known.filter("NOT spare").select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    if not moments:
        known = known.withColumn("spare", F.lit(False))
        moments = known.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    if not moments:
        return None
    mean, scale = np.zeros(len(NAMES)), np.ones(len(NAMES))
    for r in moments:
        mean[r["k"]], scale[r["k"]] = r["m"], r["s"] or 1.0
    size = FOURIER + len(NAMES) + 1

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size + 1))
        for pdf in frames:
            for at in range(0, len(pdf), 2000):
                part = pdf.iloc[at : at + 2000]
                z = fourier((_matrix(part) - mean) / scale)
                total += z.T @ np.hstack([z, part["y"].to_numpy(float)[:, None]])
        yield pd.DataFrame({"total": [total.tobytes()]})

    parts = known.filter("NOT spare").select("x", "y").mapInPandas(C.lean(sums), "total binary").collect()  # at most PARTS rows of a fixed size
    total = sum(np.frombuffer(r["total"]).reshape(size, size + 1) for r in parts)
    weights = np.linalg.solve(total[:, :-1] + RIDGE * max(1.0, total[-1, -2]) * np.eye(size), total[:, -1])
    model = Model(mean, scale, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def bins(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                raw = model.raw(_matrix(pdf))
                yield pd.DataFrame({"bin": np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64), "raw": raw, "y": pdf["y"]})

    spare = known.filter("spare") if known.filter("spare").take(1) else known
    binned = spare.select("x", "y").mapInPandas(C.lean(bins), "bin long, raw double, y double")
    found = sorted(binned.groupBy("bin").agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count("*").alias("n")).collect())
    raw, y, n = (np.array([r[c] for r in found], dtype=np.float64) for c in ("raw", "y", "n"))
    fitted = isotonic(y, n)
    # one knot a step, at its weighted middle
    steps = np.concatenate([[0], np.flatnonzero(np.diff(fitted)) + 1])
    weight = np.add.reduceat(n, steps)
    return Model(mean, scale, weights, np.add.reduceat(raw * n, steps) / weight, fitted[steps])


def scored(rows: DataFrame, model: Model | None) -> DataFrame:
    """rows (doc_id, row_key, x) with ``score`` instead of x."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if model is None or not len(b):
                score = np.full(len(b), 0.5)
            else:
                score = model.score(b.column("x").flatten().to_numpy().reshape(len(b), len(NAMES)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row_key"), pa.array(score)], names=["doc_id", "row_key", "score"])

    return rows.mapInArrow(C.lean(f), "doc_id long, row_key binary, score double")


def classify(docs: DataFrame, labels: DataFrame, train: Column | None = None, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 200_000) -> DataFrame:
    """doc_id, row_key, score (0 to 1) and predicted (0 or 1) of every row."""
    rows = C.cut(with_statistics(docs, id_col, text_col))
    out = scored(rows, fit(rows, labels, label, id_col, train, max_rows))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    verdicts = C.cut(classify(docs, labels, train, id_col=id_col, text_col=text_col, **options).select("row_key", (F.col("predicted") == 1).alias("good")))
    return C.keep_rows(docs, verdicts, "good", id_col, text_col)

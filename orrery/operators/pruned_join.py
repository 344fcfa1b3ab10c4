"""Joins on distance that leave distances out: approximate neighbours, counts by inclusion, densities within an error.

The reference side lies in buckets around pivots, of which the radius and the size are known. From a query's distances to
the pivots alone a bucket may be done: it is too far for a neighbour, or lies wholly inside or outside of a radius, or all its
points have nearly the same kernel value. Only for the other buckets distances are computed, and the results say
how many. A reference side of at most ``metric_join.BROADCAST_BYTES`` is broadcast in bucket order; a larger one
stays in chunks, and only queries that a bucket may matter to travel there.

Null ids and vectors take no part; an empty reference side gives no neighbours, and counts and densities of 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import grids
from orrery.operators.metric_join import PAIRS, PIVOTS, TALL, WIDE, Block, Metric, Tile, _Blocks, _exact, _matrix, _prepared, _rough, _routed, _spread, _tiles, _top, block_knn

#: Share of a tile's pairs above which more components are read for all of them at once; and that of a tile that is not full.
SPARSE, DENSE = 1 / 32, 1 / 4


def block_distances(a: np.ndarray, b: np.ndarray, metric: Metric | None, edge: float | None = None) -> np.ndarray:
    """Distances of all pairs; those so near to ``edge`` that rounding could decide are computed from differences."""
    if metric:
        return metric(a, b)
    squares, error = _rough(a, b)
    d = np.sqrt(np.maximum(squares, 0))
    if edge is not None:
        i, j = np.nonzero(np.abs(squares - edge * edge) <= 4 * error)
        d[i, j] = _exact(a[i], b[j])
    return d


@dataclass
class _Buckets:
    """Reference vectors in bucket order."""

    pivots: np.ndarray
    radius: np.ndarray
    starts: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)

    def held(self, b: int) -> slice:
        return slice(int(self.starts[b]), int(self.starts[b + 1]))


def _bucketed(ids: np.ndarray, vectors: np.ndarray, metric: Metric | None) -> _Buckets:
    """Every point at its nearest of at most PIVOTS pivots, evenly taken by id."""
    n = len(ids)
    picked = np.unique(np.linspace(0, n - 1, min(PIVOTS, max(1, int(n**0.5)))).astype(int)) if n else np.zeros(0, int)
    pivots = vectors[picked]
    bucket, far = np.zeros(n, np.int64), np.zeros(n)
    for lo in range(0, n, TALL):
        part = vectors[lo : lo + TALL]
        d = block_distances(part, pivots, metric)
        bucket[lo : lo + TALL] = d.argmin(axis=1)
        own = bucket[lo : lo + TALL]
        far[lo : lo + TALL] = d[np.arange(len(part)), own] if metric else _exact(part, pivots[own])
    order = np.lexsort((ids, bucket))
    starts = np.searchsorted(bucket[order], np.arange(len(pivots) + 1))
    radius = np.zeros(len(pivots))
    np.maximum.at(radius, bucket, far)
    return _Buckets(pivots, radius * (1 + 1e-12) + 1e-12, starts, ids[order], vectors[order])


def _small(b: _Blocks):
    found = b.refs.toPandas().sort_values("id", kind="stable")
    vectors = _matrix(found["v"]) if len(found) else np.zeros((0, b.dim))
    return b.spark.sparkContext.broadcast(_bucketed(found["id"].to_numpy(np.int64), vectors, b.metric))


def _sides(queries: DataFrame, refs: DataFrame | None, id_col: str, vec_col: str, metric: Metric | None) -> tuple[DataFrame, _Blocks]:
    q = _prepared(queries, id_col, vec_col)
    return q, _Blocks(q if refs is None else _prepared(refs, id_col, vec_col), q, metric)


def knn(queries: DataFrame, refs: DataFrame | None = None, k: int = 1, epsilon: float = 1.0, id_col: str = "vec_id", vec_col: str = "embedding", exclude_zero: bool = True, metric: Metric | None = None) -> DataFrame:
    """(q, rank, r, dist, computed): neighbours whose distances are at most ``epsilon`` times those of the k nearest.

    A bucket is left out when even its nearest possible point, times epsilon, is farther than what was found. ``computed``
    counts the query's distances, those to pivots included.
    """
    if k < 1 or epsilon < 1:
        raise ValueError("k and epsilon must be at least 1")
    q, b = _sides(queries, refs, id_col, vec_col, metric)
    schema = "q long, rank int, r long, dist double, computed long"
    if b.small:
        block = _small(b)

        def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = block.value
            for pdf in _tiles(frames):
                if not len(held.ids):
                    continue
                v, rows = _matrix(pdf["v"]), []
                least = block_distances(v, held.pivots, metric) - held.radius[None, :]
                order = np.argsort(least, axis=1)
                for i, q_id in enumerate(pdf["id"].tolist()):
                    ids, dists, bound, computed = np.zeros(0, np.int64), np.zeros(0), np.inf, len(held.pivots)
                    for bucket in order[i].tolist():
                        if least[i, bucket] * epsilon > bound * (1 + 1e-9):
                            break
                        at = held.held(bucket)
                        d = metric(v[i : i + 1], held.vectors[at])[0] if metric else _exact(v[i], held.vectors[at])
                        computed += len(d)
                        keep = ~(d > bound) & (d > 0) if exclude_zero else ~(d > bound)
                        if not keep.any():
                            continue
                        ids, dists = np.concatenate([ids, held.ids[at][keep]]), np.concatenate([dists, d[keep]])
                        best = np.lexsort((ids, dists))[:k]
                        ids, dists = ids[best], dists[best]
                        bound = dists[-1] if len(dists) == k else np.inf
                    rows += [(q_id, r + 1, int(x), float(d), computed) for r, (x, d) in enumerate(zip(ids, dists, strict=True))]
                yield pd.DataFrame(rows, columns=["q", "rank", "r", "dist", "computed"])

        return _spread(q, b.rows).mapInPandas(near, schema)
    b.pivoted()
    pivots = len(b.pivots)

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "r": [], "dist": [], "computed": []})
        row, r, d = block_knn(_matrix(left["v"]), _matrix(right["v"]), right["id"].to_numpy(np.int64), k, exclude_zero, metric)
        counts = pd.DataFrame({"q": left["q"].to_numpy(), "r": -1, "dist": np.nan, "computed": len(right)})
        return pd.concat([counts, pd.DataFrame({"q": left["q"].to_numpy()[row], "r": r, "dist": d, "computed": -1})])

    found_schema = "q long, r long, dist double, computed long"
    asked = q.select(F.col("id").alias("q"), "v", F.lit(float("inf")).alias("bound"))
    first = b.meet(b.route(asked, own=True), work, found_schema, own=True)
    bound = _top(first.filter("computed < 0"), k).filter(F.col("rank") == k).select("q", (F.col("dist") / epsilon).alias("bound"))
    bounded = asked.drop("bound").join(bound, "q", "left").fillna(float("inf"), ["bound"])
    every = first.unionByName(b.meet(b.route(bounded, own=False, again=False), work, found_schema))
    counts = every.filter("computed >= 0").groupBy("q").agg((F.sum("computed") + pivots).alias("computed"))
    return _top(every.filter("computed < 0"), k).join(counts, "q").select("q", "rank", "r", "dist", "computed")


#: What a bucket gives a query without its distances: (decided, amounts) from lower and upper bounds of its distances.
Decide = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _sums(q: DataFrame, b: _Blocks, width: int, decide: Decide, amounts: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(q, total: array of ``width``, computed): sums over all references, bucket by bucket.

    decide(low, high, sizes) has arrays (queries, buckets); its amounts have a last axis of ``width``. amounts(a, b)
    gives those of a block, (queries, width).
    """
    metric = b.metric
    schema = "q long, total array<double>, computed long"
    if b.small:
        block = _small(b)

        def all_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = block.value
            for pdf in frames:
                v = _matrix(pdf["v"]) if len(pdf) else np.zeros((0, b_dim))
                total, computed = np.zeros((len(v), width)), np.full(len(v), len(held.pivots), np.int64)
                for lo in range(0, len(v), TALL):
                    part = v[lo : lo + TALL]
                    d = block_distances(part, held.pivots, metric)
                    decided, given = decide(np.maximum(d - held.radius[None, :], 0), d + held.radius[None, :], held.sizes)
                    total[lo : lo + TALL] += np.where(decided[:, :, None], given, 0).sum(axis=1)
                    for bucket in np.flatnonzero(~decided.all(axis=0)).tolist():
                        rows, at = np.flatnonzero(~decided[:, bucket]), held.held(bucket)
                        for start in range(at.start, at.stop, WIDE):
                            refs = held.vectors[start : min(at.stop, start + WIDE)]
                            total[lo + rows] += amounts(part[rows], refs)
                            computed[lo + rows] += len(refs)
                if len(pdf):
                    yield pd.DataFrame({"q": pdf["id"], "total": list(total), "computed": computed})

        b_dim = b.dim
        return _spread(q, b.rows).mapInPandas(all_of, schema)
    b.pivoted()
    pivots, radius, n = b.pivots, np.maximum(b.radius, 0) * (1 + 1e-12) + 1e-12, b.sizes

    def bounds(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        d = block_distances(_matrix(pdf["v"]), pivots, metric)
        return decide(np.maximum(d - radius[None, :], 0), d + radius[None, :], n)

    def given(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _tiles(frames):
            decided, amount = bounds(pdf)
            yield pd.DataFrame({"q": pdf["q"], "total": list(np.where(decided[:, :, None], amount, 0).sum(axis=1)), "computed": len(pivots)})

    def open_(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _tiles(frames):
            yield from _routed(pdf, ~bounds(pdf)[0] & (n > 0)[None, :], bound=0.0)

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "total": [], "computed": []})
        a, refs = _matrix(left["v"]), _matrix(right["v"])
        total = np.concatenate([amounts(a[lo : lo + TALL], refs) for lo in range(0, len(a), TALL)])
        return pd.DataFrame({"q": left["q"], "total": list(total), "computed": len(refs)})

    asked = q.select(F.col("id").alias("q"), "v")
    routed = asked.mapInPandas(open_, "q long, v array<double>, bucket long, bound double")
    parts = asked.mapInPandas(given, schema).unionByName(b.meet(routed, work, schema))
    cells = parts.groupBy("q").agg(*(F.sum(F.col("total")[k]).alias(f"t{k}") for k in range(width)), F.sum("computed").alias("computed"))
    return cells.select("q", F.array(*(F.col(f"t{k}") for k in range(width))).alias("total"), "computed")


def _within(radii: list[float], closed: bool) -> tuple[Decide, Callable[[np.ndarray, np.ndarray, Metric | None], np.ndarray]]:
    def decide(low: np.ndarray, high: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = np.stack([high < r for r in radii], axis=2)
        outside = np.stack([low > r for r in radii], axis=2)
        return (inside | outside).all(axis=2), inside * sizes[None, :, None].astype(float)

    def amounts(a: np.ndarray, b: np.ndarray, metric: Metric | None) -> np.ndarray:
        """One tile of distances for all radii; squares are compared, and those near an edge again from differences."""
        total = np.zeros((len(a), len(radii)))
        for lo in range(0, len(b), WIDE):
            refs = b[lo : lo + WIDE]
            d, error = (metric(a, refs), 0.0) if metric else _rough(a, refs)
            for k, r in enumerate(radii):
                edge = r if metric else r * r if r >= 0 else -np.inf
                ok = d <= edge if closed else d < edge
                if not metric:
                    i, j = np.nonzero(np.abs(d - edge) <= 4 * error)
                    near = _exact(a[i], refs[j])
                    ok[i, j] = near <= r if closed else near < r
                total[:, k] += np.count_nonzero(ok, axis=1)
        return total

    return decide, amounts


def range_counts(queries: DataFrame, refs: DataFrame | None = None, radii: list[float] | float = 1.0, closed: bool = False, id_col: str = "vec_id", vec_col: str = "embedding", metric: Metric | None = None) -> DataFrame:
    """(q, radius, n, computed): how many references lie within each radius of every query, 0 included.

    Buckets wholly inside count as a whole, those wholly outside not at all; no row is made for a pair.
    """
    every = [float(r) for r in (radii if isinstance(radii, list) else [radii])]
    decide, amounts = _within(every, closed)
    q, b = _sides(queries, refs, id_col, vec_col, metric)
    found = _sums(q, b, len(every), decide, lambda x, y: amounts(x, y, metric))
    cells = F.array(*(F.struct(F.lit(r).alias("radius"), F.col("total")[k].cast("long").alias("n")) for k, r in enumerate(every)))
    return found.select("q", F.explode(cells).alias("c"), "computed").select("q", "c.radius", "c.n", "computed")


def pair_counts(df: DataFrame, radii: list[float], **options) -> DataFrame:
    """(radius, n, computed): the two-point correlation counts, self pairs included, and the distances computed for all radii."""
    return range_counts(df, None, list(radii), **options).groupBy("radius").agg(F.sum("n").alias("n"), F.sum("computed").alias("computed"))


def density(queries: DataFrame, refs: DataFrame | None = None, bandwidth: float = 0.5, kernel: str = "gaussian", error: float = 0.0, id_col: str = "vec_id", vec_col: str = "embedding", metric: Metric | None = None) -> DataFrame:
    """(q, density, computed): the kernel sum of every query over all references, within ``error`` of the exact one.

    Each reference has an equal share of the error. Where the kernel values of a bucket's nearest and farthest possible
    points differ by less than two shares, all its points get the value in the middle. Without an error only
    buckets beyond the kernel's width are left out.
    """
    h = bandwidth
    shape = {
        "gaussian": lambda d: np.exp(-d * d / (2 * h * h)),
        "epanechnikov": lambda d: np.where(d < h, 0.75 * (1 - (d / h) ** 2), 0.0),
        "uniform": lambda d: np.where(d < h, 0.5, 0.0),
    }[kernel]
    q, b = _sides(queries, refs, id_col, vec_col, metric)
    share = error / max(1, b.rows)

    def decide(low: np.ndarray, high: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most, least = shape(low), shape(high)  # kernels fall with distance
        return most - least <= 2 * share, ((most + least) / 2 * sizes[None, :])[:, :, None]

    def amounts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return shape(block_distances(x, y, metric, None if kernel == "gaussian" else h)).sum(axis=1)[:, None]

    return _sums(q, b, 1, decide, amounts).select("q", F.col("total")[0].alias("density"), "computed")


class _Aborting:
    """The k nearest of queries among references that come block after block, most distances broken off.

    Where no bounds are given, some references of the first block are measured whole, which bounds the answer; the k best so far bound
    it closer from tile to tile. Of all others the first components, in the given order, are read for a whole tile at once, as
    many as rule out most of it; then ``step`` at a time for what is left, and a pair ends once its sum passes the bound. ``work``
    counts the components that each query read.
    """

    def __init__(self, q: np.ndarray, k: int, exclude_zero: bool, order: np.ndarray, step: int, bounds: np.ndarray | None = None):
        self.q, self.k, self.exclude_zero, self.order, self.step, self.depth = q[:, order], k, exclude_zero, order, step, step
        self.bounds = np.full(len(q), np.inf) if bounds is None else bounds.copy()
        self.work = np.zeros(len(q), np.int64)
        # the k best so far of each part's queries: (row, id, distance), by distance and id
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for _ in range(0, len(q), TALL)]

    def meet(self, r: np.ndarray, r_ids: np.ndarray) -> None:
        k, width, r = self.k, self.q.shape[1], r[:, self.order]
        some = np.unique(np.linspace(0, len(r) - 1, min(len(r), max(k + 1, min(len(r) // 4, max(4 * k + 28, min(len(r) // 16, WIDE)))))).astype(int))
        sample, sample_ids, fresh = r[some], r_ids[some], np.isinf(self.bounds).all() and not any(len(x[0]) for x in self.held)
        for p, lo in enumerate(range(0, len(self.q), TALL)):
            bounds = self.bounds[lo : lo + TALL]
            asks = np.flatnonzero(np.isinf(bounds))
            if len(asks) and len(some):
                row, found, d = block_knn(self.q[lo + asks], sample, sample_ids, k, self.exclude_zero, None)
                last = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == k - 1)
                bounds[asks[row[last]]] = d[last]
                self.work[lo + asks] += len(some) * width
                if fresh:
                    self.held[p] = (row, found, d)
        if fresh:  # what was measured whole for all is not read again
            r, r_ids = np.delete(r, some, axis=0), np.delete(r_ids, some)
        for start in range(0, len(r), WIDE):
            tile = Tile(r[start : start + WIDE])
            for p, lo in enumerate(range(0, len(self.q), TALL)):
                part, bounds = self.q[lo : lo + TALL], self.bounds[lo : lo + TALL]
                i, j = self._alive(part, tile, (bounds * (1 + 1e-9)) ** 2, self.work[lo : lo + TALL])
                d = np.concatenate([_exact(part[i[at : at + PAIRS]], tile.v[j[at : at + PAIRS]]) for at in range(0, len(i), PAIRS)]) if len(i) else np.zeros(0)
                use = (d > 0 if self.exclude_zero else np.ones(len(d), bool)) & (d <= bounds[i] * (1 + 1e-9))
                if not use.any():
                    continue
                row, ids, dists = (np.concatenate(x) for x in zip(self.held[p], (i[use], r_ids[start + j[use]], d[use]), strict=True))
                by = np.lexsort((ids, dists, row))
                rank = np.arange(len(by)) - np.searchsorted(row[by], row[by])
                last = by[rank == k - 1]
                bounds[row[last]] = np.minimum(bounds[row[last]], dists[last])
                self.held[p] = tuple(x[by[rank < k]] for x in (row, ids, dists))

    def _alive(self, part: np.ndarray, tile: Tile, most: np.ndarray, work: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of the pairs whose sums of squares do not pass ``most``, with what was read added to ``work``."""
        width, step = part.shape[1], self.step
        few, lo = Tile(tile.v[:: max(1, len(tile.v) // 128)]), min(width, max(step, self.depth - 2 * step))
        while lo < width:  # a sixteenth of the tile tells how many components are worth a product
            share = len(few.near(part, most, lo)[0]) / max(1, len(part) * len(few.v))
            if share <= (DENSE if len(tile.v) < WIDE else SPARSE):
                break
            lo = min(lo + step, width)
        self.depth = lo
        work += len(tile.v) * lo
        i, j, over, error = tile.near(part, most, lo)
        for at in range(lo, width, step):
            work += np.bincount(i, minlength=len(part)) * min(step, width - at)
            over = over + _squares(part, tile.v, i, j, at, at + step)
            keep = over <= error + 1e-12 * most[i]
            i, j, over = i[keep], j[keep], over[keep]
        return i, j

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, reference id, distance), by row, distance and id."""
        parts = [(lo + row, ids, d) for lo, (row, ids, d) in zip(range(0, len(self.q), TALL), self.held, strict=True)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _squares(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Sums of squared differences of paired rows in some components."""
    a, b, out = a[:, lo:hi], b[:, lo:hi], np.zeros(len(i))
    for at in range(0, len(i), WIDE):
        d = a[i[at : at + WIDE]] - b[j[at : at + WIDE]]
        out[at : at + WIDE] = (d * d).sum(axis=1)
    return out


def aborting_knn(q: np.ndarray, r: np.ndarray, r_ids: np.ndarray, k: int, exclude_zero: bool, order: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query row, reference id, distance) of the k nearest, and the components that each query read."""
    search = _Aborting(q, k, exclude_zero, order, step)
    search.meet(r, r_ids)
    return *search.found(), search.work


def bounded_knn(queries: DataFrame, refs: DataFrame | None = None, k: int = 1, step: int = 8, id_col: str = "vec_id", vec_col: str = "embedding", exclude_zero: bool = True) -> DataFrame:
    """(q, rank, r, dist, components): the k nearest by Euclidean distance, most distances broken off early.

    Components are read in order of falling variance among the references, so that far pairs pass the bound soon.
    ``components`` counts what the query read; reading all of n references would be n times the dimension.
    """
    q, b = _sides(queries, refs, id_col, vec_col, None)
    cells = b.refs.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.var_pop("x").alias("var"))  # a row a component
    order = np.array([r["dim"] for r in sorted(cells.collect(), key=lambda r: (-(r["var"] or 0.0), r["dim"]))], dtype=int)
    schema = "q long, rank int, r long, dist double, components long"
    if b.small:
        block = b.broadcast()

        def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, vectors = block.value
            for pdf in frames:
                if len(pdf) and len(ids):
                    row, r, d, work = aborting_knn(_matrix(pdf["v"]), vectors, ids, k, exclude_zero, order, step)
                    yield pd.DataFrame({"q": pdf["id"].to_numpy()[row], "rank": np.arange(len(row)) - np.searchsorted(row, row) + 1, "r": r, "dist": d, "components": work[row]})

        return _spread(q, b.rows).mapInPandas(near, schema)
    b.pivoted()

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "r": [], "dist": [], "components": []})
        row, r, d, work = aborting_knn(_matrix(left["v"]), _matrix(right["v"]), right["id"].to_numpy(np.int64), k, exclude_zero, order, step)
        counts = pd.DataFrame({"q": left["q"].to_numpy(), "r": -1, "dist": np.nan, "components": work})
        return pd.concat([counts, pd.DataFrame({"q": left["q"].to_numpy()[row], "r": r, "dist": d, "components": -1})])

    found_schema = "q long, r long, dist double, components long"
    asked = q.select(F.col("id").alias("q"), "v", F.lit(float("inf")).alias("bound"))
    first = grids.cut(b.meet(b.route(asked, own=True), meet, found_schema, own=True))
    bound = _top(first.filter("components < 0"), k).filter(F.col("rank") == k).select("q", F.col("dist").alias("bound"))
    bounded = asked.drop("bound").join(bound, "q", "left").fillna(float("inf"), ["bound"])

    def told(x: Block, search: _Aborting) -> Iterator[pd.DataFrame]:
        row, r, d = search.found()
        yield pd.DataFrame({"q": x.ids, "r": -1, "dist": np.nan, "components": search.work})
        yield pd.DataFrame({"q": x.ids[row], "r": r, "dist": d, "components": -1})

    def rest(blocks: Iterator[tuple[Block, Block]]) -> Iterator[pd.DataFrame]:
        """Bounds are carried from block to block of a query block's references; its rows are handed on once."""
        at = search = None
        for x, y in blocks:
            if at is None or x.key != at.key:
                if at is not None:
                    yield from told(at, search)
                at, search = x, _Aborting(x.v, k, exclude_zero, order, step, x.bounds)
            search.meet(y.v, y.ids)
        if at is not None:
            yield from told(at, search)

    every = first.unionByName(b.paired(bounded, rest, found_schema, again=False))
    counts = every.filter("components >= 0").groupBy("q").agg(F.sum("components").alias("components"))
    return _top(every.filter("components < 0"), k).join(counts, "q").select("q", "rank", "r", "dist", "components")

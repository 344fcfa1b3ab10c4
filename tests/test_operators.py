"""Operators against brute force on small inputs, and their laws."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import trace as T
from orrery.operators import colour, glm, graphs, metric_join, moments, objective, pivot_index, pruned_join, sampling
from orrery.sources import loaders


def frame(spark, points):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "vec_id long, embedding array<double>")


def brute(points, k, exclude_zero=True, refs=None):
    out = []
    for i, p in enumerate(points):
        d = sorted((math.dist(p, q), j) for j, q in enumerate(refs or points))
        d = [x for x in d if x[0] > 0 or not exclude_zero]
        out += [(i, n + 1, j, round(x, 9)) for n, (x, j) in enumerate(d[:k])]
    return sorted(out)


def rows(df):
    return sorted((r["q"], r["rank"], r["r"], round(r["dist"], 9)) for r in df.collect())


RNG = np.random.default_rng(5)
SETS = {
    "one": [(1, 2)],
    "two": [(0, 0), (3, 4)],
    "equal": [(1, 1)] * 4,
    "copies": [(0, 0), (0, 0), (1, 0)],
    "square": [(0, 0), (0, 1), (1, 0), (1, 1)],
    "line": [(x,) for x in (5, 1, 1, 9, 3)],
    "cloud": RNG.normal(size=(60, 3)).tolist() + [[9.0, 9.0, 9.0]] * 3,
}


@pytest.mark.parametrize("name", SETS)
@pytest.mark.parametrize("small", [True, False])
def test_knn(spark, name, small, monkeypatch):
    if not small:
        monkeypatch.setattr(metric_join, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(metric_join, "CHUNK", 16)
    df = frame(spark, SETS[name])
    assert rows(metric_join.knn(df, k=3)) == brute(SETS[name], 3)
    assert rows(metric_join.knn(df, k=1, exclude_zero=False)) == brute(SETS[name], 1, False)


@pytest.mark.parametrize("small", [True, False])
def test_range_and_density(spark, small, monkeypatch):
    points = SETS["cloud"]
    if not small:
        monkeypatch.setattr(metric_join, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(metric_join, "CHUNK", 16)
    df = frame(spark, points)
    want = sorted((i, j) for i, p in enumerate(points) for j, q in enumerate(points) if math.dist(p, q) < 1.5)
    got = sorted((r["q"], r["r"]) for r in metric_join.within(df, None, 1.5).collect())
    assert got == want
    sums = {r["q"]: r["density"] for r in pruned_join.density(df, None, 0.7).collect()}
    for i, p in enumerate(points):
        assert sums[i] == pytest.approx(sum(math.exp(-math.dist(p, q) ** 2 / (2 * 0.49)) for q in points))


def test_knn_other_metric_and_empty(spark):
    df = frame(spark, SETS["cloud"])

    def city(a, b):
        return np.abs(a[:, None, :] - b[None, :, :]).sum(axis=2)

    got = {r["q"]: r["r"] for r in metric_join.knn(df, metric=city).collect()}
    for i, p in enumerate(SETS["cloud"]):
        d = [(sum(abs(x - y) for x, y in zip(p, q, strict=True)), j) for j, q in enumerate(SETS["cloud"])]
        assert got[i] == min(x for x in d if x[0] > 0)[1]
    assert metric_join.knn(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        metric_join.knn(df, k=0)


def test_nearest_neighbour_laws(spark):
    found = {r["q"]: (r["r"], r["dist"]) for r in metric_join.knn(frame(spark, SETS["cloud"])).collect()}
    for q, (r, d) in found.items():
        assert q != r
        assert found[r][1] <= d
        if found[r][0] == q:
            assert found[r][1] == d


def test_moment_laws(spark):
    df = spark.createDataFrame([(k % 3, float(x)) for k, x in enumerate(RNG.normal(size=50))] + [(0, None)], "g int, x double")
    a, b = df.filter("g = 0"), df.filter("g <> 0")
    whole = moments.summary(df, "x").first()
    both = moments.merge(moments.summary(a, "x"), moments.summary(b, "x")).first()
    assert list(whole) == pytest.approx(list(both))
    left = moments.subtract(moments.summary(df, "x"), moments.summary(b, "x")).first()
    assert list(left) == pytest.approx(list(moments.summary(a, "x").first()))
    stat = moments.centred(df, "x").select("mean", moments.variance()).first()
    want = df.agg(F.avg("x"), F.var_pop("x")).first()
    assert list(stat) == pytest.approx(list(want))
    assert list(moments.summary(df.limit(0), "x").first()) == [0, 0, 0]
    half = moments.scale(moments.summary(df, "x"), 0.5).select(moments.mean()).first()[0]
    assert half == pytest.approx(want[0])


def test_folds(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    folds = {r["k"]: r["fold"] for r in sampling.kfold(df, "k", 5, 1).collect()}
    assert sorted(v for v in folds.values() if v is not None) == sorted([f for f in range(5) for _ in range(20)])
    assert sum(v is None for v in folds.values()) == 3
    assert folds == {r["k"]: r["fold"] for r in sampling.kfold(df.repartition(7), "k", 5, 1).collect()}
    assert sampling.holdout(df, "k", 0.7, 1).filter("side = 'train'").count() == 72


def test_logistic_training_reaches_the_optimum(spark):
    x = RNG.normal(size=(200, 3))
    y = ["b" if v @ [1.0, -2.0, 0.5] + RNG.normal() > 0 else "a" for v in x]
    df = spark.createDataFrame([(i, v.tolist(), c) for i, (v, c) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y string")
    models = {}
    for how in ("newton", "bfgs", "polak-ribiere"):
        got = glm.train(df, "x", "y", ridge=0.1, optimiser=how, iterations=25, tolerance=1e-10).collect()
        models[how] = np.array({r["label"]: r["weights"] for r in got}["b"])
        assert {r["label"]: r["weights"] for r in got}["a"] == [0.0] * 3
    s = np.array([1.0 if c == "b" else -1.0 for c in y])
    gradient = -(s / (1 + np.exp(s * (x @ models["newton"])))) @ x + 0.1 * models["newton"]
    assert np.abs(gradient).max() < 1e-4
    assert np.allclose(models["newton"], models["bfgs"], atol=1e-2)
    assert np.allclose(models["newton"], models["polak-ribiere"], atol=1e-2)


def test_classify_ties_go_to_the_smallest_class(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "id long, x array<double>")
    model = spark.createDataFrame([("c", [1.0, 0.0]), ("b", [1.0, 0.0]), ("a", [0.0, 0.0])], "label string, weights array<double>")
    assert glm.classify(df, model, "x", "id").first()["predicted"] == "b"


def test_walks(spark):
    edges = spark.createDataFrame([("g", 0, 1), ("g", 1, 2), ("g", 2, 2)], "graph string, src int, dst int")
    a = np.zeros((3, 3))
    for i, j in ((0, 1), (1, 0), (1, 2), (2, 1), (2, 2)):
        a[i, j] = 1
    got = {r["t"]: r["memo"] for r in graphs.walk_profiles(graphs.symmetrised(edges)).collect()}
    for t in range(1, 6):
        assert got[t] == pytest.approx(np.linalg.matrix_power(a, t).sum() / 9)


def test_transport():
    cost = np.array([[0.0, 1, 4], [1, 0, 1], [4, 1, 0]])
    a, b = np.array([1, 4, 4]) / 9, np.array([6, 2, 1]) / 9
    # on a line with squared costs the cheapest plan moves mass step by step: 2 + 3 units by one, 3 by one
    from itertools import product

    best = min(
        sum(f * c for f, c in zip(p, cost.ravel(), strict=True))
        for p in _plans(np.array([1, 4, 4]), np.array([6, 2, 1]), product)
    )
    assert colour.transport_cost(a, b, cost) == pytest.approx(best / 9)
    assert colour.transport_cost(a, a, cost) == pytest.approx(0)


def _plans(u, v, product):
    for p in product(range(5), repeat=4):
        m = np.zeros((3, 3), int)
        m[:2, :2] = np.reshape(p, (2, 2))
        m[:2, 2] = u[:2] - m[:2, :2].sum(axis=1)
        m[2] = v - m[:2].sum(axis=0)
        if (m >= 0).all() and m[2].sum() == u[2]:
            yield m.ravel()


def test_lower_bound_never_above(spark):
    rows = [(k, float(x), float(y), float(z), float(w)) for k in range(4) for x, y, z, w in RNG.uniform(0.1, 1, size=(5, 4))]
    df = spark.createDataFrame(rows, "id long, r double, g double, b double, w double")
    sig = colour.signature(df.withColumn("lab", colour.lab(F.col("r"), F.col("g"), F.col("b"))), "id", "lab", "w")
    first = sig.filter("id = 0").select(F.col("sig").alias("a"))
    pairs = sig.filter("id > 0").select("id", F.col("sig").alias("b")).join(F.broadcast(first), how="cross")
    pairs = pairs.withColumn("bound", colour.lower_bound(F.col("a"), F.col("b")))
    for r in colour.earth_movers(pairs).collect():
        assert r["bound"] <= r["emd"] + 1e-9


def test_pivots(spark):
    df = frame(spark, SETS["cloud"])
    pivots = df.filter("vec_id % 10 = 0")
    index = pivot_index.build(df, pivots)
    assert index.count() == len(SETS["cloud"])
    stats = pivot_index.statistics(pivot_index.nodes(index)).first()
    assert stats["points"] == len(SETS["cloud"])
    halves = [pivot_index.build(df.filter(f"vec_id % 2 = {k}"), pivots) for k in (0, 1)]
    assert sorted(map(tuple, pivot_index.merge(*halves).select("id", "pivot").collect())) == sorted(map(tuple, index.select("id", "pivot").collect()))


def test_minimise(spark):
    x, fx = objective.minimise_column(spark, lambda c: (c - 5) * (c - 5), *objective.bracket(spark, lambda c: (c - 5) * (c - 5), 1.0))
    assert x == pytest.approx(5, abs=1e-4)
    assert fx == pytest.approx(0, abs=1e-7)


def test_trace_and_stop_rules(spark):
    t = T.Trace()
    end = T.iterate(lambda x: x / 2, T.either(T.max_iterations(50), T.below(0.1)), 8.0, trace=t, name="halve")
    assert end == pytest.approx(0.0625)
    s = t.summary(spark).first()
    assert (s["name"], s["calls"]) == ("halve", 8)


def test_loaders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2,x\n3,4,y\n")
    got = loaders.load(spark, str(tmp_path / "a.csv"), "labelled", label=2).orderBy("id").collect()
    assert [(r["id"], r["label"], r["features"]) for r in got] == [(0, "x", [1.0, 2.0]), (1, "y", [3.0, 4.0])]
    (tmp_path / "b.csv").write_text("1,2\n3,4\n")
    assert [r["features"] for r in loaders.csv(spark, str(tmp_path / "b.csv")).orderBy("id").collect()] == [[1.0, 2.0], [3.0, 4.0]]
    with pytest.raises(Exception):
        loaders.csv(spark, str(tmp_path / "a.csv")).collect()
    (tmp_path / "bag.txt").write_text("2\n5\n3\n1 2 4\n1 3 1\n2 5 2\n")
    assert {r["doc"]: r["bag"] for r in loaders.bag_of_words(spark, str(tmp_path / "bag.txt")).collect()} == {0: {2: 4.0, 3: 1.0}, 1: {5: 2.0}}
    (tmp_path / "g.plg").write_text("|v\n|v\n|v\n= 1 = t = 2\n= 2 = t = 3\n")
    edges, nodes = loaders.plg(spark, str(tmp_path / "g.plg"))
    assert sorted((r["src"], r["dst"]) for r in edges.collect()) == [(0, 1), (1, 0), (1, 2), (2, 1)]
    assert nodes.count() == 3
    with pytest.raises(ValueError):
        loaders.load(spark, "x", "nonsense")
    found = metric_join.knn(loaders.csv(spark, str(tmp_path / "b.csv")), id_col="id", vec_col="features")
    loaders.write_neighbours(found, str(tmp_path / "out"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).split()
    assert lines == ["1", "0"]
    (tmp_path / "tree" / "sub").mkdir(parents=True)
    (tmp_path / "tree" / "a.txt").write_text("abc")
    (tmp_path / "tree" / "sub" / "b.txt").write_text("d")
    (tmp_path / "tree" / ".hidden").write_text("no")
    assert loaders.files(spark, str(tmp_path / "tree")).count() == 2
    sizes = loaders.directory(spark, str(tmp_path / "tree"), lambda df: df.select("path", F.length("content").alias("n")), limit=1)
    assert [r["n"] for r in sizes.collect()] == [3]


def test_row_ids_are_dense(spark):
    df = loaders.with_row_ids(spark.range(0, 100, 1, 7).withColumnRenamed("id", "x"))
    assert [(r["x"], r["id"]) for r in df.orderBy("id").collect()] == [(k, k) for k in range(100)]


def test_entry_has_queries():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "allknn_k1" in names
    assert set(entry.oracle_sql()) <= names


def test_glm_train_query_reaches_the_optimum(spark, tmp_path):
    """The gradient of the sums of losses and ridge vanishes at the weights that the registered query gives."""
    from orrery.plans import model_queries

    rng = np.random.default_rng(4)
    rows = [(float(q), float(q * p), float(d) / 100, float(t) / 100, "ANR"[f]) for q, p, d, t, f in zip(rng.integers(1, 51, 400), rng.uniform(900, 2000, 400), rng.integers(0, 11, 400), rng.integers(0, 9, 400), rng.integers(0, 3, 400), strict=True)]
    spark.createDataFrame(rows, "l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {}
    for r in model_queries.glm_train(spark, str(tmp_path)).collect():
        got.setdefault(r["label"], {})[r["k"]] = r["weight"]
    x = np.array([[1.0, q / 50, e / 1e5, d * 10, t * 10] for q, e, d, t, _ in rows])
    assert sorted(got) == ["A", "N", "R"] and set(got["A"].values()) == {0.0}
    for c in "NR":
        w, s = np.array([got[c][k] for k in range(5)]), np.array([1.0 if r[4] == c else -1.0 for r in rows])
        gradient = -(x * (s / (1 + np.exp(s * (x @ w))))[:, None]).sum(axis=0) + 1e-3 * w
        assert np.abs(gradient).max() < 1e-4


def test_graph_kernel_query_has_all_pairs(spark, tmp_path):
    """More than 1000 graphs, of two vertices or one: every pair has a row."""
    from orrery.plans import model_queries

    n = 1001
    spark.range(n).selectExpr("id AS n_nationkey", "id AS n_regionkey").write.parquet(str(tmp_path / "nation.parquet"))
    spark.range(n).selectExpr("id AS s_suppkey", "id AS s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    found = model_queries.graph_kernel(spark, str(tmp_path)).agg(F.count("*").alias("n"), F.count_distinct("q").alias("q"), F.count_distinct("r").alias("r")).first()
    assert tuple(found) == (n * n, n, n)


def test_merged_results_are_those_of_the_whole(spark):
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(k, rng.normal(size=3).tolist()) for k in range(60)], "vec_id long, embedding array<double>").cache()
    parts = [v.filter("vec_id < 40"), v.filter("vec_id >= 25")]
    merged = metric_join.merge_neighbours(4, *(metric_join.knn(v, p, k=4) for p in parts))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, metric_join.knn(v, k=4).collect()))
    whole = pruned_join.range_counts(v, None, 1.5)
    less = metric_join.merge_sums("n", ["q"], whole, metric_join.negated(pruned_join.range_counts(v, parts[0], 1.5), "n"))
    other = {r["q"]: r["n"] for r in pruned_join.range_counts(v, v.filter("vec_id >= 40"), 1.5).collect() if r["n"]}
    assert {r["q"]: r["n"] for r in less.collect() if r["n"]} == other


def test_vector_densities_and_projection(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 3)) @ np.array([[1, 0.5, 0], [0, 2, 0.3], [0, 0, 1]])
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)] + [(99, None, 1.0, 1.0)], "id long, a double, b double, c double")
    got = {r["id"]: r["pdf"] for r in moments.normal_densities(df, ["a", "b", "c"]).collect()}
    sigma, mu = np.eye(3) + np.cov(x.T, bias=True), x.mean(axis=0)
    for k, r in enumerate(x):
        form = (r - mu) @ np.linalg.inv(sigma) @ (r - mu)
        assert got[k] == pytest.approx(np.exp(-form / 2) / np.sqrt((2 * np.pi) ** 3 * np.linalg.det(sigma)))
    assert got[99] is None
    assert moments.normal_densities(df.limit(0), ["a", "b"]).count() == 0
    m = [[[2.0, 3.0, 0.0], [3.0, 2.0, 1.0], [0.0, 1.0, -1.0]], [[4.0]], None, []]
    out = [r["projected"] for r in moments.nearest_semidefinite(spark.createDataFrame([(a,) for a in m], "m array<array<double>>"), "m").collect()]
    values, axes = np.linalg.eigh(np.array(m[0]))
    assert np.allclose(out[0], (axes * np.maximum(values, 0)) @ axes.T) and np.linalg.eigvalsh(np.array(out[0])).min() > -1e-9
    assert out[1:] == [[[4.0]], None, None]


def test_blocks_of_a_range_search_do_not_repeat_references_for_few_queries(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(metric_join, "CHUNK", 64)
    sent, blocks = [], metric_join._Blocks.blocks
    monkeypatch.setattr(metric_join._Blocks, "blocks", lambda self, routed: sent.append(blocks(self, routed)) or sent[0])
    points = np.random.default_rng(2).normal(size=(256, 2)).tolist()
    got = sorted((r["q"], r["r"]) for r in metric_join.within(frame(spark, points), None, 9.0, closed=True).collect())
    assert got == sorted((i, j) for i, p in enumerate(points) for j, q in enumerate(points) if math.dist(p, q) <= 9.0)
    assert sent[0].filter("not asks").count() <= 4 * 256  # once for each 64 queries


def test_vectors_of_an_objective_come_as_one_matrix():
    import pyarrow as pa

    whole = pa.array([[9.0, 9.0], [1.0, 2.0], [3.0, None]]).slice(1)
    assert np.array_equal(objective._vectors(whole), [[1.0, 2.0], [3.0, np.nan]], equal_nan=True)
    for wrong in ([[1.0], [1.0, 2.0, 3.0]], [[1.0], None]):
        with pytest.raises(ValueError):
            objective._vectors(pa.array(wrong))

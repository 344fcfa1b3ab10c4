"""Pruned joins, the cover tree, user-defined aggregates and cross-validation against plain Python."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery.operators import cover_tree, glm, grids, mergeable, metric_join, moments, objective, pruned_join, validation

RNG = np.random.default_rng(11)
CLOUD = np.round(np.concatenate([RNG.normal(size=(70, 2)), RNG.normal(size=(20, 2)) * 0.01 + 3, np.repeat([[0.5, 0.25]], 6, 0)]), 3)


def frame(spark, points=CLOUD):
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(None, [0.0, 0.0]), (9999, None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


DIST = np.array([[math.dist(p, q) for q in CLOUD] for p in CLOUD])


def nearest(i, k):
    return [(j, d) for d, j in sorted((d, j) for j, d in enumerate(DIST[i]) if d > 0)[:k]]


@pytest.fixture(params=["broadcast", "chunks"])
def side(request, monkeypatch):
    if request.param == "chunks":
        monkeypatch.setattr(metric_join, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(metric_join, "CHUNK", 16)


def test_approximate_neighbours_keep_their_factor(spark, side):
    for epsilon in (1.0, 2.0):
        found = pruned_join.knn(frame(spark), k=2, epsilon=epsilon).collect()
        assert len(found) == 2 * len(CLOUD)
        for r in found:
            want = nearest(r["q"], 2)[r["rank"] - 1]
            assert want[1] - 1e-12 <= r["dist"] <= want[1] * epsilon + 1e-12
            assert epsilon > 1 or r["r"] == want[0]
    few = sum(r["computed"] for r in found if r["rank"] == 1)
    assert few < len(CLOUD) ** 2


def test_counts_by_inclusion(spark, side):
    radii = [0.0, 0.05, 1.0, 1.5, 50.0]
    rows = pruned_join.range_counts(frame(spark), radii=radii).collect()
    assert {(r["q"], r["radius"]): r["n"] for r in rows} == {(i, x): int((DIST[i] < x).sum()) for i in range(len(CLOUD)) for x in radii}
    pairs = pruned_join.pair_counts(frame(spark), [0.05, 50.0]).collect()
    assert {r["radius"]: r["n"] for r in pairs} == {x: int((DIST < x).sum()) for x in (0.05, 50.0)}
    assert all(r["computed"] < len(CLOUD) ** 2 for r in pairs)
    closed = pruned_join.range_counts(frame(spark), radii=[float(DIST[0][1])], closed=True).filter("q = 0").first()["n"]
    assert closed == int((DIST[0] <= DIST[0][1]).sum())
    assert pruned_join.pair_counts(frame(spark).limit(0), [1.0]).count() == 0


def test_densities_stay_within_their_error(spark, side):
    kernels = {"gaussian": lambda d: np.exp(-d * d / 2), "epanechnikov": lambda d: np.where(d < 1, 0.75 * (1 - d * d), 0), "uniform": lambda d: np.where(d < 1, 0.5, 0)}
    for kernel, f in kernels.items():
        want = f(DIST).sum(axis=1)
        for error in (0.0, 8.0):
            rows = pruned_join.density(frame(spark), bandwidth=1.0, kernel=kernel, error=error).collect()
            assert len(rows) == len(CLOUD)
            assert all(abs(r["density"] - want[r["q"]]) <= error + 1e-9 for r in rows)
    assert sum(r["computed"] for r in rows) < len(CLOUD) ** 2


def test_distances_broken_off_give_the_same_neighbours(spark, side, request):
    points = np.round(RNG.normal(size=(80, 24)) * np.linspace(3, 0.1, 24), 3)
    df = frame(spark, points).filter("size(embedding) = 24")
    rows = pruned_join.bounded_knn(df, k=3, step=4).collect()
    got = sorted((r["q"], r["rank"], r["r"]) for r in rows)
    assert got == sorted((r["q"], r["rank"], r["r"]) for r in metric_join.knn(df, k=3).collect())
    read = sum(r["components"] for r in rows if r["rank"] == 1)
    assert read < 80 * 80 * 24 or "chunks" in request.node.name  # blocks of 16 rows are mostly sample


def subtree(nodes, members, node, level):
    out = {r["id"] for r in members if (r["node"], r["level"]) == (node, level)}
    for r in nodes:
        if (r["parent"], r["parent_level"]) == (node, level):
            out |= subtree(nodes, members, r["node"], r["level"])
    return out


@pytest.fixture(scope="module")
def tree(spark):
    return cover_tree.build(frame(spark), ratio=3.0, leaf=6)


def test_tree_invariants_by_hand(spark, tree):
    nodes, members = tree.nodes.collect(), tree.members.collect()
    assert sorted(r["id"] for r in members) == list(range(len(CLOUD)))
    assert len({r["level"] for r in nodes}) > 2
    for r in nodes:
        below = subtree(nodes, members, r["node"], r["level"]) - {r["node"]}
        assert all(DIST[r["node"]][i] <= 3.0 ** r["level"] for i in below)
        kids = [c for c in nodes if (c["parent"], c["parent_level"]) == (r["node"], r["level"])]
        assert len({c["level"] for c in kids}) <= 1
        assert all(DIST[a["node"]][b["node"]] > 3.0 ** a["level"] for a in kids for b in kids if a["node"] < b["node"])
        for c in kids:  # every point is below the nearest of the siblings
            for i in subtree(nodes, members, c["node"], c["level"]):
                assert DIST[c["node"]][i] <= min(DIST[s["node"]][i] for s in kids) + 1e-12
    assert sum(r["weight"] for r in nodes) == len({r["node"] for r in nodes})
    row = cover_tree.invariants(tree).first()
    assert all(row)


def test_tree_figures(spark, tree):
    nodes, members = tree.nodes.collect(), tree.members.collect()
    got = {(r["node"], r["level"]): set() for r in nodes}
    for r in cover_tree.descendants(tree).collect():
        got[r["node"], r["level"]].add(r["id"])
    assert got == {(r["node"], r["level"]): subtree(nodes, members, r["node"], r["level"]) - {r["node"]} for r in nodes}
    for r in cover_tree.radii(tree).collect():
        below = got[r["node"], r["level"]]
        assert r["n"] == len(below) and r["radius"] == pytest.approx(max((DIST[r["node"]][i] for i in below), default=0.0))
    s = cover_tree.statistics(tree).first()
    assert s["nodes"] == len(nodes) and s["points_in_nodes"] + s["leaves"] == len(CLOUD) and s["ghosts"] == sum(r["weight"] == 0 for r in nodes)
    parents = {(r["parent"], r["parent_level"]) for r in nodes if r["parent"] is not None}
    assert s["childless"] == len(nodes) - len(parents)
    depth_first, breadth_first = ([(r["node"], r["level"], r["depth"]) for r in cover_tree.traversal(tree, b).orderBy("place").collect()] for b in (False, True))
    assert sorted(depth_first) == sorted(breadth_first) and len(depth_first) == len(nodes)
    assert [d for *_, d in breadth_first] == sorted(d for *_, d in depth_first)
    up = {(r["node"], r["level"]): (r["parent"], r["parent_level"]) for r in nodes}
    assert all(depth_first.index((*up[n, lv], d - 1)) < at for at, (n, lv, d) in enumerate(depth_first) if d > 1)


def test_tree_finds_neighbours_whole_collapsed_and_approximately(spark, tree):
    df = frame(spark)
    want = sorted((r["q"], r["rank"], r["r"]) for r in metric_join.knn(df, k=2).collect())
    assert sorted((r["q"], r["rank"], r["r"]) for r in cover_tree.knn(tree, df, 2).collect()) == want
    small = cover_tree.collapsed(tree, 4)
    assert small.nodes.count() < tree.nodes.count() and sorted(r["id"] for r in small.members.collect()) == list(range(len(CLOUD)))
    assert sorted((r["q"], r["rank"], r["r"]) for r in cover_tree.knn(small, df, 2).collect()) == want
    for r in cover_tree.knn(small, df, 1, epsilon=2.0).collect():
        assert r["dist"] <= 2 * nearest(r["q"], 1)[0][1] + 1e-12


def test_tree_rules_adoption_and_empty(spark):
    df = frame(spark, CLOUD[:40])
    first = cover_tree.build(df, ratio=3.0, leaf=6, rule="first")
    row = cover_tree.invariants(first).first()
    assert row["covering"] and row["tight"] and row["separating"] and row["levelled"]
    moved, moves = cover_tree.adopted(first)
    before, after = (t.nodes.agg(F.sum("dist")).first()[0] for t in (first, moved))
    assert (moves > 0) == (after < before) and cover_tree.invariants(moved).first()["covering"]
    empty = cover_tree.build(df.limit(0))
    assert empty.nodes.count() == 0 and empty.members.count() == 0


def test_grids_meet_every_pair_once(spark):
    left = spark.createDataFrame([(k % 3 if k < 30 else 0, k) for k in range(90)], "g int, a long")
    right = spark.createDataFrame([(k % 2, k) for k in range(50)], "g int, b long")

    def work(a, b):
        import pandas as pd

        return pd.DataFrame([(x, y) for x in a["a"] for y in b["b"]], columns=["a", "b"]) if len(a) and len(b) else pd.DataFrame({"a": [], "b": []})

    got = sorted(map(tuple, grids.grid_join(left, right, ["g"], "a", "b", work, "a long, b long", chunk=7).collect()))
    assert got == sorted((x["a"], y["b"]) for x in left.collect() for y in right.collect() if x["g"] == y["g"])


def test_centred_moments_far_from_zero(spark):
    df = spark.createDataFrame([(k % 2, 1e9 + k % 2 if k % 5 else None, float(k % 3)) for k in range(1000)] + [(None, 5.0, 1.0), (7, None, 1.0)], "g int, x double, w double")
    whole = df.filter("g IN (0, 1)")
    s = moments.centred(whole, "x").select("n", "mean", moments.variance()).first()
    assert s[0] == 800 and s[1] == pytest.approx(1e9 + 0.5, abs=1e-6) and s[2] == pytest.approx(0.25, abs=1e-6)
    a, b = (moments.centred(whole.filter(f"x IS NULL OR x % 4 {op} 0"), "x", ["g"]) for op in ("=", "<>"))
    merged = {r["g"]: r for r in moments.merge_centred(a, b, keys=["g"]).collect()}
    for r in moments.centred(whole, "x", ["g"]).collect():
        assert merged[r["g"]]["n"] == r["n"] and merged[r["g"]]["s2"] == pytest.approx(r["s2"], abs=1e-6)
    left = {r["g"]: r for r in moments.subtract_centred(moments.merge_centred(a, b, keys=["g"]), b, ["g"]).collect()}
    for r in a.collect():
        assert left[r["g"]]["n"] == r["n"] and (r["n"] == 0 or left[r["g"]]["mean"] == pytest.approx(r["mean"]))
    weighted = moments.centred(whole, "x", weight="w").select(moments.variance()).first()[0]
    x = np.array([(r["x"] - 1e9, r["w"]) for r in whole.collect() if r["x"] is not None])
    assert weighted == pytest.approx(np.average((x[:, 0] - np.average(x[:, 0], weights=x[:, 1])) ** 2, weights=x[:, 1]), abs=1e-6)
    groups = {r["g"]: r["n"] for r in moments.centred(df, "x", ["g"]).collect()}
    assert groups[None] == 1 and groups[7] == 0
    cov = {(r["i"], r["j"]): r["cov"] for r in moments.covariance(whole.dropna(), ["x", "w"]).collect()}
    assert cov["x", "x"] == pytest.approx(0.25, abs=1e-6) and cov["x", "w"] == cov["w", "x"]


def test_own_aggregates_merge_and_subtract(spark):
    rows = [(["a", "b", None][k % 3], float(x)) for k, x in enumerate(RNG.normal(5, 2, 300))] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    agg = mergeable.centred_moments("x")
    got = {r["k"]: r["state"] for r in mergeable.states(df, agg, ["k"]).collect()}
    for key in ("a", "b", None):
        x = np.array([v for k, v in rows if k == key and v is not None])
        assert got[key] == pytest.approx([len(x), x.mean(), ((x - x.mean()) ** 2).sum()])
    top = mergeable.states(df, mergeable.largest("x", 4), []).first()["state"]
    assert top == sorted((v for _, v in rows if v is not None), reverse=True)[:4]
    part = mergeable.states(df.filter("x > 5"), agg, ["k"])
    left = {r["k"]: r["state"] for r in mergeable.subtracted(agg, ["k"], mergeable.states(df, agg, ["k"]), part).collect()}
    for r in mergeable.states(df.filter("x <= 5 OR x IS NULL"), agg, ["k"]).collect():
        assert left[r["k"]] == pytest.approx(r["state"], abs=1e-8)
    with pytest.raises(ValueError):
        mergeable.subtracted(mergeable.largest("x", 4), [], part, part)
    assert mergeable.states(df.limit(0), agg, ["k"]).count() == 0
    doubled = mergeable.finished(mergeable.states(df, agg, ["k"]), lambda s: s[:1] * 2)
    assert {r["k"]: r["result"][0] for r in doubled.collect()} == {k: 2 * v[0] for k, v in got.items()}


@pytest.mark.parametrize("chunk", [2048, 4])
def test_every_row_is_judged_by_all_others(spark, chunk, monkeypatch):
    monkeypatch.setattr(validation, "CHUNK", chunk)
    values = np.round(RNG.normal(size=37), 3)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "id long, x double").repartition(3)

    def worst(state, rows):
        return state[0] - rows["x"].to_numpy()

    # a top-1 has no inverse: only merges of the others give it
    found = {r["id"]: r["loss"] for r in validation.cross_validate(df, "id", validation.LeaveOneOut(), mergeable.largest("x", 1), worst).collect()}
    assert found == pytest.approx({k: float(np.delete(values, k).max() - v) for k, v in enumerate(values)})
    folds = validation.cross_validate(df, "id", validation.KFold(5, 3), mergeable.centred_moments("x"), validation.squared_error_of_mean("x")).collect()
    assert len(folds) == 35
    for r in folds:
        own = {s["id"] for s in folds if s["fold"] == r["fold"]}
        mean = np.mean([v for k, v in enumerate(values) if k not in own])
        assert r["loss"] == pytest.approx((values[r["id"]] - mean) ** 2)
    alone = validation.cross_validate(df.filter("id = 3"), "id", validation.LeaveOneOut(), mergeable.largest("x", 1), worst).collect()
    assert [r["loss"] for r in alone] == [None]


def test_group_folds_and_normal_equations(spark):
    rows = [(k, "abc"[k % 3] if k else None, float(k), 2.0 * k + (k % 3)) for k in range(30)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double")

    def loss(state, part):
        w = mergeable.least_squares(state)
        return part["y"].to_numpy() - w[0] - w[1] * part["x"].to_numpy()

    found = {r["id"]: r["loss"] for r in validation.cross_validate(df, "id", validation.Groups("g"), mergeable.normal_equations(["x"], "y"), loss).collect()}
    assert set(found) == set(range(1, 30))
    for k, g, x, y in rows[1:]:
        train = np.array([(1, a, b) for _, h, a, b in rows if h != g])
        w = np.linalg.lstsq(train[:, :2], train[:, 2], rcond=None)[0]
        assert found[k] == pytest.approx(y - w[0] - w[1] * x)


def test_own_losses_and_component_rates(spark):
    x = np.column_stack([np.ones(150), RNG.normal(size=150) * 20])
    y = ["b" if 0.05 * v[1] + RNG.normal() > 0.4 else "a" for v in x]
    df = spark.createDataFrame([(v.tolist(), c) for v, c in zip(x, y, strict=True)], "x array<double>, y string")
    sign = np.where(np.array(y) == "b", 1.0, -1.0)
    w = np.array(next(r["weights"] for r in glm.train(df, "x", "y", ridge=0.01, loss=objective.huber(0.7), optimiser="newton", tolerance=1e-14).collect() if r["label"] == "b"))
    slope = objective.huber(0.7)(x @ w, sign)[1]
    assert np.abs(slope @ x + 0.01 * w).max() < 1e-3
    own = glm.validate(df, glm.train(df, "x", "y"), "x", "y", {"cubic": lambda m, s: F.abs(m - s) * (m - s) * (m - s)}).first()
    assert own["n"] == 150 and own["cubic"] >= 0
    goal = objective.RowObjective(df.select("x", "y"), 2, ["b"], objective.squared)
    best = np.linalg.lstsq(x, sign, rcond=None)[0]
    got = objective.stochastic_gradient(goal, lambda t: (F.lit(True), 1.0), 90, objective.ComponentRates(1e-5, memory=0.5))[0]
    assert got == pytest.approx(best, abs=2e-3)
    numbered = df.withColumn("id", F.monotonically_increasing_id())
    sampled = objective.RowObjective(numbered, 2, ["b"], objective.squared)
    for sample in (objective.slices("id", 3), objective.draws("id", 0.5, 1)):
        w = objective.stochastic_gradient(sampled, sample, 4, lambda t: 1e-5)
        assert sampled.value_and_gradient(w)[0][0] < sampled.value_and_gradient(0 * w)[0][0]


def test_blocks_of_distances_stay_small(monkeypatch):
    """Whatever the number of references: tiles of TALL queries and WIDE references, results as by brute force."""
    shapes = []

    def seen(a, b, real=metric_join._rough):
        shapes.append((len(a), len(b)))
        return real(a, b)

    monkeypatch.setattr(metric_join, "_rough", seen)
    monkeypatch.setattr(pruned_join, "_rough", seen)
    refs = np.round(np.random.default_rng(5).normal(size=(9000, 12)), 2)
    refs[100:140] = refs[:1]  # more copies than a pool holds
    ids, q = np.arange(len(refs)) * 3, refs[:300]
    d = np.sqrt(((q[:, None, :] - refs[None, :, :]) ** 2).sum(axis=2))
    want = [[(float(d[i, j]), int(ids[j])) for j in np.lexsort((ids, d[i])) if d[i, j] > 0][:4] for i in range(len(q))]
    for row, r, dist in (metric_join.block_knn(q, refs, ids, 4, True, None), pruned_join.aborting_knn(q, refs, ids, 4, True, np.arange(12), 4)[:3]):
        got = [[] for _ in q]
        for i, j, x in zip(row.tolist(), r.tolist(), dist.tolist(), strict=True):
            got[i].append((x, j))
        assert got == want
    pairs = sorted((int(a), int(b)) for i, j, _ in metric_join.block_range(q, refs, 2.0, True, None) for a, b in zip(i, j, strict=True))
    assert pairs == sorted((int(a), int(b)) for a, b in zip(*np.nonzero(d <= 2.0), strict=True))
    assert shapes and max(a for a, _ in shapes) <= 512 and max(b for _, b in shapes) <= 4096


def test_rows_left_out_one_by_one_are_not_grouped(spark, monkeypatch):
    rows = [(k, float(k % 7), None if k == 5 else 2.0 * (k % 7) + k % 3) for k in range(30)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    slow = [validation.Aggregate(a.columns, a.map, a.merge, a.inverse) for a in (mergeable.centred_moments("y"), mergeable.normal_equations(["x"], "y"))]
    loss = validation.squared_error_of_mean("y")
    want = {r["id"]: r["loss"] for r in validation.cross_validate(df, "id", validation.LeaveOneOut(), slow[0], loss).collect()}
    for aggregate, old in zip((mergeable.centred_moments("y"), mergeable.normal_equations(["x"], "y")), slow, strict=True):
        pdf = df.toPandas()
        for k, state in enumerate(aggregate.each(pdf)):
            assert np.allclose(state, old.map(pdf.iloc[k : k + 1]))

    def refuse(*args):
        raise AssertionError("grouped")

    monkeypatch.setattr(validation, "states", refuse)
    got = {r["id"]: r["loss"] for r in validation.cross_validate(df, "id", validation.LeaveOneOut(), mergeable.centred_moments("y"), loss).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_small_balls_end_in_one_task_as_they_would_level_by_level(spark, monkeypatch):
    df = frame(spark)
    want = sorted((r["q"], r["rank"], r["r"]) for r in metric_join.knn(df, k=2).collect())
    trees = []
    for points in (8, 1000):
        monkeypatch.setattr(cover_tree, "_small", lambda dim, points=points: points)
        splits = []
        whole = cover_tree._split
        with monkeypatch.context() as m:
            m.setattr(cover_tree, "_split", lambda *a: splits.append(1) or whole(*a))
            built = cover_tree.build(df, ratio=3.0, leaf=2)
        trees.append((sorted(map(str, built.nodes.collect())), sorted((r["id"], r["node"], r["level"], r["dist"]) for r in built.members.collect())))
        assert sorted((r["q"], r["rank"], r["r"]) for r in cover_tree.knn(built, df, 2).collect()) == want
    assert trees[0] == trees[1] and not splits


def test_blocks_meet_when_their_partitions_are_many(spark):
    """The grid numbers of both sides have one type, so equal ones have one hash."""
    rows = spark.range(60).selectExpr("id", "id AS other", "0 AS g")

    def pairs(a, b):
        return a[["id"]].merge(b[["other"]], how="cross")

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        met = grids.grid_join(rows.select("id", "g"), rows.select("other", "g"), ["g"], "id", "other", pairs, "id long, other long", chunk=16)
        assert met.distinct().count() == 3600
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


class Tasks:
    """In place of a DataFrame: gives the function that tasks would run."""

    def mapInPandas(self, f, schema):
        return f


def test_queries_that_go_to_every_bucket_do_so_in_frames_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(metric_join, "CHUNK", 4)
    monkeypatch.setattr(metric_join, "ROUTED", 32, raising=False)
    refs = metric_join._prepared(frame(spark), "vec_id", "embedding")
    b = metric_join._Blocks(refs, refs, None)
    b.pivoted()
    buckets = int((b.chunks > 0).sum())
    asked = pd.DataFrame({"q": range(len(CLOUD)), "v": list(CLOUD), "bound": np.inf})
    routed = list(b.route(Tasks(), own=False)(iter([asked])))
    assert buckets > 10 and max(map(len, routed)) <= 32
    whole = pd.concat(routed)
    assert len(whole) == len(whole[["q", "bucket"]].drop_duplicates()) == buckets * len(CLOUD)
    assert all((CLOUD[q] == v).all() for q, v in zip(whole["q"], whole["v"], strict=True))


def test_references_travel_once_to_queries_of_their_own_bucket(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(metric_join, "CHUNK", 16)
    taken, dealt = [], metric_join._Blocks._dealt

    def counted(self, *args):
        left, held = dealt(self, *args)
        taken.append((left.select("q").distinct().count(), held.count()))
        return left, held

    monkeypatch.setattr(metric_join._Blocks, "_dealt", counted)
    assert metric_join.knn(frame(spark), k=2).count() == 2 * len(CLOUD)
    assert taken[0][0] == len(CLOUD) and taken[0][1] <= 3 * len(CLOUD)


def test_approximate_neighbours_hold_distances_to_pivots_of_few_queries_at_once(spark, monkeypatch):
    tall, distances = [], pruned_join.block_distances
    near = None
    with monkeypatch.context() as m:
        m.setattr(pruned_join, "_spread", lambda q, n: Tasks())
        near = pruned_join.knn(frame(spark), k=2)
    monkeypatch.setattr(pruned_join, "block_distances", lambda a, *rest: tall.append(len(a)) or distances(a, *rest))
    asked = pd.DataFrame({"id": range(5000), "v": [CLOUD[i % len(CLOUD)] for i in range(5000)]})
    found = pd.concat(near(iter([asked])))
    assert len(found) == 2 * 5000 and max(tall) <= metric_join.WIDE
    assert all(r in [j for j, _ in nearest(q % len(CLOUD), 2)] for q, r in zip(found["q"], found["r"], strict=True))


def test_blocks_of_a_range_search_meet_without_a_shuffle(spark, monkeypatch):
    """Each point is packed once; the pairs of blocks are read from files, so what is moved does not grow with their number."""
    monkeypatch.setattr(metric_join, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(metric_join, "CHUNK", 8)
    odd = np.concatenate([CLOUD, [[np.nan, 0.0]]])  # what is no number takes no other point's pairs away
    found = metric_join.within(frame(spark, odd), None, 1.0, closed=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    assert sorted((r["q"], r["r"]) for r in found.collect()) == sorted(map(tuple, np.argwhere(DIST <= 1.0).tolist()))
    monkeypatch.setattr(metric_join, "BROADCAST_BYTES", 64 << 20)
    assert sorted((r["q"], r["r"]) for r in metric_join.within(frame(spark, odd), None, 1.0, closed=True).collect()) == sorted(map(tuple, np.argwhere(DIST <= 1.0).tolist()))


def test_pairs_screened_in_single_precision_are_all_there():
    rng = np.random.default_rng(8)
    for shift, size in ((0.0, 1.0), (300.0, 1.0), (0.0, 1e-9), (0.0, 1e22)):
        v = (rng.normal(size=(500, 6)) + shift) * size
        v[3], v[4] = v[5], v[5] + size * 1e-6
        d = np.sqrt(((v[:, None, :] - v[None, :, :]) ** 2).sum(axis=2))
        for radius in (0.0, float(d[7, 9]), 1.5 * size, np.inf):
            found = [(i, j, x) for i, j, x in metric_join.block_range(v, v, radius, True, None)]
            assert sorted((int(a), int(b)) for i, j, _ in found for a, b in zip(i, j, strict=True)) == sorted(map(tuple, np.argwhere(d <= radius).tolist()))


def test_bounds_go_on_from_block_to_block(monkeypatch):
    """Bounds that are known spare the sample, and what was found in one block breaks off the next one's distances."""
    points = np.random.default_rng(6).normal(size=(3000, 32))
    ids, order = np.arange(3000), np.arange(32)
    q = points[:64]
    row, r, d = metric_join.block_knn(q, points, ids, 2, True, None)
    search = pruned_join._Aborting(q, 2, True, order, 4, d[1::2])
    search.meet(points[:1000], ids[:1000])
    first = search.work.copy()
    search.meet(points[1000:], ids[1000:])
    assert all(np.array_equal(a, b) for a, b in zip(search.found(), (row, r, d), strict=True))
    assert first.max() < 1000 * 32 and search.work.max() < 3000 * 32


def test_a_tree_is_searched_again_without_a_shuffle_of_vectors(spark, tree, monkeypatch):
    """Queries are packed once and meet the points of many balls; they are not sent to each of them."""
    monkeypatch.setattr(cover_tree, "_small", lambda dim: 8)
    sent, joined = [], grids.grid_join

    def seen(left, *rest, **more):
        sent.append(left.count())
        return joined(left, *rest, **more)

    monkeypatch.setattr(grids, "grid_join", seen)
    found = cover_tree.knn(tree, frame(spark), 2)
    assert sum(sent) < 10 * len(CLOUD) and "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["q"], r["rank"], r["r"]) for r in found.collect()) == sorted((r["q"], r["rank"], r["r"]) for r in metric_join.knn(frame(spark), k=2).collect())


def test_a_sample_is_not_read_twice():
    points = np.random.default_rng(9).normal(size=(5000, 64))
    points /= np.linalg.norm(points, axis=1)[:, None]
    row, r, d, work = pruned_join.aborting_knn(points[:256], points, np.arange(5000), 2, True, np.arange(64), 8)
    assert all(np.array_equal(a, b) for a, b in zip((row, r, d), metric_join.block_knn(points[:256], points, np.arange(5000), 2, True, None), strict=True))
    assert work.mean() < 62 * 5000

"""A tree of nested balls as tables, built from the top, a level at a time.

A node is a point at a level; its ball has the radius ratio ** level and holds all points below it. Where a ball
holds more than ``leaf`` other points it is split at the next level at which its points do not fit one smaller ball:
points farther apart than that level's radius become its children, together with the node itself at that
level, and every point of the ball goes to one of them by a rule. So siblings are on one level, farther apart
than its radius, and within the radius of their parent. What is left in a ball is its leaf array.

All balls of a level are split by the same jobs: the nodes of a ball are chosen among its first BATCH uncovered points by
hash order, in rounds until all are covered, and meet its points in blocks of bounded size (``grids.grid_join``).
A ball that has become small (``_small``) is finished by one task: its whole subtree, by the same rules.
Nothing but the root's vector and counts reach the driver.

``nodes``: (node, level, parent, parent_level, dist, weight); dist is that to the parent. A node that is its own parent's
point one level below has weight 0, all others 1; so weights count points. ``members``: (id, v, node, level,
dist), every point with the node whose leaf array has it, nodes' own points with distance 0 among them.

Defined results: null ids and vectors take no part; repeated points are in the leaf array of one of them, however many
there are; an empty table gives empty tables; order and partitions of the input do not matter, ties go by hash
of the id.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions import vectors as V
from orrery.operators import grids
from orrery.operators.metric_join import Metric, _exact, _matrix, _prepared, _top, block_knn

#: Uncovered points of a ball among which new nodes are chosen in a round.
BATCH = 4096
#: Points of a ball whose subtree one task builds or reads, and numbers in their vectors.
LOCAL, LOCAL_ITEMS = 16384, 1 << 18

#: rule(distances, turns, reach) -> keys: a point goes to the node of the smallest key; a key is infinite where it may not.
Rule = Callable[[np.ndarray, np.ndarray, float], np.ndarray]


def nearest(d: np.ndarray, turns: np.ndarray, reach: float) -> np.ndarray:
    """The nearest sibling, at every level: no ancestor's sibling is nearer than the ancestor."""
    return np.where(d <= reach, d, np.inf)


def first(d: np.ndarray, turns: np.ndarray, reach: float) -> np.ndarray:
    """The first node that covers the point, the ball's own point before all others."""
    return np.where(d <= reach, np.broadcast_to(turns, d.shape), np.inf)


RULES: dict[str, Rule] = {"nearest": nearest, "first": first}
_NODES = "node long, level int, parent long, parent_level int, dist double, weight int"
_PACKED = ["n", "centre", "far", "most", "ids", "child", "bounds", "v"]
_PART = ["id", "v", "node", "level", "parent", "parent_level", "dist", "weight"]


@dataclass
class Tree:
    nodes: DataFrame
    members: DataFrame
    ratio: float
    metric: Metric | None = None


def _distances(a: np.ndarray, b: np.ndarray, metric: Metric | None) -> np.ndarray:
    if metric:
        return metric(a, b)
    return np.stack([_exact(row[None, :], b) for row in a]) if len(a) else np.zeros((0, len(b)))


def level_below(far: float, ratio: float) -> int:
    """The highest level whose radius is smaller than ``far``."""
    level = math.ceil(math.log(far) / math.log(ratio)) + 1
    while ratio**level >= far:
        level -= 1
    return level


def _chosen(reach: float, metric: Metric | None):
    """The points of a batch, in order, that none before them covers."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["turn", "id"], kind="stable")
        v, picked = _matrix(pdf["v"]), []
        least = np.full(len(v), np.inf)
        for k in range(len(v)):
            if least[k] > reach:
                picked.append(k)
                least = np.minimum(least, _distances(v[k : k + 1], v, metric)[0])
        return pdf.iloc[picked]

    return f


def _split(rows: DataFrame, level: int, ratio: float, rule: Rule, metric: Metric | None) -> tuple[DataFrame, DataFrame]:
    """(born, placed) of balls that are split at a level: the new nodes, and all points with their new nodes."""
    reach = ratio**level
    order = Window.partitionBy("node", "level").orderBy("turn", "id")
    own = F.when(F.col("dist") <= reach, F.col("dist"))
    # the ball's own point comes before all others; best: (key, turn, node, dist) of what the rule prefers so far

    @F.pandas_udf("double")
    def own_key(dist: pd.Series) -> pd.Series:
        return pd.Series(rule(dist.to_numpy(float)[:, None], np.array([-1e300]), reach)[:, 0])

    key = own_key("dist")
    rows = grids.cut(rows.withColumns({"turn": F.xxhash64("id"), "covered": own.isNotNull(), "best": F.struct(key.alias("key"), F.lit(-(2**63)).cast("long").alias("turn"), F.col("node").alias("to"), F.col("dist").alias("d"))}))
    born: list[DataFrame] = []

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "key": [], "turn": [], "to": [], "d": [], "near": []})
        right = right.sort_values(["turn", "id"], kind="stable")
        a, b, turns = _matrix(left["v"]), _matrix(right["v"]), right["turn"].to_numpy(np.int64)
        out = []
        for lo in range(0, len(a), 512):
            d = _distances(a[lo : lo + 512], b, metric)
            keys = rule(d, turns.astype(float), reach)
            at = keys.argmin(axis=1)
            k = np.arange(len(d))
            out.append(pd.DataFrame({"id": left["id"].to_numpy()[lo : lo + 512], "key": keys[k, at], "turn": turns[at], "to": right["id"].to_numpy()[at], "d": d[k, at], "near": d.min(axis=1)}))
        return pd.concat(out)

    while True:
        batch = rows.filter("NOT covered").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= BATCH).drop("place", "best", "covered")
        picked = grids.cut(batch.groupBy("node", "level").applyInPandas(_chosen(reach, metric), batch.schema))
        if picked.isEmpty():
            break
        born.append(picked)
        met = grids.grid_join(rows.select("id", "v", "node", "level"), picked.select("id", "v", "node", "level", "turn"), ["node", "level"], "id", "id", meet, "id long, key double, turn long, to long, d double, near double")
        found = met.groupBy("id").agg(F.min(F.struct("key", "turn", "to", "d")).alias("new"), F.min("near").alias("near"))
        joined = rows.join(found, "id", "left")
        rows = grids.cut(joined.withColumns({"best": F.least(F.col("best"), F.col("new")), "covered": F.col("covered") | (F.coalesce(F.col("near"), F.lit(float("inf"))) <= reach)}).drop("new", "near"))
    nodes = born[0]
    for more in born[1:]:
        nodes = nodes.unionByName(more)
    placed = rows.select("id", "v", F.col("best.to").alias("node"), F.lit(level).alias("level"), F.col("best.d").alias("dist"))
    return nodes, placed


def _small(dim: int) -> int:
    """The points of a ball that one task finishes."""
    return max(2, min(LOCAL, LOCAL_ITEMS // max(1, dim)))


def _subtree(ratio: float, leaf: int, rule: Rule, metric: Metric | None):
    """A small ball -> its nodes (weight 0 or 1) and members (weight null), split as by ``_split``."""

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["turn", "id"], kind="stable")
        ids, turns, v = pdf["id"].to_numpy(np.int64), pdf["turn"].to_numpy(np.int64), _matrix(pdf["v"])
        nodes, ends = [], []
        balls = [(int(pdf["node"].iloc[0]), int(pdf["level"].iloc[0]), np.arange(len(ids)), pdf["dist"].to_numpy(float))]
        while balls:
            node, level, at, dist = balls.pop()
            far = dist.max()
            if len(at) - 1 <= leaf or far <= 0:
                ends.append((node, level, at, dist))
                continue
            below = level_below(far, ratio)
            reach, own = ratio**below, v[at]
            least, picked = np.where(dist <= reach, dist, np.inf), []
            for k in range(len(at)):
                if least[k] > reach:
                    picked.append(k)
                    least = np.minimum(least, _distances(own[k : k + 1], own, metric)[0])
            key, to, d = rule(dist[:, None], np.array([-1e300]), reach)[:, 0], np.full(len(at), -1), dist.copy()
            order = turns[at][picked].astype(float)
            for lo in range(0, len(at) if picked else 0, 512):
                apart = _distances(own[lo : lo + 512], own[picked], metric)
                keys = rule(apart, order, reach)
                best, rows = keys.argmin(axis=1), np.arange(len(apart))
                new = keys[rows, best] < key[lo : lo + 512]
                to[lo : lo + 512][new], d[lo : lo + 512][new] = best[new], apart[rows, best][new]
            nodes.append((node, below, node, level, 0.0, 0))
            nodes += [(int(ids[at[k]]), below, node, level, float(dist[k]), 1) for k in picked]
            by = np.argsort(to, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(to[by])) + 1):
                k = int(to[part[0]])
                balls.append((node if k < 0 else int(ids[at[picked[k]]]), below, at[part], d[part]))
        sizes, at = [len(end[2]) for end in ends], np.concatenate([end[2] for end in ends])
        held = {c: np.repeat([end[k] for end in ends], sizes) for k, c in enumerate(("node", "level"))}
        out = pd.DataFrame({"id": ids[at], "v": list(v[at]), **held, "dist": np.concatenate([end[3] for end in ends])})
        return pd.concat([pd.DataFrame(nodes, columns=["node", "level", "parent", "parent_level", "dist", "weight"]).assign(v=None), out]).reindex(columns=_PART).astype({c: "Int64" for c in _PART if c not in ("v", "dist")})

    return f


def build(df: DataFrame, ratio: float = 1.3, leaf: int = 0, rule: str | Rule = "nearest", id_col: str = "vec_id", vec_col: str = "embedding", metric: Metric | None = None) -> Tree:
    """The tree of all points; balls with at most ``leaf`` points beside their own are not split."""
    spark, choose = df.sparkSession, RULES[rule] if isinstance(rule, str) else rule
    points = grids.cut(_prepared(df, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v")))
    root = points.orderBy(F.xxhash64("id"), "id").first()
    if root is None:
        return Tree(spark.createDataFrame([], _NODES), points.select("id", "v", F.lit(0).cast("long").alias("node"), F.lit(0).alias("level"), F.lit(0.0).alias("dist")), ratio, metric)
    top = np.array([root["v"]], dtype=float)

    @F.pandas_udf("double")
    def from_root(v: pd.Series) -> pd.Series:
        return pd.Series(_distances(top, _matrix(v), metric)[0])

    members = grids.cut(points.select("id", "v", F.lit(root["id"]).cast("long").alias("node"), F.lit(0).alias("level"), from_root("v").alias("dist")))
    far = members.agg(F.max("dist")).first()[0]
    height = level_below(far, ratio) + 1 if far > 0 else 0
    members = members.withColumn("level", F.lit(height))
    nodes = spark.createDataFrame([(root["id"], height, None, None, 0.0, 1)], _NODES)
    little, done = _small(top.shape[1]), []
    while True:
        groups = grids.cut(members.groupBy("node", "level").agg(F.count("*").alias("n"), F.max("dist").alias("far")))
        wide = groups.filter((F.col("n") - 1 > leaf) & (F.col("far") > 0))
        most, here = wide.agg(F.max("far"), F.count_if(F.col("n") <= little)).first()
        if here:  # what is small is finished where it lies
            finished = wide.filter(F.col("n") <= little).select("node", "level", F.lit(True).alias("ends"))
            marked = grids.cut(grids.by_key(members, finished, ["node", "level"], "left"))
            parts = marked.filter("ends").select("id", "v", "node", "level", "dist", F.xxhash64("id").alias("turn"))
            parts = grids.cut(parts.groupBy("node", "level").applyInPandas(_subtree(ratio, leaf, choose, metric), f"id long, v array<double>, {_NODES}"))
            nodes = grids.cut(nodes.unionByName(parts.filter("weight IS NOT NULL").drop("id", "v")))
            done.append(parts.filter("weight IS NULL").select("id", "v", "node", "level", "dist"))
            members = marked.filter("ends IS NULL").drop("ends")
            wide = wide.filter(F.col("n") > little)
            most = wide.agg(F.max("far")).first()[0]
        if most is None:
            for part in done:
                members = members.unionByName(part)
            return Tree(nodes, grids.cut(members), ratio, metric)
        level = level_below(most, ratio)
        split = wide.filter(F.col("far") > ratio**level).select("node", "level", F.lit(True).alias("open"))
        marked = grids.cut(grids.by_key(members, split, ["node", "level"], "left"))
        born, placed = _split(marked.filter("open").drop("open"), level, ratio, choose, metric)
        copies = split.select("node", F.lit(level).alias("level"), F.col("node").alias("parent"), F.col("level").alias("parent_level"), F.lit(0.0).alias("dist"), F.lit(0).alias("weight"))
        children = born.select(F.col("id").alias("node"), F.lit(level).alias("level"), F.col("node").alias("parent"), F.col("level").alias("parent_level"), "dist", F.lit(1).alias("weight"))
        nodes = grids.cut(nodes.unionByName(copies).unionByName(children))
        members = grids.cut(marked.filter("open IS NULL").drop("open").unionByName(placed))


def descendants(tree: Tree) -> DataFrame:
    """(node, level, id, depth): every point below each node at any depth, the node's own point left out."""
    return _under(tree).filter("id <> node")


def _under(tree: Tree) -> DataFrame:
    """(node, level, id, depth): every point below each node and its own: one join for each level of the tree, from the leaf arrays up."""
    parents = tree.nodes.filter("parent IS NOT NULL").select("node", "level", "parent", "parent_level")
    here = tree.members.select("node", "level", "id")
    out, depth = here.withColumn("depth", F.lit(1)), 1
    while True:
        here = grids.cut(here.join(parents, ["node", "level"]).select(F.col("parent").alias("node"), F.col("parent_level").alias("level"), "id"))
        if here.isEmpty():
            return out
        depth += 1
        out = out.unionByName(here.withColumn("depth", F.lit(depth)))


def _with_vectors(tree: Tree, rows: DataFrame, id_col: str, out: str) -> DataFrame:
    return rows.join(tree.members.select(F.col("id").alias(id_col), F.col("v").alias(out)), id_col)


def _apart(tree: Tree, a: str, b: str) -> Column:
    metric = tree.metric

    @F.pandas_udf("double")
    def apart(x: pd.Series, y: pd.Series) -> pd.Series:
        one, two = _matrix(x), _matrix(y)
        return pd.Series(np.array([metric(p[None, :], q[None, :])[0, 0] for p, q in zip(one, two, strict=True)]) if metric else _exact(one, two))

    return apart(a, b)


def radii(tree: Tree) -> DataFrame:
    """(node, level, n, radius): the points below each node and the largest distance to one of them; 0 of none."""
    below = _with_vectors(tree, _with_vectors(tree, descendants(tree), "id", "v"), "node", "w")
    found = below.withColumn("d", _apart(tree, "v", "w")).groupBy("node", "level").agg(F.count("*").alias("n"), F.max("d").alias("radius"))
    return tree.nodes.select("node", "level").join(found, ["node", "level"], "left").fillna(0, ["n"]).fillna(0.0, ["radius"])


def _siblings(tree: Tree, work, schema: str) -> DataFrame:
    """work over blocks of siblings with their vectors."""
    kids = _with_vectors(tree, tree.nodes.filter("parent IS NOT NULL"), "node", "v").select("node", "v", "parent", "parent_level", "level", "dist")
    return grids.grid_join(kids, kids, ["parent", "parent_level"], "node", "node", work, schema)


def invariants(tree: Tree) -> DataFrame:
    """One row: covering, tight covering, separating, levelled, nearest; and the smallest share by which siblings are apart.

    covering: no child is farther from its parent than the parent's radius; tight: no point below a node is; separating: siblings
    are farther apart than the radius of their level; levelled: siblings are on one level; nearest: every point is in
    the leaf array of the nearest of the siblings.
    """
    ratio, metric = tree.ratio, tree.metric

    def gaps(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        d = _distances(_matrix(a["v"]), _matrix(b["v"]), metric) if len(a) and len(b) else np.zeros((0, 0))
        d = d[d > 0]
        return pd.DataFrame({"level": [int(a["level"].iloc[0])], "gap": [float(d.min())]}) if d.size else pd.DataFrame({"level": [], "gap": []})

    gap = _siblings(tree, gaps, "level int, gap double").agg(F.min(F.col("gap") / F.pow(F.lit(ratio), "level")).alias("gap"))
    reach = F.pow(F.lit(ratio), "parent_level")
    covered = tree.nodes.filter("parent IS NOT NULL").agg(F.coalesce(F.bool_and(F.col("dist") <= reach), F.lit(True)).alias("covering"))
    tight = radii(tree).agg(F.coalesce(F.bool_and(F.col("radius") <= F.pow(F.lit(ratio), "level")), F.lit(True)).alias("tight"))
    levels = tree.nodes.filter("parent IS NOT NULL").groupBy("parent", "parent_level").agg(F.count_distinct("level").alias("k")).agg(F.coalesce(F.max("k") == 1, F.lit(True)).alias("levelled"))
    others = _with_vectors(tree, tree.nodes.filter("parent IS NOT NULL"), "node", "v").select("parent", "parent_level", "node", "v")
    own = tree.members.join(tree.nodes.select("node", "level", "parent", "parent_level"), ["node", "level"]).filter("parent IS NOT NULL").select("id", "v", "dist", "parent", "parent_level")

    def nearer(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"ok": []})
        d = _distances(_matrix(a["v"]), _matrix(b["v"]), metric).min(axis=1)
        return pd.DataFrame({"ok": [bool((a["dist"].to_numpy() <= d).all())]})

    near = grids.grid_join(own, others, ["parent", "parent_level"], "id", "node", nearer, "ok boolean").agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("nearest"))
    row = covered.join(tight, how="cross").join(levels, how="cross").join(near, how="cross").join(gap, how="cross")  # one row each
    return row.select("covering", "tight", (F.coalesce(F.col("gap"), F.lit(float("inf"))) > 1).alias("separating"), "levelled", "nearest")


def statistics(tree: Tree) -> DataFrame:
    """One row: the figures of a report on the tree, each as one aggregate over nodes, their children and their leaf arrays."""
    kids = tree.nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node"), F.col("parent_level").alias("level")).agg(F.count("*").alias("kids"), F.bool_or(F.col("parent") == F.col("node")).alias("selfparent"))
    own = tree.members.filter("id <> node").groupBy("node", "level").agg(F.count("*").alias("held"))
    joined = tree.nodes.join(kids, ["node", "level"], "left").join(own, ["node", "level"], "left").fillna(0, ["kids", "held"])
    inner, ghost = F.col("kids") > 0, F.col("weight") == 0
    figures = joined.agg(
        F.sum("weight").alias("points_in_nodes"), F.count("*").alias("nodes"), F.sum("held").alias("leaves"), F.count_if(ghost).alias("ghosts"), F.count_if(ghost & (F.col("kids") == 1)).alias("ghost_singletons"),
        F.count_if(ghost & ~inner).alias("ghost_leaves"), F.avg(F.when(ghost, F.col("kids"))).alias("mean_ghost_children"), F.avg("held").alias("mean_leaves"), F.max("held").alias("most_leaves"),
        F.avg(F.when(inner, F.col("kids"))).alias("mean_children"), F.max("kids").alias("most_children"), F.count_if(F.col("kids") == 1).alias("singletons"), F.count_if(~inner).alias("childless"),
        F.count_if(F.coalesce(F.col("selfparent"), F.lit(False)) & ghost).alias("ghost_selfparents"),
    )
    childless = joined.filter(~inner).select("node", "level", "parent", "parent_level")
    extra = childless.filter("node = parent").agg(F.count("*").alias("extra_leaves"))
    depth = descendants(tree).agg(F.max("depth")).withColumnRenamed("max(depth)", "below")
    # a path of leaf entries, of which each node on the way is one step
    return figures.join(extra, how="cross").join(depth, how="cross").withColumn("depth", F.coalesce("below", F.lit(1))).drop("below")


def cover_ratios(tree: Tree) -> DataFrame:
    """(most, mean): the ratio of the real radius to the level's, over nodes with points below."""
    share = F.col("radius") / F.pow(F.lit(tree.ratio), "level")
    return radii(tree).filter("n > 0").agg(F.max(share).alias("most"), F.avg(share).alias("mean"))


def traversal(tree: Tree, breadth_first: bool = False) -> DataFrame:
    """(place, node, level, depth): nodes in depth-first or breadth-first order, siblings by id.

    The path of ids from the root orders depth first; its length comes first for breadth first.
    """
    step = tree.nodes.filter("parent IS NULL").select("node", "level", F.array("node").alias("path"))
    found, kids = step, tree.nodes.filter("parent IS NOT NULL").select(F.col("node").alias("child"), F.col("level").alias("below"), "parent", "parent_level")
    while True:
        step = grids.cut(step.join(kids, (F.col("node") == F.col("parent")) & (F.col("level") == F.col("parent_level"))).select(F.col("child").alias("node"), F.col("below").alias("level"), F.array_append("path", F.col("child")).alias("path")))
        if step.isEmpty():
            break
        found = found.unionByName(step)
    keys = [F.size("path"), F.col("path")] if breadth_first else [F.col("path")]
    ordered = found.orderBy(*keys)
    # places without one window over all rows: each sorted partition's offset is a count
    numbered = grids.cut(ordered.withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id()))
    sizes = numbered.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_k").alias("_first"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))  # a row for each partition
    return numbered.join(F.broadcast(base.drop("_n")), "_p").select((F.col("_base") + F.col("_k") - F.col("_first")).alias("place"), "node", "level", F.size("path").alias("depth"))


def collapsed(tree: Tree, n: int) -> Tree:
    """The tree with every subtree of at most ``n`` nodes as the leaf array of its root, and childless nodes in their parent's.

    Points move up to the nearest kept node above them; what they are worth in a search stays.
    """
    below = _below(tree)
    big = tree.nodes.join(below, ["node", "level"]).withColumn("keep", F.col("parent").isNull() | (F.col("nodes") > n))
    parent_big = big.filter(F.col("nodes") > n).select(F.col("node").alias("parent"), F.col("level").alias("parent_level"), F.lit(True).alias("open"))
    # under a node that stays open, nodes with children stay as well: they end in a leaf array of their own
    kept = grids.cut(big.join(parent_big, ["parent", "parent_level"], "left").withColumn("stays", F.col("parent").isNull() | (F.coalesce("open", F.lit(False)) & (F.col("nodes") > 1))))
    goes = kept.filter("NOT stays").select("node", "level", "parent", "parent_level")
    moved = tree.members
    while True:
        moved = grids.cut(moved.join(goes, ["node", "level"], "left").select("id", "v", F.coalesce("parent", "node").alias("to"), F.coalesce("parent_level", "level").alias("to_level"), F.col("parent").isNotNull().alias("up"), "dist"))
        again = not moved.filter("up").isEmpty()
        moved = moved.select("id", "v", F.col("to").alias("node"), F.col("to_level").alias("level"), "dist")
        if not again:
            break
    centre = _with_vectors(tree, moved.select("id", "v", "node", "level"), "node", "w")
    nodes = grids.cut(kept.filter("stays").select("node", "level", "parent", "parent_level", "dist", "weight"))
    # a point whose node went is an entry of a leaf array now; a copy whose original stays keeps its weight of 0
    return Tree(nodes, grids.cut(centre.withColumn("dist", _apart(tree, "v", "w")).drop("w")), tree.ratio, tree.metric)


def _below(tree: Tree) -> DataFrame:
    """(node, level, nodes): the nodes of each subtree, its root among them."""
    parents = tree.nodes.filter("parent IS NOT NULL").select("node", "level", "parent", "parent_level")
    here = tree.nodes.select("node", "level")
    out = here
    while True:
        here = grids.cut(here.join(parents, ["node", "level"]).select(F.col("parent").alias("node"), F.col("parent_level").alias("level")))
        if here.isEmpty():
            return out.groupBy("node", "level").agg(F.count("*").alias("nodes"))
        out = out.unionByName(here)


def adopted(tree: Tree) -> tuple[Tree, int]:
    """(tree, moves): every childless node under the sibling of its parent that is nearest to it and covers it.

    Nodes with children stay, so balls below keep their bounds.
    """
    kids = tree.nodes.filter("parent IS NOT NULL")
    inner = kids.select(F.col("parent").alias("node"), F.col("parent_level").alias("level")).distinct()
    loose = kids.filter("weight = 1").join(inner, ["node", "level"], "left_anti")
    grand = kids.select(F.col("node").alias("parent"), F.col("level").alias("parent_level"), F.col("parent").alias("g"), F.col("parent_level").alias("g_level"))
    asked = _with_vectors(tree, loose.join(grand, ["parent", "parent_level"]).select("node", "level", "dist", "g", "g_level"), "node", "v")
    uncles = _with_vectors(tree, inner.join(kids, ["node", "level"]).select("node", F.col("level").alias("u_level"), F.col("parent").alias("g"), F.col("parent_level").alias("g_level")), "node", "w").withColumnRenamed("node", "uncle")
    ratio, metric = tree.ratio, tree.metric

    def nearer(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"node": [], "level": [], "to": [], "to_level": [], "d": []})
        b = b.sort_values("uncle")
        d = _distances(_matrix(a["v"]), _matrix(b["w"]), metric)
        d = np.where(d <= ratio ** b["u_level"].to_numpy(float)[None, :], d, np.inf)
        at = d.argmin(axis=1)
        best = d[np.arange(len(a)), at]
        ok = best < a["dist"].to_numpy()
        return pd.DataFrame({"node": a["node"], "level": a["level"], "to": b["uncle"].to_numpy()[at], "to_level": b["u_level"].to_numpy()[at], "d": best})[ok]

    met = grids.grid_join(asked, uncles, ["g", "g_level"], "node", "uncle", nearer, "node long, level int, to long, to_level int, d double")
    moves = grids.cut(met.groupBy("node", "level").agg(F.min(F.struct("d", "to", "to_level")).alias("m")))
    changed = tree.nodes.join(moves, ["node", "level"], "left").select("node", "level", F.coalesce("m.to", "parent").alias("parent"), F.coalesce("m.to_level", "parent_level").alias("parent_level"), F.coalesce("m.d", "dist").alias("dist"), "weight")
    return Tree(grids.cut(changed), tree.members, ratio, metric), moves.count()


def knn(tree: Tree, queries: DataFrame, k: int = 1, id_col: str = "vec_id", vec_col: str = "embedding", exclude_zero: bool = True, epsilon: float = 1.0) -> DataFrame:
    """(q, rank, r, dist): the k nearest points of the tree, or ones at most ``epsilon`` times as far.

    Queries go down to the nearest balls, whose nearest children bound their answers. Then those that came to one ball are packed into
    rows, as are the points below each ball of more than ``_small`` points, and each row of queries meets the points of all balls that may
    hold a nearer one: those whose centre is not farther than the largest bound over epsilon and both radii together. Rows meet
    without a shuffle; in them a ball's children that are too far from a query are left out.
    """
    if k < 1 or epsilon < 1:
        raise ValueError("k and epsilon must be at least 1")
    metric = tree.metric
    q = _prepared(queries, id_col, vec_col).withColumnsRenamed({"id": "q", "v": "x"})
    dim = tree.members.agg(F.max(F.size("v"))).first()[0] or 1
    start = tree.nodes.filter("parent IS NULL").select("node", "level")
    kids = tree.nodes.filter("parent IS NOT NULL").select("node", "level", "parent", "parent_level")
    under = grids.cut(_under(tree))
    big = under.groupBy("node", "level").agg(F.count("*").alias("n")).filter(F.col("n") > _small(dim)).select("node", "level")
    big = grids.cut(big.union(start).distinct())
    children = _with_vectors(tree, kids.join(big, ["node", "level"]), "node", "w")
    children = grids.cut(children.select(F.col("node").alias("child"), F.col("level").alias("child_level"), F.col("parent").alias("node"), F.col("parent_level").alias("level"), "w"))
    # every point once: with the lowest big node above it, and that node's child; own leaf arrays of big nodes are dealt by point
    parents = big.select(F.col("node").alias("parent"), F.col("level").alias("parent_level"))
    fringe = kids.join(parents, ["parent", "parent_level"]).join(big, ["node", "level"], "left_anti")
    held = under.join(fringe, ["node", "level"]).select("id", F.col("node").alias("child"), F.col("node").alias("deal"), F.col("parent").alias("node"), F.col("parent_level").alias("level"))
    own = tree.members.join(big, ["node", "level"]).select("id", F.col("node").alias("child"), F.col("id").alias("deal"), "node", "level")
    blocks = grids.cut(_with_vectors(tree, held.unionByName(own), "id", "v").withColumnRenamed("id", "r"))
    schema = "q long, x array<double>, node long, level int, d double"

    def nearest_child(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": [], "x": [], "node": [], "level": [], "d": []})
        b = b.sort_values("child")
        d = _distances(_matrix(a["x"]), _matrix(b["w"]), metric)
        i, j = np.arange(len(a)), d.argmin(axis=1)
        return pd.DataFrame({"q": a["q"].to_numpy(), "x": a["x"].to_numpy(), "node": b["child"].to_numpy()[j], "level": b["child_level"].to_numpy()[j], "d": d[i, j]})

    def descend(asked: DataFrame) -> DataFrame:
        """(q, x, node, level) of all nodes on the way, whose leaf arrays have to be read."""
        here = asked.join(F.broadcast(start), how="cross").select("q", "x", "node", "level")  # one row: the root
        ends = []
        while True:
            here = grids.cut(here)
            ends.append(here)
            if here.isEmpty():
                break
            found = grids.grid_join(here, children, ["node", "level"], "q", "child", nearest_child, schema)
            here = found.groupBy("q").agg(F.min_by(F.struct("x", "node", "level"), F.struct("d", "node")).alias("s")).select("q", "s.*")
        out = ends[0]
        for more in ends[1:]:
            out = out.unionByName(more)
        return out

    def read(q_ids: np.ndarray, x: np.ndarray, bound: np.ndarray | None, ids: np.ndarray, child: np.ndarray, v: np.ndarray) -> pd.DataFrame:
        """(q, r, dist): the k nearest in the children's balls that the bound allows; without one in the nearest balls."""
        starts = np.flatnonzero(np.concatenate([[True], child[1:] != child[:-1]]))
        sizes, ends = np.diff(np.append(starts, len(v))), np.append(starts[1:], len(v))
        out, many = [], bound is not None and 4 * len(starts) > len(v)  # their centres would cost as much as all points
        if not many:
            of, centre = np.repeat(np.arange(len(starts)), sizes), starts.copy()
            centre[of[ids == child]] = np.flatnonzero(ids == child)
            away = np.concatenate([metric(v[c : c + 1], v[lo:hi])[0] for c, lo, hi in zip(centre, starts, ends, strict=True)]) if metric else _exact(v, v[centre[of]])
            wide = np.maximum.reduceat(away, starts)
        for lo in range(0, len(x), 512):
            part = x[lo : lo + 512]
            if many:
                jobs = [(np.arange(len(part)), 0, len(v))]
            else:
                d = _distances(part, v[centre], metric)
                if bound is None:
                    order = np.argsort(d, axis=1, kind="stable")
                    ask = np.zeros(d.shape, bool)
                    np.put_along_axis(ask, order, np.cumsum(sizes[order], axis=1) - sizes[order] <= 2 * k, 1)
                else:
                    ask = d - wide[None, :] <= bound[lo : lo + 512, None] / epsilon * (1 + 1e-12)
                if (ask @ sizes).sum() > 0.1 * len(part) * len(v):  # little is left out: all at once
                    jobs = [(np.arange(len(part)), 0, len(v))]
                else:
                    jobs = [(np.flatnonzero(ask[:, g]), starts[g], ends[g]) for g in np.flatnonzero(ask.any(axis=0))]
            for rows, first, last in jobs:
                row, r, dist = block_knn(part[rows], v[first:last], ids[first:last], k, exclude_zero, metric)
                keep = slice(None) if bound is None else ~(dist > bound[lo + rows[row]])
                out.append((q_ids[lo + rows[row]][keep], r[keep], dist[keep]))
        if not out:
            return pd.DataFrame({"q": [], "r": [], "dist": []})
        near = pd.DataFrame(dict(zip(("q", "r", "dist"), map(np.concatenate, zip(*out, strict=True)), strict=True))).sort_values(["q", "dist", "r"])
        return near[near.groupby("q").cumcount() < k]

    def first_read(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": [], "r": [], "dist": []})
        b = b.sort_values(["child", "r"])
        return read(a["q"].to_numpy(), _matrix(a["x"]), None, b["r"].to_numpy(np.int64), b["child"].to_numpy(np.int64), _matrix(b["v"]))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        """Points (id, child, bound, v) of a chunk in a row, with a ball around them and the largest bound."""
        pdf = pdf.sort_values(["child", "id"])
        v, bounds = _matrix(pdf["v"]), pdf["bound"].to_numpy(float)
        far = _distances(v[:1], v, metric)[0].max()
        return pd.DataFrame([(len(v), v[0], float(far), float(bounds.max()), *(pdf[c].to_numpy(np.int64).tobytes() for c in ("id", "child")), bounds.tobytes(), v.tobytes())], columns=_PACKED)

    def rows_of(points: DataFrame) -> DataFrame:
        sizes = points.groupBy("node", "level").agg(F.ceil(F.count("*") / _small(dim)).cast("int").alias("chunks"))
        chunk = F.pmod(F.xxhash64("deal"), F.col("chunks")).cast("int")
        dealt = grids.by_key(points, grids.cut(sizes), ["node", "level"]).withColumn("chunk", chunk)
        return grids.cut(dealt.groupBy("node", "level", "chunk").applyInPandas(packed, "n int, centre array<double>, far double, most double, ids binary, child binary, bounds binary, v binary"))

    def second_read(frames):
        for pdf in frames:
            for row in pdf.to_dict("records"):
                x, v = (np.frombuffer(row[c]).reshape(row[n], -1) for c, n in (("q_v", "q_n"), ("v", "n")))
                yield read(np.frombuffer(row["q_ids"], np.int64), x, np.frombuffer(row["q_bounds"]), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["child"], np.int64), v)

    way = descend(q)
    first = grids.cut(_top(grids.grid_join(way, blocks, ["node", "level"], "q", "deal", first_read, "q long, r long, dist double"), k))
    bound = first.filter(F.col("rank") == k).select("q", F.col("dist").alias("bound"))
    ends = way.groupBy("q").agg(F.min_by("node", "level").alias("node"), F.min("level").alias("level"))
    bounded = q.join(ends, "q").join(bound, "q", "left").fillna(float("inf"), ["bound"])
    left = rows_of(bounded.select(F.col("q").alias("id"), F.lit(0).cast("long").alias("child"), F.col("q").alias("deal"), "bound", F.col("x").alias("v"), "node", "level"))
    right = rows_of(blocks.select(F.col("r").alias("id"), "child", "deal", F.lit(0.0).alias("bound"), "v", "node", "level"))
    left = left.select(*(F.col(c).alias(f"q_{c}") for c in _PACKED))
    # of numbers only: a metric of one's own is not known to Spark, so its balls all meet
    apart = V.distance("q_centre", "centre") - F.col("q_far") - F.col("far")
    may = F.lit(True) if metric else ~(apart > F.col("q_most") / epsilon * (1 + 1e-9) + 1e-9)
    met = left.join(right.select(*_PACKED).hint("shuffle_replicate_nl"), may)
    second = met.select("q_n", "q_ids", "q_bounds", "q_v", "n", "ids", "child", "v").mapInPandas(second_read, "q long, r long, dist double")
    # what was found on the first way may be left out on the second one
    return _top(first.drop("rank").unionByName(second).groupBy("q", "r").agg(F.min("dist").alias("dist")), k)

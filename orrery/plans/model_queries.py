"""Queries on linear models, graphs, colours, the pivot index, minimisers, loaders and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.trace import Trace
from orrery.operators import colour, glm, graphs, grids, metric_join, objective, pivot_index, search
from orrery.plans.metric_queries import rounded, table, vectors
from orrery.plans.registry import query
from orrery.sources import loaders
from orrery.streaming import running

_CENTROIDS = """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT label, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM e),
m AS (SELECT label, list(x ORDER BY d) AS w FROM (SELECT label, d, avg(x) AS x FROM u GROUP BY 1, 2) GROUP BY label),
s AS (SELECT e.vec_id, e.label, m.label AS class, list_inner_product(e.v, m.w) AS score FROM e, m),
p AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, class) AS k FROM s)
"""


def _model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = vectors(spark, sf_dir)
    return e, glm.centroids(e, "embedding", "label", 64)


@query("glm_classify", _CENTROIDS + "SELECT vec_id, class AS predicted FROM p WHERE k = 1")
def glm_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, model = _model(spark, sf_dir)
    return glm.classify(e, model, "embedding", "vec_id")


@query("glm_accuracy", _CENTROIDS + "SELECT label, count(*) AS n, round(avg((class = label)::INTEGER), 6) AS accuracy FROM p WHERE k = 1 GROUP BY label")
def glm_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, model = _model(spark, sf_dir)
    found = glm.classify(e, model, "embedding", "vec_id", ["label"])
    return found.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("predicted") == F.col("label")).cast("int")), 6).alias("accuracy"))


@query("glm_losses", _CENTROIDS + """
, l AS (SELECT score AS m, CASE WHEN class = label THEN 1 ELSE -1 END AS s FROM p WHERE k = 1)
SELECT count(*) AS n, count(*) FILTER (s < 0) AS errors, round(sum(0.5 * (m - s) * (m - s)), 5) AS squared, round(sum(ln(1 + exp(-s * m))), 5) AS logistic, round(sum(greatest(0, 1 - s * m)), 5) AS hinge FROM l""")
def glm_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, model = _model(spark, sf_dir)
    found = glm.validate(e, model, "embedding", "label")
    return found.withColumns({c: F.round(c, 5) for c in ("squared", "logistic", "hinge")})


@query("glm_train")
def glm_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights at the optimum of a logistic model of return flags by size, price, discount and tax, by Newton steps."""
    items = table(spark, sf_dir, "lineitem").select(
        F.array(F.lit(1.0), F.col("l_quantity") / 50, F.col("l_extendedprice") / 1e5, F.col("l_discount") * 10, F.col("l_tax") * 10).alias("x"), "l_returnflag"
    )
    return glm.train(items, "x", "l_returnflag", optimiser="newton", tolerance=1e-12).select("label", F.posexplode("weights").alias("k", "weight"))


@query("squared_train_exact", """
WITH x AS (SELECT l_quantity / 50 AS a, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS s FROM lineitem)
SELECT 'O' AS label, round((sum(a * a) * sum(s) - sum(a) * sum(a * s)) / (count(*) * sum(a * a) - sum(a) * sum(a)), 4) + 0.0 AS intercept,
       round((count(*) * sum(a * s) - sum(a) * sum(s)) / (count(*) * sum(a * a) - sum(a) * sum(a)), 4) + 0.0 AS slope FROM x""")
def squared_train_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared loss without ridge, where the optimum has a closed form."""
    items = table(spark, sf_dir, "lineitem").select(F.array(F.lit(1.0), F.col("l_quantity") / 50).alias("x"), "l_linestatus")
    model = glm.train(items, "x", "l_linestatus", ridge=0.0, loss="squared", optimiser="newton")
    return model.filter("label = 'O'").select("label", (F.round(F.col("weights")[0], 4) + 0.0).alias("intercept"), (F.round(F.col("weights")[1], 4) + 0.0).alias("slope"))


_PAIR = """
WITH RECURSIVE x AS (SELECT l_quantity / 50 AS a, CASE WHEN {flag} THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM lineitem),
w AS (
  SELECT 0 AS i, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v
  UNION ALL
  SELECT i + 1, u - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), v - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  FROM (
    SELECT i, u, v, sum(slope) + 0.001 * u AS g0, sum(slope * a) + 0.001 * v AS g1, sum(curve) + 0.001 AS h00, sum(curve * a) AS h01, sum(curve * a * a) + 0.001 AS h11
    FROM (SELECT w.*, a, {slope} AS slope, {curve} AS curve FROM w, x WHERE i < 12) GROUP BY i, u, v
  )
)
SELECT '{label}' AS label, round(u, 3) + 0.0 AS intercept, round(v, 3) + 0.0 AS slope FROM w WHERE i = 12
"""


def _pair(model: DataFrame, label: str) -> DataFrame:
    w = F.col("weights")
    return model.filter(F.col("label") == label).select("label", (F.round(w[0], 3) + 0.0).alias("intercept"), (F.round(w[1], 3) + 0.0).alias("slope"))


def _sizes(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.array(F.lit(1.0), F.col("l_quantity") / 50).alias("x"), label)


@query("logistic_train", _PAIR.format(flag="l_linestatus = 'O'", label="O", slope="-s / (1 + exp(s * (u + v * a)))", curve="1 / (1 + exp(s * (u + v * a))) / (1 + exp(-s * (u + v * a)))"))
def logistic_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic model of two weights by quasi-Newton steps; the SQL takes Newton steps."""
    return _pair(glm.train(_sizes(spark, sf_dir, "l_linestatus"), "x", "l_linestatus", optimiser="bfgs", tolerance=1e-14), "O")


@query("huber_train", _PAIR.format(flag="l_returnflag = 'R'", label="R", slope="CASE WHEN abs(u + v * a - s) <= 1 THEN u + v * a - s ELSE sign(u + v * a - s) END", curve="CASE WHEN abs(u + v * a - s) <= 1 THEN 1 ELSE 0 END"))
def huber_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trainer with a loss of one's own: squared near the sign, linear beyond."""
    return _pair(glm.train(_sizes(spark, sf_dir, "l_returnflag"), "x", "l_returnflag", loss=objective.huber(1.0), optimiser="newton", tolerance=1e-14), "R")


@query("component_rates_train", """
WITH x AS (SELECT l_quantity / 50 AS a, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS s FROM lineitem)
SELECT 'O' AS label, round((sum(a * a) * sum(s) - sum(a) * sum(a * s)) / (count(*) * sum(a * a) - sum(a) * sum(a)), 3) + 0.0 AS intercept,
       round((count(*) * sum(a * s) - sum(a) * sum(s)) / (count(*) * sum(a * a) - sum(a) * sum(a)), 3) + 0.0 AS slope FROM x""")
def component_rates_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient steps whose size is each weight's own, from the agreement of successive gradients."""
    rows = _sizes(spark, sf_dir, "l_linestatus").select("x", F.col("l_linestatus").alias("y")).persist()
    goal = objective.RowObjective(rows, 2, ["O"], objective.squared)
    w = objective.stochastic_gradient(goal, lambda t: (F.lit(True), 1.0), 70, objective.ComponentRates(0.5 / max(1, rows.count()), memory=0.5))
    rows.unpersist()
    return _pair(spark.createDataFrame([("O", [float(v) for v in w[0]])], "label string, weights array<double>"), "O")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each region a graph: nations, and suppliers in seven classes."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("graph"), F.col("n_nationkey").alias("src"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("src"), (F.lit(100) + F.col("s_suppkey") % 7).cast("int").alias("dst"))
    return supplier.join(nation, "src").select("graph", "src", "dst")


_EDGES = """
WITH RECURSIVE b AS (SELECT DISTINCT n_regionkey AS graph, s_nationkey AS src, (100 + s_suppkey % 7)::INTEGER AS dst FROM supplier JOIN nation ON s_nationkey = n_nationkey),
e AS (SELECT graph, src, dst FROM b UNION SELECT graph, dst, src FROM b),
n AS (SELECT graph, count(DISTINCT src)::DOUBLE AS size FROM e GROUP BY graph),
w AS (SELECT graph, src AS v, 0 AS t, 1::DOUBLE AS k FROM (SELECT DISTINCT graph, src FROM e)
      UNION ALL SELECT graph, v, t, sum(k) FROM (SELECT e.graph, e.dst AS v, w.t + 1 AS t, w.k FROM w JOIN e ON w.graph = e.graph AND w.v = e.src WHERE w.t < 5) GROUP BY ALL),
m AS (SELECT w.graph, t, sum(k) / max(size * size) AS memo FROM w JOIN n USING (graph) WHERE t > 0 GROUP BY w.graph, t)
"""


@query("graph_symmetrised", _EDGES + "SELECT graph, src, dst FROM e")
def graph_symmetrised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.symmetrised(_edges(spark, sf_dir))


@query("graph_adjacency", _EDGES + "SELECT graph, src, dst, 1.0::DOUBLE AS weight, round(1 / size, 9) AS start FROM e JOIN n USING (graph)")
def graph_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse 0/1 matrix of each graph that has edges, and the chance that a walk starts at a vertex."""
    return graphs.adjacency(graphs.symmetrised(_edges(spark, sf_dir))).withColumn("start", F.round("start", 9))


@query("graph_walks", _EDGES + "SELECT graph, t, round(memo, 6) AS memo FROM m")
def graph_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(graphs.walk_profiles(graphs.symmetrised(_edges(spark, sf_dir))), "memo")


@query("graph_distance", _EDGES + """
SELECT a.graph::BIGINT AS q, b.graph::BIGINT AS r, round(sqrt(sum(pow(2, 1 - a.t) * (a.memo - b.memo) * (a.memo - b.memo))), 5) AS dist
FROM m a JOIN m b ON a.t = b.t WHERE a.graph <> b.graph GROUP BY ALL""")
def graph_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of graphs by the metric join on their profiles."""
    points = graphs.points(graphs.walk_profiles(graphs.symmetrised(_edges(spark, sf_dir))))
    return metric_join.within(points, None, 1e9, "graph", "v").filter("q <> r").withColumn("dist", F.round("dist", 5))


@query("graph_kernel", _EDGES + """
SELECT a.graph AS q, b.graph AS r, round(sum(pow(2, 1 - a.t) * a.memo * b.memo), 4) AS kernel FROM m a JOIN m b ON a.t = b.t GROUP BY ALL""")
def graph_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk kernels of all pairs of graphs: products of their profiles, summed over the walk lengths."""
    m = graphs.walk_profiles(graphs.symmetrised(_edges(spark, sf_dir)))
    a, b = m.select("t", F.col("graph").alias("q"), F.col("memo").alias("x")), m.select("t", F.col("graph").alias("r"), F.col("memo").alias("y"))
    kernel = F.sum(F.pow(F.lit(2.0), 1 - F.col("t")) * F.col("x") * F.col("y"))
    return a.join(b, "t").groupBy("q", "r").agg(F.round(kernel, 4).alias("kernel"))


_LAB = """
WITH c AS (SELECT p_partkey, (p_size % 16) / 15.0::DOUBLE AS r, (p_partkey % 11) / 10.0::DOUBLE AS g, (p_partkey % 7) / 6.0::DOUBLE AS b FROM part),
x AS (SELECT p_partkey, (0.412453*r + 0.357580*g + 0.180423*b) / 0.950456 AS x, 0.212671*r + 0.715160*g + 0.072169*b AS y, (0.019334*r + 0.119193*g + 0.950227*b) / 1.088754 AS z FROM c),
f AS (SELECT *, CASE WHEN x > 0.008856 THEN pow(x, 1/3.0::DOUBLE) ELSE 7.787*x + 16/116.0::DOUBLE END AS fx, CASE WHEN y > 0.008856 THEN pow(y, 1/3.0::DOUBLE) ELSE 7.787*y + 16/116.0::DOUBLE END AS fy,
      CASE WHEN z > 0.008856 THEN pow(z, 1/3.0::DOUBLE) ELSE 7.787*z + 16/116.0::DOUBLE END AS fz FROM x),
l AS (SELECT p_partkey, CASE WHEN y > 0.008856 THEN 116*pow(y, 1/3.0::DOUBLE) - 16 ELSE 903.3*y END AS l, 500*(fx - fy) AS a, 200*(fy - fz) AS b FROM f)
"""


def _colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    return part.withColumn("lab", colour.lab((F.col("p_size") % 16) / 15, (F.col("p_partkey") % 11) / 10, (F.col("p_partkey") % 7) / 6))


@query("rgb_to_lab", _LAB + "SELECT p_partkey, round(l, 6) + 0.0 AS l, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b FROM l")
def rgb_to_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _colours(spark, sf_dir).select("p_partkey", *((F.round(f"lab.{c}", 6) + 0.0).alias(c) for c in ("l", "a", "b")))


@query("colour_distances", _LAB + """
, n AS (SELECT l.*, c.r, c.g, c.b AS blue FROM l JOIN c USING (p_partkey))
SELECT x.p_partkey, round(sqrt((x.r - y.r) * (x.r - y.r) + (x.g - y.g) * (x.g - y.g) + (x.blue - y.blue) * (x.blue - y.blue)), 6) AS rgb,
       round(sqrt((x.l - y.l) * (x.l - y.l) + (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)), 5) AS lab FROM n x JOIN n y ON y.p_partkey = x.p_partkey + 1""")
def colour_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of each part's colour to the next part's, in both colour spaces."""
    rgb = F.struct(((F.col("p_size") % 16) / 15).alias("r"), ((F.col("p_partkey") % 11) / 10).alias("g"), ((F.col("p_partkey") % 7) / 6).alias("b"))
    x = _colours(spark, sf_dir).select("p_partkey", "lab", rgb.alias("rgb"))
    y = x.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("lab").alias("lab2"), F.col("rgb").alias("rgb2"))
    far = colour.rgb_distance(F.col("rgb"), F.col("rgb2")), colour.lab_distance(F.col("lab"), F.col("lab2"))
    return x.join(y, "p_partkey").select("p_partkey", F.round(far[0], 6).alias("rgb"), F.round(far[1], 5).alias("lab"))


@query("signature_centroids", _LAB + "SELECT p_brand AS id, round(avg(l), 5) + 0.0 AS l, round(avg(a), 5) + 0.0 AS a, round(avg(b), 5) + 0.0 AS b FROM l JOIN part USING (p_partkey) GROUP BY 1")
def signature_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids of the colour signature of each brand, every part weighing the same."""
    found = colour.centroids(_colours(spark, sf_dir).withColumn("w", F.lit(1.0)), "p_brand", "lab", "w")
    return found.select("id", *((F.round(x, 5) + 0.0).alias(x) for x in ("l", "a", "b")))


@query("signature_distance")
def signature_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earth mover's distance of brands' colour signatures (eight colours at most each) where the lower bound is small."""
    rough = _colours(spark, sf_dir).withColumn("lab", F.struct(*((F.round(F.col(f"lab.{c}") / 50) * 50).alias(c) for c in ("l", "a", "b")))).groupBy("p_brand", "lab").agg(F.count("*").cast("double").alias("w"))
    sig = colour.signature(rough, "p_brand", "lab", "w")
    bucket = F.floor(colour.centroid(F.col("sig"))["l"] / 10)
    left = sig.select(F.col("id").alias("p"), F.col("sig").alias("a"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("k"))
    right = sig.select(F.col("id").alias("q"), F.col("sig").alias("b"), bucket.alias("k"))
    pairs = left.join(right, "k").filter("p < q").withColumn("bound", colour.lower_bound(F.col("a"), F.col("b"))).filter("bound < 10")
    return rounded(colour.earth_movers(pairs.select("p", "q", "bound", "a", "b")), "bound", "emd")


_PLACED = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.vec_id AS id, b.vec_id AS "pivot", list_distance(a.v, b.v) AS far FROM e a, e b WHERE b.vec_id % 25 = 0),
i AS (SELECT id, "pivot", far FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY far, "pivot") AS k FROM d) WHERE k = 1)
"""


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = vectors(spark, sf_dir)
    pivots = e.filter("vec_id % 25 = 0")
    return e, pivots, pivot_index.build(e, pivots)


@query("pivot_assignment", _PLACED + 'SELECT id, "pivot", round(far, 6) AS far FROM i')
def pivot_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_index(spark, sf_dir)[2], "far")


@query("pivot_buckets", _PLACED + 'SELECT "pivot", count(*) AS n, round(max(far), 6) AS radius, round(avg(far), 6) AS mean FROM i GROUP BY "pivot"')
def pivot_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pivot_index.buckets(_index(spark, sf_dir)[2]), "radius", "mean")


@query("pivot_statistics", _PLACED + """
, k AS (SELECT "pivot", count(*) - 1 AS k FROM i GROUP BY "pivot")
SELECT (SELECT count(*) FROM i) AS points, count(*) FILTER (k > 0) AS inner_nodes, (SELECT count(*) FROM i) - count(*) FILTER (k > 0) AS leaves, 2 AS depth, max(k) AS most_children,
       round(avg(k) FILTER (k > 0), 6) AS mean_children, count(*) FILTER (k = 1) AS single_child FROM k""")
def pivot_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pivot_index.statistics(pivot_index.nodes(_index(spark, sf_dir)[2])), "mean_children")


@query("pivot_invariants", _PLACED + """
, b AS (SELECT "pivot", max(far) AS radius FROM i GROUP BY "pivot"), s AS (SELECT min(far) AS least FROM d WHERE id % 25 = 0 AND id <> "pivot")
SELECT max(radius) <= 1.6 AS covering, max(least) >= 0.5 AS separating, round(max(radius / 1.6), 6) AS most_cover, round(avg(radius / 1.6), 6) AS mean_cover FROM b, s""")
def pivot_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pivots, index = _index(spark, sf_dir)
    return rounded(pivot_index.invariants(index, pivots, 1.6, 0.5), "most_cover", "mean_cover")


@query("pivot_descendants", _PLACED + 'SELECT id AS node_id, coalesce(n, 0) AS n FROM i LEFT JOIN (SELECT "pivot", nullif(count(*) - 1, 0) AS n FROM i GROUP BY "pivot") c ON c."pivot" = i.id')
def pivot_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.descendants(pivot_index.nodes(_index(spark, sf_dir)[2]))


@query("pivot_merged", _PLACED + 'SELECT id, "pivot", round(far, 6) AS far FROM i')
def pivot_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes of two halves of the table, merged."""
    e, pivots, _ = _index(spark, sf_dir)
    halves = [pivot_index.build(e.filter(f"vec_id % 2 = {k}"), pivots) for k in (0, 1)]
    return rounded(pivot_index.merge(*halves), "far")


@query("pivot_inserted", _PLACED + 'SELECT id, "pivot", round(far, 6) AS far FROM i')
def pivot_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the table built, the rest inserted afterwards."""
    e, pivots, _ = _index(spark, sf_dir)
    built = pivot_index.build(e.filter("vec_id % 3 <> 0"), pivots)
    return rounded(pivot_index.insert(built, e.filter("vec_id % 3 = 0"), pivots), "far")


@query("pivot_adopted", _PLACED + 'SELECT id, "pivot", round(far, 6) AS far FROM i')
def pivot_adopted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index over half of the pivots, whose rows move to the other half where those are nearer."""
    e, pivots, _ = _index(spark, sf_dir)
    built = pivot_index.build(e, pivots.filter("vec_id % 50 = 0"))
    return rounded(pivot_index.adopt(built, e, pivots.filter("vec_id % 50 <> 0")), "far")


@query("pivot_ordered", _PLACED + """
SELECT "pivot", n, row_number() OVER (ORDER BY n DESC, "pivot") - 1 AS place FROM (SELECT "pivot", count(*) AS n FROM i GROUP BY "pivot")""")
def pivot_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets with their place in the order by size."""
    return loaders.with_row_ids(pivot_index.ordered(_index(spark, sf_dir)[2]), "place").select("pivot", "n", "place")


@query("pivot_packed", _PLACED + """
SELECT id, "pivot", row_number() OVER (PARTITION BY "pivot" ORDER BY far, id) AS place FROM i""")
def pivot_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the packed layout with their place in their bucket, by counting on from where the bucket begins."""
    packed = pivot_index.packed(_index(spark, sf_dir)[2]).withColumn("at", F.monotonically_increasing_id())
    begins = packed.groupBy("pivot").agg(F.min("at").alias("begin"))
    return packed.join(begins, "pivot").select("id", "pivot", (F.col("at") - F.col("begin") + 1).alias("place"))


@query("pivot_movable", _PLACED + """
, t AS (SELECT id, far, row_number() OVER (PARTITION BY id ORDER BY far, "pivot") AS k FROM d)
SELECT i."pivot", count(*) AS n, count(*) FILTER (t.far <= 1.3) AS movable FROM i JOIN t ON t.id = i.id AND t.k = 2 GROUP BY i.pivot""")
def pivot_movable(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, pivots, _ = _index(spark, sf_dir)
    return pivot_index.movable(e, pivots)


@query("minimum_of_slopes", "SELECT s_suppkey, round(30 + s_nationkey + floor(s_acctbal / 100) / 10, 3) + 0.0 AS x, -30.0::DOUBLE AS fx, round(50 + floor(s_acctbal / 100) / 10, 3) + 0.0 AS gap_x FROM supplier")
def minimum_of_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test functions of one variable, with and without a jump, moved along by each row's account and nation, and minimised by row."""
    account = F.floor(F.col("s_acctbal").cast("double") / 100) / 10
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") + account).alias("at"), (20 + account).alias("to"))
    smooth = search.golden_section(lambda x: objective.slopes(x - F.col("at")), F.lit(-50.0), F.lit(150.0))
    # the jump is at the least point: the section is told the side before it
    jump = search.golden_section(lambda x: objective.slopes_with_gap(x - F.col("to")), F.lit(-50.0), F.col("to") + 30)
    found = rows.withColumn("x", smooth)
    return found.select("s_suppkey", (F.round("x", 3) + 0.0).alias("x"), (F.round(objective.slopes(F.col("x") - F.col("at")), 3) + 0.0).alias("fx"), (F.round(jump, 3) + 0.0).alias("gap_x"))


@query("minima_of_surfaces", """
SELECT n_nationkey, name, round(x + n_nationkey / 8.0, 3) + 0.0 AS x, round(y - n_regionkey, 3) + 0.0 AS y, round(fx, 3) + 0.0 AS fx FROM nation,
       (VALUES ('sphere', 0.0::DOUBLE, 0.0::DOUBLE, 3.0::DOUBLE), ('beale', 3, 0.5, 0), ('rosenbrock', 1, 1, 0)) t(name, x, y, fx)""")
def minima_of_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test functions of two variables, moved by each nation's keys, minimised by row with a simplex that starts again where it ends."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") / 8).alias("dx"), (-F.col("n_regionkey")).cast("double").alias("dy"))
    parts = []
    for name, start in (("sphere", (2.0, 2.0)), ("beale", (2.0, 0.0)), ("rosenbrock", (0.5, 0.5))):

        def f(v, n=name):
            return objective.surface(n, v[0] - F.col("dx"), v[1] - F.col("dy"))

        first = rows.withColumn("v", search.nelder_mead(f, F.array(start[0] + F.col("dx"), start[1] + F.col("dy")), steps=120))
        again = first.withColumn("w", search.nelder_mead(f, F.col("v"), steps=120))
        parts.append(again.select("n_nationkey", F.lit(name).alias("name"), F.round(F.col("w")[0], 3).alias("x"), F.round(F.col("w")[1], 3).alias("y"), F.round(f(F.col("w")), 3).alias("fx")))
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return found.select("n_nationkey", "name", *((F.col(c) + 0.0).alias(c) for c in ("x", "y", "fx")))


@query("trace_summary", """
WITH x AS (SELECT l_quantity / 50 AS a, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS s FROM lineitem),
b AS (SELECT (count(*) * sum(a * s) - sum(a) * sum(s)) / (count(*) * sum(a * a) - sum(a) * sum(a)) AS slope, avg(s) AS ms, avg(a) AS ma FROM x)
SELECT 'newton' AS name, true AS timed, round(sum(0.5 * pow(s - (ms - slope * ma) - slope * a, 2)), 3) AS last FROM x, b""")
def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a traced training: its steps took time, and the last value reported is that of the optimum."""
    trace = Trace()
    glm.train(_sizes(spark, sf_dir, "l_linestatus"), "x", "l_linestatus", ridge=0.0, loss="squared", optimiser="newton", trace=trace)
    last = trace.frame(spark).groupBy("name").agg(F.max_by("value", "iteration").alias("last"))
    found = trace.summary(spark).join(last, "name")
    return found.select("name", ((F.col("calls") > 0) & (F.col("seconds") > 0)).alias("timed"), F.round("last", 3).alias("last"))


_WORD = "([a-z]+)"


_BAG = f"t AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_WORD}', 1)) AS word FROM documents) GROUP BY ALL)"


#: Bytes of text that a task of a word count gets.
BAG_BYTES = 16 << 20


@query("bag_of_words", f"WITH {_BAG} SELECT doc_id, word, n FROM t")
def bag_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts of each document: its text shuffles once, so words and their counts never do; tasks grow in number, not in size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    docs = docs.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BAG_BYTES + 1), "doc_id")
    words = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_WORD))).alias("word"))
    return words.groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def _norms(bag: DataFrame) -> DataFrame:
    return bag.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))


@query("document_norms", f"WITH {_BAG} SELECT doc_id, round(sqrt(sum(n * n)), 6) AS norm FROM t GROUP BY doc_id")
def document_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of each document's word-count vector: an inner product of sparse vectors in long form."""
    return rounded(_norms(bag_of_words(spark, sf_dir)), "norm")


@query("document_cosine", f"""
WITH {_BAG}, c AS (SELECT word, sum(n)::DOUBLE AS m FROM t GROUP BY word)
SELECT doc_id, round(sum(n * m) / sqrt(sum(n * n)) / (SELECT sqrt(sum(m * m)) FROM c), 6) AS cosine FROM t JOIN c USING (word) GROUP BY doc_id""")
def document_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cosine of each document's word counts and the corpus's."""
    bag = bag_of_words(spark, sf_dir)
    corpus = bag.groupBy("word").agg(F.sum("n").cast("double").alias("m"))
    norm = corpus.agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("whole"))  # one row
    sums = bag.join(corpus, "word").groupBy("doc_id").agg(F.sum(F.col("n") * F.col("m")).alias("x"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return sums.join(F.broadcast(norm), how="cross").select("doc_id", F.round(F.col("x") / F.col("norm") / F.col("whole"), 6).alias("cosine"))


@query("streaming_moments", "SELECT event_type, count(value)::DOUBLE AS m0, round(sum(value), 4) AS m1, round(sum(value * value), 3) AS m2 FROM events GROUP BY 1")
def streaming_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running summary after all events that are there now have streamed through."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = running.run_to_files(running.running_moments(stream, "value", ["event_type"]), f"{grids.shared_folder(spark)}/stream-{uuid.uuid4().hex}")
    return out.select("event_type", "m0", F.round("m1", 4).alias("m1"), F.round("m2", 3).alias("m2"))


@query("streaming_windows", """
SELECT time_bucket(INTERVAL '1 day', ts) AS start, count(value)::DOUBLE AS m0, round(sum(value), 4) AS m1 FROM events GROUP BY 1""")
def streaming_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    frame = running.windowed_moments(stream.withColumn("ts", F.col("ts").cast("timestamp")), "value", "ts", "1 day", "30 days")
    out = running.run_to_files(frame, f"{grids.shared_folder(spark)}/stream-{uuid.uuid4().hex}")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "m0", F.round("m1", 4).alias("m1"))



"""Queries on mergeable statistics and on splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.operators import mergeable as U
from orrery.operators import moments as M
from orrery.operators import sampling as S
from orrery.operators import validation as W
from orrery.plans.metric_queries import rounded, table
from orrery.plans.registry import query

KEYS = ["l_returnflag", "l_linestatus"]


@query("moments_by_key", "SELECT l_returnflag, l_linestatus, count(l_quantity)::DOUBLE AS m0, round(sum(l_quantity), 6) AS m1, round(sum(l_quantity * l_quantity), 6) AS m2 FROM lineitem GROUP BY ALL")
def moments_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.summary(table(spark, sf_dir, "lineitem"), "l_quantity", KEYS), "m1", "m2")


@query("moments_merged", "SELECT l_returnflag, count(l_quantity)::DOUBLE AS m0, round(sum(l_quantity), 6) AS m1, round(sum(l_quantity * l_quantity), 6) AS m2, round(var_pop(l_quantity), 6) AS var FROM lineitem GROUP BY ALL")
def moments_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries by two keys, rolled up to one without reading rows again."""
    items = table(spark, sf_dir, "lineitem")
    spread = M.merge_centred(M.centred(items, "l_quantity", KEYS).drop("l_linestatus"), keys=["l_returnflag"])
    sums = M.merge(M.summary(items, "l_quantity", KEYS).drop("l_linestatus"), keys=["l_returnflag"])
    return rounded(sums.join(spread.select("l_returnflag", M.variance().alias("var")), "l_returnflag"), "m1", "m2", "var")


@query("moments_untrained", """
WITH s AS (SELECT o_orderstatus, count(*)::DOUBLE AS m0, sum(o_totalprice) AS m1, sum(o_totalprice * o_totalprice) AS m2 FROM orders GROUP BY 1),
t AS (SELECT sum(m0) AS t0, sum(m1) AS t1, sum(m2) AS t2 FROM s)
SELECT o_orderstatus, t0 - m0 AS m0, round((t1 - m1) / (t0 - m0), 4) AS mean FROM s, t""")
def moments_untrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-group-out statistics by subtraction, in one pass."""
    left = M.without_each(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderstatus")
    return left.select("o_orderstatus", "m0", F.round(M.mean(), 4).alias("mean"))


@query("moments_subtracted", "SELECT l_returnflag, count(*)::DOUBLE AS m0, round(sum(l_tax), 6) AS m1, round(sum(l_tax * l_tax), 6) AS m2 FROM lineitem WHERE l_linestatus <> 'F' GROUP BY 1")
def moments_subtracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    whole, part = M.summary(items, "l_tax", ["l_returnflag"]), M.summary(items.filter("l_linestatus = 'F'"), "l_tax", ["l_returnflag"])
    return rounded(M.subtract(whole, part, ["l_returnflag"]).filter("m0 > 0"), "m1", "m2")


@query("moments_weighted", """
SELECT l_returnflag, round(sum(l_quantity), 6) AS m0, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS mean,
       round(sum(l_quantity * l_discount * l_discount) / sum(l_quantity) - pow(sum(l_quantity * l_discount) / sum(l_quantity), 2), 6) AS var
FROM lineitem GROUP BY 1""")
def moments_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = M.centred(table(spark, sf_dir, "lineitem"), "l_discount", ["l_returnflag"], weight="l_quantity")
    return s.select("l_returnflag", F.round("n", 6).alias("m0"), F.round("mean", 6).alias("mean"), F.round(M.variance(), 6).alias("var"))


@query("moments_scaled", "SELECT l_linestatus, count(*) / 4.0::DOUBLE AS m0, round(sum(l_tax) / 4, 6) AS m1, round(sum(l_tax * l_tax) / 4, 6) AS m2 FROM lineitem GROUP BY 1")
def moments_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.scale(M.summary(table(spark, sf_dir, "lineitem"), "l_tax", ["l_linestatus"]), 0.25), "m1", "m2")


_FOUR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_COV = " UNION ALL ".join(f"SELECT '{i}' AS i, '{j}' AS j, round(covar_pop({i}, {j}), 4) + 0.0 AS cov FROM lineitem" for i in _FOUR for j in _FOUR)


@query("moments_outer", _COV)
def moments_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.covariance(table(spark, sf_dir, "lineitem"), _FOUR)
    return found.withColumn("cov", F.round("cov", 4) + F.lit(0.0))


@query("normal_density", """
WITH s AS (SELECT event_type, avg(value) AS mu, 1 + var_pop(value) AS s FROM events GROUP BY 1)
SELECT event_id, round(exp(-0.5 * (value - mu) * (value - mu) / s) / sqrt(2 * pi() * s), 9) AS pdf FROM events JOIN s USING (event_type)""")
def normal_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    model = M.centred(events, "value", ["event_type"]).select("event_type", F.col("mean").alias("mu"), M.variance().alias("spread"))
    return events.join(model, "event_type").select("event_id", F.round(M.normal_pdf("value", F.col("mu"), F.col("spread")), 9).alias("pdf"))


@query("column_statistics", "SELECT generate_subscripts(e, 1) - 1 AS dim, unnest(e) AS v FROM (SELECT embedding::DOUBLE[] AS e FROM embeddings)".join(["SELECT dim::INTEGER AS dim, count(*) AS n, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS var FROM (", ") GROUP BY dim"]))
def column_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.by_dimension(table(spark, sf_dir, "embeddings"), "embedding", 64), "mean", "var")


_ORDER = """
WITH u AS (SELECT generate_subscripts(e, 1) - 1 AS dim, unnest(e) AS v FROM (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id < 1000)),
s AS (SELECT dim, var_pop(v) AS var FROM u GROUP BY dim), o AS (SELECT dim, var, row_number() OVER (ORDER BY var DESC, dim) - 1 AS pos FROM s)
"""


@query("variance_order", _ORDER + "SELECT dim::INTEGER AS dim, round(var, 6) AS var, pos::INTEGER AS pos FROM o")
def variance_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components by falling variance over the first 1000 rows."""
    return rounded(M.variance_order(table(spark, sf_dir, "embeddings").filter("vec_id < 1000"), "embedding", 64), "var")


@query("column_reorder", _ORDER + """
SELECT vec_id, round(max(v) FILTER (pos = 0), 6) AS first, round(max(v) FILTER (pos = 63), 6) AS last
FROM (SELECT vec_id, generate_subscripts(e, 1) - 1 AS dim, unnest(e) AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)) JOIN o USING (dim) GROUP BY vec_id""")
def column_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.doubles("embedding").alias("v"))
    order = [r["dim"] for r in M.variance_order(e.filter("vec_id < 1000"), "v", 64).orderBy("pos").collect()]
    out = M.reordered(e, "v", order)
    return out.select("vec_id", F.round(F.col("reordered")[0], 6).alias("first"), F.round(F.col("reordered")[63], 6).alias("last"))


@query("mean_centred", """
WITH u AS (SELECT vec_id, generate_subscripts(e, 1) - 1 AS dim, unnest(e) AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))
SELECT vec_id, dim::INTEGER AS dim, round(v - avg(v) OVER (PARTITION BY dim), 6) AS value FROM u""")
def mean_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.doubles("embedding").alias("v"))
    return M.mean_centred(e, "v", 64).select("vec_id", F.posexplode("centred").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query("rotated_distances", """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.vec_id AS q, round(list_distance(a.v, b.v), 5) AS dist FROM e a, (SELECT * FROM e WHERE vec_id = 0) b""")
def rotated_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principal-component rotation keeps all distances."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.doubles("embedding").alias("v"))
    out = M.rotated(e, "v", 64).select("vec_id", "rotated")
    first = F.broadcast(out.filter("vec_id = 0").select(F.col("rotated").alias("o")))
    return out.join(first, how="cross").select(F.col("vec_id").alias("q"), F.round(V.distance("rotated", "o"), 5).alias("dist"))


_HASHED = "SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat(o_orderkey, '-7')), o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders"


@query("kfold_assign", f"SELECT o_orderkey, (CASE WHEN pos // (n // 7) < 7 THEN pos // (n // 7) ELSE -1 END)::INTEGER AS fold FROM ({_HASHED})")
def kfold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.kfold(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7, 7).fillna(-1, ["fold"])


@query("holdout_split", f"SELECT o_orderkey, CASE WHEN pos < round(0.7 * n) THEN 'train' ELSE 'test' END AS side FROM ({_HASHED})")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.holdout(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.7, 7)


@query("repeated_split", """
SELECT o_orderkey, rep, CASE WHEN row_number() OVER (PARTITION BY rep ORDER BY md5(concat(o_orderkey, '/', rep, '-7')), concat(o_orderkey, '/', rep)) <= round(0.5 * n) THEN 'train' ELSE 'test' END AS side
FROM (SELECT o_orderkey, count(*) OVER () AS n FROM orders), (SELECT unnest([0, 1, 2])::INTEGER AS rep)""")
def repeated_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.repeated(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 3, 0.5, 7)


@query("first_by_hash", "SELECT o_orderkey FROM orders ORDER BY md5(concat(o_orderkey, '-7')), o_orderkey LIMIT 100")
def first_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The option that limits the number of data points."""
    return S.first_n(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100, 7)


@query("fold_validation", f"""
WITH f AS (SELECT o_orderkey, o_totalprice, pos // (n // 7) AS fold FROM ({_HASHED}) JOIN orders USING (o_orderkey)),
m AS (SELECT g.fold, avg(f.o_totalprice) AS mu FROM (SELECT DISTINCT fold FROM f WHERE fold < 7) g, f WHERE f.fold <> g.fold GROUP BY 1)
SELECT f.fold::INTEGER AS fold, count(*) AS n, round(avg((o_totalprice - mu) * (o_totalprice - mu)), 2) AS loss FROM f JOIN m USING (fold) GROUP BY 1""")
def fold_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared loss of the mean of all other folds, the models made by subtraction from one summary."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    folded = S.kfold(orders, "o_orderkey", 7, 7).withColumn("fold", F.coalesce("fold", F.lit(7)))
    models = M.without_each(folded, "o_totalprice", "fold").select("fold", M.mean().alias("mu"))  # a row for each fold
    tested = folded.filter("fold < 7").join(F.broadcast(models), "fold")
    loss = S.squared_loss(F.col("mu"), F.col("o_totalprice"))
    return tested.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg(loss), 2).alias("loss"))


@query("scalar_functions", """
SELECT event_id, round(1 / (1 + exp(-value / 100)), 9) AS logit, round(ln(1 + exp(-value / 100)), 9) AS logloss, CASE WHEN value > 250 THEN 1.0 ELSE -1.0 END::DOUBLE AS sign,
       floor(ln(value) / ln(1.3))::BIGINT AS down, ceil(ln(value) / ln(1.3))::BIGINT AS up, round(pow(1.3, floor(ln(value) / ln(1.3)) + 1), 6) AS cover, (value > 250)::INTEGER AS high,
       regexp_replace(props, '[^0-9.,-]', '', 'g') AS digits, round(ln(exp(value / 100) + exp(2)), 9) AS lse FROM events""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value")
    down = V.level_down(x)
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(V.inverse_logit(x / 100), 9).alias("logit"), F.round(V.log_loss(x / 100), 9).alias("logloss"), V.sign_of(x > 250).alias("sign"), down.alias("down"), V.level_up(x).alias("up"),
        F.round(V.cover_distance(down), 6).alias("cover"), V.indicator(x > 250).alias("high"), V.digits_only("props").alias("digits"), F.round(V.log_sum_exp(x / 100, F.lit(2.0)), 9).alias("lse"),
    )


@query("vector_functions", """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0) AS o FROM embeddings)
SELECT vec_id, round(list_inner_product(v, o), 6) AS dot, round(list_distance(v, o), 6) AS dist, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(v[2] * o[3], 6) AS outer_12,
       round(v[1] + o[1], 6) AS plus_0, round(v[1] * o[1], 6) AS times_0, round(sqrt(list_inner_product(v, v) + list_inner_product(o, o) - 2 * list_inner_product(v, o)), 5) AS kernel FROM e""")
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.doubles("embedding").alias("v"))
    both = e.join(F.broadcast(e.filter("vec_id = 0").select(F.col("v").alias("o"))), how="cross")
    return both.select(
        "vec_id", F.round(V.dot("v", "o"), 6).alias("dot"), F.round(V.distance_unrolled("v", "o", 64), 6).alias("dist"), F.round(V.norm("v"), 6).alias("norm"), F.round(V.outer("v", "o")[1][2], 6).alias("outer_12"),
        F.round(V.plus("v", "o")[0], 6).alias("plus_0"), F.round(V.times("v", "o")[0], 6).alias("times_0"), F.round(V.kernel_distance(V.dot("v", "v"), V.dot("o", "o"), V.dot("v", "o")), 5).alias("kernel"),
    )


@query("normal_density_vectors", """
WITH s AS (SELECT avg(l_quantity) AS ma, avg(l_discount) AS mb, 1 + var_pop(l_quantity) AS aa, 1 + var_pop(l_discount) AS bb, covar_pop(l_quantity, l_discount) AS ab FROM lineitem),
x AS (SELECT l_orderkey, l_linenumber, l_quantity - ma AS a, l_discount - mb AS b, aa, bb, ab, aa * bb - ab * ab AS size FROM lineitem, s)
SELECT l_orderkey, l_linenumber, round(exp(-0.5 * (bb * a * a - 2 * ab * a * b + aa * b * b) / size) / (2 * pi() * sqrt(size)), 9) AS pdf FROM x""")
def normal_density_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return M.normal_densities(items, ["l_quantity", "l_discount"]).select("l_orderkey", "l_linenumber", F.round("pdf", 9).alias("pdf"))


@query("moments_combined", """
WITH a AS (SELECT l_returnflag, count(*)::DOUBLE AS m0, sum(l_tax) AS m1, sum(l_tax * l_tax) AS m2 FROM lineitem GROUP BY 1),
b AS (SELECT l_returnflag, count(*)::DOUBLE AS m0, sum(l_discount) AS m1, sum(l_discount * l_discount) AS m2 FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(a.m0 / b.m0, 6) AS m0, round(a.m1 / b.m1, 6) AS m1, round(a.m2 / b.m2, 6) AS m2 FROM a JOIN b USING (l_returnflag)""")
def moments_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component-wise quotient of two summaries."""
    items = table(spark, sf_dir, "lineitem")
    a, b = (M.summary(items, c, ["l_returnflag"]) for c in ("l_tax", "l_discount"))
    return rounded(M.combine(a, b, "/", ["l_returnflag"]), "m0", "m1", "m2")


@query("semidefinite_projection", """
WITH m AS (SELECT p_partkey, (p_partkey % 7 - 3)::DOUBLE AS a, (p_partkey % 5 - 2)::DOUBLE AS b, (p_size % 9 - 4)::DOUBLE AS c FROM part),
e AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS most, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) AS least FROM m)
SELECT p_partkey, round(CASE WHEN least >= 0 THEN a WHEN most <= 0 THEN 0 ELSE most * (a - least) / (most - least) END, 6) + 0.0 AS a,
       round(CASE WHEN least >= 0 THEN b WHEN most <= 0 THEN 0 ELSE most * b / (most - least) END, 6) + 0.0 AS b,
       round(CASE WHEN least >= 0 THEN c WHEN most <= 0 THEN 0 ELSE most * (c - least) / (most - least) END, 6) + 0.0 AS c FROM e""")
def semidefinite_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = F.col("p_partkey") % 7 - 3, F.col("p_partkey") % 5 - 2, F.col("p_size") % 9 - 4
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(F.array(a, b), F.array(b, c)).alias("m"))
    found = M.nearest_semidefinite(rows, "m", "p")
    cells = {"a": F.col("p")[0][0], "b": F.col("p")[0][1], "c": F.col("p")[1][1]}
    return found.select("p_partkey", *((F.round(x, 6) + 0.0).alias(n) for n, x in cells.items()))


@query("moments_centred", "SELECT l_returnflag, l_linestatus, count(*)::DOUBLE AS n, round(avg(1e9 + l_discount), 4) AS mean, round(var_pop(l_discount), 6) AS var FROM lineitem GROUP BY ALL")
def moments_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variances of values far from 0, whose raw squares hold none of their digits."""
    far = table(spark, sf_dir, "lineitem").withColumn("x", 1e9 + F.col("l_discount"))
    found = M.centred(far, "x", KEYS).select(*KEYS, "n", "mean", M.variance().alias("var"))
    return found.withColumns({"mean": F.round("mean", 4), "var": F.round("var", 6)})


@query("moments_centred_untrained", "SELECT l_returnflag, count(*)::DOUBLE AS n, round(avg(1e6 + l_tax), 6) AS mean, round(var_pop(l_tax), 6) AS var FROM lineitem WHERE l_linestatus <> 'F' GROUP BY 1")
def moments_centred_untrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred summaries of groups from which a part is taken out again without its rows' values."""
    far = table(spark, sf_dir, "lineitem").withColumn("x", 1e6 + F.col("l_tax"))
    part = M.centred(far.filter("l_linestatus = 'F'"), "x", ["l_returnflag"])
    left = M.subtract_centred(M.centred(far, "x", ["l_returnflag"]), part, ["l_returnflag"]).filter("n > 0")
    return rounded(left.select("l_returnflag", "n", "mean", M.variance().alias("var")), "mean", "var")


@query("aggregate_moments", "SELECT l_returnflag, l_linestatus, count(*)::DOUBLE AS n, round(avg(l_extendedprice), 4) AS mean, round(var_pop(l_extendedprice), 2) AS var FROM lineitem GROUP BY ALL")
def aggregate_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments written as a user's own aggregate: a map, a merge and its inverse; two parts merged, a third taken out."""
    items, agg = table(spark, sf_dir, "lineitem"), U.centred_moments("l_extendedprice")
    a, b, c = (U.states(items.filter(f"l_linenumber % 3 = {k}"), agg, KEYS) for k in range(3))
    twice = U.merged(agg, KEYS, a, b, c, c)
    found = U.subtracted(agg, KEYS, twice, c)
    cells = {"n": F.col("state")[0], "mean": F.round(F.col("state")[1], 4), "var": F.round(F.col("state")[2] / F.col("state")[0], 2)}
    return found.select(*KEYS, *(x.alias(n) for n, x in cells.items()))


@query("aggregate_largest", "SELECT o_orderpriority, rank, o_totalprice AS value FROM (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC)::INTEGER AS rank FROM orders) WHERE rank <= 5")
def aggregate_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top five as a user's own aggregate."""
    found = U.states(table(spark, sf_dir, "orders"), U.largest("o_totalprice", 5), ["o_orderpriority"])
    return found.select("o_orderpriority", F.posexplode("state").alias("rank", "value")).withColumn("rank", F.col("rank") + 1)


@query("aggregate_histogram", """
SELECT event_type, least(floor(value / 50), 9)::INTEGER AS bin, count(*)::DOUBLE AS n FROM events WHERE value >= 0 AND value <= 500 GROUP BY ALL""")
def aggregate_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram as a user's own aggregate."""
    found = U.states(table(spark, sf_dir, "events"), U.histogram("value", [50.0 * k for k in range(11)]), ["event_type"])
    return found.select("event_type", F.posexplode("state").alias("bin", "n")).filter("n > 0")


def _mean_loss(found: DataFrame) -> DataFrame:
    return found.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg("loss"), 2).alias("loss"))


@query("kfold_mean", f"""
WITH f AS (SELECT o_orderkey, o_totalprice, pos // (n // 7) AS fold FROM ({_HASHED}) JOIN orders USING (o_orderkey)),
m AS (SELECT g.fold, avg(f.o_totalprice) AS mu FROM (SELECT DISTINCT fold FROM f WHERE fold < 7) g, f WHERE f.fold <> g.fold GROUP BY 1)
SELECT f.fold::BIGINT AS fold, count(*) AS n, round(avg((o_totalprice - mu) * (o_totalprice - mu)), 2) AS loss FROM f JOIN m USING (fold) GROUP BY 1""")
def kfold_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven folds of a mergeable model, each judged by prefix and suffix merges of the others."""
    return _mean_loss(W.cross_validate(table(spark, sf_dir, "orders"), "o_orderkey", W.KFold(7, 7), U.centred_moments("o_totalprice"), W.squared_error_of_mean("o_totalprice")))


@query("leave_one_out_mean", """
SELECT c_custkey, round(pow(c_acctbal - (sum(c_acctbal) OVER () - c_acctbal) / (count(*) OVER () - 1), 2), 4) AS loss FROM customer""")
def leave_one_out_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = W.cross_validate(table(spark, sf_dir, "customer"), "c_custkey", W.LeaveOneOut(), U.centred_moments("c_acctbal"), W.squared_error_of_mean("c_acctbal"))
    return found.select("c_custkey", F.round("loss", 4).alias("loss"))


def _line_loss(state, rows):
    w = U.least_squares(state)
    return (rows["y"].to_numpy(float) - w[0] - w[1] * rows["x"].to_numpy(float)) ** 2


_LINE = "round(pow(y - ((m - b * sx) / n) - b * x, 2), {d}) AS loss"


@query("leave_one_out_line", """
WITH d AS (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice / 100 AS y FROM part),
t AS (SELECT count(*) - 1 AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM d),
o AS (SELECT p_partkey, x, y, n, sx - x AS sx, sy - y AS m, (n * (sxy - x * y) - (sx - x) * (sy - y)) / (n * (sxx - x * x) - (sx - x) * (sx - x)) AS b FROM d, t)
SELECT p_partkey, """ + _LINE.format(d=6) + " FROM o")
def leave_one_out_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line by normal equations, judged on each row by the equations of all others."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"))
    found = W.cross_validate(parts, "p_partkey", W.LeaveOneOut(), U.normal_equations(["x"], "y"), _line_loss)
    return found.select("p_partkey", F.round("loss", 6).alias("loss"))


@query("group_folds_line", """
WITH d AS (SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem),
t AS (SELECT g, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM d GROUP BY 1),
o AS (SELECT a.g, sum(b.n) AS n, sum(b.sx) AS sx, sum(b.sy) AS m, (sum(b.n) * sum(b.sxy) - sum(b.sx) * sum(b.sy)) / (sum(b.n) * sum(b.sxx) - sum(b.sx) * sum(b.sx)) AS b FROM t a JOIN t b ON a.g <> b.g GROUP BY 1)
SELECT l_returnflag, count(*) AS n, round(avg(loss), 4) AS loss FROM (SELECT g AS l_returnflag, """ + _LINE.format(d=12) + " FROM d JOIN o USING (g)) GROUP BY 1")
def group_folds_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of each return flag judged by a line through those of all others."""
    items = table(spark, sf_dir, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("id"), "l_returnflag", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    found = W.cross_validate(items, "id", W.Groups("l_returnflag"), U.normal_equations(["x"], "y"), _line_loss)
    flags = W.folded(items.select("id", "l_returnflag"), "id", W.Groups("l_returnflag")).select("l_returnflag", "fold").distinct()
    return found.join(F.broadcast(flags), "fold").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("loss"), 4).alias("loss"))

"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest.

Rules are strings of a host and a path (``net/es/``). A rule fits its host and all its subdomains when the
url's path starts with the rule's path; the longest fitting rule wins, of equally long ones that of the longer host. Rules are
a table of any size: the host suffixes of all distinct hosts meet them by an equal join, and every url then its
host's rules, the urls of frequent hosts where they lie. The urls that a rule decides are the labelled ones: from ``max_rows`` distinct ones of them at most, drawn by label and a hash of the url and weighted
back to the rows of their label, boosted trees learn to decide the urls that no rule fits. Everything is a
DataFrame or SQL expression; label counts and suffix statistics come from all rows, and only suffixes that hold
a thousandth of all rows are broadcast.

Defined results: a null url, or one without ``://``, has an empty host and path and is judged by its
features (a null one as the empty string); with no labelled url, or labels of one kind only, every url
without a rule gets that kind (allow if there is none); repeated rows are judged each; an empty table
gives an empty result; extra columns are ignored. A rule without a path fits every path; one that is listed as both kinds
blocks; rules with null or empty hosts fit nothing.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import common as C

ALLOW, BLOCK = "allow", "block"


def host(url: Column) -> Column:
    return C.ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without it."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """(suffix, rules: array of (length, host_length, kind, rule, path)), one row for each host that rules name."""
    table = rules.select("kind", "rule") if isinstance(rules, DataFrame) else spark.createDataFrame(rules, "kind string, rule string")
    suffix = C.ascii_lower(F.substring_index("rule", "/", 1))
    one = table.filter("rule IS NOT NULL AND kind IS NOT NULL").groupBy("rule").agg(F.max("kind").alias("kind"))
    entry = F.struct(F.length("rule").alias("length"), F.length(suffix).alias("host_length"), "kind", "rule", F.substring(F.col("rule"), F.length(suffix) + 1, F.length("rule")).alias("path"))
    return one.withColumn("suffix", suffix).filter("suffix <> ''").groupBy("suffix").agg(F.collect_list(entry).alias("rules"))


def with_rules(urls: DataFrame, rules: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """urls (with host and path) with ``rule`` and ``ruled``, the longest fitting rule and its kind; null if none fits."""
    table = C.cut(rule_table(urls.sparkSession, rules))
    depth = table.agg(F.max(F.size(F.split("suffix", r"\."))).alias("d")).first()["d"] or 1
    hosts = C.cut(urls.groupBy("host").agg(F.count("*").alias("n")))
    labels = F.split(F.col("host"), r"\.")
    # no rule has more labels than ``depth``, however long a host is
    tails = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - depth + 1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = hosts.select("host", F.explode(tails).alias("suffix"))
    sizes = asked.groupBy("suffix").agg(F.count("*").alias("k"))
    met = C.join_groups(asked, table.join(sizes, "suffix"), "suffix", "k", asked.count())
    per_host = C.cut(met.groupBy("host").agg(F.flatten(F.collect_list("rules")).alias("rules")).join(hosts, "host"))
    joined = C.join_groups(urls, per_host, "host", "n", hosts.agg(F.sum("n")).first()[0] or 0, "left")
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])))
    return joined.withColumn("best", best).select(*urls.columns, F.col("best.rule").alias("rule"), F.col("best.kind").alias("ruled"))


#: Lexical features of a url; suffix statistics come beside them.
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "marks", "entropy", "parameters", "query_length", "fragment", "extension", "longest")


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def with_features(urls: DataFrame, url: str, h: str, p: str) -> DataFrame:
    """urls with the columns of FEATURES."""
    u = F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    n = F.greatest(F.length(u), F.lit(1))
    chars = F.array_distinct(F.filter(F.split(u, ""), lambda c: c != ""))

    def bits(c: Column) -> Column:
        share = (F.length(u) - F.length(F.replace(u, c))) / n
        return -share * F.log2(share)

    return urls.withColumns(
        {
            "length": F.length(u).cast("double"),
            "host_length": F.length(h).cast("double"),
            "path_length": F.length(p).cast("double"),
            "depth": F.regexp_count(F.col(p), F.lit("/[^/]")).cast("double"),
            "labels": F.size(F.split(F.col(h), r"\.")).cast("double"),
            "digits": _share(u, "[0-9]").cast("double"),
            "host_digits": _share(F.col(h), "[0-9]").cast("double"),
            "marks": _share(u, "[-_~%=+]").cast("double"),
            "entropy": F.aggregate(F.transform(chars, bits), F.lit(0.0), lambda a, x: a + x),
            "parameters": F.when(query == "", 0.0).otherwise(F.regexp_count(query, F.lit("[^&;]+")).cast("double")),
            "query_length": F.length(query).cast("double"),
            "fragment": F.locate("#", u).cast("boolean").cast("double"),
            "extension": F.length(F.regexp_extract(F.col(p), r"\.([A-Za-z0-9]{1,5})$", 1)).cast("double"),
            "longest": F.coalesce(F.array_max(F.transform(F.split(u, "[^A-Za-z]+"), lambda w: F.length(w))), F.lit(0)).cast("double"),
        }
    )


def draw(labelled: DataFrame, urls: dict[float, int], rows: dict[float, int], max_rows: int) -> DataFrame:
    """At most max_rows distinct urls of both labels, those of lowest hash, with weights that sum to the rows of each label.

    Each label has half of the draw, and what the other leaves. ``urls`` and ``rows`` are counts by label.
    """
    half, parts = max_rows // 2, []
    for k in (0.0, 1.0):
        take = max(half, max_rows - urls[1.0 - k])
        part = C.cut(labelled.filter(F.col("label") == k).orderBy(F.xxhash64("url"), "url").limit(take))
        held = part.agg(F.sum("copies")).first()[0]
        parts.append(part.withColumn("weight", F.col("copies") * F.lit(rows[k] / held)))
    return parts[0].unionByName(parts[1])


def _prepared(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, id_col: str, url_col: str) -> DataFrame:
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    whole = F.coalesce(F.col("url"), F.lit(""))
    urls = urls.withColumn("host", host(whole)).withColumn("path", path(whole))
    return C.cut(with_rules(urls, rules).withColumn("suffix", F.substring_index("host", ".", -1)))


def _statistics(urls: DataFrame, prior: float) -> DataFrame:
    """How common a suffix is among all urls, and its smoothed share of blocked ones among all that a rule decides."""
    label = (F.col("ruled") == BLOCK).cast("double")
    return C.cut(
        urls.groupBy("suffix")
        .agg(F.count("*").alias("n"), F.count("ruled").alias("ruled"), F.sum(label).alias("blocked"))
        .select("suffix", "n", F.log1p("n").alias("suffix_count"), ((F.coalesce("blocked", F.lit(0.0)) + 10 * prior) / (F.col("ruled") + 10)).alias("suffix_blocked"))
    )


def _learner(trees: int, depth: int) -> GBTClassifier:
    return GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, seed=1, checkpointInterval=-1)


SUFFIX_FEATURES = ("suffix_count", "suffix_blocked")


def _features(df: DataFrame, stats: DataFrame, total: int, names: tuple[str, ...] = (*FEATURES, *SUFFIX_FEATURES), how: str = "inner") -> DataFrame:
    joined = C.join_groups(with_features(df, "url", "host", "path"), stats, "suffix", "n", total, how).fillna(0.0, list(SUFFIX_FEATURES))
    return VectorAssembler(inputCols=list(names), outputCol="features").transform(joined)


def held_out_auc(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url", max_rows: int = 20_000, trees: int = 10, depth: int = 4) -> dict[str, float]:
    """Areas under the curve on a fifth of the distinct ruled urls, of trees and statistics that have not seen them: with and without suffixes."""
    urls = _prepared(pages, rules, id_col, url_col)
    label = (F.col("ruled") == BLOCK).cast("double").alias("label")
    ruled = C.cut(urls.filter("ruled IS NOT NULL").groupBy("url", "host", "path", "suffix", label).agg(F.count("*").alias("copies")))
    held = F.pmod(F.xxhash64("url", F.lit(5)), F.lit(5)) == 0
    train, test = ruled.filter(~held), ruled.filter(held)
    counts = {r["label"]: r for r in train.groupBy("label").agg(F.count("*").alias("urls"), F.sum("copies").alias("n")).collect()}
    drawn = draw(train, {k: r["urls"] for k, r in counts.items()}, {k: r["n"] for k, r in counts.items()}, max_rows)
    stats = _statistics(urls.filter(~held), counts[1.0]["n"] / (counts[0.0]["n"] + counts[1.0]["n"]))
    total = stats.agg(F.sum("n")).first()[0]
    out = {}
    for name, names in (("all", (*FEATURES, *SUFFIX_FEATURES)), ("lexical", FEATURES)):
        model = _learner(trees, depth).fit(C.cut(_features(drawn, stats, total, names, "left").select("features", "label", "weight")))
        judged = model.transform(_features(test, stats, total, names, "left"))
        out[name] = float(BinaryClassificationEvaluator(labelCol="label", weightCol="copies").evaluate(judged.withColumn("copies", F.col("copies").cast("double"))))
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url", max_rows: int = 20_000, trees: int = 10, depth: int = 4) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every url. ``rules``: (allow or block, rule) pairs, or a table (kind, rule)."""
    C.prepare(pages.sparkSession)
    urls = _prepared(pages, rules, id_col, url_col)
    label = (F.col("ruled") == BLOCK).cast("double")
    labelled = urls.filter("ruled IS NOT NULL").groupBy("url", "host", "path", "suffix", label.alias("label")).agg(F.count("*").alias("copies"))
    counts = {r["label"]: r for r in labelled.groupBy("label").agg(F.count("*").alias("urls"), F.sum("copies").alias("n")).collect()}
    out = ("page_id", "host", "path", "rule")
    if len(counts) < 2:
        verdict = BLOCK if 1.0 in counts else ALLOW
        return urls.select(*out, F.coalesce("ruled", F.lit(verdict)).alias("verdict"), F.lit(float(verdict == BLOCK)).alias("score"))
    prior = counts[1.0]["n"] / (counts[0.0]["n"] + counts[1.0]["n"])
    drawn = draw(labelled, {k: r["urls"] for k, r in counts.items()}, {k: r["n"] for k, r in counts.items()}, max_rows)
    stats = _statistics(urls, prior)
    total = stats.agg(F.sum("n")).first()[0]
    model = _learner(trees, depth).fit(C.cut(_features(drawn, stats, total).select("features", "label", "weight")))
    judged = model.setProbabilityCol("probability").transform(_features(urls, stats, total))
    from pyspark.ml.functions import vector_to_array

    score = vector_to_array("probability")[1]
    verdict = F.coalesce("ruled", F.when(score >= 0.5, F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    return judged.select(*out, verdict.alias("verdict"), score.alias("score"))

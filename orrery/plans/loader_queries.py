"""Queries on readers and writers: a table is written in a format, read again by its reader, and has to be the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import colour, grids, metric_join
from orrery.plans.metric_queries import PAIRS, table, vectors
from orrery.plans.registry import query
from orrery.sources import loaders


def _folder(spark: SparkSession) -> str:
    """A new folder under the one that all machines share."""
    return f"{grids.shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("double").alias("a"), F.col("p_size").cast("double").alias("b"), F.col("p_retailprice").cast("double").alias("c"))


@query("loader_csv", "SELECT p_partkey::DOUBLE AS a, p_size::DOUBLE AS b, p_retailprice::DOUBLE AS c FROM part")
def loader_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric CSV without a header, read as vectors."""
    path = _folder(spark)
    _numbers(spark, sf_dir).write.csv(path)
    found = loaders.load(spark, path, "csv")
    return found.select(*(F.col("features")[k].alias(c) for k, c in enumerate("abc")))


@query("loader_row_ids", "SELECT count(*) AS n, 0::BIGINT AS first, count(*) - 1 AS last, count(*) AS ids FROM part")
def loader_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are read get the ids 0, 1, ..., each once."""
    path = _folder(spark)
    _numbers(spark, sf_dir).write.csv(path)
    found = loaders.csv(spark, path)
    return found.agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.count_distinct("id").alias("ids"))


@query("loader_labelled_csv", "SELECT p_brand AS label, p_size::DOUBLE AS a, p_retailprice::DOUBLE AS b FROM part")
def loader_labelled_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV whose middle column is the label."""
    path = _folder(spark)
    table(spark, sf_dir, "part").select("p_size", "p_brand", "p_retailprice").write.csv(path)
    found = loaders.load(spark, path, "labelled", label=1)
    return found.select("label", F.col("features")[0].alias("a"), F.col("features")[1].alias("b"))


@query("loader_words", "SELECT p_type AS word, count(*) AS n FROM part GROUP BY 1")
def loader_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One string a line."""
    path = _folder(spark)
    table(spark, sf_dir, "part").select("p_type").write.text(path)
    return loaders.load(spark, path, "words").groupBy("word").agg(F.count("*").alias("n"))


@query("loader_bag_of_words", "SELECT (l_orderkey - 1)::INTEGER AS doc, l_linenumber::INTEGER AS dim, sum(l_quantity)::DOUBLE AS val FROM lineitem GROUP BY 1, 2")
def loader_bag_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of document, word number and count, after three header lines."""
    path = _folder(spark)
    cells = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").cast("long").alias("n"))
    spark.createDataFrame([("1",), ("2",), ("3",)], "value string").coalesce(1).write.text(path)
    cells.select(F.concat_ws(" ", "l_orderkey", "l_linenumber", "n").alias("value")).write.mode("append").text(path)
    found = loaders.load(spark, path, "bag_of_words")
    return found.select("doc", F.explode("bag").alias("dim", "val")).withColumn("val", F.col("val").cast("double"))


@query("loader_files", "SELECT sum(octet_length(encode(p_type)) + 1)::BIGINT AS bytes FROM part")
def loader_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files below a folder and its subfolders, by size."""
    path = _folder(spark)
    table(spark, sf_dir, "part").select("p_type", "p_brand").write.partitionBy("p_brand").text(path)
    return loaders.files(spark, path, "part-*").agg(F.sum("length").cast("long").alias("bytes"))


@query("loader_directory", "SELECT p_brand AS name, count(*) AS lines FROM part GROUP BY 1")
def loader_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point a file, loaded by a function of the user, filtered after that: here the lines of each brand's files."""
    path = _folder(spark)
    table(spark, sf_dir, "part").select("p_type", "p_brand").write.partitionBy("p_brand").text(path)

    def lines(files: DataFrame) -> DataFrame:
        return files.select("path", (F.size(F.split(F.col("content").cast("string"), "\n")) - 1).cast("long").alias("n"))

    found = loaders.directory(spark, path, lines, "part-*", keep=F.col("n") > 0)
    brand = F.url_decode(F.url_decode(F.regexp_extract("path", "p_brand=([^/]*)", 1)))
    return found.groupBy(brand.alias("name")).agg(F.sum("n").alias("lines"))


_NEAREST = PAIRS.format(where="WHERE a.vec_id <> b.vec_id") + " SELECT {columns} FROM (SELECT q, r, dist, row_number() OVER (PARTITION BY q ORDER BY dist, r) AS k FROM p WHERE dist > 0) WHERE k = 1"


@query("sink_distances", _NEAREST.format(columns="round(dist, 6) AS dist"))
def sink_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances to nearest neighbours as text, a line a query."""
    path = _folder(spark)
    loaders.write_distances(metric_join.knn(vectors(spark, sf_dir)), path)
    return spark.read.text(path).select(F.round(F.col("value").cast("double"), 6).alias("dist"))


@query("sink_neighbours", _NEAREST.format(columns="r AS neighbour"))
def sink_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours as text, a line a query."""
    path = _folder(spark)
    loaders.write_neighbours(metric_join.knn(vectors(spark, sf_dir)), path)
    return spark.read.text(path).select(F.col("value").cast("long").alias("neighbour"))


@query("loader_graphs", """
WITH b AS (SELECT DISTINCT n_regionkey AS graph, s_nationkey AS src, 25 + s_suppkey % 7 AS dst FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT graph, src::BIGINT AS src, dst::BIGINT AS dst, 32::BIGINT AS vertices FROM b UNION ALL SELECT graph, dst, src, 32 FROM b""")
def loader_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph files, one a region: a line with a bar for each of 32 vertices, a line for each edge; read as edges both ways."""
    path = _folder(spark)
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("graph"), F.col("n_nationkey").alias("s_nationkey"))
    edges = table(spark, sf_dir, "supplier").join(nation, "s_nationkey").select("graph", F.format_string("= %d = 1 = %d", F.col("s_nationkey") + 1, 26 + F.col("s_suppkey") % 7).alias("value")).distinct()
    bars = nation.select("graph").distinct().select("graph", F.explode(F.array_repeat(F.lit("|"), 32)).alias("value"))
    edges.unionByName(bars).repartition("graph").write.partitionBy("graph").text(path)
    found, vertices = loaders.load(spark, path, "plg")
    region = F.regexp_extract("graph", "graph=([0-9]+)", 1)
    sizes = vertices.groupBy(region.cast(nation.schema["graph"].dataType).alias("graph")).agg(F.count("*").alias("vertices"))
    return found.select(region.cast(nation.schema["graph"].dataType).alias("graph"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).join(sizes, "graph")


@query("loader_colours", """
WITH c AS (SELECT p_brand AS name, (p_size % 16) / 15.0::DOUBLE AS r, (p_partkey % 11) / 10.0::DOUBLE AS g, (p_partkey % 7) / 6.0::DOUBLE AS b, (1 + p_size)::DOUBLE AS w FROM part),
x AS (SELECT name, w, (0.412453*r + 0.357580*g + 0.180423*b) / 0.950456 AS x, 0.212671*r + 0.715160*g + 0.072169*b AS y, (0.019334*r + 0.119193*g + 0.950227*b) / 1.088754 AS z FROM c),
f AS (SELECT *, CASE WHEN x > 0.008856 THEN pow(x, 1/3.0::DOUBLE) ELSE 7.787*x + 16/116.0::DOUBLE END AS fx, CASE WHEN y > 0.008856 THEN pow(y, 1/3.0::DOUBLE) ELSE 7.787*y + 16/116.0::DOUBLE END AS fy,
      CASE WHEN z > 0.008856 THEN pow(z, 1/3.0::DOUBLE) ELSE 7.787*z + 16/116.0::DOUBLE END AS fz FROM x)
SELECT name, count(*) AS colours, round(sum(w * CASE WHEN y > 0.008856 THEN 116*pow(y, 1/3.0::DOUBLE) - 16 ELSE 903.3*y END) / sum(w), 5) + 0.0 AS l,
       round(sum(w * 500*(fx - fy)) / sum(w), 5) + 0.0 AS a, round(sum(w * 200*(fy - fz)) / sum(w), 5) + 0.0 AS b FROM f GROUP BY 1""")
def loader_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour files, one a brand, with lines of blue, green, red and weight; read as signatures, of which the centroids are shown."""
    path = _folder(spark)
    part = table(spark, sf_dir, "part").select(((F.col("p_partkey") % 7) / 6).alias("b"), ((F.col("p_partkey") % 11) / 10).alias("g"), ((F.col("p_size") % 16) / 15).alias("r"), (1 + F.col("p_size")).cast("double").alias("w"), "p_brand")
    part.repartition("p_brand").write.partitionBy("p_brand").csv(path)
    found = loaders.load(spark, path, "colour").withColumn("c", colour.centroid(F.col("sig")))
    brand = F.url_decode(F.url_decode(F.regexp_extract("id", "p_brand=([^/]*)", 1)))
    return found.select(brand.alias("name"), F.size("sig").cast("long").alias("colours"), *((F.round(f"c.{x}", 5) + 0.0).alias(x) for x in ("l", "a", "b")))

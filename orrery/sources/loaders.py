"""Readers: every one gives a DataFrame of points, with an id where order counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.operators import colour, graphs

FORMATS = ("csv", "labelled", "words", "bag_of_words", "plg", "colour")


def with_row_ids(df: DataFrame, out: str = "id") -> DataFrame:
    """Ids 0, 1, ... in the order of the table: an offset for each partition and the place within it."""
    part, place = F.shiftright(F.col("_m"), 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    marked = df.withColumn("_m", F.monotonically_increasing_id())
    sizes = marked.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))  # one row a partition
    return marked.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn(out, F.col("_o") + place).drop("_m", "_p", "_o")


def _columns(spark: SparkSession, path: str) -> int:
    """The width of a headerless CSV: that of its first line."""
    first = spark.read.text(path).head()
    return len(first[0].split(",")) if first else 0


def csv(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """(id, features) of a headerless numeric CSV; a cell that is no number fails the load."""
    n = width or _columns(spark, path)
    schema = ", ".join(f"_c{k} double" for k in range(n)) or "_c0 double"
    rows = with_row_ids(spark.read.csv(path, schema=schema, header=False, mode="FAILFAST"))
    return rows.select("id", F.array(*(f"_c{k}" for k in range(max(n, 1)))).alias("features"))


def labelled_csv(spark: SparkSession, path: str, label: int, width: int | None = None) -> DataFrame:
    """(id, label, features): the column with this 0-based number is a string label, the others are the vector."""
    n = width or _columns(spark, path)
    if not 0 <= label < n:
        raise ValueError(f"no column {label} in {n}")
    schema = ", ".join(f"_c{k} {'string' if k == label else 'double'}" for k in range(n))
    rows = with_row_ids(spark.read.csv(path, schema=schema, header=False, mode="FAILFAST"))
    return rows.select("id", F.col(f"_c{label}").alias("label"), F.array(*(f"_c{k}" for k in range(n) if k != label)).alias("features"))


def words(spark: SparkSession, path: str) -> DataFrame:
    """(id, word): one string a line."""
    return with_row_ids(spark.read.text(path)).select("id", F.col("value").alias("word"))


def bag_of_words(spark: SparkSession, path: str) -> DataFrame:
    """(doc, bag): documents (from 0) as maps from word number to count; three header lines are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    cells = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") == 3)
    cells = cells.select((F.col("p")[0].cast("int") - 1).alias("doc"), F.col("p")[1].cast("int").alias("dim"), F.col("p")[2].cast("float").alias("val"))
    return cells.groupBy("doc").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("dim", "val")))).alias("bag"))


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, length) of all files below a folder; names that start with a dot are left out."""
    return _binary(spark, path, pattern).select("path", "length")


def _binary(spark: SparkSession, path: str, pattern: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def directory(spark: SparkSession, path: str, load: Callable[[DataFrame], DataFrame], pattern: str | None = None, keep=None, limit: int | None = None) -> DataFrame:
    """One point a file: filter names, take the first ``limit`` by path, load, then filter results.

    ``load`` maps a DataFrame (path, content) to one with the columns of a point beside ``path``.
    """
    found = _binary(spark, path, pattern).select("path", "content")
    if limit is not None:
        first = found.select("path").orderBy("path").limit(limit)
        found = found.join(F.broadcast(first), "path", "left_semi") if limit <= 100_000 else found.join(first, "path", "left_semi")
    out = load(found)
    return out if keep is None else out.filter(keep)


def plg(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, vertices) of PLG graph files, a graph a file; edges go both ways."""
    lines = spark.read.text(path).withColumn("path", F.input_file_name())
    return graphs.symmetrised(graphs.parse_plg(lines)), graphs.parse_plg_vertices(lines)


def colour_signatures(spark: SparkSession, path: str) -> DataFrame:
    """(id, sig) of files with lines ``b,g,r,weight``; the id is the file."""
    rows = spark.read.csv(path, schema="b double, g double, r double, w double").withColumn("file", F.input_file_name())
    return colour.signature(rows.withColumn("lab", colour.lab(F.col("r"), F.col("g"), F.col("b"))), "file", "lab", "w")


def load(spark: SparkSession, path: str, format: str = "csv", **options):
    """One entry for all formats."""
    if format not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}, not {format!r}")
    return {"csv": csv, "labelled": labelled_csv, "words": words, "bag_of_words": bag_of_words, "plg": plg, "colour": colour_signatures}[format](spark, path, **options)


def write_distances(found: DataFrame, path: str) -> None:
    """The distances of a nearest-neighbour result as text, a line a query, in query order."""
    _write(found, "dist", path)


def write_neighbours(found: DataFrame, path: str) -> None:
    _write(found, "r", path)


def _write(found: DataFrame, column: str, path: str) -> None:
    """Range-sorted part files: read in name order they are the lines in query order."""
    rows = found.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", column))).alias("x"))
    rows.orderBy("q").select(F.array_join(F.transform("x", lambda c: c[column].cast("string")), ",").alias("value")).write.text(path)

"""Small graphs as points of a metric space: tables of edges (graph, src, dst).

A graph's profile holds, for lengths 1 to 5, the number of walks of that length over the squared number of
its vertices. Distances weigh the lengths by 1, 1/2, 1/4, 1/8, 1/16, so a graph is a point of a
five-dimensional space and all metric joins apply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators import grids

LENGTHS = 5
WEIGHTS = [2.0**-k for k in range(LENGTHS)]


def symmetrised(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, each once; self loops stay single."""
    back = edges.select("graph", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("graph", "src", "dst").unionByName(back).distinct()


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select("graph", F.explode(F.array("src", "dst")).alias("v")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(graph, src, dst, weight, start): the cells of the 0/1 matrix; ``start`` is one over the number of vertices.

    A walk starts and stops at each vertex with the same chance. Graphs without edges have no row.
    """
    sizes = vertices(edges).groupBy("graph").agg((1 / F.count("*")).alias("start"))
    return edges.select("graph", "src", "dst", F.lit(1.0).alias("weight")).distinct().join(sizes, "graph")


def walk_profiles(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(graph, t, memo) for t = 1..5; graphs without vertices have no rows.

    Walk counts go along the edges by a join and a sum for each length.
    """
    edges = grids.cut(edges.select("graph", "src", "dst"))  # read at every length
    nodes = vertices(edges) if nodes is None else nodes
    # a marked edge from each vertex to itself brings its own history along, so a step reads the last one once
    marked = edges.select("graph", "src", "dst", F.lit(False).alias("own")).unionByName(nodes.select("graph", F.col("v").alias("src"), F.col("v").alias("dst"), F.lit(True).alias("own")))
    marked = grids.cut(marked)
    walks = nodes.select("graph", F.col("v").alias("src"), F.array(F.lit(1.0)).alias("h"))
    for _ in range(LENGTHS):
        here = F.max(F.when(F.col("own"), F.col("h")))
        new = F.coalesce(F.sum(F.when(~F.col("own"), F.element_at("h", -1))), F.lit(0.0))
        walks = marked.join(walks, ["graph", "src"]).groupBy("graph", F.col("dst").alias("src")).agg(F.concat(here, F.array(new)).alias("h"))
    size = F.count("*").cast("double")
    totals = walks.groupBy("graph").agg(*((F.sum(F.col("h")[t]) / (size * size)).alias(f"m{t}") for t in range(1, LENGTHS + 1)))
    cells = F.array(*(F.struct(F.lit(t).alias("t"), F.col(f"m{t}").alias("memo")) for t in range(1, LENGTHS + 1)))
    return totals.select("graph", F.explode(cells).alias("c")).select("graph", "c.*")


def points(profiles: DataFrame) -> DataFrame:
    """(graph, v): profiles as vectors whose Euclidean distance is the distance of the graphs."""
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), F.col("t"))
    cells = F.sort_array(F.collect_list(F.struct("t", (F.sqrt(weight) * F.col("memo")).alias("x"))))
    return profiles.groupBy("graph").agg(F.transform(cells, lambda c: c["x"]).alias("v"))


def walk_kernel(a: Column, b: Column) -> Column:
    """The walk kernel of two weighted profiles: walks of the product graph are products of walks."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def parse_plg(lines: DataFrame, path_col: str = "path", line_col: str = "value") -> DataFrame:
    """Edges of PLG files: lines ``= v1 = t = v2`` with vertices from 1; here from 0, the type left out."""
    parts = F.split(F.trim(F.col(line_col)), r"\s+")
    edges = lines.filter(F.col(line_col).startswith("=")).select(F.col(path_col).alias("graph"), (parts[1].cast("int") - 1).alias("src"), (parts[5].cast("int") - 1).alias("dst"))
    return edges


def parse_plg_vertices(lines: DataFrame, path_col: str = "path", line_col: str = "value") -> DataFrame:
    """(graph, v) of PLG files: one vertex for each line that starts with a bar, numbered from 0."""
    counts = lines.filter(F.col(line_col).startswith("|")).groupBy(F.col(path_col).alias("graph")).count()
    return counts.select("graph", F.explode(F.sequence(F.lit(0), F.col("count").cast("int") - 1)).alias("v"))

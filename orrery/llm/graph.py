"""Connected components of a link table, by alternating large and small stars.

The number of rounds grows with the logarithm of the longest path. Nodes and links never reach the driver. Links
lead from the greater node to the lesser. In each half of a round the links of a node meet once, by shuffle, to learn
the node's least neighbour; equal links become one there. A hub's links do not meet: the least neighbour of a node with at least 1/HEAVY of all links comes from an
aggregate that map tasks prepare, and is broadcast to its links where they lie. There are at most HEAVY such nodes.

Defined results: links with a null end and links of a node to itself are left out; repeated links count once; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from orrery.llm import common as C

#: A node with fewer links is never a hub, whatever the number of all links.
FEW = 200


def _hubs(e: DataFrame, key: str, rows: int) -> DataFrame:
    """The nodes in column ``key`` that hold so many of the ``rows`` links: HEAVY at most, with their least lesser neighbour there."""
    return e.groupBy(key).agg(F.min("v").alias("m"), F.count("*").alias("k")).filter(F.col("k") >= max(FEW, -(-rows // C.HEAVY))).drop("k")


def _large(e: DataFrame, rows: int) -> DataFrame:
    """Every node's greater neighbours are linked to the least of it and its neighbours."""
    least = e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "v")
    hubs = _hubs(e, "v", rows).select("v").join(least, "v", "left").select("v", F.coalesce("m", "v").alias("m"))
    marked = e.join(F.broadcast(hubs), "v", "left")
    light = marked.filter("m IS NULL").select("u", "v").repartition("v").distinct().join(least, "v", "left")
    return marked.filter("m IS NOT NULL").select("u", F.col("m").alias("v")).unionByName(light.select("u", F.coalesce("m", "v").alias("v")))


def _small(e: DataFrame, rows: int) -> DataFrame:
    """Every node and its lesser neighbours, which all links lead to, are linked to the least of these."""
    marked = e.join(F.broadcast(_hubs(e, "u", rows)), "u", "left")
    light = marked.filter("m IS NULL").select("u", "v").repartition("u").distinct()
    full = marked.filter("m IS NOT NULL").unionByName(light.withColumn("m", F.min("v").over(Window.partitionBy("u"))))
    return full.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def _cut(e: DataFrame) -> tuple[DataFrame, tuple[int, int | None]]:
    """The links written, their number and the sum of their hashes, both taken while they are written."""
    seen = Observation()
    e = C.cut(e.observe(seen, F.count("*").alias("rows"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")))
    return e, (seen.get["rows"], seen.get["sum"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node that has a link to another; the label is the least node reachable."""
    e, state = _cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(f"{a} <> {b}"))
    while state[0]:
        before = state
        e, state = _cut(_small(C.cut(_large(e, state[0])), state[0]))  # the small half reads the links three times
        if state == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).distinct()

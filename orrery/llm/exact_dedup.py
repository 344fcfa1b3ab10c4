"""Exact dedup by two-pass Bloom filtering, DataFrame functions only.

Pass one counts the cells of a blocked Bloom filter; a text whose cells were all set by more than
one row may be repeated. Pass two probes every row against the broadcast filter (at most 16 MB):
rows that miss it are unique and pass straight through, only the others shuffle. A false positive
costs a shuffled row, never a wrong answer.

Defined results: a null text counts as empty; texts of white space only are equal to each other and
to one space, not to the empty text; null ids rank after all others; of rows that repeat both id and
text exactly one stays; an empty table gives an empty result; extra columns are carried by
``exact_dedup`` whatever their names, and ignored by ``exact_groups``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm import common as C


def normalised(text: str | Column = "text") -> Column:
    """The text with each run of white space as one space."""
    return F.regexp_replace(C.text_or_empty(text), C.SPACE, " ")


def digest(text: str | Column = "text") -> Column:
    return F.sha2(normalised(text), 256)


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"), F.unhex(digest(text_col)).alias("key"), F.monotonically_increasing_id().alias("row")
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts never shuffle: 32-byte digests of the possibly repeated rows do, summed before the shuffle.
    """
    keys = C.cut(_digests(docs, id_col, text_col))
    total = keys.count()
    blocks = C.filter_blocks(total)
    seen = C.probe(keys, "key", C.repeated_filter(keys, "key", blocks), blocks, "again")
    hexed = F.lower(F.hex("key")).alias("text_sha256")
    alone = seen.filter(~F.col("again")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), hexed
    )
    again = seen.filter("again").drop("again")
    groups = C.cut(
        again.groupBy("key").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), F.count("*").alias("group_size")
        )
    )
    joined = C.join_groups(again, groups, "key", "group_size", total).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        hexed,
    )
    return alone.unionByName(joined)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    Unique rows pass straight through; possibly repeated rows are summed to one row a digest in each
    map task before they shuffle, so a group of any size sends one row from each task.
    """
    key, again, order = C.fresh(docs, "digest", "again", "order")
    keyed = docs.withColumn(key, F.unhex(digest(text_col)))
    keys = C.cut(keyed.select(F.col(key).alias("key")))
    blocks = C.filter_blocks(keys.count())
    seen = C.probe(keyed, key, C.repeated_filter(keys, "key", blocks), blocks, again)
    alone = seen.filter(~F.col(again)).select(*docs.columns)
    plain = [f.name for f in docs.schema.fields if f.dataType.typeName() in ("string", "long", "integer", "double", "boolean", "binary")]
    first = F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(*plain))
    kept = (
        seen.filter(again)
        .groupBy(key)
        .agg(F.min_by(F.struct(*docs.columns), first).alias(order))
        .select(f"{order}.*")
    )
    return alone.unionByName(kept)

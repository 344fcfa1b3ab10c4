"""Helpers that the operators of this subpackage share.

Everything here is a DataFrame in, DataFrame out. What reaches the driver or is broadcast has a
bound that does not depend on the input: a Bloom bitmap of at most ``MAX_FILTER_BITS`` bits, or at
most ``HEAVY`` groups (a group that holds at least 1/HEAVY of all rows; there can be no more of them).
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of one bitmap block: what ``bitmap_construct_agg`` makes (4096 bytes).
BLOCK_BITS = 32768
#: The largest filter: 2**27 bits, 16 MB. Above it more rows take the exact way; none is lost.
MAX_FILTER_BITS = 1 << 27
#: A key is heavy when it holds at least 1/HEAVY of all rows, so there are at most HEAVY such keys.
HEAVY = 1000
#: Shuffle files go at the end of an execution; safe where the result is written and the plan runs once.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: White space as the contracts define it.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> None:
    """Give the session a checkpoint folder when none is named (tests, local mode); a cluster has to name one."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster spark.checkpoint.dir has to name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="orrery-checkpoint-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the cluster names, or the session's own."""
    prepare(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is planned and run in here deletes its shuffle files when it ends, instead of when the driver collects garbage."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the cluster's checkpoint folder and go on from there; lineage and shuffle files end here."""
    prepare(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # planned anew under the setting


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet under the shared folder and read it again."""
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def trim() -> None:
    """Give freed memory of this Python worker back to the system: Spark keeps workers for later tasks."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
    if give_back is not None:
        give_back(0)


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over the batches of a task, whose memory goes back to the system at its end."""

    def g(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            trim()

    return g


def in_pieces(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``most`` bytes together, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto, lo = np.cumsum(sizes, dtype=np.int64), 0
    while lo < len(batch):
        before = int(upto[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, before + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of df has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        new = f"_{name}"
        while new.lower() in taken:
            new = "_" + new
        taken.add(new.lower())
        out.append(new)
    return out


def crc_mod(c: str | Column, mod: int) -> Column:
    """crc32 of the id as text, mod n; null for a null id."""
    return F.pmod(F.crc32((F.col(c) if isinstance(c, str) else c).cast("string").cast("binary")), F.lit(mod))


def filter_blocks(rows: int, bits_per_row: int = 16, most: int = MAX_FILTER_BITS) -> int:
    """Blocks of a Bloom filter for so many rows, 4 at least, bounded by ``most`` bits."""
    return max(4, min(most, rows * bits_per_row) // BLOCK_BITS + 1)


def _cell(key: Column, blocks: int) -> tuple[Column, Column, Column]:
    """The block of a key and its two bits in this block (a blocked Bloom filter)."""
    return (
        F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks)),
        F.pmod(F.xxhash64(key, F.lit(2)), F.lit(BLOCK_BITS)),
        F.pmod(F.xxhash64(key, F.lit(3)), F.lit(BLOCK_BITS)),
    )


def _bitmaps(cells: DataFrame) -> DataFrame:
    """(block, bit) rows as one bitmap a block; at most as many rows as the filter has blocks."""
    return cells.groupBy("block").agg(F.bitmap_construct_agg(F.col("bit")).alias("bitmap"))


def repeated_filter(df: DataFrame, key: str, blocks: int) -> DataFrame:
    """First pass over keys: the filter of the cells that more than one row sets."""
    block, one, two = _cell(F.col(key), blocks)
    cells = df.select(block.alias("block"), F.explode(F.array_distinct(F.array(one, two))).alias("bit"))
    return _bitmaps(cells.groupBy("block", "bit").count().filter("count > 1"))


def member_filter(df: DataFrame, key: str, blocks: int) -> DataFrame:
    """The Bloom filter of all keys of df."""
    block, one, two = _cell(F.col(key), blocks)
    return _bitmaps(df.select(block.alias("block"), F.explode(F.array(one, two)).alias("bit")).distinct())


def probe(df: DataFrame, key: str, bitmaps: DataFrame, blocks: int, flag: str) -> DataFrame:
    """df with a boolean column ``flag``: the filter may hold the key. Rows do not shuffle.

    The bitmaps are broadcast: at most MAX_FILTER_BITS / 8 bytes, whatever the input.
    """
    block, one, two = _cell(F.col(key), blocks)
    at, bits = fresh(df, "block", "bitmap")

    def is_set(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col(bits), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0

    joined = df.withColumn(at, block).join(
        F.broadcast(bitmaps.select(F.col("block").alias(at), F.col("bitmap").alias(bits))), at, "left"
    )
    found = F.col(bits).isNotNull() & is_set(one) & is_set(two)
    return joined.withColumn(flag, F.coalesce(found, F.lit(False))).drop(at, bits)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """Inner or left join of rows with one row a key, where single keys may hold a large part of all rows.

    Keys with at least total / HEAVY rows (at most HEAVY of them) are broadcast; their rows never
    meet in one task. The other keys are joined by shuffle, none of them larger than total / HEAVY.
    """
    least = max(1000, -(-total // HEAVY))
    heavy = groups.filter(F.col(size) >= least)
    light = groups.filter(F.col(size) < least)
    a = rows.join(F.broadcast(heavy), key)
    b = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, how)
    return a.unionByName(b)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """32 bytes that stand for a row's id and text; nulls differ from empty values."""

    def part(c: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))

    return F.unhex(F.sha2(F.concat(part(id_col), F.lit("\x1f"), part(text_col)), 256))


def one_a_key(df: DataFrame, key: str) -> DataFrame:
    """One row for each value of ``key``, the same in every run: the one whose other columns hash lowest."""
    others = [f.name for f in df.schema.fields if f.name != key]
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    whole = fresh(df, "whole")[0]
    picked = df.groupBy(key).agg(F.min_by(F.struct(*others), F.xxhash64(*plain)).alias(whole))
    return picked.select(key, f"{whole}.*")


def keep_rows(docs: DataFrame, decisions: DataFrame, keep: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that a decision table (row_key, keep) drops, all columns kept.

    Rows that miss a bounded filter of the dropped keys pass straight through; only the others
    shuffle. Of rows equal in id and text, of which some go, one stays if any does.
    """
    key, flag, verdict = fresh(docs, "row_key", "flag", "verdict")
    verdicts = cut(
        decisions.groupBy("row_key")
        .agg(F.bool_or(keep).alias(verdict), F.bool_and(keep).alias("whole"))
        .filter("NOT whole")
        .select(F.col("row_key").alias(key), verdict)
    )
    blocks = filter_blocks(verdicts.count())
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    seen = probe(keyed, key, member_filter(verdicts, key, blocks), blocks, flag)
    straight = seen.filter(~F.col(flag)).select(*docs.columns)
    judged = seen.filter(flag).join(verdicts, key, "left")
    wrong = judged.filter(F.col(verdict).isNull()).select(*docs.columns)
    one = one_a_key(judged.filter(verdict).select(key, *docs.columns), key).select(*docs.columns)
    return straight.unionByName(wrong).unionByName(one)

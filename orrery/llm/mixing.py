"""Mixing sources to target weights over fixed-length token blocks.

Tokens are the words of a text. A source's documents, in pseudorandom order, form one stream that is cut
into blocks of ``block`` tokens (the last one may be shorter). The mix is a list of slots dealt to output
shards: each shard draws its source counts from a multinomial distribution with the target shares; a last
shard takes what a source lacks and draws beyond a source's quota are left out, so every source gets its
quota of slots. A source's slots run through its blocks in passes; in each pass a pseudorandom permutation
(a Feistel network on the block numbers) says which block a slot takes, so no block is taken more than
``most`` times. Slots and blocks are joined by source and block number.

Only the table of sources (name, size, quota) reaches the driver; it may have MAX_SOURCES rows, more raise
an error. Offsets in a stream come from sums over hash ranges in two levels, and starts of a shard's slots from sums
over groups of shards, so no source meets in one task. A source's slots of one shard are dealt out in ranges of
SLOT_RANGE at most.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents of
size 0 are never taken; sources of size 0 have target 0; repeated rows are documents of their own; an
empty table gives an empty result; extra columns are ignored, or carried by ``mixed_documents``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm import common as C

MAX_SOURCES = 1_000_000
#: Slots of one range, documents of a hash range, and hash ranges (or shards) whose sums are added up at once.
SLOT_RANGE, RANGE_DOCS, GROUP = 50_000, 250, 1000
WEIGHTS = (5.0, 2.0, 1.0)
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: np.ndarray, weights: np.ndarray, total: float, most: float) -> np.ndarray:
    """Shares of total by weight, none above ``most`` times its size; the excess goes to the others by weight."""
    cap = most * sizes
    capped = np.zeros(len(sizes), dtype=bool)
    while True:
        free = weights[~capped].sum()
        level = (total - cap[capped].sum()) / free if free else 0.0
        more = ~capped & (level * weights > cap)
        if not more.any():
            return np.where(capped, cap, level * weights)
        capped |= more


def permute(x: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Image of x under a pseudorandom permutation of 0..size-1 chosen by key; all arrays of one length."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2)
    mask = (np.int64(1) << half) - 1
    x, todo = x.copy(), np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        a, b = x[todo] >> h, x[todo] & m
        for r in range(4):
            z = (b.astype(np.uint64) + k + np.uint64((r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            a, b = b, a ^ ((z >> np.uint64(32)).astype(np.int64) & m)
        x[todo] = (a << h) | b
        todo = todo[x[todo] >= size[todo]]
    return x


def offsets(sums: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """sums (one row for each key and order, orders from 0 on) with ``out``: the sum of value over the key's lower orders.

    Orders are added up in groups of GROUP, and the sums of groups among each other.
    """
    grouped = sums.withColumn("_group", F.expr(f"{order} div {GROUP}"))
    earlier = Window.partitionBy(key).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    whole = grouped.groupBy(key, "_group").agg(F.sum(value).alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    within = Window.partitionBy(key, "_group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = grouped.withColumn("_before", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inside.join(whole.drop("_sum"), [key, "_group"]).withColumn(out, F.col("_base") + F.col("_before")).drop("_group", "_base", "_before")


class Mix:
    """The tables of one mix. ``sources``: rank, source, source_size, target, blocks, quota."""

    def __init__(self, docs: DataFrame, weight: Callable[[int, str | None], float] | None = None, total_share: float = 1.0, most: int = 3, block: int = 32, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_slots: int = 65_536):
        self.block, self.seed, self.most = block, seed, most
        spark = docs.sparkSession
        self.docs = C.cut(
            docs.select(
                F.col(id_col).alias("doc_id"),
                F.col(source_col).cast("string").alias("source"),
                F.regexp_count(C.text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"),
                C.row_key(id_col, text_col).alias("row_key"),
            ).withColumn("row", F.monotonically_increasing_id())
        )
        found = self.docs.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).limit(MAX_SOURCES + 1).collect()
        if len(found) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = np.array([r["n"] for r in found], dtype=np.float64)
        weights = np.array([weight(k, r["source"]) if weight else WEIGHTS[k % len(WEIGHTS)] for k, r in enumerate(found)], dtype=np.float64)
        target = targets(sizes, weights, total_share * sizes.sum(), most)
        blocks = np.ceil(sizes / block).astype(np.int64)
        quota = np.minimum(np.rint(target * blocks / np.maximum(sizes, 1)).astype(np.int64), most * blocks)
        self.quota, self.n_blocks = quota, blocks
        rows = [(k, r["source"], int(r["n"]), float(t), int(b), int(q)) for k, (r, t, b, q) in enumerate(zip(found, target, blocks, quota, strict=True))]
        self.sources = spark.createDataFrame(rows, "rank long, source string, source_size long, target double, blocks long, quota long")
        total = int(quota.sum())
        self.shards = max(1, -(-total // shard_slots))
        self.parts = max(1, sum(r["docs"] for r in found) // RANGE_DOCS)

    def slots(self) -> DataFrame:
        """(shard, rank, slot, block_no) for every slot of the mix."""
        quota, blocks, seed, shards = self.quota, self.n_blocks, self.seed, self.shards
        total = int(quota.sum())
        spark = self.sources.sparkSession
        p = quota / max(1, total)

        def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for shard in pdf["id"]:
                    n = total // shards + (shard < total % shards)
                    drawn = np.random.default_rng([seed, int(shard)]).multinomial(n, p)
                    rank = np.flatnonzero(drawn)
                    yield pd.DataFrame({"shard": shard, "rank": rank, "n": drawn[rank]})

        def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for shard, rank, lo, n in pdf[["shard", "rank", "start", "n"]].itertuples(index=False):
                    if n > 0:
                        slot = np.arange(lo, lo + n, dtype=np.int64)
                        turn, size = slot // blocks[rank], np.full(len(slot), blocks[rank])
                        key = turn * 1_000_003 + rank * 7_919 + seed * 104_729 + 1
                        yield pd.DataFrame({"shard": shard, "rank": rank, "slot": slot, "block_no": permute(slot % blocks[rank], size, key)})

        if not total:
            return spark.createDataFrame([], "shard long, rank long, slot long, block_no long")
        drawn = spark.range(shards).mapInPandas(C.lean(draw), "shard long, rank long, n long")
        placed = offsets(drawn, "rank", "shard", "n", "start")
        limit = F.broadcast(self.sources.select("rank", "quota"))  # at most MAX_SOURCES rows
        placed = placed.join(limit, "rank").withColumn("n", F.least("n", F.greatest(F.col("quota") - F.col("start"), F.lit(0))))
        lack = self.sources.select("rank", "quota").join(placed.groupBy("rank").agg(F.sum("n").alias("has")), "rank", "left")
        lack = lack.select(F.lit(shards).cast("long").alias("shard"), "rank", F.coalesce("has", F.lit(0)).alias("start"), (F.col("quota") - F.coalesce("has", F.lit(0))).alias("n"))
        both = placed.select("shard", "rank", "start", "n").unionByName(lack).filter("n > 0")
        ranged = both.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SLOT_RANGE).cast("long"))))
        ranged = ranged.select("shard", "rank", (F.col("start") + F.col("at")).alias("start"), F.least(F.lit(SLOT_RANGE).cast("long"), F.col("n") - F.col("at")).alias("n"))
        # a count of its own: what a task makes, not the few rows it reads, is to be bounded
        return ranged.repartition(max(1, total // (4 * SLOT_RANGE)), "rank", "start").mapInPandas(C.lean(spread), "shard long, rank long, slot long, block_no long")

    def spans(self) -> DataFrame:
        """(row, doc_id, row_key, rank, block_no, lo, hi): the words lo..hi-1 of a document that lie in a block."""
        docs = self.docs.filter("size > 0").join(F.broadcast(self.sources.select("rank", F.col("source").alias("s"))), F.col("source").eqNullSafe(F.col("s")))
        docs = docs.withColumn("h", F.xxhash64("row_key", F.lit(self.seed)))
        docs = docs.withColumn("part", F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * self.parts).cast("long"))
        base = offsets(docs.groupBy("rank", "part").agg(F.sum("size").alias("n")), "rank", "part", "n", "base").drop("n")
        within = Window.partitionBy("rank", "part").orderBy("h", "row_key", "row").rowsBetween(Window.unboundedPreceding, -1)
        docs = docs.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(base, ["rank", "part"])
        docs = docs.withColumn("at", F.col("base") + F.col("before"))
        b = self.block
        docs = docs.withColumn("block_no", F.explode(F.sequence(F.expr(f"at div {b}"), F.expr(f"(at + size - 1) div {b}"))))
        return docs.select(
            "row", "doc_id", "row_key", "rank", "size", "block_no",
            F.greatest(F.lit(0), F.col("block_no") * b - F.col("at")).alias("lo"),
            F.least("size", (F.col("block_no") + 1) * b - F.col("at")).alias("hi"),
        )

    def uses(self) -> DataFrame:
        """spans with ``times``: how often the mix takes them."""
        times = self.slots().groupBy("rank", "block_no").agg(F.count("*").alias("times"))
        # consecutive numbers compress so well that the size of their shuffle says nothing of a broadcast table's
        return self.spans().join(times.hint("merge"), ["rank", "block_no"], "left").withColumn("times", F.coalesce("times", F.lit(0)))

    def documents(self) -> DataFrame:
        """doc_id, source, size, source_size, target, taken of every document."""
        taken = self.uses().groupBy("row", "doc_id", "size", "rank").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken"))
        about = F.broadcast(self.sources)
        full = taken.join(about, "rank").select("doc_id", "source", "size", "source_size", "target", "taken")
        none = self.docs.filter("size = 0").select("doc_id", F.col("source").alias("s"), "size").join(about, F.col("s").eqNullSafe(F.col("source")))
        return full.unionByName(none.select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str = "n_chars", **options) -> DataFrame:
    """The mix as documents: one row for each time that a document is taken, whole or in part.

    A document whose spans are taken 3, 1, 2 times gives three rows: all spans, the first and third, the
    first. Rows equal in id and text take the other columns of one of them, the same in every run. Neighbouring spans keep the text between them; others are set apart by a line end.
    """
    mix = Mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    spans, key, again = C.fresh(docs, "spans", "row_key", "again")
    plan = (
        mix.uses().filter("times > 0").groupBy("row", "row_key").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "times"))).alias(spans))
        .select(F.col("row_key").alias(key), spans)
    )
    texts = C.one_a_key(docs.withColumn(key, C.row_key(id_col, text_col)), key)
    joined = texts.join(plan, key).drop(key)
    word, names = re.compile(WORD), docs.columns

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in C.in_pieces(whole, text_col)):
            rows = []
            for row in batch.to_pylist():
                text = row[text_col]
                words = [m.span() for m in word.finditer(text)]
                taken = row.pop(spans)
                for turn in range(1, 1 + max(s["times"] for s in taken)):
                    runs: list[list[int]] = []
                    for s in taken:
                        if s["times"] >= turn:
                            if runs and runs[-1][1] == s["lo"]:
                                runs[-1][1] = s["hi"]
                            else:
                                runs.append([s["lo"], s["hi"]])
                    part = text if runs == [[0, len(words)]] else "\n".join(text[words[a][0] : words[b - 1][1]] for a, b in runs)
                    rows.append(row | {text_col: part} | ({length_col: len(part)} if length_col in row else {}))
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([batch.schema.field(n) for n in names]))

    return joined.select(*names, spans).mapInArrow(C.lean(cut_out), docs.schema)

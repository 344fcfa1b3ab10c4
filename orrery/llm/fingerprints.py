"""SimHash document fingerprints and search within a Hamming radius.

A text's terms are its shingles of five words (fewer words: the whole text), weighted by the bit length of
their counts. Each term's 64-bit hash votes, with its weight, for or against every bit; the fingerprint has
the bits with more votes for than against, as 16 hex digits. Likeness is 1 - distance / 64.

Search: the 64 bits are cut into ``radius + 3`` blocks. Two fingerprints within the radius agree on all
bits of three blocks at least, so one table for each choice of three blocks (a permutation of the blocks
with these in front) finds every match as an equal key, and the distance is then computed. Rows of the
searched side that share no key with a query are left out by a bounded Bloom filter before the shuffle.

Defined results: null and empty texts, and texts without words, have the fingerprint of sixteen zeros;
equal texts have equal fingerprints; null ids rank last in ``with_next``; rows equal in id are ordered by
text; the one document of a table follows itself; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm import common as C
from orrery.llm import hashing

WIDTH = 5


def simhash(words: np.ndarray, width: int = WIDTH) -> int:
    """The fingerprint of a text's word hashes."""
    terms, counts = np.unique(hashing.shingle_hashes(words, width), return_counts=True)
    if not len(terms):
        return 0
    weights = np.floor(np.log2(counts)) + 1
    bits = np.unpackbits(terms.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = weights @ bits.astype(np.float64)  # whole numbers, so exact in any order
    return int(np.packbits(2 * votes > weights.sum(), bitorder="little").view(np.uint64)[0])


def of_texts(texts: list[str | None]) -> list[int]:
    out = []
    for lo, hi in hashing.in_pieces(texts):
        words, at = hashing.word_hashes(texts[lo:hi])
        out += [simhash(words[at[k] : at[k + 1]]) for k in range(hi - lo)]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([f"{x:016x}" for x in of_texts(b.column("text").to_pylist())], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(C.lean(f), "doc_id long, fingerprint string")


def edit(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the start of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / 64


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())]
)
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int, edge string, text string"


def _compared(ids: list, texts: list[str], prints: list[int], after: list[str], after_prints: list[int]) -> list[tuple]:
    edited = [edit(t, n) for t, n in zip(texts, after, strict=True)]
    changed = of_texts(edited)
    return [
        (i, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), f"{p:016x}", f"{c:016x}", _likeness(p, c), _likeness(p, q), None, None, None)
        for i, t, e, p, c, q in zip(ids, texts, edited, prints, changed, after_prints, strict=True)
    ]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition: every row with its follower; the first and the last row go on as edges."""
    from pyspark import TaskContext

    part, held = TaskContext.get().partitionId(), None
    for b in (piece for whole in batches for piece in C.in_pieces(whole)):
        i, t = b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
        p = of_texts(t)
        rows = []
        if held is None:
            rows.append((i[0], None, None, None, None, None, None, part, "first", t[0]))
        else:
            i, t, p = [held[0], *i], [held[1], *t], [held[2], *p]
        rows += _compared(i[:-1], t[:-1], p[:-1], t[1:], p[1:])
        held = i[-1], t[-1], p[-1]
        yield _batch(rows)
    if held is not None:
        yield _batch([(held[0], None, None, None, None, None, None, part, "last", held[1])])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, after = b.column("text").to_pylist(), b.column("after").to_pylist()
        yield _batch(_compared(b.column("doc_id").to_pylist(), texts, of_texts(texts), after, of_texts(after)))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the next document.

    The next document is the next lower id (after the lowest: the highest). Texts move once, into ranges
    of ids; only the first and last text of a range meet those of its neighbours, by a join.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    down = F.col("doc_id").desc_nulls_last()
    ranged = slim.repartitionByRange(n, down).sortWithinPartitions(down, F.col("text").desc_nulls_last())
    found = C.cut(ranged.mapInArrow(C.lean(_neighbours), _DDL))
    inner = found.filter("edge IS NULL")
    first = found.filter("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("after"))
    # one row a range, without texts: its successor, and the first range after the last one
    order = found.filter("edge = 'first'").select("part")
    around = Window.orderBy("part")
    ends = order.select("part", F.lead("part").over(around).alias("next_part"), F.min("part").over(Window.partitionBy()).alias("start"))
    ends = ends.select("part", F.coalesce("next_part", "start").alias("next_part"))
    last = found.filter("edge = 'last'").select("doc_id", "part", "text").join(ends, "part").join(first, "next_part")
    outer = last.select("doc_id", "text", "after").mapInArrow(C.lean(_edges), _DDL)
    return inner.unionByName(outer).drop("part", "edge", "text")


def _keys(print_: Column, radius: int) -> Column:
    """The table keys of a fingerprint (a long): one for each choice of three blocks."""
    blocks = radius + 3
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    keys = []
    for k, chosen in enumerate(itertools.combinations(masks, 3)):
        mask = sum(chosen)
        keys.append(F.xxhash64(F.lit(k), print_.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return F.array(*keys)


def _as_long(c: str) -> Column:
    high, low = (F.conv(F.substring(c, at, 8), 16, 10).cast("long") for at in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


def search(queries: DataFrame, table: DataFrame, radius: int = 3, column: str = "fingerprint") -> DataFrame:
    """(query, match, distance): all distinct fingerprints of table within the radius of each distinct query.

    Copies are one fingerprint here; join the tables back on it for their documents.
    """
    wanted = queries.select(F.col(column).alias("query")).filter("query IS NOT NULL").distinct()
    asked = C.cut(wanted.withColumn("q", _as_long("query")).select("query", "q", F.explode(_keys(F.col("q"), radius)).alias("key")))
    blocks = C.filter_blocks(asked.count())
    held = table.select(F.col(column).alias("match")).filter("match IS NOT NULL").distinct().withColumn("m", _as_long("match"))
    held = held.select("match", "m", F.explode(_keys(F.col("m"), radius)).alias("key"))
    near = C.probe(held, "key", C.member_filter(asked, "key", blocks), blocks, "maybe").filter("maybe").drop("maybe")
    distance = F.bit_count(F.col("q").bitwiseXOR(F.col("m")))
    return asked.join(near, "key").filter(distance <= radius).select("query", "match", distance.alias("distance")).distinct()

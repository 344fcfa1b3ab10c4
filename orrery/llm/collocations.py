"""Collocations: phrases whose words stand together more often than their frequencies explain.

The corpus is a weighted de Bruijn graph for each language. Edges are the grams of ``WIDTH`` words, weighted by how
often they occur; nodes are the grams of one word less at which they overlap. Only edges are counted, and the shorter
grams at which pieces of text end: the count of a node is what flows out of it plus what ends there, and the
same step gives the counts of words from those of nodes. A node with one way in and one way out is the inside of
a path; such paths are compacted, their nodes have the weight of the path and are nobody's candidates.

Counting is summed in each block of texts before it shuffles, and grams travel in sorted compressed packets by
hash of the gram, so a frequent gram has one entry a block and no task holds all grams of a word or node. Joins
with the counts of words deal out frequent words. The number of packets' parts, and of the tasks that sum them, follows the
size of the input.

Text: A-Z lower-cased, cut into pieces at ``. , ; : ! ?`` and at line ends, pieces into words at spaces and tabs.

Defined results: a null language counts as ``und``, a null text as empty; ids take no part; repeated rows count each; pieces
and texts of any length are counted whole, a text at a time; ties rank by count, then by phrase in byte order; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm import common as C
from orrery.llm.hashing import mix
from orrery.llm.packing import pack_codes, squeeze, unpack_codes, unsqueeze

#: Words of an edge.
WIDTH = 3
#: Bytes of text of a block, and characters of the input for each part.
BLOCK, PART = 8 << 20, 8_000_000
_KIND = np.zeros(256, dtype=np.uint8)  # 0: of a word, 1: between words, 2: between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[0x0A, 0x0B, 0x0C, 0x0D, *b".,;:!?"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20260311).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE, _TAB = 0x20, 0x09

#: Grams are strings ``words TAB language``; words hold no tab, so the first one divides.
Grams = tuple[pa.Array, np.ndarray]


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of an array of large binaries."""
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, the text and the piece of each) of a block of texts."""
    raw, offsets = _buffers(texts.cast(pa.large_binary()))
    raw = _LOWER[raw]
    kind = _KIND[raw]
    begins = np.zeros(len(raw) + 1, dtype=bool)
    begins[offsets[:-1]] = True
    begins = begins[:-1]
    word = kind == 0
    first = word.copy()
    first[1:] &= ~word[:-1] | begins[1:]
    starts = np.flatnonzero(first)
    sizes = np.add.reduceat(word, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    piece = np.cumsum((kind == 2) | begins)[starts]
    return _strings(raw[word], sizes), np.searchsorted(offsets, starts, side="right") - 1, piece


def block_grams(texts: pa.Array, langs: pa.Array) -> Grams:
    """Every gram of WIDTH words of a block and the shorter ones at the ends of its pieces, with their counts."""
    words, text, piece = _words(texts)
    n = len(words)
    if not n:
        return _strings(np.zeros(0, np.uint8), np.zeros(0, np.int64)), np.zeros(0, np.int64)
    coded, lang = words.dictionary_encode(), pc.cast(langs, pa.large_binary()).dictionary_encode()
    ids, none = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)

    def after(k: int) -> np.ndarray:
        """The word k places on in the same piece."""
        out = np.full(n, none, dtype=np.int64)
        same = piece[k:] == piece[: n - k]
        out[: n - k][same] = ids[k:][same]
        return out

    rest, tail = np.unique(after(1) * (none + 1) + after(2), return_inverse=True)
    head = lang.indices.to_numpy().astype(np.int64)[text] * none + ids
    keys, counts = np.unique(head * len(rest) + tail, return_counts=True)
    head, tail = keys // len(rest), rest[keys % len(rest)]
    columns = [head % none, tail // (none + 1), tail % (none + 1)]
    cells = [coded.dictionary.take(pa.array(c, mask=c == none)) for c in columns]
    phrases = pc.binary_join_element_wise(*cells, pa.scalar(b" ", pa.large_binary()), null_handling="skip")
    grams = pc.binary_join_element_wise(phrases, lang.dictionary.take(pa.array(head // none)), pa.scalar(b"\t", pa.large_binary()))
    return grams, counts.astype(np.int64)


def _hashes(strings: pa.Array, most: int = 50_000) -> np.ndarray:
    """A 64-bit hash of each string, none of them empty; ``most`` strings at a time, since every byte takes several words."""
    out = [np.zeros(0, np.uint64)]
    for lo in range(0, len(strings), most):
        raw, offsets = _buffers(strings.slice(lo, most))
        place = np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets))
        powers = np.full(int(place.max(initial=0)) + 1, _BASE, dtype=np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        out.append(mix(np.add.reduceat(_BYTE[raw] * powers[place], offsets[:-1])))
    return np.concatenate(out)


def _packets(grams: Grams, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, packet) of grams, dealt by hash."""
    strings, counts = grams
    if not len(strings):
        return
    part = (_hashes(strings) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    strings, counts, part = strings.take(pa.array(order)), counts[order], part[order]
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        raw, offsets = _buffers(strings.slice(lo, hi - lo))
        yield int(part[lo]), squeeze(pack_codes(np.diff(offsets)), raw.tobytes(), pack_codes(counts[lo:hi]))


def _summed(strings: pa.Array, counts: np.ndarray) -> Grams:
    found = pa.table({"gram": strings, "c": counts}).group_by("gram", use_threads=False).aggregate([("c", "sum")]).combine_chunks()
    if not len(found):
        return _strings(np.zeros(0, np.uint8), np.zeros(0, np.int64)), np.zeros(0, np.int64)
    return found.column("gram").chunk(0), found.column("c_sum").to_numpy()


def _merged(packets: list[bytes]) -> Grams:
    strings, counts = [], []
    for packet in packets:
        sizes, raw, c = unsqueeze(packet)
        strings.append(_strings(np.frombuffer(raw, np.uint8), unpack_codes(sizes)))
        counts.append(unpack_codes(c))
    return _summed(pa.concat_arrays(strings), np.concatenate(counts))


def _shortened(strings: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the grams without their last words, how many words each had); a gram of one word keeps its language alone."""
    raw, offsets = _buffers(strings)
    tabs, spaces = np.flatnonzero(raw == _TAB), np.flatnonzero(raw == _SPACE)
    tab = tabs[np.searchsorted(tabs, offsets[:-1])]
    upto, before = np.searchsorted(spaces, tab), np.searchsorted(spaces, offsets[:-1])
    length = upto - before + 1
    last = offsets[:-1].copy()
    last[length > 1] = spaces[upto[length > 1] - 1]
    edge = np.zeros(len(raw) + 1, dtype=np.int8)
    np.add.at(edge, last, 1)
    np.add.at(edge, tab, -1)
    keep = np.cumsum(edge[:-1], dtype=np.int8) == 0
    return _strings(raw[keep], np.diff(offsets) - (tab - last)), length


_ROWS = pa.schema([("part", pa.int64()), ("packet", pa.binary()), ("lang", pa.string()), ("phrase", pa.string()), ("c", pa.int64())])
_DDL = "part long, packet binary, lang string, phrase string, c long"


def _batch(packets: list[tuple[int, bytes]], rows: list[tuple[str, str | None, int]]) -> pa.Table:
    n, m = len(packets), len(rows)
    lang, phrase, c = zip(*rows, strict=True) if rows else ((), (), ())
    columns = [[p for p, _ in packets] + [None] * m, [b for _, b in packets] + [None] * m, [None] * n + list(lang), [None] * n + list(phrase), [None] * n + list(c)]
    return pa.table([pa.array(x, f.type) for x, f in zip(columns, _ROWS, strict=True)], schema=_ROWS)


def _blocks(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts to packets of grams, a block at a time."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            block = pa.Table.from_batches(held).combine_chunks()
            texts, langs = (block.column(c).combine_chunks() for c in ("text", "lang"))
            texts, langs = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (texts, langs))
            yield from _batch(list(_packets(block_grams(texts, langs), parts)), []).to_batches()

        for batch in batches:
            for piece in C.in_pieces(batch, most=BLOCK // 2):
                held.append(piece)
                size += pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0
                if size >= BLOCK // 2:
                    yield from packed()
                    held, size = [], 0
        if held:
            yield from packed()

    return f


def _level(width: int, least: int, parts: int) -> Callable[[pa.Table], pa.Table]:
    """Sum a part's grams; those of ``width`` words become rows when frequent, and flow on into their first words."""

    def f(table: pa.Table) -> pa.Table:
        strings, counts = _merged(table.column("packet").to_pylist())
        shorter, length = _shortened(strings)
        here = length == width
        rows = []
        for gram, c in zip(strings.filter(pa.array(here & (counts >= least))).to_pylist(), counts[here & (counts >= least)].tolist(), strict=True):
            phrase, _, lang = gram.decode().partition("\t")
            rows.append((lang, phrase, c))
        if width > 1:
            below = pa.concat_arrays([shorter.filter(pa.array(here)), strings.filter(pa.array(~here))])
            out = _batch(list(_packets(_summed(below, np.concatenate([counts[here], counts[~here]])), parts)), rows)
        else:  # the words of each language
            langs, sums = _summed(shorter, counts)
            rows += [(lang.decode()[1:], None, c) for lang, c in zip(langs.to_pylist(), sums.tolist(), strict=True)]
            out = _batch([], rows)
        C.trim()
        return out

    return f


def graph(docs: DataFrame, least: int = 10, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(edges, nodes, words: (lang, phrase, f) with f >= least; sizes: (lang, n)) of a corpus, stored.

    Edges have WIDTH words, nodes one less, words one. ``n`` counts all words of a language.
    """
    slim = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), C.text_or_empty(F.col(text_col).cast("string")).alias("text"))
    parts = 32 + (slim.agg(F.sum(F.length("text"))).first()[0] or 0) // PART
    packets = slim.mapInArrow(C.lean(_blocks(parts)), _DDL)
    levels = []
    for width in range(WIDTH, 0, -1):
        summed = C.stored(packets.select("part", "packet").repartition(parts, "part").groupBy("part").applyInArrow(_level(width, least, parts), _DDL))
        levels.append(summed.filter("phrase IS NOT NULL").select("lang", "phrase", F.col("c").alias("f")))
        packets = summed.filter("packet IS NOT NULL")
    sizes = summed.filter("lang IS NOT NULL AND phrase IS NULL").groupBy("lang").agg(F.sum("c").alias("n"))
    edges, nodes, words = levels
    return edges, nodes, words, sizes


def _head(phrase: str = "phrase") -> Column:
    return F.substring_index(phrase, " ", WIDTH - 1)


def _tail(phrase: str = "phrase") -> Column:
    return F.substring_index(phrase, " ", -(WIDTH - 1))


def through(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes with ``most``, the weight of their heaviest edge, and ``inside``: exactly one edge comes in and one goes out.

    An edge that has the whole count of a node is its only one on that side, and no piece begins or ends there.
    """
    ends = [edges.select("lang", at().alias("phrase"), F.col("f").alias(side), F.lit(0).cast("long").alias(other)) for at, side, other in ((_head, "leaves", "enters"), (_tail, "enters", "leaves"))]
    sides = ends[0].unionByName(ends[1]).groupBy("lang", "phrase").agg(F.max("enters").alias("enters"), F.max("leaves").alias("leaves"))
    both = nodes.join(sides, ["lang", "phrase"], "left")
    most = F.coalesce(F.greatest("enters", "leaves"), F.lit(0))
    inside = F.coalesce((F.col("enters") == F.col("f")) & (F.col("leaves") == F.col("f")), F.lit(False))
    return both.select("lang", "phrase", "f", most.alias("most"), inside.alias("inside"))


def paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(lang, phrase, f, edges): the compacted graph, each maximal path without branches as one phrase.

    A step doubles what every edge knows of its path, so a path of n edges takes log2(n) steps. A ring of edges, which
    no text makes, has no first one and stays as its edges.
    """
    steps = edges.count().bit_length() + 1
    inside = through(edges, nodes).filter("inside").select("lang", F.col("phrase").alias("node"))
    plain = edges.select("lang", "phrase", "f", _head().alias("head"), _tail().alias("tail"))
    # first: the first edge of what is known so far; steps: how far it lies back
    before = plain.join(inside, (plain["lang"] == inside["lang"]) & (plain["tail"] == inside["node"]), "left_semi").select("lang", F.col("tail").alias("head"), F.col("phrase").alias("first"))
    now = C.cut(plain.join(before, ["lang", "head"], "left").select("lang", "phrase", "f", F.coalesce("first", "phrase").alias("first"), F.col("first").isNotNull().cast("long").alias("steps"), F.col("first").isNull().alias("done")))
    # an edge is done when its first one begins the path; every step after that changes nothing
    for _ in range(steps):
        if now.filter("NOT done").isEmpty():
            break
        known = now.select("lang", F.col("phrase").alias("first"), F.col("first").alias("next"), F.col("steps").alias("more"), F.col("done").alias("ended"))
        now = C.cut(now.join(known, ["lang", "first"]).select("lang", "phrase", "f", F.when(F.col("done"), F.col("first")).otherwise(F.col("next")).alias("first"), (F.col("steps") + F.when(F.col("done"), 0).otherwise(F.col("more"))).alias("steps"), (F.col("done") | F.col("ended")).alias("done")))
    ring = ~F.col("done")
    keyed = now.withColumns({"first": F.when(ring, F.col("phrase")).otherwise(F.col("first")), "steps": F.when(ring, 0).otherwise(F.col("steps"))})
    grouped = keyed.groupBy("lang", "first").agg(F.sort_array(F.collect_list(F.struct("steps", "phrase"))).alias("way"), F.first("f").alias("f"), F.count("*").alias("edges"))
    words = F.concat_ws(" ", F.col("first"), F.transform(F.slice("way", 2, F.greatest(F.size("way") - 1, F.lit(1))), lambda e: F.substring_index(e["phrase"], " ", -1)))
    return grouped.select("lang", words.alias("phrase"), "f", "edges")


#: floor(1000000 a^2 / (l r)) of one cut, exact for counts below 10^15.
_SCORE = "CAST(1000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0)) div (CAST({l} AS DECIMAL(15, 0)) * CAST({r} AS DECIMAL(15, 0)))"


def _with_counts(candidates: DataFrame, words: DataFrame, word: str, out: str) -> DataFrame:
    """candidates with the count of their column ``word``; those of a frequent word are dealt out."""
    keyed = candidates.withColumn("key", F.concat_ws("\t", word, "lang"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size"))
    counts = words.select(F.concat_ws("\t", "phrase", "lang").alias("key"), F.col("f").alias(out)).join(sizes, "key")
    return C.join_groups(keyed, counts, "key", "size", candidates.count()).drop("key", "size")


def candidates(edges: DataFrame, nodes: DataFrame, words: DataFrame, share: int = 50) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the edges and of the nodes that no edge with ``share`` of 100 of their count holds.

    l and r are the counts of the two parts of the cut that scores lowest, the first of equal ones.
    """
    known = C.cut(through(edges, nodes))
    branching = known.filter("NOT inside")
    # the count of a node inside a path is the weight of the path's edges
    counts = branching.select("lang", F.col("phrase").alias("node"), F.col("f").alias("weight"))
    ends = edges.select("lang", "phrase", F.col("f").alias("a"), _head().alias("head"), _tail().alias("tail"))
    for side, out in (("head", "l2"), ("tail", "r1")):
        ends = ends.join(counts.withColumnsRenamed({"node": side, "weight": out}), ["lang", side], "left").withColumn(out, F.coalesce(out, "a"))
    long = ends.select("lang", "phrase", "a", "r1", "l2")
    short = branching.filter(100 * F.col("most") < share * F.col("f")).select("lang", "phrase", F.col("f").alias("a"), F.lit(None).cast("long").alias("r1"), F.lit(None).cast("long").alias("l2"))
    every = C.cut(long.unionByName(short).withColumns({"first": F.substring_index("phrase", " ", 1), "last": F.substring_index("phrase", " ", -1)}))
    every = _with_counts(_with_counts(every, words, "first", "l1"), words, "last", "r2")
    every = every.withColumn("r1", F.coalesce("r1", "r2"))
    one, two = F.expr(_SCORE.format(l="l1", r="r1")), F.when(F.col("l2").isNotNull(), F.expr(_SCORE.format(l="coalesce(l2, 1)", r="r2")))
    scored = every.withColumns({"one": one, "two": two})
    second = F.coalesce(F.col("two") < F.col("one"), F.lit(False))
    picked = {"l": F.when(second, F.col("l2")).otherwise(F.col("l1")), "r": F.when(second, F.col("r2")).otherwise(F.col("r1")), "score": F.when(second, F.col("two")).otherwise(F.col("one"))}
    return scored.withColumns(picked).select("lang", "phrase", "a", "l", "r", "score")


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by score, count and phrase."""
    edges, nodes, words, sizes = graph(docs, least, text_col, lang_col)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = candidates(edges, nodes, words, share).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

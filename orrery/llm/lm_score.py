"""Language-model scores of documents by context-tree weighting over bytes.

Every byte is eight binary decisions; each decision has a context tree over the DEPTH bytes before it.
A node's Krichevsky-Trofimov estimate and its children are mixed half and half (Willems, Shtarkov and
Tjalkens 1995), so a prediction mixes the estimates of all depths, weighted by how well they coded the
training bytes. Texts are framed by the byte 0xFF, which UTF-8 never holds: DEPTH of them stand before
the first byte and one, which is scored, after the last.

How it runs: tasks turn texts into blocks and count, a block at a time, distinct words and distinct
strings of DEPTH+1 bytes. These counts shuffle by hash (words) and by the last two context bytes
(strings), where they are summed over the corpus and the trees below two bytes are weighted; the two
top levels of the tree (at most 257 x 255 nodes) are weighted on the driver. Values return to their
blocks and are summed over each text there. A frequent word or string has one entry in each block.

Beside the model's score there is a base score: an add-one unigram word model with an end token.

Defined results: a null text counts as empty (an end token only); null ids are scored and learned from;
without training rows every count is zero; repeated rows count as often as they occur; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm import common as C
from orrery.llm import packing as P
from orrery.llm.bpe import _partition

#: Bytes of context.
DEPTH = 5
#: Characters of a block, and of a piece that is worked on at once.
BLOCK_CHARS, PIECE_CHARS = 20_000_000, 1_000_000
FRAME = b"\xff"
_BITS = np.arange(8)
TEXT, WORDS, STRINGS = 0, 1, 2


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x >= 0.5: Stirling's series after a shift by eight."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    i = 1 / (z * z)
    series = (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i * (1 / 1680 - i / 1188)))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1.0)


def strings(framed: bytes, depth: int) -> np.ndarray:
    """The integer of each depth + 1 consecutive bytes."""
    a = np.frombuffer(framed, np.uint8)
    n = max(0, len(a) - depth)
    g = np.zeros(n, dtype=np.int64)
    for k in range(depth + 1):
        g = (g << 8) | a[k : k + n]
    return g


def _nodes(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string the eight nodes that its last byte passes, and the bit taken there."""
    y = (grams & 255)[:, None]
    return (1 << _BITS) | (y >> (8 - _BITS)), (y >> (7 - _BITS)) & 1


def _weigh(grams: np.ndarray, counts: np.ndarray, depth: int, least: int):
    """Weights of the trees below ``least`` context bytes, for sorted distinct strings.

    Returns (keys, zeros, ones, ln P_w) of the nodes at depth ``least`` and, for each string and bit,
    the probability of a one given by the depths from ``least`` on.
    """
    node, bit = _nodes(grams)
    weight = np.repeat(counts, 8).astype(np.float64)
    flat_bit = bit.ravel()
    levels, child = [], None
    for d in range(depth, least - 1, -1):
        context = (grams >> 8) & ((1 << (8 * d)) - 1)
        key, at = np.unique(((context[:, None] << 8) | node).ravel(), return_inverse=True)
        ones = np.bincount(at, weight * flat_bit, len(key))
        zeros = np.bincount(at, weight, len(key)) - ones
        kt = log_kt(zeros, ones)
        if child is None:
            total, stay = kt, np.ones(len(key))
        else:
            ck, cp = child
            up = ((ck >> 8) & ((1 << (8 * d)) - 1)) << 8 | (ck & 255)
            below = np.bincount(np.searchsorted(key, up), cp, len(key))
            total = np.logaddexp(kt, below) - np.log(2)
            stay = np.exp(kt - np.log(2) - total)
        levels.append((at, (ones + 0.5) / (zeros + ones + 1), stay))
        child = key, total
        last = key, zeros, ones, total
    p = None
    for at, kt, stay in levels:
        p = kt[at] if p is None else stay[at] * kt[at] + (1 - stay[at]) * p
    return last, p.reshape(-1, 8), node, bit


def _pieces(docs: list[tuple[int, bool, bytes]]) -> bytes:
    """A piece of a block: ids, flags and texts."""
    ids = pa.array([d for d, _, _ in docs], pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, pa.array([h for _, h, _ in docs]), pa.array([t for _, _, t in docs], pa.binary())], names=["id", "held", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return P.squeeze(sink.getvalue().to_pybytes())


def _framed(texts: list[bytes], depth: int) -> tuple[bytes, np.ndarray]:
    """Texts between frames, and which strings of the whole belong to a text (with its number)."""
    joined = b"".join(FRAME * depth + t + FRAME for t in texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.concatenate([[0], np.cumsum(sizes + depth)[:-1]])
    where = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return joined, where


def _merged(grams: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct strings with their summed counts."""
    g, at = np.unique(np.concatenate([g for g, _ in grams]), return_inverse=True)
    return g, np.bincount(at, np.concatenate([n for _, n in grams]), len(g)).astype(np.int64)


def _count(parts: int, depth: int):
    """Texts -> rows of blocks: the texts, the words and the strings with their training counts."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, serial = _partition(), 0
        words: Counter = Counter()
        rows: list[tuple[int, int, bytes]] = []
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        docs: list[tuple[int, bool, bytes]] = []
        size = block_size = 0

        def end_piece():
            nonlocal docs, size
            for held in (False, True):
                texts = [t for _, h, t in docs if h == held]
                if texts:
                    joined, where = _framed(texts, depth)
                    g, n = np.unique(strings(joined, depth)[where], return_counts=True)
                    grams.append((g, n * (not held)))
            if len(grams) > 6:
                grams[:] = [_merged(grams)]
            if docs:
                rows.append((TEXT, 0, _pieces(docs)))
            docs, size = [], 0

        def end_block():
            nonlocal words, rows, grams, block_size, serial
            end_piece()
            by_part: dict[int, list] = {}
            for w in words:
                by_part.setdefault(zlib.crc32(w) % parts, []).append(w)
            for p, ws in by_part.items():
                counts = np.fromiter((words[w] for w in ws), np.int64, len(ws))
                rows.append((WORDS, p, P.squeeze(P.pack_codes(counts), *P.pack_strings(ws))))
            g, n = _merged(grams)
            part = (((g >> 8) & 0xFFFF) * 40503 >> 4) % parts
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                mine = order[a:b]
                rows.append((STRINGS, int(part[mine[0]]), P.squeeze(P.pack_codes(np.diff(g[mine], prepend=0)), P.pack_codes(n[mine]))))
            name = place << 32 | serial
            out = pa.RecordBatch.from_arrays(
                [pa.array([name] * len(rows), pa.int64()), pa.array([k for k, _, _ in rows], pa.int32()), pa.array([p for _, p, _ in rows], pa.int32()), pa.array([x for _, _, x in rows], pa.binary())],
                names=["block", "kind", "part", "data"],
            )
            words, rows, grams, block_size, serial = Counter(), [], [], 0, serial + 1
            return out

        for batch in batches:
            for doc_id, held, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text"), strict=True):
                low = (text.as_py() or "").encode("utf-8", "surrogatepass").lower()
                found = [*low.split(), b""]
                words.update(dict.fromkeys(found, 0) if held else found)
                docs.append((doc_id, held, low))
                size += len(low)
                if size >= PIECE_CHARS:
                    block_size += size
                    end_piece()
                    if block_size >= BLOCK_CHARS:
                        yield end_block()
        if docs or rows:
            yield end_block()

    return f


def _sum_words(table: pa.Table) -> pa.Table:
    """All blocks' words of one part -> their counts in the training texts; the first row has totals."""
    total: dict[bytes, int] = {}
    lists = []
    for data in table.column("data"):
        counts, sizes, text = P.unsqueeze(data.as_py())
        ws = P.unpack_strings(sizes, text)
        for w, n in zip(ws, P.unpack_codes(counts).tolist(), strict=True):
            total[w] = total.get(w, 0) + n
        lists.append((ws, sizes, text))
    out = [P.squeeze(_counts([total[w] for w in ws]), sizes, text) for ws, sizes, text in lists]
    n = len(out)
    return pa.table(
        {
            "block": table.column("block"),
            "kind": pa.array([WORDS] * n, pa.int32()),
            "data": pa.array(out, pa.binary()),
            "tokens": pa.array([sum(total.values())] + [0] * (n - 1), pa.int64()),
            "distinct": pa.array([sum(c > 0 for c in total.values())] + [0] * (n - 1), pa.int64()),
        }
    )


def _counts(values: list[int]) -> bytes:
    return np.array(values, dtype=np.int64).tobytes()


def _sum_strings(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    lists, counts = [], []
    for data in table.column("data"):
        g, n = P.unsqueeze(data.as_py())
        lists.append(np.cumsum(P.unpack_codes(g)))
        counts.append(P.unpack_codes(n))
    grams, at = np.unique(np.concatenate(lists), return_inverse=True)
    return grams, np.bincount(at, np.concatenate(counts), len(grams)), lists


def _bottom(depth: int):
    """A part's strings -> the weighted nodes after two context bytes."""

    def f(table: pa.Table) -> pa.Table:
        grams, counts, _ = _sum_strings(table)
        (key, zeros, ones, weighted), *_ = _weigh(grams, counts, depth, 2)
        C.trim()
        return pa.table({"node": key & 0xFFFF, "zeros": zeros, "ones": ones, "weighted": weighted})

    return f


def _top(nodes: list) -> tuple[np.ndarray, np.ndarray]:
    """From the nodes after one context byte: what the two top levels add to P(1), and what they leave."""
    zeros, ones, below = np.zeros((3, 256, 256))
    for x in nodes:
        at = x["node"] >> 8, x["node"] & 255
        zeros[at], ones[at], below[at] = x["zeros"], x["ones"], x["weighted"]
    kt = log_kt(zeros, ones)
    total = np.logaddexp(kt, below) - np.log(2)
    stay = np.exp(kt - np.log(2) - total)
    p = (ones + 0.5) / (zeros + ones + 1)
    z0, o0 = zeros.sum(axis=0), ones.sum(axis=0)
    kt0 = log_kt(z0, o0)
    total0 = np.logaddexp(kt0, total.sum(axis=0)) - np.log(2)
    stay0 = np.exp(kt0 - np.log(2) - total0)
    p0 = (o0 + 0.5) / (z0 + o0 + 1)
    return stay0 * p0 + (1 - stay0) * stay * p, (1 - stay0) * (1 - stay)


def _planes(values: np.ndarray) -> bytes:
    """Floats of 32 bits, all first bytes before all second ones: they compress by their own statistics."""
    return values.astype(np.float32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _code_lengths(depth: int, top) -> object:
    """A part's strings -> log10 of the probability of each one's last byte, back to the blocks."""

    def f(table: pa.Table) -> pa.Table:
        add, leave = top.value
        grams, counts, lists = _sum_strings(table)
        _, p, node, bit = _weigh(grams, counts, depth, 2)
        c1 = ((grams >> 8) & 255)[:, None]
        one = add[c1, node] + leave[c1, node] * p
        value = np.log10(np.where(bit == 1, one, 1 - one)).sum(axis=1)
        out = [P.squeeze(P.pack_codes(np.diff(g, prepend=0)), _planes(value[np.searchsorted(grams, g)])) for g in lists]
        C.trim()
        return pa.table({"block": table.column("block"), "kind": pa.array([STRINGS] * len(out), pa.int32()), "data": pa.array(out, pa.binary())})

    return f


class Lookup:
    """Values of integer keys by open addressing, for whole arrays at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 1.5).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << self.bits, dtype=values.dtype)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]  # of several for one slot the last one gets it
            won = self.keys[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        odd = np.flatnonzero(self.keys[at] != keys)
        while len(odd):
            at[odd] = (at[odd] + 1) & (len(self.keys) - 1)
            odd = odd[self.keys[at[odd]] != keys[odd]]
        return self.values[at]


def _score(depth: int):
    def f(key: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
        words: dict[bytes, int] = {}
        keys, values = [], []
        for kind, data in zip(found.column("kind").to_pylist(), found.column("data"), strict=True):
            if kind == WORDS:
                counts, sizes, text = P.unsqueeze(data.as_py())
                words.update(zip(P.unpack_strings(sizes, text), np.frombuffer(counts, np.int64).tolist(), strict=True))
            else:
                g, v = P.unsqueeze(data.as_py())
                keys.append(np.cumsum(P.unpack_codes(g)))
                values.append(np.frombuffer(v, np.uint8).reshape(4, -1).T.copy().view(np.float32).ravel())
        value = Lookup(np.concatenate(keys), np.concatenate(values))
        out = []
        for data in texts.column("data"):
            with pa.ipc.open_stream(P.unsqueeze(data.as_py())[0]) as reader:
                piece = reader.read_all()
            low = piece.column("text").to_pylist()
            joined, where = _framed(low, depth)
            v = value(strings(joined, depth)[where]).astype(np.float64)
            sizes = np.fromiter(map(len, low), np.int64, len(low)) + 1
            score = np.add.reduceat(v, np.cumsum(sizes) - sizes)
            tokens, known, base = [], [], []
            for t in low:
                c = np.fromiter(map(words.__getitem__, [*t.split(), b""]), np.int64)
                tokens.append(len(c))
                known.append(int((c > 0).sum()))
                base.append(float(np.log10(c + 1.0).sum()))
            out.append(
                pa.table(
                    {"doc_id": piece.column("id"), "held_out": piece.column("held"), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(known, pa.int64()), "n_bytes": pa.array(sizes - 1, pa.int64()), "log_counts": pa.array(base), "score": pa.array(score)}
                )
            )
        C.trim()
        return pa.concat_tables(out)

    return f


def score(docs: DataFrame, held_out: Column, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row.

    Rows for which ``held_out`` is true are scored but not learned from. ``score`` is log10 of the
    model's probability of the text, ``bits_per_byte`` its code length over its bytes and end.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    blocks = C.cut(slim.mapInArrow(C.lean(_count(parts, depth)), "block long, kind int, part int, data binary"))
    words = C.cut(
        blocks.filter(f"kind = {WORDS}").groupBy("part").applyInArrow(_sum_words, "block long, kind int, data binary, tokens long, distinct long")
    )
    totals = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    tokens, distinct = int(totals[0]), int(totals[1])
    grams = blocks.filter(f"kind = {STRINGS}").groupBy("part")
    second = grams.applyInArrow(_bottom(depth), "node long, zeros double, ones double, weighted double")
    first = second.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")))
    top = spark.sparkContext.broadcast(_top(first.collect()))  # at most 256 x 255 rows
    lengths = grams.applyInArrow(_code_lengths(depth, top), "block long, kind int, data binary")
    found = words.select("block", "kind", "data").unionByName(lengths)
    scored = (
        blocks.filter(f"kind = {TEXT}")
        .groupBy("block")
        .cogroup(found.groupBy("block"))
        .applyInArrow(_score(depth), "doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, log_counts double, score double")
    )
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * F.lit(float(np.log10(tokens + distinct + 1)))).alias("base_score"),
        "score",
        (-F.col("score") * F.lit(float(np.log2(10))) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )

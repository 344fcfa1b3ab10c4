"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

1. Each task cuts its texts into pre-tokens and keeps, a block of texts at a time, the distinct
   pre-tokens and for each text the sequence of their numbers (their positions).
2. One shuffle deals both out: number sequences by block, distinct pre-tokens by their hash, packed into
   one row for each block and hash range (so at most one row for each distinct pre-token of a block). Every
   range encodes each distinct pre-token once; a frequent one has one entry a block.
3. The ids return to their blocks, and each text's ids are put together by position.
4. Decoding joins ids with the token-byte table of the vocabulary (a fixed file, about 1 MB): the table is
   an array of bytes with offsets, and the join is a gather over whole batches.

The vocabulary file's path is a parameter; the driver reads it and broadcasts the ranks.

The shuffle of step 2 is read twice in one plan, so a block is made once. If an executor is lost, its blocks are
made again and have to be the same: rows are sorted within their partition first, so it does not matter in which
order a shuffle brings them. Files and checkpoints give their rows in one order anyway: ``settled=True`` leaves
the sort out. A source that gives a task other rows than before (one that is not deterministic) stops the job with an
error instead of giving wrong ids.

Defined results: a null text counts as empty and has no ids; decoding nulls or empty lists gives
empty bytes; repeated rows are encoded each; null ids are kept; extra columns are ignored; an empty
table gives an empty result. Token bytes that are not UTF-8 on their own decode to bytes all the same.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from orrery.llm import common as C
from orrery.llm import packing as P

#: Characters of a block of texts. A block is what one task holds at a time.
BLOCK_CHARS = 4_000_000
#: Tokens that are decoded at once, and tokens of a batch of results.
PIECE_TOKENS, BATCH_TOKENS = 200_000, 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Splitter:
    """Cuts a text into pre-tokens exactly as the tiktoken library does with the same pattern.

    The two regex engines may know different versions of Unicode. Characters on which they differ are
    replaced, for matching only, by one that this engine puts into the class the other one sees.
    """

    CLASSES = ((r"\p{L}", "a"), (r"\p{N}", "0"), (r"\s", " "))

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern)
        single = {bytes([b]): b for b in range(256)}
        self.theirs = [tiktoken.Encoding(f"class{k}", pat_str=c, mergeable_ranks=single, special_tokens={}) for k, (c, _) in enumerate(self.CLASSES)]
        self.ours = [regex.compile(c) for c, _ in self.CLASSES]
        self.known: dict[str, str | None] = {}

    def _stand_in(self, c: str) -> str | None:
        if c not in self.known:
            theirs = [bool(e.encode_ordinary(c)) for e in self.theirs]
            same = theirs == [bool(r.match(c)) for r in self.ours]
            self.known[c] = None if same else next((s for t, (_, s) in zip(theirs, self.CLASSES, strict=True) if t), "")
        return self.known[c]

    def __call__(self, text: str) -> list[str]:
        if not text.isascii():
            odd = {ord(c): s for c in set(text) if c > "\x7f" and (s := self._stand_in(c))}
            if odd:
                return [text[m.start() : m.end()] for m in self.find.finditer(text.translate(odd))]
        return self.find.findall(text)


def _blocks(pattern: str, parts: int, block_chars: int):
    """Texts -> for each block a row of number sequences, named after the block, and a row of words for each part.

    ``k`` says where a row goes: the block's name, or the number of the part.
    """

    def finish(ids: list, words: dict[str, int], codes: list[np.ndarray], keys: list[bytes]) -> pa.RecordBatch:
        flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        # the block's name is drawn from what it holds
        name = hashlib.blake2b(b"".join(keys), digest_size=16).digest()
        sizes = np.fromiter(map(len, codes), np.int64, len(codes))
        texts = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], names=["id"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, texts.schema) as writer:
            writer.write_batch(texts)
        rows = [(name, P.squeeze(sink.getvalue().to_pybytes(), P.pack_codes(sizes), P.pack_codes(rank[flat])))]
        names = list(words)
        coded = [names[k].encode("utf-8", "surrogatepass") for k in order]
        part = np.fromiter((zlib.crc32(w) % parts for w in coded), np.int64, len(coded))
        by_part = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[by_part], np.arange(parts), side="right")
        at = 0
        for p, end in enumerate(ends.tolist()):
            if end > at:
                mine = by_part[at:end]
                rows.append((b"%d" % p, P.squeeze(P.pack_codes(np.diff(mine, prepend=0)), *P.pack_strings([coded[k] for k in mine]), level=9)))
            at = end
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in rows], pa.binary()), pa.array([name] * len(rows), pa.binary()), pa.array([x for _, x in rows], pa.binary())],
            names=["k", "block", "data"],
        )

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(pattern)
        ids, words, codes, keys, size = [], {}, [], [], 0
        place = f"{_partition()}".encode()
        serial = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                found = split(text)
                ids.append(doc_id)
                codes.append(np.fromiter((words.setdefault(w, len(words)) for w in found), np.int64, len(found)))
                keys.append(f"{doc_id} {len(text)};".encode())
                size += len(text)
                if size >= block_chars:
                    yield finish(ids, words, codes, [place, f"{serial}|".encode(), *keys])
                    ids, words, codes, keys, size, serial = [], {}, [], [], 0, serial + 1
        if ids:
            yield finish(ids, words, codes, [place, f"{serial}|".encode(), *keys])

    return f


def _partition() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def _encode_words(ranks, pattern: str):
    """All blocks' words of one part -> their ids for each block, each distinct word encoded once. Blocks give nothing."""

    def f(table: pa.Table) -> pa.Table:
        if table.column("k")[0] == table.column("block")[0]:
            return pa.table({"k": pa.array([], pa.binary()), "data": pa.array([], pa.binary())})
        coder = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        seen: dict[bytes, list[int]] = {}
        out = []
        for data in table.column("data"):
            places, sizes, text = P.unsqueeze(data.as_py())
            found = []
            for w in P.unpack_strings(sizes, text):
                ids = seen.get(w)
                if ids is None:
                    ids = seen[w] = coder.encode_ordinary(w.decode("utf-8", "surrogatepass"))
                found.append(ids)
            counts = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((i for x in found for i in x), np.int64, int(counts.sum()))
            # the two bytes of an id apart: they compress by their own statistics
            halves = flat.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
            out.append(P.squeeze(places, P.pack_codes(counts), halves, level=9))
        C.trim()
        return pa.table({"k": table.column("block"), "data": pa.array(out, pa.binary())})

    return f


def _put_together(key: tuple, texts: pa.Table, words: pa.Table) -> pa.Table:
    """A block's number sequences and the ids of its words -> the ids of its texts. Parts give nothing."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    if not len(texts):
        raise ValueError("words came back to a block that was made anew from other rows")
    if texts.column("k")[0] != texts.column("block")[0]:
        return schema.empty_table()
    lists = [P.unsqueeze(x.as_py()) for x in words.column("data")]
    places = [np.cumsum(P.unpack_codes(a)) for a, _, _ in lists]
    size = sum(map(len, places))
    start, count, shift, flats = np.zeros(size, np.int64), np.zeros(size, np.int64), 0, []
    for at, (_, counts, flat) in zip(places, lists, strict=True):
        n = P.unpack_codes(counts)
        ids = np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int32)
        count[at] = n
        start[at] = shift + np.cumsum(n) - n
        shift += len(ids)
        flats.append(ids)
    table = np.concatenate(flats) if flats else np.zeros(0, np.int32)
    batches = []
    for data in texts.column("data"):
        stream, sizes, codes = P.unsqueeze(data.as_py())
        with pa.ipc.open_stream(stream) as reader:
            ids = reader.read_all().column("id")
        ends = np.cumsum(P.unpack_codes(sizes))
        codes = P.unpack_codes(codes)
        if len(codes) and int(codes.max()) >= size:
            raise ValueError("a block was made anew from other rows than its words")
        lo = first = 0
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(ends, first + 500_000)))
            c = codes[first : int(ends[hi - 1])]
            n = count[c]
            upto = np.cumsum(n)
            where = np.repeat(start[c] - (upto - n), n) + np.arange(int(upto[-1]) if len(upto) else 0)
            cuts = np.concatenate([[0], upto])[np.concatenate([[0], ends[lo:hi] - first])]
            batches.append(
                pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo).combine_chunks(), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(table[where], pa.int32()))],
                    names=["doc_id", "ids"],
                )
            )
            lo, first = hi, int(ends[hi - 1])
    C.trim()
    return pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, schema=schema) for b in batches], schema)


def in_one_order(slim: DataFrame) -> DataFrame:
    """(doc_id, text) sorted within each partition; texts are compared only where ids and hashes are equal."""
    return slim.withColumn("hash", F.xxhash64("text")).sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, settled: bool = False) -> DataFrame:
    """(doc_id, ids) for every row of docs.

    ``parts`` is the number of hash ranges of the vocabulary, the session's shuffle partitions unless
    given; each holds about 1/parts of all distinct words of all blocks. ``settled`` says that a partition of docs
    has its rows in the same order each time, as those of files have.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if not settled:
        slim = in_one_order(slim)
    dealt = slim.mapInArrow(C.lean(_blocks(pattern, parts, BLOCK_CHARS)), "k binary, block binary, data binary").repartition(parts, "k")
    words = dealt.groupBy("k").applyInArrow(_encode_words(ranks, pattern), "k binary, data binary")
    return dealt.groupBy("k").cogroup(words.groupBy("k")).applyInArrow(_put_together, "doc_id long, ids array<int>")


class TokenBytes:
    """The token-byte table as one array of bytes with offsets."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = np.full(max(ranks.values(), default=0) + 1, -1, np.int64)
        self.start = np.zeros(len(self.size), np.int64)
        at = 0
        for token, k in ranks.items():
            self.start[k], self.size[k], at = at, len(token), at + len(token)
        self.bytes = np.frombuffer(b"".join(ranks), np.uint8)

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the bytes of all ids in order, the number of bytes of each)."""
        if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= len(self.size) or int(self.size[ids].min()) < 0):
            raise ValueError("an id is not in the vocabulary")
        sizes = self.size[ids]
        out = np.empty(int(sizes.sum()), np.uint8)
        at = 0
        for lo in range(0, len(ids), PIECE_TOKENS):
            n = sizes[lo : lo + PIECE_TOKENS]
            upto = np.cumsum(n)
            end = int(upto[-1])
            out[at : at + end] = self.bytes[np.repeat(self.start[ids[lo : lo + PIECE_TOKENS]] - (upto - n), n) + np.arange(end)]
            at += end
        return out, sizes


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", keep_ids: bool = True) -> DataFrame:
    """encoded with a column ``decoded`` (binary); ``keep_ids=False`` leaves the ids' column out."""
    table = encoded.sparkSession.sparkContext.broadcast(TokenBytes(read_ranks(ranks_path)))
    names = [c for c in encoded.columns if keep_ids or c != ids_col]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(ids_col)
            upto = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            ids, lo = column.flatten().to_numpy(zero_copy_only=False), 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + BATCH_TOKENS, side="right")) - 1)
                data, sizes = table.value(ids[upto[lo] : upto[hi]])
                ends = np.concatenate([[0], np.cumsum(sizes)])[upto[lo : hi + 1] - upto[lo]]
                texts = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in names), texts], names=[*names, "decoded"])
                lo = hi

    fields = [f for f in encoded.schema.fields if f.name in names]
    return encoded.mapInArrow(C.lean(f), StructType([*fields, StructField("decoded", BinaryType())]))

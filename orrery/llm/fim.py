"""Fill-in-the-middle: a text is cut in three at unit boundaries and its parts are put in another order.

Units are runs of ASCII letters and single other code points. The offsets of all unit boundaries of a text are
held as a set of integers in containers of 2**16 values: short sorted arrays, bitmaps or runs, whichever takes the
fewest bytes, with the number of values before each container. Both cuts are selections from this set: a
search over the containers, then one within the container.

Cuts and forms follow from a SHA-256 of the seed and the id, so reruns and other partitionings agree. A text that is
empty or holds a sentinel stays plain, so that every output can be taken apart again by its sentinels.

Defined results: a null text counts as empty, a null id as the empty string; rows equal in id and text give equal
rows, each; texts of any length are cut whole; an empty table gives an empty result; ``transform`` ignores extra
columns, ``in_place`` carries them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm import common as C

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_LOW = 1 << 16
#: Bytes of a bitmap container.
_BITMAP = _LOW // 8


class _Array:
    """Sorted low halves."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class _Bitmap:
    """A bit for each low half, with the number of bits before each word of 64."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(_LOW, dtype=np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def select(self, k: int) -> int:
        w = int(np.searchsorted(self.before, k, side="right")) - 1
        bits = np.unpackbits(self.words[w : w + 1].view(np.uint8), bitorder="little")
        return 64 * w + int(np.flatnonzero(bits)[k - self.before[w]])


class _Runs:
    """First values of runs of consecutive low halves, with the number of values before each."""

    def __init__(self, low: np.ndarray, heads: np.ndarray):
        self.first, self.before = low[heads].astype(np.uint16), heads

    def select(self, k: int) -> int:
        r = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.first[r]) + k - int(self.before[r])


class Boundaries:
    """A set of non-negative integers with selection by rank."""

    def __init__(self, values: np.ndarray):
        """``values``: sorted, distinct."""
        high = values >> 16
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(high)) + 1, [len(values)]]) if len(values) else np.zeros(1, np.int64)
        self.size, self.before = len(values), cuts[:-1]
        self.high = high[cuts[:-1]].tolist()
        self.containers: list[_Array | _Bitmap | _Runs] = []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            low = values[lo:hi] & (_LOW - 1)
            heads = np.concatenate([[0], np.flatnonzero(np.diff(low) != 1) + 1])
            if 4 * len(heads) <= min(2 * len(low), _BITMAP):
                self.containers.append(_Runs(low, heads))
            elif 2 * len(low) <= _BITMAP:
                self.containers.append(_Array(low))
            else:
                self.containers.append(_Bitmap(low))

    def __len__(self) -> int:
        return self.size

    def select(self, k: int) -> int:
        """The value with k smaller ones."""
        if not 0 <= k < self.size:
            raise IndexError(k)
        c = int(np.searchsorted(self.before, k, side="right")) - 1
        return self.high[c] * _LOW + self.containers[c].select(k - int(self.before[c]))


def boundaries(text: str) -> Boundaries:
    """Where the units of a text begin, and its end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = ((points | 32) >= 97) & ((points | 32) <= 122) & (points < 128)
    starts = np.ones(len(points) + 1, dtype=bool)
    starts[1:-1] = ~(letter[1:] & letter[:-1])
    return Boundaries(np.flatnonzero(starts))


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four integers of 32 bits for a row."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def rearranged(text: str, doc_id: int | None, seed: int, plain: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix_chars, middle_chars, output) of a text."""
    bounds = boundaries(text)
    n = len(bounds) - 1
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - plain:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    one, two = bounds.select(a), bounds.select(b)
    prefix, middle, suffix = text[:one], text[one:two], text[two:]
    if h4 % 100 < spm:
        return n, "spm", one, two - one, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", one, two - one, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def transform(docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    ``plain`` of 100 texts stay as they are, ``spm`` of 100 others have their suffix first; the rest begin with the prefix.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in C.in_pieces(batch):
                ids = piece.column("doc_id").to_pylist()
                rows = [rearranged(text.as_py() or "", i, seed, plain, spm) for i, text in zip(ids, piece.column("text"), strict=True)]
                columns = [ids, *zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(C.lean(f), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made of."""

    def between(begin: str, end: str | None) -> Column:
        at = F.locate(begin, output) + len(begin)
        return F.substring(output, at, F.locate(end, output) - at if end else F.length(output))

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def in_place(docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every text replaced by its output; all other columns as they are, null texts stay null."""
    place, number = docs.columns.index(text_col), C.fresh(docs, "number")[0]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in C.in_pieces(batch, text_col):
                ids = piece.column(number).to_pylist()
                new = [None if t.as_py() is None else rearranged(t.as_py(), i, seed, plain, spm)[4] for i, t in zip(ids, piece.column(text_col), strict=True)]
                field = piece.schema.field(place)
                yield piece.set_column(place, field, pa.array(new, field.type)).drop_columns([number])

    return docs.withColumn(number, F.col(id_col).cast("long")).mapInArrow(C.lean(f), docs.schema)

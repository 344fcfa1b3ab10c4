"""Substring dedup by hashing units of text.

Units: every line that is not empty, whatever its length, and in it every sentence. A sentence ends at ``.``,
``!`` or ``?`` before white space, or with its line; one of fewer than ``min_words`` words is joined with the
sentences after it in its line until it has as many, and gives no unit of its own if the line ends before. So a
passage gives the same units whatever stands around it, also in the middle of a line, and a repeated line goes
as a whole. Units are normalised (lower case, white space as one space), hashed to 128 bits and grouped over
all documents. The occurrence that ranks first (by doc_id, then position) stays; all others are removed, with
their offsets in the original text kept. What belongs to a kept first occurrence of a repeated sentence unit is
never removed, nor the part of a line's first occurrence that no sentence unit covers.

All units are hashed and grouped, whatever their length, and every repeat is found, with the length of the run of removals that
it lies in (at most two characters between). A consumer that wants passages to go, also those made of many short lines, and
lone common lines to stay reads that length, or gives ``min_run`` (0: none), which leaves shorter runs alone.

Digests are summed in each task before they shuffle, and units of very frequent digests meet their first
occurrence by a broadcast of at most 1000 rows, so no unit's occurrences gather in one task.

Defined results: null and empty texts have no units; null ids rank last; rows equal in id rank by their
place in the table; repeats within a document count like others; very long lines are cut into sentences
like others; an empty table gives an empty result; extra columns are ignored, or carried by
``remove_repeats``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import common as C

MIN_WORDS = 8
_END = re.compile(r"(?<=[.!?])[ \t\x0b\x0c\r]+|\n+")


def spans(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, bytes, int]]:
    """(start, end, digest, own) of every unit of a text, whole lines among them, offsets in code points.

    ``own`` is where the part begins that no other unit of the line covers: the start, but for lines that hold
    sentence units the end of the last of these.
    """
    out, line = [], []  # line: (start, end, words) of its sentences

    def unit(start: int, end: int, words: list[str], own: int) -> None:
        out.append((start, end, hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest(), own))

    def close() -> None:
        if not line:
            return
        first, last = line[0][0], line[-1][1]
        own, whole = first, False
        for k, (start, _, _) in enumerate(line):
            words: list[str] = []
            for _, end, more in line[k:]:
                words = words + more
                if len(words) >= min_words:
                    unit(start, end, words, start)
                    own, whole = end, whole or (start, end) == (first, last)
                    break
        if not whole:
            unit(first, last, [w for _, _, words in line for w in words], own)
        line.clear()

    at = 0
    for m in [*_END.finditer(text), None]:
        end = m.start() if m else len(text)
        words = text[at:end].lower().split()
        if words:
            line.append((at, end, words))
        if m is None or "\n" in m.group():
            close()
        at = m.end() if m else end
    return out


def units(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of the units that lie in no other's line: sentences, and lines that hold no sentence unit."""
    return [(start, end, digest) for start, end, digest, own in spans(text, min_words) if own == start]


def _units(min_words: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 40
        for b in batches:
            rows = []
            for doc_id, key, text in zip(b.column("doc_id").to_pylist(), b.column("row_key").to_pylist(), b.column("text"), strict=True):
                found = spans(text.as_py() or "", min_words)
                rows.append((doc_id, serial, -1, -1, key, -1))  # the row itself
                rows += [(doc_id, serial, *x) for x in found]
                serial += 1
                if len(rows) > 50_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    return f


_FIELDS = [("doc_id", pa.int64()), ("serial", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("digest", pa.binary()), ("own", pa.int64())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])


def cover(removed: list[tuple[int, int, object]], kept: list[tuple[int, int]]) -> list[tuple[int, int, list]]:
    """The union of the removed spans without the kept ones, as (start, end, sources)."""
    events = sorted({p for s, e, _ in removed for p in (s, e)} | {p for s, e in kept for p in (s, e)})
    place = {p: k for k, p in enumerate(events)}
    gone: list[list] = [[] for _ in events]
    stays = [0] * (len(events) + 1)
    for s, e in kept:
        stays[place[s]] += 1
        stays[place[e]] -= 1
    for s, e, source in removed:
        for k in range(place[s], place[e]):
            gone[k].append(source)
    out: list[tuple[int, int, list]] = []
    depth = 0
    for k in range(len(events) - 1):
        depth += stays[k]
        if gone[k] and not depth:
            if out and out[-1][1] == events[k]:
                out[-1] = (out[-1][0], events[k + 1], out[-1][2] + gone[k])
            else:
                out.append((events[k], events[k + 1], list(gone[k])))
    return out


def run_lengths(spans: list[tuple[int, int, list]]) -> list[int]:
    """For each of the spans, in order, the characters from the first to the last of its run: at most two lie between."""
    out: list[int] = []
    run: list[tuple[int, int, list]] = []
    for span in [*spans, None]:
        if run and (span is None or span[0] - run[-1][1] > 2):
            out += [run[-1][1] - run[0][0]] * len(run)
            run = []
        run.append(span)
    return out


def _merge():
    schema = pa.schema([("doc_id", pa.int64()), ("serial", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("kept_in", pa.list_(pa.int64())), ("run", pa.int64())])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                removed = [(s["start"], s["end"], s["source"]) for s in row["spans"] if not s["stays"]]
                kept = [(s["own"], s["end"]) for s in row["spans"] if s["stays"]]
                found = cover(removed, kept)
                for (start, end, sources), run in zip(found, run_lengths(found), strict=True):
                    rows.append({"doc_id": row["doc_id"], "serial": row["serial"], "start": start, "end": end, "kept_in": sorted({x for x in sources if x is not None}), "run": run})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return f


def _found(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), C.row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    return C.cut(slim.mapInArrow(C.lean(_units(min_words)), "doc_id long, serial long, start long, end long, digest binary, own long"))


def _repeats(found: DataFrame, min_run: int) -> DataFrame:
    hashed = found.filter("start >= 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "serial", "start")).alias("first")
    groups = C.cut(hashed.groupBy("digest").agg(first, F.count("*").alias("n")).filter("n > 1"))
    joined = C.join_groups(hashed, groups, "digest", "n", hashed.count())
    stays = (F.col("serial") == F.col("first.serial")) & (F.col("start") == F.col("first.start"))
    spans = joined.select("doc_id", "serial", F.struct("start", "end", "own", F.col("first.doc_id").alias("source"), stays.alias("stays")).alias("span"))
    per_doc = spans.groupBy("serial", "doc_id").agg(F.collect_list("span").alias("spans"), F.bool_and("span.stays").alias("whole")).filter("NOT whole")
    return per_doc.select("doc_id", "serial", "spans").mapInArrow(C.lean(_merge()), "doc_id long, serial long, start long, end long, kept_in array<long>, run long").filter(F.col("run") >= min_run)


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, min_run: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each removed span: doc_id, serial (the row's number in this run), start, end, kept_in, run.

    ``kept_in`` lists the documents that keep the first occurrences of the span's units; ``run`` counts the characters that go
    together with the span, it and those beside it.
    """
    return _repeats(_found(docs, min_words, id_col, text_col), min_run)


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, min_run: int = 0, id_col: str = "doc_id", text_col: str = "text", removed: str = "removed") -> DataFrame:
    """All documents with their repeats cut out, and the column ``removed``: their spans in the original text."""
    found = _found(docs, min_words, id_col, text_col)
    key, turn = C.fresh(docs, "row_key", "turn")
    spans = _repeats(found, min_run).groupBy("serial").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(removed))
    plan = found.filter("start < 0").select("serial", F.col("digest").alias(key)).join(spans, "serial", "left").select(key, F.col("serial").alias(turn), removed)
    names = docs.columns
    texts = C.one_a_key(docs.withColumn(key, C.row_key(id_col, text_col)), key)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for text, gone in zip(batch.column(text_col).to_pylist(), batch.column(removed).to_pylist(), strict=True):
                if gone:
                    at, parts = 0, []
                    for span in gone:
                        parts.append(text[at : span["start"]])
                        at = span["end"]
                    text = "".join([*parts, text[at:]])
                new.append(text)
            k = batch.schema.get_field_index(text_col)
            yield batch.set_column(k, batch.schema.field(k), pa.array(new, batch.schema.field(k).type))

    joined = texts.join(plan, key).select(*names, removed)
    return joined.mapInArrow(C.lean(cut_out), joined.schema)

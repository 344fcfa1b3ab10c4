"""A content-addressed WARC archive of pages.

Writing: each page gives one WARC/1.1 record. Of records with equal payloads of at least ``least``
bytes the one with the largest id is a response that holds the payload; the others are revisits that
name it (profile identical-payload-digest) and hold none. Equality goes by SHA-256 and length; the
header names SHA-1 as well. Spark's text writer writes the records, with the two line ends that close a
record as its line separator, so the files are plain WARC, compressed with gzip unless told otherwise, and go to
any store that Spark writes to.

Pages go to files by classes of payload length: short payloads ``records_per_file`` to a file, those of up to CLASS_STEP
times the length an eighth as many, and so on down to one. So a file holds about SHORT * records_per_file bytes, or one
record that is longer. Each class that occurs is one write; most archives have one or two.

Reading: files are read whole by Spark, cut by Content-Length, and split into a header table with the exact header bytes and a payload store that
holds each payload once under its SHA-256, recomputed and compared with the header. Joins on the digest
bring the original records back.

Defined results: a null payload counts as empty; null or strange urls are percent-encoded so that a
header stays one line; null ids are written as such and rank lowest (a group of null ids only holds
no revisits); rows that repeat an id are records of their own, and rows that repeat id and payload are
equal records; an empty table gives no records; extra columns are ignored. A payload can be as long as a value of
Spark is (2 GB with its header).
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from orrery.llm import common as C

#: Closes every record.
END = "\r\n\r\n"
#: How a compressed file begins.
GZIP = b"\x1f\x8b"
#: Longest payload in bytes of the first class, and how much longer the next class's are.
SHORT, CLASS_STEP = 128 << 10, 8
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"
_HEADERS = "record_id string, record_type string, page_id long, url string, refers_to string, sha1 string, sha256 string, length long, header binary, valid boolean"


@F.pandas_udf(StringType())
def on_one_line(urls: pd.Series) -> pd.Series:
    """A url that fits on one header line: strange characters percent-encoded."""
    return urls.map(lambda u: None if u is None else quote(u, safe="%/:=&?~#+!$,;'@()*[]", errors="replace"))


def length_class(payload: Column, short: int) -> Column:
    """0 for payloads of at most short bytes, 1 for at most CLASS_STEP times as many, and so on."""
    n, bound, k = F.octet_length(payload), short, 0
    found = F.when(n <= bound, 0)
    while bound < 2**31:
        bound, k = bound * CLASS_STEP, k + 1
        found = found.when(n <= bound, k)
    return found


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000) -> DataFrame:
    """One row a page, ``value``: the record's header and payload as text."""
    return by_class(pages, id_col, url_col, payload_col, least)[0][1]


def by_class(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int, short: int | None = None) -> list[tuple[int, DataFrame]]:
    """(class, records) for each class of payload length that occurs, or all records as class 0 without ``short``."""
    slim = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), C.text_or_empty(F.col(payload_col).cast("string")).alias("payload")
    )
    # which payloads occur more than once and who holds them: digests only, and each class's
    which = F.lit(0) if short is None else length_class(F.col("payload"), short)
    long = F.octet_length("payload") >= least
    keys = C.cut(slim.filter(long | (which > 0)).select(F.sha2("payload", 256).alias("sha256"), "page_id", long.alias("long"), which.alias("which")))
    classes = sorted({0, *(r["which"] for r in keys.select("which").distinct().collect())})
    keys = keys.filter("long")
    holders = C.cut(
        keys.groupBy("sha256")
        .agg(F.max("page_id").alias("holder"), F.count("*").alias("copies"))
        .filter("copies > 1")
    )
    # only rows whose digest may be among them shuffle; a bounded filter lets the others pass
    blocks = C.filter_blocks(holders.count())
    shared, total = C.member_filter(holders, "sha256", blocks), keys.count()
    return [(k, _as_text(slim if short is None else slim.filter(which == k), holders, shared, blocks, total, least)) for k in classes]


def _as_text(slim: DataFrame, holders: DataFrame, member, blocks: int, total: int, least: int) -> DataFrame:
    """The records of slim as text, each with its header."""
    # digests by built-in functions: payloads do not leave the JVM
    rows = slim.withColumns({"length": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload"), "sha256": F.sha2("payload", 256), "url": on_one_line("url")})
    seen = C.probe(rows, "sha256", member, blocks, "shared")
    shared = F.col("shared") & (F.col("length") >= least)
    alone = seen.filter(~shared).withColumns({"holder": F.lit(None).cast("long"), "copies": F.lit(1).cast("long")})
    rows = alone.unionByName(C.join_groups(seen.filter(shared), holders, "sha256", "copies", total, "left"))

    def name(page: object) -> object:
        return F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), F.substring("sha256", 1, 16))

    again = F.col("holder").isNotNull() & ~F.col("holder").eqNullSafe(F.col("page_id"))

    def line(field: str, value) -> object:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{field}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))

    length = F.when(again, F.lit(0)).otherwise(F.col("length"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<"), name(F.col("page_id")), F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("WARC-Payload-SHA256", F.col("sha256")),
        line("WARC-Refers-To", F.when(again, F.concat(F.lit("<"), name(F.col("holder")), F.lit(">")))),
        line("WARC-Profile", F.when(again, F.lit(PROFILE))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(header, F.when(again, F.lit("")).otherwise(F.col("payload"))).alias("value"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000, records_per_file: int = 2_000, compression: str = "gzip") -> None:
    """Write the archive's files under path; ``compression`` is gzip or none."""
    C.prepare(pages.sparkSession)
    for k, part in by_class(pages, id_col, url_col, payload_col, least, SHORT):
        most = max(1, records_per_file // CLASS_STEP**k)
        part.write.mode("append" if k else "error").option("lineSep", END).option("maxRecordsPerFile", most).option("compression", compression).text(path)


def parse(data: bytes) -> Iterator[tuple[bytes, dict[str, str], bytes]]:
    """(header bytes, header fields in lower case, content) of each record of a WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        header = data[at:end]
        fields = {}
        for text in header.decode("utf-8").split("\r\n")[1:]:
            key, colon, value = text.partition(": ")
            if colon:
                fields[key.lower()] = value
        length = int(fields["content-length"])
        if data[end + length : end + length + 4] != b"\r\n\r\n":
            raise ValueError(f"a record at byte {at} does not end where its Content-Length says")
        yield header, fields, data[end : end + length]
        at = end + length + 4


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            rows, size, data = [], 0, content.as_py()
            for header, x, payload in parse(gzip.decompress(data) if data.startswith(GZIP) else data):
                strong = hashlib.sha256(payload).hexdigest()
                revisit = x["warc-type"] == "revisit"
                sha1 = x["warc-payload-digest"].removeprefix("sha1:")
                good = revisit or (strong == x["warc-payload-sha256"] and hashlib.sha1(payload).hexdigest() == sha1)
                who = x["warc-record-id"].strip("<>")
                page = who.split(":")[2]
                rows.append((who, x["warc-type"], None if page == "null" else int(page), x.get("warc-target-uri"), x.get("warc-refers-to", "").strip("<>") or None, sha1, x["warc-payload-sha256"], None if revisit else len(payload), header, good, None if revisit else payload))
                size += len(payload)
                if size > 4 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.bool_(), pa.binary()]
    names = ["record_id", "record_type", "page_id", "url", "refers_to", "sha1", "sha256", "length", "header", "valid", "payload"]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archive: ids, digests, exact header bytes, and the payload where it holds one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(C.lean(_split), _HEADERS + ", payload binary")


def headers(archive: DataFrame) -> DataFrame:
    return archive.drop("payload")


def payloads(archive: DataFrame) -> DataFrame:
    """The payload store: each payload once under its digest; only verified bytes enter it."""
    held = archive.filter("valid AND payload IS NOT NULL")
    return held.groupBy("sha256").agg(F.first("payload").alias("payload"), F.first("length").alias("length"))


def reconstruct(header_table: DataFrame, store: DataFrame) -> DataFrame:
    """Original records: each header with the full payload of its digest, null where no verified bytes are stored.

    A payload that very many headers name is broadcast to them.
    """
    named = C.cut(header_table.groupBy("sha256").agg(F.count("*").alias("records")))
    total = named.agg(F.sum("records")).first()[0] or 0
    heavy = C.cut(named.filter(F.col("records") >= max(1000, -(-total // C.HEAVY))).select("sha256"))
    rows, store = header_table.drop("length"), store.select("sha256", "payload", "length")
    if not heavy.count():
        return rows.join(store, "sha256", "left")
    many = rows.join(F.broadcast(heavy), "sha256", "left_semi").join(F.broadcast(store.join(F.broadcast(heavy), "sha256", "left_semi")), "sha256", "left")
    few = F.broadcast(heavy)
    return many.unionByName(rows.join(few, "sha256", "left_anti").join(store.join(few, "sha256", "left_anti"), "sha256", "left"))

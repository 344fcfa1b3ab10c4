"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import bpe, collocations, exact_dedup, fim, fingerprints, license_scan, lm_score, mixing, near_dedup, quality, substring_dedup, url_filter, warc
from orrery.llm import common as C
from orrery.llm.sql import SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeat; ``long_run``: it goes as part of a passage of 160 characters or more (about 25 words), not as a lone common line."""
    found = substring_dedup.repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("start").alias("start_char"), F.col("end").alias("end_char"), "kept_in", (F.col("run") >= 160).alias("long_run"))


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), RULES)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scores = quality.classify(docs, labels, train=C.crc_mod("doc_id", 3) != 1)
    held_out = F.coalesce(C.crc_mod("doc_id", 3) == 1, F.lit(False))
    return scores.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also near_docs: for every document whose id is divisible by 20, how many others have a fingerprint within 3 bits."""
    found = C.cut(fingerprints.compare_with_edits(_table(spark, sf_dir, "documents")))
    queries = found.filter("doc_id % 20 = 0")
    sizes = found.groupBy("fingerprint").agg(F.count("*").alias("n"))
    near = fingerprints.search(queries, found).join(sizes.withColumnRenamed("fingerprint", "match"), "match")
    counts = C.cut(near.groupBy(F.col("query").alias("fingerprint")).agg((F.sum("n") - 1).alias("near_docs")).join(sizes, "fingerprint"))
    asked = C.join_groups(queries, counts, "fingerprint", "n", found.count()).drop("n")
    return asked.unionByName(found.filter("doc_id IS NULL OR doc_id % 20 <> 0").withColumn("near_docs", F.lit(None).cast("long")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(_table(spark, sf_dir, "documents")).documents()


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, settled=True)
    counted = encoded.withColumns(
        {"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(F.array_join("ids", " "), 256)}
    )
    return bpe.decode(counted, ranks, keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{C.shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(_table(spark, sf_dir, "pages"), path)
    archive = warc.read(spark, path)
    # headers are kept apart; payloads are read from the archive again, once
    headers = C.stored(warc.headers(archive).select("page_id", "record_type", "refers_to", "sha256", "length"))
    # a record whose payload is not verified stays, with null bytes and digest
    full = warc.reconstruct(headers, warc.payloads(archive))
    return full.select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        "record_type",
        F.split("refers_to", ":")[2].cast("long").alias("refers_to"),
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"), held_out=C.crc_mod("doc_id", 7) == 2)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_dedup.near_groups(_table(spark, sf_dir, "documents"), width=2, percent=80)
    return groups.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its SQL leaves common words out and takes the 16 rarest, so the query does; ``scan`` by itself finds every place."""
    return license_scan.digest(license_scan.scan(_table(spark, sf_dir, "documents"), exact=False))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.transform(_table(spark, sf_dir, "documents"))
    restored = fim.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_quality": op3_quality,
    "op4_fingerprints": op4_fingerprints,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_mixing": op6_mixing,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_warc": op8_warc,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_collocations": op11_collocations,
    "op12_license_scan": op12_license_scan,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = SQL

"""A training corpus from documents, in stages of one operator each.

Each stage gets the rows that its predecessor kept, and what it decides takes effect: rejected documents
and copies go, the mix repeats or thins what is left, and the last stage gives token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import bpe, common, exact_dedup, mixing, near_dedup, quality


#: Rows of a batch that goes to Python, unless the session names a number of its own: texts of a few kilobytes make 10 MB then.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"


def _small_batches(spark: SparkSession) -> None:
    name, default, rows = BATCH_ROWS
    if spark.conf.get(name) == default:
        spark.conf.set(name, rows)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    _small_batches(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the smallest doc_id stays."""
    _small_batches(spark)
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup on shingles of five words, similarity 0.8 or more; one of each group stays."""
    _small_batches(spark)
    return near_dedup.near_dedup(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights; documents return as often as the mix takes them, whole or in part."""
    _small_batches(spark)
    return mixing.mixed_documents(docs, block=256)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: token ids, and a digest of what they decode to. The rows come from files, in one order."""
    _small_batches(spark)
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, settled=True)
    return bpe.decode(encoded, ranks).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("minhash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("byte-level bpe", tokenize),
]

#: SQL cannot express the classifier, the sketches, the permutations or the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; between two stages the rows are written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        if k:
            docs = common.stored(docs)
        docs = stage(spark, docs, sf_dir)
    return docs

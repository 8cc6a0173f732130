"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next one's docs. All but the last return the
columns of documents. Each begins with executors that have given back what the
one before left in their heaps.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wefthread.llm import bpe, jaccard, mixing, quality, secret_scan
from wefthread.llm.common import delete, dropping, rest, shared_folder, sparing


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    rest(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 5-word Jaccard similarity 0.8 or more stays, that of the smallest doc_id."""
    rest(spark)
    return jaccard.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets make way for a mark; the documents stay."""
    rest(spark)
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, or one to three times."""
    rest(spark)
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, as little-endian bytes, with their digests."""
    rest(spark)
    return bpe.encode_documents(docs, keep_ids=True, forget=True)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: The stages have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each written to the shared folder and read again; what a stage read goes when it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with dropping(spark), sparing(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{base}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{k}")
        if k:
            delete(spark, f"{base}/{k - 1}")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return docs.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", F.octet_length("ids").cast("long").alias("n_bytes"))

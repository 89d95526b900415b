"""A pipeline over a corpus of documents: quality rules, line dedup, near duplicates, secrets, packing.

Counted as part of the subpackage ``llm``. Every stage takes (spark, docs, sf_dir) and returns a
DataFrame; it is written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``; stages that change texts set ``n_chars`` anew.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import linededup, minhash, packing, rules, secretscan
from veilframe.llm.common import shared_path


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with ``n_chars`` as the texts now are, in the order of ``columns``."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return rules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat across them; a document of nothing else stays, empty."""
    return _measured(linededup.dedup_lines(docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return minhash.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret found replaced by a mark."""
    clean = secretscan.redact_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return _measured(clean, docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secret_scans),
    ("packing", pack),
]

#: SQL has no tokenizer, linear program or weighted sampling; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what the stages before return lies in the folder the cluster shares."""
    folder = shared_path(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

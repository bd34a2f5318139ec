"""From raw documents to clean, encoded ones: each stage is one operator of ``doctrellis.llm``.

Every stage takes null columns, empty and very long texts, repeated rows and empty tables as
its operator defines them, and carries columns beyond those of ``documents`` along, up to the
last stage, whose rows are (doc_id, lang, source, n_chars, n_tokens, ids, decoded).
"""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from doctrellis.llm.byte_bpe import encoded  # noqa: E402
from doctrellis.llm.common import shared_dir, table  # noqa: E402
from doctrellis.llm.decontaminate import clean  # noqa: E402
from doctrellis.llm.jaccard_join import one_per_component  # noqa: E402
from doctrellis.llm.quality_rules import accepted  # noqa: E402
from doctrellis.llm.secret_scan import redact  # noqa: E402


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id stays; of rows alike in id and text, the first by their other columns."""
    return one_per_component(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) and the text that they decode to, beside the other columns."""
    return encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("quality rules", quality),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("byte-level bpe", encoding),
]

# Suffix arrays, trees, embeddings and tokenizers are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""A training corpus from raw documents: rejects poor ones, drops copies and near copies, mixes sources, encodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm.bpe import encode_texts
from tracewell.llm.common import table
from tracewell.llm.exact_dedup import one_of_each_text
from tracewell.llm.jaccard_join import one_of_each_class
from tracewell.llm.mixing import mixed_rows
from tracewell.llm.quality_crf import good_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier doesn't reject."""
    return good_documents(docs, "doc_id", "text", spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text."""
    return one_of_each_text(docs, "doc_id", "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies."""
    return one_of_each_class(docs, "doc_id", "text")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of sources does."""
    return mixed_rows(docs, "doc_id", "text", "source")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left: a row per document and copy, with its ids."""
    import public_tokenizers

    return encode_texts(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]

#: SQL can't express a fitted classifier or the tokenizer: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline: quality rules, one document of each near-duplicate group, secrets out, sequences packed.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read back as the next one's
docs. All but the last return the columns of documents. Tables that a stage needs besides docs are read from sf_dir."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.common import shared_dir, table
from tidelog.llm.ngram_join import one_of_each
from tidelog.llm.packing import pack, token_pieces
from tidelog.llm.quality import keep_good, train
from tidelog.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. The rules' field is fitted on labelled documents of the table itself."""
    return keep_good(docs, *train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarity links; those without words or without an id stay."""
    return one_of_each(docs, 5, 80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by the kind's name."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, with the sequence that each is in."""
    return pack(token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 2), 1024)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_copies), ("secret scans", secrets), ("best-fit packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, applied to the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs

"""The corpus pipeline: stages applied to ``documents`` one after another.

Every stage takes ``(spark, docs, sf_dir)``.  All but the last return the columns of
``documents``; the last one writes the token ids of all that is left and returns what it
reads back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from enquira.llm.common import cut
from enquira.llm.curriculum import mix
from enquira.llm.latent_decontamination import decontaminate
from enquira.llm.order_minhash import deduplicate
from enquira.llm.ordinal_toxicity import score_documents
from enquira.llm.token_blocks import encode_documents


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that ordinal regression judges toxic go."""
    scored = score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("not is_toxic").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated to their source's target and sorted by training position."""
    return mix(docs).select(*docs.columns)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in block shards, read back."""
    return encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]

#: No SQL: the stages fit models and align texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = cut(docs, f"stage-{name}")
    return docs

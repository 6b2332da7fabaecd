"""Corpus preparation in five stages: each takes what its predecessor kept, whole.

    toxicity          documents scored as toxic go
    line_dedup        passages that stand elsewhere are cut out of the texts
    jaccard_join      of each group of near-duplicates the smallest doc_id stays
    decontamination   documents that hold a benchmark item go
    byte_bpe          texts are encoded, and the ids decoded and compared with them

A stage returns the columns of documents, the last one those and token_ids, n_tokens and
round_trip. Empty and null texts pass every stage. Rows that repeat a doc_id stay or go
together, as each stage judges alike texts alike. Empty tables pass as empty tables.
"""

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depsieve.llm import byte_bpe, decontamination, jaccard_join, line_dedup, toxicity
from depsieve.llm.common import crc_bucket, scratch_of, stored, whole_text
from depsieve.llm.queries import TOXIC_FROM
from depsieve.session import BATCH_CONF, new_folder

#: Words and percent of similarity from which documents are near-duplicates.
NEAR = jaccard_join.Settings(words=5, percent=80)
RANKS = "byte_bpe_multi_50k.tiktoken"


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def _stage(function):
    """A stage is written by its caller, so the batches its tasks get are set for the session."""

    @functools.wraps(function)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, value in BATCH_CONF.items():
            spark.conf.set(key, value)
        return function(spark, docs, sf_dir)

    return scratch_of("pipeline")(call)


@_stage
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(crc_bucket("doc_id", 4) != 2))
    # The score gets a name of its own, so that a column of documents keeps its values.
    scored = toxicity.score(docs, model, output="_toxicity")
    return scored.where(F.col("_toxicity") < TOXIC_FROM).select(*docs.columns)


@_stage
def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.remove_repeated_passages(docs)
    return cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


@_stage
def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard_join.jaccard_components(docs, NEAR)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@_stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, _benchmark(spark, sf_dir))


@_stage
def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    # Stored before it is decoded: in one stage every task would keep two Python workers.
    encoded = stored(byte_bpe.bpe_encode(docs, path, public_tokenizers.PATTERN), "pipeline-encoded")
    decoded = byte_bpe.bpe_decode(encoded, path)
    return decoded.select(
        *docs.columns,
        "token_ids",
        F.size("token_ids").cast("long").alias("n_tokens"),
        (F.col("decoded") == whole_text().cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("jaccard_join", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: SQL can express neither the trained model nor the merges of the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

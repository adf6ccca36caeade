"""documents -> packed training rows: five stages, each written as Parquet and read again by the next.

Every stage but the last returns the columns of documents, whatever they are. Quality rules drop documents that fail; of near copies
one row stays, whatever the ids are; documents that hold a benchmark item go; secrets are masked in the text of documents, which stay; what is left is
packed. An empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scopeflow.llm import decontaminate, neardup, packing, quality, secrets
from scopeflow.llm.queries import BYTE_BPE, CAPACITY
from scopeflow.llm.storage import kept_at, remove, scratch
from scopeflow.plans.ship import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_quality(docs, quality.train_crf(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(packing.clustered_lengths(docs, BYTE_BPE), docs.count(), CAPACITY)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_dedup", minhash_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]
#: Line labelling, components and packing are beyond SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's own tables go once its result is written, and that result once the next one's is."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        with scratch(spark):
            docs, path = kept_at(stage(spark, docs, sf_dir), name)
        if before:
            remove(spark, before)
        before = path
    return docs

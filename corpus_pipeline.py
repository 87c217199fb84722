"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

Quality: documents that the classifier rejects go. Near duplicates: one document of each group stays.
Decontamination: documents that hold a window of a benchmark item go. Secrets: each span is replaced by a mark
in the text, and n_chars counted anew. The last stage encodes what is left and decodes it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.llm import bpe, decontaminate, jaccard, quality, secrets
from veridoc.llm.common import read_table, settle
from veridoc.shipping import ship


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    field = quality.train(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.with_scores(docs, field, score_name="__score", predicted_name="__predicted")
    return scored.where(F.col("__predicted") == 1).select(*docs.columns)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard.one_of_each(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return secrets.redact_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    return bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_distinct),
    ("benchmark decontamination", keep_uncontaminated),
    ("secret scans", mask_secrets),
    ("byte-level BPE", encode),
]

# A trained classifier and a MinHash forest are not SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

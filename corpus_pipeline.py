"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, secrets, and the mix of sources.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm.common import cut, drop, scratch, table
from shelfmark.llm.decontam import drop_contaminated
from shelfmark.llm.mixing import mix_sources
from shelfmark.llm.near_copies import keep_one_of_near_copies
from shelfmark.llm.secret_scan import redact_secrets
from shelfmark.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled ones among docs."""
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one_of_near_copies(docs, width=5, share=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), width=5, share=0.8)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken, copies, source."""
    return mix_sources(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mixing", mixing)]

#: The first stage is a trained classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder for the next; what a stage left there goes once its result stands.

    Texts without words (null, empty, white space alone) are no stage's target, but copies of each other for near_duplicates: of all
    of them the one with the least doc_id stays. Repeated rows are near copies, too, and an empty table gives an empty mix.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            made = cut(stage(spark, docs, sf_dir), name, lasting=True)
        drop(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)

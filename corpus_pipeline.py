"""The corpus pipeline: five stages over ``documents``, each written before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talentgrid.llm import mixing, neardup, packing, pii, quality, queries, tokens
from talentgrid.session import scratch, settle
from talentgrid.sources import stores

#: The share of all tokens that mixing keeps in expectation.
KEPT_SHARE = 0.5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or the posterior go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more."""
    return neardup.keep_one_each(docs, width=5, percent=80)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values are replaced in the text."""
    return pii.with_pseudonyms(docs, queries.PII_KEY)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by calibrated probabilities, to half of the tokens."""
    return mixing.sample_mix(docs, share=KEPT_SHARE)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, in sequences along the curve."""
    return packing.pack(docs, tokens.tokenizer_file("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("pseudonyms", pseudonyms),
    ("source mixing", source_mixing),
    ("sequence packing", sequence_packing),
]

#: Keyed pseudonyms and tokenizers have no SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each is stored and read again.

    What a stage stores for itself goes when its result is written, and that when the next
    one's is: in the end there is one folder, that of the pieces.
    """
    queries.workers_find_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES:
        with scratch(spark):
            docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
        for folder in before:
            stores.remove(spark, folder)
        before = [docs.inputFiles()[0].rpartition("/")[0]] if docs.inputFiles() else []
    return docs

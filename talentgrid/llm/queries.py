"""One query per operator of this package, over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentgrid.llm import (
    chat, covercodes, fingerprints, languages, mixing, neardup, negatives, neighbours, packing, pii,
    quality, sharding, token_counts, tokens,
)
from talentgrid.llm.oracle import LLM_ORACLE  # noqa: F401  registered with the queries
from talentgrid.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
LLM_QUERIES: dict[str, Query] = {}

#: For the given tables only; a real run passes a secret of its own.
PII_KEY = b"given tables"

#: Python workers find this package where the driver has it.
_ROOT = str(Path(__file__).resolve().parents[2])


def workers_find_package(spark: SparkSession) -> None:
    spark.sparkContext.environment.setdefault("PYTHONPATH", _ROOT)


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        workers_find_package(spark)
        return build(spark, sf_dir)

    run.__name__, run.__doc__ = build.__name__, build.__doc__
    LLM_QUERIES[build.__name__] = run
    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


@query
def op2_sharding(spark, sf_dir):
    rows = sharding.shard_rows(documents(spark, sf_dir), 16)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op4_token_counts(spark, sf_dir):
    """Counts with a cache that starts empty, so every distinct text is encoded once."""
    return token_counts.count_tokens(
        documents(spark, sf_dir), shared_folder(spark, "token-cache"),
        tokens.tokenizer_file("word_bpe_49k.json"),
    )


@query
def op8_quality_rules(spark, sf_dir):
    return quality.judge(documents(spark, sf_dir))


@query
def op10_chat_format(spark, sf_dir):
    """Every row as a record of the layout that its columns have, with conversation -7."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        "conv_id", "turn", "role", "text"
    )
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-7, 0, "user", probe), (-7, 1, "assistant", probe)],
        "conv_id long, turn long, role string, text string",
    )
    turns = chat.turns_of_columns(rows.unionByName(more), "conv_id", ["turn", "role", "text"])
    return chat.conversation_digests(chat.format_turns(turns, "conv_id"), "conv_id")


@query
def op5_curve_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), tokens.tokenizer_file("byte_bpe_50k.json"))


@query
def op6_minmax_neardup(spark, sf_dir):
    return neardup.near_duplicates(documents(spark, sf_dir), width=3, percent=85)


@query
def op1_simhash(spark, sf_dir):
    signed = fingerprints.fingerprint_documents(documents(spark, sf_dir))
    return fingerprints.with_near_counts(signed).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        "near_edited", "near_next", "n_near",
    )


@query
def op3_language_id(spark, sf_dir):
    return languages.identify(documents(spark, sf_dir))


@query
def op7_mixing(spark, sf_dir):
    """Half of the tokens in expectation, whatever the rarest cell."""
    return mixing.mix(documents(spark, sf_dir), share=mixing.SHARE)


@query
def op9_pseudonyms(spark, sf_dir):
    done = pii.pseudonymize_documents(documents(spark, sf_dir), PII_KEY)
    return done.select("doc_id", "text", F.size("spans").alias("n_found"), "spans")


@query
def op11_hard_negatives(spark, sf_dir):
    """Rows whose id seven divides get the next label first, which makes some neighbours negatives."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings(spark, sf_dir).withColumn("label", moved)
    return negatives.hard_negatives(rows, "vec_id % 50 = 0")


@query
def op12_nearest(spark, sf_dir):
    return neighbours.nearest(embeddings(spark, sf_dir), "vec_id % 20 = 0")


@query
def op13_vector_codes(spark, sf_dir):
    return covercodes.compress(embeddings(spark, sf_dir))

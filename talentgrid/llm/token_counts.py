"""Token counts with a stored cache of digests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentgrid.llm import tokens
from talentgrid.llm.common import no_null
from talentgrid.session import settle

#: Missing digests that every task may hold, 32 bytes each.
HELD = 100_000
CACHE_SCHEMA = "content binary, version string, n_tokens long"


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts: list[int] = []
            for start, end in tokens.blocks(texts):
                counts += tokens.count_tokens(texts[start:end], path)
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array(counts, pa.int64())], ["content", "n_tokens"]
            )

    return encode


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """One stored count for each content and version; none if nothing was stored yet.

    Two runs at once may both append a content, and so may a run that was started again:
    such copies hold one count and come out as one row.
    """
    return _stored(spark, folder).groupBy("content", "version").agg(
        F.min("n_tokens").alias("n_tokens")
    )


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def normal_content() -> Column:
    """Line feeds as blanks: the only change that surely leaves every count as it is.

    The vocabulary's own lower case and composition come after its special strings are
    found, so they can't be applied before the digest.
    """
    return F.replace(no_null(), F.lit("\n"), F.lit(" "))


def count_tokens(docs: DataFrame, cache_folder: str, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; null text counts as empty.

    ``cache_folder`` holds counts by digest of normalised content and of the vocabulary
    file. Distinct contents without a stored count are encoded once and appended, then
    every row takes its count from the stored table. Equal texts share one count; an
    empty table adds nothing. The vocabulary must drop white space.
    """
    spark = docs.sparkSession
    version = tokens.tokenizer_version(path)
    rows = docs.select(
        "doc_id", F.octet_length(no_null()).cast("long").alias("n_bytes"),
        normal_content().alias("text"),
    ).withColumn("content", F.unhex(F.sha2("text", 256)))
    # Ids and digests are stored, so that texts are hashed and read once here.
    digests = settle(rows.select("doc_id", "n_bytes", "content"), "digests")
    stored = read_cache(spark, cache_folder).where(F.col("version") == version)
    misses = settle(digests.select("content").distinct().join(stored, "content", "left_anti"), "misses")
    one_text = F.first("text").alias("text")
    if misses.count() <= HELD:
        # No text of a hit is shuffled.
        missing = rows.join(F.broadcast(misses), "content", "left_semi").groupBy("content").agg(one_text)
    else:
        # Copies meet on the map side, so a text that a third of all rows hold moves once a task.
        missing = rows.groupBy("content").agg(one_text).join(misses, "content", "left_semi")
    counted = missing.select("content", "text").mapInArrow(_encoder(path), "content binary, n_tokens long")
    counted.select("content", F.lit(version).alias("version"), "n_tokens").write.mode(
        "append"
    ).parquet(cache_folder)
    stored = read_cache(spark, cache_folder).where(F.col("version") == version)
    return digests.join(stored, "content").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )

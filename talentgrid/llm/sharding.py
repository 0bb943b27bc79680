"""Sharding: a Feistel permutation over global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.common import no_null, running_positions

ROUNDS = 6


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """One 64-bit key per round, drawn from the seed."""
    return [int(k) for k in np.random.default_rng(seed).integers(1, 2**63, rounds, dtype=np.int64)]


def _scrambled(half: np.ndarray, key: int) -> np.ndarray:
    """The round function: a keyed 64-bit mix, of which the caller takes the low bits."""
    x = half + np.uint64(key)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def permute(numbers: np.ndarray, size: int, keys: list[int]) -> np.ndarray:
    """A permutation of 0..size-1, the same for the same keys.

    A balanced Feistel network permutes the smallest power of 4 that holds ``size``;
    a number that leaves the range walks on along its cycle until it is back in it. The
    domain is less than four times the range, so a walk takes four steps on average.
    """
    if size <= 1:
        return np.zeros_like(numbers)
    bits = max(1, ((size - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << bits) - 1)
    out = numbers.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        x = out[walking]
        left, right = x >> np.uint64(bits), x & low
        for key in keys:
            left, right = right, left ^ (_scrambled(right, key) & low)
        out[walking] = (left << np.uint64(bits)) | right
        walking = walking[out[walking] >= size]
    return out.astype(np.int64)


def permuted(number: str, size: int, seed: int):
    """Column: the permuted row number."""
    keys = round_keys(seed)

    @F.pandas_udf("long")
    def apply(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(np.int64), size, keys))

    return apply(number)


def shard_rows(docs: DataFrame, shards: int, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row.

    Row numbers follow (doc_id, text_crc32, size), null ids first; rows equal in all
    three are interchangeable. The permuted number p gives shard p mod ``shards`` and
    slot p div ``shards``: shard sizes differ by one row at most, slots have no gap, and
    where a row goes is computed from its number alone. Null text counts as empty, and
    an empty table gives no row. Only ids, sizes and checksums are shuffled.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    rows = docs.select(
        "doc_id",
        (F.octet_length(no_null()) + 1).cast("long").alias("size"),
        F.crc32(no_null()).alias("text_crc32"),
    )
    numbered = running_positions(rows, ["doc_id", "text_crc32", "size"], None, "number")
    total = docs.count()
    return numbered.withColumn("place", permuted("number", total, seed)).select(
        "doc_id", "size", "text_crc32",
        F.expr(f"cast(place % {shards} as int)").alias("shard"),
        F.expr(f"place div {shards}").alias("slot"),
    )

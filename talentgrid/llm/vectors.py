"""What the operators on vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(vector: str = "embedding") -> Column:
    """A vector with components, none of them null, NaN or infinite; never null itself."""
    v = F.col(vector)
    finite = F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite, F.lit(False))


def one_row_per_id(df: DataFrame, *columns: str) -> DataFrame:
    """Of rows that share a vec_id the smallest by ``columns``; rows without an id go."""
    return (
        df.where("vec_id IS NOT NULL").groupBy(F.col("vec_id").cast("long").alias("vec_id"))
        .agg(F.min(F.struct(*columns)).alias("row")).select("vec_id", "row.*")
    )


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def one_length(least: int | None, most: int | None) -> int:
    """The common length of all vectors; raises if there are several."""
    if least != most:
        raise ValueError(f"vectors of {least} to {most} components cannot be compared")
    return int(least or 0)


def hashed_block(blocks: Column, *columns: str) -> Column:
    """The number of a row's block, by the hash of ``columns``."""
    return F.pmod(F.xxhash64(*columns), blocks.cast("long")).cast("int")


def block_numbers(blocks: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1))

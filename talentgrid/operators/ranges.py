"""Work along a total order without one task that sees it whole.

Rows are range-partitioned by the whole order and stored with the number of their range.
Each range is summed alone; what meets in one place is one sum for each range, and key.
Quantiles are read from such running counts, so no row ever holds all values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.session import settle


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str,
                 name: str, total: str | None = None) -> DataFrame:
    """Adds the sum of ``value`` over a row and all earlier rows of its ``keys``.

    ``order`` must tell the rows of a key apart. ``total`` names a further column with
    the key's whole sum. A key with any share of the rows spreads over many ranges.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = settle(
        df.repartitionByRange(ranges, *[F.asc(k) for k in keys], *order).withColumn(
            "_range", F.spark_partition_id()
        ),
        "ranges",
    )
    spans = placed.groupBy("_range", *keys).agg(F.sum(value).alias("_sum"))
    # As many rows as there are ranges and keys together.
    key = Window.partitionBy(*keys)
    earlier = key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = spans.select(
        F.col("_range").alias("_r"), *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_sum").over(key).alias("_total"),
    )
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    within = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    summed = placed.withColumn("_within", F.sum(value).over(within)).join(before, same)
    added = {name: F.col("_before") + F.col("_within")} | ({total: F.col("_total")} if total else {})
    return summed.withColumns(added).select(*df.columns, *added)


def _order_statistics(df: DataFrame, value: str, wanted: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row: for each name the sorted value at the 0-based index made from the count."""
    folded = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(
        F.count(F.lit(1)).alias("c")
    )
    counted = running_sums(folded, [], [F.asc("v")], "c", "upto", total="n")
    here = [
        F.max(F.when((F.col("upto") - F.col("c") <= of(F.col("n"))) & (of(F.col("n")) < F.col("upto")), F.col("v")))
        .alias(name)
        for name, of in wanted.items()
    ]
    return counted.agg(*here, F.max("n").alias("_n"))


def linear_quantiles(df: DataFrame, value: str, fractions: dict[str, float]) -> DataFrame:
    """One row of linearly interpolated quantiles: position q * (n - 1)."""
    wanted = {}
    for name, q in fractions.items():
        wanted[f"_low_{name}"] = lambda n, q=q: F.floor(F.lit(q) * (n - 1))
        wanted[f"_high_{name}"] = lambda n, q=q: F.ceil(F.lit(q) * (n - 1))
    found = _order_statistics(df, value, wanted)

    def between(name: str, q: float) -> Column:
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        place = F.lit(q) * (F.col("_n") - 1)
        over = place - F.floor(place)
        return F.when(low == high, low).otherwise((1 - over) * low + over * high).alias(name)

    return found.select(*[between(name, q) for name, q in fractions.items()])


def indexed_quantiles(df: DataFrame, value: str, fractions: dict[str, float]) -> DataFrame:
    """One row of plain order statistics: sorted[int(q * n)]."""
    wanted = {
        name: lambda n, q=q: F.least(F.floor(F.lit(q) * n), n - 1) for name, q in fractions.items()
    }
    return _order_statistics(df, value, wanted).drop("_n")


def lower_quantiles(df: DataFrame, value: str, fractions: dict[str, float]) -> DataFrame:
    """One row of order statistics from below: sorted[int(q * (n - 1))]."""
    wanted = {name: lambda n, q=q: F.floor(F.lit(q) * (n - 1)) for name, q in fractions.items()}
    return _order_statistics(df, value, wanted).drop("_n")

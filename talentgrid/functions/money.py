"""Salary arithmetic in decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid import fixed_values as fv

_RATE_TYPE = "decimal(12,7)"
ANNUAL_TYPE = "decimal(24,2)"


def usd_rates(spark) -> DataFrame:
    """The fixed currency table (47 rows)."""
    rows = list(fv.USD_PER_UNIT.items())
    return spark.createDataFrame(rows, "salary_currency string, rate string").select(
        "salary_currency", F.col("rate").cast(_RATE_TYPE).alias("usd_rate")
    )


def with_usd_rate(df: DataFrame, currency: str = "salary_currency") -> DataFrame:
    """Add ``usd_rate``; unknown or missing currency counts as USD.

    The fixed table is the broadcast side, so the postings are never shuffled.
    """
    rates = usd_rates(df.sparkSession).withColumnRenamed("salary_currency", currency)
    return df.join(F.broadcast(rates), currency, "left").withColumn(
        "usd_rate", F.coalesce("usd_rate", F.lit("1").cast(_RATE_TYPE))
    )


def periods_per_year(period: Column) -> Column:
    """Pay periods per year; unknown or missing periods count as annual."""
    factor = F.lit(1)
    for spellings, count in reversed(fv.PERIODS_PER_YEAR):
        factor = F.when(F.lower(period).isin(*spellings), F.lit(count)).otherwise(factor)
    return factor


def _annual(amount: Column) -> Column:
    yearly = amount.cast("decimal(14,0)") * periods_per_year(F.col("salary_period")).cast(
        "decimal(4,0)"
    )
    # Wide enough for any int amount, period and rate of the table type.
    return (yearly * F.col("usd_rate")).cast(ANNUAL_TYPE)


def annual_usd_salaries(df: DataFrame) -> DataFrame:
    """Add salary_min_annual_usd, salary_max_annual_usd and salary_annual_usd."""
    bounds = with_usd_rate(df).withColumns(
        {
            "salary_min_annual_usd": _annual(F.col("salary_min")),
            "salary_max_annual_usd": _annual(F.col("salary_max")),
        }
    )
    low, high = F.col("salary_min_annual_usd"), F.col("salary_max_annual_usd")
    middle = ((low + high) / F.lit(2).cast("decimal(1,0)")).cast(ANNUAL_TYPE)
    return bounds.withColumn("salary_annual_usd", F.coalesce(middle, low, high)).drop("usd_rate")


def salary_midpoint() -> Column:
    return (F.col("salary_min").cast("double") + F.col("salary_max").cast("double")) / 2

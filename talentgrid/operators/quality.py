"""Data-quality reports and table counters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.operators.postings import expand_skills


def _blank(name: str) -> Column:
    return F.col(name).isNull() | (F.trim(F.col(name)) == "")


def quality_report(jobs: DataFrame, now: Column) -> DataFrame:
    """One row of defect counts; ``now`` decides what lies in the future."""
    low, high = F.col("salary_min"), F.col("salary_max")
    return jobs.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count_if(_blank("slug")).alias("missing_job_slug"),
        F.count_if(_blank("title")).alias("missing_title"),
        F.count_if(_blank("company_slug")).alias("missing_company"),
        F.count_if(_blank("country")).alias("missing_country"),
        F.count_if(F.col("published").isNull()).alias("missing_dates"),
        F.count_if((low < 0) | (high < 0) | (low > high)).alias("invalid_salaries"),
        F.count_if(F.col("published") > now).alias("future_dates"),
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many keys occur more than once."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.count_if(F.col("_n") > 1).alias("duplicate_keys"))


def missing_profile(df: DataFrame) -> DataFrame:
    """Columns with missing values, how many and what percentage - one pass."""
    names = df.columns
    nulls = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(name).isNull()).alias(name) for name in names],
    )
    long = nulls.unpivot("_rows", names, "column_name", "missing")
    return long.where(F.col("missing") > 0).select(
        "column_name", "missing", (F.col("missing") / F.col("_rows") * 100).alias("missing_pct")
    )


PROGRESS_COLUMNS = ("standardized_title", "seniority_level", "job_type", "work_mode", "country",
                    "salary_annual_usd")


def cleaning_progress(jobs: DataFrame, columns: Sequence[str] = PROGRESS_COLUMNS) -> DataFrame:
    """Rows in all and how many have each cleaned column filled."""
    return jobs.agg(
        F.count(F.lit(1)).alias("total"), *[F.count(c).alias(f"has_{c}") for c in columns]
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def company_job_counts(jobs: DataFrame) -> DataFrame:
    """Jobs and AI jobs per company."""
    return jobs.groupBy("company_slug").agg(
        F.count(F.lit(1)).alias("jobs_count"), F.count_if("ai").alias("jobs_ai_count")
    )


def distinct_currencies(rates: DataFrame, column: str = "currency_code") -> DataFrame:
    return rates.agg(F.count_distinct(column).alias("currencies"))


def url_success_rate(results: DataFrame) -> DataFrame:
    return results.agg((F.avg(F.col("success").cast("double")) * 100).alias("success_pct"))


def dataset_profile(postings: DataFrame) -> DataFrame:
    """First and last month, distinct values of each dimension and skill, all mentions.

    Dimension counts and skill counts are two aggregates of one row each: counting
    distinct over exploded rows would multiply every posting by its skills.
    """
    dims = postings.agg(
        F.min("published").alias("first_month"),
        F.max("published").alias("last_month"),
        F.count_distinct("country").alias("countries"),
        F.count_distinct("company_name").alias("companies"),
        F.count_distinct("standardized_title").alias("roles"),
        F.count_distinct("seniority_level").alias("levels"),
        F.sum(F.size("skills")).alias("mentions"),
    )
    skills = expand_skills(postings).agg(F.count_distinct("skill")).scalar()
    return dims.withColumn("skills", skills)

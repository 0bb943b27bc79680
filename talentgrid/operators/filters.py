"""Facet filters, facet values and overview metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.functions.dates import month_between
from talentgrid.functions.money import salary_midpoint

FACETS = ("country", "company_name", "job_type", "standardized_title", "seniority_level")


def facet_condition(filters: Mapping, month: str = "published") -> Column:
    """The conjunction of the given filters; 'All', None and absent mean no filter.

    Keys: ``date_range`` (start, end), any facet column, ``skills`` (any of).
    """
    conditions = [F.lit(True)]
    if filters.get("date_range"):
        start, end = filters["date_range"]
        conditions.append(month_between(F.col(month), start, end))
    for facet in FACETS:
        wanted = filters.get(facet)
        if wanted and wanted != "All":
            conditions.append(F.col(facet) == wanted)
    return reduce(lambda a, b: a & b, conditions)


def filter_any_skill(postings: DataFrame, skills: Sequence[str]) -> DataFrame:
    """Postings whose skills include any of the given ones."""
    wanted = F.array(*[F.lit(s.lower()) for s in skills])
    return postings.where(F.arrays_overlap("skills", wanted))


def filter_postings(postings: DataFrame, filters: Mapping) -> DataFrame:
    kept = postings.where(facet_condition(filters))
    return filter_any_skill(kept, filters["skills"]) if filters.get("skills") else kept


def filter_skill_rows(rows: DataFrame, filters: Mapping) -> DataFrame:
    """The same filters on pivot or skill rows; ``skills`` compares the skill column."""
    kept = rows.where(facet_condition(filters))
    wanted = [s.lower() for s in filters.get("skills") or []]
    return kept.where(F.col("skill").isin(*wanted)) if wanted else kept


def filter_summary(postings: DataFrame, filters: Mapping) -> DataFrame:
    """Rows in all, rows shown, reduction in percent - one pass."""
    shown = facet_condition(filters)
    if filters.get("skills"):
        wanted = F.array(*[F.lit(s.lower()) for s in filters["skills"]])
        shown = shown & F.arrays_overlap("skills", wanted)
    counted = postings.agg(F.count(F.lit(1)).alias("total"), F.count_if(shown).alias("shown"))
    reduction = F.try_divide(F.col("total") - F.col("shown"), F.col("total")) * 100
    return counted.withColumn("reduction_pct", F.coalesce(reduction, F.lit(0.0)))


def facet_values(postings: DataFrame, filters: Mapping | None = None,
                 more_than: int = 10) -> DataFrame:
    """Values of each facet seen more than ``more_than`` times, all facets in one scan.

    Facets cascade: the values offered for a facet respect the date range and the
    choices made in the facets before it.
    """
    filters = filters or {}
    allowed = facet_condition({"date_range": filters.get("date_range")})
    entries = []
    for facet in FACETS:
        entries.append(F.when(allowed, F.struct(F.lit(facet).alias("facet"),
                                                F.col(facet).alias("value"))))
        wanted = filters.get(facet)
        if wanted and wanted != "All":
            allowed = allowed & (F.col(facet) == wanted)
    rows = postings.select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
    counts = rows.where(F.col("e.value").isNotNull()).groupBy("e.facet", "e.value").agg(
        F.count(F.lit(1)).alias("jobs")
    )
    return counts.where(F.col("jobs") > more_than)


def filter_salary_range(jobs: DataFrame, above: float = 1000, below: float = 500000) -> DataFrame:
    """Add ``salary`` (the midpoint) and keep the plausible ones."""
    return jobs.withColumn("salary", salary_midpoint()).where(
        (F.col("salary") > above) & (F.col("salary") < below)
    )


def sample_ordered(jobs: DataFrame, n: int = 5) -> DataFrame:
    """The first n jobs with a salary by title, then job_slug."""
    return (
        jobs.where(F.col("salary_min") > 0)
        .select("job_slug", "title", "country", "salary_min", "salary_period",
                "salary_currency", "published")
        .orderBy("title", "job_slug")
        .limit(n)
    )


def overview_metrics(jobs: DataFrame) -> DataFrame:
    """Jobs, companies, mean skills per job, mean salary, jobs with a salary."""
    return jobs.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count_distinct("company_name").alias("companies"),
        F.avg("skills_count").alias("avg_skills_per_job"),
        F.avg(F.col("salary_annual_usd").cast("double")).alias("avg_salary_usd"),
        F.count("salary_annual_usd").alias("jobs_with_salary"),
    )

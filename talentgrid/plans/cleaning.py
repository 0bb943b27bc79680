"""The cleaning plan: raw jobs and companies to cleaned, classified postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentgrid.functions import text
from talentgrid.functions.dates import month_key
from talentgrid.functions.money import annual_usd_salaries
from talentgrid.functions.skills import remove_generic_skills, skills_count
from talentgrid.operators.keyed import cleaned_jobs, dedupe_earliest


def clean_country(jobs: DataFrame) -> DataFrame:
    """The rules run once for each different text, of which there are few."""
    texts = jobs.select(F.col("country").alias("_raw")).distinct()
    named = texts.withColumn("_named", text.standardize_country(F.col("_raw")))
    others = [F.col(c) for c in jobs.columns if c != "country"]
    return jobs.join(named, F.col("country").eqNullSafe(F.col("_raw")), "left").select(
        *others, F.col("country").alias("country_original"), F.col("_named").alias("country")
    )


def clean_employment(jobs: DataFrame) -> DataFrame:
    """job_type and work_mode from the first entry of ``types``, or from plain text."""
    plain = jobs.schema["types"].dataType == T.StringType()
    first = F.col("types") if plain else text.employment_text_of(F.col("types"))
    return jobs.withColumns({"job_type": text.job_type(first), "work_mode": text.work_mode(first)})


def clean_jobs(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """AI jobs with clean country, skills, month, salary, seniority and employment.

    The order matters: duplicates are judged on cleaned countries but on the skills
    and dates as they came. Only the duplicate check shuffles.
    """
    unique = dedupe_earliest(clean_country(cleaned_jobs(jobs, companies)))
    trimmed = unique.withColumns(
        {
            "skills": remove_generic_skills(F.col("skills")),
            "published": month_key(F.col("published")),
        }
    )
    leveled = annual_usd_salaries(trimmed).withColumn(
        "seniority_level", text.extract_seniority(F.col("title"))
    )
    return clean_employment(leveled).withColumn("skills_count", skills_count(F.col("skills")))

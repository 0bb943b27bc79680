"""Postings ready for analysis and the skill rows and counts made from them.

A *posting* row is one job with its dimensions and its distinct, normalized
skills. Counting distinct jobs never needs the job ids: a posting row is one job, and a
skill row one job and skill. All counts are therefore plain sums, combined on the map
side, whatever the skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid import fixed_values as fv
from talentgrid.functions.series import let
from talentgrid.functions.skills import names_any_skill, normalize_skills, skill_category
from talentgrid.functions.text import blank_to_null
from talentgrid.operators.keyed import require_columns
from talentgrid.session import settle

DIMENSIONS = (
    "published", "country", "company_name", "job_type", "work_mode", "standardized_title",
    "seniority_level",
)

#: Mentions of a pivot group that are counted inside one row.
LARGE_GROUP = 200_000


def fill_missing(jobs: DataFrame) -> DataFrame:
    """Blank text -> null; drop rows without month or skills; fill the other dimensions."""
    require_columns(jobs, *DIMENSIONS, "skills")
    blanked = jobs.withColumns({name: blank_to_null(F.col(name)) for name in DIMENSIONS})
    return blanked.dropna(subset=["published", "skills"]).fillna(fv.DIMENSION_DEFAULTS)


def prepare_postings(jobs: DataFrame) -> DataFrame:
    """Analysis-ready postings: one row per job, dimensions filled, skills normalized.

    Jobs left without a skill are dropped. ``skills`` must be an array; parse text
    with ``functions.skills.parse_skill_list`` first. Each input row is one job.
    """
    named = fill_missing(jobs).where(names_any_skill(F.col("skills")))
    return named.withColumn("skills", normalize_skills(F.col("skills")))


def expand_skills(postings: DataFrame, *keep: str) -> DataFrame:
    """One row per (job, skill) with the kept columns.

    The outer explode keeps Spark from testing for empty lists before the explode,
    which would evaluate the skill expression twice; rows of empty lists go after it.
    """
    exploded = postings.select(*keep, F.explode_outer("skills").alias("skill"))
    return exploded.where(F.col("skill").isNotNull())


def skill_categories(skills: Column) -> Column:
    """Distinct categories of a skill list; skills without a category give none."""
    return F.array_distinct(F.array_compact(F.transform(skills, skill_category)))


def values_of(postings: DataFrame, column: str) -> tuple[DataFrame, Column]:
    """(one row per job and distinct value, condition that a job has a value)."""
    if column == "skill":
        return expand_skills(postings), F.size("skills") > 0
    if column == "skill_category":
        mapped = postings.select(F.explode_outer(skill_categories(F.col("skills"))).alias(column))
        has_one = F.exists("skills", lambda x: skill_category(x).isNotNull())
        return mapped.where(F.col(column).isNotNull()), has_one
    require_columns(postings, column)
    return postings.where(F.col(column).isNotNull()), F.col(column).isNotNull()


def aggregate_by(postings: DataFrame, column: str = "skill") -> DataFrame:
    """Distinct jobs per value of a column and their share of the jobs that have one.

    The total is a scalar count of postings: no explode, one column read.
    """
    rows, counted = values_of(postings, column)
    total = postings.agg(F.count_if(counted)).scalar()
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("mentions")).select(
        column,
        "mentions",
        (F.col("mentions") / total * 100).alias("prevalence"),
        total.alias("total_jobs"),
    )


def order_by_metric(df: DataFrame, metric: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(metric), F.asc(key))


def skill_frequency(postings: DataFrame, top_n: int = 20) -> DataFrame:
    return order_by_metric(aggregate_by(postings, "skill"), "mentions", "skill").limit(top_n)


def skill_category_frequency(postings: DataFrame, top_n: int = 10) -> DataFrame:
    ranked = order_by_metric(
        aggregate_by(postings, "skill_category"), "mentions", "skill_category"
    )
    return ranked.limit(top_n)


def skill_cells(postings: DataFrame) -> DataFrame:
    """Distinct jobs per (seven dimensions, skill)."""
    return expand_skills(postings, *DIMENSIONS).groupBy(*DIMENSIONS, "skill").agg(
        F.count(F.lit(1)).alias("mentions")
    )


def share_in_group(cells: DataFrame, group: list[str], value: str = "mentions") -> DataFrame:
    """``value`` as a percentage of its group's sum.

    Group sums are joined back instead of using a window: a group holding a third
    of the cells can then be split by the skew join. A digest of the group leads the
    join key, so that sorting compares one number and seldom the text.
    """
    keyed = cells.withColumn("_digest", F.xxhash64(*group))
    sums = keyed.groupBy("_digest", *group).agg(F.sum(value).alias("_group_sum"))
    joined = keyed.join(sums, ["_digest", *group])
    return joined.withColumn("prevalence", F.col(value) / F.col("_group_sum") * 100).drop(
        "_digest", "_group_sum"
    )


def _sorted_cells(flat: Column) -> Column:
    """(skill, mentions) of a sorted list, each skill once."""
    n = F.size(flat)
    starts = F.filter(
        F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(flat, i - 1) != F.get(flat, i - 2))
    )
    return let(starts, lambda at: F.transform(
        at, lambda i, k: F.struct(
            F.get(flat, i - 1).alias("skill"),
            (F.coalesce(F.get(at, k + 1), n + 1) - i).cast("long").alias("mentions"),
        )
    ))


def _cells_by_row(postings: DataFrame) -> DataFrame:
    """``share_in_group`` of ``skill_cells``, each group counted inside one row."""
    lists = postings.groupBy("_digest", *DIMENSIONS).agg(F.collect_list("skills").alias("_lists"))
    flat = lists.select(
        *DIMENSIONS, F.array_sort(F.array_compact(F.flatten("_lists"))).alias("_flat")
    ).where(F.size("_flat") > 0)
    cells = flat.select(
        *DIMENSIONS, F.size("_flat").alias("_n"), F.inline(_sorted_cells(F.col("_flat")))
    )
    return cells.select(
        *DIMENSIONS, "skill", "mentions", (F.col("mentions") / F.col("_n") * 100).alias("prevalence")
    )


def skill_pivot(postings: DataFrame, large: int = LARGE_GROUP) -> DataFrame:
    """The skill pivot without job ids: counts, share of mentions in the group, category.

    Postings are stored once and meet by group, one row each with its list, so no cell is
    shuffled or sorted. Groups of more than ``large`` mentions, of which there are no more
    than all mentions / ``large``, are counted by cells combined on the map side instead.
    """
    digest = F.xxhash64(*DIMENSIONS).alias("_digest")
    kept = postings.where(F.size("skills") > 0).dropna(subset=list(DIMENSIONS))
    rows = settle(kept.select(digest, *DIMENSIONS, "skills"), "pivot-postings")
    mentions = rows.groupBy("_digest").agg(F.sum(F.size("skills")).alias("n"))
    held = [r["_digest"] for r in mentions.where(F.col("n") > large).select("_digest").collect()]
    if held:
        shared = _cells_by_row(rows.where(~F.col("_digest").isin(held))).unionByName(
            share_in_group(skill_cells(rows.where(F.col("_digest").isin(held))), list(DIMENSIONS))
        )
    else:
        shared = _cells_by_row(rows)
    return shared.select(
        *DIMENSIONS,
        "skill",
        F.col("mentions").alias("total_jobs"),
        "mentions",
        "prevalence",
        skill_category(F.col("skill")).alias("skill_category"),
    )


def pivot_job_ids(postings: DataFrame) -> DataFrame:
    """The job ids behind every pivot cell, one row per (cell, job).

    A cell may stand for a third of all jobs, so its ids are rows, never one array.
    """
    require_columns(postings, "job_id")
    return expand_skills(postings, "job_id", *DIMENSIONS).select(*DIMENSIONS, "skill", "job_id")


def postings_of_rows(rows: DataFrame) -> DataFrame:
    """Postings from skill rows (job_id, dimensions, skill), such as a stored pivot's.

    After a filter on the rows a posting has the skills that are left, so every
    operator on postings also answers for a saved and filtered pivot. One shuffle by job.
    """
    require_columns(rows, "job_id", *DIMENSIONS, "skill")
    return rows.groupBy("job_id", *DIMENSIONS).agg(
        F.array_sort(F.collect_set("skill")).alias("skills")
    )


def distinct_skill_rows(rows: DataFrame) -> DataFrame:
    """Distinct (job_id, skill) rows of any long skill table."""
    return rows.select("job_id", "skill").dropna().distinct()


def jobs_with_enough_skills(rows: DataFrame, at_least: int = 2) -> DataFrame:
    """Skill rows of jobs that have at least ``at_least`` skills."""
    enough = rows.groupBy("job_id").agg(F.count("skill").alias("_n")).where(
        F.col("_n") >= at_least
    )
    return rows.join(enough, "job_id", "left_semi")

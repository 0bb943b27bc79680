"""Skill profiles by role, seniority level, country or any other dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid import fixed_values as fv
from talentgrid.operators.keyed import level_rank, require_columns, top_per_group
from talentgrid.operators.postings import DIMENSIONS, expand_skills


def group_skill_counts(postings: DataFrame, group: str) -> DataFrame:
    """(group, skill): distinct jobs naming the skill."""
    require_columns(postings, group)
    return expand_skills(postings.dropna(subset=[group]), group).groupBy(group, "skill").agg(
        F.count(F.lit(1)).alias("mentions")
    )


def group_totals(postings: DataFrame, group: str) -> DataFrame:
    """Jobs with a skill in each group: postings are counted, nothing is exploded."""
    return postings.where(F.col(group).isNotNull() & (F.size("skills") > 0)).groupBy(group).agg(
        F.count(F.lit(1)).alias("total_jobs")
    )


def with_group_totals(postings: DataFrame, group: str) -> DataFrame:
    """(group, skill) counts with the group's distinct jobs and the share of them.

    Totals are summed on the map side and joined back, so a group with very many skills
    never meets in one task.
    """
    counts = group_skill_counts(postings, group)
    return counts.join(group_totals(postings, group), group).select(
        group, "skill", "mentions", "total_jobs",
        (F.col("mentions") / F.col("total_jobs") * 100).alias("prevalence"),
    )


def skills_by_group(postings: DataFrame, group: str, top_n: int = 15) -> DataFrame:
    """The top skills of every group with their rank.

    The leading rows are found on the counts alone, which keeps ``top_n`` rows of a
    group before the shuffle; only those meet the totals.
    """
    counts = group_skill_counts(postings, group)
    top = top_per_group(
        counts, [group], [F.desc("mentions"), F.asc("skill")], top_n, rank_as="rank"
    )
    return top.join(group_totals(postings, group), group).select(
        group, "skill", "mentions", "total_jobs",
        (F.col("mentions") / F.col("total_jobs") * 100).alias("prevalence"), "rank",
    )


def skills_by_role(postings: DataFrame, top_n: int = 15) -> DataFrame:
    return skills_by_group(postings, "standardized_title", top_n)


def skills_by_seniority(postings: DataFrame, top_n: int = 15) -> DataFrame:
    return skills_by_group(postings, "seniority_level", top_n)


def skills_by_country(postings: DataFrame, top_n: int = 10) -> DataFrame:
    return skills_by_group(postings, "country", top_n)


def role_profile(postings: DataFrame, roles: list[str] | None = None) -> DataFrame:
    """(skill, role, prevalence): the ten leading skills of each role, long form."""
    top = skills_by_role(postings, 20).where(F.col("rank") <= 10)
    if roles:
        top = top.where(F.col("standardized_title").isin(*roles))
    return top.select("skill", "standardized_title", "prevalence")


def role_comparison(postings: DataFrame, roles: list[str] | None = None) -> DataFrame:
    """Wide skill x role prevalence, 0 where a role does not list the skill.

    Naming the roles spares Spark a job to find them.
    """
    profile = role_profile(postings, roles).groupBy("skill")
    wide = profile.pivot("standardized_title", roles) if roles else profile.pivot(
        "standardized_title"
    )
    return wide.agg(F.first("prevalence")).fillna(0.0)


def top_rows_by_mean(profile: DataFrame, top_n: int = 15) -> DataFrame:
    """Skills with the highest mean prevalence over all roles, absent roles counting 0."""
    roles = profile.agg(F.count_distinct("standardized_title")).scalar()
    means = profile.groupBy("skill").agg(F.sum("prevalence").alias("_sum"))
    return (
        means.select("skill", (F.col("_sum") / roles).alias("mean_prevalence"))
        .orderBy(F.desc("mean_prevalence"), F.asc("skill"))
        .limit(top_n)
    )


def skill_progression(postings: DataFrame, skills: list[str]) -> DataFrame:
    """(skill, level): number of pivot cells, and that as a share of the level's jobs.

    Cells, not jobs, are counted; asked-for skills are lower-cased to match.
    """
    wanted = F.array(*[F.lit(s.lower()) for s in skills])
    asked = postings.withColumn("skills", F.array_intersect("skills", wanted))
    cells = expand_skills(asked, *DIMENSIONS).select(*DIMENSIONS, "skill").distinct()
    counts = cells.groupBy("skill", "seniority_level").agg(F.count(F.lit(1)).alias("mentions"))
    totals = postings.groupBy("seniority_level").agg(F.count(F.lit(1)).alias("total_jobs"))
    return counts.join(totals, "seniority_level").select(
        "skill", "seniority_level",
        (F.col("mentions") / F.col("total_jobs") * 100).alias("prevalence"),
        "mentions", "total_jobs",
    )


def charted_levels(progression: DataFrame) -> DataFrame:
    return progression.where(F.col("seniority_level").isin(*fv.PROGRESSION_LEVELS))


def progression_heatmap(progression: DataFrame) -> DataFrame:
    """Wide skill x level prevalence, 0-filled, with the mean over the levels present.

    Levels no skill has are no columns in the mean; they show as 0.
    """
    charted = charted_levels(progression)
    present = charted.agg(F.count_distinct("seniority_level")).scalar()
    wide = (
        charted.groupBy("skill")
        .pivot("seniority_level", fv.PROGRESSION_LEVELS)
        .agg(F.first("prevalence"))
        .fillna(0.0)
    )
    row_sum = sum((F.col(f"`{level}`") for level in fv.PROGRESSION_LEVELS), F.lit(0.0))
    return wide.withColumn("mean_prevalence", row_sum / present).orderBy(
        F.desc("mean_prevalence"), F.asc("skill")
    )


def order_by_level(progression: DataFrame) -> DataFrame:
    """Every skill at every level present, in level order, 0 where missing."""
    charted = charted_levels(progression)
    levels = F.array(*[F.lit(level) for level in fv.PROGRESSION_LEVELS])
    present = charted.agg(F.collect_set("seniority_level")).scalar()
    per_skill = charted.groupBy("skill").agg(
        F.map_from_entries(F.collect_list(F.struct("seniority_level", "prevalence"))).alias("_by")
    )
    spread = per_skill.select(
        "skill", "_by", F.explode(F.array_intersect(levels, present)).alias("seniority_level")
    )
    return spread.select(
        "skill", "seniority_level",
        F.array_position(levels, F.col("seniority_level")).alias("level_rank"),
        F.coalesce(F.try_element_at("_by", F.col("seniority_level")), F.lit(0.0)).alias(
            "prevalence"
        ),
    ).orderBy("skill", "level_rank")


def top_by_avg_prevalence(progression: DataFrame, top_n: int = 6) -> DataFrame:
    return (
        progression.groupBy("skill")
        .agg(F.avg("prevalence").alias("avg_prevalence"))
        .orderBy(F.desc("avg_prevalence"), F.asc("skill"))
        .limit(top_n)
    )


def peak_level(progression: DataFrame) -> DataFrame:
    """Per skill the level with the highest prevalence, its range and a pattern label."""
    rank = level_rank(F.col("seniority_level"))
    summary = progression.groupBy("skill").agg(
        F.max_by("seniority_level", F.struct("prevalence", -rank)).alias("peak_level"),
        F.max("prevalence").alias("max_prevalence"),
        F.min("prevalence").alias("min_prevalence"),
        F.avg("prevalence").alias("avg_prevalence"),
    )
    pattern = (
        F.when(F.col("peak_level").isin("Entry-level", "Junior"), "early specialization")
        .when(F.col("peak_level").isin("Lead", "Executive"), "leadership-focused")
        .otherwise("core competency")
    )
    return summary.withColumn("pattern", pattern)

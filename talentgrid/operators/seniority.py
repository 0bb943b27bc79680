"""What sets each seniority level apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentgrid import fixed_values as fv
from talentgrid.operators.groups import with_group_totals
from talentgrid.operators.keyed import level_rank, top_per_group
from talentgrid.operators.ranges import running_sums

LEVEL = "seniority_level"


def level_skills(postings: DataFrame) -> DataFrame:
    """(level, skill) counts and prevalence for the known levels."""
    known = postings.where(F.col(LEVEL).isin(*fv.SENIORITY_ORDER))
    return with_group_totals(known, LEVEL)


def seniority_patterns(postings: DataFrame, top_n: int = 5) -> DataFrame:
    """Per level its top skills, jobs and number of skills, one row per (level, skill)."""
    skills = level_skills(postings)
    sizes = skills.groupBy(LEVEL).agg(F.count(F.lit(1)).alias("total_skills"))
    top = top_per_group(
        skills, [LEVEL], [F.desc("prevalence"), F.asc("skill")], top_n, rank_as="rank"
    )
    return top.join(sizes, LEVEL).select(
        LEVEL, level_rank(F.col(LEVEL)).alias("level_rank"), "total_jobs", "total_skills",
        "rank", "skill", "prevalence",
    )


def level_specific_skills(postings: DataFrame, progression: DataFrame, threshold: float = 1.2,
                          max_skills: int = 3) -> DataFrame:
    """Skills more prevalent at a level than in the progression on average, by ratio."""
    overall = progression.groupBy("skill").agg(
        F.avg("prevalence").alias("overall_avg_prevalence")
    ).where(F.col("overall_avg_prevalence") > 0)
    compared = level_skills(postings).join(overall, "skill").select(
        LEVEL, "skill", F.col("prevalence").alias("level_prevalence"), "overall_avg_prevalence",
        (F.col("prevalence") / F.col("overall_avg_prevalence")).alias("importance_ratio"),
        (F.col("prevalence") - F.col("overall_avg_prevalence")).alias("prevalence_difference"),
    ).where(F.col("importance_ratio") >= threshold)
    return top_per_group(
        compared, [LEVEL],
        [F.desc("importance_ratio"), F.desc("level_prevalence"), F.asc("skill")],
        max_skills, rank_as="rank",
    )


def skill_diversity(postings: DataFrame) -> DataFrame:
    """Per level: concentration index, top share, mentions per job, skills above 10 %.

    The index sums cumulative shares over skills in descending order. Equal skills
    are folded first - a level has at most about sqrt(2 x mentions) different counts,
    however many skills - and a block of c equal shares p after k larger ones adds
    p * (c*(n-k) - c*(c-1)/2) to the sum.
    """
    skills = level_skills(postings)
    blocks = skills.groupBy(LEVEL, "prevalence", "mentions", "total_jobs").agg(
        F.count(F.lit(1)).alias("equal")
    )
    level = Window.partitionBy(LEVEL)
    above = level.orderBy(F.desc("prevalence")).rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumns(
        {
            "larger": F.coalesce(F.sum("equal").over(above), F.lit(0)),
            "n": F.sum("equal").over(level),
        }
    )
    equal, n = F.col("equal"), F.col("n")
    weight = equal * (n - F.col("larger")) - equal * (equal - 1) / F.lit(2.0)
    summed = placed.groupBy(LEVEL).agg(
        F.sum(F.col("prevalence") * weight).alias("_cumulative"),
        F.sum(F.col("prevalence") * equal).alias("_total"),
        F.max("n").alias("_n"),
        F.max("prevalence").alias("_top"),
        F.sum(F.col("mentions") * equal).alias("_mentions"),
        F.max("total_jobs").alias("_jobs"),
        F.sum(F.when(F.col("prevalence") > 10, equal).otherwise(0)).alias(
            "high_prevalence_skills"
        ),
    )
    # linspace(0, 1, n) sums to n/2.
    index = (F.col("_cumulative") / F.col("_total") - F.col("_n") / F.lit(2.0)) / F.col("_n")
    return summed.select(
        LEVEL,
        F.when(F.col("_n") > 1, index).otherwise(F.lit(0.0)).alias("concentration_index"),
        (F.col("_top") / F.col("_total")).alias("top_skill_dominance"),
        (F.col("_mentions") / F.col("_jobs")).alias("skills_per_job"),
        "high_prevalence_skills",
    )


def cumulative_share(postings: DataFrame) -> DataFrame:
    """Running share of prevalence over a level's skills, largest first.

    A level's prevalences have one denominator, so the shares are those of the mentions:
    whole numbers, summed range by range. A level of many skills lies in many ranges.
    """
    order = [F.desc("mentions"), F.asc("skill")]
    summed = running_sums(level_skills(postings), [LEVEL], order, "mentions", "_upto", "_all")
    share = F.col("_upto") / F.col("_all")
    return summed.select(LEVEL, "skill", "prevalence", share.alias("cumulative_share"))


def normalized_level_comparison(postings: DataFrame) -> DataFrame:
    """Jobs, skills and skills per job of a level, each over its maximum (8 levels)."""
    per_level = level_skills(postings).groupBy(LEVEL).agg(
        F.max("total_jobs").alias("total_jobs"),
        F.count(F.lit(1)).alias("total_skills"),
        F.sum("mentions").alias("_mentions"),
    ).withColumn("skills_per_job", F.col("_mentions") / F.col("total_jobs"))
    names = ("total_jobs", "total_skills", "skills_per_job")
    peaks = per_level.agg(F.struct(*[F.max(name).alias(name) for name in names])).scalar()
    return per_level.withColumn("_peaks", peaks).select(
        LEVEL,
        *[
            (F.col(name) / F.col("_peaks")[name]).alias(f"{name}_normalized")
            for name in names
        ],
    )

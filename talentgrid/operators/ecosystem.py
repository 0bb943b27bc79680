"""Which skills span roles and which belong to one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.operators.groups import role_profile, skills_by_role
from talentgrid.operators.keyed import top_per_group
from talentgrid.operators.pairs import pair_prevalence, skill_clusters

ROLE = "standardized_title"


def universal_specialized(postings: DataFrame, top_n: int = 10) -> DataFrame:
    """Universal: in at least 60 % of roles, above 15 % on average. Specialized: in one
    role, above 25 %. Judged over each role's top 20 skills; top_n of each kind."""
    top = skills_by_role(postings, 20)
    roles = top.agg(F.count_distinct(ROLE)).scalar()
    spread = top.groupBy("skill").agg(
        F.count(F.lit(1)).alias("role_count"),
        F.avg("prevalence").alias("avg_prevalence"),
        F.min(ROLE).alias("_role"),
    ).withColumn("total_roles", roles)
    average = F.col("avg_prevalence")
    kind = F.when(
        (F.col("role_count") >= F.col("total_roles") * 0.6) & (average > 15), "universal"
    ).when((F.col("role_count") == 1) & (average > 25), "specialized")
    judged = spread.withColumn("kind", kind).where(F.col("kind").isNotNull())
    best = top_per_group(
        judged, ["kind"], [F.desc("avg_prevalence"), F.asc("skill")], top_n, rank_as="rank"
    )
    return best.select(
        "kind", "rank", "skill", "role_count", "total_roles",
        F.when(F.col("kind") == "specialized", F.col("_role")).alias("primary_role"),
        "avg_prevalence",
    )


def role_specializations(postings: DataFrame, roles: list[str] | None = None) -> DataFrame:
    """Per role its ten leading skills and their mean prevalence.

    Skills a role does not list count 0, so a role with fewer than ten skills of
    its own is filled up with zeros as long as other roles list more skills.
    """
    profile = role_profile(postings, roles)
    all_skills = profile.agg(F.count_distinct("skill")).scalar()
    per_role = profile.groupBy(ROLE).agg(
        F.sort_array(
            F.collect_list(F.struct((-F.col("prevalence")).alias("p"), "skill"))
        ).alias("_top"),
        F.sum("prevalence").alias("_sum"),
    )
    return per_role.select(
        ROLE,
        F.array_join(F.transform("_top", lambda t: t["skill"]), ", ").alias("top_skills"),
        (F.col("_sum") / F.least(F.lit(10), all_skills)).alias("skill_intensity"),
    )


def ecosystem_rows(postings: DataFrame) -> DataFrame:
    """The whole report in long form: (part, key, item, value)."""
    parts = skill_ecosystem(postings)
    shapes = {
        "top_combinations": ("skill_1", F.col("skill_2"), "mentions"),
        "natural_clusters": ("core_skill", F.array_join("skills", "|"), "avg_co_occurrence"),
        "role_specializations": (ROLE, F.col("top_skills"), "skill_intensity"),
        "skill_universality": ("kind", F.col("skill"), "avg_prevalence"),
    }
    rows = [
        parts[part].select(
            F.lit(part).alias("part"), F.col(key).alias("key"), item.alias("item"),
            F.col(value).cast("double").alias("value"),
        )
        for part, (key, item, value) in shapes.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def skill_ecosystem(postings: DataFrame) -> dict[str, DataFrame]:
    """The whole report: pairs, clusters, role profiles, universality. All lazy."""
    return {
        "top_combinations": pair_prevalence(postings, 15),
        "natural_clusters": skill_clusters(postings),
        "role_specializations": role_specializations(postings),
        "skill_universality": universal_specialized(postings),
    }

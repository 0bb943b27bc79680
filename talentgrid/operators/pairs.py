"""Skills named together: pair counts, overlap of their job sets, clusters.

A posting's skills sit in one row, so its pairs are written out by two chained
explodes inside the row and counted on the map side: no self-join, no shuffle of
postings, and nothing larger than the row is held. Where only pairs of enough jobs are
wanted, skills with fewer jobs leave the postings first: no pair is more frequent than
either of its skills, so nothing is lost and rare skills write no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.functions.series import let
from talentgrid.functions.skills import pair_domain_label
from talentgrid.operators.keyed import require_columns
from talentgrid.operators.postings import expand_skills, skill_frequency

#: Names that are looked up inside a posting's row. More are joined to its skills.
LISTED = 1000


def skill_jobs(postings: DataFrame) -> DataFrame:
    """(skill, jobs naming it)."""
    return expand_skills(postings).groupBy("skill").agg(F.count(F.lit(1)).alias("mentions"))


def with_only(postings: DataFrame, names: DataFrame, *keep: str, listed: int = LISTED) -> DataFrame:
    """Kept columns and skills of postings, cut to the skills in ``names``.

    At most ``listed`` names are held as one set; the driver reads no more than one name
    beyond that. If there are more, postings are taken apart, joined with the names and put
    together by job_id. Postings without any such skill go.
    """
    held = [r["skill"] for r in names.select("skill").limit(listed + 1).collect()]
    if len(held) <= listed:
        cut = F.filter("skills", lambda s: s.isin(held)) if held else F.slice("skills", 1, 0)
        return postings.select(*keep, cut.alias("skills")).where(F.size("skills") > 0)
    require_columns(postings, "job_id")
    rows = expand_skills(postings, "job_id", *keep).join(names.select("skill").distinct(), "skill", "left_semi")
    return rows.groupBy("job_id", *keep).agg(F.collect_list("skill").alias("skills")).drop("job_id")


def pair_rows(postings: DataFrame, *keep: str) -> DataFrame:
    """One row per (job, skill_1 < skill_2)."""
    ordered = postings.select(*keep, F.array_sort("skills").alias("_s"))
    firsts = ordered.select(*keep, "_s", F.posexplode("_s").alias("_at", "skill_1"))
    rest = F.slice("_s", F.col("_at") + 2, F.size("_s"))
    return firsts.select(*keep, "skill_1", F.explode(rest).alias("skill_2"))


def pair_counts(postings: DataFrame, fewest: int = 2, most: int | None = None,
                least: int = 1) -> DataFrame:
    """Pairs that ``least`` jobs or more name; a job has ``fewest`` skills or more, and
    ``most`` if given."""
    sized = postings.where(F.size("skills") >= fewest)
    if most is not None:
        sized = sized.where(F.size("skills") <= most)
    if least > 1:
        sized = with_only(sized, skill_jobs(sized).where(F.col("mentions") >= least))
    counted = pair_rows(sized).groupBy("skill_1", "skill_2").agg(
        F.count(F.lit(1)).alias("mentions")
    )
    return counted.where(F.col("mentions") >= least) if least > 1 else counted


def skill_pairs(postings: DataFrame, min_mentions: int = 10, top_n: int = 20) -> DataFrame:
    """The top_n most common pairs, of these the ones with enough mentions.

    Prevalence is over all jobs with skills, not only the jobs paired.
    """
    total = postings.agg(F.count(F.lit(1))).scalar()
    top = (
        pair_counts(postings, least=min_mentions)
        .orderBy(F.desc("mentions"), F.asc("skill_1"), F.asc("skill_2"))
        .limit(top_n)
    )
    return top.where(F.col("mentions") >= min_mentions).withColumn(
        "prevalence", F.col("mentions") / total * 100
    )


def _overlap(counted: DataFrame, named: DataFrame, both: str, *keep: str) -> DataFrame:
    """Adds jobs with both and with either skill to pairs that have their own count.

    either = first + second - both, from the counts of single skills in ``named``.
    """
    for side in ("skill_1", "skill_2"):
        counted = counted.join(named.toDF(side, f"_{side}"), side, "left")
    with_both = F.coalesce(both, F.lit(0).cast("bigint"))
    either = F.coalesce("_skill_1", F.lit(0)) + F.coalesce("_skill_2", F.lit(0)) - with_both
    return counted.select(
        "skill_1", "skill_2", *keep, with_both.alias("jobs_with_both"),
        either.alias("jobs_with_either"),
    ).where(F.col("jobs_with_either") > 0).withColumn(
        "co_occurrence_rate", F.col("jobs_with_both") / F.col("jobs_with_either")
    )


def job_set_overlap(postings: DataFrame, pairs: DataFrame, both: str | None = None) -> DataFrame:
    """For each given pair: jobs with both skills, with either, and their ratio.

    ``both`` names a column of ``pairs`` that already counts the jobs with both skills, as
    ``skill_pairs`` gives it for skill_1 < skill_2; then only single skills are counted.
    Otherwise the pairs of the listed skills are, in postings cut to those skills.
    """
    ordered = [
        F.least("skill_1", "skill_2").alias("skill_1"),
        F.greatest("skill_1", "skill_2").alias("skill_2"),
    ]
    if both:
        wanted = pairs.select(*ordered, F.col(both).alias("_both")).distinct()
        return _overlap(wanted, skill_jobs(postings), "_both")
    wanted = pairs.select(*ordered).distinct()
    cut = with_only(postings, union_of_pair_skills(wanted))
    counted = pair_counts(cut).withColumnRenamed("mentions", "_both")
    return _overlap(wanted.join(counted, ["skill_1", "skill_2"], "left"), skill_jobs(cut), "_both")


def synergy_label(rate: Column) -> Column:
    return (
        F.when(rate > 0.4, "Very High Synergy")
        .when(rate > 0.25, "High Synergy")
        .when(rate > 0.1, "Medium Synergy")
        .otherwise("Low Synergy")
    )


def pair_synergy(postings: DataFrame, pairs: DataFrame, both: str | None = None) -> DataFrame:
    overlap = job_set_overlap(postings, pairs, both)
    return overlap.withColumn("learning_synergy", synergy_label(F.col("co_occurrence_rate")))


def pair_prevalence(postings: DataFrame, top_n: int = 20) -> DataFrame:
    """The most common pairs with their domain label and synergy."""
    pairs = skill_pairs(postings, min_mentions=3, top_n=top_n * 2)
    compared = _overlap(pairs, skill_jobs(postings), "mentions", "mentions", "prevalence")
    return (
        compared.select(
            "skill_1", "skill_2", "mentions", "prevalence",
            pair_domain_label(F.col("skill_1"), F.col("skill_2")).alias("combination_type"),
            synergy_label(F.col("co_occurrence_rate")).alias("learning_synergy"),
        )
        .orderBy(F.desc("mentions"), F.asc("skill_1"), F.asc("skill_2"))
        .limit(top_n)
    )


def union_of_pair_skills(pairs: DataFrame) -> DataFrame:
    """Skills on either side of the pairs."""
    return (
        pairs.select(F.col("skill_1").alias("skill"))
        .union(pairs.select(F.col("skill_2").alias("skill")))
        .distinct()
    )


_CLUSTER = "struct<core_skill:string,skills:array<string>,avg_co_occurrence:double>"


def _grown(state: Column, name: Column, edges: Column) -> Column:
    """The clusters after one more skill: with its free partners, unless it is taken.

    Partners are the free skills named together with it most, ties by name.
    """
    touching = F.filter(edges, lambda e: (e["skill_1"] == name) | (e["skill_2"] == name))
    partners = F.transform(
        touching,
        lambda e: F.struct(
            (-e["together"]).alias("less"),
            F.when(e["skill_1"] == name, e["skill_2"]).otherwise(e["skill_1"]).alias("skill"),
        ),
    )
    free = F.filter(partners, lambda p: ~F.array_contains(state["used"], p["skill"]))

    def taken(chosen: Column) -> Column:
        members = F.concat(F.array(name), F.transform(chosen, lambda c: c["skill"]))
        total = F.aggregate(chosen, F.lit(0).cast("bigint"), lambda s, c: s - c["less"])
        cluster = F.struct(
            name.alias("core_skill"), members.alias("skills"),
            (total.cast("double") / F.size(chosen)).alias("avg_co_occurrence"),
        )
        grown = F.struct(
            F.concat(state["used"], members).alias("used"),
            F.concat(state["found"], F.array(cluster)).alias("found"),
        )
        keeps = F.array_contains(state["used"], name) | (F.size(chosen) == 0)
        return F.when(keeps, state).otherwise(grown)

    return let(F.slice(F.sort_array(free), 1, 4), taken)


def skill_clusters(postings: DataFrame, top_skills: int = 30, least: int = 10) -> DataFrame:
    """Greedy clusters among the most frequent skills.

    Co-counts are made over all postings, each cut to the top skills. In rank order each
    unused skill takes up to four unused partners; the fold runs in one expression over
    at most top_skills^2 / 2 edges, whatever the number of postings.
    """
    top = skill_frequency(postings, top_skills)
    names = top.agg(F.collect_list("skill")).scalar()
    cut = postings.select(F.array_intersect("skills", names).alias("skills")).where(
        F.size("skills") >= 2
    )
    together = pair_rows(cut).groupBy("skill_1", "skill_2").agg(
        F.count(F.lit(1)).alias("together")
    )
    edges = together.where(F.col("together") >= least).agg(
        F.collect_list(F.struct("skill_1", "skill_2", "together"))
    )
    ranked = top.agg(
        F.sort_array(F.collect_list(F.struct((-F.col("mentions")).alias("m"), "skill"))).alias("t")
    ).withColumn("edges", edges.scalar())
    start = F.struct(
        F.array().cast("array<string>").alias("used"),
        F.array().cast(f"array<{_CLUSTER}>").alias("found"),
    )
    found = F.aggregate("t", start, lambda s, t: _grown(s, t["skill"], F.col("edges")))["found"]
    return ranked.select(F.posexplode(found).alias("at", "c")).select(
        F.concat(F.lit("Cluster_"), F.col("at") + 1).alias("cluster"), "c.core_skill", "c.skills",
        "c.avg_co_occurrence", F.size("c.skills").alias("size"),
    )

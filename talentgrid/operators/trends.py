"""Monthly skill series, their trend metrics and trend categories.

A skill is one row holding its ordered monthly arrays. Only months present in the
data count. The two global inputs (the smoothing guard and the momentum
thresholds) are scalars over skill rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid import fixed_values as fv
from talentgrid.functions import series as S
from talentgrid.operators.postings import expand_skills
from talentgrid.operators.ranges import indexed_quantiles, linear_quantiles
from talentgrid.session import settle


def monthly_totals(postings: DataFrame) -> DataFrame:
    """Distinct jobs per month."""
    return postings.groupBy("published").agg(F.count(F.lit(1)).alias("total_jobs"))


def skill_month_counts(postings: DataFrame) -> DataFrame:
    """Jobs naming the skill per (skill, month)."""
    return expand_skills(postings, "published").groupBy("skill", "published").agg(
        F.count(F.lit(1)).alias("mentions")
    )


def _calendar(postings: DataFrame) -> Column:
    """Scalar: the months present in order, each with its jobs."""
    months = F.sort_array(F.collect_list(F.struct("published", F.col("total_jobs").alias("jobs"))))
    return monthly_totals(postings).agg(months).scalar()


def skill_series(postings: DataFrame) -> DataFrame:
    """Per skill its monthly mentions and prevalence (% of the month's jobs), 0-filled."""
    counts = skill_month_counts(postings)
    by_month = F.map_from_entries(F.collect_list(F.struct("published", "mentions")))
    per_skill = counts.groupBy("skill").agg(by_month.alias("_by")).withColumn(
        "_calendar", _calendar(postings)
    )
    mentions = F.transform(
        "_calendar",
        lambda m: F.coalesce(F.try_element_at("_by", m["published"]), F.lit(0)).cast("double"),
    )
    filled = per_skill.select(
        "skill", mentions.alias("mentions"),
        F.transform("_calendar", lambda m: m["published"]).alias("months"),
        F.transform("_calendar", lambda m: m["jobs"].cast("double")).alias("_jobs"),
    )
    prevalence = F.zip_with("mentions", "_jobs", lambda m, jobs: m / jobs * 100)
    return filled.select("skill", "months", "mentions", prevalence.alias("prevalence"))


def skill_month_matrix(postings: DataFrame) -> DataFrame:
    """The dense matrix in long form: every skill at every month present."""
    rows = skill_series(postings).select(
        "skill",
        F.posexplode(F.arrays_zip("months", "mentions", "prevalence")).alias("month_idx", "m"),
    )
    return rows.select(
        "skill", "month_idx", F.col("m.months").alias("published"),
        F.col("m.mentions").cast("bigint").alias("mentions"),
        F.col("m.prevalence").alias("prevalence"),
    )


def skill_timeline(postings: DataFrame, skills: list[str]) -> DataFrame:
    """Monthly prevalence of the named skills over all months present."""
    wanted = [s.lower() for s in skills]
    return skill_month_matrix(postings).where(F.col("skill").isin(*wanted)).select(
        "skill", "published", "prevalence"
    )


def smoothed(series: DataFrame, column: str, alpha: float = 0.3) -> DataFrame:
    """(skill, month_idx, value, smoothed) in long form."""
    both = series.select("skill", column, S.ewma(F.col(column), alpha).alias("_s"))
    return both.select(
        "skill", F.posexplode(F.arrays_zip(F.col(column).alias("v"), F.col("_s").alias("s")))
    ).select(
        "skill", F.col("pos").alias("month_idx"), F.col("col.v").alias("value"),
        F.col("col.s").alias("smoothed"),
    )


def _eps_of(column: str) -> Column:
    """Aggregate: the growth guard of a smoothed column, from its largest value."""
    return S.growth_eps(F.max(F.array_max(F.transform(F.col(column), F.abs))))


def _eps(smooth: DataFrame, column: str) -> Column:
    return smooth.agg(_eps_of(column)).scalar()


def growth_rates(series: DataFrame, column: str = "mentions", alpha: float = 0.3) -> DataFrame:
    """Mean smoothed month-over-month growth per skill, in percent."""
    smooth = series.select("skill", S.ewma(F.col(column), alpha).alias("_s"))
    with_eps = smooth.withColumn("_eps", _eps(smooth, "_s"))
    return with_eps.select("skill", S.growth_pct(F.col("_s"), F.col("_eps")).alias("growth_pct"))


def mom_growth(series: DataFrame, column: str = "mentions", alpha: float = 0.3) -> DataFrame:
    """Every month-over-month step of the smoothed series."""
    smooth = series.select("skill", S.ewma(F.col(column), alpha).alias("_s"))
    steps = S.growth_steps(F.col("_s"), F.col("_eps"))
    return (
        smooth.withColumn("_eps", _eps(smooth, "_s"))
        .select("skill", F.posexplode(steps).alias("_at", "mom_growth"))
        .select("skill", (F.col("_at") + 1).alias("month_idx"), "mom_growth")
    )


def rolling_metrics(series: DataFrame, column: str = "prevalence", alpha: float = 0.3,
                    window: int = 6) -> DataFrame:
    """CAGR, recent momentum and its two window means, current value, peak ratio and
    recent percentile of the smoothed series."""
    smooth = series.select("skill", S.ewma(F.col(column), alpha).alias("_s"))
    s = F.col("_s")
    recent, before = S.recent_window_means(s, window)
    return smooth.select(
        "skill",
        S.cagr_pct(s).alias("cagr_pct"),
        recent.alias("recent_avg"),
        before.alias("previous_avg"),
        S.momentum_pct(s, window).alias("recent_momentum_pct"),
        S.current(s).alias("current_value"),
        S.peak_ratio(s).alias("peak_ratio"),
        S.recent_percentile(s, window).alias("recent_percentile"),
    )


def ols_trend(series: DataFrame, column: str = "prevalence", alpha: float = 0.3) -> DataFrame:
    """Slope, intercept and nonlinearity of the smoothed series."""
    s, slope, intercept = F.col("_s"), F.col("trend_slope"), F.col("trend_intercept")
    return (
        series.select("skill", S.ewma(F.col(column), alpha).alias("_s"))
        .withColumn("trend_slope", S.ols_slope(s))
        .withColumn("trend_intercept", S.ols_intercept(s, slope))
        .select(
            "skill", "trend_slope", "trend_intercept",
            S.nonlinearity(s, slope, intercept).alias("nonlinearity"),
        )
    )


def hybrid_momentum(baseline: Column, momentum: Column, growth: Column) -> Column:
    """Momentum and growth blended by how large the baseline is."""
    return (
        F.when(baseline < 5, 0.2 * momentum + 0.8 * growth)
        .when(baseline < 20, 0.5 * momentum + 0.5 * growth)
        .otherwise(0.8 * momentum + 0.2 * growth)
    )


def trend_category(growth: Column, current: Column, momentum: Column, slope: Column,
                   p25: Column, p75: Column) -> Column:
    """The trend label.

    A steep decline (by slope) above 50 % keeps the first label unless the slope is
    below -0.12, and an annual decline above 50 % counts as stable.
    """
    hot, stable, niche, declining, emerging = (F.lit(label) for label in fv.TREND_LABELS)
    steady = F.when((current <= 50) | (slope < -0.12), declining).otherwise(hot)
    return (
        F.when((current < 2) & (growth > 20), emerging)
        .when((growth > 10) & (current > 5) & (momentum >= p75), hot)
        .when((growth < -5) & (current <= 50), declining)
        .when((growth >= -5) & (slope < -0.08) & (momentum <= p25), steady)
        .when((current < 5) & (F.abs(growth) < 8) & (slope > -0.05), niche)
        .otherwise(stable)
    )


def with_flags(trends: DataFrame) -> DataFrame:
    """One boolean per trend label."""
    hot, stable, niche, declining, emerging = fv.TREND_LABELS
    label = F.col("trend_category")
    return trends.withColumns(
        {
            "is_emerging": label == emerging,
            "is_declining": label == declining,
            "is_growing": label == hot,
            "is_stable": label == stable,
            "is_special": label == niche,
        }
    )


def trend_metrics(series: DataFrame, min_prevalence: float = 1.0,
                  min_avg_mentions: float = 5.0, min_months: int = 8,
                  alpha: float = 0.3, window: int = 6) -> DataFrame:
    """All trend numbers of the skills that pass the volume thresholds, before labelling."""
    kept = series.where(
        (F.size("months") >= min_months)
        & (S.mean(F.col("prevalence")) >= min_prevalence)
        & (S.mean(F.col("mentions")) >= min_avg_mentions)
    )
    smooth = kept.select(
        "skill", "mentions",
        S.ewma(F.col("mentions"), alpha).alias("sm"),
        S.ewma(F.col("prevalence"), alpha).alias("sp"),
    )
    sm, sp, raw = F.col("sm"), F.col("sp"), F.col("mentions")
    head = F.slice(raw, F.lit(1), F.size(raw) - 1)
    guards = smooth.agg(F.struct(_eps_of("sm").alias("m"), _eps_of("sp").alias("p"))).scalar()
    measured = smooth.withColumn("_eps", guards).select(
        "skill", "sp",
        S.cagr_pct(sp).alias("CAGR_pct"),
        S.momentum_pct(sp, window).alias("_momentum"),
        S.current(sp).alias("current_prevalence"),
        S.mean(raw).alias("avg_mentions_per_month"),
        S.total(raw).cast("bigint").alias("total_mentions"),
        S.peak_ratio(sp).alias("peak_ratio"),
        S.ols_slope(sp).alias("trend_slope"),
        F.log1p(S.current(sm)).alias("trend_confidence"),
        S.growth_pct(sm, F.col("_eps.m")).alias("growth_mentions_pct"),
        S.growth_pct(sp, F.col("_eps.p")).alias("growth_prevalence_pct"),
        S.mean(head).alias("baseline_mentions"),
    )
    baseline = F.col("baseline_mentions")
    blended = measured.withColumns(
        {
            "nonlinearity": S.nonlinearity(
                sp, F.col("trend_slope"), S.ols_intercept(sp, F.col("trend_slope"))
            ),
            "recent_momentum_pct": hybrid_momentum(
                baseline, F.col("_momentum"), F.col("growth_mentions_pct")
            ),
            "growth_reliability": baseline >= 5,
        }
    )
    return blended.withColumn(
        "volume_adjusted_score", F.col("recent_momentum_pct") * F.col("trend_confidence")
    ).drop("sp", "_momentum")


def momentum_quantiles(metrics: DataFrame, column: str = "recent_momentum_pct") -> DataFrame:
    """Linearly interpolated p10, p25, p75 and p90 of momentum across skills."""
    return linear_quantiles(
        metrics, column, {"p10": 0.10, "p25": 0.25, "p75": 0.75, "p90": 0.90}
    )


def index_quantiles(metrics: DataFrame, column: str = "recent_momentum_pct") -> DataFrame:
    """Momentum thresholds taken as sorted[int(q * n)]."""
    return indexed_quantiles(
        metrics, column, {"p10": 0.10, "p25": 0.25, "p75": 0.75, "p90": 0.90}
    )


def skill_trends(series: DataFrame, min_prevalence: float = 1.0, min_avg_mentions: float = 5.0,
                 min_months: int = 8, alpha: float = 0.3) -> DataFrame:
    """Trend metrics, category and flags per skill, unordered.

    The series is read twice (guards, metrics): settle it first. The metrics are stored,
    as thresholds and rows both come from them.
    """
    metrics = settle(
        trend_metrics(series, min_prevalence, min_avg_mentions, min_months, alpha), "metrics"
    )
    limits = linear_quantiles(metrics, "recent_momentum_pct", {"p25": 0.25, "p75": 0.75}).select(
        F.array("p25", "p75")
    ).scalar()
    labelled = metrics.withColumn("_limits", limits).withColumn(
        "trend_category",
        trend_category(
            F.col("CAGR_pct"), F.col("current_prevalence"), F.col("recent_momentum_pct"),
            F.col("trend_slope"), F.col("_limits")[0], F.col("_limits")[1],
        ),
    )
    return with_flags(labelled.drop("_limits"))


def ranked_trends(trends: DataFrame) -> DataFrame:
    return trends.orderBy(F.desc("volume_adjusted_score"), F.asc("skill"))


def process_trends(series: DataFrame, column: str = "prevalence", alpha: float = 0.3,
                   window: int = 6) -> DataFrame:
    """All kernels on one column, labelled with indexed momentum thresholds over all skills."""
    smooth = series.select("skill", S.ewma(F.col(column), alpha).alias("_s"))
    s = F.col("_s")
    measured = smooth.withColumn("_eps", _eps(smooth, "_s")).select(
        "skill", "_s",
        S.growth_pct(s, F.col("_eps")).alias("growth_pct"),
        S.cagr_pct(s).alias("cagr"),
        S.momentum_pct(s, window).alias("recent_momentum"),
        S.current(s).alias("current_prevalence"),
        S.peak_ratio(s).alias("peak_ratio"),
        S.ols_slope(s).alias("slope"),
    ).withColumn("intercept", S.ols_intercept(s, F.col("slope")))
    measured = measured.withColumn(
        "nonlinearity", S.nonlinearity(s, F.col("slope"), F.col("intercept"))
    ).drop("_s")
    measured = settle(measured, "measured")
    limits = index_quantiles(measured, "recent_momentum")
    row = limits.select(F.struct("p25", "p75")).scalar()
    return measured.withColumn("_p", row).withColumn(
        "trend_category",
        trend_category(
            F.col("cagr"), F.col("current_prevalence"), F.col("recent_momentum"), F.col("slope"),
            F.col("_p")["p25"], F.col("_p")["p75"],
        ),
    ).drop("_p")


def top_of_category(trends: DataFrame, category: str, top_n: int = 10,
                    sort_by: str = "recent_momentum_pct") -> DataFrame:
    return (
        trends.where(F.col("trend_category") == category)
        .orderBy(F.desc(sort_by), F.asc("skill"))
        .limit(top_n)
    )


def trend_summary(trends: DataFrame) -> DataFrame:
    """Per category: skills, mean and sample std of three metrics, mean CAGR; 3 digits."""
    spread = {"current_prevalence", "trend_slope", "recent_momentum_pct"}
    measures = [F.count("skill").alias("skill_count")]
    for name in sorted(spread):
        measures += [
            F.round(F.avg(name), 3).alias(f"{name}_mean"),
            F.round(F.stddev_samp(name), 3).alias(f"{name}_std"),
        ]
    measures.append(F.round(F.avg("CAGR_pct"), 3).alias("CAGR_pct_mean"))
    return trends.groupBy("trend_category").agg(*measures).orderBy(
        F.desc("skill_count"), F.asc("trend_category")
    )


def category_means(trends: DataFrame) -> DataFrame:
    names = ("current_prevalence", "volume_adjusted_score", "avg_mentions_per_month",
             "total_mentions")
    return trends.groupBy("trend_category").agg(
        F.count("skill").alias("skill_count"), *[F.round(F.avg(n), 2).alias(n) for n in names]
    )


def trend_distribution(trends: DataFrame) -> DataFrame:
    total = trends.agg(F.count(F.lit(1))).scalar()
    counted = trends.groupBy("trend_category").agg(F.count(F.lit(1)).alias("skill_count"))
    return counted.withColumn("share", F.col("skill_count") / total)


CORRELATED = ("current_prevalence", "trend_slope", "recent_momentum_pct", "CAGR_pct",
              "peak_ratio", "nonlinearity")


def metric_correlation(trends: DataFrame) -> DataFrame:
    """Pearson correlation of every two trend metrics, long form, from one aggregate."""
    pairs = [(a, b) for a in CORRELATED for b in CORRELATED]
    row = trends.agg(
        F.array(
            *[
                F.struct(F.lit(a).alias("metric_1"), F.lit(b).alias("metric_2"),
                         F.corr(a, b).alias("correlation"))
                for a, b in pairs
            ]
        ).alias("cells")
    )
    return row.select(F.inline("cells"))


PROFILED = ("current_prevalence", "trend_slope", "recent_momentum_pct", "CAGR_pct", "peak_ratio")


def normalized_category_profile(trends: DataFrame) -> DataFrame:
    """Category means scaled to 0..1 by each metric's range over all skills."""
    ranges = trends.agg(
        F.struct(
            *[
                F.struct(F.min(name).alias("low"), F.max(name).alias("high")).alias(name)
                for name in PROFILED
            ]
        )
    ).scalar()
    means = trends.groupBy("trend_category").agg(*[F.avg(n).alias(n) for n in PROFILED])
    return means.withColumn("_r", ranges).select(
        "trend_category",
        *[
            F.try_divide(
                F.col(n) - F.col("_r")[n]["low"], F.col("_r")[n]["high"] - F.col("_r")[n]["low"]
            ).alias(n)
            for n in PROFILED
        ],
    )


def category_box_stats(trends: DataFrame) -> DataFrame:
    """Minimum, quartiles and maximum of prevalence and momentum per category."""
    cuts = F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)])
    boxed = trends.groupBy("trend_category").agg(
        F.percentile("current_prevalence", cuts).alias("p"),
        F.percentile("recent_momentum_pct", cuts).alias("m"),
    )
    marks = ("min", "q1", "median", "q3", "max")
    return boxed.select(
        "trend_category",
        *[F.col("p")[i].alias(f"prevalence_{mark}") for i, mark in enumerate(marks)],
        *[F.col("m")[i].alias(f"momentum_{mark}") for i, mark in enumerate(marks)],
    )


def top_emerging_declining(trends: DataFrame, top_n: int = 15) -> DataFrame:
    """Fastest emerging and fastest declining skills by momentum, stacked."""
    columns = ("skill", "recent_momentum_pct", "current_prevalence")
    up = trends.where("is_emerging").orderBy(F.desc("recent_momentum_pct"), F.asc("skill"))
    down = trends.where("is_declining").orderBy(F.asc("recent_momentum_pct"), F.asc("skill"))
    return (
        up.limit(top_n).select(F.lit("emerging").alias("side"), *columns)
        .unionByName(down.limit(top_n).select(F.lit("declining").alias("side"), *columns))
    )


def trend_insights(trends: DataFrame, top_n: int = 5) -> DataFrame:
    """Counts by flag, innovation ratio and the leading skills, one (kind, name, value) row each."""
    counts = trends.agg(
        F.count_if("is_emerging").alias("emerging_skills"),
        F.count_if("is_growing").alias("growing_skills"),
        F.count_if("is_declining").alias("declining_skills"),
    ).withColumn(
        "innovation_ratio",
        F.col("emerging_skills") / F.greatest(F.col("declining_skills"), F.lit(1)),
    )
    health = counts.select(*[F.col(c).cast("double") for c in counts.columns]).unpivot(
        [], list(counts.columns), "name", "value"
    ).select(F.lit("market_health").alias("kind"), "name", "value")
    hot, _, _, declining, emerging = fv.TREND_LABELS
    lists = [
        top_of_category(trends, label, top_n).select(
            F.lit(kind).alias("kind"), F.col("skill").alias("name"),
            F.col("recent_momentum_pct").alias("value"),
        )
        for kind, label in (("emerging", emerging), ("growing", hot), ("declining", declining))
    ]
    for part in lists:
        health = health.unionByName(part)
    return health

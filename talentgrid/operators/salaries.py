"""What skills add to a salary once company, place, level and time are accounted for."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import CountVectorizer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.operators.pairs import pair_counts, pair_rows, with_only
from talentgrid.operators.postings import expand_skills
from talentgrid.operators.ranges import running_sums
from talentgrid.session import settle


#: Parts that rows fall into, so that a row's own salary is no part of its features.
FOLDS = 5
#: Features whose normal equations the driver solves: 8 MB, and half a million pair counts.
DENSE = 1000
#: Added to the diagonal of the normal equations.
RIDGE = 0.1


def fill_unknown(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("Unknown")) for c in columns})


def salary_baseline(postings: DataFrame, confounders: Sequence[str]) -> DataFrame:
    """Add the mean salary of equal confounders as ``baseline`` and the ``residual``.

    Means are joined back rather than taken in a window, so a combination holding a
    third of the postings is averaged on the map side and split by the skew join.
    """
    filled = fill_unknown(postings, confounders)
    means = filled.groupBy(*confounders).agg(F.avg("salary").alias("baseline"))
    return filled.join(means, list(confounders)).withColumn(
        "residual", F.col("salary") - F.col("baseline")
    )


def r_squared(df: DataFrame, actual: str, predicted: str) -> Column:
    """Aggregate expression: 1 - residual sum of squares / total sum of squares."""
    error = F.sum(F.pow(F.col(actual) - F.col(predicted), F.lit(2.0)))
    spread = F.var_pop(actual) * F.count(actual)
    return F.when(spread > 0, F.lit(1.0) - error / spread)


def baseline_fit(fitted: DataFrame) -> DataFrame:
    return fitted.agg(
        F.count(F.lit(1)).alias("jobs"), r_squared(fitted, "salary", "baseline").alias("r2")
    )


def valid_skills(postings: DataFrame, min_samples: int = 5) -> DataFrame:
    """Skills of at least ``min_samples`` jobs, with their number of jobs."""
    return expand_skills(postings).groupBy("skill").agg(F.count(F.lit(1)).alias("jobs")).where(
        F.col("jobs") >= min_samples
    )


def job_skill_rows(postings: DataFrame, min_samples: int = 5,
                   controls: Sequence[str] = ()) -> DataFrame:
    """The incidence matrix in sparse long form: (job_id, skill, controls)."""
    rows = expand_skills(fill_unknown(postings, controls), "job_id", *controls)
    return rows.join(valid_skills(postings, min_samples).select("skill"), "skill")


def job_skill_matrix(postings: DataFrame, skills: Sequence[str],
                     controls: Sequence[str] = ()) -> DataFrame:
    """The incidence matrix in wide form: one 0/1 column for each skill of a given list.

    A posting already holds its skills, so each column is a lookup in the row. For all the
    skills that there are, see ``job_skill_vectors``.
    """
    return fill_unknown(postings, controls).select(
        "job_id",
        *[F.array_contains("skills", s).cast("int").alias(s) for s in skills],
        *controls,
    )


def skill_dictionary(postings: DataFrame, min_samples: int = 5) -> DataFrame:
    """(index, skill, jobs): skills of enough jobs, the most frequent first, from 0.

    Ranked range by range: free-text skills may be any number.
    """
    order = [F.desc("jobs"), F.asc("skill")]
    counted = valid_skills(postings, min_samples).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_sums(counted, [], order, "_one", "_place")
    return ranked.select((F.col("_place") - 1).alias("index"), "skill", "jobs")


def job_skill_vectors(postings: DataFrame, dictionary: DataFrame,
                      controls: Sequence[str] = ()) -> DataFrame:
    """The incidence matrix as one sparse 0/1 vector a job: (job_id, indices, controls).

    ``indices`` are the places of the job's skills in the dictionary, in order; a job
    without any has none. No name is a column, and none goes to the driver.
    """
    filled = fill_unknown(postings, controls)
    rows = expand_skills(filled, "job_id").join(dictionary.select("skill", "index"), "skill")
    listed = rows.groupBy("job_id").agg(F.sort_array(F.collect_list("index")).alias("indices"))
    return filled.select("job_id", *controls).join(listed, "job_id", "left").select(
        "job_id", F.coalesce("indices", F.array().cast("array<bigint>")).alias("indices"), *controls
    )


def skill_premium(fitted: DataFrame, min_samples: int = 5) -> DataFrame:
    """Mean residual of jobs with a skill minus that of jobs without it."""
    whole = fitted.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.sum("residual").alias("s"))
    ).scalar()
    per_skill = expand_skills(fitted, "residual").groupBy("skill").agg(
        F.count(F.lit(1)).alias("jobs"), F.sum("residual").alias("_s")
    )
    with_all = per_skill.where(F.col("jobs") >= min_samples).withColumn("_all", whole)
    n, s = F.col("_all")["n"], F.col("_all")["s"]
    without = F.try_divide(s - F.col("_s"), (n - F.col("jobs")).cast("double"))
    return with_all.select(
        "skill", "jobs",
        (F.col("_s") / F.col("jobs") - without).alias("dollar_premium"),
        (F.col("jobs") / n).alias("prevalence"),
    )


def skill_interactions(fitted: DataFrame, min_samples: int = 5, top_n: int = 20) -> DataFrame:
    """Pairs whose joint effect differs most from the sum of their single effects.

    synergy = r(both) - r(first only) - r(second only) + r(neither), where r is the
    mean residual; only pairs for which all four groups have jobs. Pair sums are
    combined on the map side, over postings cut to skills of enough jobs.
    """
    # Three passes follow; what stands behind the residuals is computed once.
    fitted = settle(fitted.select("job_id", "skills", "residual"), "residuals")
    whole = fitted.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.sum("residual").alias("s"))
    ).scalar()
    single = expand_skills(fitted, "residual").groupBy("skill").agg(
        F.count(F.lit(1)).alias("n"), F.sum("residual").alias("s")
    ).where(F.col("n") >= min_samples)
    cut = with_only(fitted, single, "residual")
    pairs = pair_rows(cut, "residual").groupBy("skill_1", "skill_2").agg(
        F.count(F.lit(1)).alias("n_ab"), F.sum("residual").alias("s_ab")
    )
    first = single.select(F.col("skill").alias("skill_1"), F.col("n").alias("n_a"),
                          F.col("s").alias("s_a"))
    second = single.select(F.col("skill").alias("skill_2"), F.col("n").alias("n_b"),
                           F.col("s").alias("s_b"))
    joined = pairs.join(first, "skill_1").join(second, "skill_2").withColumn("_all", whole)
    n, s = F.col("_all")["n"], F.col("_all")["s"]

    def mean_of(total: Column, count: Column) -> Column:
        return F.when(count > 0, total / count.cast("double"))

    both = mean_of(F.col("s_ab"), F.col("n_ab"))
    first_only = mean_of(F.col("s_a") - F.col("s_ab"), F.col("n_a") - F.col("n_ab"))
    second_only = mean_of(F.col("s_b") - F.col("s_ab"), F.col("n_b") - F.col("n_ab"))
    neither = mean_of(
        s - F.col("s_a") - F.col("s_b") + F.col("s_ab"),
        n - F.col("n_a") - F.col("n_b") + F.col("n_ab"),
    )
    scored = joined.select(
        "skill_1", "skill_2", F.col("n_ab").alias("jobs"),
        (both - first_only - second_only + neither).alias("synergy"),
    ).where(F.col("synergy").isNotNull())
    strongest = scored.orderBy(F.desc(F.abs("synergy")), F.asc("skill_1"), F.asc("skill_2"))
    return strongest.limit(top_n)


def encoded_means(postings: DataFrame, columns: Sequence[str], target: str,
                  key: str = "job_id") -> DataFrame:
    """Adds, for each text column, the mean target of its value over the other folds.

    Rows fall into ``FOLDS`` by the hash of ``key``, and no row's own target is part of its
    feature; a value that the other folds lack gets the mean of all rows. Numbers come
    out whatever the cardinality. Sums go by (value, fold): combined on the map side, and
    a value of a third of all rows is joined back in as many parts as there are folds.
    """
    everything = postings.agg(F.avg(target)).scalar()
    fold = F.pmod(F.xxhash64(key), F.lit(FOLDS))
    folded = out = postings.withColumn("_fold", fold)
    for column in columns:
        # Sums are over the given rows, not over the joins of the columns before.
        sums = folded.groupBy(column, "_fold").agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
        whole = sums.groupBy(column).agg(F.sum("_s").alias("_all_s"), F.sum("_n").alias("_all_n"))
        others = sums.join(whole, column).select(
            column, "_fold",
            F.coalesce(
                F.try_divide(F.col("_all_s") - F.col("_s"), (F.col("_all_n") - F.col("_n")).cast("double")),
                everything,
            ).alias(f"{column}_mean"),
        )
        out = out.join(others, [column, "_fold"])
    return out.drop("_fold")


def boosted_baseline(postings: DataFrame, confounders: Sequence[str], rounds: int = 20,
                     depth: int = 5, rate: float = 0.1) -> DataFrame:
    """Baseline by boosted trees over confounders encoded out of fold, with residuals.

    Postings are stored once before they are encoded and once after: every column's means
    read them, and the fit and its predictions read the features several times.
    """
    filled = settle(fill_unknown(postings, confounders), "paid")
    encoded = settle(encoded_means(filled, confounders, "salary"), "encoded")
    features = VectorAssembler(
        inputCols=[f"{c}_mean" for c in confounders], outputCol="_features"
    ).transform(encoded)
    model = GBTRegressor(
        featuresCol="_features", labelCol="salary", predictionCol="baseline", maxIter=rounds,
        maxDepth=depth, stepSize=rate, seed=42,
    ).fit(features)
    predicted = model.transform(features)
    kept = [c for c in predicted.columns if c != "_features" and not c.endswith("_mean")]
    return predicted.select(*kept).withColumn("residual", F.col("salary") - F.col("baseline"))


def _features(postings: DataFrame, controls: Sequence[str]) -> DataFrame:
    """(job_id, residual if there is one, skills): skills and control values in one list."""
    filled = fill_unknown(postings, controls)
    named = F.transform("skills", lambda s: F.concat(F.lit("skill="), s))
    given = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in controls]
    kept = [c for c in ("residual",) if c in postings.columns]
    return filled.select("job_id", *kept, F.array_distinct(F.concat(named, F.array(*given))).alias("skills"))


def skill_effects(fitted: DataFrame, controls: Sequence[str] = (), min_samples: int = 5,
                  ridge: float = RIDGE) -> DataFrame | None:
    """Ridge regression of the residual on skills and control values: one row a feature.

    (feature, jobs, coefficient), the intercept as feature "(intercept)". Features are
    "skill=..." and "control=..." of at least ``min_samples`` jobs. The normal equations
    need sums alone: jobs of each feature and of each pair of features, and the residuals
    of each. These are counted like skill pairs; the driver gets one row a feature and pair
    and solves them whole. With more than ``DENSE`` features the result is None.
    """
    rows = settle(_features(fitted, controls), "features")
    single = expand_skills(rows, "residual").groupBy("skill").agg(
        F.count(F.lit(1)).alias("n"), F.sum("residual").alias("s")
    ).where(F.col("n") >= min_samples)
    names = sorted((tuple(r) for r in single.limit(DENSE + 1).collect()), key=lambda r: r[0])
    if len(names) > DENSE:
        return None
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("residual").alias("s")).first()
    place = {name: i for i, (name, *_) in enumerate(names)}
    n, s = (np.array([r[k] for r in names], np.float64) for k in (1, 2))
    together = np.diag(n)
    for r in pair_counts(with_only(rows, single)).collect():
        i, j = place[r["skill_1"]], place[r["skill_2"]]
        together[i, j] = together[j, i] = r["mentions"]
    total, mean = whole["n"] or 1, (whole["s"] or 0.0) / (whole["n"] or 1)
    # Centred by sums: features and target each less their mean.
    left = together - np.outer(n, n) / total + ridge * np.eye(len(n))
    solved = np.linalg.solve(left, s - n * mean) if len(n) else s
    out = [(name, int(k), float(b)) for (name, k, _), b in zip(names, solved)]
    out.append(("(intercept)", int(whole["n"]), float(mean - solved @ n / total)))
    return fitted.sparkSession.createDataFrame(out, "feature string, jobs long, coefficient double")


def _effects_predictor(effects: DataFrame, controls: Sequence[str],
                       columns: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    def predict(df: DataFrame) -> DataFrame:
        named = effects.where("feature != '(intercept)'").select(F.col("feature").alias("skill"), "coefficient")
        # One row a job: its features' coefficients summed on the map side where they can be.
        summed = expand_skills(_features(df, controls), "job_id").join(named, "skill").groupBy("job_id").agg(
            F.sum("coefficient").alias("_sum")
        )
        base = effects.where("feature = '(intercept)'").agg(F.first("coefficient")).scalar()
        return df.join(summed, "job_id", "left").withColumn(
            "skill_prediction", base + F.coalesce("_sum", F.lit(0.0))
        ).select(*columns, "skill_prediction")

    return predict


def skill_residual_model(fitted: DataFrame, controls: Sequence[str] = (), min_samples: int = 5,
                         learner: str = "linear") -> DataFrame:
    """Residual explained by skills and controls: add ``skill_prediction``.

    ``linear`` solves the ridge regression of ``skill_effects`` exactly, or, beyond
    ``DENSE`` features, fits it step by step. ``boosted`` grows trees over a sparse 0/1
    vector of every skill with enough jobs. The fit runs when this is called.
    """
    return _skill_model(fitted, controls, min_samples, learner)(fitted)


def _skill_model(fitted: DataFrame, controls: Sequence[str], min_samples: int,
                 learner: str) -> Callable[[DataFrame], DataFrame]:
    """Fit once; the result predicts any postings with the same columns."""
    if learner == "linear":
        effects = skill_effects(fitted, controls, min_samples)
        if effects is not None:
            return _effects_predictor(effects, controls, fitted.columns)
    filled = fill_unknown(fitted, controls)
    # A control of one value says nothing, and can't be encoded.
    different = filled.agg(*[F.count_distinct(c).alias(c) for c in controls]).first() if controls else {}
    controls = [c for c in controls if different[c] > 1]
    skills = CountVectorizer(
        inputCol="skills", outputCol="_skills", binary=True, minDF=float(min_samples),
        vocabSize=max(1, valid_skills(filled, min_samples).count()),
    )
    steps, parts = [skills], ["_skills"]
    if controls:
        indexed, hot = [f"_{c}_ix" for c in controls], [f"_{c}_hot" for c in controls]
        steps += [
            StringIndexer(inputCols=list(controls), outputCols=indexed,
                          stringOrderType="frequencyDesc"),
            OneHotEncoder(inputCols=indexed, outputCols=hot),
        ]
        parts += hot
    steps.append(VectorAssembler(inputCols=parts, outputCol="_features"))
    if learner == "boosted":
        steps.append(GBTRegressor(featuresCol="_features", labelCol="residual", maxIter=20,
                                  predictionCol="skill_prediction", maxDepth=5, seed=42))
    else:
        steps.append(LinearRegression(featuresCol="_features", labelCol="residual", regParam=1e-6,
                                      predictionCol="skill_prediction", solver="l-bfgs"))
    model = Pipeline(stages=steps).fit(filled)

    def predict(df: DataFrame) -> DataFrame:
        scored = model.transform(fill_unknown(df, controls))
        return scored.select(*fitted.columns, "skill_prediction")

    return predict


def residual_fit(modelled: DataFrame) -> DataFrame:
    return modelled.agg(
        F.count(F.lit(1)).alias("jobs"),
        r_squared(modelled, "residual", "skill_prediction").alias("r2"),
    )


@dataclass(frozen=True)
class TwoStage:
    """Baseline, skill model on the residuals, premiums and interactions.

    Each part is worked out when it is asked for: only ``skill_r2`` fits a model.
    """

    fitted: DataFrame
    controls: Sequence[str]
    min_samples: int
    top_n: int

    def baseline_r2(self) -> DataFrame:
        return baseline_fit(self.fitted)

    def skill_r2(self) -> DataFrame:
        return residual_fit(skill_residual_model(self.fitted, self.controls, self.min_samples))

    def skill_premiums(self) -> DataFrame:
        return skill_premium(self.fitted, self.min_samples)

    def skill_interactions(self) -> DataFrame:
        return skill_interactions(self.fitted, self.min_samples, self.top_n)


def salary_two_stage(postings: DataFrame, confounders: Sequence[str],
                     controls: Sequence[str] = (), min_samples: int = 5,
                     top_n: int = 20) -> TwoStage:
    return TwoStage(salary_baseline(postings, confounders), controls, min_samples, top_n)


def model_premium(fitted: DataFrame, skill: str, controls: Sequence[str] = (),
                  min_samples: int = 5, learner: str = "linear") -> DataFrame:
    """One row: mean prediction with the skill minus mean prediction without it.

    One model is fitted; it predicts every posting twice, with its list as if the skill
    were named and as if it were not.
    """
    predict = _skill_model(fitted, controls, min_samples, learner)
    name = F.lit(skill.lower())
    named = fitted.withColumn("skills", F.array_union("skills", F.array(name)))
    unnamed = fitted.withColumn("skills", F.array_remove("skills", name))
    means = [
        predict(df).agg(F.avg("skill_prediction")).scalar() for df in (named, unnamed)
    ]
    one = fitted.sparkSession.range(1)
    return one.select(F.lit(skill.lower()).alias("skill"), (means[0] - means[1]).alias("premium"))

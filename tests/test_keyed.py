from datetime import datetime

from pyspark.sql import functions as F

from talentgrid.operators import keyed as K, quality, salaries
from talentgrid.operators.postings import jobs_with_enough_skills


def test_dedupe_keeps_earliest(spark, rows):
    d1, d2 = datetime(2024, 1, 1), datetime(2024, 2, 1)
    data = [
        ("a", "T", "X", ["s"], 1, 2, None), ("b", "T", "X", ["s"], 1, 2, d2),
        ("c", "T", "X", ["s"], 1, 2, d1), ("d", "T", "X", ["s"], 1, 2, d1),
        ("e", "T", "X", None, 1, 2, d2), ("f", "T", "X", None, 1, 2, None),
        ("g", "T", "X", ["s"], 1, None, d2),
    ]
    df = spark.createDataFrame(data, "job_slug string, title string, country string, skills array<string>, "
                                     "salary_min int, salary_max int, published timestamp")
    kept = K.dedupe_earliest(df)
    assert rows(kept, "job_slug") == [("c",), ("e",), ("g",)]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_insert_ignore_is_idempotent(spark, rows):
    stored = spark.createDataFrame([(1, "old")], "k int, v string")
    batch = spark.createDataFrame([(1, "new", 1), (2, "first", 1), (2, "second", 2)], "k int, v string, o int")
    fresh = K.insert_ignore(stored, batch, ["k"], [F.asc("o")]).select("k", "v")
    assert rows(fresh) == [(2, "first")]
    table = stored.unionByName(fresh)
    assert K.insert_ignore(table, batch, ["k"], [F.asc("o")]).count() == 0


def test_upserts(spark, rows):
    stored = spark.createDataFrame([(1, "old", 0), (3, "kept", 0)], "k int, v string, o int")
    batch = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, o int")
    merged = K.upsert_update(stored, batch, ["k"], [F.desc("o")])
    assert rows(merged, "k", "v") == [(1, "b"), (2, "c"), (3, "kept")]


def test_keep_last_drops_failures(spark, rows):
    stored = spark.createDataFrame([("a", True, 0), ("b", True, 0), ("c", False, 0)], "s string, success boolean, o int")
    new = spark.createDataFrame([("b", False, 1), ("c", False, 1), ("c", True, 2)], "s string, success boolean, o int")
    got = K.upsert_keep_last(stored, new, ["s"], [F.desc("o")])
    assert rows(got, "s") == [("a",), ("c",)]


def test_stamps_only_overwritten_rows(spark, rows):
    made, now = datetime(2020, 1, 1), datetime(2024, 1, 1)
    stored = spark.createDataFrame([(1, "x", made, made), (2, "y", made, made)],
                                   "k int, v string, created_at_utc timestamp, updated_at_utc timestamp")
    batch = spark.createDataFrame([(2, "z", 1), (3, "n", 1)], "k int, v string, o int")
    got = K.upsert_stamped(stored, batch, ["k"], [F.desc("o")], F.lit(now))
    assert rows(got) == [(1, "x", made, made), (2, "z", made, now), (3, "n", now, now)]


def test_write_back_and_orphans(spark, rows):
    jobs = spark.createDataFrame([("a", "t", None), ("b", "u", "old")], "slug string, title string, level string")
    new = spark.createDataFrame([("a", "Senior")], "slug string, level string")
    assert rows(K.write_classification_back(jobs, new, "slug", ["level"]), "slug", "level") == [
        ("a", "Senior"), ("b", "old")]
    child = spark.createDataFrame([("a",), ("z",), (None,)], "p string")
    assert K.orphan_count(child, jobs, "p", "slug", "n").collect()[0]["n"] == 2
    assert rows(K.unprocessed_keys(child, jobs.withColumnRenamed("slug", "p"), "p")) == [("z",)]


def test_quality(spark, rows):
    data = [("a", "t", "c", "x", datetime(2030, 1, 1), 5, 3), ("a", " ", None, "x", None, -1, 3)]
    df = spark.createDataFrame(data, "slug string, title string, company_slug string, country string, "
                                     "published timestamp, salary_min int, salary_max int")
    r = quality.quality_report(df, F.lit(datetime(2025, 1, 1))).collect()[0]
    assert (r["missing_title"], r["missing_company"], r["missing_dates"], r["invalid_salaries"],
            r["future_dates"]) == (1, 1, 1, 2, 1)
    assert quality.duplicate_keys(df, ["slug"]).collect()[0][0] == 1
    assert rows(quality.missing_profile(df), "column_name", "missing_pct") == [
        ("company_slug", 50.0), ("published", 50.0)]


def test_enough_skills(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "job_id int, skill string")
    assert rows(jobs_with_enough_skills(df, 2)) == [(1, "a"), (1, "b")]


def test_salary_contrasts(spark):
    data = [("1", ["a", "b"], 10.0), ("2", ["a"], 4.0), ("3", ["b"], 3.0), ("4", ["c"], 1.0)]
    df = spark.createDataFrame(data, "job_id string, skills array<string>, residual double")
    premium = {r["skill"]: r["dollar_premium"] for r in salaries.skill_premium(df, 1).collect()}
    assert premium == {"a": 7.0 - 2.0, "b": 6.5 - 2.5, "c": 1.0 - 17 / 3}
    pair = salaries.skill_interactions(df, 1).collect()
    assert [(r["skill_1"], r["skill_2"], r["synergy"]) for r in pair] == [("a", "b", 10.0 - 4 - 3 + 1)]


def test_salary_models_explain_residuals(spark):
    data = [(str(i), "X" if i % 2 else None, ["a", "b"] if i % 3 else ["b"],
             1000.0 + (500 if i % 3 else 0) + (i % 2) * 100) for i in range(60)]
    df = spark.createDataFrame(data, "job_id string, country string, skills array<string>, salary double")
    fitted = salaries.salary_baseline(df, ["country"])
    assert abs(fitted.groupBy().sum("residual").collect()[0][0]) < 1e-6
    r2 = salaries.residual_fit(salaries.skill_residual_model(fitted, ["country"])).collect()[0]["r2"]
    assert r2 > 0.99
    boosted = salaries.skill_residual_model(fitted, learner="boosted")
    assert salaries.residual_fit(boosted).collect()[0]["r2"] > 0.9
    tree = salaries.boosted_baseline(df, ["country"], rounds=3, depth=2)
    assert tree.count() == 60 and "residual" in tree.columns


def test_model_premium_finds_a_planted_effect(spark):
    data = [(i, 100.0 * (i % 2) + (i % 5), ["go", "sql"] if i % 2 else ["sql"], "remote") for i in range(200)]
    fitted = spark.createDataFrame(data, "job_id int, residual double, skills array<string>, work_mode string")
    (row,) = salaries.model_premium(fitted, "Go", ["work_mode"]).collect()
    assert row["skill"] == "go" and abs(row["premium"] - 100) < 2


def test_repeated_classifications_update_once(spark, rows):
    jobs = spark.createDataFrame([("a", "x"), ("b", "y")], "slug string, level string")
    classified = spark.createDataFrame([("a", "Senior"), ("a", "Lead"), ("a", None)], "slug string, level string")
    got = K.write_classification_back(jobs, classified, "slug", ["level"])
    assert rows(got, "slug", "level") == [("a", "Lead"), ("b", "y")]

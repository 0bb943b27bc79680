"""Effects by normal equations, features out of fold, and sparse vectors, against plain loops."""

import random

import numpy as np
import pytest

from talentgrid.operators import salaries

SCHEMA = "job_id int, residual double, skills array<string>, work_mode string, level string"


@pytest.fixture
def fitted(spark):
    draw = random.Random(5)
    pool = [f"s{i}" for i in range(12)]
    rows = []
    for i in range(400):
        skills = draw.sample(pool, draw.randint(1, 6)) + (["rare"] if i < 3 else [])
        mode = draw.choice(["remote", "office", None])
        value = 100.0 * ("s1" in skills) - 40 * ("s2" in skills) + 25 * (mode == "office") + draw.gauss(0, 5)
        rows.append((i, value, skills, mode, "same"))
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain_effects(rows, ridge):
    named = [["skill=" + s for s in r[2]] + [f"work_mode={r[3] or 'Unknown'}", f"level={r[4]}"] for r in rows]
    counts = {f: sum(f in x for x in named) for x in named for f in x}
    features = sorted(f for f, n in counts.items() if n >= 5)
    x = np.array([[f in own for f in features] for own in named], float)
    y = np.array([r[1] for r in rows])
    centred = x - x.mean(axis=0)
    b = np.linalg.solve(centred.T @ centred + ridge * np.eye(len(features)), centred.T @ (y - y.mean()))
    fit = y.mean() + centred @ b
    effects = {f: (counts[f], c) for f, c in zip(features, b)} | {"(intercept)": (len(y), y.mean() - x.mean(axis=0) @ b)}
    return effects, fit, 1 - ((y - fit) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_effects_are_the_ridge_regression(fitted):
    rows, df = fitted
    want, fit, r2 = plain_effects(rows, salaries.RIDGE)
    got = {r.feature: (r.jobs, r.coefficient) for r in salaries.skill_effects(df, ["work_mode", "level"]).collect()}
    assert got.keys() == want.keys() and "skill=rare" not in got
    for feature, (jobs, b) in want.items():
        assert got[feature] == (jobs, pytest.approx(b, abs=1e-6))
    assert got["skill=s1"][1] == pytest.approx(100, abs=3) and got["skill=s2"][1] == pytest.approx(-40, abs=3)
    modelled = salaries.skill_residual_model(df, ["work_mode", "level"])
    assert modelled.columns == [*df.columns, "skill_prediction"]
    predicted = {r.job_id: r.skill_prediction for r in modelled.collect()}
    assert [predicted[r[0]] for r in rows] == pytest.approx(fit.tolist(), abs=1e-6)
    (row,) = salaries.residual_fit(modelled).collect()
    assert (row.jobs, row.r2) == (400, pytest.approx(r2, abs=1e-9))


def test_more_features_than_the_driver_solves(fitted, monkeypatch):
    """The step by step fit gives nearly the same; a control of one value does no harm."""
    rows, df = fitted
    _, _, r2 = plain_effects(rows, salaries.RIDGE)
    monkeypatch.setattr(salaries, "DENSE", 3)
    assert salaries.skill_effects(df, ["work_mode", "level"]) is None
    (row,) = salaries.residual_fit(salaries.skill_residual_model(df, ["work_mode", "level"])).collect()
    assert row.r2 == pytest.approx(r2, abs=1e-3)


def test_nothing_to_explain(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert [tuple(r) for r in salaries.skill_effects(none, ["work_mode"]).collect()] == [("(intercept)", 0, 0.0)]
    few = spark.createDataFrame([(1, 5.0, ["a"], "x", "y"), (2, 7.0, [], None, "y")], SCHEMA)
    assert [tuple(r) for r in salaries.skill_effects(few, ["work_mode"]).collect()] == [("(intercept)", 2, 6.0)]


def test_no_row_is_part_of_its_own_feature(spark):
    draw = random.Random(6)
    rows = [(i, draw.choice(["hot"] * 5 + ["a", "b"]), float(draw.randint(0, 1000))) for i in range(300)]
    rows.append((1000, "alone", 1e9))
    df = spark.createDataFrame(rows, "job_id int, city string, salary double").repartition(4)
    found = salaries.encoded_means(df, ["city"], "salary").selectExpr(
        "job_id", "city", "salary", "city_mean", f"pmod(xxhash64(job_id), {salaries.FOLDS}) AS fold").collect()
    assert len(found) == len(rows) and {r.fold for r in found} == set(range(salaries.FOLDS))
    everything = sum(r[2] for r in rows) / len(rows)
    for r in found:
        others = [o.salary for o in found if o.city == r.city and o.fold != r.fold]
        assert r.city_mean == pytest.approx(sum(others) / len(others) if others else everything)
    assert next(r.city_mean for r in found if r.city == "alone") == pytest.approx(everything)


def test_vectors_hold_the_places_of_skills(fitted, monkeypatch):
    rows, df = fitted
    counts = {}
    for r in rows:
        for s in r[2]:
            counts[s] = counts.get(s, 0) + 1
    order = sorted((s for s in counts if counts[s] >= 5), key=lambda s: (-counts[s], s))
    dictionary = salaries.skill_dictionary(df)
    assert sorted(map(tuple, dictionary.collect())) == [(i, s, counts[s]) for i, s in enumerate(order)]
    bare = df.sparkSession.createDataFrame([(999, 0.0, ["rare", "other"], None, "same")], SCHEMA)
    found = salaries.job_skill_vectors(df.unionByName(bare), dictionary, ["work_mode"]).collect()
    got = {r.job_id: (r.indices, r.work_mode) for r in found}
    want = {r[0]: (sorted(order.index(s) for s in r[2] if s in order), r[3] or "Unknown") for r in rows}
    assert got == want | {999: ([], "Unknown")}

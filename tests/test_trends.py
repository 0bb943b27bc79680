import numpy as np
import pytest
from pyspark.sql import functions as F

from talentgrid import fixed_values as fv
from talentgrid.functions import series as S
from talentgrid.operators import ranges as quantiles
from talentgrid.operators import trends as T


@pytest.fixture
def made(spark):
    def build(table):
        months = [f"2024_{i:02d}" for i in range(1, 1 + len(next(iter(table.values()))))]
        data = [(k, months, [float(x) for x in v], [float(x) for x in v]) for k, v in table.items()]
        return spark.createDataFrame(
            data, "skill string, months array<string>, mentions array<double>, prevalence array<double>")
    return build


def test_smoothing_golden(made):
    r = T.smoothed(made({"a": [1, 2, 3, 4]}), "mentions", 0.5).orderBy("month_idx").collect()
    assert [x["smoothed"] for x in r] == [1.0, 1.5, 2.25, 3.125]


def test_metrics_match_numpy(made):
    rng = np.random.default_rng(1)
    table = {f"s{i}": rng.uniform(0, 60, 20) for i in range(6)}
    table["zero"] = np.zeros(20)
    frame = made(table)
    smooth = {}
    for k, y in table.items():
        s = [y[0]]
        for v in y[1:]:
            s.append(0.3 * v + 0.7 * s[-1])
        smooth[k] = np.array(s)
    eps = 1e-6 * max(s.max() for s in smooth.values()) + 1e-12
    growth = {r["skill"]: r["growth_pct"] for r in T.growth_rates(frame).collect()}
    rolled = {r["skill"]: r for r in T.rolling_metrics(frame).collect()}
    lines = {r["skill"]: r for r in T.ols_trend(frame).collect()}
    for k, s in smooth.items():
        steps = (s[1:] - (s[:-1] + eps)) / (s[:-1] + eps)
        want = 0.0 if k == "zero" else float(np.clip(steps.mean() * 100, -999, 999))
        assert growth[k] == pytest.approx(want, abs=1e-9)
        slope, intercept = np.polyfit(np.arange(20), s, 1)
        assert lines[k]["trend_slope"] == pytest.approx(slope, abs=1e-9)
        residual = s - (intercept + slope * np.arange(20))
        shape = 0.0 if k == "zero" else residual.std() / np.abs(residual).mean()
        assert lines[k]["nonlinearity"] == pytest.approx(shape, abs=1e-6)
        assert rolled[k]["recent_percentile"] == pytest.approx((s[-6:] <= s[-1]).mean())
        if k != "zero":
            recent, before = s[-6:].mean(), s[-12:-6].mean()
            assert rolled[k]["recent_momentum_pct"] == pytest.approx((recent - before) / before * 100)
            assert rolled[k]["cagr_pct"] == pytest.approx(((s[-1] / s[0]) ** (12 / 19) - 1) * 100)
            assert rolled[k]["peak_ratio"] == pytest.approx(s[-1] / s.max())


def test_short_series_have_no_momentum(made):
    r = T.rolling_metrics(made({"a": [1, 2, 4]})).collect()[0]
    assert r["recent_momentum_pct"] == 0.0 and r["recent_percentile"] == 0.5
    one = T.ols_trend(made({"a": [3]})).collect()[0]
    assert one["trend_slope"] == 0.0 and one["trend_intercept"] == 3.0


@pytest.mark.parametrize("growth, current, momentum, slope, want", [
    (30, 1, 0, 0, 4), (20, 1, 0, 0, 1), (12, 6, 5, 0, 0), (12, 6, 4, 0, 1), (-6, 40, 0, 0, 3),
    (-6, 60, 0, -0.2, 1), (-6, 60, -9, 0, 1), (0, 40, -5, -0.09, 3), (0, 60, -5, -0.13, 3),
    (0, 60, -5, -0.09, 0), (0, 4, 0, 0, 2), (0, 4, 0, -0.06, 1), (9, 4, 0, 0, 1), (0, 50, 0, 0, 1),
])
def test_every_category_branch(spark, growth, current, momentum, slope, want):
    label = T.trend_category(*[F.lit(float(x)) for x in (growth, current, momentum, slope)],
                             F.lit(-5.0), F.lit(5.0))
    assert spark.range(1).select(label).collect()[0][0] == fv.TREND_LABELS[want]


def test_hybrid_weights(spark):
    values = [T.hybrid_momentum(F.lit(b), F.lit(10.0), F.lit(20.0)) for b in (4.9, 5.0, 20.0)]
    got = spark.range(1).select(*[v.alias(str(i)) for i, v in enumerate(values)]).collect()[0]
    assert tuple(got) == pytest.approx((18.0, 15.0, 12.0))


def test_series_fill_only_months_present(posted):
    jobs = [(1, "2024_01", "Senior", ["a", "b"]), (2, "2024_01", "Senior", ["a"]),
            (3, "2024_05", "Senior", ["b"])]
    got = {r["skill"]: r for r in T.skill_series(posted(jobs)).collect()}
    assert got["a"]["months"] == ["2024_01", "2024_05"]
    assert got["a"]["mentions"] == [2.0, 0.0] and got["b"]["prevalence"] == [50.0, 100.0]


def test_too_few_months_give_no_trends(posted):
    jobs = [(i, f"2024_{1 + i % 7:02d}", "Senior", ["a"]) for i in range(70)]
    assert T.skill_trends(T.skill_series(posted(jobs))).count() == 0
    jobs += [(100 + i, "2024_08", "Senior", ["a"]) for i in range(9)]
    assert T.skill_trends(T.skill_series(posted(jobs))).count() == 1


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 40_000])
def test_quantiles_are_exact_at_any_size(spark, n):
    rng = np.random.default_rng(n)
    values = np.where(rng.random(n) < 0.33, 0.0, rng.normal(size=n))
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    wanted = {"p10": 0.1, "p25": 0.25, "p75": 0.75, "p90": 0.9}
    linear = quantiles.linear_quantiles(df, "v", wanted).collect()[0]
    indexed = quantiles.indexed_quantiles(df, "v", wanted).collect()[0]
    lower = quantiles.lower_quantiles(df, "v", wanted).collect()[0]
    ordered = np.sort(values)
    for name, q in wanted.items():
        assert linear[name] == pytest.approx(np.percentile(values, q * 100), abs=1e-12)
        assert indexed[name] == ordered[int(q * n)]
        assert lower[name] == ordered[int(q * (n - 1))]


def test_insights_count_flags(spark):
    data = [("a", fv.TREND_LABELS[4], 9.0), ("b", fv.TREND_LABELS[4], 8.0), ("c", fv.TREND_LABELS[0], 1.0)]
    trends = T.with_flags(spark.createDataFrame(
        data, "skill string, trend_category string, recent_momentum_pct double"))
    got = {(r["kind"], r["name"]): r["value"] for r in T.trend_insights(trends, 1).collect()}
    assert got[("market_health", "innovation_ratio")] == 2.0
    assert got[("emerging", "a")] == 9.0 and ("emerging", "b") not in got


def test_let_binds_once(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "s array<double>")
    got = df.select(S.let(S.mean(F.col("s")), lambda m: F.transform("s", lambda x: x - m))).collect()
    assert got[0][0] == [-0.5, 0.5]

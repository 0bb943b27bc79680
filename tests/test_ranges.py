"""Running sums and quantiles over several ranges, and plans that aggregate once."""

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from talentgrid.operators import groups, ranges, seniority


def test_running_sums_by_key(spark):
    draw = random.Random(4)
    rows = [(draw.choice(["a"] * 9 + ["b", None]), i, draw.randint(-5, 50)) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, i int, v long").repartition(7)
    found = ranges.running_sums(df, ["k"], [F.desc("i")], "v", "upto", "all").collect()
    for key in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: -r[1])
        want = list(zip([r[1] for r in own], accumulate(r[2] for r in own)))
        got = sorted(((r["i"], r["upto"]) for r in found if r["k"] == key), reverse=True)
        assert got == want and {r["all"] for r in found if r["k"] == key} == {want[-1][1]}
    assert ranges.running_sums(df.limit(0), ["k"], [F.desc("i")], "v", "upto").collect() == []


def _windows(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Window [" in line]


def test_one_level_of_many_skills_lies_in_several_ranges(posted):
    jobs = [(i, "2025_01", "Senior", [f"s{j}" for j in range(i, i + 40)]) for i in range(400)]
    found = seniority.cumulative_share(posted(jobs + [(999, "2025_01", "Junior", ["r", "sql"])]))
    # A window over rows goes by their range; the others see one sum for each range.
    assert _windows(found) and all("(_range#" in w or "sum(_sum#" in w for w in _windows(found))
    rows = found.where("seniority_level = 'Senior'").collect()
    counts = {}
    for j in jobs:
        for s in j[3]:
            counts[s] = counts.get(s, 0) + 1
    order = sorted(counts, key=lambda s: (-counts[s], s))
    whole = sum(counts.values())
    want = dict(zip(order, (n / whole for n in accumulate(counts[s] for s in order))))
    assert {r["skill"]: r["cumulative_share"] for r in rows} == pytest.approx(want)
    assert len(rows) == 439


def test_quantiles_of_many_different_values(spark):
    n = 200_000
    df = spark.range(n, numPartitions=8).select(((F.col("id") * 7919) % n / 8).alias("v"))
    asked = {"p10": 0.1, "p25": 0.25, "p75": 0.75, "p90": 0.9, "first": 0.0, "last": 1.0}
    linear = ranges.linear_quantiles(df, "v", asked)
    assert linear.first().asDict() == pytest.approx({k: q * (n - 1) / 8 for k, q in asked.items()})
    indexed = ranges.indexed_quantiles(df, "v", asked).first().asDict()
    assert indexed == {k: min(int(q * n), n - 1) / 8 for k, q in asked.items()}
    plan = linear._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "percentile" not in plan


@pytest.mark.parametrize("values", [[], [None], [2.0], [2.0, None, 5.0], [3.0] * 9 + [1.0]])
def test_quantiles_of_few_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    kept = sorted(v for v in values if v is not None)
    got = ranges.linear_quantiles(df, "v", {"a": 0.1, "b": 0.5}).first()
    for q, x in zip((0.1, 0.5), got):
        if not kept:
            assert x is None
            continue
        place = q * (len(kept) - 1)
        low = kept[int(place)]
        high = kept[min(int(place) + 1, len(kept) - 1)]
        assert x == pytest.approx(low + (high - low) * (place - int(place)))


def test_groups_are_exploded_and_aggregated_once(posted):
    jobs = [(i, "2025_01", "Senior" if i % 3 else "Junior", ["a", "b"][: 1 + i % 2]) for i in range(30)]
    for df in (groups.skills_by_seniority(posted(jobs)), groups.with_group_totals(posted(jobs), "country")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate explode") == 1
        assert sum("Aggregate [" in x and "skill" in x.split("]")[0] for x in plan.splitlines()) == 1

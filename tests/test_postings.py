import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from talentgrid.operators import filters, groups, postings as P, seniority
from talentgrid.operators.keyed import require_columns

JOBS = [
    (1, "2025_01", "Junior", ["Python", "SQL"]),
    (2, "2025_02", "Mid-level", ["Python"]),
    (3, "2025_03", "Senior", ["R", "Spark"]),
    (4, "2025_04", "Junior", ["SQL", "sql ", "Excel"]),
    (5, "2025_04", None, [" "]),
    (6, None, "Junior", ["Python"]),
]


def test_prepare_drops_and_fills(posted, rows):
    got = rows(posted(JOBS), "job_id", "seniority_level", "skills")
    assert got == [
        ("1", "Junior", ["python", "sql"]), ("2", "Mid-level", ["python"]),
        ("3", "Senior", ["r", "spark"]), ("4", "Junior", ["sql", "excel"]),
    ]


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError):
        P.prepare_postings(spark.range(1))
    with pytest.raises(ValueError):
        require_columns(spark.range(1), "id", "other")


def test_pivot_counts_and_shares(posted, rows):
    pivot = P.skill_pivot(posted(JOBS))
    sums = pivot.groupBy(*P.DIMENSIONS).agg(F.round(F.sum("prevalence"), 6).alias("p"))
    assert {r["p"] for r in sums.collect()} == {100.0}
    picked = rows(pivot.where("skill = 'sql'"), "published", "mentions", "prevalence", "skill_category")
    assert picked == [("2025_01", 1, 50.0, "Programming"), ("2025_04", 1, 50.0, "Programming")]


def test_pivot_job_ids_hold_every_id_once(posted):
    jobs = [(i, "2025_01", "Senior", ["Python", "Go"] if i % 3 else ["Python"]) for i in range(400)]
    held = defaultdict(list)
    for r in P.pivot_job_ids(posted(jobs)).collect():
        held[r["skill"]].append(r["job_id"])
    assert sorted(map(int, held["python"])) == list(range(400))
    assert sorted(map(int, held["go"])) == [i for i in range(400) if i % 3]


def test_aggregate_matches_brute_force(posted, rows):
    rng = random.Random(3)
    pool = ["python", "sql", "aws", "tableau", "excel", "spark", "r"]
    jobs = [(i, "2025_01", rng.choice(["Junior", "Senior"]), rng.sample(pool, rng.randint(1, 5)))
            for i in range(200)]
    got = {r["skill"]: (r["mentions"], r["total_jobs"]) for r in P.aggregate_by(posted(jobs)).collect()}
    want = Counter(s for j in jobs for s in j[3])
    assert got == {s: (n, 200) for s, n in want.items()}
    category = {r["skill_category"]: (r["mentions"], r["total_jobs"])
                for r in P.aggregate_by(posted(jobs), "skill_category").collect()}
    programming = sum(1 for j in jobs if {"python", "sql", "r"} & set(j[3]))
    any_category = sum(1 for j in jobs if set(j[3]) - {"excel"})
    assert category["Programming"] == (programming, any_category)
    by_level = groups.skills_by_seniority(posted(jobs), 3).collect()
    for r in by_level:
        of_level = [j for j in jobs if j[2] == r["seniority_level"]]
        assert r["total_jobs"] == len(of_level)
        assert r["mentions"] == sum(1 for j in of_level if r["skill"] in j[3])
        assert r["rank"] <= 3


def test_diversity_matches_plain_loops(posted):
    rng = random.Random(5)
    pool = [f"s{i}" for i in range(12)]
    jobs = [(i, "2025_01", rng.choice(["Junior", "Senior"]), rng.sample(pool, rng.randint(1, 6)))
            for i in range(150)] + [(999, "2025_01", "Lead", ["only"])]
    for r in seniority.skill_diversity(posted(jobs)).collect():
        level = [j for j in jobs if j[2] == r["seniority_level"]]
        counts = sorted(Counter(s for j in level for s in j[3]).values(), reverse=True)
        n, running, index = len(counts), 0.0, 0.0
        for k, c in enumerate(counts):
            running += c / sum(counts)
            index += running - (k / (n - 1) if n > 1 else 0)
        assert r["concentration_index"] == pytest.approx(index / n if n > 1 else 0.0)
        assert r["skills_per_job"] == pytest.approx(sum(counts) / len(level))
        assert r["high_prevalence_skills"] == sum(1 for c in counts if c / len(level) * 100 > 10)


def test_progression_lower_cases_its_skills(posted, rows):
    got = rows(groups.skill_progression(posted(JOBS), ["Python"]), "seniority_level", "mentions", "total_jobs")
    assert got == [("Junior", 1, 2), ("Mid-level", 1, 1)]


def test_filters(posted, rows):
    p = posted(JOBS)
    none = {"country": "All", "seniority_level": None}
    assert filters.filter_postings(p, none).count() == 4
    chosen = {"date_range": ("2025-01-01", "2025-03-01"), "skills": ["PYTHON", "R"]}
    assert rows(filters.filter_postings(p, chosen), "job_id") == [("1",), ("2",), ("3",)]
    summary = filters.filter_summary(p, chosen).collect()[0]
    assert (summary["total"], summary["shown"], summary["reduction_pct"]) == (4, 3, 25.0)
    quoted = {"company_name": "O'Neil"}
    assert filters.filter_postings(p, quoted).count() == 0
    assert filters.facet_values(p, more_than=3).count() == 4


def test_facets_cascade(posted, rows):
    p = posted([(i, "2025_01", "Senior" if i < 3 else "Junior", ["a"]) for i in range(8)])
    values = filters.facet_values(p, {"job_type": "contract"}, more_than=0)
    assert rows(values.where("facet = 'seniority_level'")) == []
    assert rows(values.where("facet = 'job_type'")) == [("job_type", "full_time", 8)]


def test_counting_plans_combine_before_the_shuffle(posted):
    plan = P.aggregate_by(posted(JOBS))._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_saved_rows_answer_for_the_chosen_skills_alone(posted, rows):
    saved = P.pivot_job_ids(posted(JOBS))
    again = P.postings_of_rows(saved)
    assert rows(P.skill_frequency(again), "skill", "mentions") == rows(
        P.skill_frequency(posted(JOBS)), "skill", "mentions")
    chosen = P.postings_of_rows(saved.where("skill = 'sql'"))
    assert {r["skill"] for r in P.skill_frequency(chosen).collect()} == {"sql"}


def test_pivot_groups_are_counted_in_rows_or_by_cells(posted, rows):
    """No cell is shuffled unless its group is large; both ways give the same rows."""
    jobs = [(i, f"2024-0{1 + i % 4}", "Senior", ["python", "sql", f"s{i % 5}"]) for i in range(40)]
    jobs += [(100, "2024-09", "Lead", ["sql"]), (101, "2024-09", "Lead", ["python", "sql"])]
    small, mixed, large = (P.skill_pivot(posted(jobs), n) for n in (1000, 10, 0))
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    got = rows(small)
    assert got == rows(mixed) == rows(large)
    cell = {(r[0], r[7]): (r[9], round(r[10], 6)) for r in got}
    assert cell["2024-09", "sql"] == (2, 66.666667)
    assert cell["2024-01", "python"] == (10, 33.333333)

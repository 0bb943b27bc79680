"""Reports that read the postings several times compute them once."""

import pytest

from talentgrid.operators.postings import prepare_postings
from talentgrid.plans import projection, queries

SCHEMA = (
    "job_id string, published string, country string, company_name string, job_type string, "
    "work_mode string, standardized_title string, seniority_level string, skills array<string>, "
    "salary_min int, salary_max int"
)
SKILLS = ["Python", "SQL", "AWS", "Spark", "Excel", "Tableau"]


def _jobs(n):
    return [
        (str(i), f"2024-0{1 + i % 3}", "France", f"c{i % 4}", ("full_time", "contract")[i % 2], "remote",
         ("Data Engineer", "Data Analyst")[i % 2], ("Junior", "Senior", "Lead")[i % 3],
         [s for k, s in enumerate(SKILLS) if (i + k) % 3], 20_000 + 1_000 * (i % 30), 90_000 + 500 * (i % 7))
        for i in range(n)
    ]


@pytest.mark.parametrize("name", [
    "skill_residual_model", "salary_boosted_baseline", "skill_pivot", "skill_pairs", "pair_prevalence",
    "skill_clusters", "skill_ecosystem", "level_specific_skills",
])
def test_postings_are_computed_once(spark, monkeypatch, name):
    seen, jobs = spark.sparkContext.accumulator(0), _jobs(60)

    def counted(row):
        seen.add(1)
        return row

    def postings(session, _):
        rdd = session.sparkContext.parallelize(jobs, 2).map(counted)
        return prepare_postings(session.createDataFrame(rdd, SCHEMA, verifySchema=False))

    monkeypatch.setattr(projection, "postings", postings)
    assert queries.QUERIES[name](spark, "").collect()
    assert seen.value == len(jobs)

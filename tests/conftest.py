import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from talentgrid.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Sorted tuples of a DataFrame."""

    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=lambda t: [str(x) for x in t])

    return collect


@pytest.fixture
def posted(spark):
    """Prepared postings from (job_id, month, level, skills) tuples."""
    from talentgrid.operators.postings import prepare_postings

    def build(jobs, role="Data Engineer"):
        data = [
            (str(j[0]), j[1], "France", "Acme", "full_time", "remote", role, j[2], j[3])
            for j in jobs
        ]
        schema = (
            "job_id string, published string, country string, company_name string, "
            "job_type string, work_mode string, standardized_title string, "
            "seniority_level string, skills array<string>"
        )
        return prepare_postings(spark.createDataFrame(data, schema))

    return build

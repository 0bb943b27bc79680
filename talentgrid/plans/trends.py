"""The trend plan: postings -> settled skill series -> settled trends."""

from __future__ import annotations

from pyspark.sql import DataFrame

from talentgrid.operators.trends import skill_series, skill_trends
from talentgrid.session import settle


def settled_series(postings: DataFrame) -> DataFrame:
    """Skill series written once: one row per skill, whatever the number of postings."""
    return settle(skill_series(postings), "skill-series")


def settled_trends(postings: DataFrame, **thresholds) -> DataFrame:
    """Trends written once, for the reports that read them several times."""
    return settle(skill_trends(settled_series(postings), **thresholds), "skill-trends")

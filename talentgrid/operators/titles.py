"""Standardizing titles by the nearest category vector.

Titles arrive as vectors; any encoder that returns a vector column can be put in
front. The category vectors are the model and travel with the task; scoring is one matrix product per Arrow batch of titles: no join, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid import fixed_values as fv
from talentgrid.functions.text import extract_seniority
from talentgrid.functions.vectors import unit


def category_centroids(labelled: DataFrame, label: str, vector: str) -> DataFrame:
    """One unit vector per category: the mean of its members, scaled to length 1.

    Means are taken per (category, position) with map-side sums, so a category that
    holds a third of the vectors is no burden; a category then has one value per
    vector position.
    """
    cells = labelled.select(
        F.col(label).alias("category"), F.posexplode(vector).alias("position", "x")
    )
    means = cells.groupBy("category", "position").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.sort_array(F.collect_list(F.struct("position", "x")))
    return means.groupBy("category").agg(
        unit(F.transform(ordered, lambda p: p["x"])).alias("centroid")
    )


@dataclass(frozen=True)
class CategoryModel:
    """Category names, sorted, and the vector of each: what titles are compared with."""

    names: tuple[str, ...]
    vectors: np.ndarray


def category_model(centroids: DataFrame) -> CategoryModel:
    """The model of a centroid table: fetched once, when it is trained, not per query.

    Its size is that of the category list, which the caller decides.
    """
    rows = sorted(centroids.select("category", "centroid").collect(), key=lambda r: str(r[0]))
    if not rows:
        raise ValueError("a model needs a category at least")
    return CategoryModel(
        tuple(str(r["category"]) for r in rows), np.array([r["centroid"] for r in rows], float)
    )


def _cosines(matrix: np.ndarray):
    """Vectorized cosine of a batch of titles with every category."""
    units = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    @F.pandas_udf("array<double>")
    def cosines(vectors: pd.Series) -> pd.Series:
        empty = np.zeros(units.shape[1])
        batch = np.vstack([empty if v is None else v for v in vectors]).astype(float)
        lengths = np.linalg.norm(batch, axis=1, keepdims=True)
        scores = (batch @ units.T) / np.maximum(lengths, 1e-300)
        return pd.Series(list(scores))

    return cosines


def similarity_matrix(titles: DataFrame, key: str, vector: str, model: CategoryModel) -> DataFrame:
    """Cosine of every title with every category, long form.

    All pairs are the result asked for: a row per title and category of the fixed list.
    """
    scored = titles.select(key, F.posexplode(_cosines(model.vectors)(vector)).alias("_at", "score"))
    categories = F.lit(list(model.names))
    return scored.select(
        key, F.element_at(categories, F.col("_at") + 1).alias("category"),
        F.col("score").alias("similarity_score"),
    )


def nearest_category(titles: DataFrame, vector: str, model: CategoryModel,
                     threshold: float = fv.TITLE_MATCH_THRESHOLD) -> DataFrame:
    """Add the best category ('Other' unless its score exceeds the threshold) and score.

    Equal scores go to the first category in order. A missing vector scores 0.
    """
    categories = F.lit(list(model.names))
    scored = titles.withColumn("_scores", _cosines(model.vectors)(vector)).withColumn(
        "similarity_score", F.array_max("_scores")
    )
    at = F.array_position("_scores", F.col("similarity_score")).cast("int")
    role = F.when(F.col("similarity_score") > threshold, F.element_at(categories, at))
    return scored.withColumn(
        "standardized_title", F.coalesce(role, F.lit(fv.NO_ROLE))
    ).drop("_scores")


def classify_titles(jobs: DataFrame, title: str, vector: str, model: CategoryModel,
                    threshold: float = fv.TITLE_MATCH_THRESHOLD) -> DataFrame:
    """Role, seniority and score of every job title."""
    return nearest_category(jobs, vector, model, threshold).withColumn(
        "seniority_level", extract_seniority(F.col(title))
    )

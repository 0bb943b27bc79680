"""Connected components of a link table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.session import settle


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b); the label is the smallest node.

    Each round a node takes the smallest label around it, and then the label of that
    label, so chains halve. Rounds are written to the shared folder, which cuts their
    lineage; only the number of changed labels comes to the driver.
    """
    both = settle(
        links.select("a", "b").union(links.select("b", "a"))
        .where(F.col("a") != F.col("b")).distinct().toDF("node", "next"),
        "links",
    )
    labels = settle(
        both.groupBy("node").agg(F.least(F.min("next"), F.col("node")).alias("label")), "labels"
    )
    while True:
        around = (
            both.join(labels.withColumnRenamed("node", "next"), "next")
            .groupBy("node").agg(F.min("label").alias("near"))
        )
        lower = labels.join(around, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        # A label is itself a node, so the jump always finds its row.
        moved = settle(
            lower.join(jump, "label").select(
                "node", F.least("label", "beyond").alias("label"), "old"
            ),
            "labels",
        )
        if moved.where("label != old").limit(1).count() == 0:
            return moved.select("node", "label")
        labels = moved.select("node", "label")

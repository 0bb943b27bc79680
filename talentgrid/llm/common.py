"""What several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talentgrid.session import settle

#: White space that separates words: blank, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\f\r"


def no_null(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_positions(df: DataFrame, order: list[str], weight: str | None, name: str) -> DataFrame:
    """Adds the sum of ``weight`` (1 if None) over all earlier rows in ``order``.

    Rows are range-partitioned by the whole order, so rows that tie in its first
    columns still spread, and stored with the number of their range. A range is summed
    alone; only one sum per range meets in one place. Columns should be few and narrow.
    """
    spark = df.sparkSession
    ranges = partitions(spark)
    placed = settle(
        df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()),
        "ranges",
    )
    one = F.col(weight) if weight else F.lit(1).cast("long")
    earlier = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = (
        placed.groupBy("__range").agg(F.sum(one).alias("__sum"))
        .withColumn(
            "__before",
            F.sum("__sum").over(
                Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .select("__range", "__before")
    )
    # One row per range: as many rows as there are shuffle partitions.
    return (
        placed.withColumn("__within", F.sum(one).over(earlier))
        .join(F.broadcast(before), "__range")
        .withColumn(name, F.coalesce("__before", F.lit(0)) + F.coalesce("__within", F.lit(0)))
        .drop("__range", "__before", "__within")
    )

"""Column functions over embedding arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentgrid.functions.series import let


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def unit(a: Column) -> Column:
    """Scaled to length 1; an all-zero vector stays zero."""

    def scaled(v: Column) -> Column:
        return let(
            norm(v),
            lambda length: F.transform(
                v, lambda x: F.when(length > 0, x / length).otherwise(F.lit(0.0))
            ),
        )

    return let(a, scaled)


def as_doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))

"""Column functions over ordered ``array<double>`` series, one series per row.

A series has one entry per month, so its length is bounded by the calendar; all
of these run in place on the row and need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F



def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(series: Column) -> Column:
    return F.aggregate(series, F.lit(0.0), lambda acc, x: acc + x)


def mean(series: Column) -> Column:
    return F.try_divide(total(series), F.size(series).cast("double"))


def ewma(series: Column, alpha: float) -> Column:
    """s0 = y0, then s = alpha*y + (1-alpha)*previous s."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie in 0..1")

    def step(acc: Column, y: Column) -> Column:
        blended = F.lit(alpha) * y + F.lit(1.0 - alpha) * F.element_at(acc, -1)
        return F.concat(acc, F.array(blended))

    rest = F.slice(series, F.lit(2), F.greatest(F.size(series) - 1, F.lit(0)))
    return F.aggregate(rest, F.slice(series, 1, 1), step)


def growth_steps(series: Column, eps: Column) -> Column:
    """Month-over-month change (next - (prev + eps)) / (prev + eps)."""
    steps = F.size(series) - 1
    return F.zip_with(
        F.slice(series, F.lit(1), steps),
        F.slice(series, F.lit(2), steps),
        lambda prev, nxt: (nxt - (prev + eps)) / (prev + eps),
    )


def growth_pct(series: Column, eps: Column) -> Column:
    """Mean step in percent, 0 for an all-zero series, clipped to +-999; null below 2 months."""
    average = mean(growth_steps(series, eps)) * 100
    flat = F.forall(series, lambda x: F.abs(x) < eps)
    clipped = F.greatest(F.lit(-999.0), F.least(F.lit(999.0), average))
    return F.when(F.size(series) >= 2, F.when(flat, F.lit(0.0)).otherwise(clipped))


def growth_eps(peak: Column) -> Column:
    """The guard against division by zero, relative to the largest smoothed value."""
    return F.lit(1e-6) * peak + F.lit(1e-12)


def cagr_pct(series: Column) -> Column:
    start, end = F.element_at(series, 1), F.element_at(series, -1)
    steps = F.size(series) - 1
    return F.when(
        (start > 0) & (steps > 0), (F.pow(end / start, F.lit(12.0) / steps) - 1) * 100
    ).otherwise(F.lit(0.0))


def recent_window_means(series: Column, window: int) -> tuple[Column, Column]:
    """(mean of the last window, mean of the window before); nulls if too short."""
    enough = F.size(series) >= 2 * window
    recent = F.when(enough, mean(F.slice(series, F.lit(-window), F.lit(window))))
    before = F.when(enough, mean(F.slice(series, F.lit(-2 * window), F.lit(window))))
    return recent, before


def momentum_pct(series: Column, window: int = 6) -> Column:
    recent, before = recent_window_means(series, window)
    return F.when(before > 0, (recent - before) / before * 100).otherwise(F.lit(0.0))


def current(series: Column) -> Column:
    return F.element_at(series, -1)


def peak_ratio(series: Column) -> Column:
    peak = F.array_max(series)
    return F.when(peak > 0, current(series) / peak).otherwise(F.lit(0.0))


def recent_percentile(series: Column, window: int = 6) -> Column:
    """Share of the last ``window`` values not above the latest; 0.5 when too short."""
    last = F.slice(series, F.lit(-window), F.lit(window))
    below = let(current(series), lambda now: F.size(F.filter(last, lambda x: x <= now)))
    return F.when(F.size(series) >= window, below / F.lit(float(window))).otherwise(F.lit(0.5))



def ols_slope(series: Column) -> Column:
    """Least-squares slope over x = 0..n-1; 0 for a single point."""
    n = F.size(series).cast("double")
    cross = total(F.transform(series, lambda y, i: i * y)) - (n - 1) / 2 * total(series)
    spread = n * (n * n - 1) / 12
    return F.when(spread > 0, cross / spread).otherwise(F.lit(0.0))


def ols_intercept(series: Column, slope: Column) -> Column:
    return mean(series) - slope * (F.size(series) - 1) / F.lit(2.0)


def nonlinearity(series: Column, slope: Column, intercept: Column) -> Column:
    """Population std of the residuals over their mean absolute value; 0 if none."""

    def spread_over_size(residuals: Column) -> Column:
        mean_abs = mean(F.transform(residuals, F.abs))
        squares = mean(F.transform(residuals, lambda r: r * r))
        variance = F.greatest(squares - F.pow(mean(residuals), F.lit(2.0)), F.lit(0.0))
        return F.when(mean_abs > 0, F.sqrt(variance) / mean_abs).otherwise(F.lit(0.0))

    def residuals_of(line: Column) -> Column:
        return F.transform(series, lambda y, i: y - (line["b"] + line["a"] * i))

    line = F.struct(slope.alias("a"), intercept.alias("b"))
    return let(let(line, residuals_of), spread_over_size)

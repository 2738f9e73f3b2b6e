"""Column helpers shared by the operators. Everything here stays a native expression."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tiltlab.params import DISPERSION_FLOOR


def total(values: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def dot(left: Column, right: Column) -> Column:
    """Inner product of two equally long arrays."""
    return total(F.zip_with(left, right, lambda a, b: a * b))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def at_offset(value: Column | str, window: WindowSpec, rows: int) -> Column:
    """Value exactly ``rows`` steps away on the trading-day index the window is ordered by.

    A range frame, not ``lead``: rows of a ticker without a close are absent from the panel, and the
    neighbour by position would then be a different day.
    """
    return F.first(value).over(window.rangeBetween(rows, rows))


def average_rank(value: str, *keys: str) -> Column:
    """1-based rank within ``keys``; ties share their mean rank. One sort serves both terms."""
    by_value = Window.partitionBy(*keys).orderBy(value)
    peers = F.count(F.lit(1)).over(by_value.rangeBetween(Window.currentRow, Window.currentRow))
    return F.rank().over(by_value) + (peers - 1) / F.lit(2.0)


def correlation(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; NULL where either side is constant."""
    spread = F.var_pop(x) * F.var_pop(y)
    return F.when(spread > 0, F.try_divide(F.covar_pop(x, y), F.sqrt(spread)))


def hashed_uniform(*parts: Column) -> Column:
    """Uniform in [0, 1) from the md5 of the parts joined by ':'; any engine can reproduce it."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def score_variance(dispersion: Column, effective_count: Column) -> Column:
    """Sampling variance of a sentiment score; zero without headlines."""
    spread = F.pow(F.greatest(dispersion, F.lit(DISPERSION_FLOOR)), F.lit(2.0))
    return F.when(effective_count > 0, spread / effective_count).otherwise(F.lit(0.0))


def shrunk(kappa: Column, se: Column, t: Column) -> Column:
    """Positive-part shrinkage of a coefficient as struct(kappa, se); zeros where |t| <= 1 or undefined."""
    usable = t.isNotNull() & ~F.isnan(t) & (F.abs(t) != F.lit(float("inf"))) & (F.abs(t) > 1)
    keep = 1 - F.try_divide(F.lit(1.0), t * t)
    return F.struct(
        F.when(usable, kappa * keep).otherwise(0.0).alias("kappa"),
        F.when(usable, se * F.sqrt(keep)).otherwise(0.0).alias("se"),
    )

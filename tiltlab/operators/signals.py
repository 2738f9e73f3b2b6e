"""Signal variants, cross-sections and view inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltlab.operators.panel import by_day, excess_between
from tiltlab.params import FUNDAMENTALS_CONFIDENCE, MAX_VIEW_CONFIDENCE, MIN_NAMES, TRADING_DAYS


def with_surprise(levels: DataFrame, value: str = "level", window: int = 60, min_obs: int = 20) -> DataFrame:
    """Add ``surprise``: level minus the mean of the levels in the previous ``window`` rows."""
    before = by_day().rangeBetween(-window, -1)
    unusual = F.col(value) - F.avg(value).over(before)
    return levels.withColumn("surprise", F.when(F.count(value).over(before) >= min_obs, unusual))


def momentum(lookback: int = 5) -> Column:
    """Trailing market-excess log return of the panel row."""
    return excess_between(by_day(), -lookback, 0)


def residual_on(points: DataFrame, y: str, x: str, keys: Sequence[str] = ("t",), out: str = "residual") -> DataFrame:
    """Add the residual of a per-key regression of y on x; slope 0 if x is constant.

    Only rows with both sides count; the residual is NULL elsewhere and where fewer than five names remain.
    """
    group = Window.partitionBy(*keys)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    px, py = F.when(both, F.col(x)), F.when(both, F.col(y))
    spread = F.var_pop(px).over(group)
    slope = F.when(spread > 0, F.try_divide(F.covar_pop(px, py).over(group), spread)).otherwise(0.0)
    residual = py - F.avg(py).over(group) - slope * (px - F.avg(px).over(group))
    return points.withColumn(out, F.when(F.count(px).over(group) >= MIN_NAMES, residual))


def cross_sections(points: DataFrame, keys: Sequence[str], horizon: Column) -> DataFrame:
    """Demeaned signal ``x`` and demeaned, vol-scaled, annualised forward return ``y`` per key and day.

    ``points`` has ``value``, ``forward`` and ``realized_vol``; days need five names.
    """
    day = Window.partitionBy(*keys, "t")
    scaled = points.where("realized_vol > 0").withColumn(
        "_y", F.col("forward") * (F.lit(float(TRADING_DAYS)) / horizon) / F.col("realized_vol")
    )
    return (
        scaled.withColumn("_n", F.count(F.lit(1)).over(day))
        .withColumn("x", F.col("value") - F.avg("value").over(day))
        .withColumn("y", F.col("_y") - F.avg("_y").over(day))
        .where(F.col("_n") >= MIN_NAMES)
        .drop("_n", "_y")
    )


def fundamental_score(growth: Column, margin: Column, leverage: Column) -> Column:
    """struct(score, coverage) from the metrics that are known; NULL if none is."""
    infinite = leverage == F.lit(float("inf"))
    parts = F.array_compact(
        F.array(
            F.tanh(growth / 0.15),
            F.tanh((margin - 0.08) / 0.10),
            F.when(infinite, -1.0).otherwise(F.tanh(1.0 - leverage)),
        )
    )
    known = F.size(parts)
    mean = F.aggregate(parts, F.lit(0.0), lambda a, v: a + v) / known
    return F.when(known > 0, F.struct(mean.alias("score"), (known / 3.0).alias("coverage")))


def combine(score: Column, confidence: Column, fscore: Column, coverage: Column, sentiment_weight: float | Column) -> Column:
    """struct(value, confidence): blend of sentiment and fundamentals by confidence."""
    share = F.least(F.greatest(sentiment_weight if isinstance(sentiment_weight, Column) else F.lit(sentiment_weight), F.lit(0.0)), F.lit(1.0))
    ws = share * F.coalesce(confidence, F.lit(0.0))
    wf = F.when(
        fscore.isNotNull(), (1.0 - share) * FUNDAMENTALS_CONFIDENCE * coverage
    ).otherwise(0.0)
    weight = ws + wf
    blended = ws * F.coalesce(score, F.lit(0.0)) + wf * F.coalesce(fscore, F.lit(0.0))
    return F.struct(
        F.when(weight > 0, F.try_divide(blended, weight)).otherwise(0.0).alias("value"),
        F.least(weight, F.lit(MAX_VIEW_CONFIDENCE)).alias("confidence"),
    )


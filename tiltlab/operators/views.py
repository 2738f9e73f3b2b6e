"""Signals to views on expected returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltlab.functions.numeric import clamp, score_variance, shrunk
from tiltlab.params import MAX_VIEW_CONFIDENCE, MIN_VIEW_CONFIDENCE, OMEGA_FLOOR


def heuristic_views(assets: DataFrame, tau: float | Column, view_scale: float | Column) -> DataFrame:
    """Add nullable ``q`` and ``omega``: one absolute view per asset with enough confidence.

    ``assets`` has ``pi``, ``volatility``, ``value`` and ``confidence``.
    """
    usable = F.col("confidence") >= MIN_VIEW_CONFIDENCE
    c = clamp(F.col("confidence"), MIN_VIEW_CONFIDENCE, MAX_VIEW_CONFIDENCE)
    vol = F.col("volatility")
    return assets.withColumn(
        "q", F.when(usable, F.col("pi") + view_scale * F.col("value") * vol)
    ).withColumn("omega", F.when(usable, tau * vol * vol * (1.0 - c) / c))


def calibrated_views(assets: DataFrame, group: str, sentiment: Column, fundamentals: Column) -> DataFrame:
    """Add nullable ``q`` and ``omega`` from estimated coefficients.

    ``assets`` has ``pi``, ``volatility``, ``score``, ``dispersion``, ``effective_count`` (null without
    enough headlines) and ``fscore``. The coefficients are struct(kappa, se, t) columns, null if not
    estimated. Signals are demeaned over the group; a view needs a signal with a coefficient that
    survives shrinkage.
    """
    everyone = Window.partitionBy(group)
    ready = (
        assets.withColumn("_xs", F.col("score") - F.avg("score").over(everyone))
        .withColumn("_xf", F.col("fscore") - F.avg("fscore").over(everyone))
        .withColumn("_ks", shrunk(sentiment["kappa"], sentiment["se"], sentiment["t"]))
        .withColumn("_kf", shrunk(fundamentals["kappa"], fundamentals["se"], fundamentals["t"]))
    )
    by_news = (F.col("_ks.kappa") != 0) & F.col("_xs").isNotNull()
    by_facts = (F.col("_kf.kappa") != 0) & F.col("_xf").isNotNull()

    def square(c: Column) -> Column:
        return c * c

    noise = square(F.col("_ks.kappa")) * score_variance(F.col("dispersion"), F.col("effective_count"))
    alpha = F.when(by_news, F.col("_ks.kappa") * F.col("_xs")).otherwise(0.0) + F.when(
        by_facts, F.col("_kf.kappa") * F.col("_xf")
    ).otherwise(0.0)
    variance = F.when(by_news, square(F.col("_ks.se") * F.col("_xs")) + noise).otherwise(0.0) + F.when(
        by_facts, square(F.col("_kf.se") * F.col("_xf"))
    ).otherwise(0.0)
    used = by_news | by_facts
    vol = F.col("volatility")
    return (
        ready.withColumn("q", F.when(used, F.col("pi") + vol * alpha))
        .withColumn("omega", F.when(used, vol * vol * variance + OMEGA_FLOOR))
        .drop("_xs", "_xf", "_ks", "_kf")
    )


def tilt_readback(views: DataFrame, tau: float | Column) -> DataFrame:
    """Show a calibrated view as (value, confidence): tilt per unit of volatility and its weight
    against the prior; zeros without a view."""
    prior = tau * F.col("volatility") * F.col("volatility")
    return views.withColumn(
        "value", F.coalesce(F.try_divide(F.col("q") - F.col("pi"), F.col("volatility")), F.lit(0.0))
    ).withColumn("confidence", F.coalesce(prior / (prior + F.col("omega")), F.lit(0.0)))


def long_views(assets: DataFrame, group: str) -> DataFrame:
    """Absolute views as ``(group, view_id, ticker, pick, q, omega)`` rows."""
    return assets.where("q is not null").select(
        group, F.col("ticker").alias("view_id"), "ticker", F.lit(1.0).alias("pick"), "q", "omega"
    )

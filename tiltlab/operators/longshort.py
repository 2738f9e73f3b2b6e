"""Daily long-short test of a signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiltlab.operators.stats import hac_mean
from tiltlab.params import (
    COST_LEVELS_BPS,
    MIN_LONG_SHORT_ACTIVE,
    MIN_LONG_SHORT_DAYS,
    NEWS_PERSISTENCE,
    TRADING_DAYS,
)


def leg_weights(points: DataFrame, leg_fraction: float = 1.0 / 3.0) -> DataFrame:
    """Non-zero weights ``(signal, t, ticker, weight, next_return)``: +1/k on top, -1/k on the bottom k.

    ``points`` has ``value`` and ``next_return``; ties rank by ticker, legs under two names stay flat.
    """
    day = Window.partitionBy("signal", "t")
    ranked = (
        points.where("value is not null and next_return is not null")
        .withColumn("_rank", F.row_number().over(day.orderBy("value", "ticker")))
        .withColumn("_n", F.count(F.lit(1)).over(day))
        .withColumn("_k", F.floor(F.col("_n").cast("double") * F.lit(leg_fraction)).cast("int"))
    )
    side = F.when(F.col("_rank") > F.col("_n") - F.col("_k"), 1.0).when(
        F.col("_rank") <= F.col("_k"), -1.0
    )
    return (
        ranked.where("_k >= 2")
        .withColumn("weight", side / F.col("_k"))
        .where("weight is not null")
        .select("signal", "t", "ticker", "weight", "next_return", F.col("_k").alias("leg"))
    )


def daily_book(weights: DataFrame, days: DataFrame) -> DataFrame:
    """Per (signal, day): gross return, turnover and leg size; flat days are zero.

    A weight is today's position and tomorrow's previous one, so turnover is one aggregate over both
    roles; it counts only where yesterday's book was not empty.
    """
    roles = weights.select(
        "signal",
        "ticker",
        F.inline(
            F.array(
                F.struct(
                    F.col("t").alias("t"),
                    F.col("weight").alias("now"),
                    F.lit(0.0).alias("before"),
                    (F.col("weight") * F.col("next_return")).alias("gain"),
                    F.col("leg").alias("leg"),
                ),
                F.struct(
                    (F.col("t") + 1).alias("t"),
                    F.lit(0.0).alias("now"),
                    F.col("weight").alias("before"),
                    F.lit(0.0).alias("gain"),
                    F.lit(None).cast("int").alias("leg"),
                ),
            )
        ),
    )
    book = (
        roles.groupBy("signal", "t", "ticker")
        .agg(
            F.abs(F.sum("now") - F.sum("before")).alias("moved"),
            F.max(F.abs("before")).alias("held"),
            F.sum("gain").alias("gain"),
            F.max("leg").alias("leg"),
        )
        .groupBy("signal", "t")
        .agg(
            F.sum("gain").alias("gross"),
            F.when(F.max("held") > 0, F.sum("moved")).alias("turnover"),
            F.max("leg").alias("leg"),
        )
    )
    signals = weights.select("signal").distinct()
    grid = signals.select(
        "signal", F.explode(days.agg(F.collect_list("t")).scalar()).alias("t")
    )
    return grid.join(book, ["signal", "t"], "left").select(
        "signal", "t", F.coalesce("gross", F.lit(0.0)).alias("gross"), "turnover", "leg"
    )


def summary(book: DataFrame, leg_fraction: float = 1.0 / 3.0) -> DataFrame:
    """One row per signal with gross statistics and an array of net results per cost level."""
    ann = F.lit(float(TRADING_DAYS))
    active = F.count_if(F.col("gross") != 0)
    base = hac_mean(
        book, ("signal",), "t", "gross", F.lit(NEWS_PERSISTENCE), NEWS_PERSISTENCE,
        extra=(
            active.alias("active_days"),
            (F.coalesce(F.sum("leg"), F.lit(0)) / F.greatest(active, F.lit(1))).alias("avg_names_per_leg"),
            (F.stddev_samp("gross") * F.sqrt(ann)).alias("gross_annual_volatility"),
            F.coalesce(F.avg("turnover"), F.lit(0.0)).alias("avg_daily_turnover"),
            (F.coalesce(F.sum("turnover"), F.lit(0.0)) / F.count(F.lit(1))).alias("turnover_per_day"),
        ),
    ).where((F.col("n") >= MIN_LONG_SHORT_DAYS) & (F.col("active_days") >= MIN_LONG_SHORT_ACTIVE))
    vol = F.col("gross_annual_volatility")

    def sharpe(annual):
        return F.when(vol > 0, F.try_divide(annual, vol)).otherwise(0.0)

    net_mean = lambda bps: F.col("mean") - bps / 1e4 * F.col("turnover_per_day")
    net = F.array(
        *[
            F.struct(
                F.lit(bps).alias("cost_bps"),
                (net_mean(bps) * ann).alias("annual_return"),
                sharpe(net_mean(bps) * ann).alias("sharpe"),
            )
            for bps in COST_LEVELS_BPS
        ]
    )
    return base.select(
        "signal",
        F.lit(leg_fraction).alias("leg_fraction"),
        F.col("n").alias("days"),
        "avg_names_per_leg",
        F.col("mean").alias("daily_gross"),
        "se",
        "t",
        (F.col("mean") * ann).alias("gross_annual_return"),
        "gross_annual_volatility",
        sharpe(F.col("mean") * ann).alias("gross_sharpe"),
        "avg_daily_turnover",
        F.when(
            F.col("turnover_per_day") > 0, F.try_divide(F.col("mean"), F.col("turnover_per_day")) * 1e4
        ).alias("break_even_cost_bps"),
        net.alias("net"),
    )

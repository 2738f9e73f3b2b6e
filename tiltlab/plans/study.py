"""The panel of one evaluation: prices, news, fundamentals and the signal variants on it."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltlab.operators import panel as P
from tiltlab.operators import sentiment, signals, stats
from tiltlab.operators.fundamentals import fundamental_panel
from tiltlab.params import (
    EX_MOMENTUM,
    FUNDAMENTALS,
    LEVEL,
    NEWS_PERSISTENCE,
    SIGNAL_PERSISTENCE,
    SURPRISE,
    EvalParams,
)
from tiltlab.session import cut_lineage


@dataclass(frozen=True)
class Study:
    """Inputs of an evaluation as DataFrames.

    ``prices`` and ``days`` are read by several branches, so callers hand them in reduced to one row
    per (ticker, day) and written to the checkpoint folder: the raw tables are then scanned once.
    """

    params: EvalParams
    prices: DataFrame
    days: DataFrame
    headlines: DataFrame
    facts: DataFrame | None = None
    registrants: DataFrame | None = None
    splits: DataFrame | None = None
    start: str | None = None
    end: str | None = None

    def with_params(self, **changes) -> Study:
        return replace(self, params=replace(self.params, **changes))

    def panel(self) -> DataFrame:
        return P.indexed_prices(self.prices, self.days)

    def dated_headlines(self) -> DataFrame:
        """Headlines of the evaluated span: from ``start`` on, before ``end``; of its priced names."""
        kept = self.headlines.join(self.prices.select("ticker").distinct(), "ticker", "left_semi")
        if self.start is not None:
            kept = kept.where(F.col("date") >= F.lit(self.start).cast("date"))
        if self.end is not None:
            kept = kept.where(F.col("date") < F.lit(self.end).cast("date"))
        return kept

    def news(self) -> DataFrame:
        return sentiment.sentiment_panel(
            self.headlines, self.days, self.params.news_window_days, self.params.min_headlines
        )

    def fundamentals(self) -> DataFrame:
        return fundamental_panel(self.facts, self.registrants, self.days)

    def in_window(self) -> Column:
        """Predicate on ``t``: inside the evaluated days."""
        if self.start is None and self.end is None:
            return F.lit(True)
        bounds = P.evaluation_bounds(
            self.days,
            self.start or "0001-01-01",
            self.end or "9999-12-31",
            self.params.news_window_days,
        )
        return F.col("t").between(bounds.select("t_start").scalar(), bounds.select("t_end").scalar())


def price_features(study: Study) -> DataFrame:
    """Everything the panel says about (ticker, t), in one pass over the ticker's days."""
    p = study.params
    return P.with_returns(study.panel(), p.vol_window).select(
        "ticker",
        "t",
        signals.momentum(p.momentum_lookback).alias("momentum"),
        "realized_vol",
        P.next_return().alias("next_return"),
        P.forward_excess(sorted({*p.horizons, p.calibration_horizon})).alias("forwards"),
    )


def signal_grid(study: Study, with_fundamentals: bool = True) -> DataFrame:
    """Wide ``(ticker, t)`` grid: price features next to every signal variant, nulls where undefined.

    The sides meet on (ticker, t). The grid is written once to the checkpoint folder: IC, calibration,
    long-short and backtest all start from it instead of from the raw tables.
    """
    p = study.params
    news = signals.with_surprise(
        study.news().select("ticker", "t", F.col("score").alias("level")),
        "level",
        p.surprise_window,
        p.surprise_min_obs,
    )
    grid = price_features(study).join(news, ["ticker", "t"], "full")
    if with_fundamentals and study.facts is not None:
        scores = cut_lineage(study.fundamentals().select("ticker", "t", "fscore"))
        grid = grid.join(scores, ["ticker", "t"], "full")
    else:
        grid = grid.withColumn("fscore", F.lit(None).cast("double"))
    return cut_lineage(signals.residual_on(grid, "level", "momentum", ("t",), "ex_momentum"))


VARIANTS = (
    (LEVEL, "level"),
    (SURPRISE, "surprise"),
    (EX_MOMENTUM, "ex_momentum"),
    (FUNDAMENTALS, "fscore"),
)


def signal_variants(grid: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """Stack the grid's variants: ``signal`` and ``value`` next to the price features."""
    chosen = [v for v in VARIANTS if names is None or v[0] in names]
    stacked = F.array(
        *[F.struct(F.lit(name).alias("signal"), F.col(column).alias("value")) for name, column in chosen]
    )
    features = ["momentum", "realized_vol", "next_return", "forwards"]
    return grid.select("ticker", "t", *features, F.inline(stacked)).where("value is not null")


def persistence() -> Column:
    """HAC persistence of the row's signal."""
    out = F.lit(NEWS_PERSISTENCE)
    for name, value in SIGNAL_PERSISTENCE.items():
        out = F.when(F.col("signal") == name, value).otherwise(out)
    return out


def signal_returns(study: Study, variants: DataFrame) -> DataFrame:
    """Signals with their forward excess returns: ``(signal, horizon, ticker, t, value, forward)``."""
    wanted = F.filter("forwards", lambda f: f["horizon"].isin(*study.params.horizons))
    return (
        variants.where(study.in_window())
        .select("signal", "ticker", "t", "value", F.inline(wanted))
        .where("forward is not null")
    )


def ic_by_date(study: Study, variants: DataFrame) -> DataFrame:
    """Rank correlation of signal and forward return per (signal, horizon, t)."""
    return stats.spearman_by(
        signal_returns(study, variants), ("signal", "horizon", "t"), "value", "forward"
    )


def ic_table(study: Study, variants: DataFrame) -> DataFrame:
    """One row per (signal, horizon): does the signal rank future returns?"""
    lags = F.col("horizon") - 1 + persistence()
    max_lags = max(study.params.horizons) - 1 + max(SIGNAL_PERSISTENCE.values())
    return stats.ic_summary(ic_by_date(study, variants), ("signal", "horizon"), lags, max_lags)


def calibration_points(study: Study, variants: DataFrame) -> DataFrame:
    """Level and fundamentals with the calibration-horizon forward return and realized volatility."""
    h = study.params.calibration_horizon
    ahead = F.get(F.filter("forwards", lambda f: f["horizon"] == h), F.lit(0))["forward"]
    return (
        variants.where(F.col("signal").isin(LEVEL, FUNDAMENTALS))
        .where(study.in_window())
        .select("signal", "ticker", "t", "value", "realized_vol", ahead.alias("forward"))
        .where("forward is not null")
    )


def calibration_sections(study: Study, variants: DataFrame) -> DataFrame:
    """Demeaned cross-sections of level and fundamentals against vol-scaled forward returns."""
    return signals.cross_sections(
        calibration_points(study, variants),
        ("signal",),
        F.lit(float(study.params.calibration_horizon)),
    ).select("signal", "ticker", "t", "x", "y")


def calibration_sums(study: Study, variants: DataFrame) -> DataFrame:
    """Per signal and day the sums the slope needs: ``sxx``, ``sxy`` and the number of names."""
    return stats.date_sums(calibration_sections(study, variants), ("signal",))


def calibration(study: Study, variants: DataFrame) -> DataFrame:
    """Estimated coefficient per signal: ``kappa, se, t, dates, observations``."""
    return stats.pooled_slope(
        calibration_sums(study, variants), ("signal",), study.params.calibration_lags
    )


def coverage(study: Study, newly_scored: DataFrame | None = None) -> DataFrame:
    """One row: share of (ticker, day) cells of the evaluated days that have a signal, and the headlines of the evaluated span.

    ``newly_scored`` holds the texts that had to be scored for it; their number is null if it is not given.
    """
    days = study.days.where(study.in_window()).agg(F.count(F.lit(1)).alias("days"))
    names = study.prices.agg(F.countDistinct("ticker").alias("names"))
    news = study.news().join(study.prices.select("ticker").distinct(), "ticker", "left_semi")
    covered = news.where(study.in_window()).agg(F.count(F.lit(1)).alias("covered"))
    cells = names.scalar() * days.scalar()
    total = study.dated_headlines().agg(F.count(F.lit(1)).alias("headlines"))
    scored = F.lit(None).cast("bigint") if newly_scored is None else newly_scored.agg(F.count(F.lit(1)).alias("n")).scalar()
    return covered.select(
        "covered",
        cells.alias("cells"),
        (F.col("covered") / F.greatest(cells, F.lit(1)).cast("double")).alias("signal_coverage"),
        total.scalar().alias("headlines"),
        scored.alias("newly_scored"),
    ).withColumn("sparse", F.col("signal_coverage") < 0.3)


def headlines_per_ticker(study: Study) -> DataFrame:
    """Headlines of the evaluated span per ticker, zeros included."""
    counted = study.dated_headlines().groupBy("ticker").agg(F.count(F.lit(1)).alias("headlines"))
    names = study.prices.select("ticker").distinct()
    return names.join(counted, "ticker", "left").na.fill(0, ["headlines"])

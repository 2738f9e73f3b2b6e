"""Walk-forward backtest of the five strategies on a study."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiltlab.operators import backtest as B
from tiltlab.operators import panel as P
from tiltlab.operators import portfolio, risk, signals, stats, views
from tiltlab.params import FUNDAMENTALS, LEVEL, STRATEGIES
from tiltlab.plans.study import Study
from tiltlab.session import cut_lineage


@dataclass(frozen=True)
class Backtest:
    plan: DataFrame
    targets: DataFrame
    returns: DataFrame
    turnovers: DataFrame
    counters: DataFrame | None = None


def plan_of(study: Study) -> DataFrame:
    start = F.lit(0)
    if study.start is not None:
        start = P.evaluation_bounds(
            study.days, study.start, study.end or "9999-12-31", study.params.news_window_days
        ).select("t_start").scalar()
    return B.schedule(study.days, start, study.params.cov_window, study.params.rebalance_every)


def investable(study: Study, plan: DataFrame) -> DataFrame:
    """Trailing return windows of the investable names per rebalance; days with one name drop out."""
    returns = P.with_returns(study.panel()).select("ticker", "t", F.col("log_return").alias("ret"))
    windows = risk.trailing_windows(returns, plan, study.params.cov_window)
    wide = windows.groupBy("r").agg(F.countDistinct("ticker").alias("names")).where("names >= 2")
    return windows.join(wide.select("r"), "r", "left_semi")


def market_caps(study: Study, fundamentals: DataFrame | None = None) -> DataFrame:
    """``(ticker, t, market_cap)`` from point-in-time shares, that day's close and later splits."""
    known = (fundamentals if fundamentals is not None else study.fundamentals()).select(
        "ticker", "t", "shares", "shares_as_of"
    )
    priced = study.panel().select("ticker", "t", "close").join(known, ["ticker", "t"], "left")
    return P.market_cap(priced, study.splits)


def prior_weights(windows: DataFrame, caps: DataFrame) -> DataFrame:
    """Market weights of the investable names per rebalance, with the equal-weight fallback flag."""
    names = windows.select("r", "ticker").distinct()
    at = names.join(
        caps.select(F.col("t").alias("r"), "ticker", "market_cap"), ["r", "ticker"], "left"
    )
    return P.cap_weights(at, ("r",))


def simple_targets(prior: DataFrame) -> DataFrame:
    """Market-cap and equal-weight targets from the prior weights."""
    equal = F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("r"))
    both = F.array(
        F.struct(F.lit(STRATEGIES[0]).alias("strategy"), F.col("market_weight").alias("weight")),
        F.struct(F.lit(STRATEGIES[1]).alias("strategy"), F.col("_equal").alias("weight")),
    )
    return prior.withColumn("_equal", equal).select("r", "ticker", F.inline(both)).select(
        "strategy", "r", "ticker", "weight"
    )


def coefficients_as_of(study: Study, sums: DataFrame, rebalances: DataFrame) -> DataFrame:
    """Per rebalance the coefficients with enough realized dates: nullable structs of both signals."""
    p = study.params
    known = stats.slope_as_of(sums, rebalances, ("signal",), p.calibration_horizon, p.calibration_lags).where(
        F.col("dates") >= p.min_calibration_dates
    )
    pick = lambda name: F.max(F.when(F.col("signal") == name, F.struct("kappa", "se", "t")))
    return known.groupBy("r").agg(pick(LEVEL).alias("c_news"), pick(FUNDAMENTALS).alias("c_facts"))


def view_assets(
    study: Study, cov: DataFrame, prior: DataFrame, news: DataFrame, fundamentals: DataFrame,
    coefficients: DataFrame,
) -> DataFrame:
    """Per (r, ticker, strategy) the inputs of the solve: pi, sigma row and the strategy's view."""
    p = study.params
    pi = risk.implied_returns(
        cov, prior.select("r", "ticker", F.col("market_weight").alias("weight")), "r", p.risk_aversion
    )
    at_news = news.select(
        F.col("t").alias("r"), "ticker", "score", "confidence", "dispersion", "effective_count"
    )
    at_facts = fundamentals.select(F.col("t").alias("r"), "ticker", "fscore", "coverage")
    assets = (
        pi.join(risk.volatilities(cov, "r"), ["r", "ticker"])
        .join(at_news, ["r", "ticker"], "left")
        .join(at_facts, ["r", "ticker"], "left")
        # One row per rebalance: bounded by the calendar.
        .join(F.broadcast(coefficients), "r", "left")
    )
    blended = signals.combine(
        F.col("score"), F.col("confidence"), F.col("fscore"), F.col("coverage"), p.sentiment_weight
    )
    by_hand = views.heuristic_views(
        assets.withColumn("_s", blended)
        .withColumn("value", F.col("_s.value"))
        .withColumn("confidence", F.col("_s.confidence"))
        .drop("_s"),
        p.tau,
        p.view_scale,
    ).withColumnsRenamed({"q": "h_q", "omega": "h_omega"})
    both = views.calibrated_views(by_hand, "r", F.col("c_news"), F.col("c_facts"))
    none = F.lit(None).cast("double")
    per_strategy = F.array(
        *[
            F.struct(F.lit(name).alias("strategy"), q.alias("q"), omega.alias("omega"))
            for name, q, omega in (
                (STRATEGIES[2], none, none),
                (STRATEGIES[3], F.col("h_q"), F.col("h_omega")),
                (STRATEGIES[4], F.col("q"), F.col("omega")),
            )
        ]
    )
    return both.join(risk.matrix_rows(cov, "r"), ["r", "ticker"]).select(
        "r", "ticker", "pi", "sigma", F.inline(per_strategy)
    )


def all_targets(study: Study, sums: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Targets of all five strategies, and one row of counters.

    If any strategy's solve fails at a rebalance, all five skip it together.
    """
    p = study.params
    windows = cut_lineage(investable(study, plan))
    cov = cut_lineage(risk.covariance(windows, "r")[0])
    fundamentals = cut_lineage(study.fundamentals())
    prior = cut_lineage(prior_weights(windows, market_caps(study, fundamentals)))
    rebalances = B.rebalance_days(plan)
    coefficients = cut_lineage(coefficients_as_of(study, sums, rebalances))
    solved = cut_lineage(
        portfolio.view_weights(
            view_assets(study, cov, prior, study.news(), fundamentals, coefficients),
            ("r", "strategy"),
            p.tau,
            p.risk_aversion,
            p.max_weight,
        )
    )
    complete = (
        solved.groupBy("r").agg(F.countDistinct("strategy").alias("n")).where(F.col("n") == 3).select("r")
    )
    every = simple_targets(prior).unionByName(solved.select("strategy", "r", "ticker", "weight"))
    targets = every.join(complete, "r", "left_semi").select("strategy", "r", "ticker", "weight")
    counters = prior.groupBy("r").agg(F.max("cap_fallback").alias("fallback")).join(
        coefficients.select("r", F.lit(True).alias("calibrated")), "r", "left"
    ).join(complete.withColumn("solved", F.lit(True)), "r", "left").agg(
        F.count_if("solved").alias("rebalances"),
        F.count_if("calibrated").alias("calibrated_rebalances"),
        F.count_if("fallback").alias("market_cap_fallbacks"),
    )
    return targets, counters


def hold(study: Study, plan: DataFrame, targets: DataFrame, counters: DataFrame | None = None) -> Backtest:
    """Daily returns and turnover of targets held until the next successful rebalance."""
    targets = cut_lineage(targets)
    held = B.periods(targets, plan)
    returns = P.with_returns(study.panel()).select("ticker", "t", "simple_return")
    values = cut_lineage(B.drifting_values(targets, returns, held))
    turnovers = B.turnover(targets, values, held)
    daily = B.daily_returns(targets, values, turnovers, plan, study.params.cost_bps)
    return Backtest(plan, targets, daily, turnovers, counters)


def run(study: Study, sums: DataFrame) -> Backtest:
    plan = plan_of(study)
    targets, counters = all_targets(study, sums, plan)
    return hold(study, plan, targets, counters)


def run_simple(study: Study) -> Backtest:
    """Market-cap and equal-weight strategies only: no solves."""
    plan = plan_of(study)
    windows = investable(study, plan)
    return hold(study, plan, simple_targets(prior_weights(windows, market_caps(study))))

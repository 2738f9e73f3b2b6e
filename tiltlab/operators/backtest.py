"""Walk-forward holdings: schedule, drift, turnover, costs and strategy statistics.

Between rebalances a book's value is a running product of returns, so daily returns and drifted weights
are windows over (strategy, rebalance, ticker); there is no day-by-day loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltlab.operators.stats import bootstrap_ci, max_drawdown
from tiltlab.params import MIN_STRATEGY_DAYS, STRATEGIES, TRADING_DAYS, EvalParams


def schedule(days: DataFrame, start: Column, cov_window: int, every: int) -> DataFrame:
    """One row ``(first, last, every)``; no row if not even one full period fits."""
    return days.agg(F.max("t").alias("last")).select(
        F.greatest(start, F.lit(cov_window)).alias("first"), "last", F.lit(every).alias("every")
    ).where(F.col("first") + F.col("every") <= F.col("last"))


def rebalance_days(plan: DataFrame) -> DataFrame:
    """``(r, next)``: every rebalance before the last day; the final short period is kept."""
    return plan.select(
        F.explode(F.sequence(F.col("first"), F.col("last") - 1, F.col("every"))).alias("r"), "last", "every"
    ).select("r", F.least(F.col("r") + F.col("every"), F.col("last")).alias("next"))


def periods(targets: DataFrame, plan: DataFrame) -> DataFrame:
    """``(r, until)`` of the rebalances that produced targets: a skipped one keeps the old book drifting."""
    done = targets.agg(F.array_sort(F.collect_set("r")).alias("rs"))
    last = plan.select("last").scalar()
    return done.select("rs", F.posexplode("rs").alias("k", "r"), last.alias("last")).select(
        "r", F.coalesce(F.get("rs", F.col("k") + 1), F.col("last")).alias("until")
    )


def drifting_values(targets: DataFrame, returns: DataFrame, held: DataFrame) -> DataFrame:
    """``(strategy, r, ticker, t, value, until)``: each position's value per day, the book being 1 at r.

    A missing return leaves the position unchanged that day.
    """
    path = Window.partitionBy("strategy", "r", "ticker").orderBy("t")
    spread = (
        targets.where("weight != 0")
        .join(F.broadcast(held), "r")
        .withColumn("t", F.explode(F.sequence(F.col("r") + 1, "until")))
    )
    growth = F.product(1.0 + F.coalesce("simple_return", F.lit(0.0))).over(
        path.rowsBetween(Window.unboundedPreceding, 0)
    )
    return spread.join(returns.select("ticker", "t", "simple_return"), ["ticker", "t"], "left").select(
        "strategy", "r", "ticker", "t", (F.col("weight") * growth).alias("value"), "until"
    )


def turnover(targets: DataFrame, values: DataFrame, held: DataFrame) -> DataFrame:
    """``(strategy, r, turnover)``: distance of the new targets from the drifted weights.

    The first build is not turnover: it has no drifted book to compare with.
    """
    book = Window.partitionBy("strategy", "r")
    old = values.where("t = until").select(
        "strategy", F.col("until").alias("r"), "ticker", F.lit(0.0).alias("new"),
        F.try_divide(F.col("value"), F.sum("value").over(book)).alias("old"),
    )
    new = targets.select("strategy", "r", "ticker", F.col("weight").alias("new"), F.lit(0.0).alias("old"))
    return (
        new.unionByName(old.join(F.broadcast(held.select("r")), "r", "left_semi"))
        .groupBy("strategy", "r", "ticker")
        .agg(F.abs(F.sum("new") - F.sum("old")).alias("moved"), F.sum("old").alias("old"))
        .groupBy("strategy", "r")
        .agg(F.sum("moved").alias("turnover"), F.sum("old").alias("old"))
        .where("old > 0")
        .select("strategy", "r", "turnover")
    )


def daily_returns(
    targets: DataFrame, values: DataFrame, turnovers: DataFrame, plan: DataFrame, cost_bps: float
) -> DataFrame:
    """``(strategy, t, idx, gross, net)`` for every day after the first rebalance day; zero before a book exists."""
    path = Window.partitionBy("strategy", "r").orderBy("t")
    built = targets.groupBy("strategy", "r").agg(F.sum("weight").alias("built"))
    book = (
        values.groupBy("strategy", "r", "t")
        .agg(F.sum("value").alias("v"))
        .join(built, ["strategy", "r"])
        .withColumn("before", F.coalesce(F.lag("v").over(path), F.col("built")))
        .select("strategy", "t", (F.try_divide("v", "before") - 1.0).alias("gross"))
    )
    cost = turnovers.select(
        "strategy", (F.col("r") + 1).alias("t"), (F.col("turnover") * cost_bps / 1e4).alias("cost")
    )
    days = plan.select(F.explode(F.sequence(F.col("first") + 1, F.col("last"))).alias("t"), "first")
    strategies = targets.select("strategy").distinct()
    grid = strategies.select(
        "strategy",
        F.inline(
            days.agg(F.collect_list(F.struct("t", (F.col("t") - F.col("first") - 1).alias("idx")))).scalar()
        ),
    )
    return (
        grid.join(book, ["strategy", "t"], "left")
        .join(cost, ["strategy", "t"], "left")
        .select(
            "strategy", "t", "idx",
            F.coalesce("gross", F.lit(0.0)).alias("gross"),
            (F.coalesce("gross", F.lit(0.0)) - F.coalesce("cost", F.lit(0.0))).alias("net"),
        )
    )


def with_active(returns: DataFrame, benchmark: str = STRATEGIES[0]) -> DataFrame:
    """Add ``active``: net return over the benchmark strategy of the same day."""
    same_day = Window.partitionBy("t")
    base = F.max(F.when(F.col("strategy") == benchmark, F.col("net"))).over(same_day)
    return returns.withColumn("active", F.col("net") - base)


def strategy_stats(returns: DataFrame, turnovers: DataFrame, params: EvalParams, with_ci: bool = True) -> DataFrame:
    """One row per strategy: return, risk, drawdown, trading and active statistics."""
    ann = float(TRADING_DAYS)
    active = with_active(returns)
    base = active.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("days"),
        (F.avg("net") * ann).alias("annual_return"),
        (F.stddev_samp("net") * ann**0.5).alias("annual_volatility"),
        (F.avg("active") * ann).alias("active_return"),
        (F.stddev_samp("active") * ann**0.5).alias("tracking_error"),
    ).where(F.col("days") >= MIN_STRATEGY_DAYS)
    traded = turnovers.groupBy("strategy").agg(
        F.avg("turnover").alias("avg_turnover"), F.sum("turnover").alias("total_turnover")
    )
    out = base.join(max_drawdown(returns, ("strategy",), "t", "net"), "strategy").join(
        traded, "strategy", "left"
    )

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.try_divide(a, b)).otherwise(0.0)

    years = F.col("days") / ann
    columns = [
        "strategy",
        "days",
        "annual_return",
        "annual_volatility",
        ratio("annual_return", "annual_volatility").alias("sharpe"),
        "max_drawdown",
        F.coalesce("avg_turnover", F.lit(0.0)).alias("avg_turnover"),
        (F.coalesce("total_turnover", F.lit(0.0)) * params.cost_bps / 1e4 / years).alias("annual_cost"),
        "active_return",
        "tracking_error",
        ratio("active_return", "tracking_error").alias("information_ratio"),
    ]
    if not with_ci:
        return out.select(*columns)
    ci = bootstrap_ci(
        active.select("strategy", "idx", "active"),
        ("strategy",),
        F.avg("active") * ann,
        params.bootstrap_reps,
        params.bootstrap_block,
        params.bootstrap_seed,
    )
    moving = F.col("tracking_error") > 0
    return out.join(ci.drop("draws"), "strategy", "left").select(
        *columns,
        F.when(moving, F.col("ci_low")).otherwise(0.0).alias("ci_low"),
        F.when(moving, F.col("ci_high")).otherwise(0.0).alias("ci_high"),
    )

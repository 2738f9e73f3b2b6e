"""Date-aligned price panels.

Timing: a signal at trading day ``t`` sees headlines dated before ``t`` and filings filed on or before
``t``; it trades at close ``t`` and its forward return runs to close ``t + h``, with ``h`` counted in
trading rows of the benchmark calendar.

The calendar holds one row per trading day, so its size is bounded by days and it may be broadcast
whatever the number of tickers. All windows below run per ticker over at most one row per day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tiltlab.functions.numeric import at_offset
from tiltlab.params import TRADING_DAYS

def by_day() -> WindowSpec:
    """One ticker in trading-day order."""
    return Window.partitionBy("ticker").orderBy("t")


def calendar(bench: DataFrame) -> DataFrame:
    """``(t, date, bench)``: the benchmark's trading days with a dense index from zero."""
    days = bench.agg(F.array_sort(F.collect_list(F.struct("date", F.col("close").alias("bench")))))
    return days.toDF("days").select(F.posexplode("days").alias("t", "day")).select(
        "t", "day.date", "day.bench"
    )


def indexed_prices(prices: DataFrame, days: DataFrame) -> DataFrame:
    """Closes on benchmark days with the day index; a missing close is an absent row."""
    return prices.join(F.broadcast(days), "date").select("ticker", "t", "date", "close", "bench")


def price_panel(prices: DataFrame, days: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """Dense ``ticker x day`` grid with nullable closes."""
    names = (tickers if tickers is not None else prices).select("ticker").distinct()
    row = days.agg(F.collect_list(F.struct("t", "date", "bench"))).scalar()
    grid = names.select("ticker", F.inline(row))
    return grid.join(prices.select("ticker", "date", "close"), ["ticker", "date"], "left").select(
        "ticker", "t", "date", "close", "bench"
    )


def lookback(prices: DataFrame, end: str, days: int) -> DataFrame:
    """Closes of the ``days`` calendar days up to ``end``, which is included; later ones are not seen."""
    last = F.lit(end).cast("date")
    return prices.where((F.col("date") >= F.date_sub(last, days)) & (F.col("date") <= last))


def aligned_log_returns(prices: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Log returns between consecutive dates on which every ticker (of the group) has a close.

    ``prices`` has one row per (group, ticker, date).
    """
    keys = list(group)
    everyone = prices.groupBy(*keys).agg(F.countDistinct("ticker").alias("names"))
    present = prices.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("seen"))
    if keys:
        common = present.join(everyone, keys)
    else:
        common = present.withColumn("names", everyone.scalar())
    common = common.where("seen = names").select(*keys, "date")
    by_date = Window.partitionBy(*keys, "ticker").orderBy("date")
    return (
        prices.join(common, [*keys, "date"], "left_semi")
        .withColumn("ret", F.log(F.col("close") / F.lag("close").over(by_date)))
        .where("ret is not null")
        .select(*keys, "ticker", "date", "ret")
    )


def excess_between(window: WindowSpec, start: int, end: int) -> Column:
    """Market-excess log return from offset ``start`` to offset ``end`` around the current row."""

    def ends(name: str) -> Column:
        first = F.col(name) if start == 0 else at_offset(name, window, start)
        last = F.col(name) if end == 0 else at_offset(name, window, end)
        return F.log(last / first)

    return ends("close") - ends("bench")


def with_returns(panel: DataFrame, vol_window: int | None = None) -> DataFrame:
    """Add ``simple_return``, ``log_return`` and, if asked, ``realized_vol`` (complete windows only)."""
    previous = at_offset("close", by_day(), -1)
    out = panel.withColumn("simple_return", F.col("close") / previous - 1).withColumn(
        "log_return", F.log(F.col("close") / previous)
    )
    if vol_window is None:
        return out
    trailing = by_day().rangeBetween(-(vol_window - 1), 0)
    complete = F.count("log_return").over(trailing) == vol_window
    return out.withColumn(
        "realized_vol",
        F.when(
            complete, F.stddev_samp("log_return").over(trailing) * F.sqrt(F.lit(float(TRADING_DAYS)))
        ),
    )


def trailing_complete(panel: DataFrame, window: int) -> DataFrame:
    """Rows whose last ``window`` log returns are all present: the investable names of each day."""
    trailing = by_day().rangeBetween(-(window - 1), 0)
    return (
        with_returns(panel)
        .withColumn("observed", F.count("log_return").over(trailing))
        .where(F.col("observed") == window)
        .drop("observed")
    )


def forward_excess(horizons: Sequence[int]) -> Column:
    """Array of struct(horizon, forward): market-excess log return from t to t + horizon, null past the end."""
    return F.array(
        *[
            F.struct(
                F.lit(h).cast("int").alias("horizon"), excess_between(by_day(), 0, h).alias("forward")
            )
            for h in horizons
        ]
    )


def next_return() -> Column:
    """Simple return from t to t + 1."""
    return at_offset("close", by_day(), 1) / F.col("close") - 1


def evaluation_bounds(cal: DataFrame, start: str, end: str, warmup_days: int) -> DataFrame:
    """One row ``(t_start, t_end)``: first day at least ``warmup_days`` after start, last day before end."""
    first_day = F.date_add(F.lit(start).cast("date"), warmup_days)
    return cal.agg(
        F.min(F.when(F.col("date") >= first_day, F.col("t"))).alias("t_start"),
        F.coalesce(
            F.max(F.when(F.col("date") < F.lit(end).cast("date"), F.col("t"))), F.max("t")
        ).alias("t_end"),
    )


def split_factor(points: DataFrame, splits: DataFrame, since: str, out: str = "split_factor") -> DataFrame:
    """Product of the split ratios strictly after ``since``; 1 without a date or later splits.

    A ticker has at most one split per trading day, so its splits travel as one short array.
    """
    history = splits.groupBy("ticker").agg(F.collect_list(F.struct("date", "ratio")).alias("_splits"))
    later = F.filter("_splits", lambda s: s["date"] > F.col(since))
    factor = F.aggregate(later, F.lit(1.0), lambda acc, s: acc * s["ratio"])
    return points.join(history, "ticker", "left").withColumn(out, F.coalesce(factor, F.lit(1.0))).drop("_splits")


def market_cap(points: DataFrame, splits: DataFrame) -> DataFrame:
    """Add ``market_cap`` = price x shares x splits after the share date."""
    return split_factor(points, splits, "shares_as_of").withColumn(
        "market_cap", F.col("close") * F.col("shares") * F.col("split_factor")
    )


def cap_weights(rows: DataFrame, keys: Sequence[str], cap: str = "market_cap") -> DataFrame:
    """Add ``market_weight``: cap share if every cap of the group is known, else equal weight."""
    group = Window.partitionBy(*keys)
    known = F.count(cap).over(group) == F.count(F.lit(1)).over(group)
    return rows.withColumn("cap_fallback", ~known).withColumn(
        "market_weight",
        F.when(known, F.col(cap) / F.sum(cap).over(group)).otherwise(
            F.lit(1.0) / F.count(F.lit(1)).over(group)
        ),
    )

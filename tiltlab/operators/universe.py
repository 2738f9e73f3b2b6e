"""Seeded sampling of a small-cap universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltlab.functions.numeric import hashed_uniform
from tiltlab.functions.text import PLAIN_TICKER, share_frame
from tiltlab.session import cut_lineage


def shortest_tickers(ticker_map: DataFrame) -> DataFrame:
    """Per filer the shortest plain ticker, ties alphabetical: skips warrants, units and preferreds."""
    return (
        ticker_map.where(F.col("ticker").rlike(PLAIN_TICKER))
        .groupBy("cik")
        .agg(F.min(F.struct(F.length("ticker").alias("n"), "ticker")).alias("pick"))
        .select("cik", "pick.ticker")
    )


def candidates(frame: DataFrame, ticker_map: DataFrame) -> DataFrame:
    """Filers of a share frame with a plain ticker and a positive count; one per ticker, frame order."""
    filers = frame.where("val > 0").withColumn("cik", F.lpad(F.col("cik").cast("string"), 10, "0"))
    return (
        filers.join(shortest_tickers(ticker_map), "cik")
        .groupBy("ticker")
        .agg(F.min_by(F.struct("cik", "end", "val"), "pos").alias("row"))
        .select("ticker", "row.cik", F.col("row.end").alias("shares_end"), F.col("row.val").alias("shares"))
    )


def cap_on(prices: DataFrame, as_of: Column, tolerance_days: int = 7) -> DataFrame:
    """Per ticker: latest close on or before ``as_of`` if recent, and the closes strictly before it."""
    seen = prices.where(F.col("date") <= as_of).groupBy("ticker").agg(
        F.max("date").alias("last_date"),
        F.max_by("close", "date").alias("close"),
        F.count_if(F.col("date") < as_of).alias("history"),
    )
    return seen.where(F.datediff(as_of, F.col("last_date")) <= tolerance_days)


def screen(
    pool: DataFrame, prices: DataFrame, splits: DataFrame | None, as_of: Column,
    min_cap: float, max_cap: float, min_history: int = 300,
) -> DataFrame:
    """Every candidate with its cap on ``as_of`` and whether it is eligible."""
    priced = pool.join(cap_on(prices, as_of), "ticker", "left")
    cap = F.col("close") * F.col("shares")
    if splits is not None:
        history = splits.groupBy("ticker").agg(F.collect_list(F.struct("date", "ratio")).alias("_splits"))
        later = F.filter("_splits", lambda s: s["date"] > F.col("shares_end"))
        factor = F.aggregate(later, F.lit(1.0), lambda acc, s: acc * s["ratio"])
        priced = priced.join(history, "ticker", "left")
        cap = cap * F.coalesce(factor, F.lit(1.0))
    return priced.withColumn("cap", cap).withColumn(
        "eligible",
        F.coalesce(
            F.col("cap").between(min_cap, max_cap) & (F.col("history") >= min_history), F.lit(False)
        ),
    ).select("ticker", "cik", "cap", "eligible")


def draw(screened: DataFrame, n: int, seed: int) -> DataFrame:
    """The first ``n`` eligible candidates in seeded order with their position.

    The order is a hash of (seed, ticker), so no shuffle of the pool is drawn: each partition keeps its
    own first n and the merge sees n rows per partition. Positions are numbered over the n rows drawn, in one task.
    """
    ordered = screened.where("eligible").withColumn("u", hashed_uniform(F.lit(str(seed)), F.col("ticker")))
    first = ordered.orderBy("u", "ticker").limit(n)
    return first.withColumn(
        "position", F.row_number().over(Window.orderBy("u", "ticker"))
    ).select("position", "ticker", "cap", "u")


def draw_summary(screened: DataFrame, drawn: DataFrame, n: int, seed: int, as_of: Column, min_cap: float | None = None, max_cap: float | None = None) -> DataFrame:
    """One row: candidates, how many were examined before the sample was full, and what was kept; with the cap range if it is given."""
    last = drawn.agg(F.max(F.struct("u", "ticker")).alias("last"), F.count(F.lit(1)).alias("kept"))
    here = F.struct(hashed_uniform(F.lit(str(seed)), F.col("ticker")).alias("u"), F.col("ticker"))
    full = last.select("kept").scalar() == n
    return screened.agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(~full | (here <= last.select("last").scalar())).alias("screened"),
    ).select(
        as_of.alias("as_of"),
        F.lit(seed).alias("seed"),
        share_frame(as_of).alias("share_frame"),
        "candidates",
        "screened",
        last.select("kept").scalar().alias("kept"),
        full.alias("filled"),
        *(F.lit(float(c)).alias(name) for c, name in ((min_cap, "min_cap"), (max_cap, "max_cap")) if c is not None),
    )


def sample(
    frame: DataFrame, ticker_map: DataFrame, prices: DataFrame, splits: DataFrame | None, as_of: Column,
    n: int, seed: int, min_cap: float, max_cap: float, min_history: int = 300,
) -> tuple[DataFrame, DataFrame]:
    """Sampled tickers with caps, and the summary row; ``filled`` is false if too few are eligible."""
    if n < 5:
        raise ValueError("sample at least 5 tickers")
    pool = candidates(frame, ticker_map)
    screened = cut_lineage(screen(pool, prices, splits, as_of, min_cap, max_cap, min_history))
    drawn = cut_lineage(draw(screened, n, seed))
    return drawn, draw_summary(screened, drawn, n, seed, as_of, min_cap, max_cap)

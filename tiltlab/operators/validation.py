"""Range checks of analysis requests: one row per violated rule, named ``field:rule``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltlab.functions.text import ticker_list
from tiltlab.params import MAX_TICKERS

MAX_FINITE = 1.7976931348623157e308
TICKER_SHAPE = r"^[A-Za-z0-9^-]{1,12}$"


def normalized_requests(requests: DataFrame) -> DataFrame:
    """Replace the raw ``tickers`` text by the normalised list."""
    return requests.withColumn("tickers", ticker_list(F.col("tickers")))


def _rules(columns: list[str]) -> list[tuple[Column, str]]:
    def within(name: str, low: float, high: float) -> Column:
        return F.col(name).between(low, high)

    def above(name: str, high: float) -> Column:
        return (F.col(name) > 0) & (F.col(name) <= high)

    names = F.size("tickers")
    ticker_rules = [
        (F.forall("tickers", lambda t: t.rlike(TICKER_SHAPE)), "tickers:shape"),
        (names.between(2, MAX_TICKERS), f"tickers:count in 2..{MAX_TICKERS}"),
    ]
    # The accepted ranges.
    closed = {
        "lookback_days": (60, 1825), "max_headlines": (1, 100), "news_days": (1, 30),
        "sentiment_weight": (0.0, 1.0), "view_scale": (0.0, 2.0),
    }
    positive_up_to = {"budget": MAX_FINITE, "max_weight": 1.0, "risk_aversion": 50.0, "tau": 1.0}
    return [
        *(ticker_rules if "tickers" in columns else []),
        *[(within(name, low, high), f"{name}:in [{low}, {high}]") for name, (low, high) in closed.items() if name in columns],
        *[(above(name, high), f"{name}:in (0, {high}]") for name, high in positive_up_to.items() if name in columns],
    ]


def violations(requests: DataFrame) -> DataFrame:
    """``(run, violation)`` of normalised requests, of the rules for the columns they have; a NaN or NULL violates its rule."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for ok, text in _rules(requests.columns)]
    if not broken:
        return requests.select("run", F.lit("").alias("violation")).where("false")
    return requests.select("run", F.explode(F.array_compact(F.array(*broken))).alias("violation"))


def accepted(requests: DataFrame) -> DataFrame:
    """The requests that violate no rule."""
    return requests.join(violations(requests).select("run").distinct(), "run", "left_anti")

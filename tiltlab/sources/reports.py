"""Report sections out, calibrations back in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltlab.params import BENCHMARK_LARGE, BENCHMARK_SMALL, FUNDAMENTALS, LEVEL

# Layout of a calibration document.
COEFFICIENT = "struct<kappa: double, se: double, t: double, dates: bigint, observations: bigint>"
CALIBRATION_SCHEMA = f"""
generated_at timestamp, horizon_days int, sample_start date, sample_end date, universe array<string>,
min_headlines int, sentiment {COEFFICIENT}, fundamentals {COEFFICIENT}
"""

# Preset universes.
LARGE_CAPS = (
    "AAPL", "MSFT", "NVDA", "GOOGL", "AMZN", "META", "TSLA", "AMD", "INTC", "NFLX", "JPM", "BAC",
    "GS", "XOM", "CVX", "JNJ", "PFE", "UNH", "PG", "KO", "PEP", "WMT", "COST", "DIS",
)
SMALL_CAPS = (
    "CROX", "BOOT", "SHAK", "WING", "ELF", "AEO", "URBN", "PTON", "BYND", "FIGS", "FSLY", "UPST",
    "AI", "PATH", "BB", "RGTI", "AEHR", "SOUN", "HIMS", "NVAX", "RXRX", "TDOC", "GERN", "PLUG",
    "RUN", "FCEL", "LMND", "OPEN", "JOBY", "RIOT", "MARA", "AMC", "FUBO", "GOGO",
)


def preset_universe(spark: SparkSession, name: str) -> DataFrame:
    """``(pos, ticker)`` of a preset universe, ``large`` or ``small``."""
    tickers = {"large": LARGE_CAPS, "small": SMALL_CAPS}[name]
    return spark.createDataFrame(list(enumerate(tickers)), "pos int, ticker string")


def preset_benchmark(name: str) -> str:
    """Ticker of the market proxy that goes with a preset universe."""
    return BENCHMARK_LARGE if name == "large" else BENCHMARK_SMALL


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CALIBRATION_SCHEMA).option("multiLine", True).json(path)


def calibration_document(
    coefficients: DataFrame, sections: DataFrame, days: DataFrame, tickers: DataFrame, horizon: int, min_headlines: int
) -> DataFrame:
    """One row in calibration layout from the estimated coefficients per signal.

    The sample is the span of the sentiment cross-sections; the universe is one short list of names.
    """
    pick = lambda name: F.max(
        F.when(F.col("signal") == name, F.struct("kappa", "se", "t", "dates", "observations"))
    )
    span = (
        sections.where(F.col("signal") == LEVEL).select("t").distinct().join(F.broadcast(days.select("t", "date")), "t")
        .agg(F.min("date").alias("a"), F.max("date").alias("b"))
    )
    names = tickers.agg(F.array_sort(F.collect_set("ticker")).alias("u"))
    return coefficients.agg(pick(LEVEL).alias("sentiment"), pick(FUNDAMENTALS).alias("fundamentals")).select(
        F.current_timestamp().alias("generated_at"),
        F.lit(horizon).alias("horizon_days"),
        span.select("a").scalar().alias("sample_start"),
        span.select("b").scalar().alias("sample_end"),
        names.scalar().alias("universe"),
        F.lit(min_headlines).alias("min_headlines"),
        "sentiment",
        "fundamentals",
    )


def write_sections(sections: dict[str, DataFrame], path: str, fmt: str = "json") -> None:
    """One folder per report section."""
    for name, frame in sections.items():
        frame.write.mode("overwrite").format(fmt).save(f"{path}/{name}")

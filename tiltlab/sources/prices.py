"""Chart documents (JSON) to prices, splits and instruments.

Parsing takes a column of document bodies, wherever they come from; ``read_charts`` fills it from files, one document each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields read from a chart document.
CHART_SCHEMA = """
chart struct<
  result: array<struct<
    meta: struct<currency: string, regularMarketPrice: double, longName: string, shortName: string, gmtoffset: bigint>,
    timestamp: array<bigint>,
    indicators: struct<
      quote: array<struct<close: array<double>>>,
      adjclose: array<struct<adjclose: array<double>>>>,
    events: struct<splits: map<string, struct<date: bigint, numerator: double, denominator: double>>>>>,
  error: string>
"""


def landed(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """``(ticker, body)`` of landed documents, one a file; the file name is the ticker."""
    name = F.regexp_extract(F.input_file_name(), rf"([^/]+?)({suffix})?(\.gz)?$", 1)
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.url_decode(name).alias("ticker"), F.col("value").alias("body"))


def read_charts(spark: SparkSession, path: str) -> DataFrame:
    """``(ticker, c)`` of the landed chart documents."""
    return parse_charts(landed(spark, path, r"\.json"))


def parse_charts(docs: DataFrame) -> DataFrame:
    """``(ticker, c)``: the last chart of each document ``(ticker, body)``; one without a chart has no row (see ``chart_failures``)."""
    parsed = docs.select("ticker", F.from_json("body", CHART_SCHEMA).alias("d"))
    return parsed.select("ticker", F.try_element_at("d.chart.result", F.lit(-1)).alias("c")).where("c IS NOT NULL")


def chart_failures(docs: DataFrame) -> DataFrame:
    """``(ticker, reason)`` of the documents without a chart: what the document says, or that it cannot be read."""
    parsed = docs.select("ticker", F.from_json("body", f"{CHART_SCHEMA}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("d"))
    bad = F.col("d").isNull() | F.col("d._corrupt").isNotNull() | F.col("d.chart").isNull()
    none = F.try_element_at("d.chart.result", F.lit(-1)).isNull()
    reason = F.when(bad, "malformed document").otherwise(F.coalesce("d.chart.error", F.lit("no chart")))
    return parsed.where(bad | none).select("ticker", reason.alias("reason"))


def _day(stamp: Column) -> Column:
    offset = F.coalesce(F.col("c.meta.gmtoffset"), F.lit(0))
    return F.timestamp_seconds(stamp + offset).cast("date")


def chart_prices(charts: DataFrame) -> DataFrame:
    """``(ticker, date, close)``: adjusted closes if the document has the series, else raw closes."""
    adjusted = F.get("c.indicators.adjclose", F.lit(0))["adjclose"]
    series = F.coalesce(adjusted, F.get("c.indicators.quote", F.lit(0))["close"])
    points = charts.select(
        "ticker", "c", F.posexplode(F.arrays_zip(F.col("c.timestamp").alias("ts"), series.alias("close"))).alias("pos", "p")
    )
    valid = F.col("p.ts").isNotNull() & (F.col("p.close") > 0) & ~F.isnan("p.close") & (
        F.col("p.close") < float("inf")
    )
    return (
        points.where(valid)
        .select("ticker", _day(F.col("p.ts")).alias("date"), F.col("p.close").alias("close"), "pos")
        .groupBy("ticker", "date")
        .agg(F.max_by("close", "pos").alias("close"))
    )


def chart_splits(charts: DataFrame) -> DataFrame:
    """``(ticker, date, ratio)`` of the splits with positive terms."""
    listed = charts.select("ticker", "c", F.explode(F.map_values("c.events.splits")).alias("s"))
    return listed.where("s.numerator > 0 and s.denominator > 0").select(
        "ticker", _day(F.col("s.date")).alias("date"), (F.col("s.numerator") / F.col("s.denominator")).alias("ratio")
    )


def instruments(charts: DataFrame) -> DataFrame:
    """``(ticker, name, currency, last_price)``: market price, else the latest close; no close, no row."""
    last = chart_prices(charts).groupBy("ticker").agg(F.max_by("close", "date").alias("_last"))
    described = charts.select(
        "ticker",
        F.coalesce("c.meta.longName", "c.meta.shortName").alias("name"),
        F.col("c.meta.currency").alias("currency"),
        F.col("c.meta.regularMarketPrice").alias("_market"),
    )
    return described.join(last, "ticker").select(
        "ticker", "name", "currency", F.coalesce("_market", "_last").alias("last_price")
    )

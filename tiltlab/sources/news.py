"""Landed news: feed documents (XML) and headline tables (CSV)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltlab.functions.text import (
    dedupe_key,
    decode_entities,
    feed_timestamp,
    has_words,
    normalize_ticker,
    parse_date,
    strip_publisher,
)
from tiltlab.sources.prices import landed

# Accepted header names per column.
CSV_ALIASES = {
    "date": ("date", "published", "datetime", "timestamp"),
    "ticker": ("ticker", "symbol", "stock_symbol", "stock"),
    "title": ("title", "headline", "article_title"),
    "source": ("source", "publisher", "publisher_name"),
}
ITEM_SCHEMA = "title string, link string, pubDate string, source struct<_VALUE: string, _url: string>"
ITEM = r"(?s)<item(?=[\s>]).*?</item\s*>"
HEADLINE_SCHEMA = "ticker string, title string, url string, source string, published timestamp, pos bigint"


def read_feed(spark: SparkSession, path: str, default_source: str) -> DataFrame:
    """Headlines of landed feeds (see ``parse_feeds``); the file name is the ticker. A feed that never landed is empty."""
    try:
        docs = landed(spark, path, r"\.xml|\.rss")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], HEADLINE_SCHEMA)
    return parse_feeds(docs, default_source)


def parse_feeds(docs: DataFrame, default_source: str) -> DataFrame:
    """``(ticker, title, url, source, published, pos)`` of the items of feed documents ``(ticker, body)``; ``pos`` is the item's place.

    Items need a title of three words and a publication date. Each item is parsed by itself, so one that is not well formed
    drops out alone.
    """
    items = docs.select("ticker", F.posexplode(F.regexp_extract_all("body", F.lit(ITEM), F.lit(0))).alias("pos", "xml"))
    items = items.select("ticker", F.col("pos").cast("bigint").alias("pos"), F.from_xml("xml", ITEM_SCHEMA, {"rowTag": "item"}).alias("i"))
    raw = items.select("ticker", "pos", _trimmed("i.title").alias("title"), _trimmed("i.link").alias("link"), "i.pubDate", _trimmed("i.source._VALUE").alias("source"))
    found = raw.select(
        "ticker",
        decode_entities(strip_publisher(F.col("title"), F.col("source"))).alias("title"),
        F.coalesce("link", F.lit("")).alias("url"),
        F.coalesce("source", F.lit(default_source)).alias("source"),
        feed_timestamp(F.col("pubDate")).alias("published"),
        "pos",
    )
    return found.where(F.col("title").isNotNull() & F.col("published").isNotNull() & has_words(F.col("title")))


def _trimmed(name: str) -> Column:
    return F.regexp_replace(name, r"(?U)^\s+|\s+$", "")


def _column(columns: list[str], role: str, required: bool = True) -> str | None:
    found = [c for c in columns if c.strip().lower() in CSV_ALIASES[role]]
    if not found and required:
        raise ValueError(f"CSV needs a {role} column")
    return found[0] if found else None


def read_headline_csv(spark: SparkSession, path: str, wanted: DataFrame | None = None, quoted_breaks: bool = False) -> DataFrame:
    """``(ticker, date, title, source)`` of a headline table with a header row.

    Header names are matched case-insensitively; ragged rows are tolerated; rows without a usable date,
    title or wanted ticker drop out; the first copy of a title per ticker and date stays. With ``quoted_breaks`` quoted
    fields may hold line breaks; each file is then read by one task, otherwise files are split.
    """
    raw = spark.read.csv(path, header=True, mode="PERMISSIVE", multiLine=quoted_breaks, escape='"')
    columns = raw.columns
    source = _column(columns, "source", required=False)
    pick = lambda role: F.col(f"`{_column(columns, role)}`")
    rows = raw.select(
        normalize_ticker(pick("ticker")).alias("ticker"),
        parse_date(pick("date")).alias("date"),
        F.trim(pick("title")).alias("title"),
        (F.coalesce(F.col(f"`{source}`"), F.lit("CSV")) if source else F.lit("CSV")).alias("source"),
        F.monotonically_increasing_id().alias("pos"),
    ).where(F.col("date").isNotNull() & (F.col("title") != ""))
    if wanted is not None:
        rows = rows.join(wanted.select("ticker"), "ticker", "left_semi")
    first = rows.groupBy("ticker", "date", dedupe_key(F.col("title")).alias("_key")).agg(
        F.min_by(F.struct("title", "source"), "pos").alias("row")
    )
    return first.select("ticker", "date", "row.title", "row.source")

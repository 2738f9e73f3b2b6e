"""Filing documents (JSON): ticker map, company facts and share-count frames.

Parsing takes a column of document bodies, wherever they come from; the ``read_`` functions fill it from files, one document each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields read from filing documents.
FACT = "struct<start: date, `end`: date, val: double, form: string, filed: date>"
FACTS_SCHEMA = f"""
cik bigint, entityName string,
facts map<string, map<string, struct<units: map<string, array<{FACT}>>>>>
"""
FRAME_SCHEMA = "data array<struct<cik: bigint, `end`: date, val: double>>"


TICKERS_SCHEMA = "map<string, struct<cik_str: bigint, ticker: string>>"


def filer_id(cik: Column) -> Column:
    """Ten digits."""
    return F.lpad(cik.cast("string"), 10, "0")


def read_ticker_map(spark: SparkSession, path: str) -> DataFrame:
    return parse_ticker_map(spark.read.text(path, wholetext=True).select(F.col("value").alias("body")))


def parse_ticker_map(docs: DataFrame) -> DataFrame:
    """``(ticker, cik)`` of the documents' entries: upper-case ticker, ten-digit filer id."""
    entries = docs.select(F.explode(F.map_values(F.from_json("body", TICKERS_SCHEMA))).alias("e"))
    return entries.select(F.upper("e.ticker").alias("ticker"), filer_id(F.col("e.cik_str")).alias("cik"))


def lookup_filers(names: DataFrame, ticker_map: DataFrame) -> DataFrame:
    """Attach ``cik``; a ticker without a filer keeps its row with NULL."""
    return names.join(ticker_map.select("ticker", "cik"), "ticker", "left")


def landed_filings(spark: SparkSession, path: str) -> DataFrame:
    """``(cik, body)`` of landed documents, one a file; the digits at the end of the file name are the filer, if there are any."""
    name = F.regexp_extract(F.input_file_name(), r"(\d+)\.json(\.gz)?$", 1)
    return spark.read.text(path, wholetext=True).select(F.nullif(name, F.lit("")).alias("cik"), F.col("value").alias("body"))


def read_facts(spark: SparkSession, path: str, wanted: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    return parse_facts(landed_filings(spark, path), wanted)


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    return parse_entities(landed_filings(spark, path))


def _filer() -> Column:
    return filer_id(F.coalesce(F.col("d.cik").cast("string"), F.col("cik"))).alias("cik")


def parse_facts(docs: DataFrame, wanted: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Long ``(cik, taxonomy, tag, unit, pos, start, end, val, form, filed)`` of documents ``(cik, body)``; ``pos`` is the list's order.

    A filer's document holds thousands of tags. With ``wanted`` (tags by taxonomy) its maps are cut to them before anything is
    exploded, so no row is made of the rest.
    """
    facts = F.col("d.facts")
    if wanted is not None:
        facts = F.map_filter(facts, lambda taxonomy, _: taxonomy.isin(list(wanted)))

        def asked(taxonomy: Column, tag: Column) -> Column:
            return reduce(Column.__or__, ((taxonomy == name) & tag.isin(list(tags)) for name, tags in wanted.items()))

        facts = F.transform_values(facts, lambda taxonomy, concepts: F.map_filter(concepts, lambda tag, _: asked(taxonomy, tag)))
    parsed = docs.select("cik", F.from_json("body", FACTS_SCHEMA).alias("d"))
    return (
        parsed.select(_filer(), facts.alias("facts"))
        .select("cik", F.explode("facts").alias("taxonomy", "tags"))
        .select("cik", "taxonomy", F.explode("tags").alias("tag", "concept"))
        .select("cik", "taxonomy", "tag", F.explode("concept.units").alias("unit", "list"))
        .select("cik", "taxonomy", "tag", "unit", F.posexplode("list").alias("pos", "f"))
        .select("cik", "taxonomy", "tag", "unit", "pos", "f.*")
        .where("end is not null and val is not null and form is not null and filed is not null")
    )


def parse_entities(docs: DataFrame) -> DataFrame:
    """``(cik, entity_name)`` of documents ``(cik, body)``."""
    return docs.select("cik", F.from_json("body", FACTS_SCHEMA).alias("d")).select(_filer(), F.col("d.entityName").alias("entity_name"))


def read_share_frame(spark: SparkSession, path: str) -> DataFrame:
    return parse_share_frames(spark.read.text(path, wholetext=True).select(F.col("value").alias("body")))


def parse_share_frames(docs: DataFrame) -> DataFrame:
    """``(cik, end, val, pos)`` of documents ``(body)``, one a frame; ``pos`` is the frame's order. Other columns of ``docs`` stay."""
    others = [c for c in docs.columns if c != "body"]
    entries = docs.select(*others, F.posexplode(F.from_json("body", FRAME_SCHEMA)["data"]).alias("pos", "d"))
    return entries.select(*others, "d.cik", "d.end", "d.val", "pos")

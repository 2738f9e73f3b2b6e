"""Cleaning and matching of headlines, tickers, company names and dates. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that decide matching.
GENERIC_FIRST_WORDS = (
    "american",
    "united",
    "general",
    "first",
    "national",
    "international",
    "global",
    "bank",
    "energy",
    "capital",
    "financial",
    "technologies",
    "systems",
)
LEGAL_SUFFIXES = (
    "incorporated",
    "inc",
    "corporation",
    "corp",
    "company",
    "com",
    "co",
    "ltd",
    "limited",
    "plc",
    "holdings",
    "group",
    "class a",
    "class b",
    "class c",
    "the",
)
TICKER_ALIASES = {
    "GOOGL": ("google", "alphabet"),
    "GOOG": ("google", "alphabet"),
    "META": ("meta", "facebook", "instagram"),
    "BRK-A": ("berkshire", "buffett"),
    "BRK-B": ("berkshire", "buffett"),
    "AMZN": ("amazon", "aws"),
}
ENTITIES = (
    ("&amp;", "&"),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&quot;", '"'),
    ("&lt;", "<"),
    ("&gt;", ">"),
)
ALPHANUMERIC = r"\p{IsAlphabetic}\p{N}"
PLAIN_TICKER = "^[A-Z]{1,5}$"


def normalize_ticker(raw: Column) -> Column:
    return F.translate(F.upper(F.trim(raw)), ".", "-")


def ticker_list(raw: Column) -> Column:
    """Tickers of a comma- or space-separated text, normalised, first occurrence kept."""
    parts = F.transform(F.split(raw, "[, ]"), normalize_ticker)
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def clean_company_name(name: Column) -> Column:
    """Drop punctuation and trailing legal suffixes; capitalise the rest."""
    spaced = F.trim(F.regexp_replace(F.lower(F.translate(name, ",.", "  ")), r"\s+", " "))
    trailing = "(?: (?:" + "|".join(LEGAL_SUFFIXES) + "))+$"
    return F.initcap(F.regexp_replace(spaced, trailing, ""))


def relevance_terms(ticker: Column, name: Column) -> Column:
    """Lower-case terms that mark a headline as being about the company."""
    cleaned = F.lower(clean_company_name(F.coalesce(name, F.lit(""))))
    first = F.element_at(F.split(cleaned, " "), 1)
    usable = (F.octet_length(first) >= 4) & ~first.isin(*GENERIC_FIRST_WORDS)
    entries = [
        c
        for symbol, names in TICKER_ALIASES.items()
        for c in (F.lit(symbol), F.array(*[F.lit(n) for n in names]))
    ]
    aliases = F.coalesce(
        F.try_element_at(F.create_map(*entries), ticker), F.array().cast("array<string>")
    )
    own = F.array_compact(F.array(F.when(usable, first), F.when(cleaned != "", cleaned)))
    return F.concat(own, aliases)


def is_relevant(title: Column, ticker: Column, terms: Column) -> Column:
    """Ticker as a case-sensitive token, a single-word term as a token, or a longer term as a substring."""
    tokens = F.split(title, f"[^{ALPHANUMERIC}-]+")
    lowered = F.lower(title)
    words = F.split(lowered, f"[^{ALPHANUMERIC}]+")
    hit = F.exists(
        terms,
        lambda t: F.when(F.contains(t, F.lit(" ")), F.contains(lowered, t)).otherwise(
            F.array_contains(words, t)
        ),
    )
    return F.array_contains(tokens, ticker) | hit


def dedupe_key(title: Column) -> Column:
    """Letters and digits only, lower case: syndicated copies collapse."""
    return F.lower(F.regexp_replace(title, f"[^{ALPHANUMERIC}]", ""))


def decode_entities(text: Column) -> Column:
    """Named entities decoded one after the other, so double-escaped text decodes twice."""
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def strip_publisher(title: Column, source: Column) -> Column:
    """Remove a trailing publisher name with the separators before it."""
    body = F.substring(title, F.lit(1), F.char_length(title) - F.char_length(source))
    bare = F.regexp_replace(F.regexp_replace(F.rtrim(body), "[-|–]+$", ""), r"\s+$", "")
    return F.when(source.isNotNull() & F.endswith(title, source), bare).otherwise(title)


def has_words(title: Column, least: int = 3) -> Column:
    return F.size(F.filter(F.split(title, r"\s+"), lambda w: w != "")) >= least


# Named zones of RFC 2822.
ZONES = {
    "EST": "-0500",
    "EDT": "-0400",
    "CST": "-0600",
    "CDT": "-0500",
    "MST": "-0700",
    "MDT": "-0600",
    "PST": "-0800",
    "PDT": "-0700",
}


def feed_timestamp(raw: Column) -> Column:
    """Feed publication date (RFC 2822: day name and seconds optional, zone numeric or named) as a timestamp; NULL if malformed."""
    undated = F.regexp_replace(F.trim(raw), "^[A-Za-z]{3}, *", "")
    zoned = F.regexp_replace(undated, "(GMT|UTC|UT|Z)$", "+0000")
    for zone, offset in ZONES.items():
        zoned = F.regexp_replace(zoned, f" {zone}$", f" {offset}")
    timed = F.regexp_replace(zoned, r" (\d{2}:\d{2}) ", " $1:00 ")
    return F.try_to_timestamp(timed, F.lit("d MMM yyyy HH:mm:ss xx"))


def parse_date(raw: Column) -> Column:
    """Calendar date of an ISO date or timestamp text; zoned times are converted to UTC first."""
    text = F.trim(raw)
    # Accepted layouts.
    zoned = F.when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"),
        F.try_to_timestamp(F.replace(F.upper(text), F.lit("T"), F.lit(" "))),
    )
    plain = F.regexp_replace(text, r"([+-]\d{2}):(\d{2})$", "$1$2")
    offset = F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss xx"))
    leading = F.when(
        F.substring(text, 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"),
        F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"),
    )
    return F.coalesce(zoned.cast("date"), offset.cast("date"), leading)


def share_frame(as_of: Column) -> Column:
    """Label of the latest calendar quarter that ended at least 90 days before ``as_of``."""
    cutoff = F.date_sub(as_of, 90)
    # The quarter of the day after the cutoff is the first one not ended by it.
    last_end = F.date_sub(F.trunc(F.date_add(cutoff, 1), "quarter"), 1)
    return F.format_string("CY%dQ%dI", F.year(last_end), F.quarter(last_end))

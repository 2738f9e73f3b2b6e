"""Live and archive headline cleaning: union of feeds, relevance, de-duplication and caps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltlab.functions.text import dedupe_key, is_relevant, relevance_terms
from tiltlab.session import staged


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """All feeds in order; ``feed_rank`` remembers which came first."""
    ranked = [feed.withColumn("feed_rank", F.lit(rank)) for rank, feed in enumerate(feeds)]
    out = ranked[0]
    for feed in ranked[1:]:
        out = out.unionByName(feed, allowMissingColumns=True)
    return out


def recent(headlines: DataFrame, now: Column, max_age_days: int) -> DataFrame:
    return headlines.where(F.col("published") >= F.to_timestamp(now) - F.make_dt_interval(F.lit(max_age_days)))


def relevant(headlines: DataFrame, names: DataFrame, short: int = 100_000, salts: int = 16) -> DataFrame:
    """Headlines about their ticker; ``names`` is ``(ticker, name)`` with one row per ticker.

    The terms are written and counted first. Those of up to ``short`` tickers are broadcast, so titles stay where they are read in
    place of travelling whole to one task a ticker. A longer list meets the titles under ticker and salt: a hot ticker is spread over
    ``salts`` parts, and what follows by ticker alone cannot keep AQE from splitting them further.
    """
    terms = staged(names.select("ticker", relevance_terms(F.col("ticker"), F.col("name")).alias("_terms")))
    if terms.count() <= short:
        found = headlines.join(F.broadcast(terms), "ticker", "left")
    else:
        dealt = headlines.withColumn("_salt", F.pmod(F.xxhash64(*headlines.columns), F.lit(salts)))
        repeated = terms.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
        found = dealt.join(repeated, ["ticker", "_salt"], "left").drop("_salt")
    empty = F.array().cast("array<string>")
    return found.where(is_relevant(F.col("title"), F.col("ticker"), F.coalesce("_terms", empty))).drop("_terms")


def title_digest(title: Column) -> Column:
    """What tells titles apart, in 32 bytes: copies meet under it, however long the title."""
    return F.unhex(F.sha2(dedupe_key(title).cast("binary"), 256))


def first_copies(headlines: DataFrame, keys: tuple[str, ...] = ("ticker",), order: tuple[str, ...] = ("feed_rank", "pos")) -> DataFrame:
    """First copy of every title per key, in feed order. A map-side aggregate: hot titles collapse early."""
    rest = [c for c in headlines.columns if c not in keys]
    return (
        headlines.withColumn("_key", title_digest(F.col("title")))
        .groupBy(*keys, "_key")
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
    )


def newest(headlines: DataFrame, limit: int, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """The ``limit`` newest headlines per key; ties keep feed order.

    ``row_number() <= k`` lets Spark keep only k rows per key before the exchange, so a hot ticker
    never travels whole.
    """
    latest = Window.partitionBy(*keys).orderBy(F.desc("published"), "feed_rank", "pos")
    return headlines.withColumn("_k", F.row_number().over(latest)).where(F.col("_k") <= limit).drop("_k")


def live_headlines(
    headlines: DataFrame, names: DataFrame, now: Column, max_age_days: int = 7, limit: int = 40
) -> DataFrame:
    """Recent, relevant, de-duplicated, newest first. The filters come before the de-duplication: a
    dropped headline must not hide a later copy."""
    return newest(first_copies(relevant(recent(headlines, now, max_age_days), names)), limit)


def week_start(date: Column) -> Column:
    """Monday of the week: the half-open seven-day window the date falls in."""
    return F.trunc(date, "week").cast("date")


def week_windows(start: str, end: str, spark) -> DataFrame:
    """Monday-aligned windows ``[a, b)`` covering ``[start, end)``."""
    first = week_start(F.lit(start).cast("date"))
    last = F.date_sub(F.lit(end).cast("date"), 1)
    return spark.range(1).select(
        F.explode(F.sequence(first, last, F.expr("interval 7 days"))).alias("a")
    ).select(F.col("a").cast("date").alias("a"), F.date_add("a", 7).alias("b"))


def weekly_cap(headlines: DataFrame, per_week: int) -> DataFrame:
    """At most ``per_week`` headlines per (ticker, week) in feed order, no title twice per ticker.

    A title past the cap is never taken, so a later week may still use it: whether a title is taken depends on all earlier weeks of
    its ticker. Titles out of reach are dropped first (see ``_within_reach``), which leaves a ticker at most ``per_week`` x n titles in
    its n-th week, whatever its feed holds. The rest is one ordered pass: each ticker's titles stream through a task by week and
    place, which remembers the titles taken.
    """
    keyed = headlines.withColumn("_key", title_digest(F.col("title"))).withColumn(
        "_week", week_start(F.col("date"))
    )
    rest = [c for c in headlines.columns if c not in ("ticker",)]
    titles = keyed.groupBy("ticker", "_week", "_key").agg(
        F.min_by(F.struct(*rest), "pos").alias("_row"), F.min("pos").alias("_pos")
    )
    ordered = _within_reach(titles, per_week).repartition("ticker").sortWithinPartitions("ticker", "_week", "_pos", "_key")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, seen = None, 0, set()
        for batch in batches:
            kept = []
            for ticker, week, key in zip(*(batch.column(c).to_pylist() for c in ("ticker", "_week", "_key")), strict=True):
                if now is None or ticker != now[0]:
                    seen = set()
                if now != (ticker, week):
                    now, left = (ticker, week), per_week
                kept.append(left > 0 and key not in seen)
                if kept[-1]:
                    left -= 1
                    seen.add(key)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return ordered.mapInArrow(take, ordered.schema).select("ticker", "_row.*")


def _within_reach(titles: DataFrame, per_week: int, salts: int = 32) -> DataFrame:
    """Drop titles that can never be taken: an exact bound, so that a hot week stays small.

    A title is passed over before its week is full only if an earlier week took it, and the weeks before a ticker's n-th take at
    most ``per_week`` x (n - 1) titles; so beyond place ``per_week`` x n nothing is reached. The place is cut in salted parts of the
    week first, then over what they leave.
    """
    number = F.row_number().over(Window.partitionBy("ticker").orderBy("_week"))  # one row a week of each ticker
    weeks = titles.select("ticker", "_week").distinct().withColumn("_reach", number * per_week)
    same = titles["ticker"].eqNullSafe(weeks["ticker"]) & (titles["_week"] == weeks["_week"])
    part = titles.join(weeks, same).select(titles["*"], "_reach").withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(salts)))
    for keys in (("ticker", "_week", "_salt"), ("ticker", "_week")):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("_pos", "_key"))
        part = part.withColumn("_place", place).where(F.col("_place") <= F.col("_reach"))
    return part.drop("_place", "_salt", "_reach")


def archive_headlines(headlines: DataFrame, names: DataFrame, start: str, end: str, per_week: int) -> DataFrame:
    """Dated headlines of the weeks covering ``[start, end)``: relevant, unique and capped per week."""
    a = F.lit(start).cast("date")
    covered = (F.col("date") >= week_start(a)) & (
        week_start(F.col("date")) < F.lit(end).cast("date")
    )
    return weekly_cap(relevant(headlines.where(covered), names), per_week)

"""Point-in-time fundamentals from filed facts.

A fact version is visible from its filing date until the next filing of the same period, and matters
only while its period is recent enough to be used. So instead of joining every fact with every as-of
date, each version is sent to the months of its own visibility interval and met there by equi join;
the work is linear in facts and in as-of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltlab.operators.signals import fundamental_score
from tiltlab.params import (
    ANNUAL_PERIOD_DAYS,
    MAX_ANNUAL_AGE_DAYS,
    MAX_INSTANT_AGE_DAYS,
    PRIOR_YEAR_GAP_DAYS,
)

# Facts read per series, in order of preference.
SERIES_TAGS = {
    "revenue": (
        "RevenueFromContractWithCustomerExcludingAssessedTax",
        "Revenues",
        "RevenueFromContractWithCustomerIncludingAssessedTax",
        "SalesRevenueNet",
    ),
    "income": ("NetIncomeLoss", "ProfitLoss"),
    "debt": ("LongTermDebt", "LongTermDebtNoncurrent", "LongTermDebtAndCapitalLeaseObligations"),
    "equity": (
        "StockholdersEquity",
        "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
    ),
    "shares": ("CommonStockSharesOutstanding", "WeightedAverageNumberOfDilutedSharesOutstanding"),
}
COVER_TAG = "EntityCommonStockSharesOutstanding"
ANNUAL_SERIES = ("revenue", "income")

# A period older than this cannot influence any output: the latest annual period must be younger than
# the annual limit, and the one before it at most the prior-year gap older.
_USEFUL_DAYS = MAX_ANNUAL_AGE_DAYS + PRIOR_YEAR_GAP_DAYS[1]


def filed_by(facts: DataFrame, as_of: Column) -> DataFrame:
    """Facts an investor could have known on ``as_of``."""
    return facts.where(F.col("filed") <= as_of)


def facts_slice(facts: DataFrame, taxonomy: str, tag: str, unit: str) -> DataFrame:
    return facts.where(
        (F.col("taxonomy") == taxonomy) & (F.col("tag") == tag) & (F.col("unit") == unit)
    )


def is_periodic() -> Column:
    form = F.col("form")
    return form.startswith("10-K") | form.startswith("10-Q") | form.startswith("20-F")


def is_annual() -> Column:
    form = F.col("form")
    days = F.datediff("end", "start")
    return (form.startswith("10-K") | form.startswith("20-F")) & days.between(*ANNUAL_PERIOD_DAYS)


def dedupe_by_end(facts: DataFrame, keys=("cik", "tag", "unit")) -> DataFrame:
    """One value per period end: the latest filed, ties to the first in file."""
    return facts.groupBy(*keys, "end").agg(
        F.max_by("val", F.struct("filed", -F.col("pos"))).alias("val"), F.max("filed").alias("filed")
    )


def _tagged(facts: DataFrame) -> DataFrame:
    """Keep the facts some series reads, with series name and tag preference."""
    entries = []
    for series, tags in SERIES_TAGS.items():
        unit = "shares" if series == "shares" else "USD"
        for rank, tag in enumerate(tags):
            entries += [
                F.lit(f"us-gaap/{tag}/{unit}"),
                F.struct(F.lit(series).alias("series"), F.lit(rank).alias("tag_rank")),
            ]
    use = F.try_element_at(F.create_map(*entries), F.concat_ws("/", "taxonomy", "tag", "unit"))
    annual = F.col("_use.series").isin(*ANNUAL_SERIES)
    return (
        facts.withColumn("_use", use)
        .where((annual & is_annual()) | (~annual & is_periodic()))
        .select("cik", "_use.series", "_use.tag_rank", "pos", "end", "val", "filed")
    )


def _until_next(keys: list[str]) -> Column:
    return F.lead("filed").over(Window.partitionBy(*keys).orderBy("filed"))


def _period_versions(facts: DataFrame) -> DataFrame:
    """``(cik, series, tag_rank, end, val, filed, until)``: each version with the date that replaces it."""
    keys = ["cik", "series", "tag_rank", "end"]
    return (
        _tagged(facts)
        .groupBy(*keys, "filed")
        .agg(F.min_by("val", "pos").alias("val"))
        .withColumn("until", _until_next(keys))
    )


def cover_shares(facts: DataFrame) -> DataFrame:
    """Per filing: shares summed over the classes of its latest cover-page date."""
    cover = facts_slice(facts, "dei", COVER_TAG, "shares")
    return (
        cover.groupBy("cik", "filed", "end")
        .agg(F.sum("val").alias("val"))
        .groupBy("cik", "filed")
        .agg(F.max("end").alias("end"), F.max_by("val", "end").alias("val"))
    )


def _meet(versions: DataFrame, as_ofs: DataFrame, last_useful: Column) -> DataFrame:
    """Versions visible at each as-of date, by equi join on (cik, month)."""
    month = lambda d: F.trunc(d, "month").cast("date")
    end = F.least(F.coalesce("until", last_useful), last_useful)
    spread = versions.where(F.col("filed") <= end).withColumn(
        "_month", F.explode(F.sequence(month(F.col("filed")), month(end), F.expr("interval 1 month")))
    )
    visible = (F.col("filed") <= F.col("as_of")) & (
        F.col("until").isNull() | (F.col("as_of") < F.col("until"))
    )
    return spread.join(as_ofs.withColumn("_month", month(F.col("as_of"))), ["cik", "_month"]).where(
        visible
    ).drop("_month")


def visible_periods(facts: DataFrame, as_ofs: DataFrame, useful_days: int | None = None) -> DataFrame:
    """Period values known at each ``(cik, as_of)``, however old, or at most about ``useful_days`` old.

    The limit saves work for readers that ignore older periods; it is applied by the month.
    """
    last = as_ofs.agg(F.max("as_of")).scalar()
    if useful_days is not None:
        last = F.least(last, F.date_add("end", useful_days))
    return _meet(_period_versions(facts), as_ofs, last).select(
        "cik", "as_of", "series", "tag_rank", "end", "val"
    )


def visible_cover(facts: DataFrame, as_ofs: DataFrame) -> DataFrame:
    """The latest cover-page share count known at each ``(cik, as_of)``, if recent."""
    versions = cover_shares(facts).withColumn("until", _until_next(["cik"]))
    met = _meet(versions, as_ofs, F.date_add("end", MAX_INSTANT_AGE_DAYS))
    return met.where("val > 0").select(
        "cik", "as_of", F.struct(F.col("end"), F.col("val")).alias("cover")
    )


def choose_series(periods: DataFrame) -> DataFrame:
    """Per (cik, as_of, series): points of the tag with the latest period end, ties to the preferred tag.

    A tag keeps only its useful periods, a dozen points at most, so they travel as one short array.
    """
    per_tag = periods.groupBy("cik", "as_of", "series", "tag_rank").agg(
        F.array_sort(F.collect_list(F.struct("end", "val"))).alias("points")
    )
    freshness = F.struct(F.element_at("points", -1)["end"], -F.col("tag_rank"))
    return per_tag.groupBy("cik", "as_of", "series").agg(F.max_by("points", freshness).alias("points"))


def _latest(points: Column, as_of: Column, max_age: int) -> Column:
    last = F.element_at(points, -1)
    return F.when((F.size(points) > 0) & (F.datediff(as_of, last["end"]) <= max_age), last)


def _value_at(points: Column, end: Column) -> Column:
    return F.get(F.filter(points, lambda p: p["end"] == end), F.lit(0))["val"]


def _extract(as_ofs: DataFrame, series: DataFrame, cover: DataFrame) -> DataFrame:
    points = series.groupBy("cik", "as_of").pivot("series", list(SERIES_TAGS)).agg(F.first("points"))
    joined = as_ofs.join(points, ["cik", "as_of"], "left").join(cover, ["cik", "as_of"], "left")
    as_of = F.col("as_of")
    latest = joined.select(
        *as_ofs.columns,
        "cover",
        "revenue",
        "income",
        "debt",
        _latest(F.col("revenue"), as_of, MAX_ANNUAL_AGE_DAYS).alias("rev"),
        _latest(F.col("equity"), as_of, MAX_INSTANT_AGE_DAYS).alias("eq"),
        _latest(F.col("shares"), as_of, MAX_INSTANT_AGE_DAYS).alias("gaap_shares"),
    )
    prior = F.element_at(
        F.filter("revenue", lambda p: p["end"] < F.col("rev.end")), F.lit(-1)
    )
    prior = F.when(F.size(F.filter("revenue", lambda p: p["end"] < F.col("rev.end"))) > 0, prior)
    gap = F.datediff(F.col("rev.end"), prior["end"])
    growth = F.when(
        gap.between(*PRIOR_YEAR_GAP_DAYS) & (prior["val"] > 0),
        F.try_divide(F.col("rev.val") - prior["val"], prior["val"]),
    )
    income = _value_at(F.col("income"), F.col("rev.end"))
    margin = F.when(F.col("rev.val") > 0, F.try_divide(income, F.col("rev.val")))
    debt = _value_at(F.col("debt"), F.col("eq.end"))
    leverage = F.when(
        debt.isNotNull(),
        F.when(F.col("eq.val") > 0, F.try_divide(debt, F.col("eq.val"))).otherwise(F.lit(float("inf"))),
    )
    shares = F.coalesce("cover", "gaap_shares")
    return latest.select(
        *as_ofs.columns,
        growth.alias("revenue_growth"),
        margin.alias("net_margin"),
        leverage.alias("debt_to_equity"),
        shares["val"].alias("shares"),
        shares["end"].alias("shares_as_of"),
        F.col("rev.end").alias("fiscal_year_end"),
    )


def fundamentals_as_of(facts: DataFrame, as_ofs: DataFrame) -> DataFrame:
    """Fundamentals exactly as known at each distinct ``(cik, as_of)``: filed on or before that date."""
    series = choose_series(visible_periods(facts, as_ofs.select("cik", "as_of"), _USEFUL_DAYS))
    return _extract(as_ofs, series, visible_cover(facts, as_ofs.select("cik", "as_of")))


def current_fundamentals(facts: DataFrame, as_ofs: DataFrame) -> DataFrame:
    """Fundamentals at ``(cik, as_of)`` from every landed fact, whatever its filing date.

    One as-of row per filer, so the join is on the filer alone.
    """
    keys = ["cik", "series", "tag_rank", "end"]
    periods = (
        _tagged(facts)
        .groupBy(*keys)
        .agg(F.max_by("val", F.struct("filed", -F.col("pos"))).alias("val"))
        .join(as_ofs.select("cik", "as_of"), "cik")
        .where(F.datediff("as_of", "end") <= _USEFUL_DAYS)
    )
    cover = (
        cover_shares(facts)
        .groupBy("cik")
        .agg(F.max_by(F.struct("end", "val"), "filed").alias("cover"))
        .join(as_ofs.select("cik", "as_of"), "cik")
        .where((F.col("cover.val") > 0) & (F.datediff("as_of", "cover.end") <= MAX_INSTANT_AGE_DAYS))
        .select("cik", "as_of", "cover")
    )
    return _extract(as_ofs, choose_series(periods), cover)


def with_score(fundamentals: DataFrame) -> DataFrame:
    """Add nullable ``fscore`` and ``coverage``."""
    scored = fundamentals.withColumn(
        "_f",
        fundamental_score(F.col("revenue_growth"), F.col("net_margin"), F.col("debt_to_equity")),
    )
    return scored.withColumn("fscore", F.col("_f.score")).withColumn("coverage", F.col("_f.coverage")).drop("_f")


def month_starts(cal: DataFrame) -> DataFrame:
    """First trading day of each calendar month, with the following month's first day index.

    The calendar has one row per day, so its single-partition window is bounded.
    """
    days = cal.agg(F.array_sort(F.collect_list(F.struct("t", "date"))).alias("days"))
    changed = F.filter(
        "days",
        lambda d, i: (i == 0)
        | (F.month(d["date"]) != F.month(F.element_at("days", F.greatest(i, F.lit(1)))["date"])),
    )
    starts = days.select(changed.alias("starts"), F.size("days").alias("len"))
    return starts.select("starts", "len", F.posexplode("starts").alias("k", "s")).select(
        F.col("s.date").alias("as_of"),
        F.col("s.t").alias("t_from"),
        F.coalesce(F.get("starts", F.col("k") + 1)["t"], F.col("len")).alias("t_to"),
    )


def fundamental_panel(
    facts: DataFrame, registrants: DataFrame, cal: DataFrame
) -> DataFrame:
    """``(ticker, t, ..)``: fundamentals as of each month's first trading day, carried over its days."""
    starts = month_starts(cal)
    as_ofs = (
        registrants.select("ticker", "cik")
        .withColumn("_m", F.explode(starts.agg(F.collect_list(F.struct("as_of", "t_from", "t_to"))).scalar()))
        .select("ticker", "cik", "_m.as_of", "_m.t_from", "_m.t_to")
    )
    known = with_score(fundamentals_as_of(facts, as_ofs))
    return known.withColumn("t", F.explode(F.sequence(F.col("t_from"), F.col("t_to") - 1))).drop(
        "t_from", "t_to"
    )

"""Studies over the warehouse tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tiltlab.params import EvalParams
from tiltlab.operators.panel import calendar
from tiltlab.plans.study import Study
from tiltlab.session import cut_lineage
from tiltlab.sources import tables


def brand_study(
    spark: SparkSession, root: str, params: EvalParams | None = None, grain: str = "week",
    start: str | None = None, end: str | None = None, with_facts: bool = True,
) -> Study:
    """Brands as tickers, order rows as headlines, nations as filers.

    Bars and the calendar are read by every branch; each is written once after a single pass over the
    raw table, at a size set by brands and dates rather than rows.
    """
    bars = cut_lineage(tables.brand_bars(spark, root, grain))
    return Study(
        params or EvalParams(),
        tables.prices(bars),
        cut_lineage(calendar(tables.benchmark(bars))),
        tables.headlines(spark, root),
        cut_lineage(tables.facts(spark, root)) if with_facts else None,
        tables.registrants(spark, root),
        tables.splits(spark, root),
        start,
        end,
    )

"""The whole evaluation of a study, one DataFrame per report section."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltlab.operators import backtest as B
from tiltlab.operators import longshort, stats
from tiltlab.params import EX_MOMENTUM, LEVEL
from tiltlab.plans import study as S
from tiltlab.plans import walkforward as W
from tiltlab.plans.study import Study
from tiltlab.session import cut_lineage
from tiltlab.sources.reports import calibration_document


def long_short_days(study: Study) -> DataFrame:
    """Evaluated days that have a next trading day."""
    days = study.days.where(study.in_window())
    last = F.least(days.agg(F.max("t")).scalar(), study.days.agg(F.max("t")).scalar())
    return days.where(F.col("t") < last).select("t")


def long_short_books(study: Study, grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leg weights of the level and the ex-momentum signal, and the daily books they make."""
    days = cut_lineage(long_short_days(study))
    rows = S.signal_variants(grid, (LEVEL, EX_MOMENTUM)).join(F.broadcast(days), "t", "left_semi")
    weights = cut_lineage(longshort.leg_weights(rows, study.params.leg_fraction))
    return weights, longshort.daily_book(weights, days)


def evaluate(study: Study) -> dict[str, DataFrame]:
    """Coverage, information coefficients, long-short, calibration and backtest of a study.

    The signal grid is written once; every section starts from it.
    """
    grid = S.signal_grid(study)
    variants = S.signal_variants(grid)
    sections = cut_lineage(S.calibration_sections(study, variants))
    sums = cut_lineage(stats.date_sums(sections, ("signal",)))
    coefficients = stats.pooled_slope(sums, ("signal",), study.params.calibration_lags)
    _, book = long_short_books(study, grid)
    bt = W.run(study, sums)
    returns = cut_lineage(bt.returns)
    return {
        "coverage": S.coverage(study),
        "headlines": S.headlines_per_ticker(study),
        "ic": S.ic_table(study, variants),
        "long_short": longshort.summary(cut_lineage(book), study.params.leg_fraction),
        "calibration": calibration_document(
            coefficients, sections, study.days, study.prices, study.params.calibration_horizon, study.params.min_headlines
        ),
        "strategies": B.strategy_stats(returns, bt.turnovers, study.params),
        "returns": returns.join(F.broadcast(study.days.select("t", "date")), "t"),
        "turnover": bt.turnovers,
        "backtest": bt.counters,
    }


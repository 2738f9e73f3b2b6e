"""Shrunk covariance, correlation, implied returns and portfolio statistics for many groups at once.

A group is one portfolio's estimation window (run x rebalance date). Its matrix has names^2 entries,
which is the result itself; window lengths bound the arrays carried per name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiltlab.params import MIN_COVARIANCE_ROWS, TRADING_DAYS

TILE = 64  # names of a strip; a tile is two strips


def _vectors(returns: DataFrame, group: str) -> DataFrame:
    """One row per (group, ticker): the column-demeaned return vector in date order."""
    raw = F.transform(F.array_sort(F.collect_list(F.struct("date", "ret"))), lambda p: p["ret"])
    out = returns.groupBy(group, "ticker").agg(raw.alias("_raw"), F.avg("ret").alias("_mean"))
    return out.select(group, "ticker", F.transform("_raw", lambda v: v - F.col("_mean")).alias("x")).where(
        F.size("x") >= MIN_COVARIANCE_ROWS
    )


def _pairs(vectors: DataFrame, group: str, tile: int = TILE) -> DataFrame:
    """Sample covariances ``(group, i, j, s)`` for i <= j, as a tiled matrix product.

    A group's names are dealt to as many strips as it needs of about ``tile`` names; each pair of strips is a tile, so the number of
    tiles grows with names squared and a tile's rows and result stay bounded. A name's vector goes to the tiles of its strip.
    """
    strips = vectors.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("_strips"))
    dealt = vectors.join(strips, group).withColumn("_own", F.pmod(F.xxhash64("ticker"), F.col("_strips")).cast("int"))
    tiled = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_strips") - 1))).select(
        group, "ticker", "x", F.least("_own", "_with").alias("_low"), F.greatest("_own", "_with").alias("_high"), (F.col("_own") > F.col("_with")).alias("_right")
    )
    schema = f"{group} {vectors.schema[group].dataType.simpleString()}, i string, j string, s double"

    def product(table: pa.Table) -> pa.Table:
        names = table.column("ticker").to_numpy()
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(len(names), -1)
        right = table.column("_right").to_numpy(zero_copy_only=False)
        across = table.column("_low")[0] != table.column("_high")[0]
        rows, columns = (np.flatnonzero(~right), np.flatnonzero(right)) if across else (np.arange(len(names)),) * 2
        s = (x[rows] @ x[columns].T / x.shape[1]).ravel()
        i, j = np.repeat(names[rows], len(columns)), np.tile(names[columns], len(rows))
        swapped = i > j
        i, j = np.where(swapped, j, i), np.where(swapped, i, j)
        if not across:  # each pair once
            s, i, j = s[~swapped], i[~swapped], j[~swapped]
        kind = table.schema.field(group).type
        return pa.table({group: pa.array([table.column(group)[0].as_py()] * len(s), kind), "i": pa.array(i, pa.string()), "j": pa.array(j, pa.string()), "s": s})

    return tiled.groupBy(group, "_low", "_high").applyInArrow(product, schema)


def trailing_windows(returns: DataFrame, schedule: DataFrame, window: int) -> DataFrame:
    """Complete trailing windows ``(r, ticker, date, ret)`` at every rebalance day ``r``.

    ``returns`` is ``(ticker, t, ret)``; ``schedule`` is one row ``(first, last, every)``. A return is sent
    straight to the rebalances whose window holds it, computed from the schedule's step. Names with a gap
    in the window drop out.
    """
    first, every = schedule.select("first").scalar(), schedule.select("every").scalar()
    last = schedule.select("last").scalar()
    low = F.greatest(F.ceil((F.col("t") - first) / every), F.lit(0))
    high = F.least(
        F.floor((F.col("t") + (window - 1) - first) / every), F.floor((last - 1 - first) / every)
    )
    sent = (
        returns.where("ret is not null")
        .select("ticker", F.col("t").alias("date"), "ret", low.alias("_low"), high.alias("_high"), first.alias("_first"), every.alias("_every"))
        .where("_low <= _high")
        .withColumn("_k", F.explode(F.sequence("_low", "_high")))
        .withColumn("r", (F.col("_first") + F.col("_k") * F.col("_every")).cast("int"))
    )
    complete = F.count(F.lit(1)).over(Window.partitionBy("r", "ticker")) == window
    return sent.select("r", "ticker", "date", "ret", complete.alias("_ok")).where("_ok").drop("_ok")


def covariance(returns: DataFrame, group: str, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Annualised covariance ``(group, i, j, value)`` and ``(group, shrinkage, observations, names)``.

    ``returns`` is ``(group, date, ticker, ret)`` on dates every name of the group has. Shrinks towards
    the scaled identity; the intensity needs only norms: the squared distance to the target from
    ||S||^2 and the trace, the sampling error from the sum over days of |x_k|^4.
    """
    vectors = _vectors(returns, group)
    pairs = _pairs(vectors, group, tile)
    day_norms = (
        vectors.select(group, F.posexplode("x").alias("k", "v"))
        .groupBy(group, "k")
        .agg(F.sum(F.col("v") * F.col("v")).alias("q"))
        .groupBy(group)
        .agg(F.sum(F.col("q") * F.col("q")).alias("q4"), F.count(F.lit(1)).alias("observations"))
    )
    diagonal = F.col("i") == F.col("j")
    squares = F.when(diagonal, 1.0).otherwise(2.0) * F.col("s") * F.col("s")
    norms = pairs.groupBy(group).agg(
        F.sum(squares).alias("s2"),
        F.sum(F.when(diagonal, F.col("s")).otherwise(0.0)).alias("trace"),
        F.count_if(diagonal).alias("names"),
    )
    n, t = F.col("names"), F.col("observations")
    distance = (F.col("s2") - F.col("trace") * F.col("trace") / n) / n
    error = (F.col("q4") - t * F.col("s2")) / (n.cast("double") * t * t)
    scalars = (
        norms.join(day_norms, group)
        .withColumn("d2", F.greatest(distance, F.lit(0.0)))
        .withColumn("b2", F.least(F.greatest(error, F.lit(0.0)), F.col("d2")))
        .select(
            group,
            F.when(F.col("d2") > 0, F.try_divide("b2", "d2")).otherwise(1.0).alias("shrinkage"),
            "observations",
            "names",
            (F.col("trace") / n).alias("target"),
        )
    )
    keep = 1.0 - F.col("shrinkage")
    shrunk = pairs.join(scalars, group).withColumn(
        "value",
        (F.when(diagonal, F.col("shrinkage") * F.col("target")).otherwise(0.0) + keep * F.col("s"))
        * float(TRADING_DAYS),
    )
    both = F.when(diagonal, F.array(F.struct("i", "j"))).otherwise(
        F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    )
    full = shrunk.select(group, F.explode(both).alias("_p"), "value").select(
        group, "_p.i", "_p.j", "value"
    )
    return full, scalars.drop("target")


def volatilities(cov: DataFrame, group: str) -> DataFrame:
    return cov.where("i = j").select(
        group, F.col("i").alias("ticker"), F.sqrt(F.greatest("value", F.lit(0.0))).alias("volatility")
    )


def correlation(cov: DataFrame, group: str) -> DataFrame:
    """Correlations from covariances; NULL where a volatility is zero."""
    vol = volatilities(cov, group)
    vi = vol.select(group, F.col("ticker").alias("i"), F.col("volatility").alias("vi"))
    vj = vol.select(group, F.col("ticker").alias("j"), F.col("volatility").alias("vj"))
    return (
        cov.join(vi, [group, "i"])
        .join(vj, [group, "j"])
        .select(group, "i", "j", F.try_divide("value", F.col("vi") * F.col("vj")).alias("correlation"))
    )


def implied_returns(cov: DataFrame, weights: DataFrame, group: str, risk_aversion: float) -> DataFrame:
    """Equilibrium returns: risk aversion x covariance x market weights, per (group, ticker)."""
    held = weights.select(group, F.col("ticker").alias("j"), F.col("weight").alias("w"))
    return (
        cov.join(held, [group, "j"])
        .groupBy(group, F.col("i").alias("ticker"))
        .agg((F.sum(F.col("value") * F.col("w")) * risk_aversion).alias("pi"))
    )


def portfolio_stats(weights: DataFrame, mu: DataFrame, cov: DataFrame, group: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Expected return, volatility and their ratio per (group, keys); ``weights`` has a ``weight`` column."""
    held = weights.select(group, *keys, "ticker", "weight")
    ret = held.join(mu.select(group, "ticker", "mu"), [group, "ticker"]).groupBy(group, *keys).agg(
        F.sum(F.col("weight") * F.col("mu")).alias("expected_return")
    )
    left = held.withColumnRenamed("ticker", "i").withColumnRenamed("weight", "wi")
    marginal = (
        cov.join(held.select(group, *keys, F.col("ticker").alias("j"), F.col("weight").alias("wj")), [group, "j"])
        .groupBy(group, *keys, "i")
        .agg(F.sum(F.col("value") * F.col("wj")).alias("m"))
    )
    var = left.join(marginal, [group, *keys, "i"]).groupBy(group, *keys).agg(
        F.sqrt(F.greatest(F.sum(F.col("wi") * F.col("m")), F.lit(0.0))).alias("volatility")
    )
    return ret.join(var, [group, *keys]).withColumn(
        "sharpe",
        F.when(F.col("volatility") > 0, F.try_divide("expected_return", "volatility")).otherwise(0.0),
    )


def matrix_rows(cov: DataFrame, group: str) -> DataFrame:
    """Covariance as one row per (group, ticker) with the row in ticker order, for the grouped solves."""
    row = F.transform(F.array_sort(F.collect_list(F.struct("j", "value"))), lambda p: p["value"])
    return cov.groupBy(group, F.col("i").alias("ticker")).agg(row.alias("sigma"))



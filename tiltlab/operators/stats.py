"""Autocorrelation-robust statistics over series and panels.

Series here have one row per date, so a window over one series is bounded by the calendar. Panels are
reduced to per-date sums by map-side aggregates before any window runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltlab.functions.numeric import average_rank, hashed_uniform, total
from tiltlab.params import MIN_IC_DATES, MIN_NAMES


def bartlett_history(value: Column, series: Window, lags: Column, max_lags: int) -> Column:
    """Sum over l of (1 - l / (lags + 1)) * value at l positions before; ``lags`` may vary by row."""
    history = F.collect_list(value).over(series.rowsBetween(-max_lags, -1))
    kernel = lambda v, i: v * F.greatest(
        1.0 - (F.size(history) - i) / (lags + F.lit(1.0)), F.lit(0.0)
    )
    return total(F.transform(history, kernel))


def hac_mean(
    series: DataFrame, keys: Sequence[str], order: str, value: str, lags: Column, max_lags: int,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Per series: ``n``, ``mean``, Bartlett ``long_run_variance``, ``se`` and ``t`` of the mean.

    Lags are positions in the rows given, so callers drop thin dates first. The autocovariances are one
    ordered window, not a lag self-join.
    """
    whole = Window.partitionBy(*keys)
    centred = series.withColumn("_d", F.col(value) - F.avg(value).over(whole)).withColumn("_lags", lags)
    if max_lags > 0:
        past = bartlett_history(F.col("_d"), whole.orderBy(order), F.col("_lags"), max_lags)
    else:
        past = F.lit(0.0)
    centred = centred.withColumn("_term", F.col("_d") * F.col("_d") + 2.0 * F.col("_d") * past)
    out = centred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean"),
        (F.greatest(F.sum("_term"), F.lit(0.0)) / F.count(F.lit(1))).alias("long_run_variance"),
        *extra,
    )
    se = F.sqrt(F.col("long_run_variance") / F.col("n"))
    return out.withColumn("se", se).withColumn(
        "t", F.when(F.col("se") > 0, F.try_divide(F.col("mean"), F.col("se"))).otherwise(0.0)
    )


def spearman_by(pairs: DataFrame, keys: Sequence[str], x: str, y: str, min_names: int = MIN_NAMES) -> DataFrame:
    """Rank correlation per key over at least ``min_names`` pairs; undefined ones are dropped.

    Ranks, counts and the correlation share one shuffle on ``keys``. Ranks are centred on their known
    mean, so all sums are exact and a zero correlation is exactly zero whatever the summation order.
    """
    centre = (F.count(F.lit(1)).over(Window.partitionBy(*keys)) + 1) / F.lit(2.0)
    ranked = pairs.select(
        *keys,
        (average_rank(x, *keys) - centre).alias("_rx"),
        (average_rank(y, *keys) - centre).alias("_ry"),
    )
    product = lambda a, b: F.sum(F.col(a) * F.col(b))
    spread = F.sqrt(product("_rx", "_rx") * product("_ry", "_ry"))
    return (
        ranked.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("names"),
            F.when(spread > 0, F.try_divide(product("_rx", "_ry"), spread)).alias("ic"),
        )
        .where((F.col("names") >= min_names) & F.col("ic").isNotNull())
    )


def ic_summary(by_date: DataFrame, keys: Sequence[str], lags: Column, max_lags: int) -> DataFrame:
    """Mean information coefficient with HAC error, hit rate and average breadth per key."""
    return hac_mean(
        by_date,
        keys,
        "t",
        "ic",
        lags,
        max_lags,
        extra=(
            F.avg(F.when(F.col("ic") > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
            F.avg("names").alias("avg_names"),
        ),
    ).where(F.col("n") >= MIN_IC_DATES)


def date_sums(sections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per date: ``sxx``, ``sxy`` of the demeaned cross-section, and its size."""
    size = F.count(F.lit(1))
    return (
        sections.groupBy(*keys, "t")
        .agg(
            (F.var_pop("x") * size).alias("sxx"),
            (F.covar_pop("x", "y") * size).alias("sxy"),
            size.alias("names"),
        )
        .where(F.col("names") >= MIN_NAMES)
    )


def pooled_slope(sums: DataFrame, keys: Sequence[str], lags: int) -> DataFrame:
    """No-intercept slope of y on x over all dates with Driscoll-Kraay error: ``kappa, se, t``."""
    whole = Window.partitionBy(*keys)
    scored = (
        sums.withColumn("_sxx", F.sum("sxx").over(whole))
        .withColumn("kappa", F.try_divide(F.sum("sxy").over(whole), F.col("_sxx")))
        .withColumn("u", F.col("sxy") - F.col("kappa") * F.col("sxx"))
    )
    out = hac_mean(
        scored, keys, "t", "u", F.lit(lags), lags,
        extra=(
            F.max("kappa").alias("kappa"),
            F.max("_sxx").alias("sxx"),
            F.sum("names").alias("observations"),
        ),
    )
    se = F.sqrt(F.col("long_run_variance") * F.col("n")) / F.col("sxx")
    return (
        out.where((F.col("sxx") > 0) & (F.col("n") >= 2))
        .withColumn("se", se)
        .select(
            *keys,
            "kappa",
            "se",
            F.when(F.col("se") > 0, F.try_divide(F.col("kappa"), F.col("se"))).otherwise(0.0).alias("t"),
            F.col("n").alias("dates"),
            "observations",
        )
    )


def slope_as_of(sums: DataFrame, rebalances: DataFrame, keys: Sequence[str], horizon: int, lags: int) -> DataFrame:
    """The pooled slope at every rebalance ``r`` from the dates whose forward window closed by ``r``.

    The slope's scores u = sxy - kappa * sxx sum to zero, so every autocovariance is a quadratic in
    kappa whose coefficients accumulate over dates. Running sums therefore answer all rebalances in one
    pass; nothing joins dates with rebalances.
    """
    series = Window.partitionBy(*keys).orderBy("t")
    lag = F.lit(lags)
    x, y = F.col("sxx"), F.col("sxy")
    px = bartlett_history(x, series, lag, lags) if lags else F.lit(0.0)
    py = bartlett_history(y, series, lag, lags) if lags else F.lit(0.0)
    terms = (
        sums.withColumn("_px", px)
        .withColumn("_py", py)
        .select(
            *keys,
            (F.col("t") + horizon).alias("at"),
            x.alias("sxx"),
            y.alias("sxy"),
            F.col("names").cast("bigint").alias("names"),
            (y * y + 2.0 * y * F.col("_py")).alias("yy"),
            (2.0 * x * y + 2.0 * (y * F.col("_px") + x * F.col("_py"))).alias("xy"),
            (x * x + 2.0 * x * F.col("_px")).alias("xx"),
            F.lit(1).cast("bigint").alias("one"),
            F.lit(None).cast("int").alias("r"),
        )
    )
    questions = (
        sums.select(*keys).distinct()
        .withColumn("r", F.explode(rebalances.agg(F.collect_set("r")).scalar()))
        .withColumn("at", F.col("r"))
    )
    upto = Window.partitionBy(*keys).orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    running = terms.unionByName(questions, allowMissingColumns=True)
    for name in ("sxx", "sxy", "names", "yy", "xy", "xx", "one"):
        running = running.withColumn(f"c_{name}", F.sum(name).over(upto))
    kappa = F.try_divide(F.col("c_sxy"), F.col("c_sxx"))
    answered = (
        running.where("r is not null and c_one >= 2 and c_sxx > 0")
        .withColumn("kappa", kappa)
        .withColumn(
            "scores",
            F.col("c_yy") - F.col("kappa") * F.col("c_xy") + F.col("kappa") * F.col("kappa") * F.col("c_xx"),
        )
        .withColumn("se", F.sqrt(F.greatest("scores", F.lit(0.0))) / F.col("c_sxx"))
    )
    return answered.select(
        *keys,
        "r",
        "kappa",
        "se",
        F.when(F.col("se") > 0, F.try_divide(F.col("kappa"), F.col("se"))).otherwise(0.0).alias("t"),
        F.col("c_one").alias("dates"),
        F.col("c_names").alias("observations"),
    )


def max_drawdown(returns: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Worst fall of compounded equity below its running peak, the peak starting at one."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    equity = returns.withColumn("_equity", F.product(1.0 + F.col(value)).over(upto))
    peak = F.greatest(F.max("_equity").over(upto), F.lit(1.0))
    return (
        equity.withColumn("_fall", F.col("_equity") / peak - 1.0)
        .groupBy(*keys)
        .agg(F.least(F.min("_fall"), F.lit(0.0)).alias("max_drawdown"))
    )


def bootstrap_paths(lengths: DataFrame, reps: int, block: float, seed: int) -> DataFrame:
    """Stationary-bootstrap index paths ``(len, rep, i, idx)`` for each row of ``lengths(len)``, with geometric blocks and wrap-around.

    Uniforms are hashed from (seed, rep, i): a lost task recomputes the same path, and replicates
    spread over the cluster.
    """
    replicates = F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")
    grid = lengths.where("len > 0").select("len", replicates).repartition("len", "rep")
    grid = grid.select("rep", "len", F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("i"))
    seed_col = F.lit(str(seed))
    draw = hashed_uniform(seed_col, F.col("rep"), F.col("i"), F.lit("break"))
    start = F.floor(hashed_uniform(seed_col, F.col("rep"), F.col("i"), F.lit("start")) * F.col("len"))
    breaks = (F.col("i") == 0) | (draw < 1.0 / max(block, 1.0))
    path = Window.partitionBy("len", "rep").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return (
        grid.withColumn("_from", F.when(breaks, F.struct(start.alias("s"), F.col("i").alias("at"))))
        .withColumn("_from", F.last("_from", ignorenulls=True).over(path))
        .select(
            "len", "rep", "i", ((F.col("_from.s") + F.col("i") - F.col("_from.at")) % F.col("len")).cast("int").alias("idx")
        )
    )


def bootstrap_ci(
    series: DataFrame, keys: Sequence[str], statistic: Column,
    reps: int = 2000, block: float = 10.0, seed: int = 42,
) -> DataFrame:
    """2.5% and 97.5% nearest-rank percentiles of ``statistic`` over resampled series.

    ``series`` has rows ``(keys, idx, ...)`` with a dense ``idx`` from 0; ``statistic`` is any Spark aggregate
    over its columns. Each key is resampled at its own length; keys of one length share their paths.
    """
    lengths = series.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("len"))
    paths = bootstrap_paths(lengths.select("len").distinct(), reps, block, seed)
    draws = (
        paths.join(series.join(lengths, list(keys)), ["len", "idx"])
        .groupBy(*keys, "rep")
        .agg(statistic.alias("draw"))
        .where("draw is not null and not isnan(draw) and abs(draw) < double('infinity')")
    )
    group = Window.partitionBy(*keys)
    ranked = draws.withColumn("_k", F.row_number().over(group.orderBy("draw", "rep")) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(group)
    )
    pick = lambda q: F.max(
        F.when(F.col("_k") == F.round((F.col("_n") - 1) * F.lit(q)).cast("int"), F.col("draw"))
    )
    return ranked.groupBy(*keys).agg(
        pick(0.025).alias("ci_low"), pick(0.975).alias("ci_high"), F.count(F.lit(1)).alias("draws")
    )

"""The cross-section analysis: what to hold now, for many runs in one job.

A run is one request (a set of tickers and its settings); every table carries ``run``, so a thousand requests are the same
number of stages as one. Settings are a table of one row a run (``settings_of``) that is joined to whatever they bear on; requests that
violate a rule leave before anything is read for them, and the rule becomes a warning of their run.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltlab.operators import panel as P
from tiltlab.operators import portfolio, risk, sentiment, signals, validation, views
from tiltlab.params import AnalysisParams
from tiltlab.session import cut_lineage


@dataclass(frozen=True)
class AnalysisInputs:
    """``assets(run, ticker, name, currency, price, shares, shares_as_of, fscore, coverage)``,
    ``prices(run, ticker, date, close)``, scored ``headlines(ticker, title, published, ..)`` without copies, as
    ``operators.headlines.first_copies`` leaves them, ``splits(ticker, date, ratio)``, and optionally one row of calibrated coefficients
    ``calibration(c_news, c_facts, min_headlines)``. Each run sees the prices of its lookback, and its tickers' newest headlines within
    its news days and up to its number of them."""

    assets: DataFrame
    prices: DataFrame
    headlines: DataFrame
    splits: DataFrame
    now: Column
    calibration: DataFrame | None = None


@dataclass(frozen=True)
class Report:
    assets: DataFrame
    portfolio: DataFrame
    benchmarks: DataFrame
    risk: DataFrame
    correlation: DataFrame
    warnings: DataFrame

    def sections(self) -> dict[str, DataFrame]:
        """The report as ``sources.reports.write_sections`` takes it; assets in the report's order."""
        return {
            "assets": self.assets.orderBy("run", "position"), "portfolio": self.portfolio, "benchmarks": self.benchmarks,
            "risk": self.risk, "correlation": self.correlation, "warnings": self.warnings,
        }


Settings = AnalysisParams | DataFrame
"""One setting for all runs, or requests ``(run, ..)`` with any of the ``KNOBS``, and ``tickers`` if a run is to see only these."""
KNOBS = {
    "budget": "double", "max_weight": "double", "lookback_days": "int", "news_days": "int", "max_headlines": "int", "risk_aversion": "double",
    "tau": "double", "view_scale": "double", "sentiment_weight": "double", "heuristic_views": "boolean",
}


def settings_of(inputs: AnalysisInputs, params: Settings) -> DataFrame:
    """One row a run with every knob: the accepted requests, or ``params`` for all runs. A knob not given has its default."""
    if isinstance(params, AnalysisParams):
        rows, given = inputs.assets.select("run").distinct(), {}
    else:
        rows, given, params = validation.accepted(params), set(params.columns), AnalysisParams()
    knobs = [(F.col(k) if k in given else F.lit(getattr(params, k))).cast(kind).alias(k) for k, kind in KNOBS.items()]
    return rows.select("run", *knobs, *(c for c in ("tickers",) if c in given))


def _asked(inputs: AnalysisInputs, knobs: DataFrame) -> AnalysisInputs:
    """The inputs as the accepted runs see them."""
    assets = inputs.assets.join(knobs.select("run", *(c for c in ("tickers",) if c in knobs.columns)), "run")
    if "tickers" in knobs.columns:
        assets = assets.where(F.array_contains("tickers", F.col("ticker"))).drop("tickers")
    held = inputs.prices.join(knobs.select("run", "lookback_days"), "run").where(
        F.col("date").between(F.date_sub(F.to_date(inputs.now), F.col("lookback_days")), F.to_date(inputs.now))
    )
    limits = assets.select("run", "ticker").join(knobs.select("run", "news_days", "max_headlines"), "run")
    recent = F.col("published") >= F.to_timestamp(inputs.now) - F.make_dt_interval(F.col("news_days"))
    seen = inputs.headlines.join(limits, "ticker").where(recent)
    ties = [c for c in ("feed_rank", "pos") if c in inputs.headlines.columns] or ["title"]
    latest = P.Window.partitionBy("run", "ticker").orderBy(F.desc("published"), *ties)
    seen = seen.withColumn("_k", F.row_number().over(latest)).where(F.col("_k") <= F.col("max_headlines"))
    return replace(inputs, assets=assets, prices=held.drop("lookback_days"), headlines=seen.drop("_k", "news_days", "max_headlines"))


def _histories(inputs: AnalysisInputs) -> DataFrame:
    """``(run, ticker)`` with at least two closes, without which there is no return."""
    closes = inputs.prices.where("close is not null").groupBy("run", "ticker").agg(F.count(F.lit(1)).alias("_closes"))
    return closes.where("_closes >= 2").select("run", "ticker")


def settled_assets(inputs: AnalysisInputs) -> DataFrame:
    """The assets that a run is about: priced and with history, in runs that have two of them at least.

    Prior weights, covariances and everything after use these and no others.
    """
    kept = inputs.assets.where("price is not null").join(_histories(inputs), ["run", "ticker"], "left_semi")
    names = F.count(F.lit(1)).over(P.Window.partitionBy("run"))
    return kept.withColumn("_names", names).where("_names >= 2").drop("_names")


def prior_assets(inputs: AnalysisInputs) -> DataFrame:
    """Settled assets with market cap and prior weight; a run falls back to equal weights if any cap is unknown."""
    capped = P.market_cap(settled_assets(inputs).withColumn("close", F.col("price")), inputs.splits)
    return P.cap_weights(capped.drop("close"), ("run",))


def _signals(inputs: AnalysisInputs, assets: DataFrame) -> DataFrame:
    summary = sentiment.live_summary(inputs.headlines, inputs.now, assets.select("run", "ticker"), ("run", "ticker"))
    blended = signals.combine(
        F.col("score"), F.col("confidence"), F.col("fscore"), F.col("coverage"), F.col("sentiment_weight")
    )
    return (
        assets.join(summary.withColumnRenamed("confidence", "news_confidence"), ["run", "ticker"])
        .withColumn("confidence", F.col("news_confidence"))
        .withColumn("_s", blended)
        .withColumn("value", F.col("_s.value"))
        .withColumn("confidence", F.col("_s.confidence"))
        .drop("_s")
    )


def _with_views(inputs: AnalysisInputs, rows: DataFrame, params: Settings) -> DataFrame:
    tau = F.col("tau")
    heuristic = views.heuristic_views(rows, tau, F.col("view_scale")).withColumn("view_mode", F.lit("heuristic"))
    if inputs.calibration is None or (isinstance(params, AnalysisParams) and params.heuristic_views):
        return heuristic
    known = rows
    for column in ("c_news", "c_facts", "min_headlines"):
        known = known.withColumn(column, inputs.calibration.select(column).scalar())
    enough = F.col("headlines") >= F.col("min_headlines")
    shown = ("score", "dispersion", "effective_count")
    kept = known.withColumnsRenamed({c: f"_{c}" for c in shown})
    for c in shown:
        kept = kept.withColumn(c, F.when(enough, F.col(f"_{c}")))
    viewed = views.calibrated_views(kept, "run", F.col("c_news"), F.col("c_facts"))
    viewed = viewed.drop(*shown).withColumnsRenamed({f"_{c}": c for c in shown})
    calibrated = (
        views.tilt_readback(viewed, tau)
        .drop("c_news", "c_facts", "min_headlines")
        .withColumn("view_mode", F.lit("calibrated"))
    )
    if isinstance(params, AnalysisParams):
        return calibrated
    # Each run in the mode it asks for.
    return calibrated.where("NOT heuristic_views").unionByName(heuristic.where("heuristic_views"))


def prepare(inputs: AnalysisInputs, params: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Assets with settings, prior, signal and view; covariances; and the scalars of the risk model."""
    knobs = cut_lineage(settings_of(inputs, params))
    return _prepared(_asked(inputs, knobs), knobs, params)


def _prepared(inputs: AnalysisInputs, knobs: DataFrame, params: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    assets = cut_lineage(prior_assets(inputs))
    held = inputs.prices.where("close is not null").join(assets.select("run", "ticker"), ["run", "ticker"], "left_semi")
    returns = P.aligned_log_returns(held, ("run",))
    cov, scalars = risk.covariance(returns, "run")
    cov = cut_lineage(cov)
    prior = assets.select("run", "ticker", F.col("market_weight").alias("weight"))
    known = assets.join(knobs.drop("tickers"), "run")
    pi = risk.implied_returns(cov, prior, "run", 1.0).withColumnRenamed("pi", "_pi")
    rows = _signals(inputs, known).join(pi, ["run", "ticker"]).join(
        risk.volatilities(cov, "run"), ["run", "ticker"]
    )
    rows = rows.withColumn("pi", F.col("_pi") * F.col("risk_aversion")).drop("_pi")
    if not isinstance(params, AnalysisParams):
        rows = cut_lineage(rows)  # read by both view modes
    return _with_views(inputs, rows, params), cov, scalars


def analyze(inputs: AnalysisInputs, params: Settings) -> Report:
    knobs = cut_lineage(settings_of(inputs, params))
    asked, inputs = inputs, _asked(inputs, knobs)
    rows, cov, scalars = _prepared(inputs, knobs, params)
    rows = cut_lineage(rows)
    prior = rows.select("run", "ticker", F.col("market_weight").alias("weight"))
    limits = knobs.select("run", "risk_aversion", "max_weight")
    matrix = rows.select("run", "ticker", "pi", "tau").join(risk.matrix_rows(cov, "run"), ["run", "ticker"])
    post = cut_lineage(
        portfolio.posterior(matrix, views.long_views(rows, "run"), "run", "tau")
    )
    solved = cut_lineage(portfolio.optimal_weights(post.join(limits, "run"), "run", "risk_aversion", "max_weight"))
    weights = portfolio.clean_weights(solved, ("run",))

    # Benchmarks share the posterior for comparability.
    no_view = post.select("run", "ticker", "sigma").join(
        rows.select("run", "ticker", F.col("pi").alias("mu")), ["run", "ticker"]
    )
    capped = portfolio.optimal_weights(no_view.join(limits, "run"), "run", "risk_aversion", "max_weight")
    equal = prior.withColumn(
        "weight", F.lit(1.0) / F.count(F.lit(1)).over(P.Window.partitionBy("run"))
    )
    books = None
    for name, book in (
        ("With views", weights), ("Capped optimum, no views", capped), ("Market-cap prior", prior), ("Equal weight", equal),
    ):
        part = book.select("run", F.lit(name).alias("portfolio"), "ticker", "weight")
        books = part if books is None else books.unionByName(part)
    columns = post.groupBy("run").agg(F.array_sort(F.collect_list("ticker")).alias("names"))
    posterior_cov = post.join(columns, "run").select(
        "run", F.col("ticker").alias("i"), F.inline(F.arrays_zip(F.col("names").alias("j"), F.col("sigma").alias("value")))
    )
    books = cut_lineage(books)
    held = books.groupBy("run", "portfolio").agg(F.array_sort(F.collect_list(F.struct("ticker", "weight"))).alias("weights"))
    stats = risk.portfolio_stats(books, post, posterior_cov, "run", ("portfolio",)).join(held, ["run", "portfolio"])

    orders = portfolio.whole_shares(
        weights.join(rows.select("run", "ticker", "price", "budget"), ["run", "ticker"]).select("run", "ticker", "price", "weight", "budget"),
        ("run",),
        F.col("budget"),
    )
    orders = cut_lineage(orders)
    titles = inputs.headlines.groupBy("run", "ticker").agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("published", "title", "positive", "negative", "neutral")))).alias("latest")
    )
    known = [c for c in ("revenue_growth", "net_margin", "debt_to_equity", "fiscal_year_end", "shares_as_of") if c in rows.columns]
    report = (
        rows.withColumnRenamed("shares", "shares_outstanding")
        .join(post.select("run", "ticker", F.col("mu").alias("posterior_return")), ["run", "ticker"])
        .join(orders.select("run", "ticker", "weight", "shares"), ["run", "ticker"])
        .join(titles, ["run", "ticker"], "left")
        .select(
            "run", "ticker", "name", "currency", "price", "market_cap", "market_weight", "volatility",
            "score", F.col("news_confidence").alias("sentiment_confidence"), "headlines", "positive", "negative", "neutral", "dispersion",
            "effective_count", "fscore", "shares_outstanding", *known,
            F.col("value").alias("signal"), F.col("confidence").alias("signal_confidence"),
            F.col("pi").alias("prior_return"), F.col("q").alias("view_return"), "posterior_return", "weight",
            (F.col("weight") * F.col("budget")).alias("target_value"), "shares", "view_mode", "latest",
            # The report's order: heaviest first.
            F.row_number().over(P.Window.partitionBy("run").orderBy(F.desc("weight"), "ticker")).alias("position"),
        )
    )
    cash = orders.groupBy("run").agg(
        F.sum(F.col("shares") * F.col("price")).alias("invested"), F.max("cash_left").alias("cash_left")
    )
    steps = solved.groupBy("run").agg(
        F.max("iterations").alias("iterations"), F.min("converged").alias("converged")
    )
    summary = (
        stats.where(F.col("portfolio") == "With views").drop("portfolio", "weights").join(cash, "run").join(steps, "run")
    )
    return Report(
        report, summary, stats, scalars, risk.correlation(cov, "run"), _warnings(asked, inputs, knobs, rows, solved, params)
    )


def _warnings(asked: AnalysisInputs, inputs: AnalysisInputs, knobs: DataFrame, rows: DataFrame, solved: DataFrame, params: Settings) -> DataFrame:
    """``(run, warning)``: what a reader of the report should know."""
    facts = rows.groupBy("run").agg(
        F.array_sort(F.collect_list(F.when(F.col("market_cap").isNull(), F.col("ticker")))).alias("uncapped"),
        F.array_sort(F.collect_list(F.when(F.col("headlines") == 0, F.col("ticker")))).alias("silent"),
        F.count("q").alias("views"),
        F.count(F.lit(1)).alias("names"),
        F.max("max_weight").alias("max_weight"),
    ).join(solved.groupBy("run").agg(F.min("converged").alias("converged")), "run")
    listed = lambda text, names: F.concat(F.lit(text), F.array_join(names, ", "))
    found = F.array_compact(
        F.array(
            F.when(F.size("uncapped") > 0, listed("equal-weight prior: no share count for ", F.col("uncapped"))),
            F.when(F.size("silent") > 0, listed("no headlines for ", F.col("silent"))),
            F.when(F.col("views") == 0, F.lit("no confident signal; the result is the market prior")),
            F.when(F.col("max_weight") * F.col("names") < 1.0, F.lit("max weight infeasible; raised to 1/n")),
            F.when(~F.col("converged"), F.lit("optimizer stopped at its step limit")),
        )
    )
    unpriced = inputs.assets.where("price is null").select(
        "run", F.concat("ticker", F.lit(": dropped, no price")).alias("warning")
    )
    bare = inputs.assets.where("price is not null").join(_histories(inputs), ["run", "ticker"], "left_anti").select(
        "run", F.concat("ticker", F.lit(": dropped, no price history")).alias("warning")
    )
    failed = knobs.select("run").join(rows.select("run"), "run", "left_anti").select(
        "run", F.lit("no result: needs two priced tickers with 30 common returns").alias("warning")
    )
    unsolved = rows.select("run").distinct().join(solved.select("run"), "run", "left_anti").select(
        "run", F.lit("no result: the posterior or the optimum could not be solved").alias("warning")
    )
    out = facts.select("run", F.explode(found).alias("warning"))
    for more in (unpriced, bare, failed, unsolved):
        out = out.unionByName(more)
    if not isinstance(params, AnalysisParams):
        run = asked.assets.schema["run"].dataType
        broken = validation.violations(params).select(F.col("run").cast(run).alias("run"), F.concat(F.lit("no result: "), "violation").alias("warning"))
        out = out.unionByName(broken)
    return out

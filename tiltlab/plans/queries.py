"""The registered queries: every operator on the warehouse tables, whole tables and whole texts.

Each function takes ``(spark, root)`` and returns a DataFrame; doubles are rounded so that two engines
agree on them whatever their summation order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiltlab.functions import numeric, text
from tiltlab.operators import backtest as B
from tiltlab.operators import compare, fundamentals, headlines, longshort, portfolio, risk
from tiltlab.operators import panel as P
from tiltlab.operators import sentiment, signals, stats, universe, validation, views
from tiltlab.params import LEVEL, STRATEGIES, AnalysisParams, EvalParams
from tiltlab.plans import analysis
from tiltlab.plans import study as S
from tiltlab.plans import walkforward as W
from tiltlab.plans.evaluation import long_short_books
from tiltlab.plans.warehouse import brand_study
from tiltlab.session import cut_lineage, shared_folder
from tiltlab.sources import documents, filings, news, prices, scores, tables
from tiltlab.streaming import headlines as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Weekly bars with the default windows; and a setting dense enough for calibration and rebalancing.
DEFAULTS = EvalParams()
DENSE = EvalParams(
    news_window_days=28, min_headlines=1, calibration_horizon=4, min_calibration_dates=60,
    cov_window=52, rebalance_every=13, horizons=(1, 4),
)
# Sparse tables: monthly bars and a quarter of news.
MONTHLY = EvalParams(news_window_days=90, min_headlines=1)
START, END = "1995-06-01", "2001-06-01"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, places: int = 6, **special: int) -> DataFrame:
    """Round doubles; ``+ 0.0`` turns a negative zero positive."""
    out = []
    for field in df.schema.fields:
        name = field.name
        if field.dataType.typeName() == "double":
            out.append((F.round(name, special.get(name, places)) + F.lit(0.0)).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def study(spark: SparkSession, root: str, params: EvalParams = DEFAULTS, facts: bool = False, window: bool = False) -> S.Study:
    start, end = (START, END) if window else (None, None)
    return brand_study(spark, root, params, "week", start, end, with_facts=facts)


def variants_of(st: S.Study) -> DataFrame:
    return S.signal_variants(S.signal_grid(st))


# Panel ---------------------------------------------------------------------------------------------


@query
def price_panel(spark, root):
    st = study(spark, root)
    panel = P.price_panel(st.prices, st.days)
    logs = (F.log("close").alias("log_close"), F.log("bench").alias("log_bench"))
    return rounded(panel.select("ticker", "t", "date", *logs), 8)


@query
def price_lookback(spark, root):
    bars = tables.prices(tables.brand_bars(spark, root))
    return rounded(P.lookback(bars, END, 365).select("ticker", "date", F.log("close").alias("log_close")), 8)


@query
def aligned_returns(spark, root):
    bars = cut_lineage(tables.brand_bars(spark, root))
    return rounded(P.aligned_log_returns(tables.prices(bars)))


@query
def excess_returns(spark, root):
    ahead = study(spark, root).panel().select("ticker", "t", P.forward_excess(DEFAULTS.horizons).alias("f"))
    return rounded(ahead.select("ticker", "t", F.inline("f")).where("forward is not null"))


@query
def realized_vol(spark, root):
    st = study(spark, root)
    return rounded(
        P.with_returns(st.panel(), DEFAULTS.vol_window).select(
            "ticker", "t", "simple_return", "log_return", "realized_vol"
        )
    )


@query
def trailing_complete(spark, root):
    st = study(spark, root)
    return P.trailing_complete(st.panel(), DEFAULTS.cov_window).select("ticker", "t")


@query
def evaluation_window(spark, root):
    st = study(spark, root, window=True)
    return P.evaluation_bounds(st.days, START, END, DEFAULTS.news_window_days)


@query
def split_factors(spark, root):
    """Split factor since each headline day of a ticker."""
    points = tables.headlines(spark, root).select("ticker", "date").distinct()
    return rounded(P.split_factor(points, tables.splits(spark, root), "date"), 8)


# News ----------------------------------------------------------------------------------------------


@query
def sentiment_panel(spark, root):
    st = study(spark, root)
    news = st.news()
    variance = numeric.score_variance(F.col("dispersion"), F.col("effective_count"))
    return rounded(news.withColumn("score_variance", variance))


@query
def sentiment_live(spark, root):
    live = tables.live_headlines(spark, root)
    now = live.agg(F.max("published")).scalar()
    return rounded(sentiment.live_summary(live, now))


@query
def headline_labels(spark, root):
    """Class counts under both tie rules, per ticker."""
    rows = tables.headlines(spark, root)
    last = compare.last_label()
    return rows.groupBy("ticker").agg(
        F.count_if(sentiment.summary_label() == "positive").alias("positive"),
        F.count_if(sentiment.summary_label() == "negative").alias("negative"),
        F.count_if(sentiment.summary_label() == "neutral").alias("neutral"),
        F.count_if(last == 0).alias("last_positive"),
        F.count_if(last == 1).alias("last_negative"),
        F.count_if(last == 2).alias("last_neutral"),
    )


@query
def signal_coverage(spark, root):
    return rounded(S.coverage(study(spark, root, window=True)))


@query
def headlines_per_ticker(spark, root):
    return S.headlines_per_ticker(study(spark, root))


@query
def headlines_in_span(spark, root):
    """Headlines per brand of the evaluated span only, with what had to be scored for all of them."""
    st = study(spark, root, window=True)
    total = S.coverage(st, st.dated_headlines())
    return S.headlines_per_ticker(st).withColumn("of", total.select("headlines").scalar()).withColumn("newly_scored", total.select("newly_scored").scalar())


@query
def signal_surprise(spark, root):
    news = study(spark, root, DENSE).news().select("ticker", "t", F.col("score").alias("level"))
    return rounded(signals.with_surprise(news).where("surprise is not null"))


@query
def signal_ex_momentum(spark, root):
    grid = S.signal_grid(study(spark, root, DENSE))
    return rounded(grid.where("ex_momentum is not null").select("ticker", "t", "level", "momentum", "ex_momentum"))


@query
def signal_variants(spark, root):
    return rounded(variants_of(study(spark, root, facts=True)).select("signal", "ticker", "t", "value"))


# Evaluation ----------------------------------------------------------------------------------------


@query
def ic_by_date(spark, root):
    st = study(spark, root, window=True)
    return rounded(S.ic_by_date(st, variants_of(st)))


@query
def ic_table(spark, root):
    st = study(spark, root, facts=True, window=True)
    return rounded(S.ic_table(st, variants_of(st)))


def ic_monthly(spark: SparkSession, root: str) -> DataFrame:
    """Flagship: the information coefficient table on monthly bars."""
    st = brand_study(spark, root, MONTHLY, "month")
    return rounded(S.ic_table(st, variants_of(st)))


QUERIES["ic_monthly"] = ic_monthly


@query
def nw_mean(spark, root):
    """Mean weekly return per ticker with its HAC error."""
    returns = P.with_returns(study(spark, root).panel()).where("simple_return is not null")
    return rounded(stats.hac_mean(returns, ("ticker",), "t", "simple_return", F.lit(5), 5))


@query
def cross_sections(spark, root):
    st = study(spark, root, DENSE, facts=True, window=True)
    return rounded(S.calibration_sections(st, variants_of(st)))


@query
def pooled_slope(spark, root):
    st = study(spark, root, DENSE, facts=True, window=True)
    return rounded(S.calibration(st, variants_of(st)))


@query
def shrunk_coefficients(spark, root):
    st = study(spark, root, DENSE, facts=True, window=True)
    out = S.calibration(st, variants_of(st)).withColumn(
        "_s", numeric.shrunk(F.col("kappa"), F.col("se"), F.col("t"))
    )
    return rounded(out.select("signal", "kappa", "se", "t", F.col("_s.kappa").alias("shrunk_kappa"), F.col("_s.se").alias("shrunk_se")))


@query
def slope_asof(spark, root):
    st = study(spark, root, DENSE, facts=True, window=True)
    sums = cut_lineage(S.calibration_sums(st, variants_of(st)))
    days = B.rebalance_days(W.plan_of(st))
    return rounded(
        stats.slope_as_of(sums, days, ("signal",), DENSE.calibration_horizon, DENSE.calibration_lags)
    )


# Long-short ----------------------------------------------------------------------------------------


def _long_short(spark, root) -> tuple[DataFrame, DataFrame]:
    st = study(spark, root, DENSE, window=True)
    return long_short_books(st, S.signal_grid(st))


@query
def long_short_weights(spark, root):
    weights, _ = _long_short(spark, root)
    return rounded(weights.select("signal", "t", "ticker", "weight"))


@query
def long_short_daily(spark, root):
    return rounded(_long_short(spark, root)[1])


@query
def long_short_summary(spark, root):
    book = cut_lineage(_long_short(spark, root)[1])
    out = longshort.summary(book, DENSE.leg_fraction)
    flat = out.select(
        *[c for c in out.columns if c != "net"], F.inline("net").alias("cost_bps", "net_annual_return", "net_sharpe")
    )
    return rounded(flat)


# Fundamentals --------------------------------------------------------------------------------------


def _year_ends(spark, root) -> DataFrame:
    """Every filer at every quarter end of all filings' span, one year beyond the last."""
    filed = F.col("filed")
    span = tables.facts(spark, root).agg(
        F.trunc(F.min(filed), "quarter").alias("a"), F.add_months(F.trunc(F.max(filed), "quarter"), 12).alias("b")
    )
    starts = span.select(F.explode(F.expr("sequence(a, b, interval 3 months)")).alias("start"))
    ends = F.broadcast(starts.select(F.date_sub("start", 1).alias("as_of")))  # one row per quarter
    return tables.registrants(spark, root).select("cik").join(ends)


@query
def facts_dedupe(spark, root):
    """Latest filed annual value per period end, restatements included."""
    annual = tables.facts(spark, root).where(fundamentals.is_annual())
    out = fundamentals.dedupe_by_end(annual)
    return rounded(out.withColumnRenamed("end", "period_end"), 3)


@query
def facts_asof(spark, root):
    """Values known per filer, date, series and period."""
    facts = cut_lineage(tables.facts(spark, root))
    known = fundamentals.visible_periods(facts, _year_ends(spark, root))
    return rounded(known.withColumnRenamed("end", "period_end"), 3)


@query
def share_classes(spark, root):
    """Cover-page shares per filing, all classes of the latest date summed."""
    return rounded(fundamentals.cover_shares(tables.facts(spark, root)).withColumnRenamed("end", "period_end"), 2)


@query
def fundamentals_asof(spark, root):
    facts = cut_lineage(tables.facts(spark, root))
    return rounded(fundamentals.fundamentals_as_of(facts, _year_ends(spark, root)))


@query
def fundamentals_current(spark, root):
    """Every landed fact counts, as of a date in the middle of the sample."""
    facts = cut_lineage(tables.facts(spark, root))
    today = tables.registrants(spark, root).select("cik", F.lit("1999-06-30").cast("date").alias("as_of"))
    return rounded(fundamentals.current_fundamentals(facts, today))


@query
def fundamental_score(spark, root):
    facts = cut_lineage(tables.facts(spark, root))
    known = fundamentals.with_score(fundamentals.fundamentals_as_of(facts, _year_ends(spark, root)))
    return rounded(known.select("cik", "as_of", "fscore", "coverage"))


@query
def fundamental_panel(spark, root):
    st = study(spark, root, facts=True)
    return rounded(st.fundamentals().select("ticker", "t", "as_of", "shares", "shares_as_of", "fscore", "coverage"))


@query
def market_caps(spark, root):
    st = study(spark, root, facts=True)
    caps = W.market_caps(st).select("ticker", "t", (F.col("market_cap") / 1e6).alias("cap_millions"))
    return rounded(caps, 4)


def _prior(spark, root):
    st = study(spark, root, DENSE, facts=True)
    windows = cut_lineage(W.investable(st, W.plan_of(st)))
    return st, windows, W.prior_weights(windows, W.market_caps(st))


@query
def market_weights(spark, root):
    _, _, prior = _prior(spark, root)
    return rounded(prior.select("r", "ticker", "market_weight", "cap_fallback"))


# Risk and views ------------------------------------------------------------------------------------


def _risk(spark, root):
    st = study(spark, root, DENSE)
    windows = cut_lineage(W.investable(st, W.plan_of(st)))
    return risk.covariance(windows, "r")


@query
def covariance(spark, root):
    return rounded(_risk(spark, root)[0])


@query
def covariance_shrinkage(spark, root):
    return rounded(_risk(spark, root)[1])


@query
def correlation(spark, root):
    return rounded(risk.correlation(cut_lineage(_risk(spark, root)[0]), "r"))


def _prior_risk(spark, root):
    st, windows, prior = _prior(spark, root)
    prior = cut_lineage(prior)
    return st, cut_lineage(risk.covariance(windows, "r")[0]), prior


def _held(prior: DataFrame) -> DataFrame:
    return prior.select("r", "ticker", F.col("market_weight").alias("weight"))


@query
def implied_returns(spark, root):
    _, cov, prior = _prior_risk(spark, root)
    return rounded(risk.implied_returns(cov, _held(prior), "r", DENSE.risk_aversion))


@query
def portfolio_stats(spark, root):
    _, cov, prior = _prior_risk(spark, root)
    mu = cut_lineage(risk.implied_returns(cov, _held(prior), "r", DENSE.risk_aversion)).withColumnRenamed("pi", "mu")
    targets = W.simple_targets(prior)
    return rounded(risk.portfolio_stats(targets, mu, cov, "r", ("strategy",)))


@query
def combined_signal(spark, root):
    """Blend of news and fundamentals on every panel day with news."""
    st = study(spark, root, DENSE, facts=True)
    scores = st.fundamentals().select("ticker", "t", "fscore", "coverage")
    rows = st.news().join(scores, ["ticker", "t"], "left")
    blend = signals.combine(
        F.col("score"), F.col("confidence"), F.col("fscore"), F.col("coverage"), DENSE.sentiment_weight
    )
    return rounded(rows.select("ticker", "t", F.inline(F.array(blend))))


def _view_rows(spark, root, calibrated: bool = True):
    """Inputs of the solves; news alone is calibrated here."""
    st, cov, prior = _prior_risk(spark, root)
    known = cut_lineage(st.fundamentals().select("ticker", "t", "fscore", "coverage"))
    days = cut_lineage(B.rebalance_days(W.plan_of(st)))
    if calibrated:
        news_only = S.signal_variants(S.signal_grid(replace(st, facts=None)), (LEVEL,))
        sums = cut_lineage(S.calibration_sums(st, news_only))
        coefficients = cut_lineage(W.coefficients_as_of(st, sums, days))
    else:
        none = F.lit(None).cast("struct<kappa:double,se:double,t:double>")
        coefficients = days.select("r", none.alias("c_news"), none.alias("c_facts"))
    return W.view_assets(st, cov, prior, cut_lineage(st.news()), known, coefficients)


@query
def heuristic_views(spark, root):
    rows = _view_rows(spark, root, calibrated=False)
    return rounded(
        rows.where(F.col("strategy") == STRATEGIES[3]).where("q is not null").select("r", "ticker", "q", "omega")
    )


@query
def calibrated_views(spark, root):
    """Views under fixed coefficients, so that every rebalance has some."""
    st, cov, prior = _prior_risk(spark, root)
    pi = risk.implied_returns(cov, _held(prior), "r", DENSE.risk_aversion)
    news = st.news().select(F.col("t").alias("r"), "ticker", "score", "dispersion", "effective_count")
    facts = st.fundamentals().select(F.col("t").alias("r"), "ticker", "fscore")
    rows = (
        pi.join(risk.volatilities(cov, "r"), ["r", "ticker"])
        .join(news, ["r", "ticker"], "left")
        .join(facts, ["r", "ticker"], "left")
    )
    coefficient = lambda k, s: F.struct(F.lit(k).alias("kappa"), F.lit(s).alias("se"), F.lit(k / s).alias("t"))
    out = views.calibrated_views(rows, "r", coefficient(0.5, 0.2), coefficient(-0.4, 0.25))
    shown = views.tilt_readback(out, DENSE.tau)
    return rounded(shown.select("r", "ticker", "q", "omega", "value", "confidence"))


# Portfolios ----------------------------------------------------------------------------------------


@query
def simplex_projection(spark, root):
    """Nations as portfolios, suppliers as assets: nearest capped weights to scaled balances."""
    points = tables.table(spark, root, "supplier").select(
        F.col("s_nationkey").alias("portfolio"), F.col("s_suppkey").alias("asset"),
        (F.col("s_acctbal") / 10000.0).alias("v"),
    )
    size = F.count(F.lit(1)).over(Window.partitionBy("portfolio"))
    cap = portfolio.feasible_cap(F.lit(0.3), size)
    return rounded(portfolio.project_capped_simplex(points, ("portfolio",), "v", cap), 11)


@query
def share_rounding(spark, root):
    """Whole shares per rebalance for the market-cap weights at that day's closes."""
    st, _, prior = _prior(spark, root)
    closes = st.panel().select(F.col("t").alias("r"), "ticker", (F.col("close") / 100.0).alias("price"))
    book = portfolio.clean_weights(_held(prior), ("r",)).join(closes, ["r", "ticker"])
    shares = portfolio.whole_shares(book, ("r",), F.lit(10000.0))
    return rounded(shares.select("r", "ticker", "shares", "cash_left"))


@query
def bl_posterior(spark, root):
    """Posterior means per rebalance under the heuristic views."""
    rows = _view_rows(spark, root, calibrated=False).where(F.col("strategy") == STRATEGIES[3])
    rows = cut_lineage(rows)
    out = portfolio.posterior(rows, views.long_views(rows, "r"), "r", DENSE.tau)
    return rounded(out.select("r", "ticker", "mu"))


@query
def optimal_weights(spark, root):
    """Capped optimum per rebalance and view strategy."""
    solved = portfolio.view_weights(
        _view_rows(spark, root), ("r", "strategy"), DENSE.tau, DENSE.risk_aversion, DENSE.max_weight
    )
    return rounded(solved.select("r", "strategy", "ticker", "weight", "converged"))


# Walk-forward --------------------------------------------------------------------------------------


@query
def rebalance_schedule(spark, root):
    return B.rebalance_days(W.plan_of(study(spark, root, DENSE)))


def _simple(spark, root):
    return W.run_simple(study(spark, root, DENSE, facts=True))


@query
def backtest_returns_capeq(spark, root):
    return rounded(_simple(spark, root).returns)


@query
def turnover(spark, root):
    return rounded(_simple(spark, root).turnovers)


@query
def drawdown(spark, root):
    return rounded(stats.max_drawdown(_simple(spark, root).returns, ("strategy",), "t", "net"))


@query
def strategy_stats(spark, root):
    bt = _simple(spark, root)
    return rounded(B.strategy_stats(cut_lineage(bt.returns), bt.turnovers, DENSE, with_ci=False))


@query
def bootstrap_ci(spark, root):
    """Stationary-bootstrap interval of every ticker's mean return over the days it has one."""
    st = study(spark, root)
    returns = P.with_returns(st.panel()).where("simple_return is not null")
    place = F.row_number().over(Window.partitionBy("ticker").orderBy("t")) - 1
    series = cut_lineage(returns.select("ticker", place.alias("idx"), "simple_return"))
    return rounded(stats.bootstrap_ci(series, ("ticker",), F.avg("simple_return")))


@query
def backtest_all(spark, root):
    st = study(spark, root, DENSE, facts=True)
    sums = cut_lineage(S.calibration_sums(st, variants_of(st)))
    bt = W.run(st, sums)
    return rounded(B.strategy_stats(cut_lineage(bt.returns), bt.turnovers, DENSE))


@query
def backtest_counters(spark, root):
    st = study(spark, root, DENSE, facts=True)
    sums = cut_lineage(S.calibration_sums(st, variants_of(st)))
    return W.run(st, sums).counters


# Texts ---------------------------------------------------------------------------------------------


def _company_name() -> Column:
    """Part names dressed up as company names."""
    endings = {
        "ECONOMY": " Inc.", "LARGE": " CORP", "MEDIUM": " Inc. Class A", "PROMO": ".com, Inc.",
        "SMALL": " Holdings Group plc",
    }
    ending = F.lit(" American Co")
    for kind, tail in endings.items():
        ending = F.when(F.col("p_type") == kind, tail).otherwise(ending)
    return F.concat("p_name", ending)


@query
def company_names(spark, root):
    parts = tables.table(spark, root, "part").select("p_partkey", _company_name().alias("raw"))
    terms = text.relevance_terms(F.lit("AMZN"), F.col("raw"))
    return parts.select(
        "p_partkey", text.clean_company_name(F.col("raw")).alias("clean"), F.array_join(terms, "|").alias("terms")
    )


@query
def tickers_normalized(spark, root):
    raw = F.concat(F.lower("p_brand"), F.lit(", brk.b "), F.col("p_brand"), F.lit(" ,"), F.col("p_type"))
    return tables.table(spark, root, "part").select(
        "p_partkey", F.array_join(text.ticker_list(raw), ",").alias("tickers")
    )


@query
def csv_dates(spark, root):
    """Dates of six layouts; offsets roll over to the next UTC day, garbage is NULL."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    layout = F.substring("o_orderpriority", 1, 1)
    raw = (
        F.when(layout == "1", day)
        .when((layout == "2") & (F.col("o_orderkey") % 2 == 0), F.concat(day, F.lit(" 13:00:00")))
        .when(layout == "2", F.concat(day, F.lit(" 01:15:00 +03:30")))
        .when(layout == "3", F.concat(day, F.lit("T23:30:00-02:00")))
        .when(layout == "4", F.concat(day, F.lit(" 22:30:00 -0400")))
        .otherwise(F.concat(F.lit("on "), day))
    )
    return tables.table(spark, root, "orders").select("o_orderkey", text.parse_date(raw).alias("date"))


def _document_headlines(spark, root) -> DataFrame:
    """Documents as headlines; the language's article plays the ticker."""
    ticker = F.when(F.col("lang") == "en", "Of").when(F.col("lang") == "fr", "La").when(
        F.col("lang") == "de", "Der"
    ).otherwise("El")
    return tables.table(spark, root, "documents").select("doc_id", ticker.alias("ticker"), F.col("text").alias("title"))


@query
def relevance(spark, root):
    rows = _document_headlines(spark, root)
    name = F.when(F.col("ticker") == "Of", "American Which Corp").when(F.col("ticker") == "La", "Dans Inc").when(
        F.col("ticker") == "Der", "Nicht Ltd"
    ).otherwise("Para, The")
    names = rows.select("ticker").distinct().withColumn("name", name)
    return headlines.relevant(rows, names).select("doc_id", "ticker")


@query
def title_keys(spark, root):
    docs = tables.table(spark, root, "documents")
    return docs.select(
        "doc_id",
        F.md5(text.dedupe_key(F.col("text")).cast("binary")).alias("key"),
        text.has_words(F.col("text"), 3).alias("long_enough"),
    )


@query
def chart_prices(spark, root):
    """Closes of chart documents, one a part: whole adjusted series or raw closes, days in local time, last point of a day."""
    return rounded(prices.chart_prices(prices.parse_charts(documents.chart_documents(spark, root))), 9)


@query
def chart_splits(spark, root):
    return rounded(prices.chart_splits(prices.parse_charts(documents.chart_documents(spark, root))))


@query
def chart_instruments(spark, root):
    """Name and last price of each chart."""
    return rounded(prices.instruments(prices.parse_charts(documents.chart_documents(spark, root))))


@query
def chart_failures(spark, root):
    """Chart documents that hold no chart, with the reason."""
    return prices.chart_failures(documents.chart_documents(spark, root))


WANTED_FACTS = {"us-gaap": ("URGENT", "HIGH"), "dei": ("Shares",)}


@query
def filing_facts(spark, root):
    """Wanted facts of filing documents, one a customer, with their place in their lists."""
    return rounded(filings.parse_facts(documents.filing_documents(spark, root), WANTED_FACTS).withColumnRenamed("end", "until"))


@query
def filing_entities(spark, root):
    return filings.parse_entities(documents.filing_documents(spark, root))


@query
def ticker_lookup(spark, root):
    """Filer of every customer's name, none for unlisted ones."""
    listed = filings.parse_ticker_map(documents.ticker_documents(spark, root))
    names = tables.table(spark, root, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 4 == 0, "UNLISTED").otherwise(F.upper(F.replace("c_name", F.lit("#"), F.lit("-")))).alias("ticker")
    )
    return filings.lookup_filers(names, listed)


@query
def share_frame_entries(spark, root):
    """Entries of share frames in their order."""
    return rounded(filings.parse_share_frames(documents.frame_documents(spark, root)).withColumnRenamed("end", "until"))


@query
def feed_items(spark, root):
    """Headlines of feed documents with whole texts as titles."""
    found = news.parse_feeds(documents.feed_documents(spark, root), "Wire")
    return found.select("ticker", "pos", F.md5(F.col("title").cast("binary")).alias("title_md5"), "url", "source", "published")


@query
def page_titles(spark, root):
    """Page titles decoded, with the last word stripped as publisher."""
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    pages = tables.table(spark, root, "pages").select("page_id", title.alias("raw"))
    source = F.regexp_extract("raw", r"(\S+)$", 1)
    return pages.select(
        "page_id",
        text.decode_entities(F.col("raw")).alias("title"),
        text.decode_entities(text.strip_publisher(F.col("raw"), F.nullif(source, F.lit("")))).alias("stripped"),
    )


def _feeds(spark, root) -> DataFrame:
    """Documents and turns as two feeds, spread over the fourteen days up to 2024-01-10."""
    start = F.lit("2024-01-10").cast("timestamp")
    ago = lambda key: F.make_dt_interval(mins=(F.col(key) * 37 % (14 * 24 * 60)).cast("int"))
    documents = tables.table(spark, root, "documents").select(
        F.col("source").alias("ticker"), F.col("text").alias("title"),
        (start - ago("doc_id")).alias("published"),
        F.col("doc_id").alias("pos"),
    )
    turns = tables.table(spark, root, "conversations").select(
        F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("ticker"), F.col("text").alias("title"),
        (start - ago("conv_id")).alias("published"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"),
    )
    return headlines.union_feeds(documents, turns)


@query
def headlines_dedup_topk(spark, root):
    """Five newest distinct headlines per ticker over two feeds."""
    fresh = headlines.recent(_feeds(spark, root), F.lit("2024-01-10").cast("timestamp"), 7)
    kept = headlines.newest(headlines.first_copies(fresh), 5)
    return kept.select("ticker", "feed_rank", "pos", F.md5(F.col("title").cast("binary")).alias("title_md5"))


@query
def headlines_week_cap(spark, root):
    """Two titles per brand and week, no title twice per brand."""
    rows = tables.table(spark, root, "part").select(
        F.col("p_brand").alias("ticker"), F.col("p_name").alias("title"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size") * 3).alias("date"),
        F.col("p_partkey").alias("pos"),
    )
    return headlines.weekly_cap(rows, 2).select("ticker", "date", "pos", "title")


@query
def archive_headlines(spark, root):
    """Titles of the covered weeks that are about their brand, two a brand and week, no title twice."""
    rows = tables.table(spark, root, "part").select(
        F.col("p_brand").alias("ticker"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("title"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size") * 3).alias("date"),
        F.col("p_partkey").alias("pos"),
    )
    names = rows.select("ticker").distinct().withColumn("name", F.lit("Gear Company"))
    return headlines.archive_headlines(rows, names, "2024-01-18", "2024-05-02", 2).select("ticker", "date", "pos", "title")


@query
def week_windows(spark, root):
    """Headlines per Monday-aligned window of the evaluated span."""
    spans = headlines.week_windows(START, END, spark)
    counted = tables.headlines(spark, root).groupBy(headlines.week_start(F.col("date")).alias("a")).agg(
        F.count(F.lit(1)).alias("headlines")
    )
    return spans.join(counted, "a", "left").na.fill(0, ["headlines"])


# Scores --------------------------------------------------------------------------------------------

FIRST_WORDS = (("the", "and", "la", "der", "que"), ("of", "to", "de", "die", "el"))
SECOND_WORDS = (("the", "in", "la", "das", "en"), ("of", "is", "le", "und", "los"))


def _store(spark, root) -> DataFrame:
    """A store of labelled documents' scores, written for this call; the later record of a text wins."""
    records = (
        tables.table(spark, root, "documents").select("doc_id", "text")
        .join(tables.table(spark, root, "labels"), "doc_id")
        .select(
            scores.text_key().alias("digest"), "text", "doc_id", (F.col("quality") * 0.75).alias("positive"), (F.col("toxic") * 0.25).alias("negative"),
        )
    )
    latest = records.groupBy("digest").agg(F.max_by(F.struct("text", "positive", "negative"), "doc_id").alias("p"))
    path = f"{shared_folder(spark).rstrip('/')}/scores-{uuid.uuid4().hex}"
    scores.append_scores(latest.select("p.*", (1.0 - F.col("p.positive") - F.col("p.negative")).alias("neutral")), path, 0)
    return scores.read_store(spark, path)


def _texts(spark, root) -> DataFrame:
    return tables.table(spark, root, "documents").select("doc_id", "text")


@query
def scores_missing(spark, root):
    missing = sentiment.missing_texts(_texts(spark, root), _store(spark, root))
    return missing.select(F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def scores_lookup(spark, root):
    found = sentiment.stored_scores(_texts(spark, root), _store(spark, root))
    return rounded(found.select("doc_id", "positive", "negative", "neutral"))


@query
def scores_memoised(spark, root):
    """Stored scores where a text has one, the word scorer for the rest."""
    scorer = sentiment.lexicon_scorer(*FIRST_WORDS)
    done = sentiment.score_all(_texts(spark, root), _store(spark, root), scorer)
    return rounded(done.select("doc_id", "positive", "negative", "neutral"))


def _word_model():
    """A batch model of weighted words: class weights summed over a text's words, as probabilities."""
    import re

    import numpy as np

    weights = {w: (0.3, 0.0) for w in FIRST_WORDS[0]} | {w: (0.0, 0.2) for w in FIRST_WORDS[1]}

    def predict(batch):
        found = (re.findall(r"[^\W_]+", t.lower()) for t in batch)
        logits = np.array([np.sum([(*weights.get(w, (0.0, 0.0)), 0.01) for w in ws] or [(0.0, 0.0, 0.0)], axis=0) for ws in found])
        powers = np.exp(logits - logits.max(axis=1, keepdims=True))
        return powers / powers.sum(axis=1, keepdims=True)

    return predict


@query
def model_scores(spark, root):
    """Every distinct document scored by a batch model that each worker loads once."""
    texts = _texts(spark, root).where("text IS NOT NULL").groupBy(scores.text_key().alias("digest")).agg(F.first("text").alias("text"))
    found = sentiment.loaded_scorer(_word_model, "weighted words")(texts)
    return rounded(found.select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "positive", "negative", "neutral"))


# Streams -------------------------------------------------------------------------------------------


def _landed_stream(spark, root) -> DataFrame:
    """Events as headlines in three landings, read one a batch: up to the tenth day, the later ones, and stragglers of all days."""
    events = tables.table(spark, root, "events").select(
        "event_id", F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("published"),
        (F.col("value") / 100.0).alias("positive"), (F.col("user_id") / 1000.0).alias("negative"),
    ).withColumn("neutral", 1.0 - F.col("positive") - F.col("negative"))
    straggler, early = F.col("event_id") % 40 == 0, F.col("published") < F.lit("2024-01-11").cast("timestamp")
    path = f"{shared_folder(spark).rstrip('/')}/landed-{uuid.uuid4().hex}"
    landings = (~straggler & early, ~straggler & ~early, straggler)
    for part in landings:  # a landing is one file, so that it is one batch
        events.where(part).drop("event_id").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.drop("event_id").schema).option("maxFilesPerTrigger", 1).parquet(path)


def _drained(spark, stream: DataFrame) -> DataFrame:
    """What a stream's final rows are once all that has landed is read."""
    path = f"{shared_folder(spark).rstrip('/')}/drained-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress")
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


@query
def stream_closed_weeks(spark, root):
    """Weeks that are final: three days have passed since their end. Stragglers count if their week is still open."""
    return rounded(_drained(spark, streams.closed_weeks(_landed_stream(spark, root))), 9)


@query
def stream_sliding_news(spark, root):
    """News of the seven days before each day, final after three days."""
    return rounded(_drained(spark, streams.sliding_news(_landed_stream(spark, root))), 9)


@query
def model_agreement(spark, root):
    variants = {
        "reference": sentiment.lexicon_scorer(*FIRST_WORDS),
        "smooth": sentiment.lexicon_scorer(*FIRST_WORDS, prior=20.0),
        "other": sentiment.lexicon_scorer(*SECOND_WORDS),
    }
    return rounded(compare.compare_models(_texts(spark, root), variants))


@query
def text_sample(spark, root):
    texts = _texts(spark, root).select("text").distinct()
    sample = compare.hash_sample(texts, 50)
    return rounded(sample.select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "u"), 9)


# Universe ------------------------------------------------------------------------------------------


def _ticker_map(spark, root) -> DataFrame:
    """Three tickers per supplier: a plain one, a longer one and a preferred share.

    The plain one is the key in base 26, five letters; keys that differ by a multiple of 26 ** 5 share it.
    """
    digit = lambda k: F.chr((F.lit(65) + F.floor(F.col("s_suppkey") / F.lit(26**k)) % 26).cast("int"))
    letters = F.concat(*[digit(k) for k in (4, 3, 2, 1, 0)])
    listed = F.array(F.concat(letters, F.lit("W")), letters, F.concat(letters, F.lit("-P")))
    return tables.table(spark, root, "supplier").select(
        F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("cik"), F.explode(listed).alias("ticker")
    )


def _frame(spark, root) -> DataFrame:
    return tables.table(spark, root, "supplier").select(
        F.col("s_suppkey").alias("cik"), F.lit("1999-03-31").cast("date").alias("end"),
        (F.col("s_acctbal") * 100.0).alias("val"), F.col("s_suppkey").alias("pos"),
    )


def _supplier_closes(spark, root) -> DataFrame:
    pool = universe.candidates(_frame(spark, root), _ticker_map(spark, root))
    names = pool.select(F.col("cik").cast("bigint").alias("instrument"), "ticker")
    return tables.supplier_prices(spark, root).join(names, "instrument").select("ticker", "date", "close")


def _supplier_splits(spark, root) -> DataFrame:
    """A split wherever a supplier ships 50 units as the first line of an order."""
    pool = universe.candidates(_frame(spark, root), _ticker_map(spark, root)).select(F.col("cik").cast("bigint").alias("l_suppkey"), "ticker")
    lines = tables.table(spark, root, "lineitem").where("l_quantity = 50 AND l_linenumber = 1")
    return lines.join(pool, "l_suppkey").select("ticker", F.col("l_shipdate").cast("date").alias("date"), F.when(F.col("l_discount") >= 0.05, 2.0).otherwise(0.5).alias("ratio"))


def _screened(spark, root, splits: DataFrame | None = None) -> DataFrame:
    pool = universe.candidates(_frame(spark, root), _ticker_map(spark, root))
    return universe.screen(pool, _supplier_closes(spark, root), splits, F.lit("1999-07-01").cast("date"), 5e7, 3e9, 300)


@query
def shortest_ticker(spark, root):
    return universe.shortest_tickers(_ticker_map(spark, root))


@query
def universe_screen(spark, root):
    return rounded(_screened(spark, root).withColumn("cap", F.col("cap") / 1e6), 4)


@query
def universe_sample(spark, root):
    drawn = universe.draw(_screened(spark, root), 10, 1)
    return rounded(drawn.select("position", "ticker", (F.col("cap") / 1e6).alias("cap")), 4)


@query
def universe_summary(spark, root):
    screened = cut_lineage(_screened(spark, root))
    drawn = cut_lineage(universe.draw(screened, 10, 1))
    return universe.draw_summary(screened, drawn, 10, 1, F.lit("1999-07-01").cast("date"))


@query
def universe_screen_splits(spark, root):
    """The screen with splits after the date of the share counts."""
    return rounded(_screened(spark, root, _supplier_splits(spark, root)).withColumn("cap", F.col("cap") / 1e6), 4)


@query
def universe_draw_splits(spark, root):
    """A sample drawn and summed up in one call, with its cap range."""
    day = F.lit("1999-07-01").cast("date")
    listed, prices = _ticker_map(spark, root), _supplier_closes(spark, root)
    drawn, told = universe.sample(_frame(spark, root), listed, prices, _supplier_splits(spark, root), day, 8, 3, 2e7, 2e9)
    total = drawn.agg(F.sum(F.col("cap") / 1e6).alias("caps"))
    return rounded(told.withColumn("caps", total.scalar()), 3)


@query
def share_frames(spark, root):
    days = tables.table(spark, root, "orders").select(F.col("o_orderdate").cast("date").alias("as_of")).distinct()
    return days.select("as_of", text.share_frame(F.col("as_of")).alias("share_frame"))


# Analysis ------------------------------------------------------------------------------------------


# As far as any accepted request may look.
WIDEST = AnalysisParams(lookback_days=1825, news_days=30, max_headlines=100)


def _inputs(spark, root, calibrated: bool = False, params: AnalysisParams = AnalysisParams()) -> tuple[analysis.AnalysisInputs, AnalysisParams]:  # noqa: B008
    """One run per region, its five brands as tickers, on the last day with orders."""
    bars = cut_lineage(tables.prices(tables.brand_bars(spark, root)))
    filers = tables.registrants(spark, root)
    orders = tables.table(spark, root, "orders")
    today = cut_lineage(orders.agg(F.max(F.col("o_orderdate").cast("date")).alias("today")))
    now = today.scalar()
    recent = bars.where((F.col("date") >= F.date_sub(now, params.lookback_days)) & (F.col("date") <= now))
    prices = filers.select("ticker", F.col("region").alias("run")).join(recent, "ticker")
    last = prices.groupBy("run", "ticker").agg((F.max_by("close", "date") / 100.0).alias("price"))
    facts = cut_lineage(tables.facts(spark, root))
    known = fundamentals.with_score(
        fundamentals.current_fundamentals(facts, filers.select("cik", now.alias("as_of")))
    )
    assets = (
        last.join(filers, "ticker")
        .join(known.drop("as_of"), "cik", "left")
        .select(
            "run", "ticker", F.col("entity_name").alias("name"), F.lit("USD").alias("currency"), "price", "shares",
            "shares_as_of", "fscore", "coverage", "revenue_growth", "net_margin", "debt_to_equity", "fiscal_year_end",
        )
    )
    scored = orders.select(
        tables._brand(F.col("o_custkey")).alias("ticker"),
        F.concat_ws(" ", F.lit("Order"), "o_orderkey", "o_orderpriority").alias("title"),
        F.col("o_orderdate").cast("timestamp").alias("published"),
        (F.col("o_totalprice") / 500000.0).alias("positive"),
        (0.5 - F.col("o_totalprice") / 1000000.0).alias("negative"),
        F.lit(0).alias("feed_rank"),
        F.col("o_orderkey").alias("pos"),
    ).withColumn("neutral", 1.0 - F.col("positive") - F.col("negative"))
    fresh = headlines.recent(scored, now, params.news_days)
    latest = cut_lineage(headlines.newest(headlines.first_copies(fresh), params.max_headlines))
    coefficients = None
    if calibrated:
        fixed = lambda k, s: F.struct(F.lit(k).alias("kappa"), F.lit(s).alias("se"), F.lit(k / s).alias("t"))
        coefficients = today.select(
            fixed(0.5, 0.2).alias("c_news"), fixed(0.3, 0.1).alias("c_facts"), F.lit(1).alias("min_headlines")
        )
    inputs = analysis.AnalysisInputs(
        cut_lineage(assets), cut_lineage(prices), latest, tables.splits(spark, root), now, coefficients
    )
    return inputs, params


def _analysis(spark, root, calibrated: bool = False) -> analysis.Report:
    return analysis.analyze(*_inputs(spark, root, calibrated))


SIGNAL_COLUMNS = (
    "run", "ticker", "name", "price", "market_weight", "volatility", "score", "news_confidence", "headlines", "fscore",
    "value", "confidence", "pi", "q", "omega", "view_mode",
)


@query
def analysis_signals(spark, root):
    """Everything the analysis knows per asset before the solve."""
    return rounded(analysis.prepare(*_inputs(spark, root))[0].select(*SIGNAL_COLUMNS))


@query
def analysis_signals_calibrated(spark, root):
    return rounded(analysis.prepare(*_inputs(spark, root, True))[0].select(*SIGNAL_COLUMNS))


def _requests(spark, root) -> DataFrame:
    """A request for each region, with settings of its own; one asks for a cap of nothing."""
    k = F.col("r_regionkey")
    return tables.table(spark, root, "region").select(
        k.alias("run"),
        (5000.0 * (k + 1)).alias("budget"),
        F.when(k == 3, 0.0).otherwise(0.3 + 0.1 * k).alias("max_weight"),
        (300 + 200 * k).cast("int").alias("lookback_days"),
        (5 + 4 * k).cast("int").alias("news_days"),
        (30 - 6 * k).cast("int").alias("max_headlines"),
        (2.0 + 0.5 * k).alias("risk_aversion"),
        (0.02 + 0.02 * k).alias("tau"),
        (0.1 + 0.2 * k).alias("view_scale"),
        (0.9 - 0.15 * k).alias("sentiment_weight"),
        (k % 2 == 0).alias("heuristic_views"),
    )


@query
def analysis_requests(spark, root):
    """Signals and views of runs that differ in every setting; the run that breaks a rule is gone."""
    inputs, _ = _inputs(spark, root, True, WIDEST)
    return rounded(analysis.prepare(inputs, _requests(spark, root))[0].select(*SIGNAL_COLUMNS, "budget", "max_weight", "tau"))


@query
def analysis_orders(spark, root):
    """What the requests' books come to: names, the largest weight and whether orders stay within budget and cap."""
    inputs, _ = _inputs(spark, root, True, WIDEST)
    report = analysis.analyze(inputs, _requests(spark, root))
    told = report.warnings.where(F.col("warning").startswith("no result")).select("run", "warning")
    books = report.assets.join(_requests(spark, root).select("run", "budget", "max_weight"), "run").groupBy("run").agg(
        F.count(F.lit(1)).alias("names"),
        (F.abs(F.sum("weight") - 1) < 1e-9).alias("full"),
        (F.max("weight") <= F.max("max_weight") + 1e-9).alias("capped"),
        (F.sum(F.col("shares") * F.col("price")) <= F.max("budget")).alias("affordable"),
        (F.abs(F.sum("target_value") - F.max("budget")) < 1e-6).alias("budgeted"),
    )
    return books.join(told, "run", "full")


@query
def request_violations(spark, root):
    """Rules that requests made of customers break."""
    k = F.col("c_custkey")
    requests = tables.table(spark, root, "customer").select(
        k.alias("run"),
        F.concat(F.lower("c_mktsegment"), F.lit(", n."), F.col("c_nationkey").cast("string"), F.when(k % 5 == 0, " bad#one").when(k % 7 == 0, ",a-very-long-ticker").otherwise(" N-1")).alias("tickers"),
        F.when(k % 11 != 0, F.col("c_acctbal")).alias("budget"),
        (k % 30 / 20.0).alias("max_weight"),
        (k % 2000).cast("int").alias("lookback_days"),
        (k % 40).cast("int").alias("news_days"),
        (k % 130).cast("int").alias("max_headlines"),
        (k % 600 / 10.0).alias("risk_aversion"),
        F.when(k % 13 == 0, float("nan")).otherwise(k % 130 / 100.0).alias("tau"),
        (k % 250 / 100.0).alias("view_scale"),
        (k % 120 / 100.0 - 0.05).alias("sentiment_weight"),
    )
    return validation.violations(validation.normalized_requests(requests))


@query
def analysis_report(spark, root):
    out = _analysis(spark, root).assets
    titles = F.when(F.col("latest").isNull(), 0).otherwise(F.size("latest"))
    return rounded(out.withColumn("titles", titles).drop("latest", "market_cap"))


@query
def analysis_facts(spark, root):
    """What the report says of each asset besides its solve: counted headlines and reported figures."""
    out = _analysis(spark, root).assets
    return rounded(out.select("run", "ticker", "headlines", "positive", "negative", "neutral", "effective_count", "revenue_growth", "net_margin", "debt_to_equity", "shares_as_of", "fiscal_year_end"))


@query
def analysis_books(spark, root):
    """Weights of the benchmark books that no optimum is needed for."""
    books = _analysis(spark, root).benchmarks.where(F.col("portfolio").isin("Market-cap prior", "Equal weight"))
    return rounded(books.select("run", "portfolio", F.inline("weights")).withColumn("weight", F.col("weight")))


@query
def analysis_calibrated(spark, root):
    return rounded(_analysis(spark, root, True).assets.drop("latest", "market_cap"))


@query
def analysis_portfolio(spark, root):
    return rounded(_analysis(spark, root).portfolio)


@query
def analysis_benchmarks(spark, root):
    return rounded(_analysis(spark, root).benchmarks.drop("weights"))


@query
def analysis_risk(spark, root):
    return rounded(analysis.prepare(*_inputs(spark, root))[2])

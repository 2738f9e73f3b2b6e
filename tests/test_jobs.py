import datetime as dt
import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tiltlab.operators import backtest as B
from tiltlab.operators import panel as P
from tiltlab.operators import portfolio, universe, validation
from tiltlab.params import STRATEGIES, AnalysisParams, EvalParams
from tiltlab.plans import analysis
from tiltlab.plans import walkforward as W
from tiltlab.plans.evaluation import evaluate
from tiltlab.plans.study import Study
from tiltlab.sources.reports import write_sections
from tiltlab.streaming import headlines as H

START = dt.date(2024, 1, 1)


def path(spark, **drift):
    rows = [
        (name, START + dt.timedelta(days=k), 100.0 * math.exp(d * k + w * math.sin(0.7 * k)))
        for name, (d, w) in drift.items() for k in range(400)
    ]
    return spark.createDataFrame(rows, "ticker string, date date, close double")


@pytest.fixture(scope="module")
def quiet(spark):
    """Three names, no news, no share counts."""
    empty = lambda schema: spark.createDataFrame([], schema)
    days = P.calendar(path(spark, IDX=(0.0004, 0.01)).drop("ticker")).cache()
    prices = path(spark, A=(0.0005, 0.02), B=(0.0002, 0.015), C=(0.0007, 0.03)).cache()
    return Study(
        EvalParams(max_weight=0.6), prices, days,
        empty("ticker string, date date, positive double, negative double, neutral double"),
        empty("cik string, taxonomy string, tag string, unit string, pos int, start date, end date, val double, form string, filed date"),
        spark.createDataFrame([(n, n) for n in "ABC"], "ticker string, cik string"),
        empty("ticker string, date date, ratio double"),
    )


def test_backtest_without_signals(spark, quiet):
    sums = spark.createDataFrame([], "signal string, t int, sxx double, sxy double, names bigint")
    bt = W.run(quiet, sums)
    counters = bt.counters.first()
    assert counters.rebalances == counters.market_cap_fallbacks == 7 and counters.calibrated_rebalances == 0
    by = {}
    for r in bt.returns.orderBy("t").collect():
        by.setdefault(r.strategy, []).append(r.net)
    assert set(by) == set(STRATEGIES) and {len(v) for v in by.values()} == {400 - 1 - 252}
    assert by["Market cap"] == pytest.approx(by["Equal weight"], abs=1e-15)
    assert by["BL + heuristic views"] == by["BL, no views"] == by["BL + calibrated views"]
    moved = {r.strategy: r["count"] for r in bt.turnovers.groupBy("strategy").count().collect()}
    assert set(moved.values()) == {6}
    stats = {r.strategy: r for r in B.strategy_stats(bt.returns, bt.turnovers, quiet.params, with_ci=False).collect()}
    assert stats["Market cap"].tracking_error == 0.0 and stats["Market cap"].information_ratio == 0.0


def simulate(closes, targets, first, last, every, bps):
    """Carry one book day by day: drift, rebalance where targets exist, pay costs the day after."""
    book, out, moved = {}, [], []
    for r in range(first, last, every):
        cost = 0.0
        if r in targets:
            if book:
                names = set(book) | set(targets[r])
                moved.append(sum(abs(targets[r].get(n, 0) - book.get(n, 0)) for n in names))
                cost = moved[-1] * bps / 1e4
            book = dict(targets[r])
        for t in range(r + 1, min(r + every, last) + 1):
            ret = {n: (closes[n][t] / closes[n][t - 1] - 1 if closes[n][t] and closes[n][t - 1] else 0.0) for n in book}
            gross = sum(w * ret[n] for n, w in book.items())
            out.append(gross - (cost if t == r + 1 else 0.0))
            book = {n: w * (1 + ret[n]) / (1 + gross) for n, w in book.items()}
    return out, moved


def test_holdings_match_a_daily_simulation(spark, quiet):
    closes = {n: [100 * math.exp(0.01 * math.sin(k * (i + 1))) for k in range(31)] for i, n in enumerate("AB")}
    closes["B"][9] = None
    rows = [(n, START + dt.timedelta(days=k), x) for n, v in closes.items() for k, x in enumerate(v) if x]
    prices = spark.createDataFrame(rows, "ticker string, date date, close double")
    study = Study(EvalParams(cov_window=3, rebalance_every=5), prices, quiet.days.where("t < 31"), quiet.headlines)
    plan = B.schedule(study.days, F.lit(0), 3, 5)
    wanted = {8: {"A": 0.7, "B": 0.3}, 18: {"A": 0.2, "B": 0.8}, 23: {"A": 1.0}}  # 3 and 13 are skipped
    targets = spark.createDataFrame([("Market cap", r, n, w) for r, v in wanted.items() for n, w in v.items()], "strategy string, r int, ticker string, weight double")
    bt = W.hold(study, plan, targets)
    want, moved = simulate(closes, wanted, 3, 30, 5, 10.0)
    assert [r.net for r in bt.returns.orderBy("t").collect()] == pytest.approx(want, abs=1e-12)
    assert [r.turnover for r in bt.turnovers.orderBy("r").collect()] == pytest.approx(moved, abs=1e-12)
    assert B.schedule(study.days, F.lit(0), 28, 5).count() == 0


def test_evaluation_sections(spark, quiet, tmp_path):
    sections = evaluate(replace(quiet, start="2024-01-05", end="2025-01-20"))
    write_sections(sections, str(tmp_path / "report"), "parquet")
    read = lambda name: spark.read.parquet(str(tmp_path / "report" / name))
    assert read("ic").count() == read("long_short").count() == 0
    assert read("coverage").first().sparse and read("coverage").first().signal_coverage == 0.0
    assert {r.ticker: r.headlines for r in read("headlines").collect()} == {"A": 0, "B": 0, "C": 0}
    assert read("strategies").count() == 5 and read("returns").count() == 5 * 147
    document = read("calibration").first()
    assert document.sentiment is None and document.universe == ["A", "B", "C"]


def test_universe_sampling(spark, day):
    ticker_map = spark.createDataFrame(
        [(f"{c:010d}", t) for c, ts in enumerate([("AAA", "AA", "AA-P"), ("BB", "BA"), ("TOOLONG",), ("CC",), ("DD",)]) for t in ts], "cik string, ticker string"
    )
    assert {r.ticker for r in universe.shortest_tickers(ticker_map).collect()} == {"AA", "BA", "CC", "DD"}
    frame = spark.createDataFrame([(0, day("2024-06-30"), 10.0, 0), (1, day("2024-06-30"), 10.0, 1), (3, day("2024-06-30"), 0.0, 2), (4, day("2024-06-30"), 99.0, 3)],
                                  "cik bigint, end date, val double, pos int")
    pool = universe.candidates(frame, ticker_map)
    assert {r.ticker for r in pool.collect()} == {"AA", "BA", "DD"}
    as_of = day("2025-01-10")
    rows = [(t, as_of - dt.timedelta(days=k), 2.0) for t in ("AA", "DD") for k in range(0, 305)]
    rows += [("BA", as_of - dt.timedelta(days=k), 2.0) for k in range(8, 400)] + [("AA", as_of + dt.timedelta(days=1), 50.0)]
    prices = spark.createDataFrame(rows, "ticker string, date date, close double")
    splits = spark.createDataFrame([("AA", day("2024-09-01"), 3.0)], "ticker string, date date, ratio double")
    got = {r.ticker: r for r in universe.screen(pool, prices, splits, F.lit(as_of), 1.0, 100.0).collect()}
    assert got["AA"].cap == 60.0 and got["AA"].eligible
    assert got["BA"].cap is None and not got["BA"].eligible and not got["DD"].eligible
    many = spark.createDataFrame([(f"T{i}", str(i), 1.0, i % 3 != 0) for i in range(60)], "ticker string, cik string, cap double, eligible boolean")
    drawn = universe.draw(many, 10, 1)
    assert [r.position for r in drawn.orderBy("position").collect()] == list(range(1, 11))
    assert {r.ticker for r in drawn.collect()} != {r.ticker for r in universe.draw(many, 10, 2).collect()}
    row = universe.draw_summary(many, drawn, 10, 1, F.lit(as_of)).first()
    assert row.candidates == 60 and 10 <= row.screened < 60 and row.filled
    with pytest.raises(ValueError):
        universe.sample(frame, ticker_map, prices, None, F.lit(as_of), 3, 1, 1.0, 100.0)
    picked, told = universe.sample(frame, ticker_map, prices, splits, F.lit(as_of), 5, 1, 1.0, 100.0)
    assert [r.ticker for r in picked.collect()] == ["AA"] and told.first().candidates == 3 and not told.first().filled
    short = universe.draw(many, 50, 1)
    assert not universe.draw_summary(many, short, 50, 1, F.lit(as_of)).first().filled


def test_request_validation(spark):
    base = dict(budget=1e4, max_weight=0.35, lookback_days=365, news_days=7, max_headlines=40, risk_aversion=2.5, tau=0.05, view_scale=0.25, sentiment_weight=0.7)
    rows = [dict(base, run="ok", tickers="aapl, msft AAPL brk.b"), dict(base, run="one", tickers="AAPL"), dict(base, run="bad", tickers="AAPL ../etc"),
            dict(base, run="nan", tickers="A B", budget=float("nan"), tau=0.0)]
    df = spark.createDataFrame(rows, "run string, tickers string, budget double, max_weight double, lookback_days int, news_days int, max_headlines int, "
                                     "risk_aversion double, tau double, view_scale double, sentiment_weight double")
    got = {}
    for r in validation.violations(validation.normalized_requests(df)).collect():
        got.setdefault(r.run, []).append(r.violation)
    assert "ok" not in got and got["one"] == ["tickers:count in 2..20"] and got["bad"] == ["tickers:shape"]
    assert {v.split(":")[0] for v in got["nan"]} == {"budget", "tau"} and len(got["nan"]) == 2


def test_analysis(spark, tmp_path):
    now = dt.datetime(2025, 2, 3)
    names = {"A": (0.0005, 0.02), "B": (0.0002, 0.015), "C": (0.0007, 0.03)}
    prices = path(spark, **names).withColumn("run", F.lit("x"))
    prices = prices.unionByName(prices.where("ticker != 'C'").withColumn("run", F.lit("y")))
    rows = [(run, n, "Acme", "USD", 100.0, None if (run, n) == ("y", "B") else 1e6 * (i + 1), None, 0.4, 1.0)
            for run, ns in (("x", "ABC"), ("y", "AB")) for i, n in enumerate(ns)]
    rows += [("x", "D", "Gone", "USD", None, 1e6, None, 0.4, 1.0), ("z", "A", "Lone", "USD", 100.0, 1e6, None, 0.4, 1.0)]
    assets = spark.createDataFrame(rows, "run string, ticker string, name string, currency string, price double, shares double, shares_as_of date, fscore double, coverage double")
    heads = spark.createDataFrame([("A", f"title {k}", now - dt.timedelta(hours=k), 0.8, 0.1, 0.1) for k in range(6)],
                                  "ticker string, title string, published timestamp, positive double, negative double, neutral double")
    splits = spark.createDataFrame([], "ticker string, date date, ratio double")
    report = analysis.analyze(analysis.AnalysisInputs(assets, prices, heads, splits, F.lit(now)), AnalysisParams())
    got = {(r.run, r.ticker): r for r in report.assets.collect()}
    assert len(got) == 5 and got[("x", "A")].latest[0].title == "title 0"
    assert abs(got[("x", "B")].market_weight - 1 / 3) < 1e-12 and got[("y", "A")].market_weight == 0.5
    assert got[("x", "A")].view_return > got[("x", "A")].prior_return
    cap = {"x": 0.35, "y": 0.5}
    for run in ("x", "y"):
        weights = [r.weight for k, r in got.items() if k[0] == run]
        assert abs(sum(weights) - 1) < 1e-9 and max(weights) <= cap[run] + 1e-9
    told = {(r.run, r.warning) for r in report.warnings.collect()}
    assert ("y", "equal-weight prior: no share count for B") in told and ("x", "no headlines for B, C") in told
    assert ("y", "max weight infeasible; raised to 1/n") in told
    assert ("x", "D: dropped, no price") in told and any(run == "z" and "no result" in w for run, w in told)
    cash = {r.run: r for r in report.portfolio.collect()}
    assert all(abs(r.invested + r.cash_left - 10000) < 1e-6 for r in cash.values())
    assert report.benchmarks.count() == 8 and report.correlation.count() == 13
    # The report's order, its scored headlines, and the sections written and read back.
    order = [(r.run, r.weight) for r in report.assets.orderBy("run", "position").collect()]
    assert order == sorted(order, key=lambda x: (x[0], -x[1]))
    assert [(h.title, h.positive) for h in got[("x", "A")].latest[:2]] == [("title 0", 0.8), ("title 1", 0.8)] and got[("x", "A")].positive == 6
    write_sections(report.sections(), str(tmp_path / "report"))
    back = {name: spark.read.json(str(tmp_path / "report" / name)) for name in report.sections()}
    assert [(r.run, r.ticker) for r in back["assets"].orderBy("run", "position").collect()] == [(r.run, r.ticker) for r in report.assets.orderBy("run", "position").collect()]
    assert {(r.run, r.portfolio, len(r.weights)) for r in back["benchmarks"].collect()} == {(r.run, r.portfolio, {"x": 3, "y": 2}[r.run]) for r in report.benchmarks.collect()}


def test_requests_have_settings_of_their_own(spark):
    now = dt.datetime(2025, 2, 3)
    prices = path(spark, A=(0.0005, 0.02), B=(0.0002, 0.015), C=(0.0007, 0.03))
    runs = spark.createDataFrame([("plain",), ("poor",), ("short",), ("bad",), ("alone",)], "run string")
    assets = spark.createDataFrame([(n, n, "USD", 100.0 * (k + 1), 1e6, None, 0.4, 1.0) for k, n in enumerate("ABC")],
                                   "ticker string, name string, currency string, price double, shares double, shares_as_of date, fscore double, coverage double")
    heads = spark.createDataFrame([("A", f"title {k}", now - dt.timedelta(days=k, hours=1), 0.8, 0.1, 0.1) for k in range(20)],
                                  "ticker string, title string, published timestamp, positive double, negative double, neutral double")
    splits = spark.createDataFrame([], "ticker string, date date, ratio double")
    asked = spark.createDataFrame(
        [("plain", "A,B C", 10000.0, 0.6, 5, 40), ("poor", "A,B,C", 500.0, 0.6, 5, 40), ("short", "A,B", 10000.0, 0.7, 30, 3), ("bad", "A,B,C", 10000.0, 1.5, 5, 0), ("alone", "A", 10000.0, 0.6, 5, 40)],
        "run string, tickers string, budget double, max_weight double, news_days int, max_headlines int",
    )
    inputs = analysis.AnalysisInputs(runs.crossJoin(assets), runs.crossJoin(prices), heads, splits, F.lit(now))
    report = analysis.analyze(inputs, validation.normalized_requests(asked))
    got = {(r.run, r.ticker): r for r in report.assets.collect()}
    assert {run for run, _ in got} == {"plain", "poor", "short"} and {t for run, t in got if run == "short"} == {"A", "B"}
    assert got["plain", "A"].headlines == 5 and got["short", "A"].headlines == 3
    assert got["plain", "A"].weight == got["poor", "A"].weight and got["poor", "B"].target_value == got["poor", "B"].weight * 500
    for run, budget in (("plain", 10000), ("poor", 500)):
        assert sum(r.shares * r.price for k, r in got.items() if k[0] == run) <= budget
    told = {(r.run, r.warning) for r in report.warnings.collect()}
    assert ("bad", "no result: max_weight:in (0, 1.0]") in told and ("bad", "no result: max_headlines:in [1, 100]") in told and ("alone", "no result: tickers:count in 2..20") in told
    # The same as a single setting for all runs.
    same = analysis.analyze(replace(inputs, assets=inputs.assets.where("run = 'plain'")), AnalysisParams(max_weight=0.6, news_days=5))
    for r in same.assets.collect():
        assert abs(r.weight - got["plain", r.ticker].weight) < 1e-9 and r.shares == got["plain", r.ticker].shares


def test_analysis_settles_its_assets_once(spark):
    now = dt.datetime(2025, 2, 3)
    closes = path(spark, A=(0.0005, 0.02), B=(0.0002, 0.015), C=(0.0007, 0.03)).withColumn("run", F.lit("mixed"))
    closes = closes.unionByName(closes.where("ticker != 'C'").withColumn("run", F.lit("plain")))
    rows = [("mixed", "A", 100.0, 2e6), ("mixed", "B", 100.0, 6e6), ("mixed", "C", None, 5e6), ("mixed", "D", 50.0, 9e6),
            ("plain", "A", 100.0, 2e6), ("plain", "B", 100.0, 6e6)]
    assets = spark.createDataFrame([(r, t, t, "USD", p, s, None, None, None) for r, t, p, s in rows],
                                   "run string, ticker string, name string, currency string, price double, shares double, shares_as_of date, fscore double, coverage double")
    heads = spark.createDataFrame([], "ticker string, title string, published timestamp, positive double, negative double, neutral double")
    splits = spark.createDataFrame([], "ticker string, date date, ratio double")
    report = analysis.analyze(analysis.AnalysisInputs(assets, closes, heads, splits, F.lit(now)), AnalysisParams())
    got = {(r.run, r.ticker): r for r in report.assets.collect()}
    # C has history but no price, D a price but no history: the run is as if they were not asked for.
    assert set(got) == {(run, t) for run in ("mixed", "plain") for t in "AB"}
    for t, weight in (("A", 0.25), ("B", 0.75)):
        mixed, plain = got[("mixed", t)], got[("plain", t)]
        assert abs(mixed.market_weight - weight) < 1e-12
        assert abs(mixed.prior_return - plain.prior_return) < 1e-12 and abs(mixed.weight - plain.weight) < 1e-12
    told = {r.warning for r in report.warnings.where("run = 'mixed'").collect()}
    assert {"C: dropped, no price", "D: dropped, no price history"} <= told


def test_one_failing_portfolio_leaves_the_others(spark):
    nan = float("nan")
    rows = [("good", "A", 0.05, [0.04, 0.01]), ("good", "B", 0.03, [0.01, 0.02]), ("bad", "A", 0.05, [nan, 0.0]), ("bad", "B", nan, [0.0, 0.02])]
    assets = spark.createDataFrame(rows, "run string, ticker string, pi double, sigma array<double>")
    said = spark.createDataFrame([], "run string, view_id string, ticker string, pick double, q double, omega double")
    post = portfolio.posterior(assets, said, "run", 0.05)
    assert {r.run for r in post.collect()} == {"good"}
    solved = portfolio.optimal_weights(post, "run", 2.5, 0.9).collect()
    assert {r.run for r in solved} == {"good"} and abs(sum(r.weight for r in solved) - 1) < 1e-9


def test_windows_over_streams(spark, tmp_path):
    now = dt.datetime(2024, 1, 8)
    rows = [("A", "gain today", now + dt.timedelta(days=k), 0.5, 0.0, 0.5) for k in range(20)] + [("B", "loss today", now, 0.0, 0.5, 0.5)]
    schema = "ticker string, text string, published timestamp, positive double, negative double, neutral double"
    landed = str(tmp_path / "in")
    for part in (rows[:5], rows[5:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(landed)
    stream = lambda: spark.readStream.schema(schema).parquet(landed)

    def drain(df, name):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name)

    weeks = {(r.ticker, str(r.a)): r.headlines for r in drain(H.closed_weeks(stream()), "weeks").collect()}
    # The last day seen is the 27th; with three days of lateness only weeks ended by the 24th are final.
    assert weeks == {("A", "2024-01-08"): 7, ("B", "2024-01-08"): 1, ("A", "2024-01-15"): 7}
    slid = {(r.ticker, str(r.as_of)): r.headlines for r in drain(H.sliding_news(stream()), "slid").collect()}
    assert slid[("A", "2024-01-09")] == 1 and slid[("A", "2024-01-20")] == 7 and ("A", "2024-01-08") not in slid

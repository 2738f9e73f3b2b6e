import datetime as dt
import math

from pyspark.sql import functions as F

from tiltlab.operators import longshort, signals
from tiltlab.operators import panel as P
from tiltlab.operators import sentiment as S

START = dt.date(2025, 3, 3)


def prices(spark, **closes):
    rows = [
        (name, START + dt.timedelta(days=k), float(px))
        for name, path in closes.items() for k, px in enumerate(path) if px is not None
    ]
    return spark.createDataFrame(rows, "ticker string, date date, close double")


def days(spark, path):
    return P.calendar(prices(spark, B=path).drop("ticker"))


def test_excess_returns_subtract_benchmark(spark):
    panel = P.indexed_prices(prices(spark, A=[10, 11, 13.31]), days(spark, [100, 110, 121]))
    rows = panel.select("t", P.forward_excess([2]).alias("f")).select("t", F.inline("f")).collect()
    assert abs({r.t: r.forward for r in rows}[0] - (math.log(1.331) - math.log(1.21))) < 1e-12
    assert {r.t: r.forward for r in rows}[1] is None


def test_gaps_are_not_neighbours(spark):
    d = days(spark, [1, 1, 1, 1])
    panel = P.indexed_prices(prices(spark, A=[10, None, 12, 13]), d)
    got = {r.t: r.simple_return for r in P.with_returns(panel).collect()}
    assert got[0] is None and got[2] is None and abs(got[3] - (13 / 12 - 1)) < 1e-12
    dense = P.price_panel(prices(spark, A=[10, None, 12, 13]), d).orderBy("t").collect()
    assert [r.close for r in dense] == [10.0, None, 12.0, 13.0]


def test_trailing_windows_need_every_return(spark):
    panel = P.indexed_prices(prices(spark, A=[1, 2, 3, 4, 5], B=[1, 2, None, 4, 5]), days(spark, [1] * 5))
    full = {(r.ticker, r.t) for r in P.trailing_complete(panel, 2).collect()}
    assert full == {("A", 2), ("A", 3), ("A", 4)}


def test_aligned_returns_use_common_dates(spark):
    got = P.aligned_log_returns(prices(spark, A=[1.0, 2.0, 4.0], B=[1.0, None, 3.0])).collect()
    assert {(r.ticker, round(math.exp(r.ret), 9)) for r in got} == {("A", 4.0), ("B", 3.0)}


def test_market_cap_corrects_later_splits(spark):
    points = spark.createDataFrame([("A", 90.0, 1000.0, dt.date(2025, 5, 1)), ("A", 90.0, 1000.0, dt.date(2025, 6, 1)), ("A", 90.0, 1000.0, None)],
                                   "ticker string, close double, shares double, shares_as_of date")
    splits = spark.createDataFrame([("A", dt.date(2025, 6, 1), 1 / 30)], "ticker string, date date, ratio double")
    got = [r.market_cap for r in P.market_cap(points, splits).collect()]
    assert sorted(round(x, 6) for x in got) == [3000.0, 90000.0, 90000.0]


def test_cap_weights_fall_back_for_the_whole_group(spark):
    rows = spark.createDataFrame([("g", "A", 1.0), ("g", "B", 3.0), ("h", "A", 1.0), ("h", "B", None)], "g string, ticker string, market_cap double")
    got = {(r.g, r.ticker): r.market_weight for r in P.cap_weights(rows, ("g",)).collect()}
    assert got == {("g", "A"): 0.25, ("g", "B"): 0.75, ("h", "A"): 0.5, ("h", "B"): 0.5}


def headlines(spark, rows):
    return spark.createDataFrame(rows, "ticker string, date date, positive double, negative double, neutral double")


def test_no_same_day_headlines(spark):
    d = days(spark, [1, 1, 1, 1])
    news = S.sentiment_panel(headlines(spark, [("A", START, 1.0, 0.0, 0.0), ("A", START + dt.timedelta(1), 0.0, 1.0, 0.0)]), d, 7, 1)
    got = {r.t: r.score for r in news.collect()}
    assert 0 not in got and got[1] == 1.0 and got[2] < 1.0


def test_window_summary_matches_definition(spark):
    rows = [("A", START + dt.timedelta(k), 0.1 * (k + j) % 0.7, 0.2, 0.3) for k in range(5) for j in range(3)]
    d = days(spark, [1] * 9)
    got = {r.t: r for r in S.sentiment_panel(headlines(spark, rows), d, 4, 3).collect()}
    for t in got:
        seen = [(t - (r[1] - START).days, r[2] - r[3]) for r in rows if 1 <= t - (r[1] - START).days <= 4]
        w = [0.5 ** (a / 3) for a, _ in seen]
        mu = sum(x * s for x, (_, s) in zip(w, seen)) / sum(w)
        sd = (sum(x * (s - mu) ** 2 for x, (_, s) in zip(w, seen)) / sum(w)) ** 0.5
        n = sum(w) ** 2 / sum(x * x for x in w)
        assert abs(got[t].score - mu) < 1e-12 and abs(got[t].dispersion - sd) < 1e-9
        assert abs(got[t].effective_count - n) < 1e-9
        assert abs(got[t].confidence - n / (n + 6) * (1 - 0.5 * min(sd, 1))) < 1e-9
    same = [("A", START + dt.timedelta(k), 0.6, 0.1, 0.3) for k in range(5)]
    assert all(r.dispersion < 1e-12 for r in S.sentiment_panel(headlines(spark, same), d, 4, 3).collect())


def live(spark, rows):
    now = dt.datetime(2025, 3, 3, 12)
    return spark.createDataFrame(
        [(k, now - dt.timedelta(hours=h), max(s, 0.0), max(-s, 0.0), 1 - abs(s)) for k, h, s in rows],
        "ticker string, published timestamp, positive double, negative double, neutral double",
    )


def test_live_summary(spark):
    now = F.lit("2025-03-03 12:00:00").cast("timestamp")
    rows = [("recent", 1, 0.9), ("recent", 24 * 14, -0.9)]
    rows += [("few", 1, 0.5)] * 2 + [("many", 1, 0.5)] * 20 + [("mixed", 1, 0.9 if i % 2 else -0.9) for i in range(20)]
    names = spark.createDataFrame([("recent",), ("few",), ("many",), ("mixed",), ("none",)], "ticker string")
    got = {r.ticker: r for r in S.live_summary(live(spark, rows), now, names).collect()}
    assert got["recent"].score > 0.7
    assert got["mixed"].confidence < got["many"].confidence < 1.0 and got["few"].confidence < got["many"].confidence
    assert got["none"].score == 0.0 and got["none"].confidence == 0.0 and got["none"].headlines == 0


def test_surprise_needs_history(spark):
    rows = [("A", t, 0.2) for t in range(29)] + [("A", 29, 0.5)]
    got = {r.t: r.surprise for r in signals.with_surprise(spark.createDataFrame(rows, "ticker string, t int, level double")).collect()}
    assert got[19] is None and abs(got[20]) < 1e-12 and abs(got[29] - 0.3) < 1e-12


def test_residual_removes_the_regressor(spark):
    rows = [(1, f"n{i}", 2.0 * i + 1.0, float(i)) for i in range(6)] + [(2, f"n{i}", float(i), 1.0) for i in range(6)] + [(3, "n0", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "t int, ticker string, y double, x double")
    got = {(r.t, r.ticker): r.residual for r in signals.residual_on(df, "y", "x").collect()}
    assert all(abs(got[(1, f"n{i}")]) < 1e-12 for i in range(6))
    assert abs(got[(2, "n5")] - 2.5) < 1e-12 and got[(3, "n0")] is None


def long_short(spark, returns, values):
    """returns, values: ticker -> list per day."""
    rows = [("s", t, name, values[name][t], returns[name][t]) for name in values for t in range(len(values[name]))]
    return spark.createDataFrame(rows, "signal string, t int, ticker string, value double, next_return double")


def test_perfect_signal_earns_the_spread(spark):
    names = [f"S{i}" for i in range(6)]
    points = long_short(spark, {n: [(i - 2.5) * 0.01] * 100 for i, n in enumerate(names)}, {n: [float(i)] * 100 for i, n in enumerate(names)})
    book = longshort.daily_book(longshort.leg_weights(points), spark.range(100).select(F.col("id").cast("int").alias("t")))
    row = longshort.summary(book).first()
    assert abs(row.daily_gross - 0.04) < 1e-9 and row.avg_daily_turnover == 0.0 and row.avg_names_per_leg == 2.0
    assert row.break_even_cost_bps is None and len(row.net) == 3


def test_turnover_skips_builds_but_counts_going_flat(spark):
    names = [f"S{i}" for i in range(6)]
    values = {n: [float(i), None, float(i), float(-i)] for i, n in enumerate(names)}
    points = long_short(spark, {n: [0.01] * 4 for n in names}, values)
    book = longshort.daily_book(longshort.leg_weights(points), spark.range(4).select(F.col("id").cast("int").alias("t")))
    got = {r.t: (r.turnover, r.gross) for r in book.collect()}
    assert got[0][0] is None and got[1] == (2.0, 0.0) and got[2][0] is None and got[3][0] == 4.0

import datetime as dt
import random

from pyspark.sql import functions as F

from tiltlab.operators import compare, headlines, sentiment

NOW = dt.datetime(2025, 3, 10)


def feed(spark, rows):
    return spark.createDataFrame(
        [(t, title, NOW - dt.timedelta(hours=h), i) for i, (t, title, h) in enumerate(rows)],
        "ticker string, title string, published timestamp, pos int",
    )


def test_live_headlines(spark):
    first = feed(spark, [("TSLA", "Old TSLA news here", 24 * 9), ("TSLA", "TSLA jumps again", 5), ("TSLA", "Markets are quiet today", 1)])
    second = feed(spark, [("TSLA", "tsla JUMPS again!", 1), ("TSLA", "Tesla opens a plant", 2), ("TSLA", "Old TSLA news here", 3)])
    names = spark.createDataFrame([("TSLA", "Tesla, Inc.")], "ticker string, name string")
    out = headlines.live_headlines(headlines.union_feeds(first, second), names, F.lit(NOW), 7, 2).collect()
    # The stale copy does not hide the fresh one; the syndicated copy of the second feed is dropped.
    assert {r.title for r in out} == {"Tesla opens a plant", "Old TSLA news here"}


def test_relevant_titles_stay_where_they_are_read(spark):
    number = F.col("id")
    title = F.when(number % 3 == 0, "Acme opens a plant").when(number % 3 == 1, "HOT again").otherwise("Quiet markets")
    ticker = F.when(number % 10 == 0, "ACM").when(number % 10 == 1, None).otherwise("HOT")
    rows = spark.range(0, 30_000, 1, 12).select("id", ticker.alias("ticker"), title.alias("title"))
    names = rows.select("ticker").distinct().withColumn("name", F.when(F.col("ticker") == "ACM", "Acme Inc."))
    want = [n for n in range(30_000) if (n % 3 == 0 and n % 10 == 0) or (n % 3 == 1 and n % 10 > 1)]

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "64k",  # less than what the names are read from
        "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        place = F.spark_partition_id().alias("p")
        out = headlines.relevant(rows, names)
        assert out.columns == ["ticker", "id", "title"] and sorted(r.id for r in out.collect()) == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        assert out.select(place).distinct().count() == 12

        # A list too long to be sent around: the hot ticker is dealt to several tasks.
        long = headlines.relevant(rows, names, short=0)
        assert long.columns == out.columns and sorted(r.id for r in long.collect()) == want
        assert long.groupBy(place).count().agg(F.max("count")).first()[0] < len(want) / 2
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def fold(rows, per_week):
    """One pass per ticker over weeks and positions."""
    seen, out = {}, []
    weeks = {}
    for ticker, title, date, pos in rows:
        weeks.setdefault((date - dt.timedelta(days=date.weekday()), ticker), []).append((pos, title))
    for (week, ticker) in sorted(weeks):
        taken = 0
        for pos, title in sorted(weeks[(week, ticker)]):
            if taken == per_week:
                break
            if title.lower() in seen.setdefault(ticker, set()):
                continue
            seen[ticker].add(title.lower())
            out.append((ticker, pos))
            taken += 1
    return sorted(out)


def test_weekly_cap_matches_the_ordered_fold(spark):
    rng = random.Random(8)
    rows = []
    for pos in range(600):
        ticker = "HOT" if rng.random() < 0.6 else rng.choice("AB")
        rows.append((ticker, rng.choice("abcdefghijklmnop") + rng.choice(["", "x"]), dt.date(2025, 1, 1) + dt.timedelta(days=rng.randint(0, 50)), pos))
    df = spark.createDataFrame(rows, "ticker string, title string, date date, pos int")
    for cap in (1, 2, 4):
        got = sorted((r.ticker, r.pos) for r in headlines.weekly_cap(df, cap).collect())
        assert got == fold(rows, cap)


def test_weekly_cap_builds_without_running_and_reaches_every_copy(spark):
    # Week n repeats all titles of the weeks before it, then brings two of its own at its end.
    rows = []
    for n in range(12):
        for k, title in enumerate([f"t{m}" for m in range(2 * n)] + [f"t{2 * n}", f"t{2 * n + 1}", "late one", "late two"]):
            rows.append(("T", title, dt.date(2025, 1, 6) + dt.timedelta(days=7 * n), 1000 * n + k))
    rows.append((None, "t0", dt.date(2025, 1, 6), 0))
    df = spark.createDataFrame(rows, "ticker string, title string, date date, pos int")
    spark.sparkContext.setJobGroup("build", "build")
    capped = headlines.weekly_cap(df, 2)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("build")) == []
    got = sorted(((r.ticker or ""), r.pos) for r in capped.collect())
    assert got == [("", 0)] + sorted(fold(rows[:-1], 2))


def test_week_windows_start_on_monday(spark, day):
    got = [(r.a, r.b) for r in headlines.week_windows("2025-01-01", "2025-01-13", spark).collect()]
    assert got == [(day("2024-12-30"), day("2025-01-06")), (day("2025-01-06"), day("2025-01-13"))]


def test_lexicon_scores(spark):
    df = spark.createDataFrame([("Profit BEATS, shares fall",), ("nothing here",)], "text string")
    got = [tuple(r)[1:] for r in sentiment.lexicon_scorer()(df).collect()]
    assert got == [(0.5, 0.25, 0.25), (0.0, 0.0, 1.0)]


def test_agreement(spark):
    rng = random.Random(1)
    rows, a, b = [], [], []
    for i in range(250):
        p, q = sorted([rng.random(), rng.random()])
        r, s = sorted([rng.random(), rng.random()])
        rows += [("ref", str(i), p, q - p, 1 - q), ("new", str(i), r, s - r, 1 - s)]
        a.append((p, q - p, 1 - q))
        b.append((r, s - r, 1 - s))
    df = spark.createDataFrame(rows, "model string, text string, positive double, negative double, neutral double")
    got = {r.model: r for r in compare.agreement(df, "ref").collect()}
    diffs = sorted(abs((x[0] - x[1]) - (y[0] - y[1])) for x, y in zip(a, b))
    assert abs(got["new"].p99_abs_score_diff - diffs[int(249 * 0.99)]) < 1e-12
    assert abs(got["new"].max_abs_score_diff - diffs[-1]) < 1e-12 and abs(got["new"].mean_abs_score_diff - sum(diffs) / 250) < 1e-12
    label = lambda v: max(range(3), key=lambda k: (v[k], k))
    assert abs(got["new"].label_agreement - sum(label(x) == label(y) for x, y in zip(a, b)) / 250) < 1e-12
    assert got["ref"].label_agreement == 1.0 and abs(got["ref"].score_correlation - 1) < 1e-12


def test_percentile_is_exact_at_any_size(spark):
    for n in (1, 7, 99_999, 100_001, 250_000):
        # A permutation of n values, a third of them equal.
        diff = F.when(F.col("id") % 3 == 0, 0.25).otherwise((F.col("id") * 7919 % n) / n * 2)
        pairs = spark.range(n).select(F.lit("m").alias("model"), diff.cast("double").alias("diff"))
        stats = pairs.groupBy("model").agg(F.count(F.lit(1)).alias("texts"))
        want = sorted(r.diff for r in pairs.collect())[int((n - 1) * 0.99)]
        assert compare._p99(pairs, stats).first().p99_abs_score_diff == want

import json

import pytest
from pyspark.sql import functions as F

from tiltlab.operators.fundamentals import current_fundamentals, facts_slice, filed_by
from tiltlab.sources import filings, news, prices, reports, scores

DAY = 86400


def chart(result):
    return {"chart": {"result": result, "error": None}}


@pytest.fixture(scope="module")
def charts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("charts")
    t0 = 1_748_736_000  # 2025-06-01
    raw = {
        "meta": {"currency": "USD", "longName": "Acme Inc.", "gmtoffset": -3600},
        "timestamp": [t0 + 7200, t0 + DAY + 7200, t0 + 2 * DAY + 7200, t0 + 2 * DAY + 9000],
        "indicators": {"quote": [{"close": [10.0, None, 12.0, 13.0]}]},
        "events": {"splits": {"1": {"date": t0 + DAY + 7200, "numerator": 1.0, "denominator": 30.0}, "2": {"date": t0, "numerator": 1.0, "denominator": 0.0}}},
    }
    adjusted = {
        "meta": {"currency": "USD", "shortName": "Beta", "regularMarketPrice": 7.5},
        "timestamp": [t0, t0 + DAY],
        "indicators": {"quote": [{"close": [1.0, 2.0]}], "adjclose": [{"adjclose": [0.5, -1.0]}]},
    }
    (folder / "ACME.json").write_text(json.dumps(chart([adjusted, raw]), indent=1))
    (folder / "BETA.json").write_text(json.dumps(chart([adjusted])))
    (folder / "GONE.json").write_text(json.dumps({"chart": {"result": None, "error": "not found"}}))
    return prices.read_charts(spark, str(folder)).cache()


def test_chart_prices(charts, day):
    got = {(r.ticker, r.date): r.close for r in prices.chart_prices(charts).collect()}
    assert got == {
        ("ACME", day("2025-06-01")): 10.0, ("ACME", day("2025-06-03")): 13.0, ("BETA", day("2025-06-01")): 0.5,
    }
    splits = prices.chart_splits(charts).collect()
    assert [(s.ticker, s.date, round(s.ratio, 6)) for s in splits] == [("ACME", day("2025-06-02"), round(1 / 30, 6))]
    named = {r.ticker: (r.name, r.last_price) for r in prices.instruments(charts).collect()}
    assert named == {"ACME": ("Acme Inc.", 13.0), "BETA": ("Beta", 7.5)}


def test_filings(spark, tmp_path, day):
    (tmp_path / "map.json").write_text(json.dumps({"0": {"cik_str": 320, "ticker": "acme"}, "1": {"cik_str": 7, "ticker": "BETA"}}))
    names = filings.read_ticker_map(spark, str(tmp_path / "map.json"))
    assert {(r.ticker, r.cik) for r in names.collect()} == {("ACME", "0000000320"), ("BETA", "0000000007")}
    wanted = spark.createDataFrame([("ACME",), ("ETF",)], "ticker string")
    assert {(r.ticker, r.cik) for r in filings.lookup_filers(wanted, names).collect()} == {("ACME", "0000000320"), ("ETF", None)}

    folder = tmp_path / "facts"
    folder.mkdir()
    usd = [
        {"start": "2024-01-01", "end": "2024-12-31", "val": 100, "form": "10-K", "filed": "2025-02-01", "accn": "x"},
        {"start": "2024-01-01", "end": "2024-12-31", "val": 110, "form": "10-K/A", "filed": "2025-05-01"},
    ]
    doc = {"entityName": "Acme", "facts": {"us-gaap": {"Revenues": {"label": "l", "units": {"USD": usd}}}}}
    (folder / "CIK0000000320.json").write_text(json.dumps(doc))
    facts = filings.read_facts(spark, str(folder))
    assert [(r.cik, r.tag, r.pos, r.val) for r in facts.orderBy("pos").collect()] == [("0000000320", "Revenues", 0, 100.0), ("0000000320", "Revenues", 1, 110.0)]
    assert filings.read_entities(spark, str(folder)).first().entity_name == "Acme"
    assert facts_slice(facts, "us-gaap", "Revenues", "USD").count() == 2 and facts_slice(facts, "dei", "Revenues", "USD").count() == 0
    assert filed_by(facts, F.lit("2025-03-01").cast("date")).count() == 1
    as_of = spark.createDataFrame([("0000000320", day("2025-09-01"))], "cik string, as_of date")
    assert current_fundamentals(facts, as_of).first().fiscal_year_end == day("2024-12-31")

    (tmp_path / "frame.json").write_text(json.dumps({"data": [{"cik": 320, "end": "2024-06-30", "val": 5e6, "accn": "a"}]}))
    assert tuple(filings.read_share_frame(spark, str(tmp_path / "frame.json")).first()) == (320, day("2024-06-30"), 5e6, 0)


def item(title, stamp=None, source=None, link=None):
    tags = {"title": title, "pubDate": stamp, "source": source, "link": link}
    return "<item>" + "".join(f"<{k}>{v}</{k}>" for k, v in tags.items() if v) + "</item>"


def test_feeds(spark, tmp_path):
    items = [
        item("Ferry line adds winter sailings | Coast Post", "3 Mar 2021 07:45 EST", "Coast Post", "https://news.test/1"),
        item("Tea &amp;lt; coffee, says poll", "Wed, 03 Mar 2021 23:45:10 -0230"),
        item("Ferry late", "3 Mar 2021 07:45 EST", "Coast Post"),
        item("The stamp is no date", "last Wednesday", "Coast Post"),
        item("There is no stamp at all"),
    ]
    (tmp_path / "FRY.xml").write_text(f"<rss><channel>{''.join(items)}</channel></rss>")
    (tmp_path / "NIL.xml").write_text("<rss><channel></channel></rss>")
    got = {r.title: (r.ticker, r.source, r.url, str(r.published)) for r in news.read_feed(spark, str(tmp_path), "Default").collect()}
    assert got == {
        "Ferry line adds winter sailings": ("FRY", "Coast Post", "https://news.test/1", "2021-03-03 12:45:00"),
        "Tea < coffee, says poll": ("FRY", "Default", "", "2021-03-04 02:15:10"),
    }
    assert news.read_feed(spark, str(tmp_path / "absent"), "x").count() == 0


def test_malformed_items_and_documents_drop_alone(spark, charts):
    good = item("Three words here", "3 Mar 2021 07:45 EST")
    bodies = [
        ("A", "<rss>" + good + "<item><title>An open tag here<pubDate>3 Mar 2021 07:45 EST</pubDate></item>" + good.replace("Three", "Four") + "<item/>"),
        ("B", good.replace("<item>", "<item\n kind='x'>").replace("Three words", "<![CDATA[Q & A]]>")),
        ("C", None),
        ("D", "no feed"),
    ]
    got = news.parse_feeds(spark.createDataFrame(bodies, "ticker string, body string"), "Default")
    assert {(r.ticker, r.pos, r.title) for r in got.collect()} == {("A", 0, "Three words here"), ("A", 2, "Four words here"), ("B", 0, "Q & A here")}

    docs = [("OK", json.dumps(chart([{"meta": {}, "timestamp": [], "indicators": {}}]))), ("CUT", '{"chart": {"result"'), ("NULL", None), ("NONE", json.dumps(chart([])))]
    docs = spark.createDataFrame(docs + [("SAID", json.dumps({"chart": {"result": None, "error": {"code": "Not Found"}}}))], "ticker string, body string")
    assert {r.ticker for r in prices.parse_charts(docs).collect()} == {"OK"}
    assert {r.ticker: r.reason for r in prices.chart_failures(docs).collect()} == {
        "CUT": "malformed document", "NULL": "malformed document", "NONE": "no chart", "SAID": '{"code":"Not Found"}'
    }


def test_facts_are_cut_to_the_wanted_before_they_are_exploded(spark):
    fact = {"end": "2024-12-31", "val": 1, "form": "10-K", "filed": "2025-02-01"}
    doc = {"cik": 5, "facts": {x: {t: {"units": {"USD": [fact]}} for t in "abc"} for x in "xyz"}}
    docs = spark.createDataFrame([(None, json.dumps(doc)), ("7", "{}"), ("8", None), ("9", "{")], "cik string, body string")
    found = filings.parse_facts(docs, {"x": ["a", "b"], "z": ["c", "none"]})
    assert {(r.cik, r.taxonomy, r.tag) for r in found.collect()} == {("0000000005", "x", "a"), ("0000000005", "x", "b"), ("0000000005", "z", "c")}
    assert filings.parse_facts(docs).count() == 9
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    last = max(k for k, line in enumerate(plan) if "Generate explode" in line)  # plans read upwards: the first to run
    cuts = [k for k, line in enumerate(plan) if "map_filter" in line]
    assert cuts and all("map_filter" in plan[k] for k in cuts) and min(cuts) >= last


def test_headline_csv(spark, tmp_path, day):
    rows = [
        ["PUBLISHED", "headline", "Stock", "publisher"],
        ["2020-11-09T23:30:00-02:00", '"Mill, reopened"', "lum", "Wire"],
        ["2020-11-10 08:00:00", "MILL REOPENED!", "LUM", "Other"],  # the same title on the same day
        ["2020-11-11 00:30:00 +01:00", "Kiln sold at auction", "LUM"],  # ragged
        ["2020-11-11", "Mill reopened", "LUM", "Late"],  # the same title, a day later
        ["", "No day given", "LUM", "Wire"],
        ["2020-11-12", "", "LUM", "Wire"],
        ["2020-11-12", "A firm nobody asked for", "ZZZ", "Wire"],
    ]
    path = tmp_path / "table.csv"
    path.write_text("\n".join(",".join(r) for r in rows) + "\n")
    wanted = spark.createDataFrame([("LUM",), ("NONE",)], "ticker string")
    got = sorted(tuple(r) for r in news.read_headline_csv(spark, str(path), wanted).collect())
    assert got == [
        ("LUM", day("2020-11-10"), "Kiln sold at auction", "CSV"),
        ("LUM", day("2020-11-10"), "Mill, reopened", "Wire"),
        ("LUM", day("2020-11-11"), "Mill reopened", "Late"),
    ]
    assert news.read_headline_csv(spark, str(path)).count() == 4

    path.write_text('date,title,symbol\n2020-11-09,"Two\nlines",LUM\n')
    assert [r.title for r in news.read_headline_csv(spark, str(path), quoted_breaks=True).collect()] == ["Two\nlines"]
    path.write_text("date,symbol\n2020-11-09,LUM\n")
    with pytest.raises(ValueError):
        news.read_headline_csv(spark, str(path))


def test_score_store(spark, tmp_path):
    lines = tmp_path / "scores.jsonl"
    lines.write_text('{"t":"aa","p":[0.1,0.2,0.7]}\n{"t":"bbb","p":[0.3,0.3,0.4]}\n{"t":"aa","p":[0.5,0.2,0.3]}\n{"t":"cc","p":[0.1\n{"t":"dd","p":[1.0]}\n')
    got = {r.text: r.positive for r in scores.read_score_lines(spark, str(lines)).collect()}
    assert got == {"aa": 0.5, "bbb": 0.3}


def test_reports_round_trip(spark, tmp_path, day):
    assert reports.preset_universe(spark, "large").count() == 24 and reports.preset_universe(spark, "small").count() == 34
    signal = "signal string, kappa double, se double, t double, dates bigint, observations bigint"
    coefficients = spark.createDataFrame([(reports.LEVEL, 0.5, 0.2, 2.5, 100, 900)], signal)
    sections = spark.createDataFrame([(reports.LEVEL, 1), (reports.LEVEL, 2)], "signal string, t int")
    days = spark.createDataFrame([(k, day(f"2025-01-0{k + 1}")) for k in range(4)], "t int, date date")
    names = spark.createDataFrame([("B",), ("A",)], "ticker string")
    doc = reports.calibration_document(coefficients, sections, days, names, 21, 3)
    reports.write_sections({"calibration": doc, "names": names}, str(tmp_path / "out"))
    back = reports.read_calibration(spark, str(tmp_path / "out" / "calibration")).first()
    assert back.sentiment.kappa == 0.5 and back.fundamentals is None and back.universe == ["A", "B"]
    assert (back.sample_start, back.sample_end, back.horizon_days) == (day("2025-01-02"), day("2025-01-03"), 21)

from pyspark.sql import functions as F

from tiltlab.functions import text


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_company_names(spark):
    want = {
        "NORTHWIND TRADERS LIMITED": "Northwind Traders",
        "Pine & Sons Co., Ltd.": "Pine & Sons",
        "the Harbour Light Holdings plc": "The Harbour Light",  # only trailing suffixes go
        "Group Group": "Group",
        "Incline Village Bancorp": "Incline Village Bancorp",  # a suffix is a whole word
        "": "",
    }
    assert values(spark, text.clean_company_name(F.col("x")), [(k,) for k in want]) == list(want.values())


def test_relevance(spark):
    kestrel, energy, elm = ("KSTL", "Kestrel Marine Corp"), ("EBRK", "Energy of Brookfield Inc"), ("ELM", "Elm Co")
    cases = {
        kestrel: [("The kestrel yard reopens", True), ("Kestrels over the marsh", False), ("Down 4%: KSTL, again", True),
                  ("a kstl typed small", False), ("OLD-KSTL is another symbol", False), (None, None)],
        energy: [("Energy bills rise", False), ("Who owns energy of brookfield now?", True), ("Brookfield council meets", False)],
        elm: [("An elm falls", True), ("Elmwood school fair", False)],  # the whole name counts, however short
        ("META", None): [("instagram outage", True), ("A metaphor", False)],
        ("Q", None): [("Q&A with readers", True), ("", False)],
    }
    rows = [(title, ticker, name, want) for (ticker, name), titles in cases.items() for title, want in titles]
    df = spark.createDataFrame(rows, "title string, ticker string, name string, want boolean")
    terms = text.relevance_terms(F.col("ticker"), F.col("name"))
    out = df.select("title", "want", text.is_relevant(F.col("title"), F.col("ticker"), terms).alias("got")).collect()
    assert [(r.title, r.got) for r in out] == [(r.title, r.want) for r in out]


def test_keys_entities_and_publishers(spark):
    assert len(set(values(spark, text.dedupe_key(F.col("x")), [("Acme beats!",), ("acme BEATS",)]))) == 1
    assert values(spark, text.decode_entities(F.col("x")), [("A &amp; B &amp;lt; &#39;c&#39;",)]) == ["A & B < 'c'"]
    rows = [("Acme falls - Some Wire", "Some Wire"), ("Acme falls | – Wire", "Wire"), ("Acme falls", "Wire"), ("Acme falls", None)]
    got = values(spark, text.strip_publisher(F.col("x"), F.col("s")), rows, "x string, s string")
    # Separators of one run are removed together with the spaces around the run.
    assert got == ["Acme falls", "Acme falls |", "Acme falls", "Acme falls"]


def test_dates(spark, day):
    want = {
        "1999-12-31": "1999-12-31",
        "1999-12-31 23:59:59": "1999-12-31",
        "1999-12-31T23:59:59.5Z": "1999-12-31",
        "1999-12-31T19:00:00-05:30": "2000-01-01",
        "1999-12-31 19:00:00 -05:30": "2000-01-01",
        "1999-12-31 19:00:00 -0530": "2000-01-01",
        "2000-01-01 02:00:00 +09:00": "1999-12-31",
        "2000-01-01 02:00:00 UTC": "2000-01-01",
        "2000-02-30": None,
        "31/12/1999": None,
        "": None,
    }
    assert values(spark, text.parse_date(F.col("x")), [(k,) for k in want]) == [v and day(v) for v in want.values()]


def test_feed_timestamps(spark):
    want = {
        "Wed, 3 Mar 2021 07:45:10 GMT": "2021-03-03 07:45:10",
        "3 Mar 2021 07:45 EST": "2021-03-03 12:45:00",
        "Wed, 03 Mar 2021 23:45:10 PDT": "2021-03-04 06:45:10",
        "03 Mar 2021 00:15 +0100": "2021-03-02 23:15:00",
        "03 Mar 2021 00:15 UT": "2021-03-03 00:15:00",
        "Wed, 33 Mar 2021 00:15:00 GMT": None,
        "2021": None,
    }
    got = values(spark, F.date_format(text.feed_timestamp(F.col("x")), "yyyy-MM-dd HH:mm:ss"), [(k,) for k in want])
    assert got == list(want.values())


def test_tickers_and_frames(spark, day):
    assert values(spark, text.ticker_list(F.col("x")), [("aapl, msft AAPL brk.b",)]) == [["AAPL", "MSFT", "BRK-B"]]
    rows = [(day("2024-10-05"),), (day("2024-09-01"),), (day("2024-02-15"),), (day("2024-09-28"),)]
    assert values(spark, text.share_frame(F.col("x")), rows, "x date") == ["CY2024Q2I", "CY2024Q1I", "CY2023Q3I", "CY2024Q2I"]

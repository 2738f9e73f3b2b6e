"""Chart, filing and feed documents written from the warehouse tables, for jobs that parse such documents.

Every document is bounded: a part's lines, a customer's orders, or a fixed run of keys. They carry what landed documents do:
nulls in series, days with several points, unusable splits, failed and cut-off documents, unnamed filers, items without date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltlab.sources.tables import table

RUN = 50  # keys of one ticker map, share frame or feed


def _series(value: Column) -> Column:
    """The lines' values in order of (time, order, line)."""
    points = F.sort_array(F.collect_list(F.struct("ts", "l_orderkey", "l_linenumber", value.alias("v"))))
    return F.transform(points, lambda p: p["v"])


def chart_documents(spark: SparkSession, root: str) -> DataFrame:
    """``(ticker, body)``: a chart of the unit prices of each part."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    lines = table(spark, root, "lineitem").select(
        "l_partkey",
        "l_orderkey",
        "l_linenumber",
        (F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber") * 5400).alias("ts"),
        F.when((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "R"), F.lit(None)).when(F.col("l_linenumber") == 2, -price).otherwise(price).alias("close"),
        F.when(F.col("l_linenumber") != 3, price * (1 - F.col("l_discount"))).alias("adjusted"),
        F.when(
            F.col("l_quantity") >= 45,
            F.struct(
                F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"),
                F.struct(F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("date"), F.col("l_linenumber").cast("double").alias("numerator"), (F.col("l_quantity") - 45).alias("denominator")),
            ),
        ).alias("split"),
    )
    drawn = lines.groupBy("l_partkey").agg(
        F.transform(_series(F.col("ts")), lambda t: t).alias("timestamp"),
        _series(F.col("close")).alias("close"),
        _series(F.col("adjusted")).alias("adjusted"),
        F.map_from_entries(F.collect_list("split")).alias("splits"),
    )
    drawn = drawn.join(table(spark, root, "part"), F.col("l_partkey") == F.col("p_partkey"))
    meta = F.struct(
        F.lit("USD").alias("currency"),
        F.when(F.col("p_size") % 5 == 0, F.col("p_retailprice")).alias("regularMarketPrice"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_name")).alias("longName"),
        F.col("p_type").alias("shortName"),
        F.when(F.col("p_size") % 4 != 0, (F.col("p_size") % 25 - 12).cast("bigint") * 3600).alias("gmtoffset"),
    )
    quote = F.array(F.struct("close"))
    adjclose = F.when(F.col("p_size") % 2 == 0, F.array(F.struct(F.col("adjusted").alias("adjclose"))))
    chart = F.struct(
        meta.alias("meta"),
        "timestamp",
        F.struct(quote.alias("quote"), adjclose.alias("adjclose")).alias("indicators"),
        F.struct("splits").alias("events"),
    )
    # Some documents hold an older chart before the one that counts.
    charts = F.when(F.col("p_size") % 7 == 0, F.array(chart.withField("timestamp", F.array(F.lit(0).cast("bigint"))), chart)).otherwise(F.array(chart))
    good = F.to_json(F.struct(F.struct(charts.alias("result")).alias("chart")))
    failed = F.to_json(F.struct(F.struct(F.struct(F.lit("Not Found").alias("code")).alias("error")).alias("chart")))
    body = F.when(F.col("p_size") == 49, failed).when(F.col("p_size") == 48, F.left(good, F.char_length(good) - 9)).otherwise(good)
    return drawn.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("ticker"), body.alias("body"))


def filing_documents(spark: SparkSession, root: str) -> DataFrame:
    """``(cik, body)``: each customer's orders as facts of two taxonomies; even customers are named by ``cik`` only."""
    day = F.col("o_orderdate").cast("date")
    orders = table(spark, root, "orders")
    form = F.when(F.col("o_orderstatus") == "F", "10-K").when(F.col("o_orderstatus") == "O", "10-Q")
    fact = F.struct(F.date_sub(day, 90).alias("start"), day.alias("end"), F.col("o_totalprice").alias("val"), form.alias("form"), F.date_add(day, 30).alias("filed"))
    money = orders.select(
        "o_custkey", "o_orderkey", F.lit("us-gaap").alias("taxonomy"), F.regexp_replace("o_orderpriority", "[^A-Z]", "").alias("tag"), F.lit("USD").alias("unit"), fact.alias("fact")
    )
    share = F.struct(F.lit(None).cast("date").alias("start"), day.alias("end"), F.col("o_orderkey").cast("double").alias("val"), F.lit("10-K").alias("form"), day.alias("filed"))
    shares = orders.where("o_orderkey % 5 = 0").select(
        "o_custkey", "o_orderkey", F.lit("dei").alias("taxonomy"), F.when(F.col("o_orderkey") % 2 == 0, "URGENT").otherwise("Shares").alias("tag"), F.lit("shares").alias("unit"), share.alias("fact")
    )
    entries = money.unionByName(shares)

    def nested(df: DataFrame, keys: list[str], name: str, value: Column) -> DataFrame:
        return df.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, value.alias("v"))))).alias("v"))

    lists = entries.groupBy("o_custkey", "taxonomy", "tag", "unit").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "fact"))), lambda x: x["fact"]).alias("v"))
    # A map cannot be sorted, so entries are ordered by their names in the arrays they come from.
    units = lists.groupBy("o_custkey", "taxonomy", "tag").agg(F.map_from_entries(F.collect_list(F.struct("unit", "v"))).alias("units"))
    tags = units.groupBy("o_custkey", "taxonomy").agg(F.map_from_entries(F.collect_list(F.struct("tag", F.struct("units")))).alias("tags"))
    facts = tags.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("taxonomy", "tags"))).alias("facts"))
    cik = F.col("o_custkey").cast("string")
    named = F.when(F.col("o_custkey") % 2 == 1, F.col("o_custkey"))
    return facts.select(cik.alias("cik"), F.to_json(F.struct(named.alias("cik"), F.concat(F.lit("Customer "), cik).alias("entityName"), "facts")).alias("body"))


def ticker_documents(spark: SparkSession, root: str) -> DataFrame:
    """``(body)``: ticker maps of ``RUN`` customers each."""
    entry = F.struct(F.col("c_custkey").cast("string").alias("at"), F.struct(F.col("c_custkey").alias("cik_str"), F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("ticker")))
    listed = table(spark, root, "customer").groupBy(F.floor(F.col("c_custkey") / RUN)).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    return listed.select(F.to_json("m").alias("body"))


def frame_documents(spark: SparkSession, root: str) -> DataFrame:
    """``(frame, body)``: share frames of ``RUN`` orders each, in order of their keys."""
    entry = F.struct(F.col("o_custkey").alias("cik"), F.col("o_orderdate").cast("date").alias("end"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("val"))
    listed = table(spark, root, "orders").groupBy(F.floor(F.col("o_orderkey") / RUN).alias("frame")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", entry.alias("entry")))).alias("l"))
    return listed.select("frame", F.to_json(F.struct(F.transform("l", lambda x: x["entry"]).alias("data"))).alias("body"))


def feed_documents(spark: SparkSession, root: str) -> DataFrame:
    """``(ticker, body)``: feeds of ``RUN`` documents each, whole texts as titles.

    Of every ten items one has no date, one an unclosed tag, and three no publisher; publishers end the titles they come with.
    """
    docs = table(spark, root, "documents").where("text IS NOT NULL")
    kind = F.col("doc_id") % 10
    clean = F.regexp_replace("text", "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", " ")
    escaped = F.replace(F.replace(F.replace(clean, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    source = F.when((kind >= 3) & F.col("source").isNotNull(), F.col("source"))
    at = F.make_date(F.lit(2021), (F.col("doc_id") % 12 + 1).cast("int"), (F.col("doc_id") % 28 + 1).cast("int"))
    stamp = F.concat(F.date_format(at, "EEE, d MMM yyyy "), F.format_string("%02d:30:00 ", F.col("doc_id") % 24), F.when(kind == 5, "EST").when(kind == 6, "+0130").otherwise("GMT"))
    item = F.concat(
        F.when(kind == 4, '<item id="x">').otherwise("<item>"),
        F.lit("<title> "), escaped, F.coalesce(F.concat(F.lit(" - "), source), F.lit("")), F.lit(" </title>"),
        F.concat(F.lit("<link>https://news.test/"), F.col("doc_id").cast("string"), F.lit("</link>")),
        F.when(kind == 8, "").otherwise(F.concat(F.lit("<pubDate>"), stamp, F.lit("</pubDate>"))),
        F.coalesce(F.concat(F.lit("<source url='s'>"), source, F.lit("</source>")), F.lit("")),
        F.when(kind == 7, "<open>").otherwise(""),
        F.lit("</item>"),
    )
    feed = docs.groupBy(F.floor(F.col("doc_id") / RUN).alias("feed")).agg(F.sort_array(F.collect_list(F.struct("doc_id", item.alias("item")))).alias("l"))
    body = F.concat(F.lit("<rss><channel><title>all items</title>"), F.array_join(F.transform("l", lambda x: x["item"]), "\n"), F.lit("</channel></rss>"))
    return feed.select(F.concat(F.lit("F"), F.col("feed").cast("string")).alias("ticker"), body.alias("body"))

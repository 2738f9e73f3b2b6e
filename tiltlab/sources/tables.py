"""Prices, headlines, facts and texts read off the star-schema tables.

The engine works on long domain tables; these readers map the warehouse tables onto them:
``prices(ticker, date, close)``, ``headlines(ticker, date, positive, negative, neutral)``,
``facts(cik, taxonomy, tag, unit, pos, start, end, val, form, filed)`` and so on. Each is one scan
that reads only the columns it needs, and reduces rows before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BRAND_COUNT = 25


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def _period(column: str, grain: str) -> Column:
    """First day of the week or month, as a date."""
    return F.trunc(F.col(column).cast("date"), grain).cast("date")


def brand_bars(spark: SparkSession, root: str, grain: str = "week") -> DataFrame:
    """Per brand and period: sum and count of unit prices (both averages below come from these)."""
    lines = table(spark, root, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"),
        _period("l_shipdate", grain).alias("date"),
        F.try_divide("l_extendedprice", "l_quantity").alias("px"),
    )
    brands = table(spark, root, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    return (
        lines.join(brands, "p_partkey")
        .groupBy("ticker", "date")
        .agg(F.sum("px").alias("px_sum"), F.count("px").alias("px_count"))
        .where("px_count > 0")
    )


def prices(bars: DataFrame) -> DataFrame:
    return bars.select("ticker", "date", (F.col("px_sum") / F.col("px_count")).alias("close"))


def benchmark(bars: DataFrame) -> DataFrame:
    """Average over all brands, folded from the same partial sums as ``prices``."""
    return bars.groupBy("date").agg((F.sum("px_sum") / F.sum("px_count")).alias("close"))


def supplier_prices(spark: SparkSession, root: str) -> DataFrame:
    """Daily prices per supplier, the instruments that universe sampling screens."""
    return (
        table(spark, root, "lineitem")
        .groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("date"))
        .agg(F.avg(F.try_divide("l_extendedprice", "l_quantity")).alias("close"))
        .withColumnRenamed("l_suppkey", "instrument")
    )


def _brand(key: Column) -> Column:
    return F.concat(F.lit("Brand#"), (key % BRAND_COUNT + 1).cast("string"))


def headlines(spark: SparkSession, root: str) -> DataFrame:
    """One dated, scored headline per order; probabilities by fixed arithmetic."""
    priority = F.substring("o_orderpriority", 1, 1).cast("double")
    size = F.col("o_totalprice") / 500000.0
    return (
        table(spark, root, "orders")
        .select(
            _brand(F.col("o_custkey")).alias("ticker"),
            F.col("o_orderdate").cast("date").alias("date"),
            (size * (6.0 - priority) / 6.0).alias("positive"),
            ((1.0 - size) * priority / 6.0).alias("negative"),
        )
        .withColumn("neutral", 1.0 - F.col("positive") - F.col("negative"))
    )


def live_headlines(spark: SparkSession, root: str) -> DataFrame:
    """Timestamped headlines: one per event, the event's user is the ticker."""
    size = F.col("value") / 500.0
    return table(spark, root, "events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"),
        F.col("ts").cast("timestamp").alias("published"),
        size.alias("positive"),
        ((1.0 - size) / 2.0).alias("negative"),
        ((1.0 - size) / 2.0).alias("neutral"),
    )


def splits(spark: SparkSession, root: str) -> DataFrame:
    """At most one split per brand and year, dated at the year's largest order."""
    return (
        table(spark, root, "orders")
        .select(
            _brand(F.col("o_custkey")).alias("ticker"),
            F.col("o_orderdate").cast("date").alias("date"),
            F.struct("o_totalprice", "o_orderkey").alias("size"),
        )
        .groupBy("ticker", F.year("date").alias("year"))
        .agg(F.max_by("date", "size").alias("date"), F.count(F.lit(1)).alias("n"))
        .select("ticker", "date", F.when(F.col("n") % 2 == 0, 2.0).otherwise(0.5).alias("ratio"))
    )


def facts(spark: SparkSession, root: str) -> DataFrame:
    """Filed facts per nation, folded from orders; order status supplies restatements and tag changes.

    Orders are first reduced to one row per (nation, quarter, status); everything below that is bounded
    by nations x quarters x statuses.
    """
    filed = table(spark, root, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        F.trunc(F.col("o_orderdate").cast("date"), "quarter").alias("quarter"),
        F.col("o_orderstatus").alias("status"),
        "o_totalprice",
    )
    nations = table(spark, root, "customer").select("c_custkey", "c_nationkey")
    cube = (
        filed.join(nations, "c_custkey")
        .groupBy("c_nationkey", "quarter", "status")
        .agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n"))
        .withColumn("cik", F.lpad(F.col("c_nationkey").cast("string"), 10, "0"))
    )
    annual = cube.groupBy("cik", F.trunc("quarter", "year").alias("start"), "status").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n")
    )
    yearly_facts = annual.selectExpr("*", "date_sub(add_months(start, 12), 1) as end").selectExpr(
        "cik",
        """inline(array(
            named_struct('taxonomy', 'us-gaap',
                'tag', if(status = 'P', 'Revenues', 'RevenueFromContractWithCustomerExcludingAssessedTax'),
                'unit', 'USD', 'start', start, 'end', end, 'val', total,
                'form', decode(status, 'F', '10-K', 'O', '10-K/A', '20-F'),
                'filed', date_add(end, decode(status, 'F', 60, 'O', 150, 90)),
                'pos', decode(status, 'F', 0, 'O', 1, 2)),
            named_struct('taxonomy', 'us-gaap',
                'tag', if(status = 'P', 'ProfitLoss', 'NetIncomeLoss'),
                'unit', 'USD', 'start', start, 'end', end, 'val', total * 0.1D - n * 10000.0D,
                'form', decode(status, 'F', '10-K', 'O', '10-K/A', '20-F'),
                'filed', date_add(end, decode(status, 'F', 60, 'O', 150, 90)),
                'pos', decode(status, 'F', 0, 'O', 1, 2))
        ))""",
    )
    # Quarter-length revenue is never an annual observation. Share classes O and P are filed together and
    # must both count; third quarters carry no cover page.
    quarterly_facts = cube.selectExpr(
        "cik", "status", "total", "n", "cast(quarter as date) as start",
        "date_sub(add_months(quarter, 3), 1) as end",
        "date_add(date_sub(add_months(quarter, 3), 1), if(status = 'F', 30, 45)) as filed",
        "decode(status, 'F', 0, 'O', 1, 2) as pos",
    ).selectExpr(
        "cik",
        """inline(array(
            named_struct('taxonomy', 'us-gaap', 'tag', 'Revenues', 'unit', 'USD', 'start', start,
                'end', end, 'val', total, 'form', '10-Q', 'filed', filed, 'pos', pos),
            named_struct('taxonomy', 'us-gaap',
                'tag', if(status = 'P', 'StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest',
                          'StockholdersEquity'),
                'unit', 'USD', 'start', cast(null as date), 'end', end, 'val', total - n * 240000.0D,
                'form', '10-Q', 'filed', filed, 'pos', pos),
            named_struct('taxonomy', 'us-gaap',
                'tag', if(status = 'O', 'LongTermDebtNoncurrent', 'LongTermDebt'),
                'unit', 'USD', 'start', cast(null as date), 'end', end, 'val', total * 0.2D,
                'form', '10-Q', 'filed', filed, 'pos', pos),
            named_struct('taxonomy', 'us-gaap', 'tag', 'CommonStockSharesOutstanding', 'unit', 'shares',
                'start', cast(null as date), 'end', end, 'val', n * 900.0D, 'form', '10-Q', 'filed', filed, 'pos', pos),
            named_struct('taxonomy', 'dei', 'tag', 'EntityCommonStockSharesOutstanding', 'unit', 'shares',
                'start', cast(null as date), 'end', end, 'val', n * 1000.0D, 'form', '10-Q', 'filed', filed, 'pos', pos)
        ))""",
    ).where("not (taxonomy = 'dei' and month(end) = 9)")
    return yearly_facts.unionByName(quarterly_facts)


def registrants(spark: SparkSession, root: str) -> DataFrame:
    """Brand to filer id: brand k files as nation k - 1."""
    return table(spark, root, "nation").select(
        F.concat(F.lit("Brand#"), (F.col("n_nationkey") + 1).cast("string")).alias("ticker"),
        F.lpad(F.col("n_nationkey").cast("string"), 10, "0").alias("cik"),
        F.col("n_name").alias("entity_name"),
        F.col("n_regionkey").alias("region"),
    )

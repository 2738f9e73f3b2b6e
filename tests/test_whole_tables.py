"""Keys beyond those of the small test tables reach the results."""

from pyspark.sql import functions as F

from tiltlab.plans import queries as Q


def test_feeds_and_tickers_take_all_keys(spark, tmp_path):
    ids = spark.range(0, 40_000, 7)
    ids.select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("text "), "id").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    ids.select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("t").alias("text")).write.parquet(f"{tmp_path}/conversations.parquet")
    feeds = Q._feeds(spark, str(tmp_path))
    assert feeds.count() == 2 * ids.count()
    fresh = feeds.where("published >= timestamp '2024-01-03'").agg(F.max("pos").alias("last"), F.count("*").alias("n")).first()
    assert fresh.last > 10_080 and 0.4 < fresh.n / (2 * ids.count()) < 0.6

    keys = [1, 99_999, 100_000, 11_881_375, 11_881_377]
    spark.createDataFrame([(k, 1.0) for k in keys], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {int(r.cik): r.ticker for r in Q.shortest_ticker(spark, str(tmp_path)).collect()}
    assert set(got) == set(keys) and got[1] == "AAAAB" and got[11_881_375] == "ZZZZZ"
    assert got[11_881_377] == got[1] and len(set(got.values())) == 4  # 26 ** 5 keys on they repeat

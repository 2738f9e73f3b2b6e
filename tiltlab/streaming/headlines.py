"""Streaming forms of the headline steps: incremental scoring, closed weeks and sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tiltlab.operators.sentiment import Scorer, polarity, score_missing
from tiltlab.session import staged
from tiltlab.sources.scores import NAMED, append_scores, read_store, text_key


def score_stream(texts: DataFrame, store_path: str, scorer: Scorer, checkpoint: str) -> StreamingQuery:
    """Score only texts the store has not seen, batch by batch, and write them to the batch's own partition.

    Exactly once: a batch sees the store as it was before it, whatever an earlier attempt at it left behind, so a replay scores the same
    texts and replaces that attempt's partition. A batch of at most ``NAMED`` texts names their digests to the scan, which opens only
    the buckets, and in them the pages, that can hold them; a larger one joins the store where it lies.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        texts = batch.select("text").where("text IS NOT NULL").distinct().persist()
        try:
            named = [r.digest for r in texts.select(text_key().alias("digest")).limit(NAMED + 1).collect()]
            store = read_store(batch.sparkSession, store_path, before=batch_id, digests=named if len(named) <= NAMED else None)
            fresh = staged(score_missing(texts, store, scorer))  # a table is not overwritten while it is read
            append_scores(fresh, store_path, batch_id)
        finally:
            texts.unpersist()

    return (
        texts.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def closed_weeks(headlines: DataFrame, lateness: str = "3 days") -> DataFrame:
    """Headlines per (ticker, Monday-aligned week); a week is final once the lateness has passed."""
    week = F.window("published", "7 days", startTime="4 days")
    return (
        headlines.withWatermark("published", lateness)
        .groupBy("ticker", week.alias("week"))
        .agg(F.count(F.lit(1)).alias("headlines"), F.avg(polarity()).alias("score"))
        .select("ticker", F.col("week.start").cast("date").alias("a"), "headlines", "score")
    )


def sliding_news(headlines: DataFrame, days: int = 7, lateness: str = "3 days") -> DataFrame:
    """Daily-sliding window of the last ``days`` days: ``as_of`` sees the days strictly before it."""
    return (
        headlines.withWatermark("published", lateness)
        .groupBy("ticker", F.window("published", f"{days} days", "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("headlines"), F.avg(polarity()).alias("score"))
        .select("ticker", F.col("w.end").cast("date").alias("as_of"), "headlines", "score")
    )

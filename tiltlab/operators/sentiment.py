"""Scored headlines to sentiment summaries, and the score memo.

A hot ticker may hold a large share of all headlines. Every path therefore first folds headlines into
per-day moments with a map-side aggregate; what is shuffled and kept per ticker afterwards is bounded
by days, never by headlines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltlab.functions.numeric import total
from tiltlab.params import CONFIDENCE_HALF_COUNT, HALF_LIFE_DAYS
from tiltlab.session import staged
from tiltlab.sources.scores import SCORES, by_digest, text_key

SUMMARY_COLUMNS = (
    "score",
    "confidence",
    "headlines",
    "dispersion",
    "effective_count",
    "positive",
    "negative",
    "neutral",
)


def polarity() -> Column:
    return F.col("positive") - F.col("negative")


def summary_label() -> Column:
    """Top class; ties go to positive, then negative."""
    pos, neg, neu = F.col("positive"), F.col("negative"), F.col("neutral")
    return F.when((pos >= neg) & (pos >= neu), "positive").when(neg >= neu, "negative").otherwise("neutral")


def recency_weight(age_days: Column) -> Column:
    return F.pow(F.lit(0.5), age_days / HALF_LIFE_DAYS)


def moments(headlines: DataFrame, when: str, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Per (keys, ``when``): count, mean polarity, squared deviations and class counts.

    All aggregates merge map-side, so a ticker travels as one row per distinct time.
    """
    label = summary_label()
    return (
        headlines.select(*keys, when, polarity().alias("s"), label.alias("label"))
        .groupBy(*keys, when)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("s").alias("mean"),
            (F.var_pop("s") * F.count(F.lit(1))).alias("dev"),
            F.count_if(F.col("label") == "positive").alias("n_pos"),
            F.count_if(F.col("label") == "negative").alias("n_neg"),
            F.count_if(F.col("label") == "neutral").alias("n_neu"),
        )
    )


def _summary(w1: Column, w2: Column, mean: Column, variance: Column) -> list[Column]:
    n_eff = w1 * w1 / w2
    spread = F.sqrt(F.greatest(variance, F.lit(0.0)))
    agreement = 1.0 - 0.5 * F.least(spread, F.lit(1.0))
    return [
        mean.alias("score"),
        (n_eff / (n_eff + CONFIDENCE_HALF_COUNT) * agreement).alias("confidence"),
        spread.alias("dispersion"),
        n_eff.alias("effective_count"),
    ]


def sentiment_panel(
    headlines: DataFrame, cal: DataFrame, window_days: int = 7, min_headlines: int = 3
) -> DataFrame:
    """Summary per (ticker, trading day t) of the headlines dated in [t - window, t - 1].

    Each (ticker, date) moment row is sent to the trading days that can see it, so the range join
    becomes an equi join with the calendar plus one aggregate; a group holds at most ``window_days``
    moment rows.
    """
    seen = (
        moments(headlines, "date")
        .withColumn("age", F.explode(F.sequence(F.lit(1), F.lit(window_days))))
        .withColumn("date", F.date_add("date", F.col("age")))
        .join(F.broadcast(cal.select("date", "t")), "date")
        .withColumn("w", recency_weight(F.col("age").cast("double")))
    )
    points = F.collect_list(F.struct("w", "n", "mean", "dev"))
    grouped = (
        seen.groupBy("ticker", "t", "date")
        .agg(
            F.sum(F.col("w") * F.col("n")).alias("w1"),
            F.sum(F.col("w") * F.col("w") * F.col("n")).alias("w2"),
            F.sum(F.col("w") * F.col("n") * F.col("mean")).alias("ws"),
            F.sum("n").alias("headlines"),
            F.sum("n_pos").alias("positive"),
            F.sum("n_neg").alias("negative"),
            F.sum("n_neu").alias("neutral"),
            points.alias("points"),
        )
        .where(F.col("headlines") >= min_headlines)
        .withColumn("mu", F.col("ws") / F.col("w1"))
    )
    # Deviations around the mean, not a difference of squares: agreement gives exactly zero.
    spread = total(
        F.transform(
            "points",
            lambda p: p["w"] * (p["dev"] + p["n"] * (p["mean"] - F.col("mu")) * (p["mean"] - F.col("mu"))),
        )
    )
    return grouped.select(
        "ticker",
        "t",
        "date",
        *_summary(F.col("w1"), F.col("w2"), F.col("mu"), spread / F.col("w1")),
        "headlines",
        "positive",
        "negative",
        "neutral",
    )


def live_summary(headlines: DataFrame, now: Column, tickers: DataFrame | None = None, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Summary per ticker (or ``keys``) of timestamped headlines as of ``now``; zeros for tickers without any.

    Headlines fold to one row per (ticker, second). Two aggregates over those rows follow: weighted
    means, then deviations around them.
    """
    at = F.unix_seconds("published")
    age = F.greatest(F.unix_seconds(F.to_timestamp(now)) - F.col("at"), F.lit(0)) / F.lit(86400.0)
    aged = moments(headlines.withColumn("at", at), "at", keys).withColumn("w", recency_weight(age))
    mass = F.col("w") * F.col("n")
    means = aged.groupBy(*keys).agg((F.sum(mass * F.col("mean")) / F.sum(mass)).alias("mu"))
    offset = F.col("mean") - F.col("mu")
    grouped = (
        aged.join(means, list(keys))
        .groupBy(*keys)
        .agg(
            F.sum(mass).alias("w1"),
            F.sum(F.col("w") * mass).alias("w2"),
            F.max("mu").alias("mu"),
            F.sum(F.col("w") * (F.col("dev") + F.col("n") * offset * offset)).alias("ss"),
            F.sum("n").alias("headlines"),
            F.sum("n_pos").alias("positive"),
            F.sum("n_neg").alias("negative"),
            F.sum("n_neu").alias("neutral"),
        )
    )
    out = grouped.select(
        *keys,
        *_summary(F.col("w1"), F.col("w2"), F.col("mu"), F.col("ss") / F.col("w1")),
        "headlines",
        "positive",
        "negative",
        "neutral",
    )
    if tickers is None:
        return out
    return tickers.select(*keys).join(out, list(keys), "left").na.fill(0, list(SUMMARY_COLUMNS))


# Scoring -----------------------------------------------------------------------------------------

Scorer = Callable[[DataFrame], DataFrame]
"""A scorer maps ``(text)`` to ``(text, positive, negative, neutral)``, one row per distinct text."""

# Default word lists of the built-in scorer.
POSITIVE_WORDS = (
    "beat", "beats", "gain", "gains", "growth", "jump", "jumped", "jumps", "profit", "raises",
    "rally", "record", "rise", "rises", "soars", "strong", "surge", "surges", "upgrade", "wins",
)
NEGATIVE_WORDS = (
    "cut", "cuts", "downgrade", "drop", "drops", "fall", "falls", "fraud", "lawsuit", "loss",
    "losses", "miss", "misses", "plunge", "plunges", "probe", "recall", "recalls", "weak", "warns",
)


def lexicon_scorer(positive=POSITIVE_WORDS, negative=NEGATIVE_WORDS, prior: float = 1.0) -> Scorer:
    """Word-share scorer in native expressions; ``prior`` is the pseudo-count of neutral words."""

    def score(texts: DataFrame) -> DataFrame:
        def hits(vocabulary) -> Column:
            return F.size(F.filter("_words", lambda w: w.isin(list(vocabulary)))).cast("double")

        # Texts are split once; both vocabularies count on the same words.
        split = texts.select("text", F.split(F.lower("text"), r"[^\p{L}\p{N}]+").alias("_words"))
        counted = split.select("text", hits(positive).alias("p"), hits(negative).alias("q"))
        mass = F.col("p") + F.col("q") + prior
        return counted.select(
            "text",
            (F.col("p") / mass).alias("positive"),
            (F.col("q") / mass).alias("negative"),
            (F.lit(prior) / mass).alias("neutral"),
        )

    return score


def model_scorer(predict, batch_size: int = 256) -> Scorer:
    """Adapter for a user's batch model: ``predict(list of texts) -> array of (pos, neg, neu)`` rows.

    Runs inside tasks, one Arrow batch at a time, and calls the model on at most ``batch_size`` texts.
    """
    return loaded_scorer(lambda: predict, None, batch_size)


_MODEL: list = [None, None]  # name and model of this Python worker


def _worker_model(load, name: str | None):
    """The worker's model, loaded when it first needs it; workers are reused, so later tasks find it. None is not kept."""
    if name is None:
        return load()
    if _MODEL[0] != name:
        _MODEL[:] = [name, load()]
    return _MODEL[1]


def loaded_scorer(load, name: str | None, batch_size: int = 256) -> Scorer:
    """Adapter for a model that is costly to load: ``load()`` gives a ``predict`` as in ``model_scorer``.

    A worker loads the model called ``name`` once and feeds it all batches of all its tasks; another name takes its place.
    """

    def score(texts: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            from tiltlab.operators import sentiment  # the worker's own copy, which outlives the task

            predict = sentiment._worker_model(load, name)
            for batch in batches:
                for at in range(0, batch.num_rows, batch_size):
                    part = batch.column("text").slice(at, batch_size)
                    probs = np.asarray(predict(part.to_pylist()), dtype=float).reshape(len(part), 3)
                    yield pa.RecordBatch.from_arrays([part, *(pa.array(probs[:, k]) for k in range(3))], names=["text", *SCORES])

        return texts.select("text").mapInArrow(run, "text string, positive double, negative double, neutral double")

    return score


def in_store(digests: DataFrame, store: DataFrame) -> DataFrame:
    """(digest, positive, negative, neutral), null where the store has no score: one row for each distinct digest.

    Copies of a text collapse before they are dealt, and the store is joined where it lies.
    """
    return digests.select("digest").where("digest IS NOT NULL").distinct().join(store.hint("merge"), "digest", "left")


def missing_texts(texts: DataFrame, store: DataFrame) -> DataFrame:
    """(digest, text): distinct texts that the store has no score of.

    Digests decide which; only the texts found missing are dealt, one copy each.
    """
    keyed = texts.select(text_key().alias("digest"), "text")
    return _chosen(keyed, in_store(keyed, store).where("positive IS NULL"))


def _chosen(keyed: DataFrame, missing: DataFrame) -> DataFrame:
    found = keyed.join(missing.select("digest"), "digest", "left_semi")
    return found.groupBy("digest").agg(F.first("text").alias("text"))


def score_missing(texts: DataFrame, store: DataFrame, scorer: Scorer) -> DataFrame:
    """Scores (text and probabilities) of the unseen texts only."""
    return scorer(missing_texts(texts, store).select("text"))


def lookup_scores(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Attach scores to every row of ``rows``, which has a ``digest`` (copies kept); zeros for texts without a score.

    A text held by a large share of rows is one hot join key on the left; AQE splits it, and the
    scores side has one row per digest.
    """
    return rows.join(scores.select("digest", *SCORES), "digest", "left").na.fill(0.0, list(SCORES))


def keyed_rows(rows: DataFrame) -> DataFrame:
    """``rows`` with the digest of their text in place of it."""
    return rows.withColumn("digest", text_key()).drop("text")


def stored_scores(rows: DataFrame, store: DataFrame) -> DataFrame:
    """``rows`` without their text, with the scores the store has of it; zeros where it has none."""
    thin = staged(keyed_rows(rows))
    return lookup_scores(thin, in_store(thin, store).where("positive IS NOT NULL"))


def score_all(rows: DataFrame, store: DataFrame, scorer: Scorer) -> DataFrame:
    """Memoised scoring: ``rows`` without their text, with its score from the store or, for unseen texts, from the scorer.

    The rows are read twice: once for their digests, which are written down, and once for the texts that are missing.
    """
    thin = staged(keyed_rows(rows))
    known = staged(in_store(thin, store))
    missing = _chosen(rows.select(text_key().alias("digest"), "text"), known.where("positive IS NULL"))
    fresh = by_digest(scorer(missing.select("text"))).select("digest", *SCORES)
    return lookup_scores(thin, known.where("positive IS NOT NULL").unionByName(fresh))

"""Agreement of scorers on the same texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltlab.functions.numeric import correlation, hashed_uniform
from tiltlab.operators.sentiment import Scorer
from tiltlab.session import staged
from tiltlab.sources.scores import text_key

BUCKETS = 8192


def last_label() -> Column:
    """Top class; ties go to the last class, unlike the summary label."""
    pos, neg, neu = F.col("positive"), F.col("negative"), F.col("neutral")
    return F.when((neu >= pos) & (neu >= neg), 2).when(neg >= pos, 1).otherwise(0)


def hash_sample(texts: DataFrame, limit: int) -> DataFrame:
    """Deterministic sample: the first ``limit`` texts in hash order (a top-k, not a full sort)."""
    return (
        texts.select("text", hashed_uniform(F.col("text")).alias("u")).orderBy("u", "text").limit(limit)
    )


def score_variants(texts: DataFrame, variants: dict[str, Scorer]) -> DataFrame:
    """Long ``(model, text, positive, negative, neutral)``."""
    scored = [scorer(texts).withColumn("model", F.lit(name)) for name, scorer in variants.items()]
    out = scored[0]
    for more in scored[1:]:
        out = out.unionByName(more)
    return out


def agreement(scored: DataFrame, reference: str, key: str = "text") -> DataFrame:
    """Per model against ``reference``: same label share, score differences and correlation.

    ``scored`` is ``(model, key, positive, negative, neutral)`` with one row per model and key. The reference is spread over its text's
    rows by one aggregate per text (bounded by the number of models), not by a self join.
    """
    entry = F.struct("model", (F.col("positive") - F.col("negative")).alias("s"), last_label().alias("label"))
    by_text = scored.groupBy(key).agg(F.collect_list(entry).alias("_m"))
    base = F.get(F.filter("_m", lambda m: m["model"] == reference), F.lit(0))
    pairs = (
        by_text.withColumn("_ref", base)
        .where("_ref is not null")
        .select("_ref", F.explode("_m").alias("_v"))
        .select(
            F.col("_v.model").alias("model"),
            F.col("_v.s").alias("s"),
            F.col("_ref.s").alias("r"),
            (F.col("_v.label") == F.col("_ref.label")).alias("same"),
            F.abs(F.col("_v.s") - F.col("_ref.s")).alias("diff"),
        )
    )
    pairs = staged(pairs)
    stats = pairs.groupBy("model").agg(
        F.count(F.lit(1)).alias("texts"),
        F.avg(F.col("same").cast("double")).alias("label_agreement"),
        F.avg("diff").alias("mean_abs_score_diff"),
        F.max("diff").alias("max_abs_score_diff"),
        correlation("r", "s").alias("score_correlation"),
    )
    return stats.join(_p99(pairs, stats), "model")


def _p99(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """The element at floor((n - 1) * 0.99) of each model's differences, exactly.

    Differences are counted by buckets of fixed width, a running count finds the bucket that holds the element, and
    only the values inside it are ranked. Differences lie between 0 and 2, so a model has ``BUCKETS`` of them at most.
    """
    at = stats.select("model", F.floor((F.col("texts") - 1) * F.lit(0.99)).alias("_at"))
    bucketed = pairs.select("model", "diff", F.floor(F.col("diff") * F.lit(BUCKETS / 2)).alias("_bucket"))
    upto = Window.partitionBy("model").orderBy("_bucket")
    counted = bucketed.groupBy("model", "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    counted = counted.withColumn("_before", F.sum("_c").over(upto) - F.col("_c")).join(at, "model")
    holds = (F.col("_before") <= F.col("_at")) & (F.col("_before") + F.col("_c") > F.col("_at"))
    # One row per compared model: a handful.
    met = bucketed.join(F.broadcast(counted.where(holds).drop("_c")), ["model", "_bucket"])
    # Differences repeat: count per value, then run over the distinct values of the bucket.
    values = met.groupBy("model", "diff", "_at", "_before").agg(F.count(F.lit(1)).alias("_c"))
    running = F.sum("_c").over(Window.partitionBy("model").orderBy("diff"))
    return (
        values.withColumn("_upto", running + F.col("_before"))
        .where(F.col("_upto") > F.col("_at"))
        .groupBy("model")
        .agg(F.min("diff").alias("p99_abs_score_diff"))
    )


def compare_models(texts: DataFrame, variants: dict[str, Scorer], limit: int | None = None) -> DataFrame:
    """Score (a hash sample of) distinct texts with every variant; the first one is the reference.

    Texts are told apart once, by digest, and written; every scorer reads them from there.
    """
    distinct = texts.where("text IS NOT NULL").groupBy(text_key().alias("digest")).agg(F.first("text").alias("text")).select("text")
    sample = staged(distinct if limit is None else hash_sample(distinct, limit).select("text"))
    scored = score_variants(sample, variants).withColumn("text", text_key())
    return agreement(scored, next(iter(variants)))

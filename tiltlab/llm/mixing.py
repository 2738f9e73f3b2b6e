"""Mixing sources to target weights with nested hash-threshold histograms.

A document's size is its number of words. Sources share ``percent`` percent of all sizes by weight; a source's target stops at
``most`` times its size, and the excess is shared again by weight until none is above. A source whose target is q whole sizes
and a rest takes every document q times, and one time more those documents whose hash lies below a threshold: the largest
threshold whose documents fit the rest. Budgets of one source are nested: a larger budget takes a superset.

The threshold is found by histograms: sum words by source and leading hash bits, locate the bucket in which the running
sum passes the budget, and refine only that bucket by the next bits. Documents are filtered by their hash and never sorted;
what is ordered is at most ``2 ** BITS`` bucket sums of a source at each level. Documents that agree in all
``BITS * LEVELS`` bits are taken together.

The hash is the first 60 bits of an MD5 of (salt, doc_id, text): reruns agree, and it does not depend on partitions.

Defined results: a null text has size 0; null is a source, the last one; equal rows share a hash and are taken together;
a source of size 0 has target 0; an empty table gives an empty result. Extra columns are kept by ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltlab.llm import tokens as T
from tiltlab.session import staged

WEIGHTS = (3, 1, 2)
PERCENT = 150
MOST = 2
BITS = 12
LEVELS = 5
SALT = "mix"
# Up to so many sources their targets are broadcast (some 50 bytes each).
SOURCES = 100_000


def words_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash(doc_id: str, text: str) -> Column:
    whole = F.md5(F.concat_ws("|", F.lit(SALT), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))))
    return F.conv(F.substring(whole, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """(source, source_size, target): ``sizes`` holds source and source_size, one row a source.

    With ``most`` times each size as a ceiling and the rest shared by weight, the final targets are min(ceiling, t * weight) for one
    level t. Sources are settled in order of ceiling / weight: those below the level stop at their ceilings.
    If all ceilings together are below the share, every source stops.
    """
    named = Window.partitionBy("_one").orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = sizes.withColumn("_one", F.lit(1)).withColumn("place", F.row_number().over(named))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("ceiling", (most * F.col("source_size")).cast("double"))
    order = Window.partitionBy("_one").orderBy(F.col("ceiling") / F.col("weight"), "place")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy("_one")
    ranked = (
        ranked.withColumn("budget", F.sum("source_size").over(everyone) * F.lit(percent / 100))
        .withColumn("below", F.coalesce(F.sum("ceiling").over(upto), F.lit(0.0)))
        .withColumn("weights", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    )
    # The level if this source and all with a higher ceiling ratio were open; the first open one decides.
    level = (F.col("budget") - F.col("below")) / F.col("weights")
    ranked = ranked.withColumn("level", level).withColumn("open", F.col("level") < F.col("ceiling") / F.col("weight"))
    final = F.min(F.when(F.col("open"), F.struct(F.col("ceiling") / F.col("weight"), "place", "level"))).over(everyone)["level"]
    target = F.when(final.isNull(), F.col("ceiling")).otherwise(F.least("ceiling", final * F.col("weight")))
    return ranked.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): of ``rows(source, hash, size)`` those with hash < threshold fit ``budgets(source, budget)``.

    A source whose rows all fit has a threshold above every hash.
    """
    state = budgets.select("source", F.col("budget").cast("double").alias("budget"), F.lit(0).cast("long").alias("prefix"))
    found: list[DataFrame] = []
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = rows.join(state.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        inside = inside.where(F.expr(f"shiftright(hash, {shift + BITS})") == F.col("prefix"))
        cells = inside.groupBy("source", "budget", F.expr(f"shiftright(hash, {shift})").alias("cell")).agg(F.sum("size").alias("size"))
        running = Window.partitionBy("source").orderBy("cell")
        cells = cells.withColumn("before", F.sum("size").over(running) - F.col("size"))
        over = cells.where(F.col("before") + F.col("size") > F.col("budget"))
        edge = over.groupBy("source").agg(F.min(F.struct("cell", "before", "budget")).alias("e"))
        state = staged(edge.select("source", (F.col("e.budget") - F.col("e.before")).alias("budget"), F.col("e.cell").alias("prefix")))
        found.append(state)
    last = found[-1].select("source", F.col("prefix").alias("threshold"))
    # Sources without a boundary bucket fit whole.
    return budgets.select("source").join(last.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").select(
        "source", F.coalesce("threshold", F.lit(1 << 60)).alias("threshold")
    )


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """doc_id, text_hash, size, source_size, target, copies and taken of every row of ``docs``."""
    narrow = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", _hash("doc_id", "text").alias("hash"), words_of().alias("size"))
    narrow = staged(narrow)
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = staged(targets(sizes, weights, percent, most))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = goals.withColumn("whole", F.least(whole, F.lit(most)))
    goals = goals.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    limits = thresholds(narrow.select("source", "hash", "size"), goals.where("source_size > 0").select("source", "budget"))
    goals = goals.join(limits.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    goals = staged(goals)
    if goals.count() <= SOURCES:  # so few rows go to every task, and no source's rows meet in one
        goals = F.broadcast(goals)
    out = narrow.join(goals.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    more = (F.col("whole") < most) & (F.col("hash") < F.coalesce("threshold", F.lit(0)))
    copies = F.col("whole") + more.cast("long")
    return out.select("doc_id", "text_hash", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``copies``: how often each is taken (in place of a column of that name)."""
    doc, text, times = T.spare(docs, "id", "hash", "copies")
    taken = plan(docs, weights, percent, most).where("copies > 0").select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text), F.col("copies").alias(times))
    taken = taken.groupBy(doc, text).agg(F.max(times).alias(times))
    kept = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(text)))
    return kept.drop(doc, text, "copies").withColumnRenamed(times, "copies")

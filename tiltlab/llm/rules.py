"""Quality rules: robust multivariate outliers of text statistics, per language and source.

Everything here is a DataFrame expression; no Python runs in tasks.

Each text gives a vector of transformed statistics (``STATISTICS``). For every (lang, source) the minimum covariance determinant
estimate is found by concentration steps: start from medians and median deviations, take the share
``SUPPORT`` of documents nearest by distance, recompute mean and covariance from them, repeat. A document is rejected if its
squared Mahalanobis distance from its group's estimate exceeds ``CUTOFF``.

* Statistics are fixed-point integers, so sums are exact and reruns agree; quantiles are taken over the few thousand
  distinct quantised values, so a group of any size aggregates into a bounded map before the shuffle.
* The covariance has each statistic's ``FLOOR`` squared added: most statistics are zero for most documents, and a zero
  variance would reject the slightest deviation.
* Tables of one row a group are written before they are joined, so Spark knows their size and broadcasts them only if small;
  larger ones are joined by shuffles that it can split.
* Groups are estimated on top of the estimate over all documents, which counts as ``PRIOR`` documents, so a small group needs no
  special case.

Defined results: a null text has no words; null lang or source is a group of its own; documents that fail the base rules
take no part in the estimates; equal rows count each; an empty table gives an empty result. Extra columns are ignored by
``judge`` and kept by ``keep_good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tiltlab.llm import tokens as T
from tiltlab.session import staged

WORD = r"[^\x20\x09-\x0D]"
GAP = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
SPAN = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SUPPORT = 0.75
STEPS = 4
PRIOR = 50.0
CUTOFF = 75.0
SCALE = 1000
# Smallest standard deviation taken for each statistic, in the transformed unit.
FLOOR = {"length": 0.06, "symbols": 0.03, "capitals": 0.05, "repeats": 0.05, "lines": 0.08}
STATISTICS = tuple(FLOOR)
# Consistency of the covariance of the central 75 % of a normal vector of five components.
CONSISTENCY = 1.45


def _nth(words: str, step: int) -> str:
    return f"element_at({words}, i + {step})"


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, n_lines and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("_words", F.filter(F.split(text, GAP), lambda w: w != ""))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    spans = f"transform(sequence(1, size(_words) - {SPAN - 1}), i -> xxhash64({', '.join(_nth('_words', k) for k in range(SPAN))}))"
    out = out.withColumn("_spans", F.expr(f"CASE WHEN size(_words) >= {SPAN} THEN {spans} ELSE array() END"))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    out = (
        out.withColumn("word_chars", F.char_length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOL)).cast("long"))
        .withColumn("n_capitals", F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"))
        .withColumn("_lines", lines)
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    )
    # Spans in order of (hash, place), only where some span repeats.
    sort = "sort_array(transform(_spans, (h, i) -> named_struct('h', h, 'i', i)))"
    out = out.withColumn("_sorted", F.expr(f"CASE WHEN size(array_distinct(_spans)) < size(_spans) THEN {sort} END"))
    # A span equal to its neighbour in that order is repeated.
    ahead = "concat(slice(_sorted, 2, size(_sorted)), array(CAST(NULL AS struct<h:bigint,i:int>)))"
    out = out.withColumn("_pairs", F.expr(f"zip_with(_sorted, {ahead}, (a, b) -> named_struct('i', a.i, 'j', b.i, 'same', a.h <=> b.h))"))
    places = "sort_array(array_distinct(flatten(transform(filter(_pairs, p -> p.same), p -> array(p.i, p.j)))))"
    out = out.withColumn("_places", F.expr(places))
    after = "concat(slice(_places, 2, size(_places)), array(CAST(NULL AS int)))"
    gaps = f"zip_with(_places, {after}, (a, b) -> coalesce(least(b - a, {SPAN}), {SPAN}))"
    out = out.withColumn("n_repeat_words", F.expr(f"coalesce(aggregate({gaps}, 0L, (s, x) -> s + x), 0L)"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_words", "_spans", "_lines", "_sorted", "_pairs", "_places")


def _statistics() -> dict[str, Column]:
    """Transformed statistics, shrunk for short texts, as fixed-point integers."""

    def share(part: str, whole: str, add: int) -> Column:
        return F.sqrt(F.col(part) / (F.col(whole) + add))

    raw = {
        "length": F.log((F.col("word_chars") + 50) / (F.col("n_words") + 10)),
        "symbols": share("n_symbols", "word_chars", 100),
        "capitals": share("n_capitals", "word_chars", 100),
        "repeats": share("n_repeat_words", "n_words", 50),
        "lines": share("n_dup_lines", "n_lines", 10),
    }
    return {name: F.round(raw[name] * SCALE).cast("long") for name in STATISTICS}


def _distance(center: dict[str, Column], factor: dict[tuple[str, str], Column]) -> Column:
    """Squared length of the solution of ``factor * y = x - center`` (``factor`` lower triangular)."""
    solved: dict[str, Column] = {}
    for a in STATISTICS:
        rest = F.col(a) / SCALE - center[a]
        for b in solved:
            rest = rest - factor[a, b] * solved[b]
        solved[a] = rest / factor[a, a]
    total = F.lit(0.0)
    for y in solved.values():
        total = total + y * y
    return total


def _estimate(sums: DataFrame, prior: Row | None) -> DataFrame:
    """Mean (m_*) and Cholesky factor (l_*_*) of the covariance from exact sums; floors and prior included."""
    n = F.col("n").cast("double")
    weight = F.lit(PRIOR if prior else 0.0)
    out = sums
    for a in STATISTICS:
        mean = F.col(f"s_{a}").cast("double") / SCALE
        known = F.lit(prior[f"m_{a}"] if prior else 0.0)
        out = out.withColumn(f"m_{a}", (mean + weight * known) / (n + weight))
    for i, a in enumerate(STATISTICS):
        for b in STATISTICS[: i + 1]:
            moment = F.col(f"s_{a}_{b}").cast("double") / SCALE**2
            spread = (moment - F.col(f"s_{a}").cast("double") * F.col(f"s_{b}").cast("double") / SCALE**2 / n) * CONSISTENCY
            known = F.lit(prior[f"c_{a}_{b}"] if prior else 0.0)
            out = out.withColumn(f"c_{a}_{b}", (spread + weight * known) / (n + weight))
    for i, a in enumerate(STATISTICS):
        for j, b in enumerate(STATISTICS[: i + 1]):
            value = F.col(f"c_{a}_{b}") + (F.lit(FLOOR[a] ** 2) if a == b else F.lit(0.0))
            for c in STATISTICS[:j]:
                value = value - F.col(f"l_{a}_{c}") * F.col(f"l_{b}_{c}")
            smallest = FLOOR[a] ** 2 / 4
            out = out.withColumn(f"l_{a}_{b}", F.sqrt(F.greatest(value, F.lit(smallest))) if a == b else value / F.col(f"l_{b}_{b}"))
    names = [f"m_{a}" for a in STATISTICS] + [f"{k}_{a}_{b}" for k in "cl" for i, a in enumerate(STATISTICS) for b in STATISTICS[: i + 1]]
    return out.select("key", *names)


def _sums(rows: DataFrame) -> DataFrame:
    wide = "decimal(38,0)"
    sums = [F.sum(F.col(a).cast("decimal(20,0)")).cast(wide).alias(f"s_{a}") for a in STATISTICS]
    for i, a in enumerate(STATISTICS):
        sums += [F.sum((F.col(a) * F.col(b)).cast("decimal(20,0)")).cast(wide).alias(f"s_{a}_{b}") for b in STATISTICS[: i + 1]]
    return rows.groupBy("key").agg(F.count("*").alias("n"), *sums)


def _by_estimate(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """``rows`` with their squared distance from their group's estimate."""
    names = [c for c in estimate.columns if c[:2] in ("m_", "l_")]
    joined = rows.join(estimate.select("key", *names), "key", "left")
    center = {a: F.col(f"m_{a}") for a in STATISTICS}
    factor = {(a, b): F.col(f"l_{a}_{b}") for i, a in enumerate(STATISTICS) for b in STATISTICS[: i + 1]}
    return joined.withColumn("distance", _distance(center, factor)).drop(*names)


def _central(rows: DataFrame) -> DataFrame:
    """The share ``SUPPORT`` of each group with the smallest distances (equal quantised ones included)."""
    ranked = rows.withColumn("rank", F.round(100 * F.log(F.col("distance") + 1e-6)).cast("long"))
    bound = staged(ranked.groupBy("key").agg(F.ceil(F.percentile("rank", F.lit(SUPPORT))).alias("bound")))
    return ranked.join(bound, "key").where("rank <= bound")


def scatter(rows: DataFrame, prior: Row | None = None) -> DataFrame:
    """MCD estimate of every ``key`` of ``rows``; ``prior`` is an estimate that counts as ``PRIOR`` rows."""
    medians = staged(rows.groupBy("key").agg(*[F.median(a).alias(f"med_{a}") for a in STATISTICS]))
    off = rows.join(medians, "key")
    spread = staged(off.groupBy("key").agg(*[F.median(F.abs(F.col(a) - F.col(f"med_{a}"))).alias(f"mad_{a}") for a in STATISTICS]))
    start = off.join(spread, "key")
    scaled = F.lit(0.0)
    for a in STATISTICS:
        unit = F.greatest(1.4826 * F.col(f"mad_{a}") / SCALE, F.lit(FLOOR[a]))
        scaled = scaled + F.pow((F.col(a) - F.col(f"med_{a}")) / SCALE / unit, 2)
    near = start.withColumn("distance", scaled).select("key", *STATISTICS, "distance")
    estimate = rows
    for _ in range(STEPS):
        estimate = staged(_estimate(_sums(_central(near)), prior))
        near = _by_estimate(rows, estimate)
    return estimate


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, the base measures, base_failed, distance and kept of every row of ``docs``."""
    key = F.to_json(F.struct("lang", "source"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    narrow = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), key.alias("key"))
    measured = measures(narrow).select("doc_id", "text_hash", "key", *base, *[c.alias(n) for n, c in _statistics().items()])
    measured = staged(measured.withColumn("everyone", F.lit("all")))
    sound = measured.where("NOT base_failed").select("key", "everyone", *STATISTICS)
    overall = scatter(sound.drop("key").withColumnRenamed("everyone", "key"))
    sound = sound.drop("everyone")
    groups = scatter(sound, overall.first())
    judged = _by_estimate(measured, groups)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF)
    return judged.select("doc_id", "text_hash", *base, "distance", kept.alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject."""
    doc, text = T.spare(docs, "id", "hash")
    rejected = judge(docs).where("NOT kept").select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)).distinct()
    return docs.join(rejected, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(text)), "left_anti")

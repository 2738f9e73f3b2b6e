"""Collocations from depth-truncated suffix trees, partitioned by word prefix.

A text is cut at the bytes ``BREAKS`` into pieces and these into words (A-Z lower-cased); everything is per language. A phrase is a run of
up to ``DEPTH`` words of a piece; a *candidate* has two words or more and occurs ``LEAST`` times or more, overlaps included. Cutting a candidate after its
first k words gives the counts l and r of its parts and the score floor(1000 * a * n / (l * r)), n being the language's words; the cut
of the lowest score counts, the shortest first part if tied. A candidate goes if a longer one that contains it occurs as often. As counts
fall with length, one word more on either side decides that.

1. *Words.* Tasks count the words of a batch of texts; the sums give n and the frequent words. A phrase can only be frequent if its words are,
   so the suffix that starts at a word is cut before the first rare word, before a piece ends, and after ``DEPTH`` words.
2. *Vertical partitioning.* The suffixes that share a prefix make one subtree, whose size is the prefix's count. Words are packed, most
   frequent first, into groups of at most ``BUDGET`` suffixes. A word beyond the budget is lengthened: a pass over the texts counts what follows
   it, and its longer prefixes are dealt to as many groups as it needs; one that is beyond the budget itself is lengthened again.
   So the longest subtree a task builds is set by the budget, however frequent a word is.
3. *Subtrees.* Tasks sort a batch's suffixes, add up equal ones and send each group a packed block. A group's task merges its blocks into
   one sorted array of leaves; a node of depth d is a run of leaves that share d words, and its count the total of its leaves. No group needs another.
4. *Scores.* The nodes' counts meet by equi-joins; products are decimals of 38 digits.

The ``HEAD`` most frequent words travel as numbers, which are broadcast (a bound of the parameter, not of the data). If there are more
frequent words than that, the others travel as their 64-bit hashes and are not cut before they are counted: more bytes, same results.
The budget is never less than a ``HEAD``-th of all words (nor than ``LEAST``), so a word outside the head is never beyond it and the lengthened prefixes are
at most ``HEAD`` a depth. Words are named by 64-bit hashes of language and word.

Defined results: a null text is empty; a null language is ``und``, like that name itself; equal rows count each; a language without candidates
has no rows; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiltlab.llm import tokens as T
from tiltlab.llm.exchange import framed
from tiltlab.session import staged

DEPTH = 5
LEAST = 100
TOP = 2000
BUDGET = 2_000_000
HEAD = 1 << 19
SALTS = 64
PACKED = np.uint64(21)  # bits of a word's number where three share 64
NAMED = np.uint64(1 << 63)  # set in every word's hash, in no number

# Bytes that end a piece, and the separators of words.
BREAKS = np.zeros(256, bool)
BREAKS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
SEPARATORS = BREAKS.copy()
SEPARATORS[[0x20, 0x09]] = True


@dataclass
class Plan:
    """What all tasks know: the head's hashes (sorted) with their numbers, the group of each number (-1: lengthened), and per depth the
    lengthened prefixes (sorted hashes) with their first group and number of groups."""

    hashes: np.ndarray
    numbers: np.ndarray
    by_number: np.ndarray
    complete: bool
    group: np.ndarray
    least: int
    depth: int
    others: int = 1  # groups of words outside the head; they come first
    longer: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def codes(self, names: np.ndarray) -> np.ndarray:
        """Numbers from 1 for words of the head; for others their hash, or 0 if they are rare."""
        if not len(self.hashes):
            return np.zeros(len(names), np.uint64) if self.complete else names
        at = np.minimum(np.searchsorted(self.hashes, names), len(self.hashes) - 1)
        return np.where(self.hashes[at] == names, self.numbers[at].astype(np.uint64), np.uint64(0) if self.complete else names)

    def names(self, codes: np.ndarray) -> np.ndarray:
        known = codes < NAMED
        out = codes.copy()
        out[known] = self.by_number[codes[known].astype(np.int64) - 1]
        return out


def named_words(piece: pa.RecordBatch) -> tuple[T.Words, np.ndarray, np.ndarray]:
    """Words of the texts, the hash that names each with its language, and whether it opens a piece of text."""
    found = T.words(piece.column("text"), SEPARATORS, lower=True)
    doc = found.doc()
    languages = piece.column("language").to_numpy(zero_copy_only=False).view(np.uint64)
    names = T.mix(found.hash ^ T.mix(languages * T.M3)[doc]) | NAMED
    breaks = np.cumsum(BREAKS[found.data], dtype=np.int32)[found.start] if len(doc) else np.zeros(0, np.int32)
    opens = np.ones(len(doc), bool)
    opens[1:] = (breaks[1:] != breaks[:-1]) | (doc[1:] != doc[:-1])
    return found, names, opens


def _texts(found: T.Words, rows: np.ndarray) -> pa.Array:
    """The words at ``rows`` as strings."""
    size = found.end[rows] - found.start[rows]
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(found.start[rows] - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(found.data[at])).cast(pa.string())


def _vocabulary(docs: DataFrame, least: int) -> DataFrame:
    """(lang, name, word, f) of the words that occur ``least`` times or more, and for each language a row without name: all its words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in T.pieces(batches):
            found, names, _ = named_words(piece)
            name, first, counts = np.unique(names, return_index=True, return_counts=True)
            doc = np.searchsorted(found.first, first, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [piece.column("lang").take(pa.array(doc)), pa.array(name.view(np.int64)), _texts(found, first), pa.array(counts)], names=["lang", "name", "word", "f"]
            )
            none = len(piece)
            yield pa.RecordBatch.from_arrays(
                [piece.column("lang"), pa.nulls(none, pa.int64()), pa.nulls(none, pa.string()), pa.array(found.counts())], names=["lang", "name", "word", "f"]
            )

    found = docs.mapInArrow(count, "lang string, name long, word string, f long").groupBy("lang", "name", "word").agg(F.sum("f").alias("f"))
    return staged(found.where((F.col("f") >= least) | F.col("name").isNull()))


def suffixes(codes: np.ndarray, opens: np.ndarray, depth: int) -> np.ndarray:
    """Codes of the first ``depth`` words (columns) of the suffix at every word that is not rare; 0 past its end."""
    known = codes != 0
    opens = opens.copy()
    opens[1:] |= ~known[:-1]
    # A rare word's opening falls to the next word that stays.
    run = np.cumsum(opens)[known]
    codes = codes[known]
    out = np.zeros((len(codes), depth), np.uint64)
    for k in range(min(depth, len(codes))):
        same = run[k:] == run[: len(run) - k]
        out[: len(codes) - k, k][same] = codes[k:][same]
    return out


def _order(rows: np.ndarray) -> np.ndarray:
    """Places of the suffixes in lexicographic order."""
    if not len(rows) or rows.max() >> PACKED:
        return np.lexsort(rows.T[::-1])
    keys = []
    for at in range(0, rows.shape[1], 3):
        key = np.zeros(len(rows), np.uint64)
        for k in range(at, min(at + 3, rows.shape[1])):
            key = key << PACKED | rows[:, k]
        keys.append(key)
    return np.lexsort(keys[::-1])


def collapsed(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes in order, with the sums of their counts."""
    order = _order(rows)
    rows, counts = rows[order], counts[order]
    if not len(rows):
        return rows, counts
    heads = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    return rows[heads], np.add.reduceat(counts, heads)


def prefixes(rows: np.ndarray) -> Iterator[np.ndarray]:
    """Hash of the first 1, 2, ... words of each row; meaningless where the row is shorter."""
    total = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        total = T.mix(total * np.uint64(T.SEQ2) + rows[:, k])
        yield total


def _found(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def groups(rows: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Group of each suffix and how many words its group shares at least; group -1 if the suffix ends with a lengthened prefix or is one word."""
    group = np.full(len(rows), -1, np.int64)
    shared = np.ones(len(rows), np.int64)
    hashes = list(prefixes(rows))
    head = rows[:, 0] < NAMED
    group[head] = plan.group[rows[head, 0].astype(np.int64) - 1]
    group[~head] = (hashes[0][~head] % np.uint64(plan.others)).astype(np.int64)
    waiting = np.flatnonzero(group < 0)
    for k, (table, base, ways) in enumerate(plan.longer, start=1):
        at, hit = _found(hashes[k - 1][waiting], table)
        waiting, at = waiting[hit], at[hit]
        there = rows[waiting, k] != 0
        waiting, at = waiting[there], at[there]
        group[waiting] = base[at] + (hashes[k][waiting] % ways[at].astype(np.uint64)).astype(np.int64)
        shared[waiting] = k + 1
        if k < len(plan.longer):  # those whose longer prefix is lengthened itself
            again = _found(hashes[k][waiting], plan.longer[k][0])[1]
            waiting = waiting[again]
            group[waiting] = -1
    group[rows[:, 1] == 0] = -1
    return group, shared


def pack(rows: np.ndarray, counts: np.ndarray) -> bytes:
    """A block: columns of the suffixes and their counts, byte by byte of like weight."""
    table = np.column_stack([rows, counts.astype(np.uint64)]).T
    kind = np.uint32 if not len(rows) or table.max() < 1 << 32 else np.uint64
    planes = np.ascontiguousarray(table.astype(kind)).view(np.uint8).reshape(len(table), -1, kind().itemsize)
    return bytes([kind().itemsize]) + framed(np.ascontiguousarray(planes.transpose(0, 2, 1)))


def unpack(block: bytes, depth: int) -> tuple[np.ndarray, np.ndarray]:
    width, size = block[0], int.from_bytes(block[1:9], "little")
    raw = np.frombuffer(pa.decompress(block[9:], size, "zstd", asbytes=True) if size else b"", np.uint8)
    planes = raw.reshape(depth + 1, width, -1).transpose(0, 2, 1)
    table = np.ascontiguousarray(planes).view(np.uint32 if width == 4 else np.uint64)[..., 0].astype(np.uint64)
    return table[:depth].T, table[depth].astype(np.int64)


def nodes(rows: np.ndarray, counts: np.ndarray, shared: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words and counts of the subtree's nodes of two words or more (``shared`` at least) that occur ``least`` times; leaves are sorted."""
    if not len(rows):
        return
    opens = np.concatenate([[True], np.zeros(len(rows) - 1, bool)])
    for d in range(1, rows.shape[1] + 1):
        opens[1:] |= rows[1:, d - 1] != rows[:-1, d - 1]
        if d < max(2, shared):
            continue
        heads = np.flatnonzero(opens)
        total = np.add.reduceat(counts, heads)
        good = (total >= least) & (rows[heads, d - 1] != 0)
        if good.any():
            yield rows[heads[good], :d], total[good]


def _followers(docs: DataFrame, plan: Plan, above: int) -> list[tuple[list[int], int]]:
    """Prefixes one word longer than the last lengthened ones that occur more than ``above`` times."""
    size = len(plan.longer) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in T.pieces(batches):
            _, names, opens = named_words(piece)
            rows = suffixes(plan.codes(names), opens, size)
            for k, (table, _, _) in enumerate(plan.longer):
                rows = rows[_found(list(prefixes(rows[:, : k + 1]))[-1], table)[1]]
            rows = rows[rows[:, -1] != 0]
            rows, counts = collapsed(rows, np.ones(len(rows), np.int64))
            yield pa.RecordBatch.from_arrays([_lists(rows), pa.array(counts)], names=["codes", "f"])

    found = docs.mapInArrow(count, "codes array<long>, f long").groupBy("codes").agg(F.sum("f").alias("f")).where(F.col("f") > above)
    return [(list(r.codes), r.f) for r in found.collect()]  # at most a HEAD-th


def _lists(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(rows).reshape(-1).view(np.int64)))


def partitioned(docs: DataFrame, vocabulary: DataFrame, least: int, depth: int, budget: int, head: int) -> tuple[Plan, int, list[tuple[list[int], int]]]:
    """The plan, the number of groups, and the lengthened prefixes of two words or more with their counts."""
    words = vocabulary.where("name IS NOT NULL")
    n_words = words.count()
    every = vocabulary.where("name IS NULL").agg(F.sum("f")).first()[0] or 0
    top = words.select("name", "f").orderBy(F.desc("f"), "name").limit(head).toArrow()
    names, f = top.column("name").to_numpy().view(np.uint64), top.column("f").to_numpy().astype(np.int64)
    order = np.lexsort((names, -f))
    names, f = names[order], f[order]
    budget = max(budget, every // head, least)
    complete = n_words <= head
    # Words outside the head by hash; then the head's, packed; then those of lengthened prefixes.
    others = 1 if complete else 1 + (every - int(f.sum())) // budget
    group = np.full(len(f), -1, np.int64)
    small = np.flatnonzero(f <= budget)
    total, at, used = np.cumsum(f[small]), 0, others
    while at < len(small):
        to = int(np.searchsorted(total, (total[at - 1] if at else 0) + budget, side="right"))
        group[small[at:to]] = used
        at, used = to, used + 1
    by_name = np.argsort(names)
    plan = Plan(names[by_name], by_name + 1, names, complete, group, least, depth, others)
    hot = [([int(k) + 1], int(f[k])) for k in np.flatnonzero(f > budget)]
    known = []
    while hot and len(plan.longer) < depth - 1:
        keys = list(prefixes(np.array([codes for codes, _ in hot], np.int64).view(np.uint64)))[-1]
        order = np.argsort(keys)
        ways = np.array([1 + count // budget for _, count in hot], np.int64)[order]
        base = used + np.cumsum(ways) - ways
        used += int(ways.sum())
        plan.longer.append((keys[order], base, ways))
        hot = _followers(docs, plan, budget) if len(plan.longer) < depth - 1 else []
        known += hot
    return plan, used, known


def phrases(docs: DataFrame, vocabulary: DataFrame, least: int = LEAST, depth: int = DEPTH, budget: int = BUDGET, head: int = HEAD) -> DataFrame:
    """(words, a): phrases of two words or more, as arrays of word names, that occur ``least`` times."""
    spark = docs.sparkSession
    plan, used, known = partitioned(docs, vocabulary, least, depth, budget, head)
    shared_plan = spark.sparkContext.broadcast(plan)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared_plan.value
        for piece in T.pieces(batches):
            _, names, opens = named_words(piece)
            rows = suffixes(plan.codes(names), opens, depth)
            rows = rows[rows[:, 1] != 0]
            rows, counts = collapsed(rows, np.ones(len(rows), np.int64))
            group, shared = groups(rows, plan)
            order = np.argsort(group, kind="stable")
            order = order[np.searchsorted(group[order], 0) :]
            heads = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]])) if len(order) else []
            for at in np.split(order, heads[1:]) if len(order) else []:
                row = [[int(group[at[0]])], [int(shared[at[0]])], [pack(rows[at], counts[at])]]
                yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1], pa.int32()), pa.array(row[2], pa.binary())], names=["group", "shared", "block"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared_plan.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now, shared, waiting = None, 0, 0

        def grown() -> Iterator[pa.RecordBatch]:
            leaves = collapsed(*(np.concatenate(part) for part in zip(*held, strict=True)))
            for rows, counts in nodes(*leaves, shared, plan.least):
                yield pa.RecordBatch.from_arrays([_lists(plan.names(rows)), pa.array(counts)], names=["words", "a"])

        for batch in batches:
            for k in range(batch.num_rows):  # one block at a time
                group = batch.column("group")[k].as_py()
                if group != now and held:
                    yield from grown()
                    held, waiting = [], 0
                now, shared = group, batch.column("shared")[k].as_py()
                held.append(unpack(batch.column("block")[k].as_py(), plan.depth))
                waiting += len(held[-1][0])
                if waiting > len(held[0][0]) + 1_000_000:  # equal suffixes of many blocks are added up as they come
                    held = [collapsed(*(np.concatenate(part) for part in zip(*held, strict=True)))]
                    waiting = len(held[0][0])
        if held:
            yield from grown()

    blocks = docs.mapInArrow(deal, "group int, shared int, block binary")
    blocks = blocks.repartition(min(max(used, 1), 1 << 16), "group").sortWithinPartitions("group")
    found = blocks.mapInArrow(build, "words array<long>, a long")
    if known:
        rows = [(plan.names(np.array(codes, np.int64).view(np.uint64)).view(np.int64).tolist(), count) for codes, count in known]
        found = found.unionByName(spark.createDataFrame(rows, "words array<long>, a long"))
    return staged(found)


def scored(found: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(lang, words, a, l, r, n, score) of the phrases that no longer one of the same count contains."""
    words = vocabulary.where("name IS NOT NULL")
    counts = found.unionByName(words.select(F.array("name").alias("words"), F.col("f").alias("a")))
    longer = found.where(F.size("words") > 2).select(
        F.explode(F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))).alias("words"), F.col("a").alias("longer")
    )
    longer = longer.groupBy("words").agg(F.max("longer").alias("longer"))
    stays = staged(found.join(longer, "words", "left").where("longer IS NULL OR 100 * longer < 100 * a").drop("longer"))
    n = vocabulary.where("name IS NULL").select("lang", F.col("f").alias("n"))
    cuts = stays.select("words", "a", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("k"))
    cuts = cuts.withColumn("left", F.expr("slice(words, 1, k)")).withColumn("right", F.expr("slice(words, k + 1, size(words) - k)"))
    cuts = cuts.join(counts.select(F.col("words").alias("left"), F.col("a").alias("l")), "left").join(counts.select(F.col("words").alias("right"), F.col("a").alias("r")), "right")
    cuts = cuts.withColumn("name", F.element_at("words", 1)).join(words.select("name", "lang"), "name").join(n, "lang")
    exact = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    cuts = cuts.withColumn("over", F.lit(1000).cast("decimal(38,0)") * exact["a"] * exact["n"]).withColumn("under", (exact["l"] * exact["r"]).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, depth: int = DEPTH, budget: int = BUDGET, head: int = HEAD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``top`` highest-scoring collocations of each language."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    docs = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("language"), "text")
    vocabulary = _vocabulary(docs, least)
    found = scored(phrases(docs, vocabulary, least, depth, budget, head), vocabulary)
    # A language's best, part by part and then together, so that no task orders more than a bounded share; ties stay until words decide.
    order = [F.desc("score"), F.desc("a")]
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("words"), F.lit(SALTS))).orderBy(*order)
    best = staged(found.withColumn("place", F.rank().over(parts)).where(F.col("place") <= top).drop("place"))
    word = best.select("words", F.posexplode("words").alias("at", "name")).join(vocabulary.select("name", "word"), "name")
    text = word.groupBy("words").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    whole = Window.partitionBy("lang").orderBy(*order, "phrase")
    out = best.join(text, "words").withColumn("rank", F.row_number().over(whole).cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

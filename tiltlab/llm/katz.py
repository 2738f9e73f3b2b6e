"""Katz back-off language model over words.

Tokens are a text's words (A-Z lower-cased) and one end. Every training word is in the model; words that occur in no training text are one class.

* Bigram: P(w | h) = d(c) * c(h, w) / (c(h) + 1) if the pair occurs in training, else bow(h) * P(w). A text's first token has the history start.
* Unigram: P(w) = d(c) * c(w) / (N + 1); what is left is the probability of the class of unseen words.
* The one added below each line keeps some mass for back-off even where no count is discounted.
* d is Good-Turing's r* / r for counts up to ``GOOD_TURING``, with Katz's correction, from the counts of counts, smoothed if uneven;
  where even those give no proper discount (very few counts), d is 1 - 1 / (2 r + 1).
* bow(h) = (1 - seen mass) / (1 - unigram mass of the words seen after h): exactly normalised. If everything was seen after h, the seen
  mass is scaled to one. A history that was never seen has bow 1.

The recursion is evaluated for each token as a sum of three logs: that of P(w), that of bow(h), and, if the pair was seen, its *change*, log P(w | h)
less both. So a text's score is a sum of values looked up by word, by history and by pair, each wherever it lies.

How it runs. Counts and values are stored as tables partitioned by bucket, a word's and its history's in the bucket of the word.

1. Tasks count a piece of the table in numpy and send each bucket one packed block of its distinct words.
2. Pairs are counted likewise and go to the bucket of their history. A pair of a word outside the head goes by way of the word's
   bucket, where it is told the word's count, since bow(h) needs the unigram mass of the words after h.
3. Buckets add up each history's sums: its bow, and the change of each of its pairs.
4. A last pass asks for what it does not know, and the answers return as sums per text.

The *head* is a cache: the ``VOCABULARY`` most frequent words with their counts and bows, and up to ``HEAD`` of the most frequent pairs, are
broadcast, which settles most tokens in place. It bounds what is broadcast, not the model: results do not depend on it. The number of buckets
follows the bytes of the table.

Defined results: a null text is empty and has its end only; equal rows get equal
results and count each in training; a row whose fold is unknown (null doc_id) is trained on; an empty training fold gives every token the class
probabilities that are left; an empty table gives an empty result. Extra columns are ignored. Values of pairs are stored in 32 bits,
the pairs of a bucket told apart by 48.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltlab.llm import tokens as T
from tiltlab.llm.exchange import framed, unframed
from tiltlab.session import dropped, staged

VOCABULARY = 1 << 17
HEAD = 1 << 20
GOOD_TURING = 5
PAIR_BYTES = 6 << 20
BUCKET_BYTES = 8 << 20
NAMED = np.uint64(1 << 63)  # set in the hash that names a word, in no number
# Rows that travel or wait in a bucket.
WORDS, HISTORIES, PAIRS, NEAR, FAR = -3, -2, -1, 0, 1

_BLOCK = "bucket int, kind int, keys binary, words binary, counts binary, more binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("keys", "words", "counts", "more"))])


def _narrow(values: np.ndarray) -> np.ndarray:
    """Non-negative integers as bytes where they fit, else as 64 bits; see ``_wide``."""
    return values.astype(np.uint8) if len(values) == 0 or values.max() < 256 else values.astype(np.int64)


def _wide(data: bytes, n: int) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return unframed(data, np.uint8 if size == n else np.int64).astype(np.int64)


def _deal(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (T.mix(keys) % np.uint64(buckets)).astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    steps = keys.copy()
    steps[1:] -= keys[:-1]
    return framed(steps)


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unframed(data, np.uint64), dtype=np.uint64)


def pack_codes(codes: np.ndarray) -> bytes:
    """Codes byte by byte of like weight: numbers leave their upper bytes empty."""
    return framed(np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 8).T))


def unpack_codes(data: bytes) -> np.ndarray:
    planes = unframed(data, np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel()


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def _split(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of each bucket that has any, in their order."""
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(bounds)):
        yield int(b), order[bounds[b] : bounds[b + 1]]


def _block(bucket: int, kind: int, keys: np.ndarray, counts: np.ndarray, words: np.ndarray | None = None, more: np.ndarray | None = None) -> tuple:
    """A packed row; ``keys`` are sorted."""
    return bucket, kind, pack_keys(keys), None if words is None else pack_codes(words), framed(_narrow(counts)), None if more is None else framed(_narrow(more))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict]]:
    """(bucket, row) of every row."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {f.name: batch.column(f.name)[i].as_py() for f in batch.schema}
            yield row["bucket"], row


def _training(piece: pa.RecordBatch) -> np.ndarray:
    return ~piece.column("held_out").to_numpy(zero_copy_only=False)


def _word_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """The words' table: one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in T.pieces(batches, limit=PAIR_BYTES):
            found = T.words(piece.column("text"), lower=True)
            keys, counts = np.unique(found.hash[np.repeat(_training(piece), found.counts())] | NAMED, return_counts=True)
            rows = [_block(b, WORDS, keys[at], counts[at]) for b, at in _split(_deal(keys, buckets), buckets)]
            if rows:
                yield _batch(rows)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        waiting: dict[int, int] = {}
        for bucket, row in _by_bucket(batches):
            keys = unpack_keys(row["keys"])
            held.setdefault(bucket, []).append((keys, _wide(row["counts"], len(keys))))
            waiting[bucket] = waiting.get(bucket, 0) + len(keys)
            if waiting[bucket] > 2 * len(held[bucket][0][0]) + 1_000_000:
                held[bucket] = [_merged(held[bucket])]
                waiting[bucket] = 0
        for bucket, parts in held.items():
            yield _batch([_block(bucket, WORDS, *_merged(parts))])

    return docs.mapInArrow(count, _BLOCK).repartition(buckets, "bucket").mapInArrow(merge, _BLOCK)


def discounts(of_counts: np.ndarray, k: int = GOOD_TURING) -> np.ndarray:
    """d(r) for r = 0..k, where ``of_counts[r]`` is the number of distinct n-grams that occur r times (r up to k + 1).

    Where raw counts of counts give no proper discount, as copied documents do, they are smoothed by a log-linear fit.
    """
    r = np.arange(1, k + 2)
    n = of_counts[1 : k + 2].astype(float)
    tries = [n] if n.min() > 0 else []
    if (n > 0).sum() > 1:
        slope, level = np.polyfit(np.log(r[n > 0]), np.log(n[n > 0]), 1)
        tries.append(np.exp(level + slope * np.log(r)))
    for n in tries:
        common = (k + 1) * n[k] / n[0]
        star = (r[:-1] + 1) * n[1:] / n[:-1] / r[:-1]
        d = (star - common) / (1 - common) if common < 1 else star * 0
        if ((d > 0) & (d < 1)).all():
            return np.concatenate([[1.0], d])
    return np.concatenate([[1.0], 1 - 1 / (2 * r[:-1] + 1)])


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * d[np.minimum(counts, len(d) - 1)] * (counts < len(d)) + counts * (counts >= len(d))


class Head:
    """Numbers of the frequent words by name: 0 to n - 1, then the end and the start; with their counts."""

    def __init__(self, names: np.ndarray, counts: np.ndarray, ends: int):
        order = np.argsort(names)
        self.rank, self.sorted = order, names[order]
        self.end, self.start = np.uint64(len(names)), np.uint64(len(names) + 1)
        self.counts = np.append(counts, ends)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(names << np.uint64(1)) >> np.uint64(42)] = True

    def codes(self, names: np.ndarray) -> np.ndarray:
        """Numbers of words of the head, names of others."""
        out = names.copy()
        at = np.flatnonzero(self.filter[(names << np.uint64(1)) >> np.uint64(42)])
        if len(self.sorted):
            spot = np.minimum(np.searchsorted(self.sorted, names[at]), len(self.sorted) - 1)
            same = self.sorted[spot] == names[at]
            out[at[same]] = self.rank[spot[same]].astype(np.uint64)
        return out

    def sequence(self, found: T.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code, history and text of every token of the texts, ends included."""
        n = len(found.hash) + len(found)
        codes = np.empty(n, np.uint64)
        ends = found.first[1:] + np.arange(len(found))
        inner = np.ones(n, bool)
        inner[ends] = False
        codes[inner] = self.codes(found.hash | NAMED)
        codes[ends] = self.end
        history = np.empty(n, np.uint64)
        history[1:] = codes[:-1]
        history[found.first[:-1] + np.arange(len(found))] = self.start
        return codes, history, np.repeat(np.arange(len(found)), found.counts() + 1)


def pair_keys(history: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What tells the pairs of a bucket apart: 48 bits."""
    return T.mix(T.mix(history + T.M1) * T.M3 + words) >> np.uint64(16)


class Unigrams:
    """Probabilities of words by their counts."""

    def __init__(self, tokens: int, types: int, of_counts: np.ndarray):
        self.tokens, self.d = tokens, discounts(of_counts)
        r = np.arange(GOOD_TURING + 1)
        taken = (r * of_counts[: GOOD_TURING + 1] * (1 - self.d)).sum()
        self.left = 1 - (tokens - taken) / (tokens + 1)
        self.base = np.log10(tokens + types + 1)

    def mass(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.d) / (self.tokens + 1), self.left)


def _summed(history: np.ndarray, words: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs in order of (history, word), the first value summed and the others taken from one of them."""
    order = np.lexsort((words, history))
    history, words, values = history[order], words[order], [v[order] for v in values]
    if not len(history):
        return history, words, *values
    heads = np.flatnonzero(np.concatenate([[True], (history[1:] != history[:-1]) | (words[1:] != words[:-1])]))
    return history[heads], words[heads], np.add.reduceat(values[0], heads), *(v[heads] for v in values[1:])


def _pair_counts(docs: DataFrame, words: DataFrame, shared, buckets: int) -> DataFrame:
    """The pairs' table, one row a bucket of histories: history, word, count, and the word's count where it is outside the head."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: Head = shared.value
        for piece in T.pieces(batches, limit=PAIR_BYTES):
            codes, history, text = head.sequence(T.words(piece.column("text"), lower=True))
            taught = _training(piece)[text]
            h, w, counts = _summed(history[taught], codes[taught], np.ones(int(taught.sum()), np.int64))
            far = w >= NAMED
            rows = []
            for kind, part in ((NEAR, np.flatnonzero(~far)), (FAR, np.flatnonzero(far))):
                dealt = _deal(h[part] if kind == NEAR else w[part], buckets)
                rows += [_block(b, kind, h[part[at]], counts[part[at]], w[part[at]]) for b, at in _split(dealt, buckets)]
            if rows:
                yield _batch(rows)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, now, held, waiting = None, None, [], 0

        def whole() -> tuple[np.ndarray, ...]:
            return _summed(*(np.concatenate(c) for c in zip(*held, strict=True)))

        def told() -> Iterator[pa.RecordBatch]:
            h, w, counts = whole()
            more = _found(table, w)
            for b, at in _split(_deal(h, buckets), buckets):
                yield _batch([_block(b, NEAR, h[at], counts[at], w[at], more[at])])

        for bucket, row in _by_bucket(batches):  # by bucket; a bucket's words come first
            if bucket != now:
                if held:
                    yield from told()
                table, now, held, waiting = None, bucket, [], 0
            keys = unpack_keys(row["keys"])
            counts = _wide(row["counts"], len(keys))
            if row["kind"] == WORDS:
                table = keys, counts
                continue
            held.append((keys, unpack_codes(row["words"]), counts))
            waiting += len(keys)
            if waiting > 2 * len(held[0][0]) + 500_000:
                held = [whole()]
                waiting = 0
        if held:
            yield from told()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, waiting = None, [], 0

        def whole() -> tuple[np.ndarray, ...]:
            return _summed(*(np.concatenate(c) for c in zip(*held, strict=True)))

        for bucket, row in _by_bucket(batches):
            if bucket != now and held:
                h, w, counts, more = whole()
                yield _batch([_block(now, NEAR, h, counts, w, more)])
                held, waiting = [], 0
            now = bucket
            keys = unpack_keys(row["keys"])
            more = np.zeros(len(keys), np.int64) if row["more"] is None else _wide(row["more"], len(keys))
            held.append((keys, unpack_codes(row["words"]), _wide(row["counts"], len(keys)), more))
            waiting += len(keys)
            if waiting > 2 * len(held[0][0]) + 500_000:
                held = [whole()]
                waiting = 0
        if held:
            h, w, counts, more = whole()
            yield _batch([_block(now, NEAR, h, counts, w, more)])

    raw = staged(docs.mapInArrow(count, _BLOCK))
    far = raw.where(F.col("kind") == FAR).unionByName(words).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(tell, _BLOCK)
    near = raw.where(F.col("kind") == NEAR).unionByName(far)
    pairs = staged(near.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(merge, _BLOCK))
    dropped(raw)
    return pairs


def _grade(counts: np.ndarray) -> np.ndarray:
    return np.floor(16 * np.log2(counts.astype(float))).astype(np.int64)


CELLS = 64 * 16


def _profile(table: DataFrame, most: int) -> tuple[int, np.ndarray, int, int]:
    """Of a table's counts: the lowest grade of which at most ``most`` are left, counts of counts up to GOOD_TURING + 1, their sum and number."""
    cut = GOOD_TURING + 2

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS + cut + 2, np.int64)
        for _, row in _by_bucket(batches):
            counts = _wide(row["counts"], len(unframed(row["keys"], np.uint64)))
            total[:CELLS] += np.bincount(_grade(counts), minlength=CELLS)
            total[CELLS:-1] += np.bincount(np.minimum(counts, cut), minlength=cut + 1)
            total[-1] += counts.sum()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["at", "n"])

    got = dict(table.select("bucket", "keys", "counts").mapInArrow(profile, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect())  # one row a cell
    down = np.cumsum(np.array([got.get(i, 0) for i in range(CELLS)], dtype=np.int64)[::-1])[::-1]
    fits = np.flatnonzero(down <= most)
    small = np.array([got.get(CELLS + i, 0) for i in range(cut + 1)], dtype=np.int64)
    return int(fits[0]) if len(fits) else CELLS, small, int(got.get(CELLS + cut + 1, 0)), int(down[0])


def _frequent(words: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and counts of the words of grade ``least`` or more, most frequent first."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, row in _by_bucket(batches):
            keys = unpack_keys(row["keys"])
            counts = _wide(row["counts"], len(keys))
            chosen = _grade(counts) >= least
            yield pa.RecordBatch.from_arrays([pa.array(keys[chosen].view(np.int64)), pa.array(counts[chosen])], names=["key", "n"])

    top = words.mapInArrow(pick, "key long, n long").toArrow()  # at most VOCABULARY rows
    names, counts = top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.lexsort((names, -counts))
    return names[order], counts[order]


_VALUES = "bucket int, kind int, keys binary, counts binary"
TOLD_HISTORIES, TOLD_PAIRS = 2, 3


def _values(pairs: DataFrame, shared, d2: np.ndarray, least: int) -> DataFrame:
    """Rows of values by key: log bow of histories and change of pairs; those for the broadcast head in kinds of their own."""
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, unigrams = shared.value
        for bucket, row in _by_bucket(batches):
            h = unpack_keys(row["keys"])
            w, counts, more = unpack_codes(row["words"]), _wide(row["counts"], len(h)), _wide(row["more"], len(h))
            known = w < NAMED
            more[known] = head.counts[w[known].astype(np.int64)]
            mass, weight = unigrams.mass(more), discounted(counts, d2)
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            total, seen, backed = (np.add.reduceat(v, first) for v in (counts.astype(float), weight, mass))
            left, open_ = 1 - seen / (total + 1), 1 - backed
            whole = open_ <= 1e-12
            below = np.log10(np.where(whole, np.maximum(seen, 1e-300), total + 1))
            bow = np.log10(np.maximum(left, 1e-300) / np.maximum(open_, 1e-12))
            owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
            change = np.log10(np.maximum(weight, 1e-300)) - below[owner] - bow[owner] - np.log10(np.maximum(mass, 1e-300))
            keys = pair_keys(h, w)
            top = _grade(counts) >= least
            rows = []
            for kind, names, values, width in (
                (HISTORIES, h[first][h[first] >= NAMED], bow[h[first] >= NAMED], float), (TOLD_HISTORIES, h[first][h[first] < NAMED], bow[h[first] < NAMED], float),
                (PAIRS, keys[~top], change[~top], np.float32), (TOLD_PAIRS, keys[top], change[top], float),
            ):
                order = np.argsort(names)
                rows.append((bucket, kind, pack_keys(names[order]), framed(values[order].astype(width))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return pairs.mapInArrow(solve, _VALUES)


def _told(values: DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of one kind, sorted by key; bounded by the head."""
    rows = values.where(F.col("kind") == kind).select("keys", "counts").toArrow()
    keys = [unpack_keys(k) for k in rows.column("keys").to_pylist()]
    numbers = [unframed(v, float) for v in rows.column("counts").to_pylist()]
    keys, numbers = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0), *numbers])
    order = np.argsort(keys)
    return keys[order], numbers[order]


class Model:
    """What is broadcast to score: the head with its logs, and the values of its histories and of frequent pairs."""

    def __init__(self, head: Head, unigrams: Unigrams, histories: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray]):
        self.head, self.unigrams, self.pairs = head, unigrams, pairs
        self.log_unigram = np.log10(np.maximum(unigrams.mass(head.counts), 1e-300))
        self.log_bow = np.zeros(int(head.start) + 1)
        self.log_bow[histories[0].astype(np.int64)] = histories[1]


def scores(docs: DataFrame, held_out, vocabulary: int = VOCABULARY, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score; rows of ``held_out`` are not learnt from.

    ``vocabulary`` and ``head`` bound the words and pairs that are broadcast.
    """
    context = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    narrow = docs.select("text", "held_out")
    size, ends = narrow.agg(F.sum(F.octet_length("text")), F.count_if(~F.col("held_out"))).first()
    buckets = max(8, -(-(size or 0) // BUCKET_BYTES))

    words = staged(_word_counts(narrow, buckets))
    least, of_counts, tokens, types = _profile(words, vocabulary)
    of_counts[min(ends, GOOD_TURING + 2)] += ends > 0
    unigrams = Unigrams(tokens + ends, types + (ends > 0), of_counts)
    known = Head(*_frequent(words, least), ends)
    pairs = _pair_counts(narrow, words, context.broadcast(known), buckets)
    least, of_counts, _, _ = _profile(pairs, head)
    values = staged(_values(pairs, context.broadcast((known, unigrams)), discounts(of_counts), least))
    dropped(pairs)
    shared = context.broadcast(Model(known, unigrams, _told(values, TOLD_HISTORIES), _told(values, TOLD_PAIRS)))
    return _looked_up(docs, words, values.where(F.col("kind") < 0), shared, buckets).select(
        "doc_id", "held_out", F.round("n_tokens").cast("long").alias("n_tokens"), F.round("n_known").cast("long").alias("n_known"), F.lit(unigrams.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


_QUESTIONS = ("word_keys", "word_counts", "word_texts", "pair_keys", "pair_counts", "pair_texts")
_ASKED = pa.schema(
    [("bucket", pa.int32()), ("kind", pa.int32()), ("piece", pa.int64())]
    + [(name, pa.binary()) for name in (*_QUESTIONS, "local")]
    + [("doc_ids", pa.list_(pa.int64())), ("folds", pa.list_(pa.bool_()))]
)
_ASKED_DDL = "bucket int, kind int, piece long, " + ", ".join(f"{c} binary" for c in (*_QUESTIONS, "local")) + ", doc_ids array<long>, folds array<boolean>"
_TOLD = pa.schema(
    [("kind", pa.int32()), ("piece", pa.int64())]
    + [(name, pa.binary()) for name in ("texts", "known", "base", "score")]
    + [("doc_ids", pa.list_(pa.int64())), ("folds", pa.list_(pa.bool_()))]
)
_TOLD_DDL = "kind int, piece long, texts binary, known binary, base binary, score binary, doc_ids array<long>, folds array<boolean>"


def _row(schema: pa.Schema, **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v := values.get(f.name), pa.Array) else pa.array([v], f.type) for f in schema], schema=schema)


def _list(column: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def _short(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint16) if len(values) == 0 or values.max() < 1 << 16 else values.astype(np.int64)


def _long(data: bytes, n: int) -> np.ndarray:
    return unframed(data, np.uint16 if int.from_bytes(data[:8], "little") == 2 * n else np.int64).astype(np.int64)


def _question(keys: np.ndarray, bucket: np.ndarray, text: np.ndarray, buckets: int) -> dict[int, tuple[bytes, bytes, bytes]]:
    """Per bucket: its distinct keys, how often each occurs, and the texts of the occurrences in key order."""
    order = np.lexsort((text, keys, bucket))
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    out = {}
    for b in np.flatnonzero(np.diff(bounds)):
        part = order[bounds[b] : bounds[b + 1]]
        mine = keys[part]
        new = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        counts = np.diff(np.append(new, len(mine)))
        out[int(b)] = pack_keys(mine[new]), framed(_narrow(counts)), framed(_short(text[part]))
    return out


def _found(table: tuple[np.ndarray, np.ndarray] | None, keys: np.ndarray) -> np.ndarray:
    counts = np.zeros(len(keys), np.int64 if table is None else table[1].dtype)
    if table is not None and len(table[0]) and len(keys):
        spot = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        same = table[0][spot] == keys
        counts[same] = table[1][spot[same]]
    return counts


def _looked_up(docs: DataFrame, words: DataFrame, values: DataFrame, shared, buckets: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score and score of every row.

    Pieces ask buckets and get their answers back under a hash of their rows; equal pieces have equal answers, so sums of
    several are divided by their number.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        head = model.head
        for piece in T.pieces(batches, limit=PAIR_BYTES):
            found = T.words(piece.column("text"), lower=True)
            codes, history, text = head.sequence(found)
            n = len(found)
            # Words and histories of the head, and frequent pairs, are settled here; the rest is looked up. A word outside the head is
            # the history of the token after it, so its bow is asked for with its probability.
            far, distant = codes >= NAMED, history >= NAMED
            number, before = np.where(far, 0, codes).astype(np.int64), np.where(distant, 0, history).astype(np.int64)
            counts = np.where(far, 0, head.counts[number])
            value = np.where(far, 0.0, model.log_unigram[number]) + np.where(distant, 0.0, model.log_bow[before])
            keys = pair_keys(history, codes)
            settled = np.zeros(len(keys), bool)
            if len(model.pairs[0]):
                spot = np.minimum(np.searchsorted(model.pairs[0], keys), len(model.pairs[0]) - 1)
                settled = model.pairs[0][spot] == keys
                value[settled] += model.pairs[1][spot[settled]]
            base = np.log10(counts + 1.0) - model.unigrams.base
            local = np.stack([np.bincount(text, w, n) for w in (np.ones(len(codes)), counts > 0, base, value)])
            hashes = piece.column("text_hash").to_numpy().view(np.uint64)
            identity = T.mix(T.mix(hashes + T.M1 * piece.column("doc_id").fill_null(-1).to_numpy().view(np.uint64)) + np.arange(n, dtype=np.uint64) * T.M3).sum()
            name = int(np.array([identity]).view(np.int64)[0])
            home = int(identity % np.uint64(buckets))
            yield _row(_ASKED, bucket=home, kind=0, piece=name, local=framed(local), doc_ids=_list(piece.column("doc_id")), folds=_list(piece.column("held_out")))
            rest = np.flatnonzero(~settled)
            asked = {
                "word": _question(codes[far], _deal(codes[far], buckets), text[far], buckets),
                "pair": _question(keys[rest], _deal(history[rest], buckets), text[rest], buckets),
            }
            for b in sorted(set().union(*asked.values())):
                parts = {f"{what}_{c}": v for what, by in asked.items() if b in by for c, v in zip(("keys", "counts", "texts"), by[b], strict=True)}
                yield _row(_ASKED, bucket=b, kind=1, piece=name, **parts)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        now = None
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, kind, piece = (batch.column(c)[i].as_py() for c in ("bucket", "kind", "piece"))
                if bucket != now:
                    now, tables = bucket, {}
                if kind < 0:  # a table of the bucket; these come first
                    keys, data = unpack_keys(batch.column("word_keys")[i].as_py()), batch.column("word_counts")[i].as_py()
                    tables[kind] = keys, _wide(data, len(keys)) if kind == WORDS else unframed(data, float if kind == HISTORIES else np.float32)
                    continue
                if kind == 0:
                    lists = {c: _list(batch.column(c)[i].values) for c in ("doc_ids", "folds")}
                    yield _row(_TOLD, kind=0, piece=piece, texts=batch.column("local")[i].as_py(), **lists)
                    continue
                told: list[tuple[str, np.ndarray, np.ndarray]] = []
                for what, table in (("word", WORDS), ("pair", PAIRS)):
                    packed = batch.column(f"{what}_keys")[i].as_py()
                    if packed is None:
                        continue
                    keys = unpack_keys(packed)
                    steps = _wide(batch.column(f"{what}_counts")[i].as_py(), len(keys))
                    texts = _long(batch.column(f"{what}_texts")[i].as_py(), int(steps.sum()))
                    found = _found(tables.get(table), keys)
                    if what == "word":
                        told += [("known", texts, np.repeat(found > 0, steps)), ("base", texts, np.repeat(np.log10(found + 1.0), steps))]
                        found = np.log10(np.maximum(model.unigrams.mass(found), 1e-300)) + _found(tables.get(HISTORIES), keys)
                    told.append(("score", texts, np.repeat(found.astype(float), steps)))
                touched = np.unique(np.concatenate([t for _, t, _ in told]))
                sums = {c: np.zeros(len(touched)) for c in ("known", "base", "score")}
                for c, texts, weight in told:
                    sums[c] += np.bincount(np.searchsorted(touched, texts), weight, len(touched))
                yield _row(_TOLD, kind=1, piece=piece, texts=framed(touched.astype(np.uint32)), known=framed(sums["known"].astype(np.float32)), base=framed(sums["base"]), score=framed(sums["score"]))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((c, pa.float64()) for c in ("n_tokens", "n_known", "base_score", "score"))])
        name, total, identities = None, None, []

        def results():
            for doc_ids, folds in identities:
                yield pa.RecordBatch.from_arrays([doc_ids, folds, *(pa.array(v / len(identities)) for v in total)], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                kind, piece = batch.column("kind")[i].as_py(), batch.column("piece")[i].as_py()
                texts = batch.column("texts")[i].as_py()
                if kind == 0:
                    if piece != name:
                        yield from results()
                        name, total, identities = piece, 0.0, []
                    total = total + unframed(texts, float).reshape(4, -1)
                    identities.append((batch.column("doc_ids")[i].values, batch.column("folds")[i].values))
                    continue
                at = unframed(texts, np.uint32)
                for place, (c, width) in enumerate((("known", np.float32), ("base", float), ("score", float)), start=1):
                    total[place][at] += unframed(batch.column(c)[i].as_py(), width)
        yield from results()

    nothing = {f.name: F.lit(None).cast({"piece": "long", "doc_ids": "array<long>", "folds": "array<boolean>"}.get(f.name, "binary")) for f in _ASKED if f.name not in ("bucket", "kind", "word_keys", "word_counts")}
    asked = docs.mapInArrow(ask, _ASKED_DDL)
    for table in (words, values):
        asked = asked.unionByName(table.select("bucket", "kind", F.col("keys").alias("word_keys"), F.col("counts").alias("word_counts")).withColumns(nothing))
    told = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(answer, _TOLD_DDL)
    told = told.repartition("piece").sortWithinPartitions("piece", "kind")
    return told.mapInArrow(add_up, "doc_id long, held_out boolean, n_tokens double, n_known double, base_score double, score double")

"""Benchmark decontamination by greedy string tiling.

A document is contaminated by a benchmark item if tiles cover at least ``threshold`` of the item's words. Tiles are
found greedily: mark the longest match of unmarked words on both sides, repeat with what is left, down to ``least``
words. Matches are found by running Karp-Rabin: rolling hashes of all unmarked runs of one length, equal hashes verified word by
word, lengths falling from long to short. Tiles may lie in any order, so reordered passages count.

The join on shared tokens comes first: every run of ``least`` words of a document is looked up in the index of the
items' runs (the seeds). A tile consists of seeds only, so tiling a document needs just the words that seeds cover, and an
item is skipped if its places with a shared seed (a seed repeated in the item counts at each place) are too few to reach
the threshold; neither loses a tile.

The index is broadcast in slices of at most about ``SLICE_BYTES`` of item text. With several slices each makes its own pass over the
documents, whose result is written before the next index is built, so a benchmark of any size is handled with bounded memory. Words are lower-cased alphanumeric runs.

Defined results: null or empty texts hold nothing; an item of fewer than ``least`` words, or null, is never found; a repeated
item is found under each id, a repeated row gives repeated results; a null doc_id is reported as such; no
document or no item gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltlab.llm import tokens as T
from tiltlab.session import staged

LEAST = 4
THRESHOLD = 0.5
SLICE_BYTES = 4 << 20
_FILTER_BITS = 22


class _Rolling:
    """Hashes of all runs of a sequence, of any length, from one pass: differences of running sums of scaled words."""

    def __init__(self, words: np.ndarray):
        up, self.down = T.powers(len(words), T.SEQ1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(T.mix(words) * up, out=self.sums[1:])

    def runs(self, marked: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the runs of ``length`` unmarked words."""
        if len(marked) < length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        before = np.concatenate([[0], np.cumsum(marked)])
        at = np.flatnonzero(before[length:] == before[:-length])
        return at, (self.sums[at + length] - self.sums[at]) * self.down[at]


def _matches(here: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Which of ``here`` occur in ``there``, the smaller one sorted."""
    return np.isin(here, there) if len(here) and len(there) else np.zeros(len(here), bool)


def greedy_tiles(pattern: np.ndarray, text: np.ndarray, least: int = LEAST, breaks: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(pattern start, text start, length) of the tiles; ``breaks`` marks words of ``text`` no tile may contain.

    The longest match of unmarked words is marked, the first in the pattern and then in the text if tied, until none of ``least`` words is
    left. Its length is found by halving, since a match of some length holds matches of all shorter ones; all matches of
    that length are then marked in order. So a length costs a few passes over both sequences, however often words repeat in them.
    """
    in_pattern = np.zeros(len(pattern), bool)
    in_text = np.zeros(len(text), bool) if breaks is None else breaks.copy()
    mine, other = _Rolling(pattern), _Rolling(text)
    tiles: list[tuple[int, int, int]] = []
    top = min(len(pattern), len(text))

    def shared(length: int) -> bool:
        return bool(_matches(mine.runs(in_pattern, length)[1], other.runs(in_text, length)[1]).any())

    while top >= least and shared(least):
        low, high = least, top
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if shared(middle) else (low, middle - 1)
        here, hashes = mine.runs(in_pattern, low)
        there, others = other.runs(in_text, low)
        common = _matches(others, hashes)
        there, others = there[common], others[common]
        order = np.argsort(others, kind="stable")
        there, others = there[order], others[order]
        first = np.searchsorted(others, hashes, side="left").tolist()
        after = np.searchsorted(others, hashes, side="right").tolist()
        spent: dict[int, int] = {}  # of the places with one hash, those before are marked by now
        for p, start, end in zip(here.tolist(), first, after, strict=True):
            if start == end or in_pattern[p : p + low].any():
                continue
            at = spent.get(start, start)
            while at < end:
                t = int(there[at])
                if not in_text[t : t + low].any() and (pattern[p : p + low] == text[t : t + low]).all():
                    in_pattern[p : p + low] = in_text[t : t + low] = True
                    tiles.append((p, t, low))
                    break
                at += 1
            spent[start] = at
        top = low - 1  # a pass leaves no match of its length
    return tiles


class SeedIndex:
    """Runs of ``least`` words of the items, sorted by hash, with the items that hold each and at how many places."""

    def __init__(self, ids: pa.Array, texts: pa.Array, least: int):
        found = T.words(texts, T.NOT_ALNUM, lower=True)
        self.ids, self.least = ids, least
        self.items = [found.hash[a:b] for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
        self.sizes = found.counts()
        good = T.inside_one(found.first, least, len(found.hash))
        hashes, owner = T.windows(found.hash, least)[good], found.doc()[: len(good)][good]
        none = np.zeros((2, 0), np.uint64), np.zeros(0, np.int64)
        pairs, self.places = np.unique(np.stack([hashes, owner.astype(np.uint64)]), axis=1, return_counts=True) if len(hashes) else none
        self.seeds, self.heads = np.unique(pairs[0], return_index=True)
        self.heads = np.append(self.heads, pairs.shape[1])
        self.owners = pairs[1].astype(np.int64)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.seeds >> np.uint64(64 - _FILTER_BITS)] = True

    def match(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of ``hashes`` that are seeds, and which."""
        at = np.flatnonzero(self.filter[hashes >> np.uint64(64 - _FILTER_BITS)])
        spot = np.minimum(np.searchsorted(self.seeds, hashes[at]), max(len(self.seeds) - 1, 0))
        same = self.seeds[spot] == hashes[at] if len(self.seeds) else np.zeros(0, bool)
        return at[same], spot[same]


def _covered(found: T.Words, index: SeedIndex, threshold: float) -> Iterator[tuple[int, int, int]]:
    """(document, item, covered words) for the pairs of a piece that reach the threshold."""
    least = index.least
    at, seed = index.match(T.windows(found.hash, least))
    owner = np.searchsorted(found.first, at, side="right") - 1
    whole = at + least <= found.first[owner + 1]
    at, seed, owner = at[whole], seed[whole], owner[whole]
    if not len(at):
        return
    # Places of the item with a shared seed: a tile of n words has n - least + 1 of them, so at least a share 1 / least.
    held = index.heads[seed + 1] - index.heads[seed]
    row = np.repeat(np.arange(len(at)), held)
    entry = np.repeat(index.heads[seed], held) + np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held)
    item = index.owners[entry]
    order = np.lexsort((seed[row], item, owner[row]))
    row, item, entry = row[order], item[order], entry[order]
    doc, kind = owner[row], seed[row]
    fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (kind[1:] != kind[:-1])])
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]))
    places = np.add.reduceat(np.where(fresh, index.places[entry], 0), new)
    ends = np.append(new[1:], len(row))
    for k in np.flatnonzero(places * least >= threshold * index.sizes[item[new]]):
        d, i = int(doc[new[k]]), int(item[new[k]])
        starts = np.sort(at[row[new[k] : ends[k]]])
        # Only words under seeds, a break where they are not adjacent.
        spots = np.unique((starts[:, None] + np.arange(least)).ravel())
        gap = np.flatnonzero(np.diff(spots) > 1) + 1
        text = np.insert(found.hash[spots], gap, 0)
        breaks = np.insert(np.zeros(len(spots), bool), gap, True)
        covered = sum(n for _, _, n in greedy_tiles(index.items[i], text, least, breaks))
        if covered >= threshold * index.sizes[i]:
            yield d, i, covered


def _slices(items: DataFrame, limit: int) -> Iterator[tuple[pa.Table, int]]:
    """The items in slices of about ``limit`` bytes of text, with the number of slices; the total is measured first."""
    items = items.select("item_id", "text").where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // limit)
    for number in range(count):
        yield items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == number).toArrow(), count


def contaminated(docs: DataFrame, items: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, limit: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, text_hash, item_id, item_words, covered_words, coverage) of every contaminating pair."""
    spark = docs.sparkSession
    narrow = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    schema = "doc_id long, text_hash long, item_id long, item_words long, covered_words long, coverage double"
    parts = []
    for table, slices in _slices(items, limit):
        index = SeedIndex(table.column("item_id").combine_chunks().cast(pa.int64()), table.column("text").combine_chunks(), least)
        shared = spark.sparkContext.broadcast(index)

        def tile(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for piece in T.pieces(batches):
                found = list(_covered(T.words(piece.column("text"), T.NOT_ALNUM, lower=True), index, threshold))
                if found:
                    doc, item, covered = (pa.array([f[k] for f in found], pa.int64()) for k in range(3))
                    sizes = index.sizes[item.to_numpy()]
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("doc_id").take(doc), piece.column("text_hash").take(doc), index.ids.take(item), pa.array(sizes), covered, pa.array(covered.to_numpy() / sizes)],
                        names=["doc_id", "text_hash", "item_id", "item_words", "covered_words", "coverage"],
                    )

        part = narrow.mapInArrow(tile, schema)
        if slices > 1:
            part = staged(part)
            shared.destroy()
        parts.append(part)
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def remove_contaminated(docs: DataFrame, items: DataFrame, least: int = LEAST, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text covers some item."""
    doc, text = T.spare(docs, "id", "hash")
    found = contaminated(docs, items, least, threshold).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(text)), "left_anti")

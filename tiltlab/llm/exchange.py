"""Sketches merged over tasks, of fixed size whatever the input.

Tasks reduce their rows to cells, the cells are shuffled by slice and merged there, and only the merged
sketch reaches the driver to be broadcast. Its size is set by ``bits``, not by the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tiltlab.llm.tokens import M3, mix

SLICES = 64
FLUSH = 2_000_000
# Keys counted at once where a task's sums of all cells would take too much memory.
DENSE_BITS = 22
SUMS_FLUSH = 6_000_000
Keys = Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]


def framed(values: np.ndarray) -> bytes:
    """``values`` with their size in bytes in front, compressed."""
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unframed(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], size, "zstd", asbytes=True) if size else b"", kind)


def cell(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(keys + np.uint64((row + 1) * int(M3) % 2**64)) >> np.uint64(64 - bits)


class RepeatSketch:
    """Two-row count-min sketch, kept as one bit a cell: was the cell hit twice or more?

    Counts are overestimated by collisions and never underestimated, so ``repeated`` is true for every
    key that occurred twice; it is also true for a few that did not.
    """

    rows = 2

    def __init__(self, bits: int, maps: list[np.ndarray]):
        self.bits, self.maps = bits, maps

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        hit = np.ones(len(keys), bool)
        for row, bitmap in enumerate(self.maps):
            at = cell(keys, row, self.bits)
            hit &= (bitmap[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1)).astype(bool)
        return hit


def repeat_sketch(df: DataFrame, keys: Keys, bits: int, least: int = 2) -> RepeatSketch:
    """Merge the cell counts of all partitions of ``df``; ``keys`` yields the occurrences of a partition.

    ``least`` 1 makes a Bloom filter of the keys instead. An empty table gives an empty sketch.
    """
    width = bits - SLICES.bit_length() + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for part in keys(batches):
            held.append(part)
            size += len(part)
            if size > FLUSH:
                yield _cells(np.concatenate(held), bits, width, least)
                held, size = [], 0
        if size:
            yield _cells(np.concatenate(held), bits, width, least)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, once, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = total.setdefault(number, np.zeros(1 << width, np.uint8))
                at = unframed(once, np.uint32)
                counts[at] = np.minimum(counts[at] + 1, least)
                counts[unframed(more, np.uint32)] = least
        for number, counts in total.items():
            yield pa.RecordBatch.from_pydict({"slice": [number], "bitmap": [np.packbits(counts >= least).tobytes()]}, schema=_BITMAP)

    found = (
        df.mapInArrow(count, "slice int, once binary, more binary")
        .repartition("slice")
        .mapInArrow(merge, "slice int, bitmap binary")
        .toLocalIterator()  # one slice at a time on the driver
    )
    maps = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(RepeatSketch.rows)]
    for number, bitmap in found:
        row, at = divmod(number, SLICES)
        maps[row][at << (width - 3) : (at + 1) << (width - 3)] = np.frombuffer(bitmap, np.uint8)
    return RepeatSketch(bits, maps)


_BITMAP = pa.schema([("slice", pa.int32()), ("bitmap", pa.binary())])


def _cells(keys: np.ndarray, bits: int, width: int, least: int) -> pa.RecordBatch:
    rows = {"slice": [], "once": [], "more": []}
    for row in range(RepeatSketch.rows):
        at = np.sort(cell(keys, row, bits).astype(np.uint32))
        at, counts = np.unique(at, return_counts=True)
        bounds = np.searchsorted(at, np.arange(SLICES + 1, dtype=np.int64) << width)
        for number in range(SLICES):
            part = slice(bounds[number], bounds[number + 1])
            local = at[part] & np.uint32((1 << width) - 1)
            twice = counts[part] >= least
            if len(local):
                rows["slice"].append(row * SLICES + number)
                rows["once"].append(framed(local[~twice]))
                rows["more"].append(framed(local[twice]))
    return pa.RecordBatch.from_pydict(rows, schema=pa.schema([("slice", pa.int32()), ("once", pa.binary()), ("more", pa.binary())]))


def frequency_levels(df: DataFrame, keys: Keys, bits: int) -> np.ndarray:
    """How frequent each of ``2 ** bits`` hash cells is over all partitions: eight times the binary logarithm of its exact sum plus one.

    Up to ``DENSE_BITS`` a task sends its sums of all cells, beyond that its cells with keys, by sorted steps; only levels reach the driver.
    """
    width = bits - SLICES.bit_length() + 1
    none = framed(np.zeros(0, np.uint32))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for part in keys(batches):
            total += np.bincount(cell(part, 0, bits).astype(np.int64), minlength=1 << bits)
        if total.any():
            parts = total.reshape(SLICES, -1)
            yield pa.RecordBatch.from_pydict({"slice": list(range(SLICES)), "steps": [none] * SLICES, "sums": [framed(p) for p in parts]}, schema=_SUMS)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for part in keys(batches):
            held.append(cell(part, 0, bits).astype(np.uint32))
            size += len(part)
            if size > SUMS_FLUSH:
                yield _sums(np.concatenate(held), width)
                held, size = [], 0
        if size:
            yield _sums(np.concatenate(held), width)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, steps, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = total.setdefault(number, np.zeros(1 << width, np.int64))
                if steps == none:
                    counts += unframed(sums, np.int64)
                else:
                    sums = unframed(sums, np.uint32)
                    wide = int.from_bytes(steps[:8], "little") == 4 * len(sums)
                    counts[np.cumsum(unframed(steps, np.uint32 if wide else np.uint16), dtype=np.int64)] += sums
        for number, counts in total.items():
            levels = np.minimum(255, np.floor(8 * np.log2(counts + 1.0))).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"slice": [number], "levels": [framed(levels)]}, schema=_LEVELS)

    found = df.mapInArrow(dense if bits <= DENSE_BITS else sparse, "slice int, steps binary, sums binary")
    found = found.repartition("slice").mapInArrow(merge, "slice int, levels binary")
    levels = np.zeros(1 << bits, np.uint8)
    for number, part in found.collect() if bits <= DENSE_BITS else found.toLocalIterator():
        levels[number << width : (number + 1) << width] = unframed(part, np.uint8)
    return levels


_SUMS = pa.schema([("slice", pa.int32()), ("steps", pa.binary()), ("sums", pa.binary())])
_LEVELS = pa.schema([("slice", pa.int32()), ("levels", pa.binary())])


def _sums(cells: np.ndarray, width: int) -> pa.RecordBatch:
    """A row for each slice: its cells as sorted steps, and how often each was hit."""
    at, counts = np.unique(cells, return_counts=True)
    bounds = np.searchsorted(at, np.arange(SLICES + 1, dtype=np.int64) << width)
    rows: dict[str, list] = {name: [] for name in _SUMS.names}
    for number in np.flatnonzero(np.diff(bounds)):
        part = slice(bounds[number], bounds[number + 1])
        steps = np.diff(at[part], prepend=np.uint32(int(number) << width))
        rows["slice"].append(int(number))
        rows["steps"].append(framed(steps if steps.max() >= 1 << 16 else steps.astype(np.uint16)))
        rows["sums"].append(framed(counts[part].astype(np.uint32)))
    return pa.RecordBatch.from_pydict(rows, schema=_SUMS)

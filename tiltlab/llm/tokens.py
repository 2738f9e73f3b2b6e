"""Words of whole texts as numpy arrays, for Arrow batches inside tasks.

A word is a maximal run of bytes outside a separator set. Every byte of UTF-8 above 0x7F belongs to a
code point that is never a separator here, so splitting bytes equals splitting code points. Words are
represented by 64-bit hashes of their bytes; sequences of words by hashes over those.

Texts are cut into pieces of bounded size, so memory follows the piece, not the table; a single text is
never cut, and costs about 40 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Separators are space and 0x09-0x0D for plain words; all but digits, letters and
# bytes above 0x7F for alphanumeric words (texts are lower-cased first).
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x30:0x3A] = False
NOT_ALNUM[0x61:0x7B] = False
NOT_ALNUM[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

PIECE_BYTES = 6 << 20
# Odd multipliers with well spread bits.
M1, M2, M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
SEQ1, SEQ2 = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


def spare(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while f"_{name}" in taken:
            name = f"_{name}"
        out.append(f"_{name}")
    return out


@dataclass
class Words:
    """Words of consecutive texts: ``hash``, byte ``start`` and ``end`` in ``data``, and for text i the
    words ``first[i]:first[i + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(len(self), dtype=np.int64), self.counts())


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(column: pa.Array, separators: np.ndarray = SPACE, lower: bool = False) -> Words:
    data, offsets = buffers(column)
    if lower:
        data = LOWER[data]
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, np.zeros(0, np.uint64), none, none, np.zeros(len(column) + 1, np.int64))
    inside = ~separators[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    starts[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= ~(inside[1:] & ~starts[1:])
    start = np.flatnonzero(starts)
    end = np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    return Words(data, offsets, _hashes(data, start, end), start, end, first)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes at a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    length = end - start
    result = mix(length.astype(np.uint64) * M3)
    rest, at, left = np.arange(len(start)), start, length
    while len(rest):
        part = eight[at]
        short = np.flatnonzero(left < 8)
        part[short] &= (np.uint64(1) << (left[short].astype(np.uint64) << np.uint64(3))) - np.uint64(1)
        if len(rest) == len(result):
            result = mix(result + part * M3)
        else:
            result[rest] = mix(result[rest] + part * M3)
        more = left > 8
        rest, at, left = rest[more], at[more] + 8, left[more] - 8
    return result


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    up = np.full(n, base % 2**64, np.uint64)
    down = np.full(n, pow(base, -1, 2**64), np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def windows(hashes: np.ndarray, size: int, base: int = SEQ1) -> np.ndarray:
    """Hash of every run of ``size`` consecutive hashes (also runs that cross texts)."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    if size <= 8:
        total = hashes[: len(hashes) - size + 1].copy()
        for k in range(1, size):
            total *= np.uint64(base)
            total += hashes[k : len(hashes) - size + 1 + k]
        return mix(total)
    up, down = powers(len(hashes), base)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[: len(hashes) - size + 1])


def inside_one(first: np.ndarray, size: int, total: int) -> np.ndarray:
    """Positions whose run of ``size`` words lies within one text."""
    good = np.ones(max(total - size + 1, 0), bool)
    for k in range(1, size):  # a run starting at p crosses a boundary b if p < b < p + size
        cut = first[1:-1] - k
        good[cut[(cut >= 0) & (cut < len(good))]] = False
    return good


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values, by doubling."""
    span, out = 1, values
    while span * 2 <= size:
        out = np.minimum(out[:-span], out[span:]) if len(out) > span else out[:0]
        span *= 2
    rest = size - span
    if rest:
        out = np.minimum(out[:-rest], out[rest:]) if len(out) > rest else out[:0]
    return out

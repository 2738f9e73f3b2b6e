"""Substring de-duplication behind a merged count-min sketch.

A window is ``size`` consecutive words of one document. Every word covered by a window whose word
sequence starts at two or more places of the table, the same document included, is removed.

1. Each window names an anchor: the occurrence of its smallest eight-word hash, leftmost if tied. Equal
   windows name anchors of equal hash at equal distance, so a repeated window has an anchor hash that
   occurs at two positions or more. Tasks count anchor occurrences in a count-min sketch; the merged sketch
   overestimates the windows' counts and underestimates none. It is sized by the table's bytes (see ``sketch_size``).
2. Windows whose anchor is estimated repeated are grouped exactly by a 128-bit fingerprint of their words.
   A window found twice within one piece of the table is settled there and sends a single row without a
   place, so a passage in a third of all documents costs one row a piece, not one a document.
3. Places of repeated windows return to their documents, which drop the covered words.

Keys are (doc_id, hash of the text): documents that share an id are told apart by text, and equal rows get
equal results.

Defined results: a null text has no words; texts shorter than a window keep all words; equal rows repeat each
other; an empty table gives an empty result. Extra columns are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tiltlab.llm import tokens as T
from tiltlab.llm.exchange import repeat_sketch
from tiltlab.session import staged

WINDOW = 35
GRAM = 8
SKETCH_BITS = 28  # at most: two maps of 32 MB
ROOM = 4
WORD_BYTES = 6
_POSITION = np.uint64(24)


def anchors(found: T.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start words of the windows of a piece and the word at which each one's anchor starts."""
    total = len(found.hash)
    grams = T.windows(found.hash, GRAM)
    if total < size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(T.inside_one(found.first, size, total))
    span = size - GRAM + 1
    low = np.empty(total - size + 1, np.int64)
    step = (1 << int(_POSITION)) - span + 1  # windows of a part whose positions fit beside the hash
    for at in range(0, len(low), step):
        part = grams[at : at + step + span - 1]
        ranked = (part >> _POSITION << _POSITION) | np.arange(len(part), dtype=np.uint64)
        low[at : at + step] = at + (T.sliding_min(ranked, span) & np.uint64((1 << int(_POSITION)) - 1)).astype(np.int64)
    return starts, low[starts]


def _class_of(hashes: np.ndarray, classes: int) -> np.ndarray:
    """Classes of anchors; sketch cells come from other bits."""
    return (T.mix(hashes ^ np.uint64(T.SEQ2)) % np.uint64(classes)).astype(np.int64)


def _anchor_hashes(size: int, number: int = 0, classes: int = 1):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for piece in T.pieces(batches):
            found = T.words(piece.column("text"))
            _, at = anchors(found, size)
            if len(at):
                places = at[np.concatenate([[True], at[1:] != at[:-1]])]
                hashes = T.windows(found.hash, GRAM)[places]
                yield hashes if classes == 1 else hashes[_class_of(hashes, classes) == number]

    return keys


def sketch_size(n_bytes: int, size: int, most: int = SKETCH_BITS) -> tuple[int, int]:
    """Bits of the sketch and number of anchor classes for so many bytes of text.

    A window of random words changes its anchor every (size - GRAM + 2) / 2 words on average, and a word is taken to have ``WORD_BYTES``. Cells
    outnumber anchors by ``ROOM`` to twice that, so an anchor that does not repeat seldom passes. Beyond ``2 ** most`` cells, anchors are split
    into classes, each with a sketch and a pass of its own: the load of a sketch stays the same at every size.
    """
    cells = ROOM * max(n_bytes, 1) * 2 // (WORD_BYTES * (size - GRAM + 2))
    bits = max(cells.bit_length(), 16)
    return (bits, 1) if bits <= most else (most, -(-cells >> most))


def repeated_windows(docs: DataFrame, size: int = WINDOW, bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, text_hash, starts): first words of the repeated windows of each document that has any.

    A sketch has at most ``2 ** bits`` cells.
    """
    narrow = docs.select("doc_id", "text")
    bits, classes = sketch_size(narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0, size, bits)
    found = [_repeated_of_class(narrow, size, bits, number, classes) for number in range(classes)]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("doc_id", "text_hash").agg(F.collect_list("place").alias("starts"))


def _repeated_of_class(narrow: DataFrame, size: int, bits: int, number: int, classes: int) -> DataFrame:
    """(doc_id, text_hash, place) of the repeated windows whose anchors are of one class."""
    context = narrow.sparkSession.sparkContext
    sketch = context.broadcast(repeat_sketch(narrow, _anchor_hashes(size, number, classes), bits))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in T.pieces(batches):
            found = T.words(piece.column("text"))
            starts, at = anchors(found, size)
            if not len(starts):
                continue
            change = np.concatenate([[True], at[1:] != at[:-1]])
            hashes = T.windows(found.hash, GRAM)[at[change]]
            known = sketch.value.repeated(hashes)
            if classes > 1:
                known &= _class_of(hashes, classes) == number
            starts = starts[known[np.cumsum(change) - 1]]
            if not len(starts):
                continue
            high = T.windows(found.hash, size, T.SEQ1)[starts]
            low = T.windows(found.hash, size, T.SEQ2)[starts]
            order = np.lexsort((low, high))
            high, low, starts = high[order], low[order], starts[order]
            new = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
            group = np.cumsum(new) - 1
            several = np.bincount(group) > 1
            doc = np.searchsorted(found.first, starts, side="right") - 1
            place = starts - found.first[doc]
            ids, texts = piece.column("doc_id"), piece.column("text_hash")
            # A row for each sequence: with its place if that is the only one here.
            head = np.flatnonzero(new)
            alone = ~several[group[head]]
            where = pa.array(doc[head], mask=~alone)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(high[head].view(np.int64)),
                    pa.array(low[head].view(np.int64)),
                    ids.take(where),
                    texts.take(where),
                    pa.array(place[head].astype(np.int32), mask=~alone),
                    pa.array(np.where(alone, 1, 2).astype(np.int32)),
                ],
                names=_NAMES,
            )
            # The places of those settled here, with no fingerprint.
            here = np.flatnonzero(several[group])
            if len(here):
                none = pa.nulls(len(here), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [none, none, ids.take(pa.array(doc[here])), texts.take(pa.array(doc[here])), pa.array(place[here].astype(np.int32)), pa.array(np.full(len(here), 2, np.int32))],
                    names=_NAMES,
                )

    rows = narrow.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(candidates, _ROWS)
    settled = rows.where("high IS NULL")
    # Rows of one sequence: at most one for each piece of the table.
    total = F.sum("n").over(Window.partitionBy("high", "low"))
    matched = rows.where("high IS NOT NULL").withColumn("total", total).where("total > 1 AND place IS NOT NULL").drop("total")
    repeated = settled.unionByName(matched).select("doc_id", "text_hash", "place")
    if classes > 1:  # written, so that one sketch is held at a time
        repeated = staged(repeated)
        sketch.destroy()
    return repeated


_NAMES = ["high", "low", "doc_id", "text_hash", "place", "n"]
_ROWS = "high long, low long, doc_id long, text_hash long, place int, n int"


def with_repeats(docs: DataFrame, size: int = WINDOW, bits: int = SKETCH_BITS, name: str = "repeat_starts") -> DataFrame:
    """``docs`` with a column ``name``: the first words of each document's repeated windows, or null."""
    doc, text = T.spare(docs, "id", "hash")
    marks = repeated_windows(docs, size, bits)
    marks = marks.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text), F.col("starts").alias(name))
    on = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(text))
    return docs.join(marks, on, "left").drop(doc, text)


def covered(starts: np.ndarray, n_words: int, size: int) -> np.ndarray:
    """Which of a document's words lie in a window that starts at one of ``starts``."""
    depth = np.zeros(n_words + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, np.minimum(np.asarray(starts) + size, n_words), -1)
    return np.cumsum(depth)[:n_words] > 0


def _documents(piece: pa.RecordBatch, size: int, name: str = "repeat_starts"):
    """Words of each text of a piece with the mask of removed ones."""
    found = T.words(piece.column("text"))
    starts = piece.column(name)
    data = found.data.tobytes()
    for i in range(len(found)):
        part = slice(found.first[i], found.first[i + 1])
        n = found.first[i + 1] - found.first[i]
        mine = starts[i]
        gone = covered(mine.values.to_numpy(zero_copy_only=False), n, size) if mine.is_valid else None
        yield data, found, i, part, n, gone


def removal_digests(docs: DataFrame, size: int = WINDOW, bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in T.pieces(batches):
            rows = {"n_words": [], "n_removed": [], "kept_sha256": []}
            for data, found, i, part, n, gone in _documents(piece, size):
                text = data[found.offsets[i] : found.offsets[i + 1]].split()
                if gone is not None:
                    text = [w for w, out in zip(text, gone.tolist(), strict=True) if not out]
                rows["n_words"].append(int(n))
                rows["n_removed"].append(int(n) - len(text))
                rows["kept_sha256"].append(hashlib.sha256(b" ".join(text)).hexdigest())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(v) for v in rows.values())], names=["doc_id", *rows])

    marked = with_repeats(docs.select("doc_id", "text"), size, bits)
    return marked.mapInArrow(digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, size: int = WINDOW, bits: int = SKETCH_BITS) -> DataFrame:
    """``docs`` with the repeated words cut out of ``text``; a column ``n_chars`` follows the new text.

    A removed word takes the white space after it along. Texts without a repeated window stay as they are.
    """
    fields = [StructField("text", StringType()) if f.name == "text" else f for f in docs.schema.fields]
    (name,) = T.spare(docs, "repeat_starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in T.pieces(batches):
            texts = piece.column("text").to_pylist()
            for data, found, i, part, n, gone in _documents(piece, size, name):
                if gone is None:
                    continue
                first, last = found.offsets[i], found.offsets[i + 1]
                heads = np.append(found.start[part], last)
                kept = [data[first : heads[0]]] + [data[heads[k] : heads[k + 1]] for k in np.flatnonzero(~gone)]
                texts[i] = b"".join(kept).decode()
            at = piece.schema.get_field_index("text")
            out = piece.set_column(at, "text", pa.array(texts, pa.string()))
            yield out.drop_columns([name])

    out = with_repeats(docs, size, bits, name).mapInArrow(cut, StructType(fields))
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(dict(docs.dtypes)["n_chars"])
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))
    return out

"""Exact near-duplicate join on word shingles by T-occurrence search.

Two documents link when their sets of distinct five-word shingles have a Jaccard similarity of at least
``threshold`` (an exact integer comparison). The join finds every component that such links form.

1. *Profile.* Tasks hash each text's shingles, give the set's size and a 128-bit fingerprint, and add up how
   often each hash cell of shingles occurs (a sketch of fixed size).
2. *Prefixes.* Shingles are ordered by cell frequency, rarest first, and each set is posted under its first ones, by size class
   (see ``postings``); linked documents share a block. Postings are packed by bucket of blocks and dealt once (see ``pack``);
   each bucket connects the sets of its blocks (see ``match``): a block of many sets by a leader, one of at most ``FEW`` by
   pairs, less those that sizes or parity bits prove unlinked. Components of that graph (*regions*) hold every link.
3. *T-occurrence.* The texts of each region's sets are gathered (they are shorter than their hashes), one for each distinct set. Small regions share a group;
   a large region is cut into chunks of ``CHUNK`` sets. Within a group an inverted index over shingles is searched
   with every set: DivideSkip merges the short lists, keeps candidates that reach the required overlap less the
   number of long lists, probes the long lists by binary search and retains sets that reach the overlap. Sets
   already known to be connected are not compared again.
4. Large regions run twice: first each chunk by itself and against the region's first chunk, which connects groups of
   near copies in linear work; then those pairs of chunks that still hold more than one component and whose sizes
   can meet the threshold. So no link between components is lost and no list of all pairs is written.

Short lists are merged by a stable merge sort of the sorted runs rather than with a Python heap: same order,
vectorised.

Defined results: a document without words has size 0, links with nothing and is its own component; one with fewer
than five words has its whole sequence as its single shingle; equal sets link (one row stands for them);
a null doc_id gets a null component and links with nothing; equal rows get equal results; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiltlab.llm import tokens as T
from tiltlab.llm.exchange import cell, framed, frequency_levels, repeat_sketch, unframed
from tiltlab.llm.graph import components
from tiltlab.session import staged

SIZE = 5
PERCENT = 75
# Cells for the order of shingles: one for each ``CELL_LOAD`` shingles, within these bounds. Other orders post more, none loses a link.
FREQUENCY_BITS = (22, 26)
CELL_LOAD = 32
CHOSEN_BITS = 24
CHUNK = 1000
FEW = 16
PARITY_BITS = 1024
# A set's signature has two bits a shingle at least, within these bounds.
SIGNATURE_BITS = (1 << 8, 1 << 16)
# Of a block's hash this many bits are kept: blocks that fall together cost a comparison, never a link.
KEY_BITS = 48
# Postings packed at once in a task, and shingles for which there is one bucket.
FLUSH = 3_000_000
BUCKET = 6_000_000
POST, EDGE, WAIT, LEAD, PAIR = range(5)
INDEXED, HOT = 1, 2
_DEALT = pa.schema(
    [("bucket", pa.int32()), ("kind", pa.int32()), ("key", pa.binary()), ("owner", pa.binary()), ("flag", pa.binary()), ("a", pa.binary()), ("n", pa.binary())]
)


def shingle_sets(column: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within it, and where each text's begin."""
    found = T.words(column, lower=True)
    doc = found.doc()
    good = T.inside_one(found.first, size, len(found.hash))
    hashes, owner = T.windows(found.hash, size)[good], doc[: len(good)][good]
    counts = found.counts()
    for k in range(1, size):  # whole sequences of shorter texts
        short = np.flatnonzero(counts == k)
        if len(short):
            rows = found.hash[found.first[short][:, None] + np.arange(k)]
            total = np.full(len(short), k * int(T.M3) % 2**64, np.uint64)
            for j in range(k):
                total = T.mix(total * np.uint64(T.SEQ2) + rows[:, j])
            hashes, owner = np.concatenate([hashes, total]), np.concatenate([owner, short])
    # One sort by text and leading bits; only if two hashes of a text share these is the order wrong, and a full sort follows.
    room = np.uint64(max(len(column), 1).bit_length())
    order = np.argsort(owner.astype(np.uint64) << (np.uint64(64) - room) | hashes >> room)
    if ((hashes[order[1:]] < hashes[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])).any():
        order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(column) + 1))


def _sum_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def fingerprints(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, which do not depend on order."""
    a = T.mix(_sum_by(T.mix(hashes ^ np.uint64(T.SEQ1)), first))
    b = T.mix(_sum_by(T.mix(hashes ^ np.uint64(T.SEQ2)), first))
    return a.view(np.int64), b.view(np.int64)


def parities(hashes: np.ndarray, first: np.ndarray) -> pa.Array:
    """``PARITY_BITS`` bits of each set: how often its shingles hit each, modulo two.

    Bits that differ between two sets are no more than the shingles in which they differ.
    """
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    hit = owner * PARITY_BITS + (T.mix(hashes) >> np.uint64(54)).astype(np.int64)
    bits = np.bincount(hit, minlength=n * PARITY_BITS).astype(np.uint8) & 1
    longs = np.packbits(bits).view(np.int64)
    width = PARITY_BITS // 64
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(longs))


def signatures(hashes: np.ndarray, first: np.ndarray) -> pa.Array:
    """Parities as in ``parities``, of as many bits as the set's size asks for: a power of two.

    A set of many more shingles than bits sets half of them, whatever it holds, so that a fixed number of bits tells large sets not apart.
    """
    n = np.diff(first)
    low, high = SIGNATURE_BITS
    width = np.clip(1 << np.ceil(np.log2(np.maximum(2 * n, 2))).astype(np.int64), low, high)
    at = np.concatenate([[0], np.cumsum(width)])
    hit = np.repeat(at[:-1], n) + ((T.mix(hashes) >> np.uint64(48)).astype(np.int64) & np.repeat(width - 1, n))
    bits = np.bincount(hit, minlength=at[-1]).astype(np.uint8) & 1
    data = np.packbits(bits, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((at // 8).astype(np.int32)), pa.py_buffer(data)])


def differing(p: pa.Array, q: pa.Array) -> np.ndarray:
    """In how many bits each two signatures differ, the longer one folded to the shorter: no more than the shingles in which the sets differ."""
    sides = [T.buffers(x) for x in (p, q)]
    lengths = [np.diff(offsets) for _, offsets in sides]
    out = np.zeros(len(p), np.int64)
    kinds = lengths[0] << 32 | lengths[1]
    for kind in np.unique(kinds):
        both = int(kind) >> 32, int(kind) & 0xFFFFFFFF
        least = min(both)
        rows = np.flatnonzero(kinds == kind)
        for part in np.array_split(rows, len(rows) * max(both) // (1 << 22) + 1):
            folded = [
                np.bitwise_xor.reduce(data[offsets[part][:, None] + np.arange(size)].reshape(len(part), -1, least), axis=1)
                for (data, offsets), size in zip(sides, both, strict=True)
            ]
            out[part] = np.bitwise_count(folded[0] ^ folded[1]).sum(axis=1, dtype=np.int64)
    return out


def frequency_bits(total: int) -> int:
    """Bits of a shingle's cell when there are so many shingles."""
    low, high = FREQUENCY_BITS
    return min(high, max(low, (total // CELL_LOAD).bit_length()))


def least_overlap(sizes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Shingles that a set of this size shares at least with any set it links with."""
    return -(-percent * sizes // 100)


def linked(shared, a, b, percent: int = PERCENT):
    """100 * intersection >= percent * union."""
    return (100 + percent) * shared >= percent * (a + b)


def band(sizes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Size classes such that sets that link are in the same class or in neighbouring ones, and each class's smallest size."""
    edges = [1]
    while edges[-1] <= (sizes.max() if len(sizes) else 0):
        edges.append(max(edges[-1] + 1, -(-edges[-1] * 100 // percent)))
    number = np.searchsorted(np.array(edges), sizes, side="right")
    return number, np.array(edges)[np.maximum(number - 1, 0)]


def postings(hashes: np.ndarray, first: np.ndarray, level: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks, texts and roles of the posted shingles, by order of (cell frequency, hash).

    Of a linked pair, the first common shingle is among the first n - ceil(t n) + 1 of either set, and in the set that is not larger
    among the first m - ceil(2 t / (1 + t) m) + 1. So every set is *indexed* under the latter in its own size class, and *probes* under the
    former in its own class (where the bound uses the class's smallest size) and the one below. A block is a hash of shingle
    and class; role 1 is indexed.
    """
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    # Sets come sorted by hash, so a stable sort by text, level and leading bits orders ties by the whole hash.
    room = np.uint64(max(len(n), 1).bit_length())
    rank = (owner.astype(np.uint64) << (np.uint64(64) - room)) | (level[cell(hashes, 0, len(level).bit_length() - 1)].astype(np.uint64) << (np.uint64(56) - room))
    order = np.argsort(rank | (hashes >> (np.uint64(8) + room)), kind="stable")
    place = np.arange(len(hashes)) - np.repeat(first[:-1], n)
    indexed = place < np.repeat(n + (2 * percent * n // -(100 + percent)) + 1, n)
    probing = place < np.repeat(n - least_overlap(n, percent) + 1, n)
    classes, smallest = band(n, percent)
    beside = place < np.repeat(n + (percent * (n + smallest) // -(100 + percent)) + 1, n)
    size_class = np.repeat(classes, n)
    blocks, owners, roles = [], [], []
    for down, role, within in ((0, indexed, (beside & probing) | indexed), (1, np.zeros(len(hashes), bool), probing)):
        at = np.flatnonzero(within)
        blocks.append(T.mix(hashes[order[at]] + (size_class[at] - down).astype(np.uint64) * T.M3))
        owners.append(owner[at])
        roles.append(role[at])
    return np.concatenate(blocks), np.concatenate(owners), np.concatenate(roles)


def search(sizes: np.ndarray, first: np.ndarray, members: np.ndarray, label: np.ndarray, queries: np.ndarray, indexed: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect different components: DivideSkip search of ``queries`` in the index of ``indexed`` sets.

    ``members[first[i]:first[i + 1]]`` are the shingles of set i; ``label`` is the component of each set and is
    updated. ``queries`` and ``indexed`` number sets; a set is not compared with itself.
    """
    rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in indexed]) if len(indexed) else np.zeros(0, np.int64)
    owner = np.repeat(indexed, sizes[indexed])
    order = np.lexsort((owner, members[rows]))
    tokens, postings = members[rows][order], owner[order]
    heads = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    vocabulary, heads = tokens[heads], np.append(heads, len(tokens))
    links: list[tuple[int, int]] = []
    for q in queries:
        if (label[indexed] == label[q]).all():
            continue
        mine = members[first[q] : first[q + 1]]
        at = np.searchsorted(vocabulary, mine)
        at = at[(at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] == mine)]
        need = int(least_overlap(sizes[q], percent))
        if len(at) < need:
            continue
        lengths = heads[at + 1] - heads[at]
        at = at[np.argsort(lengths, kind="stable")]
        # The longest lists are probed; the rest are merged and must yield need - probes occurrences.
        probes = min(need - 1, int(need / (1 + 0.1 * np.log2(max(lengths.max(), 2)))))
        short, long = at[: len(at) - probes], at[len(at) - probes :]
        merged = np.sort(np.concatenate([postings[heads[t] : heads[t + 1]] for t in short]), kind="stable")
        merged = merged[label[merged] != label[q]]
        if not len(merged):
            continue
        edge = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1], [True]]))
        candidate, count = merged[edge[:-1]], np.diff(edge)
        near = (count >= need - probes) & (100 * np.minimum(sizes[candidate], sizes[q]) >= percent * np.maximum(sizes[candidate], sizes[q]))
        candidate, count = candidate[near], count[near]
        for left, t in zip(range(len(long) - 1, -1, -1), long, strict=True):
            if not len(candidate):
                break
            inverted = postings[heads[t] : heads[t + 1]]
            spot = np.minimum(np.searchsorted(inverted, candidate), len(inverted) - 1)
            count = count + (inverted[spot] == candidate)
            alive = count + left >= need
            candidate, count = candidate[alive], count[alive]
        for c in candidate[linked(count, sizes[candidate], sizes[q], percent)]:
            if label[c] != label[q]:
                links.append((int(q), int(c)))
                label[label == label[c]] = label[q]
    return links


def _profile(docs: DataFrame, size: int) -> DataFrame:
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in T.pieces(batches):
            hashes, first = shingle_sets(piece.column("text"), size)
            a, b = fingerprints(hashes, first)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("text_hash"), pa.array(np.diff(first)), pa.array(a), pa.array(b), signatures(hashes, first)],
                names=["doc_id", "text_hash", "n_shingles", "a", "b", "signature"],
            )

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return hashed.mapInArrow(profile, "doc_id long, text_hash long, n_shingles long, a long, b long, signature binary")


def pack(parts: list[tuple[np.ndarray, ...]], bits: int) -> dict[str, list]:
    """Rows (bucket, kind, key, owner, flag, a, n) for the postings of a few pieces, one a bucket: keys as sorted steps, owners as
    numbers in a table of the row's own sets.

    Sets that are equal count once. A block with more than ``FEW`` sets is reduced here: its members are connected to one that is
    indexed (kind ``EDGE``) and only that one is posted; if none is, one is posted and the members wait (kind ``WAIT``) for an indexed
    one elsewhere. So a block that very many sets share sends a few postings from each call, whatever its size.
    """
    shift = np.cumsum([0, *(len(a) for _, a, _, _, _ in parts)])
    a, first, number = np.unique(np.concatenate([p[1] for p in parts]), return_index=True, return_inverse=True)
    sizes = np.concatenate([p[2] for p in parts])[first].astype(np.uint32)
    key = np.concatenate([p[0] for p in parts]) >> np.uint64(64 - KEY_BITS)
    owner = number[np.concatenate([p[3] + at for p, at in zip(parts, shift, strict=False)])]
    flag = np.concatenate([p[4] for p in parts]).astype(np.uint8)
    key, owner, flag = _grouped(key, owner, flag)
    starts, counts, leader = _leaders(key, owner, flag)
    hot = np.repeat(counts > FEW, counts)
    led = np.repeat(leader, counts)
    x, y = _distinct(owner, led, hot & (led >= 0) & (owner != led))
    waits = hot & (led < 0)
    flag = flag | (hot * HOT).astype(np.uint8)
    opening = np.zeros(len(key), bool)
    opening[starts] = True
    stays = ~hot | np.where(led >= 0, owner == led, opening)
    rows: dict[str, list] = {name: [] for name in _DEALT.names}

    def add(bucket: int, kind: int, *columns: bytes) -> None:
        for name, value in zip(_DEALT.names, (bucket, kind, *columns), strict=True):
            rows[name].append(value)

    none = framed(np.zeros(0, np.uint64))
    if len(x):
        add(int(a[x[0]]) & ((1 << bits) - 1), EDGE, framed(a[x]), none, none, framed(a[y]), none)
    if waits.any():
        add(int(key[waits][0]) >> (KEY_BITS - bits), WAIT, framed(key[waits]), none, none, framed(a[owner[waits]]), none)
    key, owner, flag = key[stays], owner[stays], flag[stays]
    bounds = np.searchsorted(key, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(KEY_BITS - bits))
    for bucket in np.flatnonzero(np.diff(bounds)):
        part = slice(bounds[bucket], bounds[bucket + 1])
        steps = np.diff(key[part], prepend=np.uint64(int(bucket) << (KEY_BITS - bits)))
        wide = steps.max() >= 1 << 32
        mine, at = np.unique(owner[part], return_inverse=True)
        at = at.astype(np.uint16 if len(mine) <= 1 << 16 else np.uint32)
        add(int(bucket), POST, framed(steps if wide else steps.astype(np.uint32)), framed(at), framed(flag[part]), framed(a[mine]), framed(sizes[mine]))
    return rows


def _grouped(key: np.ndarray, owner: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings by (key, owner); of equal ones the flags are joined."""
    order = np.lexsort((owner, key))
    key, owner, flag = key[order], owner[order], flag[order]
    if not len(key):
        return key, owner, flag
    heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]))
    return key[heads], owner[heads], np.bitwise_or.reduceat(flag, heads)


def _distinct(x: np.ndarray, y: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs of numbers below 2 ** 32 among those marked."""
    pairs = np.unique(x[where].astype(np.int64) << 32 | y[where].astype(np.int64))
    return pairs >> 32, pairs & 0xFFFFFFFF


def _leaders(key: np.ndarray, owner: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each block, and its first indexed owner or -1."""
    if not len(key):
        return (np.zeros(0, np.int64),) * 3
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    none = np.iinfo(np.int64).max
    leader = np.minimum.reduceat(np.where(flag & INDEXED, owner, none), starts)
    return starts, np.diff(np.append(starts, len(key))), np.where(leader == none, -1, leader)


def match(table: pa.Table, bits: int, percent: int) -> pa.Table:
    """(kind, x, y): the sets to be connected that share a block of this bucket.

    In blocks of at most ``FEW`` sets these are the pairs of which the smaller set is indexed and whose sizes may link (kind ``PAIR``);
    in others each set and a leader (``EDGE``). For blocks with sets that wait, the block and its leader (``LEAD``); what waits passes (``WAIT``).
    """
    keys, owners, flags, names, sizes, out, n = [], [], [], [], [], [], 0
    for bucket, kind, key, owner, flag, a, size in zip(*(c.to_pylist() for c in table.select(_DEALT.names).columns), strict=True):
        a = unframed(a, np.int64)
        if kind != POST:
            out.append((kind, unframed(key, np.int64), a))
            continue
        posted = int.from_bytes(flag[:8], "little")
        steps = unframed(key, np.uint64 if int.from_bytes(key[:8], "little") == 8 * posted else np.uint32)
        keys.append(np.cumsum(steps, dtype=np.uint64) + np.uint64(bucket << (KEY_BITS - bits)))
        at = unframed(owner, np.uint32 if int.from_bytes(owner[:8], "little") == 4 * posted else np.uint16)
        owners.append(at.astype(np.int64) + n)
        flags.append(unframed(flag, np.uint8))
        names.append(a)
        sizes.append(unframed(size, np.uint32))
        n += len(a)
    if keys:
        name, first, number = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
        size = np.concatenate(sizes)[first].astype(np.int64)
        key, owner, flag = _grouped(np.concatenate(keys), number[np.concatenate(owners)], np.concatenate(flags))
        starts, counts, leader = _leaders(key, owner, flag)
        hot = np.bitwise_or.reduceat(flag, starts) & HOT > 0
        starred = hot | (counts > FEW)
        leads = hot & (leader >= 0)
        out.append((LEAD, key[starts[leads]].view(np.int64), name[leader[leads]]))
        led, star = np.repeat(leader, counts), np.repeat(starred, counts)
        x, y = _distinct(owner, led, star & (led >= 0) & (owner != led))
        out.append((EDGE, name[x], name[y]))
        few = np.repeat(~starred & (leader >= 0) & (counts > 1), counts)
        key, owner, flag = key[few], owner[few], flag[few] & INDEXED
        pairs = []
        for step in range(1, FEW):
            x, y = owner[:-step], owner[step:]
            m, k = size[x], size[y]
            fit = (key[:-step] == key[step:]) & ((flag[:-step] > 0) & (m <= k) | (flag[step:] > 0) & (k <= m))
            fit &= 100 * np.minimum(m, k) >= percent * np.maximum(m, k)
            pairs.append(_distinct(x, y, fit))
        x, y = (np.concatenate(ends) for ends in zip(*pairs, strict=True))
        x, y = _distinct(x, y, np.ones(len(x), bool))
        out.append((PAIR, name[x], name[y]))
    kinds = np.concatenate([np.full(len(x), kind, np.int32) for kind, x, _ in out])
    return pa.table({"kind": kinds, "x": np.concatenate([x for _, x, _ in out]), "y": np.concatenate([y for _, _, y in out])})


def _regions(docs: DataFrame, profile: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, root): sets that share a posted shingle with a different set, by fingerprint a, and their region."""
    context = docs.sparkSession.sparkContext

    def all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for piece in T.pieces(batches):
            yield shingle_sets(piece.column("text"), size)[0]

    total = profile.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    level = context.broadcast(frequency_levels(docs, all_shingles, frequency_bits(total)))
    bits = max(6, (total // BUCKET).bit_length())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for piece in T.pieces(batches):
            hashes, first = shingle_sets(piece.column("text"), size)
            a, _ = fingerprints(hashes, first)
            block, owner, role = postings(hashes, first, level.value, percent)
            held.append((block, a, np.diff(first), owner, role))
            waiting += len(block)
            if waiting > FLUSH:
                yield pa.RecordBatch.from_pydict(pack(held, bits), schema=_DEALT)
                held, waiting = [], 0
        if waiting:
            yield pa.RecordBatch.from_pydict(pack(held, bits), schema=_DEALT)

    dealt = docs.mapInArrow(deal, "bucket int, kind int, key binary, owner binary, flag binary, a binary, n binary")
    found = dealt.groupBy("bucket").applyInArrow(lambda table: match(table, bits, percent), "kind int, x long, y long")
    found = staged(found.distinct())
    level.destroy()
    edges = found.where(F.col("kind") == EDGE).select(F.col("x").alias("a"), F.col("y").alias("b"))
    waits = found.where(F.col("kind") == WAIT).select(F.col("x").alias("block"), F.col("y").alias("a"))
    leads = found.where(F.col("kind") == LEAD).select(F.col("x").alias("block"), F.col("y").alias("b"))
    waited = waits.join(leads, "block").select("a", "b").where("a <> b").distinct()
    # Pairs whose signatures rule a link out are dropped.
    pairs = found.where(F.col("kind") == PAIR).select(F.col("x").alias("a"), F.col("y").alias("b"))
    sets = profile.dropDuplicates(["a"]).select("a", "n_shingles", "signature")
    pairs = pairs.join(sets.toDF("a", "n", "p"), "a").join(sets.toDF("b", "m", "q"), "b")

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differ = differing(batch.column("p"), batch.column("q"))
            n, m = (batch.column(name).to_numpy() for name in ("n", "m"))
            yield batch.select(["a", "b"]).filter(pa.array(differ * (100 + percent) <= (100 - percent) * (n + m)))

    pairs = pairs.select("a", "b", "n", "m", "p", "q").mapInArrow(fits, "a long, b long")
    return components(edges.unionByName(waited).unionByName(pairs))


def _tiles(sets: DataFrame, size: int, percent: int) -> DataFrame:
    """Links found in each group of (tile); ``side`` 0 is searched in the index of side 1, or both in one."""

    def solve(table: pa.Table) -> pa.Table:
        rows = pa.table([table.column("rep"), table.column("side"), pa.array(np.arange(table.num_rows))], names=["rep", "side", "i"])
        table = table.take(rows.group_by(["rep", "side"]).aggregate([("i", "min")]).column("i_min"))  # equal rows of other pieces
        sizes = table.column("n").to_numpy().astype(np.int64)
        names = table.column("rep").to_numpy()
        side = table.column("side").to_numpy()
        known = table.column("label").to_numpy()
        _, label = np.unique(known, return_inverse=True)
        label = label.astype(np.int64)
        texts = table.column("text").cast(pa.large_string()).combine_chunks()
        members, first = shingle_sets(texts, size)
        order = np.argsort(sizes, kind="stable")
        if (side == 0).all():
            links = search(sizes, first, members, label, order, order, percent)
        else:
            links = search(sizes, first, members, label, order[side[order] == 0], order[side[order] == 1], percent)
        return pa.table({"x": names[[q for q, _ in links]] if links else pa.array([], pa.int64()), "y": names[[c for _, c in links]] if links else pa.array([], pa.int64())})

    return sets.groupBy("tile").applyInArrow(solve, "x long, y long")


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text_hash, n_shingles and component_id of every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    profile = staged(_profile(docs, size))
    regions = staged(_regions(docs.where("doc_id IS NOT NULL"), profile, size, percent))
    classes = profile.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("a", "b", "n_shingles").agg(F.min("doc_id").alias("rep"))
    # Sets that may link, each under the smallest id that has it.
    chosen = staged(classes.join(regions, F.col("a") == F.col("node")).select("rep", "a", "b", F.col("root").alias("region")))
    chosen = chosen.join(chosen.groupBy("region").agg(F.count("*").alias("members")), "region")

    def chosen_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield T.mix(batch.column("rep").to_numpy().view(np.uint64))

    picked = spark.sparkContext.broadcast(repeat_sketch(chosen.select("rep"), chosen_ids, CHOSEN_BITS, least=1))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in T.pieces(batches):
            keep = picked.value.repeated(T.mix(piece.column("doc_id").to_numpy().view(np.uint64)))
            piece = piece.filter(pa.array(keep))
            if piece.num_rows:  # equal rows of a piece count once
                rows = pa.table([piece.column("doc_id"), piece.column("text_hash"), pa.array(np.arange(piece.num_rows))], names=["d", "t", "i"])
                piece = piece.take(rows.group_by(["d", "t"]).aggregate([("i", "min")]).column("i_min").combine_chunks())
            if piece.num_rows == 0:
                continue
            hashes, first = shingle_sets(piece.column("text"), size)
            a, b = fingerprints(hashes, first)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(np.diff(first)), pa.array(a), pa.array(b), piece.column("text")], names=["id", "n", "sa", "sb", "text"]
            )

    named = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    found = named.mapInArrow(sets, "id long, n long, sa long, sb long, text string")
    same = (F.col("id") == F.col("rep")) & (F.col("sa") == F.col("a")) & (F.col("sb") == F.col("b"))
    gathered = staged(found.join(chosen, same).select(F.col("a").alias("rep"), "n", "text", "region", "members"))
    picked.destroy()
    return _label(profile, classes, _link(gathered, size, percent, chunk))


def _link(gathered: DataFrame, size: int, percent: int, chunk: int) -> DataFrame:
    """(node, root) over the sets of ``gathered`` that are linked with another set, by fingerprint a (``rep``)."""
    placed = gathered
    # Small regions share groups of about ``chunk`` sets; a large one is cut at random into chunks of about that size.
    pool = F.lit(1) + F.floor(F.lit(placed.select("rep").count()) / F.lit(chunk))
    chunks = F.when(F.col("members") > chunk, F.ceil(F.col("members") / F.lit(chunk))).otherwise(1)
    placed = placed.withColumn("chunks", chunks.cast("long")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")))
    placed = placed.withColumn(
        "home", F.when(F.col("chunks") == 1, F.concat(F.lit("pool-"), F.pmod(F.xxhash64("region"), pool))).otherwise(F.concat_ws("-", "region", "own"))
    )
    placed = placed.withColumn("label", F.col("rep"))
    inner = placed.select(F.col("home").alias("tile"), F.lit(0).alias("side"), "rep", "n", "label", "text")
    big = placed.where("chunks > 1")
    to_first = big.where("own > 0").select(F.concat_ws("-", "region", F.lit("first"), "own").alias("tile"), F.lit(0).alias("side"), "rep", "n", "label", "text")
    firsts = big.where("own = 0").select("region", F.explode(F.sequence(F.lit(1), F.col("chunks") - 1)).alias("other"), "rep", "n", "label", "text")
    firsts = firsts.select(F.concat_ws("-", "region", F.lit("first"), "other").alias("tile"), F.lit(1).alias("side"), "rep", "n", "label", "text")
    links = staged(_tiles(inner.unionByName(to_first).unionByName(firsts), size, percent))
    known = components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    # What large regions have left: chunks by component and size, paired unless one component or too far apart in size.
    rest = big.drop("label", "home", "own").join(known, F.col("rep") == F.col("node"), "left")
    rest = rest.withColumn("label", F.coalesce("root", "rep"))
    several = rest.groupBy("region").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("region")
    rest = rest.join(several, "region", "left_semi")
    # Members of one component stay together, smaller sizes first; chunk numbers come from running counts over (label, size).
    steps = rest.groupBy("region", "label", "n").agg(F.count("*").alias("here"))
    before = F.sum("here").over(Window.partitionBy("region").orderBy("label", "n")) - F.col("here")
    steps = steps.withColumn("before", before)
    rest = rest.join(steps.select("region", "label", "n", "before", "here"), ["region", "label", "n"])
    spread = F.col("before") + F.pmod(F.xxhash64("rep"), F.col("here"))
    rest = staged(rest.select("region", "rep", "n", "label", "text", F.floor(spread / F.lit(chunk)).alias("at")))
    blocks = rest.groupBy("region", "at").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
    left, right = blocks.alias("l"), blocks.alias("r")
    pairs = left.join(right, (F.col("l.region") == F.col("r.region")) & (F.col("l.at") <= F.col("r.at")))
    pairs = pairs.where("least(l.low, r.low) <> greatest(l.high, r.high) AND NOT (l.at = r.at AND l.low = l.high)")
    pairs = pairs.where(f"100 * l.most >= {percent} * r.least AND 100 * r.most >= {percent} * l.least")
    pairs = pairs.select(F.col("l.region").alias("region"), F.col("l.at").alias("i"), F.col("r.at").alias("j"))
    ends = pairs.select("region", F.col("i").alias("at"), F.lit(0).alias("side"), "i", "j").unionByName(
        pairs.where("i <> j").select("region", F.col("j").alias("at"), F.lit(1).alias("side"), "i", "j")
    )
    second = rest.join(ends, ["region", "at"]).select(F.concat_ws("-", "region", "i", "j").alias("tile"), "side", "rep", "n", "label", "text")
    more = staged(_tiles(second, size, percent))
    return components(links.unionByName(more).select(F.col("x").alias("a"), F.col("y").alias("b")))


def _label(profile: DataFrame, classes: DataFrame, joined: DataFrame) -> DataFrame:
    # Components of fingerprints, each under the smallest id of its sets.
    least = joined.join(classes, F.col("a") == F.col("node")).groupBy("root").agg(F.min("rep").alias("least"))
    ids = joined.join(least, "root").select("node", "least")
    roots = classes.join(ids, F.col("a") == F.col("node"), "left").select("a", "b", "n_shingles", F.coalesce("least", "rep").alias("component_id"))
    out = profile.join(roots, ["a", "b", "n_shingles"], "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", "text_hash", "n_shingles", own.alias("component_id"))


def keep_one(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``docs`` without near duplicates: of each component the row with the smallest doc_id stays.

    Equal rows count once; rows without a doc_id stay; different texts under the smallest id stay side by side.
    """
    doc, text = T.spare(docs, "id", "hash")
    found = near_duplicates(docs, size, percent).where("component_id <> doc_id")
    found = found.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)).distinct()
    others = docs.join(found, (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(text)), "left_anti")
    return others.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).unionByName(others.where("doc_id IS NULL"))

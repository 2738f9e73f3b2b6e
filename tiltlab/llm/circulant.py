"""Exact near-duplicate classes behind circulant MinHash signatures.

Two documents link when their sets of distinct three-word shingles have a Jaccard similarity of at least ``PERCENT`` in a hundred (an
exact integer comparison on the full sets); a document's class is what links reach.

1. *Signatures.* The universe is the ``2 ** 32`` places of a ring. A first permutation places each shingle on it; a second one gives every
   place its rank. Coordinate k of a set is the least rank of its places, all of them shifted by k round the ring, so that two permutations
   serve for any number of coordinates. Sets agree in a coordinate with a probability of their similarity.
2. *Banding.* ``ROWS`` coordinates make a band, whose hash is a *bucket*; sets that share one of ``BANDS`` buckets are candidates. A
   linked pair shares none with a probability of at most (1 - 0.85 ** 5) ** 36, or 7 in 10 ** 10.
3. *Stars.* Each bucket ties its members to a leader: the least member within a batch, and the least of the batches' leaders. A bucket
   that very many sets share thus sends one row a batch. Each set is compared with the nearest of its leaders.
4. *Rest.* A bucket whose members are in several classes by then is read whole: pairs across classes that the bounds below leave open are
   compared as well. A bucket larger than ``CHUNK`` is dealt as pairs of chunks, those within one class left out. Each
   class brings its ``OPEN`` nearest pairs at first; if some were held back, the step is repeated with the classes as they are then and four
   times as many, until none is. So a group that hangs together in very many pairs costs few, and no link between classes is lost.
5. *Bounds.* Sizes, and parities: how often a set's shingles hit each of ``PARITY_BITS`` cells, modulo two. Two sets differ in at least as many
   shingles as their parities differ in cells; a pair whose least difference rules a link out is dropped, no other.
6. *Verification.* The texts of compared sets are gathered by leader, cut by their number of shingles, and their full sets intersected.

Defined results: a document without words has size 0, links with nothing and is its own class; one with fewer than three words has its
whole sequence as its single shingle; equal sets link (one row stands for them); a null doc_id gets a null component, links with nothing
and is kept; equal rows get equal results; different texts may share a doc_id; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltlab.llm import tokens as T
from tiltlab.llm.exchange import repeat_sketch
from tiltlab.llm.graph import components
from tiltlab.llm.jaccard import PARITY_BITS, fingerprints, parities, shingle_sets
from tiltlab.session import staged

SIZE = 3
PERCENT = 85
ROWS = 5
BANDS = 36
CHUNK = 2000
OPEN = 16
# Shingles of one tile, and of one step of the signatures (which stay in the processor's cache).
ROOM = 2_000_000
STEP = 1 << 16


def placed(hashes: np.ndarray) -> np.ndarray:
    """The first permutation: the place of each shingle on the ring."""
    return (T.mix(hashes * T.M3) >> np.uint64(32)).astype(np.uint32)


def ranked(places: np.ndarray) -> np.ndarray:
    """The second permutation: the rank of each place; a bijection of 32 bits."""
    rank = places ^ (places >> np.uint32(16))
    rank *= np.uint32(0x7FEB352D)
    rank ^= rank >> np.uint32(15)
    rank *= np.uint32(0x846CA68B)
    rank ^= rank >> np.uint32(16)
    return rank


def signatures(hashes: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """``count`` coordinates (rows) of each set (columns); an empty set has the greatest rank everywhere."""
    out = np.full((count, len(first) - 1), 0xFFFFFFFF, np.uint32)
    filled = np.flatnonzero(np.diff(first))
    heads = first[filled]
    at = 0
    while at < len(filled):  # whole sets of about STEP shingles at a time, longer ones by themselves
        to = max(at + 1, int(np.searchsorted(heads, heads[at] + STEP)))
        end = heads[to] if to < len(filled) else first[-1]
        ring, cuts = placed(hashes[heads[at] : end]), heads[at:to] - heads[at]
        for k in range(count):
            out[k, filled[at:to]] = np.minimum.reduceat(ranked(ring + np.uint32(k)), cuts)
        at = to
    return out


def buckets(coordinates: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each set (rows) and band (columns)."""
    bands = len(coordinates) // rows
    out = np.empty((coordinates.shape[1], bands), np.uint64)
    for band in range(bands):
        total = np.full(coordinates.shape[1], (band + 1) * T.SEQ1 % 2**64, np.uint64)
        for row in coordinates[band * rows : (band + 1) * rows]:
            total = T.mix(total * np.uint64(T.SEQ2) + row.astype(np.uint64))
        out[:, band] = total
    return out.view(np.int64)


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1)))


def _profile(docs: DataFrame, size: int, rows: int, bands: int) -> DataFrame:
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in T.pieces(batches):
            hashes, first = shingle_sets(piece.column("text"), size)
            a, b = fingerprints(hashes, first)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    piece.column("text_hash"),
                    pa.array(np.diff(first)),
                    pa.array(a),
                    pa.array(b),
                    parities(hashes, first),
                    _lists(buckets(signatures(hashes, first, rows * bands), rows)),
                ],
                names=["doc_id", "text_hash", "n", "a", "b", "parity", "buckets"],
            )

    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return hashed.mapInArrow(profile, "doc_id long, text_hash long, n long, a long, b long, parity array<long>, buckets array<long>")


def _stars(classes: DataFrame) -> DataFrame:
    """(bucket, s, lead): every member of a bucket with more than one, but its leader, beside a leader."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("buckets")
            bucket = lists.flatten().to_numpy(zero_copy_only=False)
            s = np.repeat(batch.column("s").to_numpy(), len(bucket) // batch.num_rows)
            order = np.lexsort((s, bucket))
            bucket, s = bucket[order], s[order]
            head = np.concatenate([[True], bucket[1:] != bucket[:-1]])
            lead = s[head][np.cumsum(head) - 1]
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(s), pa.array(lead), pa.array(head)], names=["bucket", "s", "lead", "leads"])

    found = classes.select("s", "buckets").mapInArrow(post, "bucket long, s long, lead long, leads boolean")
    # Of each batch only the leader meets the others: a bucket has at most one row a batch here.
    least = F.min("s").over(Window.partitionBy("bucket"))
    across = found.where("leads").select("bucket", "s", least.alias("lead")).where("s <> lead")
    return across.unionByName(found.where("NOT leads").select("bucket", "s", "lead"))


def _differ(p: str, q: str) -> Column:
    """Cells in which two parities differ."""
    return F.aggregate(F.zip_with(p, q, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)


def _nearest(stars: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(x, y): each set with that of its leaders whose parity is nearest, unless the bounds rule a link out."""
    sets = classes.select("s", "n", "parity")
    pairs = stars.select("s", "lead").distinct().join(sets, "s").join(sets.toDF("lead", "m", "other"), "lead")
    differ = _differ("parity", "other")
    fits = (differ * (100 + percent) <= (100 - percent) * (F.col("n") + F.col("m"))) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    pairs = pairs.where(fits).select(F.col("s").alias("x"), F.struct((differ / (F.col("n") + F.col("m"))).alias("far"), F.col("lead").alias("y")).alias("to"))
    return pairs.groupBy("x").agg(F.min("to").alias("to")).select("x", F.col("to.y").alias("y"))


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(x, y) of ``pairs`` that link, by their full sets."""
    spark = pairs.sparkSession
    sets = classes.select("s", "n")
    pairs = pairs.join(sets.toDF("x", "n"), "x")
    load = pairs.groupBy("y").agg(F.sum("n").alias("load"))
    total = load.agg(F.sum("load")).first()[0] or 0
    # Leaders of few shingles share a tile, one of many is cut by its members.
    pool = 1 + total // ROOM
    cuts = F.ceil(F.col("load") / F.lit(ROOM))
    tile = F.when(cuts > 1, F.concat_ws("-", "y", F.pmod(F.xxhash64("x"), cuts))).otherwise(F.concat(F.lit("pool-"), F.pmod(F.xxhash64("y"), F.lit(pool))))
    pairs = staged(pairs.join(load, "y").select(tile.alias("tile"), "x", "y"))
    needs = pairs.select(F.col("tile").alias("home"), F.explode(F.array("x", "y")).alias("s")).distinct()
    chosen = staged(needs.select("s").distinct().join(classes.select("s", "rep", "rep_hash"), "s"))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield T.mix(batch.column("rep").to_numpy().view(np.uint64))

    # Sized by the sets chosen; past 2 ** 28 cells (64 MB) it fills up, and then more texts travel to the join, which decides.
    bits = min(max(16, int(chosen.count() * 8).bit_length()), 28)
    picked = spark.sparkContext.broadcast(repeat_sketch(chosen.select("rep"), ids, bits, least=1))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in T.pieces(batches):
            piece = piece.filter(pa.array(picked.value.repeated(T.mix(piece.column("doc_id").to_numpy().view(np.uint64)))))
            if piece.num_rows:  # equal rows of a piece count once
                rows = pa.table([piece.column("doc_id"), piece.column("text_hash"), pa.array(np.arange(piece.num_rows))], names=["d", "t", "i"])
                yield piece.take(rows.group_by(["d", "t"]).aggregate([("i", "min")]).column("i_min").combine_chunks())

    named = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    texts = named.mapInArrow(keep, "doc_id long, text_hash long, text string")
    texts = texts.join(chosen, (F.col("doc_id") == F.col("rep")) & (F.col("text_hash") == F.col("rep_hash"))).select("s", "text")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        names, rows = np.unique(left.column("s").to_numpy(), return_index=True)
        members, first = shingle_sets(left.column("text").take(pa.array(rows)).cast(pa.large_string()).combine_chunks(), size)
        x, y = right.column("x").to_numpy(), right.column("y").to_numpy()
        good = np.zeros(len(x), bool)
        for k, (i, j) in enumerate(zip(np.searchsorted(names, x).tolist(), np.searchsorted(names, y).tolist(), strict=True)):
            p, q = members[first[i] : first[i + 1]], members[first[j] : first[j + 1]]
            if len(p) > len(q):
                p, q = q, p
            at = np.searchsorted(q, p)
            both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
            good[k] = 100 * both >= percent * (len(p) + len(q) - both)
        return pa.table({"x": x[good], "y": y[good]})

    gathered = needs.join(texts, "s").select("home", "s", "text")
    links = staged(gathered.groupBy("home").cogroup(pairs.groupBy("tile")).applyInArrow(solve, "x long, y long"))
    picked.destroy()
    return links


def open_pairs(table: pa.Table, percent: int, limit: int) -> pa.Table:
    """Pairs of a tile's rows (bucket, side, s, label, n, parity) that share a bucket but no label and that the bounds leave open.

    Rows of side 2 pair with all others of their bucket, sides 0 and 1 with each other. Given are the ``limit`` nearest pairs of
    each label; ``held`` says that there were more.
    """
    rows = table.select(["bucket", "side", "s"]).append_column("i", pa.array(np.arange(table.num_rows)))
    table = table.take(rows.group_by(["bucket", "side", "s"]).aggregate([("i", "min")]).column("i_min"))
    order = np.argsort(table.column("bucket").to_numpy(), kind="stable")
    bucket, side, s, label, n = (table.column(c).to_numpy()[order] for c in ("bucket", "side", "s", "label", "n"))
    width = PARITY_BITS // 64
    parity = table.column("parity").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)[order].view(np.uint64)
    found = []
    for step in range(1, len(s)):
        same = np.flatnonzero(bucket[step:] == bucket[:-step])
        if not len(same):
            break
        i, j = same, same + step
        near = (label[i] != label[j]) & ((side[i] != side[j]) | (side[i] == 2))
        near &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
        i, j = i[near], j[near]
        differ = np.bitwise_count(parity[i] ^ parity[j]).sum(axis=1, dtype=np.int64)
        near = differ * (100 + percent) <= (100 - percent) * (n[i] + n[j])
        found.append((i[near], j[near], differ[near] / (n[i] + n[j])[near]))
    i, j, far = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
    i, j = i.astype(np.int64), j.astype(np.int64)
    x, y = np.maximum(s[i], s[j]), np.minimum(s[i], s[j])
    order = np.lexsort((y, x))  # a pair may share several buckets
    once = order[np.concatenate([[True], (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])])[: len(x)]]
    i, j, x, y, far = i[once], j[once], x[once], y[once], far[once]
    ends = np.concatenate([label[i], label[j]])
    order = np.lexsort((np.tile(y, 2), np.tile(x, 2), np.tile(far, 2), ends))
    head = np.concatenate([[True], ends[order][1:] != ends[order][:-1]])[: len(ends)]
    place = np.arange(len(ends)) - np.flatnonzero(head)[np.cumsum(head) - 1] if len(ends) else ends
    taken = np.zeros(len(x), bool)
    taken[order[place < limit] % max(len(x), 1)] = True
    return pa.table({"x": x[taken], "y": y[taken], "held": np.full(int(taken.sum()), not taken.all())})


def _across(stars: DataFrame, classes: DataFrame, labels: DataFrame, percent: int, chunk: int, limit: int) -> DataFrame:
    """(x, y, held): open pairs across classes that share a bucket."""
    named = stars.join(labels.toDF("s", "l"), "s", "left").join(labels.toDF("lead", "m"), "lead", "left")
    torn = named.where("coalesce(l, s) <> coalesce(m, lead)").select("bucket").distinct()
    members = stars.join(torn, "bucket", "left_semi")
    members = members.select("bucket", F.explode(F.array("s", "lead")).alias("s")).distinct()
    sets = classes.select("s", "n", "parity").join(labels.toDF("s", "l"), "s", "left").select("s", "n", "parity", F.coalesce("l", "s").alias("label"))
    members = staged(members.join(sets, "s"))
    # A label with more than ``chunk`` members of a bucket is a group by itself; the bucket's other members are its rest.
    counts = members.groupBy("bucket", "label").agg(F.count("*").alias("here"))
    grouped = counts.withColumn("own", F.col("here") > chunk)
    groups = grouped.groupBy("bucket", F.when(F.col("own"), F.col("label")).alias("group")).agg(F.sum("here").alias("here"))
    groups = groups.withColumn("chunks", F.ceil(F.col("here") / F.lit(chunk)))
    large = staged(groups.join(groups.groupBy("bucket").agg(F.sum("here").alias("all")).where(F.col("all") > chunk).drop("all"), "bucket"))
    small = members.join(large.select("bucket").distinct(), "bucket", "left_anti")
    pool = 1 + members.count() // chunk
    tiles = small.select(F.concat(F.lit("pool-"), F.pmod(F.xxhash64("bucket"), F.lit(pool))).alias("tile"), F.lit(2).alias("side"), "bucket", "s", "label", "n", "parity")
    if not large.isEmpty():
        left, right = large.select("bucket", "group", "chunks"), large.select("bucket", F.col("group").alias("other"), F.col("chunks").alias("others"))
        # The rest (null) meets itself and all, a label's group the greater ones.
        both = left.join(right, "bucket").where(F.col("group").isNull() | (F.col("group") < F.col("other")))
        both = both.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        named = [F.coalesce(F.col(c).cast("string"), F.lit("rest")) for c in ("group", "other")]
        both = both.where("other IS NOT NULL OR i <= j").withColumn("tile", F.concat_ws("-", "bucket", *named, "i", "j"))
        alone = F.col("other").isNull() & (F.col("i") == F.col("j"))
        ends = both.select("bucket", "group", F.col("i").alias("at"), "tile", F.when(alone, 2).otherwise(0).alias("side")).unionByName(
            both.where(~alone).select("bucket", F.col("other").alias("group"), F.col("j").alias("at"), "tile", F.lit(1).alias("side"))
        )
        groups = large.select("bucket", "group", "chunks")
        at = members.join(grouped.drop("here"), ["bucket", "label"]).withColumn("group", F.when(F.col("own"), F.col("label")))
        at = at.alias("m").join(groups.alias("g"), (F.col("m.bucket") == F.col("g.bucket")) & F.col("m.group").eqNullSafe(F.col("g.group")))
        at = at.select("m.bucket", "m.group", "s", "label", "n", "parity", F.pmod(F.xxhash64("s"), F.col("chunks")).alias("at"))
        dealt = at.alias("m").join(ends.alias("e"), (F.col("m.bucket") == F.col("e.bucket")) & F.col("m.group").eqNullSafe(F.col("e.group")) & (F.col("m.at") == F.col("e.at")))
        tiles = tiles.unionByName(dealt.select("tile", "side", "m.bucket", "s", "label", "n", "parity"))
    solve = lambda table: open_pairs(table, percent, limit)
    return staged(tiles.groupBy("tile").applyInArrow(solve, "x long, y long, held boolean"))


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS, chunk: int = CHUNK, open_limit: int = OPEN) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    profile = staged(_profile(docs, size, rows, bands))
    classes = profile.where("n > 0 AND doc_id IS NOT NULL").groupBy("a", "b").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("one"), F.first("n").alias("n"), F.first("parity").alias("parity"), F.first("buckets").alias("buckets")
    )
    classes = classes.select("a", "b", F.col("one.doc_id").alias("rep"), F.col("one.text_hash").alias("rep_hash"), "n", "parity", "buckets")
    classes = staged(classes.withColumn("s", F.monotonically_increasing_id()))
    stars = staged(_stars(classes))
    tried = staged(_nearest(stars, classes, percent))
    links = _verified(tried, classes, docs, size, percent)
    limit, held = open_limit, True
    while True:
        labels = staged(components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))))
        if not held:
            break
        found = _across(stars, classes, labels, percent, chunk, limit)
        pairs = staged(found.select("x", "y").distinct().join(tried, ["x", "y"], "left_anti"))
        held = not found.where("held").isEmpty()
        limit *= 4
        if not pairs.isEmpty():
            links = links.unionByName(_verified(pairs, classes, docs, size, percent))
            tried = tried.unionByName(pairs)
        elif not held:
            break
    named = classes.select("s", "a", "b", "rep").join(labels.toDF("s", "root"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    named = named.join(named.groupBy("root").agg(F.min("rep").alias("least")), "root").select("a", "b", "least")
    out = profile.select("doc_id", "n", "a", "b").join(named, ["a", "b"], "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("least"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

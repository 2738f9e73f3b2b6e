"""Merkle manifest of a table: a hash tree over the rows of each source, and one over the sources.

A leaf is the SHA-256 of a row's columns, each written as byte count, colon and value, or ``-`` for null. The leaves of a source ascend
by doc_id; every ``FANOUT`` consecutive nodes become the hash of their digests, until one, the source's *subroot*, is left. Subroots
in order of source give the *root* in the same way. A row's *proof* is what its leaf lacks on the way to the root: the other nodes of its
run, left to right, level by level.

Slot pivot: a node's place in its run is its *slot*. One conditional aggregate a slot spreads the children of a parent into ``FANOUT``
columns; the columns concatenated hash to the parent, and the columns but a child's own are that child's siblings, those before it and
those after it. So a level is one group-by over its nodes, and its siblings need no further join: they leave the parent's row with the child.

How it runs. Rows are dealt by range of (source, doc_id), so a source of any size spreads over tasks; the order is written once with each
row's number, and a row's place in its source is that number less the first one of its source in the range plus what lies in earlier
ranges. Texts stay in the first scan. A group is one run of ``FANOUT`` nodes; levels shrink by that factor, and their number is the
logarithm of the largest source. On the way down parents hand each child the digests before and after it at every level above.

Defined results: null doc_ids come first and are never tampered with; rows that share a doc_id are ordered by leaf; equal rows have equal
leaves and a proof each; a null source is a source of its own, before the empty one; a lone leaf is its source's subroot and
has no siblings there; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltlab.session import staged

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 5


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts one after the other; nulls are left out."""
    return F.sha2(F.concat_ws("", *parts).cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """Digest of a row's fields, each with its length in front."""
    texts = [f.cast("string") for f in fields]
    return digest(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts))


def leaves(docs: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(tree, doc_id, leaf, changed): ``changed`` is the leaf of the tampered row, null where nothing is tampered with.

    ``tree`` names the source: empty for null, else ``/`` and the source, so that null comes first.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    picked = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPERED)) == 0
    other = [F.translate(F.col(c), upper, lower) if c == "text" else F.col(c) for c in columns]
    return docs.select(
        F.coalesce(F.concat(F.lit("/"), F.col("source")), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf([F.col(c) for c in columns]).alias("leaf"),
        F.when(picked, leaf(other)).alias("changed"),
    )


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``place`` (from 0) in its ``tree`` by ``order``, and ``total``, the tree's number of nodes.

    Ranges are written before their counts are read, so a task that runs again reads the same ranges.
    """
    ranged = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = staged(ranged.withColumn("number", F.monotonically_increasing_id())).withColumn("range", F.shiftright("number", 33))
    steps = ranged.groupBy("tree", "range").agg(F.min("number").alias("opening"), F.count("*").alias("here"))
    before = F.coalesce(F.sum("here").over(Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("here").over(Window.partitionBy("tree"))
    steps = steps.select("tree", "range", (before - F.col("opening")).alias("shift"), total.alias("total"))
    return ranged.join(steps, ["tree", "range"]).withColumn("place", F.col("number") + F.col("shift")).drop("number", "range", "shift")


def pivot(nodes: DataFrame, fanout: int, *carried: str) -> DataFrame:
    """Parents (tree, place, total, lone, slot columns s0, s1, ...) of the nodes (tree, place, total, digest).

    A slot holds its child's digest and the columns ``carried``; it is null past a run's end.
    """
    slot = F.pmod(F.col("place"), F.lit(fanout))
    spread = [F.max(F.when(slot == k, F.struct("digest", *carried))).alias(f"s{k}") for k in range(fanout)]
    parent = F.floor(F.col("place") / F.lit(fanout)).cast("long").alias("place")
    total = F.ceil(F.first("total") / F.lit(fanout)).cast("long").alias("total")
    return nodes.groupBy("tree", parent).agg(total, (F.first("total") == 1).alias("lone"), *spread)


def parents(runs: DataFrame, fanout: int) -> DataFrame:
    """The node that each run becomes; a lone node stays what it is."""
    joined = digest(*(F.col(f"s{k}.digest") for k in range(fanout)))
    return runs.select("tree", "place", "total", F.when(F.col("lone"), F.col("s0.digest")).otherwise(joined).alias("digest"))


def grow(nodes: DataFrame, fanout: int, *carried: str) -> tuple[list[DataFrame], DataFrame]:
    """Runs of every level, lowest first, and the last node of each tree.

    The lowest level has a run for every tree, also for a tree of one node; above it a tree of one node is finished.
    """
    runs, ends = [], []
    while True:
        level = staged(pivot(nodes, fanout, *([] if runs else carried)))
        runs.append(level)
        above = parents(level, fanout)
        ends.append(above.where("total = 1").select("tree", "digest"))
        nodes = above.where("total > 1")
        if nodes.isEmpty():
            return runs, reduce(DataFrame.unionByName, ends)


def children(runs: DataFrame, fanout: int, *carried: str) -> DataFrame:
    """The children of ``runs`` with ``before`` and ``after``: the slots but their own, put in front of the run's.

    A lone node has null there, a run of one beside other runs the empty string.
    """
    kept = [c for c in ("subroot",) if c in runs.columns]
    slots = F.array_compact(F.array(*(f"s{k}" for k in range(fanout))))
    run = runs.select("tree", "place", "lone", "before", "after", *kept, slots.alias("slots"))
    run = run.withColumn("digests", F.transform("slots", lambda x: x["digest"]))
    child = run.select("*", F.posexplode("slots").alias("slot", "child"))
    left, right = F.slice("digests", F.lit(1), F.col("slot")), F.slice("digests", F.col("slot") + 2, F.lit(fanout))
    left, right = (F.when(~F.col("lone"), F.array_join(side, "")) for side in (left, right))
    return child.select(
        "tree",
        (F.col("place") * fanout + F.col("slot")).alias("place"),
        F.col("child.digest").alias("digest"),
        F.concat(F.array(left), "before").alias("before"),
        F.concat(F.array(right), "after").alias("after"),
        *(F.col(f"child.{c}").alias(c) for c in carried),
        *kept,
    )


def descend(runs: list[DataFrame], tops: DataFrame, fanout: int, *carried: str) -> DataFrame:
    """The lowest nodes with the digests before and after them at every level; ``tops`` has those of each tree's last node."""
    paths = None
    for level in range(len(runs) - 1, -1, -1):
        here = runs[level]
        first = here.where("total = 1").join(tops, "tree")
        if paths is not None:
            first = first.unionByName(here.where("total > 1").join(paths.drop("digest"), ["tree", "place"]))
        # Each level but the lowest is written: it has a sixteenth of the nodes below it, and every plan stays one level deep.
        paths = children(first, fanout, *([] if level else carried))
        paths = staged(paths) if level else paths
    return paths


def folded(start: Column, before: Column, after: Column) -> Column:
    """The root that follows from a leaf and its siblings; null stands for no level."""
    step = F.zip_with(before, after, lambda left, right: F.struct(left.alias("left"), right.alias("right")))
    return F.aggregate(step, start, lambda node, s: F.when(s["left"].isNull(), node).otherwise(digest(s["left"], node, s["right"])))


def manifest(docs: DataFrame, fanout: int = FANOUT, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """doc_id, leaf, subroot, root, siblings (before, after), proof_sha256, folded_root and verified of every row."""
    # Written first: the ranges are drawn from a sample, which would hash every row once more.
    rows = placed(staged(leaves(docs, columns)), ["doc_id", "leaf"]).withColumnRenamed("leaf", "digest")
    runs, subroots = grow(rows, fanout, "doc_id", "changed")
    named = staged(subroots)
    # The sources' subroots are the lowest nodes of one more tree.
    top = placed(named.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"), ["source"])
    upper, root = grow(top, fanout, "source")
    none = F.array().cast("array<string>")
    tops = root.select("tree", none.alias("before"), none.alias("after"))
    sources = descend(upper, tops, fanout, "source").select(F.col("source").alias("tree"), F.col("digest").alias("subroot"), "before", "after")
    one = root.first()  # the root, a single row
    found = descend(runs, staged(sources), fanout, "doc_id", "changed").withColumn("root", F.lit(one["digest"] if one else None).cast("string"))
    proof = F.concat_ws("", F.zip_with("before", "after", lambda left, right: F.concat_ws("", left, right)))
    back = folded(F.coalesce("changed", "digest"), F.col("before"), F.col("after"))
    out = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "before", "after", digest(proof).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

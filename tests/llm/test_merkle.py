"""The Merkle manifest against a tree built by hand."""

import hashlib
import random
import zlib

import pytest

from tiltlab.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, digest string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(fields):
    return sha(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(nodes, fanout):
    """Root, and for each node its (before, after) by level."""
    paths = [[] for _ in nodes]
    owner = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, owners = [], []
        for at in range(0, len(nodes), fanout):
            run = nodes[at : at + fanout]
            for k in range(len(run)):
                for i in owner[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(sha(*run))
            owners.append(sum(owner[at : at + fanout], []))
        nodes, owner = above, owners
    return nodes[0], paths


def by_hand(rows, fanout):
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    found = {}
    for name in names:
        sources[name].sort(key=lambda x: x[:3])
        found[name] = climb([x[2] for x in sources[name]], fanout)
    root, above = climb([found[name][0] for name in names], fanout)
    out = []
    for name, upper in zip(names, above, strict=True):
        subroot, paths = found[name]
        for (_, _, leaf, row), lower in zip(sources[name], paths, strict=True):
            path = lower + upper
            node = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                node = leaf_of((*row[:4], row[4] and row[4].translate(LOWER)))
            for before, after in path:
                node = sha(before, node, after)
            out.append((row[0], leaf, subroot, root, sha(*(b + a for b, a in path)), node, node == root))
    return sorted(out, key=repr)


def found_rows(spark, rows, fanout=16):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in merkle.manifest(docs, fanout).select(*names).collect()), key=repr)


def fixture():
    draw = random.Random(5)
    rows = []
    for i in range(70):  # a source with a third of all rows, several levels deep
        rows.append((i * 3, "Hot", "en", i, f"Text {i} É"))
    for i in range(100):
        rows.append((1000 + i, draw.choice(["b", "ä", "z", "", None]), draw.choice(["en", None]), draw.choice([None, 5]), draw.choice(["Aa", "", None, "ß\nX"])))
    rows += [(5000, f"lone{k}", "en", 1, "T") for k in range(9)]
    rows += [(7, "Hot", "en", 1, "other text, same id"), (6, "Hot", "en", 2, "Text 2 É"), (6, "Hot", "en", 2, "Text 2 É")]
    rows += [(None, "Hot", None, None, None), (None, "Hot", "en", 3, "A"), (-4, "Hot", "en", 3, "A" * 300_000)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("fanout", [3, 16])
def test_tree_proofs_and_tampering_follow_the_definition(spark, fanout):
    rows = fixture()
    assert found_rows(spark, rows, fanout) == by_hand(rows, fanout)


def test_run_of_one_beside_other_runs_is_hashed(spark):
    rows = [(i, "s", "en", 1, "t") for i in range(17)]
    assert found_rows(spark, rows) == by_hand(rows, 16)


@pytest.mark.parametrize("rows", [[], [(10, None, None, None, None)], [(10, "s", "en", 1, "Upper")], [(1, "s", "e", 1, "T"), (1, "s", "e", 1, "T")]])
def test_small_tables(spark, rows):
    assert found_rows(spark, rows) == (by_hand(rows, 16) if rows else [])


def test_only_changed_texts_fail(spark):
    rows = [(i, f"s{i % 3}", "en", 1, "Upper" if i % 2 else "lower") for i in range(200)]
    for doc_id, *_, verified in found_rows(spark, rows):
        tampered = zlib.crc32(str(doc_id).encode()) % 5 == 0
        assert verified == (not tampered or doc_id % 2 == 0)

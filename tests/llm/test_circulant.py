"""Circulant MinHash classes against brute force over all pairs."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_operators import frame, rng_words, words
from tiltlab.llm import circulant


def shingles(text, size=3):
    w = words(text, lower=True)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def by_hand(rows, size=3, percent=85):
    """Distinct (doc_id, n_shingles, component_id, kept)."""
    nodes = sorted({(i, frozenset(shingles(t, size))) for i, t in rows if i is not None}, key=lambda x: x[0])
    root = list(range(len(nodes)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for p, q in itertools.combinations(range(len(nodes)), 2):
        a, b = nodes[p][1], nodes[q][1]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            root[max(find(p), find(q))] = min(find(p), find(q))
    found = {node: nodes[find(k)][0] for k, node in enumerate(nodes)}
    out = []
    for i, t in rows:
        s = frozenset(shingles(t, size))
        own = None if i is None else found[i, s]
        out.append((i, len(s), own, i == own))
    return sorted(out, key=repr)


def found_rows(docs, **more):
    return sorted((tuple(r) for r in circulant.near_duplicates(docs, **more).collect()), key=repr)


def chains(seed, groups=12, length=9, size=60):
    """Texts that drift from copy to copy, so that classes are chains and many pairs lie near the threshold."""
    draw = random.Random(seed)
    rows, number = [], 1000
    for g in range(groups):
        text = rng_words(f"{seed}{g}", size, 5000).split()
        for _ in range(length):
            rows.append((number, " ".join(text)))
            number += draw.choice([1, 3])
            at = draw.randrange(len(text))
            text = text[:at] + [f"new{draw.random()}"] * draw.choice([1, 1, 2]) + text[at + draw.choice([0, 1]) :]
    draw.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    base = rng_words("b", 120)
    near = base.split()
    out = [(i, rng_words(i, 30 + 7 * i)) for i in range(10)]
    out += [(100, base), (99, base.upper()), (102, " ".join([*near[:60], "changed", *near[61:]])), (103, " ".join(near[3:])), (104, " ".join(near + ["more"] * 3))]
    out += [(200, None), (201, ""), (202, " \n\t"), (203, "one"), (204, "ONE"), (205, "One  two"), (206, "one\ntwo"), (207, "É x y"), (208, "é x y")]
    out += [(300, "spam ham\n" * 60), (301, "spam ham " * 90), (302, "long" + "x" * 5000 + " " + rng_words("l", 3000)), (303, rng_words("l", 3000))]
    out += [(5, rng_words(5, 65)), (5, rng_words(5, 65)), (5, "other text under an id"), (400, "Other text under an id"), (None, rng_words("n", 50)), (None, None), (None, "one")]
    return out + chains("d")


@pytest.mark.parametrize("more", [{}, {"chunk": 3, "open_limit": 1, "rows": 1, "bands": 60}])
def test_classes_equal_brute_force(spark, rows, more):
    """Also where buckets are cut into chunks and pairs are held back at first."""
    assert found_rows(frame(spark, rows), **more) == by_hand(rows)


def test_other_sizes_and_thresholds(spark, rows):
    some = [r for r in rows if r[0] is None or r[0] > 90]
    assert found_rows(frame(spark, some), size=5, percent=75, rows=3, bands=40) == by_hand(some, 5, 75)


def test_empty(spark):
    assert found_rows(frame(spark, []).limit(0)) == []
    assert found_rows(frame(spark, [(1, None), (None, " ")])) == [(1, 0, 1, True), (None, 0, None, True)]


def test_second_permutation_is_one():
    """The rank is a bijection: its steps can be undone."""

    def unshift(x, k):
        out = x.copy()
        for _ in range(32 // k):
            out = x ^ (out >> np.uint32(k))
        return out

    places = np.random.default_rng(3).integers(0, 2**32, 1000, dtype=np.uint32)
    x = unshift(circulant.ranked(places), 16)
    x = unshift(x * np.uint32(pow(0x846CA68B, -1, 2**32)), 15)
    assert (unshift(x * np.uint32(pow(0x7FEB352D, -1, 2**32)), 16) == places).all()


def test_signatures_are_shifts_and_estimate_similarity():
    draw = np.random.default_rng(4)
    both, one, other = (draw.integers(0, 2**63, k).astype(np.uint64) for k in (70, 15, 15))
    sets = [np.concatenate([both, one]), np.concatenate([both, other]), np.zeros(0, np.uint64)]
    first = np.cumsum([0, *(len(s) for s in sets)])
    found = circulant.signatures(np.concatenate(sets), first, 400)
    assert (found[:, 2] == 0xFFFFFFFF).all()
    for k in (0, 1, 17, 399):
        assert found[k, 0] == circulant.ranked(circulant.placed(sets[0]) + np.uint32(k)).min()
    assert abs((found[:, 0] == found[:, 1]).mean() - 0.7) < 0.1


def test_open_pairs_give_the_nearest_of_each_label():
    draw = np.random.default_rng(6)
    parity = draw.integers(0, 2**62, 16)
    rows = [{"tile": "t", "side": 2, "bucket": b, "s": k, "label": k % 2, "n": 4000, "parity": (parity ^ (1 << k // 4) - 1).tolist()} for k in range(12) for b in (1, 2)]
    table = pa.Table.from_pylist(rows + rows[:2])
    every = circulant.open_pairs(table, 85, 1000).to_pylist()
    assert sorted((r["y"], r["x"]) for r in every) == [(i, j) for i, j in itertools.combinations(range(12), 2) if i % 2 != j % 2]
    assert not any(r["held"] for r in every)
    few = circulant.open_pairs(table, 85, 6).to_pylist()
    assert len(few) == 6 and all(r["held"] and r["x"] // 4 == r["y"] // 4 for r in few)


def test_group_of_near_copies_costs_few_pairs():
    """Every label brings a few pairs, however many it could."""
    rows = [{"tile": "t", "side": 2, "bucket": 1, "s": k, "label": k, "n": 4000, "parity": [k] * 16} for k in range(300)]
    found = circulant.open_pairs(pa.Table.from_pylist(rows), 85, 16)
    assert 300 * 16 / 2 <= found.num_rows <= 300 * 16

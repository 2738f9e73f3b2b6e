"""Collocations against brute force, with prefixes lengthened to every depth and words outside the head."""

import collections
import random
import re

import numpy as np
import pytest

from tests.llm.test_operators import frame
from tiltlab.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, words string, a string, name string, language string"


def by_hand(rows, least, top, depth=5):
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            counts[lang].update(tuple(w[i : i + m]) for m in range(1, depth + 1) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in found.items():
            inside = (q for q in found if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if any(100 * found[q] >= 100 * a for q in inside):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], start=1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def found_rows(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, lang, "x", "x", "x", "x") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in collocations.collocations(docs, **more).collect())


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(9)
    vocabulary = [f"w{k}" for k in range(25)] + ["É", "é", "x-y", "#", "THE", "the"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    out = []
    for k in range(120):
        text = ""
        for w in draw.choices(vocabulary, weights, k=draw.choice([0, 1, 5, 60, 200])):
            text += w + draw.choice([" "] * 12 + ["  ", "\t", ". ", ", ", "\n", "?!", "\x0b", "\r\n", ";"])
            if draw.random() < 0.05:
                text += "New York City Hall opens "
        out.append((text, draw.choice(["en", "en", "en", "de", None, "und"])))
    out += [(None, "en"), ("", "fr"), ("...", "fr"), ("one", "es"), (out[2][0], out[2][1]), (out[2][0], out[2][1])]
    out += [("same words again " * 400, "it"), ("a very long text of words " * 3000, "en")]
    return out


@pytest.mark.parametrize("more", [{"budget": 60}, {"head": 4, "budget": 300, "top": 60}])
def test_collocations_equal_brute_force(spark, rows, more):
    least, top = 8, more.get("top", 2000)
    got = found_rows(spark, rows, least=least, **more)
    assert got == by_hand(rows, least, top)
    assert any(len(r[2].split()) == 5 for r in got) or top < 100


def test_plan_lengthens_prefixes_beyond_the_budget(spark, rows):
    """No group holds more than the budget but for what hashing adds; groups share the words they say they share."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "text string, lang string").select(F.lit("x").alias("lang"), F.lit(1).cast("long").alias("language"), "text")
    vocabulary = collocations._vocabulary(docs, 8)
    plan, used, known = collocations.partitioned(docs, vocabulary, 8, 5, 400, 1000)
    assert len(plan.longer) == 4 and all(count > 400 for _, count in known) and {len(codes) for codes, _ in known} >= {2, 3}
    batch = docs.toArrow().combine_chunks().to_batches()[0]
    _, names, opens = collocations.named_words(batch)
    leaves = collocations.suffixes(plan.codes(names), opens, 5)
    group, shared = collocations.groups(leaves, plan)
    assert group.max() < used
    for g in np.unique(group[group >= 0]):
        mine = group == g
        assert len(set(shared[mine])) == 1
        if shared[mine][0] < 5:
            _, sizes = np.unique(leaves[mine][:, : shared[mine][0]], axis=0, return_counts=True)
            assert sizes.max() <= 400


def test_blocks_keep_suffixes():
    draw = np.random.default_rng(2)
    for top in (50, 1 << 40):
        leaves, counts = collocations.collapsed(draw.integers(1, top, (500, 5)).astype(np.uint64) | np.uint64((top >> 40) << 63), draw.integers(1, 9, 500))
        again = collocations.unpack(collocations.pack(leaves, counts), 5)
        assert (again[0] == leaves).all() and (again[1] == counts).all()
        assert sorted(map(tuple, leaves.tolist())) == list(map(tuple, leaves.tolist()))


def test_scores_beyond_64_bits(spark):
    """Products of counts are exact."""
    big = 3_000_000_000_000
    words = spark.createDataFrame([("en", 1, "x", big), ("en", 2, "y", big - 1), ("en", None, None, 7 * big)], "lang string, name long, word string, f long")
    found = spark.createDataFrame([([1, 2], big - 5)], "words array<long>, a long")
    row = collocations.scored(found, words).first()
    assert row.score == 1000 * (big - 5) * 7 * big // (big * (big - 1))


def test_empty(spark):
    assert found_rows(spark, [(None, "en"), ("", None)]) == []
    assert collocations.collocations(frame(spark, []).limit(0)).collect() == []

"""The Katz model against one written down in dictionaries, with heads far smaller than the vocabulary."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import words
from tiltlab.llm import katz

SCHEMA = "doc_id long, text string, held_out string, n_tokens string, bucket string, kind string, keys string"
START, END = "<start>", "<end>"


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def discount(counts):
    d = katz.discounts(np.array([0] + [sum(c == r for c in counts) for r in range(1, katz.GOOD_TURING + 3)]))
    return lambda c: c * d[c] if c <= katz.GOOD_TURING else c


def by_hand(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base, score) of every row, and the model's P(word | history)."""
    texts = [(i, [*words(t, lower=True), END]) for i, t in rows]
    one, two = collections.Counter(), collections.defaultdict(collections.Counter)
    for i, w in texts:
        if not held(i):
            one.update(w)
            for h, x in zip([START, *w], w):
                two[h][x] += 1
    total = sum(one.values())
    d1 = discount(list(one.values()))
    d2 = discount([c for f in two.values() for c in f.values()])
    left = 1 - sum(d1(c) for c in one.values()) / (total + 1)
    unigram = lambda x: d1(one[x]) / (total + 1) if one[x] else left

    def p(x, h):
        f = two.get(h)
        if not f:
            return unigram(x)
        n, seen, mass = sum(f.values()), sum(d2(c) for c in f.values()), sum(unigram(y) for y in f)
        if 1 - mass <= 1e-12:
            return d2(f[x]) / seen if x in f else 0.0
        return d2(f[x]) / (n + 1) if x in f else (1 - seen / (n + 1)) / (1 - mass) * unigram(x)

    out = []
    for i, w in texts:
        base = sum(math.log10((one[x] + 1) / (total + len(one) + 1)) for x in w)
        score = sum(math.log10(p(x, h)) for h, x in zip([START, *w], w))
        out.append((i, held(i), len(w), sum(one[x] > 0 for x in w), total, base, score))
    return sorted(out, key=repr), p, one, two


def found_rows(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, "x", "x", "x", "x", "x") for i, t in rows], SCHEMA).repartition(3)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    return sorted((tuple(r) for r in katz.scores(docs, fold, **more).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(31)
    vocabulary = [f"w{k}" for k in range(120)] + ["É", "x-y", "THE", "the"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    out = [(k, " ".join(draw.choices(vocabulary, weights, k=draw.choice([0, 1, 3, 40, 90])))) for k in range(120)]
    out += [(200, None), (201, ""), (202, " \n\t"), (203, "only here twice"), (204, "only here twice"), (205, "never never")]
    out += [(5, out[5][1]), (5, out[5][1]), (5, "another text under the id"), (None, "a row without an id"), (None, None)]
    return out + [(k, f"rare{k} seen{k} once{k} w1") for k in range(300, 330)] + [(400, "w0 w1 w2 " * 4000)]


@pytest.mark.parametrize("more", [{}, {"vocabulary": 1, "head": 1}, {"vocabulary": 40, "head": 200}])
def test_scores_equal_brute_force_whatever_the_head(spark, rows, more):
    got, want = found_rows(spark, rows, **more), by_hand(rows)[0]
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-6, abs=1e-5)


def test_probabilities_sum_to_one(rows):
    """Over all training words and the class of unseen ones, after every history and after none."""
    _, p, one, two = by_hand(rows)
    for h in [*two, "unseen history"]:
        assert sum(p(x, h) for x in one) + p("unseen word", h) == pytest.approx(1, abs=1e-9)


def test_every_word_of_a_large_vocabulary_counts(spark):
    """Pairs of words far outside the head tell a text that occurs twice from its words in another order."""
    draw = random.Random(7)
    told = {k: [f"v{draw.randrange(10**6)}" for _ in range(60)] for k in range(40)}
    rows = [(10 * k + j, " ".join(w)) for k, w in told.items() for j in (0, 1)]
    mixed = {10 * k + 5: " ".join(sorted(w)) for k, w in told.items()}
    got = {r[0]: r[6] for r in found_rows(spark, rows + list(mixed.items()), vocabulary=4, head=4) if r[0] is not None}
    assert all(got[10 * k] > got[10 * k + 5] + 10 for k in told if not held(10 * k) and not held(10 * k + 1))


def test_empty(spark):
    assert found_rows(spark, [])[:1] == []
    assert found_rows(spark, [(None, None)]) == [(None, False, 1, 1, 1, pytest.approx(math.log10(2 / 3)), pytest.approx(by_hand([(None, None)])[0][0][6], abs=1e-5))]
    fold = [i for i in range(100) if held(i)][0]
    assert found_rows(spark, [(fold, "a b")]) == [(fold, True, 3, 0, 0, 0.0, 0.0)]

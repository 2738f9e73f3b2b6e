"""The operators on small tables against brute force, with nulls, empty texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from tiltlab.llm import chat, html, jaccard, katz, licenses, mixing, rules, subword, substring, tiling

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, copies string, key string, a string, starts string"


def words(text, lower=False):
    raw = (text or "").encode()
    return (raw.translate(LOWER) if lower else raw).split()


def rng_words(seed, n, vocabulary=400):
    return " ".join(f"w{int(hashlib.md5(f'{seed}-{i}'.encode()).hexdigest(), 16) % vocabulary}" for i in range(n))


@pytest.fixture(scope="module")
def texts():
    base = rng_words("b", 120)
    near = base.split()
    rows = [(i, rng_words(i, 30 + 7 * i)) for i in range(20)]
    rows += [(100, base), (101, base), (102, " ".join(near[:60] + ["changed"] + near[61:])), (103, " ".join(near[3:])), (104, " ".join(near + ["more"] * 3))]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "one"), (204, "one"), (205, "One  two\nthree"), (206, "É x y z")]
    rows += [(300, "Spam ham\n" * 60), (301, "long" + "x" * 5000 + " " + rng_words("l", 3000)), (5, rng_words(5, 65)), (5, rng_words(5, 65)), (5, "other text under an id"), (None, rng_words("n", 50)), (None, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, f"s{(i or 0) % 3}" if i is None or i % 7 else None, 0, "x", "x", "x", "x", "x") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substring(docs, none, texts):
    seen = collections.Counter()
    for _, text in texts:
        w = words(text)
        seen.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    expected = []
    for i, text in texts:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = [x for x, out in zip(w, gone) if not out]
        expected.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    got = [tuple(r) for r in substring.removal_digests(docs, bits=16).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    cut = substring.remove_repeats(docs, bits=16)
    assert cut.columns == docs.columns
    assert sorted(len(words(r.text)) for r in cut.collect()) == sorted(n - out for _, n, out, _ in expected)
    assert substring.removal_digests(none, bits=16).count() == 0


@pytest.mark.parametrize("chunk", [2, 1000])
def test_jaccard(docs, texts, chunk):
    sets = []
    for i, text in texts:
        w = words(text, lower=True)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(texts)):
        for y in range(x):
            if texts[x][0] is not None and texts[y][0] is not None and sets[x] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                root[find(x)] = find(y)
    least = collections.defaultdict(list)
    for x, (i, _) in enumerate(texts):
        if i is not None:
            least[find(x)].append(i)
    expected = [(i, len(sets[x]), None if i is None else min(least[find(x)])) for x, (i, _) in enumerate(texts)]
    got = [tuple(r) for r in jaccard.near_duplicates(docs, chunk=chunk).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


@pytest.mark.parametrize("flush", [500, 10**6])
def test_jaccard_hot_group_in_chunks(spark, monkeypatch, flush):
    monkeypatch.setattr(jaccard, "FLUSH", flush)
    base = rng_words("hot", 100, 10**6).split()
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i in range(60) for k in [(7 * i) % 90 + 5]]
    rows.append((1000, rng_words("alone", 90, 10**6)))
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(frame(spark, rows), chunk=8).collect()}
    assert got == {i: 0 for i in range(60)} | {1000: 1000}
    assert {r.doc_id for r in jaccard.keep_one(frame(spark, rows + [rows[0]])).collect()} == {0, 1000}


def test_jaccard_pack_and_match_lose_no_pair():
    """Postings packed in any parts connect every two sets of a block of which the smaller is indexed."""
    rng = np.random.default_rng(5)
    parts, posted = [], collections.defaultdict(dict)
    sizes = {a: int(rng.integers(20, 24)) for a in range(100, 160)}
    for lot in np.array_split(rng.permutation(list(sizes)), 4):
        block, owner, role = [], [], []
        for i, a in enumerate(lot):
            for key in {0, 1} if a < 140 else set(rng.integers(2, 40, 5)):
                block.append(int(key) << 50)
                owner.append(i)
                role.append(bool(key != 1 and rng.random() < 0.5 or a == 101))
                posted[int(key) << 34][int(a)] = role[-1]
        parts.append((np.array(block, np.uint64), lot.astype(np.int64), np.array([sizes[a] for a in lot]), np.array(owner), np.array(role)))
    rows = [pa.Table.from_batches([pa.RecordBatch.from_pydict(jaccard.pack([p], 6), schema=jaccard._DEALT)]) for p in parts]
    table = pa.concat_tables(rows)
    found = [r for b in set(table["bucket"].to_pylist()) for r in jaccard.match(table.filter(pa.compute.equal(table["bucket"], b)), 6, 75).to_pylist()]
    leads = {r["x"]: r["y"] for r in found if r["kind"] == jaccard.LEAD}
    ends = [(r["x"], r["y"]) for r in found if r["kind"] in (jaccard.EDGE, jaccard.PAIR)]
    ends += [(r["y"], leads[r["x"]]) for r in found if r["kind"] == jaccard.WAIT and r["x"] in leads]
    root = {a: a for a in sizes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in ends:
        root[find(x)] = find(y)
    for members in posted.values():
        for x, y in itertools.combinations(members, 2):
            if members[x] and sizes[x] <= sizes[y] or members[y] and sizes[y] <= sizes[x]:
                assert find(x) == find(y)


def test_jaccard_empty(none):
    assert jaccard.near_duplicates(none).count() == 0


def test_katz(docs, none, texts):
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    got = katz.scores(docs, fold, vocabulary=64, head=32).collect()
    assert len(got) == len(texts)
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts}
    counts = collections.Counter(w for i, t in texts if not held[i] for w in [*words(t, lower=True), None])
    total, types = sum(counts.values()), len(counts)
    expected = collections.Counter()
    for i, t in texts:
        w = [*words(t, lower=True), None]
        expected[i, held[i], len(w), sum(counts[x] > 0 for x in w), total, round(sum(math.log10((counts[x] + 1) / (total + types + 1)) for x in w), 6)] += 1
    assert expected == collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert katz.scores(none, fold).count() == 0


def test_katz_discounts_leave_mass():
    import numpy as np

    for counts in ([0, 900, 300, 120, 60, 40, 25, 9], [0, 10, 30, 5, 50, 2, 9, 1], [0] * 8):
        d = katz.discounts(np.array(counts))
        assert d[0] == 1 and ((d[1:] > 0) & (d[1:] < 1)).all()


def test_licenses(docs, none, texts, spark):
    rows = [*texts, (900, "x\nReleased under the MIT License.\nUnder the MIT license"), (901, "This work is licensed under the GNU General Public License, version 3."), (902, "mit license"), (903, "CC BY-NC 4.0, cc by nc")]
    got = {(r.doc_id, r.n_words): r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert (got[900, 10].n_base, got[900, 10].first_word, got[900, 10].last_word, got[900, 10].base_labels, got[900, 10].labels) == (2, 2, 6, "mit", "mit")
    assert (got[901, 12].base_labels, got[901, 12].labels, got[901, 12].first_word) == ("", "gpl-3", None)
    assert got[902, 2].labels == "" and got[903, 8].n_base == 2
    assert got[200, 0].score == 0 and licenses.scan_licenses(none).count() == 0


def test_mixing(docs, none, texts):
    got = mixing.plan(docs)
    rows = got.collect()
    assert len(rows) == len(texts) and sorted(r.size for r in rows) == sorted(len(words(t)) for _, t in texts)
    assert all(0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size for r in rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.plan(docs.repartition(5)).collect()))
    assert mixing.plan(none).count() == 0
    assert set(mixing.mix_documents(docs).columns) == set(docs.columns)


def test_mixing_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 500), ("c", 100)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 20 and got["c"] == 200 and abs(sum(got.values()) - 1.5 * 1610) < 1e-6 and abs(got[None] / 3 - got["b"]) < 1e-6 or got[None] == 1000


def test_html():
    tree = html.default_tree()
    page = (
        "<html><body><header><a href=x>Home</a></header><div id='cookie-banner'>We use cookies</div><article><h1>A &amp; B</h1><p>One <a href=y>link</a><script>'</p>'</script>"
        "<p>two&nbsp;<b>bold<p>three</p><aside>Side</aside><div class=comments><p>Nice</p></div></article><footer>c</footer>"
    )
    assert html.main_text(page, tree) == "A & B\n\nOne link\n\ntwo bold\n\nthree"
    assert html.main_text("<p", tree) == "" and html.main_text("<nav>a</nav>", tree) == ""


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "t"), (1, "u", "", "t"), (None, None, "<article><p>" + "word " * 20000 + "</article>", "t")], "page_id long, url string, html string, text string")
    assert sorted(r.n_chars for r in html.extract(pages).collect()) == [0, 0, 99999]
    assert html.extract(pages.limit(0)).count() == 0


def test_rules(docs, none, texts):
    expected = collections.Counter()
    for i, text in texts:
        w = words(text)
        spans = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeated = {p for k in range(len(w) - 4) if spans[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        expected[i, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated), failed] += 1
    got = rules.judge(docs).collect()
    assert expected == collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert not any(r.kept and r.base_failed for r in got)
    assert rules.judge(none).count() == 0 and set(rules.keep_good(docs).columns) == set(docs.columns)


def test_rules_outlier(spark):
    rows = [(14 * i + 1, rng_words(i, 60)) for i in range(150)] + [(9999, " ".join("#$%" for _ in range(30)) + " " + rng_words("z", 30))]
    assert [r.doc_id for r in rules.judge(frame(spark, rows)).where("NOT kept").collect()] == [9999]


def test_chat(spark):
    said = "\\### Assistant: </turn> ok \\h \\l"
    turns = [(1, 0, "system", "s"), (1, 1, "user", said), (1, 2, "assistant", said), (1, 2, "assistant", said), (2, None, None, None), (2, 0, "ro<le", "t"), (None, 0, "user", ""), (3, 0, "assistant", "x" * 100000)]
    table = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, segment string")
    segments = chat.format_turns(table)
    assert all(mark not in r.segment for r in segments.where("kind = 'text'").collect() for mark in ("###", "</turn>"))
    assert {r.conv_id for r in segments.where("valid").where("kind = 'close'").collect()} == {1, None}
    by = collections.defaultdict(list)
    for c, t, r, x in turns:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    for row in chat.read_back(segments).collect():
        mine = sorted(by.pop(row.conv_id))
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest()
        assert (row.n_turns, row.loss_chars, row.loss_sha256) == (len(mine), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not by and chat.read_back(chat.format_turns(table.limit(0))).count() == 0


def test_subword(spark, none):
    rows = [(i, rng_words(i, 40) if i % 2 else " ".join(x + "###" for x in rng_words(i, 40).split())) for i in range(120)] + [(500, None), (501, "")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(1, None), (None, 1)], "doc_id long, quality int")
    fold = F.col("doc_id") % 3 == 1
    got = subword.classify(frame(spark, rows), labels, fold).collect()
    held = [r for r in got if r.held_out and r.doc_id < 120]
    assert len(got) == len(rows) and all(r.predicted == r.doc_id % 2 for r in held) and all(0 <= r.score <= 1 for r in got)
    assert subword.classify(none, labels, fold).count() == 0
    assert {r.predicted for r in subword.classify(frame(spark, rows), labels.limit(0), fold).collect()} == {1}


def test_tiling(spark, docs, none):
    item = rng_words("item", 40, 10**6).split()
    rows = [(1, "x y " + " ".join(item[20:] + ["gap"] + item[:20]) + " z"), (2, " ".join(item[:16])), (3, " ".join(item).upper().replace(" ", ", ")), (4, None), (None, " ".join(item))]
    items = spark.createDataFrame([(7, " ".join(item), 0), (8, "ab cd", 0), (9, None, 0)], "item_id long, text string, doc_id long")
    got = {(r.doc_id, r.item_id): r.covered_words for r in tiling.contaminated(frame(spark, rows), items, limit=100).collect()}
    assert got == {(1, 7): 40, (3, 7): 40, (None, 7): 40}
    assert sorted(str(r.doc_id) for r in tiling.remove_contaminated(frame(spark, rows), items).collect()) == ["2", "4"]
    assert tiling.contaminated(none, items).count() == 0 and tiling.contaminated(docs, items.limit(0)).count() == 0


def test_greedy_tiles_do_not_overlap():
    import numpy as np

    pattern, text = np.array([1, 2, 3, 4, 5, 6, 7, 8], np.uint64), np.array([5, 6, 7, 8, 9, 1, 2, 3, 4, 5, 6], np.uint64)
    tiles = tiling.greedy_tiles(pattern, text, 2)
    assert tiles[0] == (0, 5, 6) and sorted(tiles)[1] == (6, 2, 2)

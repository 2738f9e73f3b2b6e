"""Cases in which an operator once did less than the whole job."""

import numpy as np
import pytest

from tests.llm.test_operators import rng_words
from tiltlab.llm import html, jaccard, licenses, mixing, rules, substring, tiling
from tiltlab.llm import tokens as T

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("item", ["la " * 12, "a b c d " * 9, "x y z " + "no " * 30])
def test_tiling_finds_items_with_inner_repetition(spark, item):
    """The skip test counts places, not distinct seeds: an exact copy of a repetitive item is found."""
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "before after")], DOCS)
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    n = len(item.split())
    assert [tuple(r) for r in tiling.contaminated(docs, items).select("doc_id", "item_id", "item_words", "covered_words").collect()] == [(1, 7, n, n)]
    assert [r.doc_id for r in tiling.remove_contaminated(docs, items).collect()] == [2]


def brute_licenses(texts, templates=licenses.TEMPLATES):
    """Every column by plain loops: all starts, all occurrences, all phrases."""
    import re

    split = lambda x: re.findall(r"[a-z0-9\x80-\U0010ffff]+", x)
    files = [split("".join(c.lower() if c.isascii() else c for c in t or "")) for t in texts]
    frequency = {}
    for w in files:
        for x in set(w):
            frequency[x] = frequency.get(x, 0) + 1
    hashes = {x: int(licenses._hashes(x)[0]) for _, t, _ in templates for x in split(t)}
    out = []
    for w in files:
        stands = lambda phrase: [i for i in range(len(w)) if w[i : i + len(phrase)] == phrase]  # noqa: E731, B023
        base = {label: stands(split(p)) for p, label in licenses.BASE_PHRASES}
        places = sorted(i for found in base.values() for i in found)
        labels, score = {x for x, found in base.items() if found}, 1.0 if places else 0.0
        for label, text, keys in templates:
            t = split(text)
            within = 3 + len(t) // 8
            if not all(stands(split(key)) for key in keys):
                continue
            rare = sorted({x for x in t if x in w}, key=lambda x: (frequency[x], hashes[x]))[:8]
            starts = {x: {i - k for i, y in enumerate(w) if y == x for k, z in enumerate(t) if z == x} for x in rare}
            for s in set().union(*starts.values()):
                near = lambda spots, at: any(abs(i - at) <= within for i in spots)  # noqa: E731, B023
                if sum(near(v, s) for v in starts.values()) < max(1, len(rare) / 2):
                    continue
                if not all(near(stands(split(key)), s + next(k for k in range(len(t)) if t[k : k + len(split(key))] == split(key))) for key in keys):
                    continue
                share = sum(near([i for i in range(max(0, s + k - within), min(len(w), s + k + within + 1)) if w[i] == x], s + k) for k, x in enumerate(t)) / len(t)
                score = max(score, share)
                if share >= 0.6:
                    labels.add(label)
        out.append((len(w), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(x for x, f in base.items() if f)), ",".join(sorted(labels)), round(score, 9)))
    return out


def test_licenses_beside_a_long_notice(spark):
    """Labels of every notice of a file, however many rarer words another notice brings, words put in and left out, identifiers."""
    mit = next(text for label, text, _ in licenses.TEMPLATES if label == "mit" and 30 < len(text.split()) < 60)
    whole = next(text for label, text, _ in licenses.TEMPLATES if label == "mit" and len(text.split()) > 100)
    extra = ["licensed under the gnu general public license version 3", "all rights reserved", "licensed under cc by sa 4 0"]
    cases = {
        f"{mit} other words {extra[0]}": "gpl-3,mit",
        f"{mit} other words {extra[1]}": "mit,proprietary",
        f"{mit} other words {extra[2]}": "cc-by-sa,mit",
        mit.replace("any person", "any natural person").upper(): "mit",
        mit.replace("any person", "any person or company"): "mit",
        "Copyright 2020. " + whole.replace("sublicense", "").replace("express or", "express, statutory or") + " End.": "mit",
        "You may use it under the GNU General Public License, either version 3 of it": "gpl-3",
        "// SPDX-License-Identifier: MIT\nint main() {}": "mit",
        "# SPDX-License-Identifier: GPL-2.0-only": "gpl-2",
        "permission is hereby granted free of charge " + "x " * 90 + "deal in the software without restriction": "",
        "deal in the software without restriction permission is hereby granted free of charge": "",
        "version 3 of the general public licence": "",
    }
    common = [" ".join(sorted({w for x in extra for w in x.split()}))] * 40
    files = [*cases, " x ".join(t for _, t, _ in licenses.TEMPLATES), "all rights reserved " * 400, None, "", *common]
    files += ["Under the MIT License. under the mit license; Apache License, Version 2", "cc by nc cc by nc", "É under the MIT license"]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(files)), DOCS)).collect()
    got = [tuple(r)[1:] for r in sorted(got, key=lambda r: r.doc_id)]
    assert [g[5] for g in got[: len(cases)]] == list(cases.values())
    assert [(*g[:6], round(g[6], 9)) for g in got] == brute_licenses(files)
    assert licenses.scan_licenses(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize(
    "start, end",
    [
        ("<div class='content has-sidebar'><article>", "</article></div>"),
        ("<div class='elementor-widget elementor-widget-text-editor'>", "</div>"),
        ("<article class='post tag-legal'>", "</article>"),
        ("<article class='post category-social'>", "</article>"),
        ("<div class='sidebar'><main>", "</main></div>"),
        ("<div class='banner'><article class='post sponsored'>", "</article></div>"),
    ],
)
def test_html_keeps_the_article_in_a_marked_wrapper(start, end):
    around = ("<div class='ad'>Buy this now</div><div class='related'><article>See also that</article></div>", "<div class='comments-area'><article class='comment-body'>Nice one indeed</article></div>")
    page = f"<body>{around[0]}{start}<h1>Title of it</h1><p>Words of the first paragraph</p><div class='cookie-notice'>We use cookies</div><p>And a last one</p>{end}{around[1]}</body>"
    assert html.main_text(page, html.default_tree()) == "Title of it\n\nWords of the first paragraph\n\nAnd a last one"


@pytest.mark.parametrize("name", ["comment", "disqus", "advert", "cookie-notice", "sidebar", "related", "newsletter-box", "footer", "nav"])
@pytest.mark.parametrize("words", [5, 40, 200, 3000])
def test_html_drops_marked_blocks_of_any_length(name, words):
    """Notices, adverts, sidebars and comments, beside and inside the article, with and without links."""
    tree, long = html.default_tree(), "word " * words
    article = "".join(f"<p>Paragraph {k} of the article {'goes on and on ' * 300}</p>" for k in range(4))
    want = "\n\n".join(f"Paragraph {k} of the article {'goes on and on ' * 300}".strip() for k in range(4))
    for tag in ("div", "section", "p"):
        block = f"<{tag} class='{name}'>{long}</{tag}>"
        linked = f"<{tag} id='{name}'><a href=x>{long}</a> {long}</{tag}>"
        for page in (f"<main>{article}</main>{block}", f"{linked}<article>{article}</article>{block}", f"<article>{article}{block}{linked}</article>", f"<body>{block}{article}{linked}</body>"):
            assert html.main_text(page, tree) == want, (tag, page[:80])


def test_substring_anchors_of_a_text_beyond_24_bits():
    n, size = (1 << 24) + 5000, substring.WINDOW
    hashes = T.mix(np.arange(n, dtype=np.uint64))
    hashes[-100:] = hashes[1000:1100]
    starts, at = substring.anchors(T.Words(None, None, hashes, None, None, np.array([0, n])), size)
    assert len(starts) == n - size + 1 and ((at >= starts) & (at <= starts + size - substring.GRAM)).all()
    ranks = T.windows(hashes, substring.GRAM) >> np.uint64(24)
    for k in [*range(0, 50), *range((1 << 24) - 100, (1 << 24) + 100), *range(n - size - 50, n - size + 1)]:
        assert at[k] == k + np.argmin(ranks[k : k + size - substring.GRAM + 1])
    assert (at[n - 100 : n - size + 1] - (n - 100) == at[1000 : 1101 - size] - 1000).all()

def test_jaccard_two_texts_under_one_smallest_id(spark):
    """Different texts that share the smallest id of both their sets keep the links of both."""
    rows, texts = [], [rng_words(f"same-id-{k}", 100, 10**6).split() for k in range(2)]
    for k, text in enumerate(texts):
        rows += [(1, " ".join(text)), (10 + k, " ".join(text[:50] + ["changed"] + text[51:])), (20 + k, " ".join(text[:90]))]
    # The two are in one region: a text that shares shingles with both, too few to be near either.
    rows.append((30, " ".join(texts[0][:60] + texts[1][:60])))
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert got == {1: 1, 10: 1, 11: 1, 20: 1, 21: 1, 30: 30}
    assert sorted(r.doc_id for r in jaccard.keep_one(docs).collect()) == [1, 1, 30]


def brute_tiles(pattern, text, least):
    """Mark the longest common run of unmarked words, first in the pattern and then in the text, until none is left."""
    marked, taken, tiles = [False] * len(pattern), [False] * len(text), []
    while True:
        best = (0, 0, 0)
        for p in range(len(pattern)):
            for t in range(len(text)):
                n = 0
                while p + n < len(pattern) and t + n < len(text) and not marked[p + n] and not taken[t + n] and pattern[p + n] == text[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        n, p, t = best
        if n < least:
            return tiles
        tiles.append((p, t, n))
        marked[p : p + n] = taken[t : t + n] = [True] * n


@pytest.mark.parametrize("seed", range(30))
def test_greedy_tiles_equal_brute_force(seed):
    draw = np.random.default_rng(seed)
    vocabulary = int(draw.choice([1, 2, 3, 8]))
    pattern, text = (draw.integers(0, vocabulary, int(draw.integers(0, 40))).astype(np.uint64) for _ in range(2))
    least = int(draw.choice([1, 2, 4]))
    assert tiling.greedy_tiles(pattern, text, least) == brute_tiles(pattern.tolist(), text.tolist(), least)


def test_tiling_of_long_repetitive_texts_is_quick():
    import time

    start = time.perf_counter()
    tiles = tiling.greedy_tiles(np.ones(1000, np.uint64), np.ones(100_000, np.uint64))
    assert tiles == [(0, 0, 1000)] and time.perf_counter() - start < 2
    start = time.perf_counter()
    tiles = tiling.greedy_tiles(np.tile(np.arange(7, dtype=np.uint64), 150), np.tile(np.array([0, 1, 2, 3, 4, 9], np.uint64), 20_000))
    assert sum(n for _, _, n in tiles) >= 5 * 150 and time.perf_counter() - start < 2


def test_slices_of_a_benchmark_give_what_one_index_gives(spark):
    items = [(k, rng_words(f"item-{k}", 30, 10**6)) for k in range(12)]
    docs = [(k, f"before {items[k % 12][1]} and {items[(k + 5) % 12][1]} after") for k in range(20)] + [(None, items[3][1]), (99, None)]
    docs, items = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda limit: sorted(map(repr, tiling.contaminated(docs, items, limit=limit).drop("text_hash").collect()))
    assert rows(200) == rows(1 << 20) and len(rows(200)) == 41


def test_sketch_grows_with_the_table_and_splits_into_classes():
    sizes = [substring.sketch_size(n, 35) for n in (0, 10**6, 10**8, 10**9, 10**10, 10**11, 10**12)]
    assert sizes == sorted(sizes) and sizes[0] == (16, 1) and sizes[-1][0] == substring.SKETCH_BITS
    for n_bytes in (10**8, 10**9, 10**10, 10**11, 10**12):
        bits, classes = substring.sketch_size(n_bytes, 35)
        anchors = n_bytes / 6 * 2 / 29
        assert anchors <= (classes << bits) / 3.9  # a cell holds a quarter of an anchor at most


@pytest.mark.parametrize("bits", [16, 10])
def test_substring_in_classes_removes_the_same(spark, bits):
    rows = [(k, rng_words(f"own-{k}", 300, 10**6) + " " + rng_words(f"shared-{k % 9}", 45, 10**6)) for k in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    assert substring.sketch_size(10**5, 35, 10)[1] > 1
    got = sorted(tuple(r) for r in substring.removal_digests(docs, bits=bits).select("doc_id", "n_words", "n_removed").collect())
    assert got == [(k, 345, 45) for k in range(40)]


def test_stages_with_clashing_names(spark):
    """Columns named like what the stages add are carried along."""
    item = rng_words("bench", 40, 10**6)
    long = rng_words("passage", 60, 10**6)
    rows = [(k, rng_words(f"doc-{k}", 80, 10**6), "en", "s") for k in range(12)]
    rows += [(20, rows[0][1] + " end", "en", "s"), (21, "x " + item + " y", "en", "s"), (22, rng_words("p", 50, 10**6) + " " + long, "en", "s"), (23, rng_words("q", 50, 10**6) + " " + long, "en", "s")]
    names = ["_id", "__id", "_hash", "repeat_starts", "_repeat_starts", "_copies", "_mark_id", "_source", "b", "root", "tile"]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(*r, *names) for r in rows], schema)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in jaccard.keep_one(docs).collect()} == {r[0] for r in rows} - {20}
    assert {r.doc_id for r in tiling.remove_contaminated(docs, items).collect()} == {r[0] for r in rows} - {21}
    cut = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    assert len(cut[22].text.split()) == 50 and len(cut[1].text.split()) == 80 and cut[5]["_repeat_starts"] == "_repeat_starts"
    assert rules.keep_good(docs).columns == docs.columns
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == [*docs.columns, "copies"] and all(r["_copies"] == "_copies" and r.copies > 0 for r in mixed.collect())


def test_signatures_rule_out_large_unrelated_sets_and_no_link():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 3, 100, 127, 129, 700, 1500, 2049, 5000, 9000, 40000]
    common = rng.integers(0, 2**63, 40000).astype(np.uint64)
    for share in (0, 0.5, 0.9):  # of its shingles each set has in common with the others
        sets = [np.unique(np.concatenate([common[: int(n * share)], rng.integers(0, 2**63, n - int(n * share)).astype(np.uint64)])) for n in sizes]
        first = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        found = jaccard.signatures(np.concatenate(sets), first)
        x, y = (np.array(z) for z in zip(*[(x, y) for x in range(len(sets)) for y in range(len(sets))], strict=True))
        differ = jaccard.differing(found.take(x), found.take(y))
        real = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(x, y, strict=True)])
        n, m = (np.array(sizes)[z] for z in (x, y))
        assert (differ <= real).all()
        fits = differ * 175 <= 25 * (n + m)
        assert fits[jaccard.linked((n + m - real) // 2, n, m) & (n + m > 0)].all()
        near = (np.minimum(n, m) > 100) & (100 * np.minimum(n, m) >= 75 * np.maximum(n, m)) & (x != y)
        assert share > 0.5 or not fits[near].any()


def test_long_texts_that_share_a_part_make_no_region(spark):
    """A chain of texts with half in common with the next one each: none links, so none is to be compared in full."""
    parts = [rng_words(f"part-{k}", 2000, 10**6) for k in range(9)]
    docs = spark.createDataFrame([(k, f"{parts[k]} {parts[k + 1]}") for k in range(8)], DOCS)
    assert jaccard._regions(docs, jaccard._profile(docs, 5), 5, 75).count() == 0


@pytest.mark.parametrize("flush", [100, 10**6])
def test_frequency_levels_of_many_cells(spark, monkeypatch, flush):
    """Levels of cells that are sent by steps are those of all sums."""
    from tiltlab.llm import exchange

    docs = spark.createDataFrame([(k, rng_words(f"level-{k % 7}", 300, 50)) for k in range(40)], DOCS).repartition(3)
    keys = lambda batches: (jaccard.shingle_sets(p.column("text"), 1)[0] for p in T.pieces(batches))
    cells = sum(np.bincount(exchange.cell(x, 0, 16).astype(np.int64), minlength=1 << 16) for x in keys(docs.toArrow().to_batches()))
    monkeypatch.setattr(exchange, "SUMS_FLUSH", flush)
    for dense in (10, 16):
        monkeypatch.setattr(exchange, "DENSE_BITS", dense)
        assert (exchange.frequency_levels(docs, keys, 16) == np.floor(8 * np.log2(cells + 1.0))).all()


def test_cells_for_the_order_grow_with_the_table(spark, monkeypatch):
    bits = [jaccard.frequency_bits(n) for n in (0, 10**8, 10**9, 2 * 10**9, 10**12)]
    assert bits == [22, 22, 25, 26, 26]
    base = rng_words("cells", 100, 10**6).split()
    docs = spark.createDataFrame([(k, " ".join([*base[:50], f"x{k}", *base[50:]])) for k in range(20)], DOCS)
    monkeypatch.setattr(jaccard, "FREQUENCY_BITS", (23, 23))
    assert {r.component_id for r in jaccard.near_duplicates(docs).collect()} == {0}


def test_stage_gathers_no_text_of_long_unlinked_rows(spark, monkeypatch):
    """The pipeline's second stage keeps a chain of long texts whole without sending any of them to a comparison."""
    import corpus_pipeline

    sent, link = [], jaccard._link
    monkeypatch.setattr(jaccard, "_link", lambda gathered, *a: sent.append(gathered.count()) or link(gathered, *a))
    parts = [rng_words(f"stage-{k}", 2000, 10**6) for k in range(7)]
    rows = [(k, f"{parts[k]} {parts[k + 1]}") for k in range(6)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(tuple(r) for r in kept.collect()) == rows and sent == [0]

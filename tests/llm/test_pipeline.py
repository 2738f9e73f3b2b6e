"""The pipeline's stages follow each other, and each does to its input what plain loops say."""

import collections
import hashlib
import itertools

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_circulant import shingles
from tests.llm.test_operators import rng_words, words
from tests.llm.test_whole_jobs import brute_tiles
from tiltlab.llm import mixing, rules
from tiltlab.llm import tokens as T

ROOT = "/root/testdata/sf0.001"
NAMES = ("quality_rules", "near_duplicates", "substring_dedup", "decontamination", "source_mix")


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in entry.queries() if name.startswith("op") and name[2].isdigit()}
    assert entry.queries()["pipeline"] is not None and tuple(name for name, _ in corpus_pipeline.STAGES) == NAMES


def one_of_each(rows):
    """Distinct rows, of each class of near copies the one with the smallest doc_id; rows without a doc_id stay."""
    rows = [*{repr(r): r for r in rows if r.doc_id is not None}.values(), *(r for r in rows if r.doc_id is None)]
    sets = [frozenset(shingles(r.text, 5)) for r in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for p, q in itertools.combinations(range(len(rows)), 2):
        a, b = sets[p], sets[q]
        if rows[p].doc_id is not None and rows[q].doc_id is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
            root[find(q)] = find(p)
    least = collections.defaultdict(list)
    for k, r in enumerate(rows):
        least[find(k)].append(r.doc_id)
    return [r for k, r in enumerate(rows) if r.doc_id is None or not sets[k] or r.doc_id == min(least[find(k)])]


def without_repeats(rows, size=35):
    """Text by row, words covered by windows found twice or more taken out."""
    split = [words(r.text) for r in rows]
    seen = collections.Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for w in split:
        gone = {p for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for p in range(i, i + size)}
        out.append([x for p, x in enumerate(w) if p not in gone])
    return out


def clean_of(rows, items, least=4):
    """Rows in which tiles cover less than half of every item."""
    import re

    split = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    runs = lambda w: {tuple(w[i : i + least]) for i in range(len(w) - least + 1)}
    wanted = [(w, runs(w)) for w in (split(i.text) for i in items)]
    out = []
    for r in rows:
        w = split(r.text)
        mine = runs(w)
        hit = False
        for item, seeds in wanted:
            if len(mine & seeds) and not hit:
                # Words under no shared run belong to no tile.
                keep = {p for i in range(len(w) - least + 1) if tuple(w[i : i + least]) in seeds for p in range(i, i + least)}
                text = [x if p in keep else f"\0{p}" for p, x in enumerate(w)]
                spots = [x for p, x in enumerate(text) if p in keep or p - 1 in keep]
                hit = sum(n for _, _, n in brute_tiles(item, spots, least)) >= 0.5 * len(item)
        if not hit:
            out.append(r)
    return out


def mix_of(rows):
    """(row, copies) by weights 3, 1, 2 over sources, 150 percent of all words, no source beyond twice its own."""
    size = {id(r): len(words(r.text)) for r in rows}
    totals = collections.Counter()
    for r in rows:
        totals[r.source] += size[id(r)]
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:  # fill by weight; sources over their ceiling stop there
        level = (1.5 * sum(totals.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * totals[s]}
        target.update({s: 2 * totals[s] for s in full} if full else {s: level * weight[s] for s in open_})
        open_ = open_ - full if full else set()
    place = lambda r: int(hashlib.md5(f"{mixing.SALT}|{'' if r.doc_id is None else r.doc_id}|{r.text or ''}".encode()).hexdigest()[:15], 16)
    out = []
    for s in names:
        whole = min(int(target[s] // totals[s]), 2) if totals[s] else 0
        rest, taken = target[s] - whole * totals[s], 0
        mine = sorted((r for r in rows if r.source == s), key=place)
        for _, tied in itertools.groupby(mine, key=place):
            tied = list(tied)
            taken += sum(size[id(r)] for r in tied)
            more = whole < 2 and totals[s] > 0 and taken <= rest
            out += [(r, whole + more) for r in tied if whole + more]
    return out


def said(rows):
    return sorted(map(repr, rows))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The small tables with nulls, empty texts, repeated rows, near copies, a shared passage and benchmark items added, and a column more."""
    root = str(tmp_path_factory.mktemp("tables"))
    given = spark.read.parquet(f"{ROOT}/documents.parquet")
    items = spark.read.parquet(f"{ROOT}/benchmark.parquet")
    item = items.where("text IS NOT NULL").orderBy("item_id").first().text
    passage = rng_words("passage", 70, 10**5)
    base = rng_words("base", 120, 10**5)
    more = [(10**6 + k, t, "en", s) for k, (t, s) in enumerate([
        (None, "src1"), ("", "src1"), (" \n", None), (base, "src2"), (base + " end", "src2"), (base.upper(), None),
        (f"{rng_words('a', 80, 10**5)} {passage} {rng_words('b', 40, 10**5)}", "src3"), (f"{rng_words('c', 80, 10**5)} {passage}", "src3"),
        (f"{rng_words('d', 60, 10**5)} {item} {rng_words('e', 60, 10**5)}", "src4"), ("same row " + rng_words("f", 50, 10**5), "src5"), (rng_words("g", 30_000, 400), "src6"),
    ])]
    more += [more[9], (None, rng_words("h", 60, 10**5), "en", "src1"), (None, None, None, None)]
    added = spark.createDataFrame([(*r, len(r[1] or "")) for r in more], "doc_id long, text string, lang string, source string, n_chars long")
    given.unionByName(added).selectExpr("*", "concat('x', doc_id) AS _id").write.parquet(f"{root}/documents.parquet")
    items.write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages_equal_plain_loops(spark, tables, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, sizes = docs.columns, []
    for name in NAMES:
        before = docs.collect()
        stages[name](spark, docs, tables).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = docs.collect()
        sizes.append((len(before), len(after)))
        assert docs.columns == columns + ["copies"] * (name == "source_mix")
        if name == "quality_rules":  # the base rules by loops; the estimate's verdict by the operator itself
            verdict = {(r.doc_id, r.text_hash): r.kept for r in rules.judge(spark.read.parquet(f"{tables}/documents.parquet")).collect()}
            assert len(after) == sum(verdict.get(k, False) * n for k, n in collections.Counter((r.doc_id, r.h) for r in spark.read.parquet(f"{tables}/documents.parquet").selectExpr("doc_id", "xxhash64(text) AS h").collect()).items())
            for r in after:
                w = words(r.text)
                spans = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
                repeated = {p for i in range(len(w) - 4) if spans[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
                assert len(w) >= 10 and 100 * len(repeated) <= 20 * len(w)
        elif name == "near_duplicates":
            assert said(after) == said(one_of_each(before))
        elif name == "substring_dedup":
            assert sorted(((r.doc_id is None, r.doc_id or 0), words(r.text)) for r in after) == sorted(((r.doc_id is None, r.doc_id or 0), w) for r, w in zip(before, without_repeats(before)))
            assert all(r.n_chars == len(r.text) for r in after if r.text is not None)
        elif name == "decontamination":
            assert said(after) == said(clean_of(before, spark.read.parquet(f"{tables}/benchmark.parquet").collect()))
        else:
            assert said([(*r[:-1], r.copies) for r in after]) == said([(*r, n) for r, n in mix_of(before)])
    assert all(a > b for a, b in sizes if (a, b) != sizes[2]) and sizes[2][0] == sizes[2][1] and sizes[-1][1] > 0


def test_run_gives_the_last_stage(spark, tables):
    found = corpus_pipeline.run(spark, tables)
    assert found.columns[-1] == "copies" and found.count() > 0


def test_stages_take_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").limit(0)
    items = spark.read.parquet(f"{ROOT}/benchmark.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_spare_names(spark):
    df = spark.range(1).selectExpr("id AS _ID", "id AS __id", "id AS hash")
    assert T.spare(df, "id", "hash") == ["___id", "_hash"]

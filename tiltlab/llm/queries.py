"""Registered queries of the training-data operators, and their SQL where SQL can express them.

Queries without SQL are tested against brute force, exact round trips or held-out labels in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltlab.llm import chat, circulant, collocations, html, jaccard, katz, licenses, merkle, mixing, rules, substring, subword, tiling


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def _fold(parts: int, part: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == part


def op1_katz_scores(spark: SparkSession, root: str) -> DataFrame:
    """Log probability of every document under a Katz model of the other six folds."""
    return katz.scores(_table(spark, root, "documents"), _fold(7, 2))


def op2_license_scan(spark: SparkSession, root: str) -> DataFrame:
    """License labels of every document."""
    return licenses.scan_licenses(_table(spark, root, "documents"))


def op3_ngram_jaccard(spark: SparkSession, root: str) -> DataFrame:
    """Components of documents whose five-word shingles overlap by three quarters."""
    return jaccard.near_duplicates(_table(spark, root, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_source_mix(spark: SparkSession, root: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.plan(_table(spark, root, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_html_text(spark: SparkSession, root: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(_table(spark, root, "pages"))


def op6_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    """Base measures and verdict of every document."""
    found = rules.judge(_table(spark, root, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_chat_format(spark: SparkSession, root: str) -> DataFrame:
    """Digests of all conversations and one of control strings, read back from their formatted segments."""
    turns = _table(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    tricky = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.format_turns(turns.unionByName(tricky)))


def op8_quality_classifier(spark: SparkSession, root: str) -> DataFrame:
    """Quality score of every document."""
    return subword.classify(_table(spark, root, "documents"), _table(spark, root, "labels"), _fold(3, 1))


def op9_substring_dedup(spark: SparkSession, root: str) -> DataFrame:
    """What stays of every document without words in repeated 35-word windows."""
    return substring.removal_digests(_table(spark, root, "documents"))


def op10_decontaminate(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the share of its words found."""
    found = tiling.contaminated(_table(spark, root, "documents"), _table(spark, root, "benchmark"))
    return found.select("doc_id", "item_id", "item_words", "covered_words", "coverage")


def op11_phrase_collocations(spark: SparkSession, root: str) -> DataFrame:
    """The 2,000 highest-scoring collocations of each language."""
    return collocations.collocations(_table(spark, root, "documents"))


def op12_circulant_minhash(spark: SparkSession, root: str) -> DataFrame:
    """Classes of documents whose three-word shingles overlap by 85 percent."""
    return circulant.near_duplicates(_table(spark, root, "documents"))


def op13_merkle_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Leaf, proof and check of every document in a hash tree over sources."""
    found = merkle.manifest(_table(spark, root, "documents"))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    fn.__name__: fn
    for fn in (
        op1_katz_scores,
        op2_license_scan,
        op3_ngram_jaccard,
        op4_source_mix,
        op5_html_text,
        op6_quality_rules,
        op7_chat_format,
        op8_quality_classifier,
        op9_substring_dedup,
        op10_decontaminate,
        op11_phrase_collocations,
        op12_circulant_minhash,
        op13_merkle_manifest,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _links(size: int, percent: int, more: str) -> str:
    """Classes of documents whose sets of ``size``-word shingles overlap by ``percent`` in a hundred."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + {size - 1}], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - {size - 2}, 2))) AS t(i) WHERE len(ws) > 0
), n AS (
  SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= {percent} * (p.n + q.n - k)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM n
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
)
SELECT n.doc_id, n.n AS n_shingles, min(r.y) AS component_id{more} FROM n JOIN reach r ON r.x = n.doc_id GROUP BY n.doc_id, n.n
"""


ORACLES = {
    "op3_ngram_jaccard": _links(5, 75, ""),
    "op4_source_mix": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
    ('0x' || substr(md5('{mixing.SALT}|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS place FROM d GROUP BY source
), v AS (
  SELECT *, [3.0, 1.0, 2.0][((place - 1) % 3 + 1)::INT]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS ceiling FROM s
), o AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
    coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ceiling / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_weight
  FROM v
), l AS (
  SELECT *, (budget - below) / open_weight AS level FROM o
), f AS (
  SELECT min_by(level, (ceiling / weight, place)) AS level FROM l WHERE level < ceiling / weight
), g AS (
  SELECT v.source, v.source_size, CASE WHEN f.level IS NULL THEN ceiling ELSE least(ceiling, f.level * weight) END AS target FROM v, f
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS whole FROM g
), c AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target, (whole + CASE WHEN whole < 2 AND source_size > 0 AND upto <= rest THEN 1 ELSE 0 END) * size AS taken FROM c
""",
    "op7_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *,
    CASE role WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 WHEN 'system' THEN 6 WHEN 'tool' THEN 4 ELSE length(role) + length(regexp_replace(role, '[^\\#<]', '', 'g')) END
      + length('### ' || ':' || chr(10)) + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + length(chr(10) || '</turn>' || chr(10)) AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(chars) + length('### Conversation' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op9_substring_dedup": rf"""
WITH w AS (
  SELECT doc_id, {_WORDS} AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k FROM w, unnest(range(1, len(ws) - 33)) AS t(i)
), rep AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY k) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + o AS p FROM rep, range(0, 35) AS t(o)
), word AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
    "op11_phrase_collocations": rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]') AS pieces FROM documents
), e AS (
  SELECT id, lang, generate_subscripts(pieces, 1) AS pc, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS ws FROM d
), w AS (
  SELECT id, lang, pc, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM e
), y AS (
  SELECT lang, word AS w1, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3, lead(word, 3) OVER p AS w4, lead(word, 4) OVER p AS w5
  FROM w WINDOW p AS (PARTITION BY id, pc ORDER BY i)
), g AS (
  SELECT lang, [w1] AS p, count(*) AS f FROM y GROUP BY lang, w1 HAVING count(*) >= 100 UNION ALL
  SELECT lang, [w1, w2], count(*) FROM y WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 100 UNION ALL
  SELECT lang, [w1, w2, w3], count(*) FROM y WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 100 UNION ALL
  SELECT lang, [w1, w2, w3, w4], count(*) FROM y WHERE w4 IS NOT NULL GROUP BY lang, w1, w2, w3, w4 HAVING count(*) >= 100 UNION ALL
  SELECT lang, [w1, w2, w3, w4, w5], count(*) FROM y WHERE w5 IS NOT NULL GROUP BY lang, w1, w2, w3, w4, w5 HAVING count(*) >= 100
), n AS (
  SELECT lang, count(*)::HUGEINT AS n FROM w GROUP BY lang
), c AS (
  SELECT lang, p, f AS a FROM g WHERE len(p) > 1
), covered AS (
  SELECT lang, p, max(a) AS longer FROM (
    SELECT lang, p[1:len(p) - 1] AS p, a FROM c WHERE len(p) > 2 UNION ALL SELECT lang, p[2:], a FROM c WHERE len(p) > 2
  ) GROUP BY lang, p
), s AS (
  SELECT c.lang, c.p, c.a, n.n, k, x.f AS l, y.f AS r, (1000::HUGEINT * c.a * n.n) // (x.f::HUGEINT * y.f) AS score
  FROM c JOIN n USING (lang), range(1, 5) AS t(k) JOIN g x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN g y ON y.lang = c.lang AND y.p = c.p[k + 1:]
  WHERE k < len(c.p) AND NOT EXISTS (SELECT 1 FROM covered v WHERE v.lang = c.lang AND v.p = c.p AND 100 * v.longer >= 100 * c.a)
), b AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, n, min(struct_pack(score := score, k := k, l := l, r := r)) AS cut FROM s GROUP BY ALL
), o AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY cut.score DESC, a DESC, encode(phrase)) AS rank, phrase, a, cut.l AS l, cut.r AS r, n, cut.score AS score FROM b
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000
""",
    "op12_circulant_minhash": _links(3, 85, ", n.doc_id = min(r.y) AS kept"),
    "op13_merkle_manifest": rf"""
WITH RECURSIVE f AS (
  SELECT doc_id, source,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') ||
      coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS other,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [(ord(c) >> b) & 1 for b in range(8)]))::BIGINT[]),
      lambda a, bit: xor(a >> 1, 3988292384 * (xor(a, bit) & 1))), 4294967295) % 5 = 0 AS tampered
  FROM documents
), l AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN tampered THEN sha256(head || coalesce(strlen(other) || ':' || other, '-')) END AS changed
  FROM f
), p AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS total FROM l
), t AS (
  SELECT 0 AS level, source, place, total, leaf AS digest FROM p
  UNION ALL
  SELECT level + 1, source, place // 16, (any_value(total) + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM t WHERE total > 1 GROUP BY level, source, place // 16
), r AS (
  SELECT source, level AS height, digest AS subroot, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS place, count(*) OVER () AS total FROM t WHERE total = 1
), u AS (
  SELECT 0 AS level, place, total, subroot AS digest FROM r
  UNION ALL
  SELECT level + 1, place // 16, (any_value(total) + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM u WHERE total > 1 GROUP BY level, place // 16
), low AS (
  SELECT level, source, place // 16 AS run, list(digest ORDER BY place) AS run_digests FROM t WHERE total > 1 GROUP BY level, source, place // 16
), high AS (
  SELECT level, place // 16 AS run, list(digest ORDER BY place) AS run_digests FROM u WHERE total > 1 GROUP BY level, place // 16
), s AS (
  SELECT l.source, l.run, l.level, l.run_digests, r.height, r.place AS at FROM low l JOIN r ON l.source IS NOT DISTINCT FROM r.source
), steps AS (
  SELECT p.source, p.place, s.level AS step, array_to_string(run_digests[1:(p.place // (16 ** s.level)::BIGINT) % 16], '') AS before,
    array_to_string(run_digests[(p.place // (16 ** s.level)::BIGINT) % 16 + 2:], '') AS after
  FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source AND s.run = p.place // (16 ** (s.level + 1))::BIGINT
  UNION ALL
  SELECT p.source, p.place, r.height + h.level, array_to_string(run_digests[1:(r.place // (16 ** h.level)::BIGINT) % 16], ''),
    array_to_string(run_digests[(r.place // (16 ** h.level)::BIGINT) % 16 + 2:], '')
  FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source JOIN high h ON h.run = r.place // (16 ** (h.level + 1))::BIGINT
), fold AS (
  SELECT source, place, 0 AS step, coalesce(changed, leaf) AS digest FROM p
  UNION ALL
  SELECT f.source, f.place, f.step + 1, sha256(s.before || f.digest || s.after) FROM fold f JOIN steps s ON f.source IS NOT DISTINCT FROM s.source AND f.place = s.place AND f.step = s.step
), done AS (
  SELECT source, place, max_by(digest, step) AS folded_root FROM fold GROUP BY source, place
), proof AS (
  SELECT source, place, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY source, place
), top AS (
  SELECT digest AS root FROM u WHERE total = 1
)
SELECT p.doc_id, p.leaf, r.subroot, top.root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = top.root AS verified
FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source
  JOIN done d ON p.source IS NOT DISTINCT FROM d.source AND p.place = d.place
  LEFT JOIN proof q ON p.source IS NOT DISTINCT FROM q.source AND p.place = q.place, top
""",
}

"""Queries of this package that SQL can express, for another engine over the same tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP2 = f"""
WITH d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_FOLDED} AS w FROM benchmark),
bw AS (SELECT item, least(13, len(w)) AS m, w, unnest(range(len(w) - least(13, len(w)) + 1)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, m, array_to_string(w[k + 1 : k + m], ' ') AS s FROM bw),
dw AS (SELECT doc_id, w, z.m, unnest(range(len(w) - z.m + 1)) AS k FROM d, (SELECT DISTINCT m FROM win) z WHERE len(w) >= z.m),
hit AS (SELECT doc_id, dw.m, k, item FROM dw JOIN win ON win.m = dw.m AND win.s = array_to_string(w[k + 1 : k + dw.m], ' ')),
pos AS (SELECT DISTINCT doc_id, k + i AS p FROM hit, range(13) r(i) WHERE i < m),
n AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id"""

_OP4 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(len(w) - 12)) AS k FROM d WHERE len(w) >= 13),
f AS (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY array_to_string(w[k + 1 : k + 13], ' ')) AS first FROM g),
gone AS (SELECT DISTINCT doc_id, k + i AS p FROM f, range(13) r(i) WHERE doc_id > first),
word AS (SELECT doc_id, unnest(range(len(w))) AS p, unnest(w) AS x FROM d),
kept AS (SELECT word.doc_id, count(gone.p) AS n_removed, string_agg(x, ' ' ORDER BY word.p) FILTER (gone.p IS NULL) AS t FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""

_OP7 = f"""
WITH s AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '#' || md5(coalesce(text, '')))) AS h FROM documents),
a AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM a),
w AS (SELECT *, CAST([3, 1, 2][(rank - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap FROM r),
l AS (SELECT *, cap / weight AS ratio, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, max(level) FILTER (level <= ratio) OVER () AS final FROM l),
u AS (SELECT source, source_size, CASE WHEN final IS NULL OR ratio < final THEN cap ELSE final * weight END AS target FROM t),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM u)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - whole * source_size
  - coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM s JOIN p ON s.source IS NOT DISTINCT FROM p.source"""


def _escaped(x: str) -> str:
    return rf"regexp_replace(regexp_replace(replace({x}, '\', '\z'), '<(/?s>|</?SYS|\|)', '\\l\1', 'g'), '\[(/?INST\])', '\\s\1', 'g')"


_OP8 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(replace({_escaped("role")}, chr(10), '\\n')) + 1 + length({_escaped("text")}) + 11) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

_VECTORS = """kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


def _round(i: int) -> str:
    """Codebooks i + 1 from codebooks i."""
    return f"""near{i} AS ({_near(i)}),
mean{i} AS (SELECT n.part, n.entry, p.place, CAST(floor(sum(p.x) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS x FROM near{i} n JOIN piece p ON p.vec_id = n.vec_id AND p.part = n.part GROUP BY ALL),
book{i + 1} AS (SELECT b.part, b.entry, b.place, coalesce(m.x, b.x) AS x FROM book{i} b LEFT JOIN mean{i} m ON m.part = b.part AND m.entry = b.entry AND m.place = b.place)"""


def _near(i: int) -> str:
    return f"""SELECT vec_id, part, min_by(entry, d * 64 + entry) AS entry, min(d) AS d
  FROM (SELECT p.vec_id, p.part, b.entry, CAST(sum((p.x - b.x) * (p.x - b.x)) AS BIGINT) AS d FROM piece p JOIN book{i} b ON b.part = p.part AND b.place = p.place GROUP BY ALL) GROUP BY vec_id, part"""


_OP11 = f"""
WITH {_VECTORS},
piece AS (SELECT vec_id, i // (len(v) // 16) AS part, i % (len(v) // 16) AS place, v[i + 1] AS x FROM (SELECT vec_id, v, unnest(range(len(v))) AS i FROM kept)),
seed AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64),
book0 AS (SELECT part, entry, place, x FROM seed JOIN piece ON piece.vec_id = seed.vec_id),
{_round(0)},
{_round(1)},
near2 AS ({_near(2)}),
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY vec_id)
SELECT coded.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) FROM book2) AS codebooks_sha256
FROM coded JOIN kept ON kept.vec_id = coded.vec_id"""

_OP12 = f"""
WITH {_VECTORS},
r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(v AS DOUBLE[]) AS v FROM kept WHERE label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS other, r.label = a.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score FROM r a JOIN r ON r.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, s.other AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) QUALIFY row_number() OVER w <= 10"""

ORACLE_SQL: dict[str, str] = {"op2_decontamination": _OP2, "op4_substrings": _OP4, "op7_mixing": _OP7, "op8_chat": _OP8, "op11_vector_codes": _OP11, "op12_hard_negatives": _OP12}

"""DuckDB SQL for the rows of the queries that SQL can express, written independently of the operators.

Without SQL: the toxicity chain, the token files, XXH64 fingerprints and the SentencePiece merges (and so the pipeline);
the tests hold those against plain code or the libraries themselves.
"""

from __future__ import annotations

from hushline.llm.quality_rules import CUTOFFS, Risk

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SUFFIX_DEDUP = r"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS s FROM d, unnest(range(0, length(h) // 2 - 99)) u(i)),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM w),
m AS (SELECT doc_id, i, lag(i + 100) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM k WHERE r > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN e IS NULL OR i > e THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM m),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, n),
p AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS c FROM s),
t AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""

CONTAMINATION = rf"""WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s FROM items, unnest(range(1, len(w) - least(13, len(w)) + 2)) u(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM words, lengths, unnest(range(1, len(w) - n + 2)) u(i)),
found AS (SELECT doc_id, i, places.n, item FROM places JOIN windows USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(0, n)) u(k) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

_RATES = {
    "symbol_rate": ("n_symbols", "n_words"), "upper_rate": ("up", "word_chars"), "shout_rate": ("shout", "n_words"),
    "dup_line_rate": ("n_dup_lines", "n_lines"), "repeat_rate": ("n_repeat_words", "n_words"),
}


def quality_sql(risk: Risk = Risk()) -> str:
    grid = ", ".join(f"('{r}', {i}, {c})" for r, cuts in CUTOFFS.items() for i, c in enumerate(cuts))
    rates = " UNION ALL ".join(f"SELECT doc_id, lang, base_failed, '{r}' AS rule, 1000 * {a} // greatest({b}, 1) AS score FROM f" for r, (a, b) in _RATES.items())
    share = f"{risk.risk / len(CUTOFFS)!r}e0"
    return rf"""WITH base AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
w3 AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM base, unnest(range(1, len(w) - 1)) u(i)),
c3 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM w3),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM c3, unnest([0, 1, 2]) u(k) WHERE c3.n > 1 GROUP BY doc_id),
f AS (SELECT doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(text, '[^!]', '', 'g')) AS shout, len(l) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  len(w) < {risk.min_words} OR 100 * coalesce(rep.n, 0) > {risk.max_repeat_percent} * len(w) AS base_failed FROM base LEFT JOIN rep USING (doc_id)),
sc AS ({rates}),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
grid(rule, i, cut) AS (VALUES {grid}),
lost AS (SELECT lang, sc.rule, i, cut, count(*) AS n, count(*) FILTER (WHERE score > cut) AS x FROM sc JOIN good USING (doc_id) JOIN grid ON grid.rule = sc.rule WHERE NOT base_failed GROUP BY ALL),
tail AS (SELECT lang, rule, i, cut, (SELECT sum(exp(lgamma(n + 1e0) - lgamma(k + 1e0) - lgamma(n - k + 1e0) + k * ln({share}) + (n - k) * ln(1e0 - {share}))) FROM unnest(range(0, x + 1)) u(k)) AS p FROM lost WHERE n > 0),
ok AS (SELECT *, bool_and(p <= {risk.level!r}e0 / ((SELECT count(DISTINCT lang) FROM lost) * {len(CUTOFFS)})) OVER (PARTITION BY lang, rule ORDER BY i) AS passes FROM tail),
cuts AS (SELECT lang, rule, min(cut) AS cut FROM ok WHERE passes GROUP BY lang, rule),
bad AS (SELECT DISTINCT doc_id FROM sc JOIN cuts USING (lang, rule) WHERE score > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept FROM f LEFT JOIN bad USING (doc_id)"""


SHARDING = """WITH bits AS (SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS (SELECT doc_id, coalesce(source, '') AS source, octet_length(encode(coalesce(text, ''))) + 1 AS size, md5('42:' || doc_id) AS h,
  xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM documents, bits),
f AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 1) / (2e0 * count(*) OVER (PARTITION BY source)) AS part FROM r),
g AS (SELECT *, row_number() OVER (ORDER BY part, source, h, doc_id) - 1 AS place, count(*) OVER () AS n FROM f),
s AS (SELECT *, CAST(place * 16 // n AS INTEGER) AS shard FROM g)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s"""

LINE_DEDUP = r"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, i, array_to_string(lines[i:i + 2], chr(10)) AS s FROM l, unnest(range(1, len(lines) - 1)) u(i)),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM w WHERE regexp_matches(s, '[^ \t\n\x0B\f\r]')),
g AS (SELECT doc_id, list(DISTINCT i + d) AS gone FROM k, unnest([0, 1, 2]) x(d) WHERE r > 1 GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(lines) END AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_filter(lines, lambda x, i: NOT list_contains(gone, i)), chr(10)), '') END AS text
FROM l LEFT JOIN g USING (doc_id)"""

CHAT_TOOLS = """WITH RECURSIVE c AS (SELECT conv_id, turn, role, text, coalesce(length(text), 0) AS size,
    CASE WHEN role = 'assistant' AND (conv_id + turn) % 5 = 0 THEN turn - 2 ELSE turn END AS logged FROM conversations),
u AS (SELECT conv_id, turn FROM c WHERE role = 'user'), a AS (SELECT conv_id, turn FROM c WHERE role = 'assistant'),
n AS (SELECT c.*, CASE WHEN role = 'user' THEN CASE WHEN (conv_id, turn - 1) IN (SELECT * FROM a) THEN turn - 1 WHEN (conv_id, turn - 2) IN (SELECT * FROM u) THEN turn - 2 END
    WHEN role = 'assistant' THEN CASE WHEN (conv_id, turn - 1) IN (SELECT * FROM u) THEN turn - 1 END END AS up FROM c),
o AS (SELECT conv_id, turn, logged AS late, 0 AS depth FROM n WHERE up IS NULL
  UNION ALL SELECT n.conv_id, n.turn, greatest(n.logged, o.late), o.depth + 1 FROM o JOIN n ON n.conv_id = o.conv_id AND n.up = o.turn),
m AS (SELECT n.conv_id, n.logged AS turn, late, depth, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN 'c' || n.turn WHEN 'assistant' THEN 'c' || (n.turn - 1) END AS id,
    CASE role WHEN 'user' THEN CASE WHEN (n.conv_id, n.turn + 1) IN (SELECT * FROM a) THEN 'answered' ELSE 'unanswered' END
      WHEN 'assistant' THEN CASE WHEN (n.conv_id, n.turn - 1) IN (SELECT * FROM u) THEN 'linked' ELSE 'orphan' END END AS status,
    CASE WHEN role = 'user' THEN CASE WHEN n.turn % 11 = 10 THEN 'unknown tool' ELSE concat_ws(';', CASE WHEN size % 7 = 0 THEN 'missing limit' END,
      CASE WHEN text IS NULL THEN 'missing query' END, CASE WHEN size % 7 = 0 THEN 'unexpected depth' END) END END AS errors,
    CASE role WHEN 'user' THEN '{"arguments":{' || concat_ws(',', CASE WHEN size % 7 = 0 THEN '"depth":"' || size || '"' ELSE '"limit":' || size END, '"query":' || to_json(text))
        || '},"id":"c' || n.turn || '","name":"' || CASE WHEN n.turn % 11 = 10 THEN 'other' ELSE 'search' END || '","role":"assistant"}'
      WHEN 'assistant' THEN '{' || coalesce('"content":' || to_json(text) || ',', '') || '"id":"c' || (n.turn - 1) || '","role":"tool"}'
      ELSE '{' || concat_ws(',', '"content":' || to_json(text), '"role":' || to_json(role)) || '}' END AS json
  FROM n JOIN o USING (conv_id, turn))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY late, depth, turn, kind, id, json) - 1 AS position, turn, kind, id, status, errors, json FROM m"""

HARD_NEGATIVES = """WITH c AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM c a JOIN c b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE label <> anchor_label AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

NGRAM_JOIN = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i:i + 2] AS s FROM w, unnest(range(1, greatest(2, len(w) - 1))) u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS low FROM documents UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT doc_id, min(low) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)"""

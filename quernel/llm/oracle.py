"""DuckDB SQL with the rows of the opN_<name> queries that SQL can express."""

from __future__ import annotations

from quernel.llm.decontam import UNITS
from quernel.llm.licenses import PHRASES, template_grams
from quernel.llm.notices import templates
from quernel.llm.text import ASCII_LOWER, ASCII_UPPER

SQL: dict[str, str] = {}

_LOW = f"translate({{}}, '{ASCII_UPPER}', '{ASCII_LOWER}')"
_WORD = r"'[^\x20\x09-\x0D]+'"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL["op1_near_dup"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, {_WORD}) AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
sym AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, sym.y FROM r JOIN sym ON r.reach = sym.x)
SELECT n.doc_id, n.n AS n_shingles, min(reach) AS component_id, min(reach) = n.doc_id AS kept FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n"""

SQL["op2_line_dedup"] = f"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, {_LOW.format(f"trim(line, {_BLANKS})")} AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE owner < doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE owner IS NULL OR owner = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN o USING (key) GROUP BY doc_id"""

_ESCAPE = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"

SQL["op3_chat_format"] = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
o AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role, false) AS joined,
  {_ESCAPE.format('text')} AS safe, replace({_ESCAPE.format('role')}, chr(10), '<|nl|>') AS head FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(safe) + CASE WHEN joined THEN 10 ELSE 12 + length(head) + 1 + 11 END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id"""

SQL["op8_quality"] = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, {_WORD}) AS ws, list_filter(string_split(text, chr(10)), lambda x: trim(x, {_BLANKS}) <> '') AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8)),
m AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
c AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) FROM m) GROUP BY doc_id),
b AS (SELECT doc_id, source, ls, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
x AS (SELECT doc_id, source, {_LOW.format(f"trim(line, {_BLANKS})")} AS key, CAST(len(regexp_extract_all(line, {_WORD})) AS BIGINT) AS n FROM (SELECT doc_id, source, unnest(ls) AS line FROM b)),
h AS (SELECT source, count(*) AS docs FROM d GROUP BY source),
f AS (SELECT x.source, key FROM x JOIN h ON x.source IS NOT DISTINCT FROM h.source GROUP BY x.source, key, h.docs HAVING count(DISTINCT doc_id) >= 20 AND count(DISTINCT doc_id) > 0.1 * h.docs),
r AS (SELECT doc_id, sum(n) AS removed FROM x JOIN f ON x.source IS NOT DISTINCT FROM f.source AND x.key = f.key GROUP BY doc_id),
j AS (SELECT b.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CAST(n_words - coalesce(removed, 0) AS BIGINT) AS n_left_words FROM b LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_left_words, n_left_words < 5 OR n_left_words < 0.2 * n_words AS depleted,
  NOT base_failed AND NOT (n_left_words < 5 OR n_left_words < 0.2 * n_words) AS kept FROM j"""

_UNITS = ", ".join(f"'{u}'" for u in UNITS)
_SPLIT = r"list_filter(string_split_regex({}, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_CANON = rf"list_transform(ws, lambda x: CASE WHEN x < ':' THEN '<number>' WHEN lower(x) IN ({_UNITS}) AND (regexp_matches(x, '^\p{{Lu}}\p{{Ll}}') OR x >= '[' AND x <= '{{{{') THEN '<unit>' WHEN regexp_matches(x, '^\p{{Lu}}\p{{Ll}}') THEN '<name>' ELSE lower(x) END)".replace("{{", "{")

SQL["op6_decontaminate"] = f"""
WITH b AS (SELECT item_id, ws, {_CANON} AS cs FROM (SELECT item_id, {_SPLIT.format("coalesce(text, '')")} AS ws FROM benchmark) WHERE len(ws) >= 5),
d AS (SELECT doc_id, ws, {_CANON} AS cs FROM (SELECT doc_id, {_SPLIT.format("coalesce(text, '')")} AS ws FROM documents)),
v AS (SELECT item_id, ws, cs, least(len(ws), 8) AS size, greatest(len(ws) - 7, 1) AS total, unnest(range(1, greatest(len(ws) - 7, 1) + 1)) AS i FROM b),
bw AS (SELECT item_id, i, size, total, false AS template, list_transform(ws[i:i + size - 1], lambda x: lower(x)) AS win, ws[i:i + size - 1] AS vals FROM v
  UNION ALL SELECT item_id, i, size, total, true, cs[i:i + size - 1], ws[i:i + size - 1] FROM v WHERE total > 1 AND len(list_filter(cs[i:i + size - 1], lambda x: x[1] <> '<')) >= 3),
z AS (SELECT DISTINCT size FROM bw),
u AS (SELECT doc_id, ws, cs, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, z WHERE len(ws) >= size),
dw AS (SELECT doc_id, i, size, false AS template, list_transform(ws[i:i + size - 1], lambda x: lower(x)) AS win, ws[i:i + size - 1] AS vals FROM u
  UNION ALL SELECT doc_id, i, size, true, cs[i:i + size - 1], ws[i:i + size - 1] FROM u),
m AS (SELECT doc_id, item_id, total, bw.size, bw.template, dw.i - bw.i AS diagonal, bw.i AS place, dw.i AS at, dw.win AS win, bw.vals AS bv, dw.vals AS dv FROM dw JOIN bw ON dw.size = bw.size AND dw.template = bw.template AND dw.win = bw.win),
p AS (SELECT DISTINCT doc_id, item_id, size, diagonal, place, win[k][1:2] || lower(bv[k]) AS x, win[k][1:2] || lower(dv[k]) AS y FROM (SELECT *, unnest(range(1, size + 1)) AS k FROM m WHERE template) WHERE win[k][1] = '<'),
n AS (SELECT doc_id, item_id, size, diagonal, x, y, count(*) AS n FROM p GROUP BY ALL),
c AS (SELECT doc_id, item_id, size, diagonal, x, y FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, size, diagonal, x ORDER BY n DESC, y DESC) = 1),
w AS (SELECT DISTINCT doc_id, item_id, size, diagonal, place FROM p ANTI JOIN c USING (doc_id, item_id, size, diagonal, x, y)),
g AS (SELECT doc_id, item_id, total, size, diagonal, place, bool_or(NOT template) AS same FROM m WHERE NOT template OR NOT EXISTS (SELECT 1 FROM w WHERE w.doc_id = m.doc_id AND w.item_id = m.item_id AND w.size = m.size AND w.diagonal = m.diagonal AND w.place = m.place) GROUP BY ALL),
r AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id, item_id, size, diagonal ORDER BY place) AS run FROM g),
l AS (SELECT doc_id, item_id, total, size, diagonal, run, count(*) AS n, bool_and(same) AS same, list(place) AS places FROM r GROUP BY ALL),
a AS (SELECT doc_id, item_id, total, size, diagonal, max(n) AS longest, sum(n) AS hits, bool_and(same) AS same, flatten(list(places)) AS places FROM l GROUP BY ALL)
SELECT doc_id, item_id, len(list_distinct(flatten(list(places)))) / total AS share, CAST(max(longest + size - 1) AS BIGINT) AS run_words, max(struct_pack(n := hits, v := same)).v AS verbatim FROM a
GROUP BY doc_id, item_id, total HAVING len(list_distinct(flatten(list(places)))) / total >= 0.5 OR max(longest + size - 1) >= 13"""

_GRAMS = ", ".join(f"({t}, '{label}', {p}, {n}, {lo}, {hi}, '{' '.join(gram)}')" for t, label, p, n, lo, hi, gram in template_grams(templates(), 3))
_PLACE = " OR ".join("(" + " AND ".join(f"ws[i + {j}] = '{w}'" for j, w in enumerate(phrase)) + ")" for phrase in PHRASES)
_LABEL = " ".join("WHEN " + " AND ".join(f"ws[i + {j}] = '{w}'" for j, w in enumerate(phrase)) + f" THEN '{label}'" for phrase, label in PHRASES.items())

SQL["op9_licenses"] = f"""
WITH t(t, label, t_pos, t_words, need_lo, need_hi, gram) AS (VALUES {_GRAMS}),
d AS (SELECT doc_id, list_transform({_SPLIT.format("coalesce(text, '')")}, lambda x: lower(x)) AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
p AS (SELECT doc_id, i - 1 AS start, CASE {_LABEL} END AS label FROM i WHERE {_PLACE}),
b AS (SELECT doc_id, count(*) AS n_base, CAST(min(start) AS BIGINT) AS first_word, CAST(max(start) AS BIGINT) AS last_word, list(DISTINCT label) AS labels FROM p GROUP BY doc_id),
h AS (SELECT doc_id, t, label, t_words, need_lo, need_hi, t_pos, i - 1 AS pos, i - 1 - t_pos AS diagonal FROM i JOIN t ON gram = ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]),
v AS (SELECT doc_id, t, label, t_words, need_lo, need_hi, diagonal, list(DISTINCT t_pos) AS found, min(pos) AS lo, max(pos) + 3 AS hi FROM h GROUP BY ALL),
o AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, t ORDER BY diagonal) <= 4 THEN 0 ELSE 1 END AS opens FROM v),
s AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, t ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM o),
g AS (SELECT doc_id, t, label, t_words, need_lo, need_hi, span, min(lo) AS lo, max(hi) AS hi, list_distinct(flatten(list(found))) AS found FROM s GROUP BY doc_id, t, label, t_words, need_lo, need_hi, span),
c AS (SELECT *, len(list_distinct(flatten(list_transform(found, lambda p: [p, p + 1, p + 2])))) AS covered FROM g),
m AS (SELECT *, len(found) / (t_words - 2) AS share FROM c WHERE len(found) / (t_words - 2) >= 0.6 AND 2 * (hi - lo) <= 3 * t_words + 8 AND len(list_filter(found, lambda p: p BETWEEN need_lo AND need_hi)) = need_hi - need_lo + 1),
y AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.doc_id = m.doc_id AND b.label <> m.label AND b.lo < m.hi AND m.lo < b.hi
  AND (b.covered > m.covered OR (b.covered = m.covered AND (b.share > m.share OR (b.share = m.share AND b.label < m.label)))))),
x AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM y GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(x.labels, [])))), ',') AS labels,
  greatest(CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END, coalesce(share, 0.0))::DOUBLE AS score
FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN x ON x.doc_id = d.doc_id"""

SQL["op12_source_divergence"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
t AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN t USING (lang, term) GROUP BY ALL),
f AS (SELECT lang, source, term, coalesce(c.n, 0) AS n FROM g JOIN t USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT *, 1 + 1000000000 * (n + 5)::HUGEINT // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM f),
l AS (SELECT lang, term, sum(n) AS n FROM f GROUP BY ALL),
q AS (SELECT lang, term, 1 + 1000000000 * (n + 5)::HUGEINT // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM l),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM y)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM z WHERE part = 'pair' OR rank <= 50"""

SQL["op13_prefix_trie"] = """
WITH z AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS z FROM range(256) r(i)),
o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS idx, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
e AS (SELECT c, c - c % 5 AS b, xor(4294967295, list_reduce(list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda j: ascii(CAST(c AS VARCHAR)[j])::BIGINT), lambda x, y: xor(z[(xor(x, y) & 255) + 1], x >> 8), 4294967295)) % 9 AS h FROM (SELECT DISTINCT c FROM o), z),
r AS (SELECT e.c, idx, role, text FROM o JOIN e ON o.c = e.b AND idx <= h UNION ALL SELECT o.c, idx, role, text FROM o JOIN e ON o.c = e.c WHERE idx > h),
l AS (SELECT e.c, coalesce(list({'role': role, 'text': text} ORDER BY idx) FILTER (WHERE idx IS NOT NULL), []) AS turns FROM e LEFT JOIN r ON r.c = e.c GROUP BY e.c),
m AS (SELECT c, len(turns) AS n, d, turns[1:d] AS said FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM l)),
a AS (SELECT c, n, d, min(c) OVER (PARTITION BY d, said) AS id, CASE WHEN d > 0 THEN strlen(said[d].text) ELSE 0 END AS size FROM m),
v AS (SELECT id, d, count(*) AS n_convs, any_value(size) AS size, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends FROM a GROUP BY id, d),
p AS (SELECT v.*, a.id AS parent FROM v LEFT JOIN a ON a.c = v.id AND a.d = v.d - 1),
k AS (SELECT parent AS id, d - 1 AS d, count(*) AS n FROM p WHERE d > 0 GROUP BY ALL),
w AS (SELECT p.*, coalesce(k.n, 0) AS n_children FROM p LEFT JOIN k ON k.id = p.id AND k.d = p.d),
t AS (SELECT a.id, a.d, count(*) FILTER (WHERE w.n_children = 0) AS leaves, sum((w.n_convs - 1) * w.size) AS saved FROM w JOIN a ON a.c = w.id AND a.d <= w.d GROUP BY a.id, a.d)
SELECT w.id AS conv_id, w.d AS depth, parent AS parent_conv_id, n_convs, n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256 FROM w JOIN t ON t.id = w.id AND t.d = w.d"""

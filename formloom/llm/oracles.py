"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

import string

from . import divergence as D
from .topk_search import OP2_SQL

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _op1() -> str:
    vocabulary = sorted({w for ws in D.COMMON_WORDS.values() for w in ws})
    n_p, n_q = len(D.CLASSES), len(vocabulary) + 1
    langs = ", ".join(f"'{x}'" for x in D.COMMON_WORDS)
    in_vocab = ", ".join(f"'{w}'" for w in vocabulary)
    commons = ", ".join(f"len(list_filter(w, lambda x: x = '{w}'))::DOUBLE" for w in vocabulary)
    share = lambda a: f"list_transform({a}, lambda x: CASE WHEN list_sum({a}) > 0 THEN x / list_sum({a}) ELSE 0.0::DOUBLE END)"
    term = "CASE WHEN {0} > 0 THEN {0} * log2({0} / ((x[1] + x[2]) / 2)) ELSE 0.0 END"
    jsd = lambda p, q: f"sqrt(greatest(0.0, list_sum(list_transform(list_zip({p}, {q}), lambda x: ({term.format('x[1]')} + {term.format('x[2]')}) / 2))))"
    means = lambda c, n: "[" + ", ".join(f"avg({c}[{k}])" for k in range(1, n + 1)) + "]"
    rest = lambda a, b: f"(length({a}) - length({b}))::DOUBLE"
    return rf"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
r1 AS (SELECT *, {_WORDS.format('t')} AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls, regexp_replace(t, '[a-z]', '', 'g') AS a FROM d),
r2 AS (SELECT *, regexp_replace(a, '[\x20\x09-\x0D]', '', 'g') AS b FROM r1), r3 AS (SELECT *, regexp_replace(b, '[#*$%&|<>]', '', 'g') AS c FROM r2), r4 AS (SELECT *, regexp_replace(c, '[A-Z]', '', 'g') AS e FROM r3),
r5 AS (SELECT *, regexp_replace(e, '[0-9]', '', 'g') AS f FROM r4), r6 AS (SELECT *, regexp_replace(f, '[.,;:!?''"()\-]', '', 'g') AS g FROM r5), r7 AS (SELECT *, regexp_replace(g, '[^\x00-\x7F]', '', 'g') AS h FROM r6),
gr AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM r1 WHERE len(w) > 3)),
gc AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM gr),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM gc WHERE n > 1) GROUP BY 1),
x AS (SELECT doc_id, lang, length(t) AS nc, len(w)::BIGINT AS n_words, (length(t) - length(a) + length(b))::BIGINT AS word_chars, (length(b) - length(c))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words, [{rest('t', 'a')}, {rest('c', 'e')}, {rest('e', 'f')}, {rest('a', 'b')}, {rest('f', 'g')}, {rest('b', 'c')}, {rest('g', 'h')}, length(h)::DOUBLE] AS cs,
  [{commons}, len(list_filter(w, lambda x: x NOT IN ({in_vocab})))::DOUBLE] AS ws FROM r7 LEFT JOIN cov USING (doc_id)),
y AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {share('cs')} AS p, {share('ws')} AS q FROM x),
ref AS (SELECT lang AS rl, {means('p', n_p)} AS rp, {means('q', n_q)} AS rq FROM y WHERE lang IN ({langs}) AND NOT base_failed AND n_words >= {D.MIN_WORDS} AND nc >= {D.MIN_CHARS} GROUP BY 1),
z AS (SELECT y.*, {jsd('p', 'rp')} AS dc, {jsd('q', 'rq')} AS dw FROM y LEFT JOIN ref ON true),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dc + dw, dc, dw) AS k FROM z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (nc < {D.MIN_CHARS} OR dc IS NULL OR dc <= {D.MAX_CHAR_DISTANCE} + {D.SHORT} / sqrt(nc)) AND (n_words < {D.MIN_WORDS} OR dw IS NULL OR dw <= {D.MAX_WORD_DISTANCE}) AS kept FROM k WHERE k = 1"""


_ESC = "replace(replace(replace({}, '\\', '\\b'), '#', '\\h'), '<', '\\l')"
OP5_SQL = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, '### ' || replace({_ESC.format('role')}, ':', '\c') || ': ' || {_ESC.format('text')} || '</turn>' || chr(10) AS line FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length(line))::BIGINT AS formatted_chars FROM e GROUP BY 1"""

OP5B_SQL = rf"""WITH c AS (SELECT conv_id // 4 AS tree, conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
e AS (SELECT *, min(conv_id) OVER (PARTITION BY tree) AS f0, length(text) % 7 AS s, length('### ' || replace({_ESC.format('role')}, ':', '\c') || ': ' || {_ESC.format('text')} || '</turn>' || chr(10)) AS n FROM c),
r AS (SELECT tree, s, n, conv_id FROM e WHERE conv_id = f0 AND i = 1),
b AS (SELECT e.tree, e.conv_id, e.conv_id * 1000000 + max(e.i) AS leaf, sum(e.s) + CASE WHEN e.conv_id = any_value(f0) THEN 0 ELSE any_value(r.s) END AS path_score, count(*) + (e.conv_id <> any_value(f0))::INTEGER AS n_turns, sum(e.n) + CASE WHEN e.conv_id = any_value(f0) THEN 0 ELSE any_value(r.n) END AS formatted_chars,
  e.conv_id = any_value(f0) AND count(*) = 1 AS bare FROM e JOIN r USING (tree) GROUP BY e.tree, e.conv_id),
k AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY path_score DESC, leaf) AS k FROM b WHERE NOT bare OR tree NOT IN (SELECT tree FROM e WHERE conv_id <> f0))
SELECT tree, leaf, path_score::DOUBLE AS path_score, n_turns::BIGINT AS n_turns, formatted_chars::BIGINT AS formatted_chars FROM k WHERE k <= 2"""

OP8_SQL = rf"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS seen FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.seen = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(seen) AS component_id, s.doc_id = min(seen) AS kept FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, s.s"""

OP10_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS g FROM (SELECT doc_id, h, unnest(generate_series(1, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
m AS (SELECT md5(g) AS k, min(doc_id) AS first FROM w GROUP BY 1),
c AS (SELECT w.doc_id, w.i FROM w JOIN m ON md5(g) = k WHERE w.doc_id > first),
n AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER o + 50 OR lag(i) OVER o IS NULL THEN 1 ELSE 0 END AS new FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
q AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 49 AS b FROM q GROUP BY 1, 2),
g AS (SELECT doc_id, run, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before, lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS final FROM s),
k AS (SELECT d.doc_id, h, sum(b - a + 1) AS removed, count(run) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before - 1)) || CASE WHEN final THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept FROM d LEFT JOIN g USING (doc_id) GROUP BY 1, 2)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, spans::BIGINT AS n_spans, sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE kept END)) AS kept_sha256 FROM k"""

ORACLE_SQL = {"op1_divergence_rules": _op1(), "op2_nra_topk": OP2_SQL, "op5_reply_trees": OP5_SQL, "op5b_ranked_branches": OP5B_SQL, "op8_bbit_minhash": OP8_SQL, "op10_lpf_dedup": OP10_SQL}

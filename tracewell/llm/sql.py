"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from tracewell.llm.hostrules import BASE_RULES, MOST_PRIOR, RULES
from tracewell.llm.licenses import LOWER, PHRASES, TEMPLATES, UPPER, reach_of

_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_SMALL = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_SMALL)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""


def op2(least: float = 0.2, times: float = 2.0, deviations: float = 3.0) -> str:
    rules = ", ".join(f"({v}) AS f_{k}" for k, v in RULES.items())
    counts = ", ".join(f"sum(CASE WHEN f_{k} THEN 1 ELSE 0 END)::DOUBLE AS {k}" for k in RULES)
    others = ", ".join(f"sum({k}) OVER () - {k} AS k_{k}, sum({k} * {k} / n) OVER () - {k} * {k} / n AS q_{k}" for k in RULES)
    means = ", ".join(f"k_{k} / nullif(o, 0) AS m_{k}, q_{k} / nullif(o, 0) AS s_{k}" for k in RULES)
    beyond = ", ".join(f"s_{k} - m_{k} * m_{k} - m_{k} * (1 - m_{k}) * hosts / nullif(o, 0) AS v_{k}" for k in RULES)
    priors = ", ".join(f"CASE WHEN v_{k} > 0 THEN least({MOST_PRIOR}, greatest(1.0, m_{k} * (1 - m_{k}) / v_{k} - 1)) ELSE {MOST_PRIOR} END AS p_{k}" for k in RULES)
    bars = " OR ".join(f"coalesce(({k} + m_{k} * p_{k}) / (n + p_{k}) > greatest({least}, {times} * m_{k}, m_{k} + {deviations} * sqrt(m_{k} * (1 - m_{k}) / (p_{k} + 1))), false)" for k in RULES)
    failed = " OR ".join(f"f_{k}" for k in BASE_RULES)
    return rf"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT *, unnest(range(1, len(ws) - 1)) AS i FROM t)),
d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS k FROM g) WHERE k > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM d, range(3) r(o) GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
b AS (SELECT doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(ls) AS n_lines,
      len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM t JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
f AS (SELECT *, {rules} FROM b),
h AS (SELECT source, count(*) AS n, {counts} FROM f GROUP BY 1),
a AS (SELECT *, sum(n) OVER () - n AS o, count(*) OVER () - 1 AS hosts, {others} FROM h),
m AS (SELECT *, {means} FROM a),
v AS (SELECT *, {beyond} FROM m),
p AS (SELECT *, {priors} FROM v),
j AS (SELECT source, {bars} AS rejected FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, NOT ({failed}) AND NOT rejected AS kept
FROM f JOIN j ON f.source IS NOT DISTINCT FROM j.source"""


OP3 = f"""
WITH t AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS gram FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS i FROM t)),
d AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY gram) AS first FROM g) WHERE first < doc_id),
p AS (SELECT doc_id, list(DISTINCT i + o) AS gone FROM d, range(50) r(o) GROUP BY 1),
k AS (SELECT doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed, ws, coalesce(gone, []) AS gone FROM t LEFT JOIN p USING (doc_id)),
m AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM t) u
      WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = u.doc_id AND u.i BETWEEN d.i AND d.i + 49) GROUP BY 1)
SELECT doc_id, n_words, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN m USING (doc_id)"""

OP9 = r"""
WITH t AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('7|' || doc_id) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight FROM t GROUP BY 1),
b AS (SELECT *, 2 * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source) - 1 AS k, sum(cap) OVER (ORDER BY cap / weight, source) - cap AS held, sum(weight) OVER () - sum(weight) OVER (ORDER BY cap / weight, source) + weight AS free FROM b),
q AS (SELECT *, (total - held) / free AS level FROM o),
v AS (SELECT min_by(level, k) AS level FROM q WHERE weight * level <= cap),
a AS (SELECT source, source_size, CASE WHEN v.level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, weight * v.level) END AS target FROM b, v),
w AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM a),
r AS (SELECT t.*, source_size, target, whole, CAST(floor(target) AS BIGINT) - whole * source_size AS rest,
      sum(size) OVER (PARTITION BY t.source ORDER BY place, doc_id) - size AS before FROM t JOIN w ON t.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + least(size, greatest(0, rest - before)) AS BIGINT) AS taken FROM r"""


def op10(threshold: float = 0.9) -> str:
    between = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(f"('{label}', list_distinct(string_split('{t}', ' ')), {reach_of(len(set(t.split())))})" for label, t in TEMPLATES.items())
    return f"""
WITH t AS (SELECT doc_id, {_SMALL} AS small FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(small, '{between}'), lambda x: x <> '') AS ws FROM t),
p(phrase, label) AS (VALUES {phrases}),
i AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
h AS (SELECT doc_id, label, i - 1 AS place FROM i JOIN p ON word = string_split(phrase, ' ')[1] JOIN w USING (doc_id) WHERE ws[i : i + len(string_split(phrase, ' ')) - 1] = string_split(phrase, ' ')),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM h GROUP BY 1),
m(label, words, reach) AS (VALUES {templates}),
s AS (SELECT doc_id, ws, reach, unnest(range(0, len(ws), reach)) AS start FROM w, (SELECT DISTINCT reach FROM m)),
f AS (SELECT doc_id, label, len(list_intersect(words, list_slice(ws, start + 1, start + 2 * reach))) / len(words) AS share FROM s JOIN m USING (reach)),
g AS (SELECT doc_id, list(DISTINCT label) AS more, max(share) AS best FROM f WHERE share >= {threshold} - 1e-9 GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(labels), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(more, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0) END::DOUBLE AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN g USING (doc_id)"""


SQL = {"op1_minhash": OP1, "op2_rules": op2(), "op3_substring": OP3, "op9_mixing": OP9, "op10_licenses": op10()}

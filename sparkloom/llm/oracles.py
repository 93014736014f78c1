"""The operators' results in DuckDB SQL, where it can express them: plain statements of each contract, by other ways."""

from __future__ import annotations

from sparkloom.llm import compression, divergence, rules
from sparkloom.llm.urls import CONFIDENCE, GIVEN, LEAST, LIFT, SUPPORT

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MIXING = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 9))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(i - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, cap / weight) FROM l WHERE level * weight < cap) * weight, cap)) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t),
r AS (SELECT *, target - passes * source_size AS rest FROM p),
b AS (SELECT source, h, sum(size)::BIGINT AS words FROM d GROUP BY source, h),
c AS (SELECT source, h, words, sum(words) OVER (PARTITION BY source ORDER BY h)::BIGINT - words AS before FROM b),
e AS (SELECT r.*, max(c.h) AS edge, arg_max(c.before, c.h) AS below, arg_max(c.words, c.h) AS words
    FROM r JOIN c ON c.source IS NOT DISTINCT FROM r.source AND c.before <= r.rest GROUP BY ALL),
cut AS (SELECT *, edge + (abs(below + words - rest) < abs(below - rest))::INT AS threshold FROM e)
SELECT d.doc_id, d.size::BIGINT AS size, source_size, target, (d.size * (passes + (d.h < threshold)::INT))::BIGINT AS taken
FROM d JOIN cut ON cut.source IS NOT DISTINCT FROM d.source
"""

SUBSTRINGS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT r, doc_id, x, len(x) // 2 AS n_bytes FROM d),
c AS (SELECT r, b, n_bytes, substr(x, 2 * b + 1, 656) AS y FROM (SELECT r, x, n_bytes, unnest(range(0, n_bytes - 199, 128)) AS b FROM n)),
w AS (SELECT r, b + j AS i, md5(substr(y, 2 * j + 1, 400)) AS m FROM (SELECT r, b, y, unnest(range(0, least(128, n_bytes - 199 - b))) AS j FROM c)),
t AS (SELECT r, i FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, (i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) + 200)::INT AS new FROM t)),
s AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, g),
k AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS z FROM s),
o AS (SELECT k.r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept
    FROM k JOIN n ON n.r = k.r GROUP BY k.r)
SELECT doc_id, n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM n LEFT JOIN o ON o.r = n.r
"""

NEARDUP = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
    HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
c AS (WITH RECURSIVE c(a, b) AS (SELECT a, b FROM p UNION SELECT c.a, p.b FROM c JOIN p ON c.b = p.a) SELECT a, min(b) AS m FROM c GROUP BY a)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id, least(s.doc_id, coalesce(m, s.doc_id)) = s.doc_id AS kept
FROM s LEFT JOIN c ON c.a = s.doc_id
"""

_WORDS = rf"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
m AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(len(w), 10) AS n FROM b WHERE len(w) > 0))),
q AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM m) WHERE len(w) >= n)),
h AS (SELECT q.r, q.i, q.n, m.item FROM q JOIN m ON q.n = m.n AND q.x = m.x),
n AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN t ON t.r = d.r
"""

_CONTROL = r"\|[A-Za-z_]{1,40}(?::[0-9]{1,9})?\|>|/?s>|/?INST\]|/?SYS>>|start_of_turn>|end_of_turn>|pad>|unk>|bos>|eos>"


def _escaped(column: str) -> str:
    return rf"regexp_replace({column}, '([<\[])(\\*)({_CONTROL})', '\1\\\2\3', 'g')"


CHAT = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
f AS (SELECT *, len('<|im_start|>') + len(replace(replace({_escaped("role")}, '\', '\\'), chr(10), '\n')) + 1 + len({_escaped("text")}) + len('<|im_end|>') + 1 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(n)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in GIVEN)
#: All sets of a labelled URL's tokens are counted, so this is for small tables only.
URLS = rf"""
WITH u AS (SELECT page_id, url, instr(url, '://') > 0 AS ok, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
l AS (SELECT *, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS folders FROM h),
t AS (SELECT page_id, host, path, CASE WHEN ok THEN list_sort(list_distinct(list_filter(list_concat(
    list_transform(range(1, len(labels) + 1), lambda i: 'h:' || array_to_string(labels[i:], '.')),
    list_transform(range(1, len(folders) + 1), lambda i: 'p' || (i - 1) || ':' || regexp_replace(folders[i], '[0-9]+', '0', 'g')),
    list_transform(regexp_extract_all(regexp_extract(url, '\?([^#]*)', 1, 's'), '(?:^|&)([^=&]+)', 1), lambda x: 'q:' || x),
    ['e:' || regexp_extract(path, '\.([A-Za-z0-9]{{1,8}})$', 1)], CASE WHEN instr(url, '#') > 0 THEN ['f:'] ELSE [] END), lambda x: x NOT IN ('e:', 'h:')))) ELSE [] END AS tokens FROM l),
m AS (SELECT doc_id, min(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id),
y AS (SELECT row_number() OVER () AS r, tokens, coalesce(q, 1) = 0 OR coalesce(m.t, 0) = 1 AS bad FROM t JOIN m ON m.doc_id = t.page_id JOIN pages USING (page_id) WHERE url IS NOT NULL),
z AS (SELECT list_filter(tokens, lambda x, i: (b >> (i - 1)) & 1 = 1) AS s, bad FROM (SELECT tokens, bad, unnest(range(1, 1 << len(tokens))) AS b FROM y)),
k AS (SELECT s, count(*) FILTER (bad) AS n_bad, count(*) AS n FROM z GROUP BY s),
a AS (SELECT s, n_bad / n AS c FROM k WHERE n_bad >= greatest({LEAST}, {SUPPORT} * (SELECT count(*) FROM y)) AND n_bad / n >= {CONFIDENCE}
    AND n_bad / n >= {LIFT} * (SELECT count(*) FILTER (bad) / count(*) FROM y)),
v AS (SELECT s, c FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE len(b.s) < len(a.s) AND list_has_all(a.s, b.s) AND b.c >= a.c)),
f AS (SELECT page_id, arg_max(v.s, struct_pack(c := v.c, s := v.s)) AS mined FROM t JOIN v ON list_has_all(t.tokens, v.s) GROUP BY page_id),
g AS (SELECT page_id, arg_max(rh || rp, len(rh || rp)) AS rule, arg_max(verdict, len(rh || rp)) AS verdict FROM t JOIN (VALUES {_RULES}) r(rh, rp, verdict)
    ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT t.page_id, host, path, rule, coalesce(verdict, CASE WHEN mined IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, array_to_string(mined, ' ') AS mined_rule
FROM t LEFT JOIN f ON f.page_id = t.page_id LEFT JOIN g ON g.page_id = t.page_id
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id, url NULLS FIRST) AS i,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
h AS (SELECT *, octet_length(encode(body)) AS n, sha1(body) AS x FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, 5 * (j // 4) + 1, 5))::BIGINT >> (15 - 5 * (j % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
    CASE WHEN i = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN i > 1 THEN first END AS refers_to
FROM h
"""

DIVERGENCE = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT lang, source, term, count(*) AS uses FROM (SELECT lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= {divergence.LEAST_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, coalesce(uses, 0) AS uses FROM g JOIN k ON k.lang = g.lang LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
p AS (SELECT *, 1 + ({divergence.SCALE}::HUGEINT * (uses + 1)) // (sum(uses) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM c),
l AS (SELECT lang, term, sum(uses) AS uses FROM c GROUP BY lang, term),
q AS (SELECT lang, term, 1 + ({divergence.SCALE}::HUGEINT * (uses + 1)) // (sum(uses) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM l),
v AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
    UNION ALL SELECT p.lang, p.source, 'term', p.term, (p - q) * (p - q) // q FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE uses > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= {divergence.TERM_RANKS}
"""


def _compression(parts: int, entries: int, rounds: int, scale: int) -> str:
    """Every round is two steps of the statement: a<i> assigns, b<i> moves the entries."""
    far = "list_sum(list_transform(range(1, w + 1), lambda i: (y[i] - c[i]) * (y[i] - c[i])))"
    steps = [
        f"e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, len(embedding) // {parts} AS w, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v"
        " FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT r, w, part, v[part * w + 1:(part + 1) * w] AS y FROM e, range({parts}) t(part))",
        f"b0 AS MATERIALIZED (SELECT part, r - 1 AS j, y AS c FROM x WHERE r <= {entries})",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, x.part, any_value(y) AS y, min(struct_pack(d := {far}, j := j)) AS m FROM x JOIN b{i} ON x.part = b{i}.part GROUP BY r, x.part)")
        if i < rounds:
            mean = "(s - ((s % n) + n) % n) // n"
            steps.append(f"s{i} AS (SELECT part, j, pos, sum(z) AS s, count(*) AS n FROM (SELECT part, m.j AS j, unnest(y) AS z, generate_subscripts(y, 1) AS pos FROM a{i}) GROUP BY ALL)")
            steps.append(f"m{i} AS (SELECT part, j, list(({mean})::BIGINT ORDER BY pos) AS c FROM s{i} GROUP BY part, j)")
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b{i}.part, b{i}.j, coalesce(m{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN m{i} ON m{i}.part = b{i}.part AND m{i}.j = b{i}.j)")
    return (
        "WITH " + ",\n".join(steps) + f""",
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, j)) AS codebooks_sha256 FROM b{rounds}),
o AS (SELECT r, string_agg(printf('%02x', m.j), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN o ON o.r = e.r, h
"""
    )


COMPRESSION = _compression(compression.PARTS, compression.ENTRIES, compression.ROUNDS, compression.SCALE)

_STOP_WORDS = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)
QUALITY_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
u AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT r, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS x FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
t AS (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM g WHERE x IS NOT NULL),
p AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM t WHERE n > 1) GROUP BY r),
s AS (SELECT r, count(*) AS n FROM u WHERE lower(x) IN ({_STOP_WORDS}) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '{rules.SYMBOLS}'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipsis_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]')))::BIGINT AS n_bullet_lines, coalesce(s.n, 0)::BIGINT AS n_stop_words,
    coalesce(p.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN p ON p.r = w.r LEFT JOIN s ON s.r = w.r)
SELECT *, {" OR ".join(r.fails() for r in rules.RULES if r.base)} AS base_failed, NOT ({" OR ".join(r.fails() for r in rules.RULES)}) AS kept FROM m
"""

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": MIXING,
    "op2_substrings": SUBSTRINGS,
    "op4_neardup": NEARDUP,
    "op7_decontamination": DECONTAMINATION,
    "op8_chat": CHAT,
    "op9_urls": URLS,
    "op10_warc": WARC,
    "op11_divergence": DIVERGENCE,
    "op12_compression": COMPRESSION,
    "op13_quality_rules": QUALITY_RULES,
}

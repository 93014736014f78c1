"""Filters, joins, aggregates, windows and set operations over code and document collections (groups B to E).

Stand-ins: documents are files or chunks (source is the repository, lang the language), embeddings their vectors,
orders jobs (status, priority), events a change feed, lineitem parts an edge table, labels marks on documents.
"""

from __future__ import annotations

from sparkloom.registry import shared

# -- predicates ------------------------------------------------------------------------------------------------------
shared("B1_ilike_substring", "SELECT doc_id, source FROM {documents} WHERE text ILIKE '%tion_with%' OR text ILIKE '%license%'")
shared("B2_regex_ignorecase", "SELECT doc_id, lang FROM {documents} WHERE RX(text, '(?i)(^|[^a-z])(license|copyright|token|login)([^a-z]|$)')")
shared("B3_like_path", "SELECT page_id, url FROM {pages} WHERE url LIKE 'https://%' AND (url LIKE '%.html' OR url LIKE '%/en/%') AND url NOT LIKE '%utm!_source%' ESCAPE '!'")
shared("B4_membership", "SELECT doc_id, source FROM {documents} WHERE source IN ('src1', 'src3', 'src5')")
shared(
    "B5_array_overlap",
    "SELECT doc_id FROM (SELECT doc_id, array_agg(DISTINCT k) AS tags FROM (SELECT doc_id, lang AS k FROM {documents} UNION ALL SELECT doc_id, source AS k FROM {documents}) t GROUP BY doc_id) g WHERE arrays_overlap(tags, array('de', 'src7'))",
    "SELECT doc_id FROM (SELECT doc_id, array_agg(DISTINCT k) AS tags FROM (SELECT doc_id, lang AS k FROM documents UNION ALL SELECT doc_id, source AS k FROM documents) t GROUP BY doc_id) g WHERE list_has_any(tags, ['de', 'src7'])",
)
_TAGS = "SELECT doc_id, lang AS tag FROM {documents} UNION SELECT doc_id, 'toxic' AS tag FROM {labels} WHERE toxic = 1 UNION SELECT doc_id, 'good' AS tag FROM {labels} WHERE quality = 1"
shared("B6_tags_all", f"SELECT doc_id FROM ({_TAGS}) t WHERE tag IN ('en', 'good') GROUP BY doc_id HAVING count(DISTINCT tag) = 2")
shared("B6_tags_any", f"SELECT DISTINCT doc_id FROM ({_TAGS}) t WHERE tag IN ('toxic', 'fr')")
shared(
    "B7_require_text_match",
    "SELECT doc_id FROM {documents} WHERE exists(filter(split('Shall tion zz', '[ ]+'), t -> t <> ''), t -> contains(lower(text), lower(t)))",
    "SELECT doc_id FROM documents WHERE len(list_filter(string_split('Shall tion zz', ' '), lambda t: t <> '' AND contains(lower(text), lower(t)))) > 0",
)
shared("B8_optional_filter", "SELECT doc_id, lang FROM {documents} WHERE (CAST(NULL AS VARCHAR(9)) IS NULL OR lang = CAST(NULL AS VARCHAR(9))) AND ('src2' IS NULL OR source = 'src2')")
shared("B10_validity_filter", "SELECT d.doc_id, l.quality FROM {documents} d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM {labels} GROUP BY doc_id) l ON d.doc_id = l.doc_id WHERE l.quality IS NULL OR l.quality >= 1")
shared("B11_status_case", "SELECT doc_id, CASE WHEN n_chars % 101 >= 70 THEN 'valid' WHEN n_chars % 101 >= 50 THEN 'warning' ELSE 'stale' END AS status FROM {documents}")
shared("B12_severity_order", "SELECT o_orderkey, o_orderpriority FROM {orders} ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END, o_orderkey LIMIT 50")
shared("B13_excerpt", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS excerpt FROM {documents}")
shared(
    "B13_first_lines",
    "SELECT doc_id, substring(array_join(slice(split(text, '\n'), 1, 5), '\n'), 1, 500) AS head FROM {documents}",
    "SELECT doc_id, substring(array_to_string(list_slice(string_split(text, chr(10)), 1, 5), chr(10)), 1, 500) AS head FROM documents",
)
shared("B14_glob", "SELECT page_id FROM {pages} WHERE RX(url, '^https?://.*[.]example[.]net/en/[^?#]*$')")

# -- joins -----------------------------------------------------------------------------------------------------------
shared("C1_inner_embedding", "SELECT d.doc_id, d.lang, e.label FROM {documents} d JOIN {embeddings} e ON d.doc_id = e.vec_id")
shared("C2_left_optional", "SELECT d.doc_id, l.quality, e.label FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id LEFT JOIN {embeddings} e ON d.doc_id = e.vec_id")
shared("C3_missing_embeddings", "SELECT d.doc_id FROM {documents} d LEFT JOIN {embeddings} e ON d.doc_id = e.vec_id WHERE e.vec_id IS NULL")
shared(
    "C4_missing_or_stale",
    "SELECT c.c_custkey, CASE WHEN o.latest IS NULL THEN 0 ELSE 1 END AS has_summary FROM {customer} c LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS latest FROM {orders} GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey WHERE o.latest IS NULL OR o.latest < TIMESTAMP '1999-01-01 00:00:00' ORDER BY has_summary, c.c_custkey LIMIT 100",
)
shared(
    "C5_full_outer_candidates",
    "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.n_chars AS vec_score, b.quality AS fts_score FROM (SELECT doc_id, n_chars FROM {documents} ORDER BY n_chars DESC, doc_id LIMIT 30) a FULL OUTER JOIN (SELECT doc_id, quality FROM {labels} ORDER BY doc_id DESC, quality LIMIT 30) b ON a.doc_id = b.doc_id",
)
shared(
    "C6_interval_overlap",
    "SELECT a.conv_id, a.turn AS a_turn, b.turn AS b_turn FROM (SELECT conv_id, turn, turn AS s, turn + 1 AS e FROM {conversations}) a JOIN (SELECT conv_id, turn, turn AS s, turn + 2 AS e FROM {conversations} WHERE role = 'assistant') b ON a.conv_id = b.conv_id AND a.s <= b.e AND a.e >= b.s",
)
_EDGES = "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM {lineitem}"
shared("C7_either_endpoint", f"SELECT src, dst FROM ({_EDGES}) e WHERE src = 7 UNION SELECT src, dst FROM ({_EDGES}) f WHERE dst = 7")
shared("C11_chain", "SELECT c.c_custkey, count(*) AS n FROM {nation} n JOIN {customer} c ON c.c_nationkey = n.n_nationkey JOIN {orders} o ON o.o_custkey = c.c_custkey JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey WHERE n.n_regionkey = 1 AND l.l_returnflag = 'R' GROUP BY c.c_custkey")
shared("C12_scalar_counts", "SELECT c.c_custkey, coalesce(o.n, 0) AS n_open, (SELECT count(*) FROM {region}) AS n_regions FROM {customer} c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {orders} WHERE o_orderstatus = 'O' GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey")
shared(
    "C13_resolution_cascade",
    """WITH sym AS (SELECT p_partkey AS id, p_brand AS file, p_name AS fqn, p_type AS name FROM {part}),
    ref AS (SELECT p_partkey AS rid, p_brand AS file, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_type WHEN 2 THEN 'none' ELSE p_name END AS target FROM {part}),
    lf AS (SELECT file, fqn, min(id) AS id FROM sym GROUP BY file, fqn), ln AS (SELECT file, name, min(id) AS id FROM sym GROUP BY file, name),
    gf AS (SELECT fqn, min(id) AS id FROM sym GROUP BY fqn), gn AS (SELECT name, min(id) AS id FROM sym GROUP BY name)
    SELECT r.rid, coalesce(lf.id, ln.id, gf.id, gn.id) AS dst, CASE WHEN lf.id IS NOT NULL THEN 'local fqn' WHEN ln.id IS NOT NULL THEN 'local name' WHEN gf.id IS NOT NULL THEN 'global fqn' ELSE 'global name' END AS how
    FROM ref r LEFT JOIN lf ON r.file = lf.file AND r.target = lf.fqn LEFT JOIN ln ON r.file = ln.file AND r.target = ln.name LEFT JOIN gf ON r.target = gf.fqn LEFT JOIN gn ON r.target = gn.name
    WHERE coalesce(lf.id, ln.id, gf.id, gn.id) IS NOT NULL""",
)

# -- aggregates ------------------------------------------------------------------------------------------------------
shared("D1_language_histogram", "SELECT lang, count(*) AS n FROM {documents} GROUP BY lang ORDER BY n DESC, lang")
shared("D2_top_targets", "SELECT l_partkey AS target, count(*) AS n FROM {lineitem} GROUP BY l_partkey ORDER BY n DESC, target LIMIT 50")
shared("D3_distinct_per_tag", f"SELECT tag, count(DISTINCT doc_id) AS n FROM ({_TAGS}) t GROUP BY tag")
shared("D4_array_agg_having", "SELECT l_partkey, count(DISTINCT l_suppkey) AS n, array_sort(array_agg(DISTINCT l_returnflag)) AS flags FROM {lineitem} GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 3")
shared("D5_usage_per_column", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, array_sort(array_agg(DISTINCT CAST(user_id % 3 AS BIGINT))) AS kinds FROM {events} GROUP BY event_type")
shared("D6_avg_having", "SELECT source, round(avg(n_chars), 4) AS mean_chars FROM {documents} GROUP BY source HAVING avg(n_chars) > 2000")
shared("D7_status_pivot", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS pending, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'P') AS claimed FROM {orders} GROUP BY o_custkey")
shared("D8_validity_stats", "SELECT d.source, round(avg(coalesce(l.quality, 0)) * 100, 4) AS mean_score, count(*) FILTER (WHERE l.quality = 1) AS valid, count(*) FILTER (WHERE l.toxic = 1) AS stale, count(*) AS n FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.source")
shared(
    "D9_drift_counts",
    "SELECT " + ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{s}' AND o_orderpriority LIKE '{p}%') AS n_{s.lower()}_{p}" for s in "OFP" for p in "123") + " FROM {orders}",
)
shared(
    "D10_nested_counts",
    "SELECT event_type, to_json(map_from_entries(array_sort(collect_list(struct(k, n))))) AS counts FROM (SELECT event_type, CAST(user_id % 3 AS STRING) AS k, count(*) AS n FROM {events} GROUP BY event_type, user_id % 3) t GROUP BY event_type",
    "SELECT event_type, '{' || string_agg('\"' || k || '\":' || n, ',' ORDER BY k) || '}' AS counts FROM (SELECT event_type, CAST(user_id % 3 AS VARCHAR) AS k, count(*) AS n FROM events GROUP BY event_type, user_id % 3) t GROUP BY event_type".replace("'{'", "chr(123)").replace("'}'", "chr(125)"),
)
shared("D11_largest_files", "SELECT source, sum(length(text)) AS size FROM {documents} GROUP BY source ORDER BY size DESC, source LIMIT 10")
shared("D12_fan_in", f"SELECT dst, count(*) AS fan_in FROM ({_EDGES}) e GROUP BY dst ORDER BY fan_in DESC, dst LIMIT 20")
shared("D13_cache_key", "SELECT max(m) AS latest FROM (SELECT max(o_orderdate) AS m FROM {orders} UNION ALL SELECT max(l_shipdate) AS m FROM {lineitem}) t")
shared("D14_module_rollup", "SELECT regexp_extract(url, '^(.*/)[^/]+$', 1) AS module, count(*) AS n, max(page_id) AS latest FROM {pages} GROUP BY 1")
shared("D15_coverage", "SELECT d.lang, count(*) AS total, count(l.quality) AS covered, round(100.0 * count(l.quality) / count(*), 2) AS percent FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.lang")
shared("D16_call_histogram", "SELECT 'language' AS by_what, lang AS k, count(*) AS n FROM {documents} GROUP BY lang UNION ALL SELECT 'framework' AS by_what, source AS k, count(*) AS n FROM {documents} GROUP BY source UNION ALL SELECT 'type' AS by_what, role AS k, count(*) AS n FROM {conversations} GROUP BY role")
shared("D18_latest_row", "SELECT o_custkey, max(struct(o_orderdate, o_orderkey)).o_orderkey AS latest FROM {orders} GROUP BY o_custkey", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY o_custkey")
shared("D19_index_status", "SELECT (SELECT count(*) FROM {documents}) AS files, (SELECT count(*) FROM {embeddings}) AS vectors, (SELECT count(*) FROM {labels}) AS marks, (SELECT count(DISTINCT conv_id) FROM {conversations}) AS chats")
shared(
    "D20_coverage_board",
    "SELECT what, total, covered, round(covered / total, 6) AS ratio, covered < 0.95 * total AS lagging FROM (SELECT 'embedding' AS what, count(*) AS total, count(e.vec_id) AS covered FROM {documents} d LEFT JOIN {embeddings} e ON d.doc_id = e.vec_id UNION ALL SELECT 'label' AS what, count(*) AS total, count(l.doc_id) AS covered FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id) t",
)
shared("D21_repo_health", "SELECT o_custkey, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P') > 0 THEN 'red' WHEN count(*) FILTER (WHERE o_orderstatus = 'O') > 5 THEN 'yellow' ELSE 'green' END AS health FROM {orders} GROUP BY o_custkey")
shared("D22_tag_usage", f"SELECT g.tag, count(t.doc_id) AS n FROM (SELECT 'en' AS tag UNION ALL SELECT 'toxic' UNION ALL SELECT 'unused') g LEFT JOIN ({_TAGS}) t ON g.tag = t.tag GROUP BY g.tag")

# -- windows, sort, limit, sets ----------------------------------------------------------------------------------------
shared(
    "E1_sample_per_file",
    "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS STRING)), doc_id) AS rn FROM {documents}) t WHERE rn = 1",
    "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents) t WHERE rn = 1",
)
shared("E2_rank_by_position", "SELECT doc_id, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS BIGINT) AS vec_rank FROM (SELECT doc_id, n_chars FROM {documents} ORDER BY n_chars DESC, doc_id LIMIT 30) t")
shared("E3_best_per_file", "SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM {documents}) t WHERE rn = 1")
shared("E4_best_over_queries", "SELECT doc_id, max(score) AS score FROM (SELECT doc_id, n_chars % 97 AS score FROM {documents} UNION ALL SELECT doc_id, n_chars % 89 AS score FROM {documents}) t GROUP BY doc_id")
shared("E5_neighbours", "SELECT a.conv_id, a.turn, b.turn AS near_turn, b.role FROM {conversations} a JOIN {conversations} b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 WHERE a.turn = 2")
shared(
    "E6_running_budget",
    "SELECT conv_id, turn, role FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM {conversations}) t WHERE spent < 1200",
)
shared("E7_nulls_last", "SELECT d.doc_id, l.quality FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id ORDER BY l.quality DESC NULLS LAST, d.doc_id LIMIT 40")
shared("E8_distinct_ordered", "SELECT DISTINCT l_suppkey FROM {lineitem} ORDER BY l_suppkey LIMIT 10")
shared("E9_pagination", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 20 OFFSET 40")
shared("E10_union_all", "SELECT doc_id AS id, 'document' AS kind FROM {documents} UNION ALL SELECT page_id AS id, 'page' AS kind FROM {pages}")
shared("E11_concat_resort", "SELECT id, kind, score FROM (SELECT doc_id AS id, 'document' AS kind, length(text) % 1009 AS score FROM {documents} UNION ALL SELECT page_id AS id, 'page' AS kind, length(html) % 1009 AS score FROM {pages}) t ORDER BY score DESC, kind, id LIMIT 25")
shared("E12_ordered_dedupe", "SELECT event_type, user_id, min(event_id) AS first_at FROM {events} GROUP BY event_type, user_id")

# -- tables and listings -----------------------------------------------------------------------------------------------

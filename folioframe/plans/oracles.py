"""The queries as plain SQL over the same tables, for comparison."""

from __future__ import annotations

_CONV = "conv AS (SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page, text FROM conversations)"
_SRC = """src AS (SELECT conv_id % 10 AS doc_id, conv_id AS source_ord, CAST(conv_id AS VARCHAR) AS source_id, 'conv-' || conv_id || '.pdf' AS name,
  CAST(count(*) AS INTEGER) AS num_pages, CAST(sum(length(text)) AS BIGINT) AS size_bytes FROM conversations GROUP BY conv_id)"""
_M = """m AS (SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS position, CAST(o_orderkey AS VARCHAR) AS page_id,
  left(o_orderpriority, 1) AS source_id, CAST(o_orderkey % 5 AS INTEGER) AS source_index, CAST(o_orderkey % 4 * 90 AS INTEGER) AS rotation, o_orderkey AS k FROM orders)"""
_DIMS = """dims AS (SELECT CAST(p_partkey % 25 // 5 + 1 AS VARCHAR) AS source_id, CAST(p_partkey % 25 % 5 AS INTEGER) AS source_index, CAST(max(p_size) AS DOUBLE) AS width, max(p_retailprice) AS height,
  CAST(count(*) % 4 * 90 AS INTEGER) AS page_rotate FROM part GROUP BY 1, 2)"""
_TREE = """t AS (SELECT c.doc_id, c.page_id AS node_id, p.page_id AS parent_id, CAST(CASE WHEN c.position < 3 THEN c.position - 1 ELSE c.position % 3 END AS INTEGER) AS sib_index,
  't' || c.page_id AS title, c.source_id, c.source_index, c.position AS n FROM m c LEFT JOIN m p ON p.doc_id = c.doc_id AND p.position = c.position // 3)"""
_COLS = "doc_id, position, page_id, source_id, source_index, rotation"
_DENSE = "CAST(row_number() OVER (PARTITION BY doc_id ORDER BY position) AS INTEGER) AS position"


def _hits(query: str) -> str:
    n = len(query)
    return f"""{_CONV}, parts AS (SELECT doc_id, page, string_split(lower(text), '{query}') AS g FROM conv),
hits AS (SELECT doc_id, page, i, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + {n} * (i - 1) AS INTEGER) AS start_,
  CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + {n} * i AS INTEGER) AS end_ FROM (SELECT *, unnest(range(1, len(g))) AS i FROM parts))"""


_LINES = """o AS (SELECT o_custkey // 10 AS doc_id, o_orderkey AS k, CAST(o_orderkey // 640 % 7 + 1 AS INTEGER) AS a, CAST(o_orderkey // 64 % 7 + 1 AS INTEGER) AS b, CAST(o_orderkey // 8 % 7 + 1 AS INTEGER) AS c,
  CAST(row_number() OVER (PARTITION BY o_custkey // 10 ORDER BY o_orderkey) AS INTEGER) AS page_number FROM orders),
h AS (SELECT doc_id, page_number, CAST(k % 3 + 1 AS INTEGER) AS level,
  CASE k % 3 WHEN 0 THEN '第' || a || '章　総則' WHEN 1 THEN a || '.' || b || ' Scope' ELSE a || '.' || b || '.' || c || ' Details' END AS title,
  CASE k % 3 WHEN 0 THEN [a] WHEN 1 THEN [a, b] ELSE [a, b, c] END AS seq FROM o WHERE k % 11 != 0 AND k % 13 != 0)"""
_PLAIN = """o AS (SELECT o_custkey AS doc_id, o_orderkey AS page_number, o_orderkey % 4 AS kind, o_orderkey // 640 % 9 + 1 AS a, o_orderkey // 64 % 9 + 1 AS b, o_orderkey // 8 % 9 + 1 AS c FROM orders),
h AS (SELECT doc_id, page_number, CASE kind WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END AS level,
  CASE kind WHEN 0 THEN '第' || a || '章 総則' WHEN 1 THEN a || '.' || b || ' 適用範囲' ELSE a || '.' || b || '.' || c || ' General' END AS title FROM o)"""
_FILTER = f"""{_LINES},
f1 AS (SELECT *, max(CASE WHEN level = 1 THEN seq END) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM h),
g1 AS (SELECT * EXCLUDE (top), level != 1 OR top IS NULL OR seq >= top AS ok FROM f1),
s1 AS (SELECT *, coalesce(sum(CASE WHEN level = 1 AND ok THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM g1),
f2 AS (SELECT *, max(CASE WHEN level = 2 THEN seq END) OVER (PARTITION BY doc_id, seg ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s1),
g2 AS (SELECT * EXCLUDE (top, ok, seg), CASE WHEN level = 2 THEN top IS NULL OR seq >= top ELSE ok END AS ok FROM f2),
s2 AS (SELECT *, coalesce(sum(CASE WHEN level <= 2 AND ok THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM g2),
f3 AS (SELECT *, max(CASE WHEN level = 3 THEN seq END) OVER (PARTITION BY doc_id, seg ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s2),
kept AS (SELECT doc_id, page_number, level, title, CASE WHEN level = 3 THEN top IS NULL OR seq >= top ELSE ok END AS accepted FROM f3)"""

_CLICKS = """k AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey * 5 % 9 + 1 AS p,
  CASE o_orderkey % 7 WHEN 0 THEN 'single' WHEN 1 THEN 'clear' WHEN 2 THEN 'all' WHEN 3 THEN 'range' WHEN 4 THEN 'range' ELSE 'toggle' END AS kind FROM orders),
f AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS chosen, CAST(NULL AS BIGINT) AS a FROM k
  UNION ALL SELECT k.doc_id, k.n, CASE WHEN kind = 'clear' THEN [] WHEN kind = 'all' THEN range(1, 8) WHEN kind = 'toggle' THEN CASE WHEN list_contains(chosen, p) THEN [x FOR x IN chosen IF x != p] ELSE list_append(chosen, p) END
      WHEN kind = 'range' AND a IS NOT NULL AND a <= 7 AND p <= 7 THEN range(least(a, p), greatest(a, p) + 1) ELSE [p] END,
    CASE WHEN kind = 'clear' THEN NULL WHEN kind = 'all' THEN 1 WHEN kind = 'range' AND a IS NOT NULL AND a <= 7 AND p <= 7 THEN a ELSE p END
  FROM f JOIN k ON k.doc_id = f.doc_id AND k.n = f.n + 1),
l AS (SELECT doc_id, arg_max(chosen, n) AS chosen, arg_max(struct_pack(a := a), n).a AS a FROM f GROUP BY doc_id)"""

_PATHS = f"""{_M}, {_TREE},
r AS (SELECT doc_id, node_id, parent_id, [sib_index] AS path, CAST([] AS VARCHAR[]) AS anc FROM t WHERE parent_id IS NULL
  UNION ALL SELECT t.doc_id, t.node_id, t.parent_id, list_append(r.path, t.sib_index), list_append(r.anc, t.parent_id) FROM t JOIN r ON r.doc_id = t.doc_id AND r.node_id = t.parent_id),
flat AS (SELECT *, CAST(len(path) - 1 AS INTEGER) AS depth, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY path, node_id) - 1 AS INTEGER) AS preorder FROM r),
clo AS (SELECT doc_id, unnest(anc) AS ancestor_id, node_id FROM flat)"""
_LOG = """e AS (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS seq, event_id % 9 AS dest,
  CASE WHEN event_id % 17 = 0 THEN 'save' WHEN event_type = 'signup' THEN 'undo' WHEN event_type = 'error' THEN 'redo' WHEN event_id % 13 = 0 THEN 'merge'
    WHEN event_type = 'click' THEN 'rotate' WHEN event_type = 'view' THEN 'reorder' ELSE 'delete' END AS kind FROM events)"""
#: Both stacks, as lists of seq.
_STACKS = f"""{_LOG}, r AS (SELECT DISTINCT user_id, 0 AS seq, CAST([] AS BIGINT[]) AS a, CAST([] AS BIGINT[]) AS u, 0 AS s FROM e UNION ALL
  SELECT r.user_id, r.seq + 1, CASE WHEN kind = 'save' THEN a WHEN kind = 'undo' THEN a[1:len(a) - 1] WHEN kind = 'redo' THEN list_concat(a, u[len(u):]) ELSE list_append(a, e.seq) END,
    CASE WHEN kind = 'save' THEN u WHEN kind = 'undo' THEN list_concat(u, a[len(a):]) WHEN kind = 'redo' THEN u[1:len(u) - 1] ELSE CAST([] AS BIGINT[]) END,
    CASE WHEN kind = 'save' THEN len(a) ELSE s END FROM r JOIN e ON e.user_id = r.user_id AND e.seq = r.seq + 1),
l AS (SELECT user_id, arg_max(a, seq) AS a, arg_max(u, seq) AS u, arg_max(s, seq) AS s FROM r GROUP BY user_id)"""
_REPLAY = f"""WITH RECURSIVE {_STACKS},
        o AS (SELECT l.user_id, i, e.kind, e.dest, e.event_id AS k, [l.user_id || '-' || e.event_id % 400, l.user_id || '-' || (e.event_id * 7 + 1) % 400] AS ids
          FROM (SELECT user_id, unnest(a) AS seq, unnest(range(1, len(a) + 1)) AS i FROM l) l JOIN e ON e.user_id = l.user_id AND e.seq = l.seq),
        p AS (SELECT user_id, 0 AS i, list_transform(range(0, 400), lambda x: {{'p': user_id || '-' || x, 's': CAST(user_id AS VARCHAR), 'n': CAST(x AS INTEGER), 'r': 0}}) AS pages FROM l UNION ALL
          SELECT p.user_id, p.i + 1, CASE o.kind
            WHEN 'rotate' THEN list_transform(pages, lambda x: {{'p': x.p, 's': x.s, 'n': x.n, 'r': CASE WHEN list_contains(o.ids, x.p) THEN (x.r + 90) % 360 ELSE x.r END}})
            WHEN 'merge' THEN list_concat(pages[1:o.dest], list_concat([{{'p': 'm-' || o.k, 's': 'm', 'n': CAST(o.k % 5 AS INTEGER), 'r': CAST(o.k % 4 * 90 AS INTEGER)}}], pages[o.dest + 1:]))
            WHEN 'delete' THEN list_filter(pages, lambda x: NOT list_contains(o.ids, x.p))
            ELSE list_concat(list_filter(pages, lambda x: NOT list_contains(o.ids, x.p))[1:o.dest], list_concat(list_filter(pages, lambda x: list_contains(o.ids, x.p)), list_filter(pages, lambda x: NOT list_contains(o.ids, x.p))[o.dest + 1:])) END
          FROM p JOIN o ON o.user_id = p.user_id AND o.i = p.i + 1),
        f AS (SELECT user_id, arg_max(pages, i) AS pages FROM p GROUP BY user_id), g AS (SELECT user_id, unnest(pages) AS x, unnest(range(1, len(pages) + 1)) AS position FROM f)
        SELECT user_id AS doc_id, CAST(position AS INTEGER) AS position, x.p AS page_id, x.s AS source_id, x.n AS source_index, x.r AS rotation FROM g"""
#: The node that is edited, its neighbours among its siblings, and its parent.
_EDIT = f"""{_M}, {_TREE}, g AS (SELECT doc_id, node_id AS g_id, parent_id AS g_up, sib_index AS g_at FROM t WHERE n = doc_id % 7 + 1),
x AS (SELECT t.*, g.*  EXCLUDE (doc_id), count(*) OVER (PARTITION BY t.doc_id, t.parent_id) AS family,
  (SELECT p.node_id FROM t p WHERE p.doc_id = g.doc_id AND p.parent_id IS NOT DISTINCT FROM g.g_up AND p.sib_index = g.g_at - 1) AS prev_id,
  (SELECT p.parent_id FROM t p WHERE p.doc_id = g.doc_id AND p.node_id = g.g_up) AS top_id,
  (SELECT p.sib_index FROM t p WHERE p.doc_id = g.doc_id AND p.node_id = g.g_up) AS top_at FROM t LEFT JOIN g ON g.doc_id = t.doc_id)"""
_NEW_INDEX = "CAST(row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY sib_index) - 1 AS INTEGER) AS sib_index"


def _size(v: str) -> str:
    steps = " ".join(f"WHEN {v} < 1024.0 ** {p + 1} THEN printf('%.1f {u}', {v} / 1024.0 ** {p})" for p, u in ((1, "KB"), (2, "MB"), (3, "GB")))
    return f"CASE WHEN {v} < 0 THEN '—' WHEN {v} < 1024 THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) || ' B' {steps} ELSE printf('%.1f TB', {v} / 1024.0 ** 4) END"


ORACLES: dict[str, str] = {
    "search_topk": """SELECT doc_id, CAST(sum(len(string_split(lower(line), 'the')) - 1) AS BIGINT) AS hits FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
        GROUP BY doc_id HAVING hits > 0 ORDER BY hits DESC, doc_id LIMIT 20""",
    "search_counts": """SELECT doc_id, CAST(sum(len(string_split(lower(line), 'on')) - 1) AS BIGINT) AS hits FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id""",
    "search_offsets": f"WITH {_hits('on')} SELECT doc_id, page, start_ AS start, end_ AS \"end\" FROM hits",
    "search_case_sensitive": "SELECT conv_id AS doc_id, CAST(sum(len(string_split(text, 'Th')) - 1) AS BIGINT) AS hits FROM conversations GROUP BY conv_id",
    "search_regex": f"""WITH {_CONV}, x AS (SELECT doc_id, page, regexp_extract_all(text, '(?i)[a-z]+ion') AS m FROM conv)
        SELECT doc_id, page, CAST(len(m) AS BIGINT) AS n_hits, CAST(list_sum(list_transform(m, lambda y: length(y))) AS BIGINT) AS hit_chars FROM x WHERE len(m) > 0""",
    "search_nav": f"""WITH {_hits('the')}, n AS (SELECT *, row_number() OVER w - 1 AS hit_no, count(*) OVER (PARTITION BY doc_id) AS n_hits, lead(page) OVER w AS lp, first_value(page) OVER w AS fp
        FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY page, start_))
        SELECT doc_id, page, start_ AS start, end_ AS "end", CAST(hit_no AS INTEGER) AS hit_no, n_hits, CAST((hit_no + 1) % n_hits AS INTEGER) AS next_hit, CAST((hit_no - 1 + n_hits) % n_hits AS INTEGER) AS prev_hit, coalesce(lp, fp) AS next_page FROM n""",
    "search_ordinals": f"WITH {_hits('the')} SELECT doc_id, page, start_ AS start, end_ AS \"end\", CAST(i - 1 AS INTEGER) AS ordinal FROM hits",
    "search_active": "SELECT conv_id AS doc_id, CASE WHEN bool_or(contains(lower(text), 'idiot')) THEN 0 ELSE -1 END AS active_hit FROM conversations GROUP BY conv_id",
    "highlight_marks": f"WITH {_CONV} SELECT doc_id, page, regexp_replace(text, '(?i)(th)', '<mark class=\"search-hit\">\\1</mark>', 'g') AS marked FROM conv",
    "highlight_current": f"""WITH {_CONV}, x AS (SELECT doc_id, page AS item_no, text, len(string_split(lower(text), 'the')) - 1 AS hits FROM conv),
        y AS (SELECT *, coalesce(sum(hits) OVER (PARTITION BY doc_id ORDER BY item_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM x),
        z AS (SELECT *, regexp_replace(text, '(?i)(the)', '<mark class="search-hit">\\1</mark>', 'g') AS m, 1 - base AS cur FROM y)
        SELECT doc_id, item_no, CASE WHEN cur = 0 AND hits > 0 THEN regexp_replace(m, '^(.*?<mark class="search-hit")', '\\1 data-current="true"', 's')
          WHEN cur = 1 AND hits > 1 THEN regexp_replace(m, '^(.*?<mark .*?<mark class="search-hit")', '\\1 data-current="true"', 's') ELSE m END AS marked FROM z""",
    "search_span_gap": f"""WITH {_CONV}, x AS (SELECT doc_id, page, text, len(string_split(lower(text), 'th')) - 1 AS n FROM conv),
        y AS (SELECT doc_id, page, n, list_sum([len(string_split(lower(substring(text, i * 20 + 1, 20)), 'th')) - 1 for i in range(0, (length(text) + 19) // 20)]) AS k FROM x WHERE n > 0)
        SELECT doc_id, page, CAST(n AS BIGINT) AS page_hits, CAST(k AS BIGINT) AS item_hits, CAST(n - k AS BIGINT) AS missed FROM y""",
    "search_crossing_hits": f"""WITH {_hits('th')} SELECT doc_id, page, start_ AS start, end_ AS "end", start_ // 20 AS first_item, (end_ - 1) // 20 AS last_item FROM hits WHERE start_ // 20 != (end_ - 1) // 20""",
    "search_marks_across": f"""WITH {_hits('th')}, s AS (SELECT doc_id, page, list(start_) AS s FROM hits GROUP BY ALL),
        i AS (SELECT doc_id, page, text, coalesce(s, []) AS s, unnest(range(0, greatest(length(text) - 1, 0) // 20 + 1)) AS item_no FROM conv LEFT JOIN s USING (doc_id, page))
        SELECT doc_id, page, CAST(item_no AS INTEGER) AS item_no, array_to_string([CASE WHEN list_contains(s, c) OR (list_contains(s, c - 1) AND c % 20 = 0) THEN '<mark class="search-hit">' ELSE '' END || substring(text, c + 1, 1)
          || CASE WHEN list_contains(s, c - 1) OR (list_contains(s, c) AND c % 20 = 19) THEN '</mark>' ELSE '' END FOR c IN range(item_no * 20, least(length(text), item_no * 20 + 20))], '') AS marked FROM i""",
    "output_page_errors": f"""WITH {_M}, l AS (SELECT CAST(s_nationkey % 5 + 1 AS VARCHAR) AS source_id, count(*) % 5 + 1 AS n FROM supplier WHERE s_nationkey % 5 != 4 GROUP BY 1)
        SELECT doc_id, position, page_id, source_id, source_index, CASE WHEN n IS NULL THEN 'missing source ' || source_id ELSE 'page ' || source_index || ' of source ' || source_id || ' with ' || n || ' pages' END AS error
        FROM m LEFT JOIN l USING (source_id) WHERE n IS NULL OR source_index >= n""",
    "docs_intake": """WITH f AS (SELECT page_id % 7 AS doc_id, url || CASE WHEN page_id % 3 = 0 THEN '.PDF' ELSE '' END AS name, page_id % 5 = 0 AS typed FROM pages),
        g AS (SELECT doc_id, typed OR ends_with(lower(name), '.pdf') AS yes FROM f) SELECT doc_id, count(*) FILTER (yes) AS accepted_count, count(*) FILTER (NOT yes) AS rejected_count FROM g GROUP BY doc_id""",
    "docs_state": "SELECT doc_id % 40 AS doc_id, count(*) >= 2 AND NOT bool_or(n_chars <= 500) AS can_merge FROM documents GROUP BY 1",
    "docs_meta": "SELECT doc_id % 10 AS doc_id, doc_id AS source_id, n_chars AS num_pages, CASE WHEN doc_id % 3 != 0 THEN ' ' || lang END AS title, source AS author FROM documents",
    "page_texts": "SELECT conv_id AS source_id, 0 AS source_index, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "displayed_texts": f"WITH {_M} SELECT m.doc_id, m.position AS page, md5(coalesce(d.text, '')) AS text FROM m LEFT JOIN documents d ON m.source_id = '3' AND d.doc_id = m.source_index",
    "raw_items": """SELECT doc_id AS source_id, 0 AS source_index, 0 AS item_no, md5(text) AS str, CAST(n_chars + 1 AS DOUBLE) AS x, CAST(n_chars + 2 AS DOUBLE) AS y, CAST(n_chars AS DOUBLE) AS font_size
        FROM documents WHERE length(text) > 0 AND doc_id % 5 != 0""",
    "file_sizes": f"SELECT o_orderkey, {_size('v')} AS shown FROM (SELECT o_orderkey, floor(o_totalprice * o_orderkey) * (o_orderkey % 7 - 1) AS v FROM orders)",
    "rotations": "SELECT o_orderkey, CAST(((floor((o_orderkey % 1000 - 500) / 90 + 0.5) * 90) % 360 + 360) % 360 AS INTEGER) AS rotation FROM orders",
    "page_clamps": """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 100 <= 0 THEN 1 ELSE least(o_orderkey % 100, greatest(1, trunc(o_totalprice / 1000 - 50))) END AS BIGINT) AS page FROM orders""",
    "fit_scales": "SELECT p_partkey, 768.0::DOUBLE / (p_size * 10.0::DOUBLE) AS by_width, least(768.0::DOUBLE / (p_size * 10.0::DOUBLE), 568.0::DOUBLE / p_retailprice) AS whole FROM part",
    "output_names": """SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'document' ELSE regexp_replace(p_name, '(?i)\\.pdf$', '') END || printf('-%02d', p_partkey % 120) || '.pdf' AS file_name FROM part""",
    "title_normalize": """WITH x AS (SELECT p_partkey, p_partkey % 30 AS k, regexp_replace(p_name, '\\s{2,}', ' ', 'g') AS name FROM part)
        SELECT p_partkey, trim(CASE p_partkey % 3 WHEN 0 THEN '第' || k || '章 総則 ' || name WHEN 1 THEN k || '.' || k || ' ' || name ELSE '1' || k || '　' || name END) AS title,
          CASE p_partkey % 3 WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN k || '.' || k ELSE '1' || k END AS numbers FROM x""",
    "toc_leaders": "SELECT p_partkey, regexp_matches(p_name, '\\.{4,}|[-–—]{3,}|…') OR p_partkey % 6 >= 4 OR p_partkey % 4 >= 3 AS leader FROM part",
    "manifest_initial": f"WITH {_SRC} SELECT doc_id, source_ord, source_id, CAST(i AS INTEGER) AS source_index, doc_id || '-' || source_id || '-' || i AS page_id, 0 AS rotation FROM (SELECT *, unnest(range(0, num_pages)) AS i FROM src)",
    "manifest_merged": f"""WITH {_SRC}, p AS (SELECT *, unnest(range(0, num_pages)) AS i FROM src)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY source_ord, i) AS INTEGER) AS position, doc_id || '-' || source_id || '-' || i AS page_id, source_id, CAST(i AS INTEGER) AS source_index, 0 AS rotation FROM p""",
    "documents_merged": f"WITH {_SRC} SELECT doc_id, CASE WHEN count(*) > 1 THEN 'merged.pdf' ELSE min(name) END AS name, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, CAST(sum(num_pages) AS BIGINT) AS num_pages, count(*) AS n_sources FROM src GROUP BY doc_id",
    "manifest_rotate": f"WITH {_M} SELECT * EXCLUDE (k, rotation), CAST(CASE WHEN k % 3 = 0 THEN (rotation + 450) % 360 ELSE rotation END AS INTEGER) AS rotation FROM m",
    "manifest_delete": f"WITH {_M} SELECT * EXCLUDE (k, position), {_DENSE} FROM m WHERE k % 4 != 1",
    "manifest_reorder": f"""WITH {_M}, d AS (SELECT *, list(page_id ORDER BY position) FILTER (k % 3 = 0) OVER w AS mv, coalesce(list(page_id ORDER BY position) FILTER (k % 3 != 0) OVER w, []) AS rest FROM m WINDOW w AS (PARTITION BY doc_id)),
        e AS (SELECT * EXCLUDE (mv), coalesce(mv, []) AS mv, CASE WHEN mv IS NULL THEN 0 ELSE greatest(0, doc_id % 6 - 1) END AS dest FROM d)
        SELECT doc_id, CAST(list_position(list_concat(rest[1:dest], list_concat(mv, rest[dest + 1:])), page_id) AS INTEGER) AS position, page_id, source_id, source_index, rotation FROM e""",
    "manifest_insert": f"""WITH {_M}, d AS (SELECT doc_id, count(*) AS n FROM m GROUP BY doc_id), i AS (SELECT doc_id, greatest(0, least(n, doc_id % 30 - 2)) AS dest FROM d)
        SELECT m.doc_id, CAST(position + CASE WHEN position > dest THEN 2 ELSE 0 END AS INTEGER) AS position, page_id, source_id, source_index, rotation FROM m JOIN i USING (doc_id)
        UNION ALL SELECT doc_id, CAST(dest + j AS INTEGER), 'new-' || doc_id, 'n', 0, 0 FROM i, (VALUES (1), (2)) v(j)""",
    "manifest_extract": f"WITH {_M} SELECT * EXCLUDE (k, position), {_DENSE} FROM m WHERE k % 3 = 2",
    "manifest_split": f"""WITH {_M}, p AS (SELECT *, CAST(1 + sum(CASE WHEN k % 7 = 0 AND position > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY position) AS INTEGER) AS part_no FROM m)
        SELECT {_COLS}, part_no, CAST(row_number() OVER (PARTITION BY doc_id, part_no ORDER BY position) AS INTEGER) AS part_position FROM p""",
    "split_names": f"""WITH {_M}, p AS (SELECT *, CAST(1 + sum(CASE WHEN k % 7 = 0 AND position > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY position) AS INTEGER) AS part_no FROM m)
        SELECT doc_id, part_no, count(*) AS n_pages, 'cust-' || doc_id || printf('-%02d', part_no) || '.pdf' AS part_name FROM p GROUP BY doc_id, part_no""",
    "manifest_array_move": f"""WITH {_M}, d AS (SELECT *, list(page_id ORDER BY position) OVER (PARTITION BY doc_id) AS l, doc_id % 4 AS a, doc_id % 11 AS b FROM m),
        e AS (SELECT *, CASE WHEN a < len(l) AND b < len(l) THEN list_concat(l[1:a], l[a + 2:]) END AS rest FROM d)
        SELECT doc_id, CAST(CASE WHEN rest IS NULL THEN position ELSE list_position(list_concat(rest[1:b], list_concat([l[a + 1]], rest[b + 1:])), page_id) END AS INTEGER) AS position, page_id FROM e""",
    "source_orders": f"WITH {_M}, f AS (SELECT doc_id, source_id, min(position) AS first_position FROM m GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_position) AS INTEGER) AS source_rank FROM f",
    "doc_keys": f"WITH {_M}, f AS (SELECT doc_id, source_id, min(position) AS p FROM m GROUP BY 1, 2) SELECT doc_id, string_agg(source_id, '|' ORDER BY p) AS doc_key FROM f GROUP BY doc_id",
    "locate_pages": f"""WITH {_M}, w AS (SELECT DISTINCT doc_id, CAST(doc_id % 5 + 1 AS VARCHAR) AS source_id, CAST(doc_id % 5 AS INTEGER) AS source_index FROM m)
        SELECT w.*, (SELECT min(position) FROM m WHERE m.doc_id = w.doc_id AND m.source_id = w.source_id AND m.source_index = w.source_index) AS position FROM w""",
    "limits": f"""WITH {_SRC}, s AS (SELECT doc_id, CAST(sum(num_pages) AS BIGINT) AS num_pages, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM src GROUP BY doc_id)
        SELECT *, num_pages > 50 AS pages_exceeded, size_bytes > 20000 AS bytes_exceeded, num_pages > 50 OR size_bytes > 20000 AS exceeded FROM s""",
    "manifest_output": f"WITH {_M}, {_DIMS} SELECT doc_id, position - 1 AS output_index, page_id, source_id, source_index, CAST((page_rotate + rotation) % 360 AS INTEGER) AS rotation FROM m JOIN dims USING (source_id, source_index)",
    "output_errors": f"""WITH {_M} SELECT DISTINCT doc_id, 'no pages' AS error FROM m WHERE doc_id % 3 = 0
        UNION ALL SELECT DISTINCT doc_id, 'missing source 4' FROM m WHERE doc_id % 3 != 0 AND source_id = '4'""",
    "page_geometry": f"""WITH {_M}, {_DIMS}, j AS (SELECT m.*, d.width AS w, d.height AS h, d.page_rotate AS pr FROM m LEFT JOIN (SELECT * FROM dims WHERE source_index != 3) d USING (source_id, source_index)),
        f AS (SELECT *, first_value(w) OVER x AS fw, first_value(h) OVER x AS fh, CAST((coalesce(pr, 0) + rotation) % 360 AS INTEGER) AS total_rotation FROM j WINDOW x AS (PARTITION BY doc_id ORDER BY position))
        SELECT doc_id, position, total_rotation, CASE WHEN total_rotation % 180 = 90 THEN coalesce(h, fh) ELSE coalesce(w, fw) END AS width, CASE WHEN total_rotation % 180 = 90 THEN coalesce(w, fw) ELSE coalesce(h, fh) END AS height FROM f""",
    "history_sizes": "SELECT user_id AS doc_id, count(*) AS n FROM events GROUP BY user_id",
    "replay_output": f"""WITH RECURSIVE {_M}, {_DIMS}, d AS (SELECT doc_id, list({{'p': page_id, 's': source_id, 'n': source_index, 'r': CASE WHEN k % 3 = 0 THEN (rotation + 90) % 360 ELSE rotation END}} ORDER BY position) AS l,
          list(page_id ORDER BY page_id) FILTER (k % 3 = 0) AS mv FROM m GROUP BY doc_id),
        e AS (SELECT doc_id, mv, CASE WHEN mv IS NULL THEN l ELSE list_concat(list_filter(l, lambda x: NOT list_contains(mv, x.p))[1:1], list_concat(list_filter(l, lambda x: list_contains(mv, x.p)), list_filter(l, lambda x: NOT list_contains(mv, x.p))[2:])) END AS l FROM d),
        f AS (SELECT doc_id, mv, list_filter(l, lambda x: mv IS NULL OR len(mv) < 2 OR x.p != mv[2]) AS l FROM e),
        g AS (SELECT doc_id, CASE WHEN mv IS NULL THEN l ELSE list_concat(l[1:1], list_concat([{{'p': 'new-' || doc_id, 's': '2', 'n': 3, 'r': 180}}], l[2:])) END AS l FROM f),
        h AS (SELECT doc_id, unnest(l) AS x, unnest(range(0, len(l))) AS i FROM g)
        SELECT doc_id, CAST(i AS INTEGER) AS output_index, x.p AS page_id, x.s AS source_id, x.n AS source_index, CAST((page_rotate + x.r) % 360 AS INTEGER) AS rotation FROM h JOIN dims ON dims.source_id = x.s AND dims.source_index = x.n""",
    "dirty_documents": """WITH g AS (SELECT o_custkey AS doc_id, count(*) > 15 AS a, max(o_orderkey) % 2 = 0 AS b FROM orders GROUP BY 1)
        SELECT doc_id, (doc_id % 3 != 0 AND a) OR (doc_id % 5 != 0 AND b) AS dirty FROM g WHERE doc_id % 3 != 0 OR doc_id % 5 != 0""",
    "selection_toggle": """WITH c AS (SELECT o_custkey AS doc_id, CAST(o_orderkey % 6 AS VARCHAR) AS page_id FROM orders UNION ALL SELECT DISTINCT o_custkey, '0' FROM orders)
        SELECT doc_id, page_id FROM c GROUP BY 1, 2 HAVING count(*) % 2 = 1""",
    "selection_anchor": "SELECT o_custkey AS doc_id, CAST(max(o_orderkey) % 6 AS VARCHAR) AS page_id FROM orders GROUP BY 1",
    "selection_range": f"WITH {_M}, n AS (SELECT doc_id, count(*) AS n FROM m GROUP BY 1) SELECT doc_id, page_id FROM m JOIN n USING (doc_id) WHERE n >= 4 AND CASE WHEN n >= 9 THEN position BETWEEN 4 AND 9 ELSE position = 4 END",
    "selection_log": f"WITH RECURSIVE {_CLICKS} SELECT doc_id, 'p' || unnest(chosen) AS page_id FROM l",
    "selection_log_anchor": f"WITH RECURSIVE {_CLICKS} SELECT doc_id, 'p' || a AS page_id FROM l WHERE a IS NOT NULL",
    "outline_edit_log": f"""WITH RECURSIVE {_M}, {_TREE}, k AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, CAST(o_orderkey AS VARCHAR) AS node, o_orderkey % 7 AS kind FROM orders),
        f AS (SELECT doc_id, CAST(0 AS BIGINT) AS n, list(struct_pack(id := CAST(node_id AS VARCHAR), up := CAST(parent_id AS VARCHAR), title := CAST(title AS VARCHAR)) ORDER BY sib_index, node_id) AS l FROM t GROUP BY doc_id
          UNION ALL SELECT doc_id, n, list_concat(flatten([CASE WHEN kind = 0 AND x = i THEN [struct_pack(id := node, up := l[i].up, title := 'edited')]
              WHEN kind = 1 AND x = i THEN [l[i], struct_pack(id := 'e' || node, up := l[i].up, title := 'edited')] WHEN kind IN (3, 4) AND j IS NOT NULL AND x = i THEN [l[j]] WHEN kind IN (3, 4) AND j IS NOT NULL AND x = j THEN [l[i]]
              WHEN kind = 5 AND j IS NOT NULL AND x = i THEN [] WHEN kind = 6 AND l[i].up IS NOT NULL AND x = i THEN [] WHEN kind = 6 AND l[i].up IS NOT NULL AND x = q THEN [l[q], struct_pack(id := node, up := l[q].up, title := l[i].title)] ELSE [l[x]] END FOR x IN range(1, len(l) + 1)]),
              CASE WHEN kind = 2 THEN [struct_pack(id := 'e' || node, up := node, title := 'edited')] WHEN kind = 5 AND j IS NOT NULL THEN [struct_pack(id := node, up := l[j].id, title := l[i].title)] ELSE [] END)
            FROM (SELECT *, list_position([y.id FOR y IN l], l[i].up) AS q, CASE WHEN kind = 4 THEN list_min([y FOR y IN range(1, len(l) + 1) IF y > i AND l[y].up IS NOT DISTINCT FROM l[i].up]) ELSE list_max([y FOR y IN range(1, len(l) + 1) IF y < i AND l[y].up IS NOT DISTINCT FROM l[i].up]) END AS j
              FROM (SELECT k.doc_id, k.n, k.node, k.kind, f.l, list_position([y.id FOR y IN f.l], k.node) AS i FROM f JOIN k ON k.doc_id = f.doc_id AND k.n = f.n + 1))),
        z AS (SELECT doc_id, arg_max(l, n) AS l FROM f GROUP BY doc_id), u AS (SELECT doc_id, unnest(l) AS y, unnest(range(1, len(l) + 1)) AS place FROM z)
        SELECT doc_id, y.id AS node_id, y.up AS parent_id, CAST(row_number() OVER (PARTITION BY doc_id, y.up ORDER BY place) - 1 AS INTEGER) AS sib_index, y.title AS title FROM u""",
    "selection_all": f"WITH {_M} SELECT doc_id, count(*) AS n_selected, arg_min(page_id, position) AS page_id FROM m GROUP BY doc_id",
    "selection_collapse": f"""WITH {_M}, s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE position WHEN 5 THEN 0 WHEN 2 THEN 1 ELSE 2 END, position) AS n FROM m WHERE k % 3 = 0)
        SELECT doc_id, page_id FROM s WHERE n = 1""",
    "selection_rotate_delete": f"WITH {_M} SELECT doc_id, {_DENSE}, page_id, source_id, source_index, CAST(CASE WHEN k % 3 = 0 THEN (rotation + 270) % 360 ELSE rotation END AS INTEGER) AS rotation FROM m WHERE position != 2",
    "headings_found": f"WITH {_LINES} SELECT doc_id, page_number, level, title FROM h",
    "headings_default": f"WITH {_PLAIN} SELECT doc_id, page_number, level, title FROM h WHERE level > 0",
    "headings_filter": f"WITH {_FILTER} SELECT doc_id, page_number, level, accepted FROM kept",
    "headings_tree": f"""WITH {_FILTER}, a AS (SELECT *, doc_id || '-' || page_number || '-0' AS node_id FROM kept WHERE accepted),
        p AS (SELECT *, CASE level WHEN 2 THEN last_value(CASE WHEN level < 2 THEN node_id END IGNORE NULLS) OVER w WHEN 3 THEN last_value(CASE WHEN level < 3 THEN node_id END IGNORE NULLS) OVER w END AS parent_id
          FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT doc_id, node_id, parent_id, CAST(row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY page_number) - 1 AS INTEGER) AS sib_index, page_number - 1 AS source_index FROM p""",
    "headings_profile": f"""WITH {_FILTER}, n AS (SELECT doc_id, page_number, count(*) AS c FROM kept WHERE accepted GROUP BY 1, 2)
        SELECT o.doc_id, o.page_number AS current_page, count(*) OVER (PARTITION BY o.doc_id) AS total_pages, CAST(sum(coalesce(n.c, 0)) OVER (PARTITION BY o.doc_id ORDER BY o.page_number) AS BIGINT) AS found_count
        FROM o LEFT JOIN n USING (doc_id, page_number)""",
    "html_headings": """WITH h AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)) AS t FROM pages)
        SELECT doc_id, 1 AS level, trim(regexp_replace(regexp_replace(t, '\\s+\\.', '.', 'g'), '\\s{2,}', ' ', 'g')) AS title FROM h WHERE trim(t) != '' AND NOT regexp_matches(t, '\\.{4,}|…|・{4,}|[-–—]{3,}|(?:\\.\\s){3,}')""",
    "median_fonts": """WITH w AS (SELECT doc_id, unnest(range(0, len(p))) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\\s+') AS p FROM documents)),
        f AS (SELECT doc_id AS source_id, CAST(i // 200 AS INTEGER) AS source_index, list(CAST(i % 200 % 4 + 10 AS DOUBLE) ORDER BY i % 200 % 4) AS s FROM w GROUP BY 1, 2)
        SELECT source_id, source_index, s[len(s) // 2 + 1] AS median FROM f""",
    "outline_auto": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
        w AS (SELECT doc_id, i, unnest(string_split(line, ' ')) AS str, unnest(range(0, len(string_split(line, ' ')))) AS k, len(string_split(line, ' ')) AS n FROM l WHERE i >= 1),
        r AS (SELECT doc_id, i, k * 2 >= n AS low, string_agg(str, '' ORDER BY CASE WHEN k * 2 >= n THEN k ELSE -k END) AS line FROM w GROUP BY 1, 2, 3),
        h AS (SELECT *, regexp_extract(line, '^(T[a-z]+)', 1) AS title FROM r WHERE regexp_matches(line, '^T[a-z]+') AND NOT regexp_matches(line, '\\.{4,}|…|・{4,}|[-–—]{3,}|(?:\\.\\s){3,}'))
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, low) - 1 AS INTEGER) AS sib_index, title, CAST(i AS INTEGER) AS source_index FROM h""",
    "outline_flatten": f"WITH RECURSIVE {_PATHS} SELECT doc_id, node_id, parent_id, depth, preorder FROM flat",
    "outline_descendants": f"WITH RECURSIVE {_PATHS} SELECT clo.* FROM clo JOIN t ON t.doc_id = clo.doc_id AND t.node_id = clo.ancestor_id WHERE t.n = 2",
    "outline_prune": f"WITH RECURSIVE {_PATHS} SELECT doc_id, node_id FROM flat f WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = f.doc_id AND t.n = 1 AND list_contains(f.anc, t.node_id))",
    "outline_counts": f"WITH RECURSIVE {_PATHS}, c AS (SELECT doc_id, ancestor_id AS node_id, count(*) AS n FROM clo GROUP BY 1, 2) SELECT t.doc_id, t.node_id, coalesce(c.n, 0) AS n_descendants FROM t LEFT JOIN c USING (doc_id, node_id)",
    "outline_sizes": "SELECT o_custkey AS doc_id, count(*) AS n_nodes FROM orders GROUP BY 1",
    "outline_links": f"""WITH RECURSIVE {_PATHS}, c AS (SELECT doc_id, ancestor_id AS node_id, count(*) AS n FROM clo GROUP BY 1, 2),
        k AS (SELECT doc_id, parent_id AS node_id, arg_min(node_id, sib_index) AS first_child, arg_max(node_id, sib_index) AS last_child FROM t WHERE parent_id IS NOT NULL GROUP BY 1, 2)
        SELECT t.doc_id, t.node_id, t.parent_id, lag(t.node_id) OVER w AS prev_id, lead(t.node_id) OVER w AS next_id, first_child, last_child, coalesce(c.n, 0) AS n_below
        FROM t LEFT JOIN c USING (doc_id, node_id) LEFT JOIN k USING (doc_id, node_id) WINDOW w AS (PARTITION BY t.doc_id, t.parent_id ORDER BY t.sib_index)""",
    "outline_remap": f"""WITH {_M}, {_TREE}, d AS (SELECT * EXCLUDE (position), {_DENSE} FROM m WHERE k % 4 != 0), f AS (SELECT doc_id, source_id, source_index, min(position) AS output_page FROM d GROUP BY 1, 2, 3)
        SELECT t.doc_id, t.node_id, f.output_page FROM t LEFT JOIN f USING (doc_id, source_id, source_index)""",
    "outline_resolve": f"""WITH {_M}, x AS (SELECT CAST(doc_id AS VARCHAR) AS source_id, page_id AS node_id, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 7 <= 5 THEN k % 7 END WHEN k % 3 > 0 THEN k % 5 END AS ref FROM m)
        SELECT source_id, node_id, CAST(CASE WHEN ref <= 3 THEN ref * 10 END AS INTEGER) AS source_index FROM x""",
    "outline_collect": f"""WITH {_M}, f AS (SELECT doc_id, source_id, min(position) AS p FROM m GROUP BY 1, 2), n AS (SELECT DISTINCT CAST(p_partkey % 5 + 1 AS VARCHAR) AS source_id, p_brand AS b FROM part)
        SELECT doc_id, doc_id || '-' || source_id || '-' || b AS node_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p, b) - 1 AS INTEGER) AS sib_index FROM f JOIN n USING (source_id)""",
    "outline_new_nodes": f"""WITH {_M}, d AS (SELECT doc_id, arg_min(source_id, position) AS s FROM m GROUP BY 1)
        SELECT d.doc_id, 'n' || d.doc_id AS node_id, CASE WHEN d.doc_id % 2 = 0 THEN 'own' ELSE 'ページ ' || (d.doc_id % 12 + 1) END AS title, coalesce(m.source_id, s) AS source_id, m.source_index FROM d LEFT JOIN m ON m.doc_id = d.doc_id AND m.position = d.doc_id % 12 + 1""",
    "outline_rename": f"WITH {_M}, {_TREE} SELECT doc_id, node_id, parent_id, sib_index, CASE WHEN n = 3 THEN 'renamed' ELSE title END AS title FROM t",
    "outline_remove": f"""WITH RECURSIVE {_PATHS}, g AS (SELECT t.* FROM t JOIN flat f USING (doc_id, node_id) WHERE t.n != 1 AND NOT EXISTS (SELECT 1 FROM t x WHERE x.doc_id = t.doc_id AND x.n = 1 AND list_contains(f.anc, x.node_id)))
        SELECT doc_id, node_id, parent_id, {_NEW_INDEX}, title FROM g""",
    "outline_add_after": f"""WITH {_M}, {_TREE}, u AS (SELECT doc_id, node_id, parent_id, CAST(sib_index AS DOUBLE) AS sib_index, title FROM t UNION ALL SELECT doc_id, 'new-' || doc_id, parent_id, sib_index + 0.5, 'new' FROM t WHERE n = 3)
        SELECT doc_id, node_id, parent_id, {_NEW_INDEX}, title FROM u""",
    "outline_add_root": f"""WITH {_M}, {_TREE} SELECT doc_id, node_id, parent_id, sib_index, title FROM t UNION ALL SELECT doc_id, 'new-' || doc_id, NULL, CAST(count(*) AS INTEGER), 'new' FROM t WHERE parent_id IS NULL GROUP BY doc_id""",
    "outline_add_child": f"""WITH {_M}, {_TREE} SELECT doc_id, node_id, parent_id, sib_index, title FROM t
        UNION ALL SELECT p.doc_id, 'new-' || p.doc_id, p.node_id, CAST((SELECT count(*) FROM t c WHERE c.doc_id = p.doc_id AND c.parent_id = p.node_id) AS INTEGER), 'new' FROM t p WHERE p.n = 2""",
    "outline_move_up": f"""WITH {_EDIT} SELECT doc_id, node_id, parent_id, CAST(CASE WHEN node_id = g_id AND sib_index > 0 THEN sib_index - 1
        WHEN parent_id IS NOT DISTINCT FROM g_up AND sib_index = g_at - 1 THEN sib_index + 1 ELSE sib_index END AS INTEGER) AS sib_index, title FROM x""",
    "outline_move_down": f"""WITH {_EDIT} SELECT doc_id, node_id, parent_id, CAST(CASE WHEN node_id = g_id AND sib_index < family - 1 THEN sib_index + 1
        WHEN g_id IS NOT NULL AND parent_id IS NOT DISTINCT FROM g_up AND sib_index = g_at + 1 THEN sib_index - 1 ELSE sib_index END AS INTEGER) AS sib_index, title FROM x""",
    "outline_indent": f"""WITH {_EDIT} SELECT doc_id, node_id, CASE WHEN node_id = g_id AND prev_id IS NOT NULL THEN prev_id ELSE parent_id END AS parent_id,
        CAST(CASE WHEN node_id = g_id AND prev_id IS NOT NULL THEN (SELECT count(*) FROM t c WHERE c.doc_id = x.doc_id AND c.parent_id = x.prev_id)
          WHEN prev_id IS NOT NULL AND parent_id IS NOT DISTINCT FROM g_up AND sib_index > g_at THEN sib_index - 1 ELSE sib_index END AS INTEGER) AS sib_index, title FROM x""",
    "outline_outdent": f"""WITH {_EDIT} SELECT doc_id, node_id, CASE WHEN node_id = g_id AND g_up IS NOT NULL THEN top_id ELSE parent_id END AS parent_id,
        CAST(CASE WHEN g_up IS NULL THEN sib_index WHEN node_id = g_id THEN top_at + 1 WHEN parent_id = g_up AND sib_index > g_at THEN sib_index - 1
          WHEN parent_id IS NOT DISTINCT FROM top_id AND sib_index > top_at THEN sib_index + 1 ELSE sib_index END AS INTEGER) AS sib_index, title FROM x""",
    "outline_append": f"""WITH {_M}, {_TREE} SELECT doc_id, node_id, parent_id, sib_index, title FROM t
        UNION ALL SELECT doc_id, 'g' || node_id, 'g' || parent_id, CAST(sib_index + CASE WHEN parent_id IS NULL THEN count(*) FILTER (parent_id IS NULL) OVER (PARTITION BY doc_id) ELSE 0 END AS INTEGER), title FROM t""",
    "outline_apply_modes": f"""WITH {_M}, {_TREE} SELECT doc_id, node_id, parent_id, sib_index, title FROM t WHERE doc_id % 3 != 0
        UNION ALL SELECT doc_id, 'g' || node_id, 'g' || parent_id, CAST(sib_index + CASE WHEN parent_id IS NULL AND doc_id % 3 = 1 THEN count(*) FILTER (parent_id IS NULL) OVER (PARTITION BY doc_id) ELSE 0 END AS INTEGER), title FROM t WHERE doc_id % 3 < 2""",
    "outline_dirty": """SELECT o_custkey AS doc_id, coalesce(max(o_orderkey) FILTER (o_orderkey % 5 != 0 AND o_orderkey % 7 != 0) > coalesce(max(o_orderkey) FILTER (o_orderkey % 5 = 0 OR o_orderkey % 7 = 0), -1), FALSE) AS dirty FROM orders GROUP BY 1""",
    "outline_move_subtree": f"""WITH RECURSIVE {_PATHS}, l AS (SELECT doc_id, list(node_id ORDER BY preorder) AS l FROM flat GROUP BY doc_id),
        a AS (SELECT t.doc_id, t.node_id AS a_id, o.node_id AS o_id, CASE WHEN t.doc_id % 2 = 0 THEN o.node_id ELSE o.parent_id END AS up FROM t JOIN t o ON o.doc_id = t.doc_id AND o.n = o.doc_id % 4 + 1 WHERE t.n = t.doc_id % 3 + 5),
        b AS (SELECT l.doc_id, a_id, up, CASE WHEN a_id IS NULL THEN l ELSE list_concat(list_filter(l, lambda y: y != a_id)[1:list_position(l, o_id) - 1], list_concat([a_id], list_filter(l, lambda y: y != a_id)[list_position(l, o_id):])) END AS l FROM l LEFT JOIN a USING (doc_id)),
        c AS (SELECT t.doc_id, t.node_id, CASE WHEN t.node_id = a_id THEN up ELSE t.parent_id END AS parent_id, t.title, list_position(b.l, t.node_id) AS i FROM t JOIN b USING (doc_id))
        SELECT doc_id, node_id, parent_id, CAST(row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY i) - 1 AS INTEGER) AS sib_index, title FROM c""",
    "history_resolve": f"""WITH RECURSIVE {_STACKS} SELECT user_id AS doc_id, CAST(len(a) AS INTEGER) AS n_applied, CAST(len(u) AS INTEGER) AS n_undone, len(a) > 0 AS can_undo, len(u) > 0 AS can_redo, len(a) > 0 AS is_dirty, len(a) != s AS unsaved FROM l""",
    "manifest_replay": _REPLAY,
    "stream_replay_pages": _REPLAY,
    "history_operations": f"""WITH RECURSIVE {_STACKS}, x AS (SELECT user_id, unnest(list_concat(a, list_reverse(u))) AS seq, unnest(range(1, len(a) + len(u) + 1)) AS place, len(a) AS n FROM l)
        SELECT x.user_id AS doc_id, CAST(place AS INTEGER) AS place, place <= n AS in_force, kind AS type, x.user_id || '-' || event_id % 400 || ',' || x.user_id || '-' || (event_id * 7 + 1) % 400 AS ids
        FROM x JOIN e ON e.user_id = x.user_id AND e.seq = x.seq""",
    "lines_reconstruct": """WITH RECURSIVE w AS (SELECT doc_id, unnest(p) AS str, unnest(range(0, len(p))) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\\s+') AS p FROM documents)),
        t AS (SELECT doc_id AS source_id, CAST(i // 200 AS INTEGER) AS source_index, i % 200 AS k, str, (i % 200) * 7 % 10 * 50 AS x, -(800 - (i % 200) // 10 * 14 + (i % 200) % 3) AS down, (i % 200) % 4 + 10 AS font FROM w),
        m AS (SELECT source_id, source_index, greatest(2, 0.3 * list_sort(list(font))[count(*) // 2 + 1]) AS tol FROM t GROUP BY 1, 2),
        q AS (SELECT t.*, m.tol, row_number() OVER (PARTITION BY source_id, source_index ORDER BY down, k) AS rank FROM t JOIN m USING (source_id, source_index)),
        r AS (SELECT source_id, source_index, rank, down AS anchor, 1 AS g FROM q WHERE rank = 1 UNION ALL
          SELECT q.source_id, q.source_index, q.rank, CASE WHEN abs(q.down - r.anchor) <= q.tol THEN r.anchor ELSE q.down END, CASE WHEN abs(q.down - r.anchor) <= q.tol THEN r.g ELSE r.g + 1 END
          FROM r JOIN q ON q.source_id = r.source_id AND q.source_index = r.source_index AND q.rank = r.rank + 1)
        SELECT source_id, source_index, CAST(g AS INTEGER) AS line_no, md5(string_agg(str, '' ORDER BY x, rank)) AS line FROM r JOIN q USING (source_id, source_index, rank) GROUP BY 1, 2, 3""",
    "search_invalid": """SELECT '(' AS query, TRUE AS invalid, CAST(0 AS BIGINT) AS hits UNION ALL SELECT '[a-', TRUE, 0 UNION ALL SELECT 'a{2', TRUE, 0 UNION ALL SELECT '  ', FALSE, 0
        UNION ALL SELECT 'th+', FALSE, CAST(sum(len(regexp_extract_all(text, '(?i)th+'))) AS BIGINT) FROM conversations
        UNION ALL SELECT 'on[,.]', FALSE, CAST(sum(len(regexp_extract_all(text, '(?i)on[,.]'))) AS BIGINT) FROM conversations""",
    "stream_search_hits": f"WITH {_hits('on')} SELECT doc_id, page, start_ AS start, end_ AS \"end\" FROM hits",
    "files_triage": """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '%PDF-1.' || page_id % 8 ELSE '%PDF-1.7' END AS version, page_id % 5 = 0 AS maybe_encrypted FROM pages""",
    "files_triage_pieces": """SELECT CAST(page_id % 16 AS INTEGER) AS part, CAST(sum(strlen(t) + 1) AS BIGINT) AS length, bool_or(contains(t, '/Encrypt')) AS maybe_encrypted
        FROM (SELECT page_id, coalesce(html, '') || CASE WHEN page_id % 37 = 0 THEN '/Encrypt 3 0 R' ELSE '' END AS t FROM pages) GROUP BY 1""",
    "saved_manifest": f"WITH {_M} SELECT {_COLS} FROM m",
    "saved_split": f"""WITH {_M}, p AS (SELECT *, CAST(1 + sum(CASE WHEN k % 7 = 0 AND position > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY position) AS INTEGER) AS part_no FROM m)
        SELECT {_COLS}, part_no, CAST(row_number() OVER (PARTITION BY doc_id, part_no ORDER BY position) AS INTEGER) AS part_position FROM p""",
    "saved_extract": f"WITH {_M} SELECT * EXCLUDE (k, position), {_DENSE}, 'cust-' || doc_id || '-extract.pdf' AS file_name FROM m WHERE k % 3 = 2",
    "saved_patterns": f"WITH {_PLAIN} SELECT doc_id, page_number, level, title FROM h WHERE level IN (1, 3)",
    "selection_range_anchor": f"WITH {_M}, n AS (SELECT doc_id, count(*) AS n FROM m GROUP BY 1) SELECT doc_id, page_id FROM m JOIN n USING (doc_id) WHERE n >= 4 AND position = CASE WHEN n >= 9 THEN 9 ELSE 4 END",
    "selection_clear": "SELECT DISTINCT o_custkey AS doc_id, CAST(0 AS BIGINT) AS n_selected FROM orders",
    "outline_build": f"""WITH RECURSIVE {_PATHS}, x AS (SELECT CAST(doc_id AS VARCHAR) AS source_id, page_id AS node_id, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 7 <= 5 THEN k % 7 END WHEN k % 3 > 0 THEN k % 5 END AS ref FROM m)
        SELECT source_id, x.node_id, parent_id, depth, preorder, CAST(CASE WHEN ref <= 3 THEN ref * 10 END AS INTEGER) AS source_index FROM x JOIN flat f ON CAST(f.doc_id AS VARCHAR) = x.source_id AND f.node_id = x.node_id""",
    "outline_to_build": f"""WITH RECURSIVE {_PATHS} SELECT f.doc_id, depth, preorder, 't' || f.node_id AS title, CAST(f.doc_id AS VARCHAR) AS source_id,
        CAST(CASE WHEN m.k % 2 = 0 THEN CASE WHEN m.k % 7 <= 3 THEN m.k % 7 * 10 END WHEN m.k % 3 > 0 AND m.k % 5 <= 3 THEN m.k % 5 * 10 END AS INTEGER) AS source_index FROM flat f JOIN m ON m.doc_id = f.doc_id AND m.page_id = f.node_id""",
}

"""The comparison SQL of each registered query, in DuckDB's dialect, over the same whole tables."""

from __future__ import annotations

from rankintel.functions.jsonld import LEAF_LIMIT
from rankintel.operators.intel import INSIGHTS, SUMMARIES
from rankintel.plans.bindings import LINK_SITE, METAL_OF_TYPE, OUR_REGION
from rankintel.plans.catalog import CUT, EVENT_CUT, OUR_SITES, TEXT_RULES

_METAL = "CASE " + " ".join(f"WHEN p_type = '{k}' THEN '{m}'" for k, m in METAL_OF_TYPE.items()) + " ELSE '' END"
_PART_URL = "'https://www.' || lower(replace(p_brand, '#', '-')) || '.example.com/p/' || p_partkey"
_SPACE = r"[\s\p{Z}\x{85}\x{0B}\x{1C}-\x{1F}]"


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _squeeze(text: str) -> str:
    return rf"regexp_replace({text}, '{_SPACE}+', ' ', 'g')"


# Views, each usable by those after it.
VIEWS = {
    "result_rows": """
        SELECT o_custkey AS query, l_linenumber AS position, l_partkey AS url, o_orderdate AS scraped_at,
               l_orderkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag, l_linestatus
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "ranked_rows": """
        SELECT *, row_number() OVER (PARTITION BY query, position ORDER BY scraped_at DESC, l_orderkey DESC,
                    url DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC, l_returnflag DESC,
                    l_linestatus DESC) AS rn
        FROM result_rows""",
    "serp": """
        SELECT query, position, url, p_name AS title, scraped_at
        FROM ranked_rows JOIN part ON url = p_partkey WHERE rn = 1""",
    "shop_serp": """
        SELECT query, position, url, p_name AS title, scraped_at, l_extendedprice AS price_usd, l_returnflag AS shop,
               CAST(l_quantity AS INTEGER) AS reviews, l_linestatus = 'F' AS star_seller
        FROM ranked_rows JOIN part ON url = p_partkey WHERE rn = 1""",
    "web": f"""
        SELECT query, position, {_PART_URL} AS url, lower(replace(p_brand, '#', '-')) || '.example.com' AS domain,
               p_partkey, p_name AS title, scraped_at, l_orderkey
        FROM result_rows JOIN part ON url = p_partkey""",
    "classes": f"""
        SELECT p_partkey AS url, {_METAL} AS metal_type, p_brand AS karat, lang AS base_metal,
               p_retailprice AS price_usd, text AS evidence,
               CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS confidence, ts AS classified_at
        FROM part JOIN documents d ON p_partkey = d.doc_id JOIN labels b ON b.doc_id = d.doc_id
                  JOIN events ON event_id = p_partkey""",
    "b_pages": "SELECT doc_id AS url, source || ' ' || lang AS page_title FROM documents",
    "listings": f"""
        SELECT p_partkey AS url, CASE WHEN toxic = 1 THEN '' ELSE p_name || ' listing' END AS title,
               CASE WHEN quality = 1 THEN p_retailprice ELSE 0 END AS price_usd, p_brand AS shop,
               [p_type, p_brand] AS materials, string_split(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), ' ') AS tags,
               p_size AS favorites, {_METAL} AS metal_type, lang AS karat,
               CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS confidence
        FROM part JOIN documents d ON p_partkey = d.doc_id JOIN labels b ON b.doc_id = d.doc_id""",
    "snap_res": f"""
        SELECT snapshot_id, position, url, domain, is_ours FROM (
          SELECT l_orderkey AS snapshot_id, l_linenumber AS position, l_partkey AS url, s_name AS domain,
                 n_regionkey = {OUR_REGION} AS is_ours,
                 row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                   ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
        WHERE rn = 1""",
    "snaps": """
        SELECT o_orderkey AS snapshot_id, o_custkey AS query, o_orderpriority AS query_grp, o_orderdate AS scraped_at,
               CAST(o_orderdate AS DATE) AS run_date, our_position, COALESCE(total_results, 0) AS total_results
        FROM orders LEFT JOIN (
          SELECT snapshot_id, MIN(CASE WHEN is_ours THEN position END) AS our_position, COUNT(*) AS total_results
          FROM snap_res GROUP BY 1) r ON r.snapshot_id = o_orderkey""",
    "prod_snaps": """
        SELECT event_id AS id, user_id AS product_id, ts AS scraped_at, CAST(ts AS DATE) AS run_date, value AS price_usd,
               event_type AS metal_type, props AS description
        FROM events""",
    "competitors": """
        SELECT s_suppkey AS competitor_id, s_name AS domain, n_name AS name
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "comp_products": """
        SELECT l_partkey AS product_id, l_partkey AS url, MIN(l_suppkey) AS competitor_id,
               MIN(l_shipdate) AS first_seen_at, MAX(l_shipdate) AS last_scraped_at
        FROM lineitem GROUP BY l_partkey""",
    "our_products": """
        SELECT c_custkey AS handle, 'https://brand-' || (c_nationkey + 1) || '.example.com/' AS our_url,
               'brand-' || (c_nationkey + 1) || '.example.com' AS our_domain,
               [c_mktsegment, c_mktsegment || ' ' || c_nationkey, c_name] AS queries
        FROM customer""",
    "listed": """
        SELECT handle, our_url, unnest(queries) AS query, generate_subscripts(queries, 1) - 1 AS pos FROM our_products""",
    "runs": "SELECT DISTINCT run_date FROM snaps",
    "calendar": """
        SELECT run_date, lag(run_date) OVER (ORDER BY run_date) AS prev_run_date FROM runs""",
    "newest_two": """
        SELECT run_date AS cur, prev_run_date AS prev FROM calendar ORDER BY run_date DESC LIMIT 1""",
    "tops": """
        SELECT DISTINCT run_date, query_grp AS query, domain FROM snaps JOIN snap_res USING (snapshot_id)
        WHERE position <= 5 AND NOT is_ours AND domain <> ''""",
    "positions": """
        SELECT query, run_date, our_position FROM (
          SELECT query_grp AS query, run_date, our_position, row_number() OVER (
            PARTITION BY query_grp, run_date ORDER BY scraped_at DESC, snapshot_id DESC) AS rn FROM snaps)
        WHERE rn = 1""",
    "all_shifts": """
        SELECT * FROM (
          SELECT run_date, prev_run_date, query, prev_pos, curr_pos,
            CASE WHEN curr_pos IS NULL AND prev_pos IS NULL THEN NULL
                 WHEN prev_pos IS NULL THEN 'entered results' WHEN curr_pos IS NULL THEN 'dropped from results'
                 WHEN abs(curr_pos - prev_pos) < 3 THEN NULL
                 WHEN curr_pos < prev_pos THEN 'improved' ELSE 'dropped' END AS direction
          FROM (
            SELECT c.run_date, c.prev_run_date, q.query, a.our_position AS curr_pos, b.our_position AS prev_pos
            FROM calendar c CROSS JOIN (SELECT DISTINCT query FROM positions) q
            LEFT JOIN positions a ON a.run_date = c.run_date AND a.query = q.query
            LEFT JOIN positions b ON b.run_date = c.prev_run_date AND b.query = q.query
            WHERE c.prev_run_date IS NOT NULL)) WHERE direction IS NOT NULL""",
    "all_changes": """
        SELECT c.run_date, c.prev_run_date, 'entrant' AS change, t.query, t.domain
        FROM calendar c JOIN tops t ON t.run_date = c.run_date
        WHERE c.prev_run_date IS NOT NULL AND NOT EXISTS (
          SELECT 1 FROM tops p WHERE p.run_date = c.prev_run_date AND p.query = t.query AND p.domain = t.domain)
        UNION ALL
        SELECT c.run_date, c.prev_run_date, 'dropout', t.query, t.domain
        FROM calendar c JOIN tops t ON t.run_date = c.prev_run_date
        WHERE NOT EXISTS (
          SELECT 1 FROM tops p WHERE p.run_date = c.run_date AND p.query = t.query AND p.domain = t.domain)""",
    "price_days": """
        SELECT max(run_date) AS cur,
               (SELECT max(run_date) FROM prod_snaps WHERE run_date < (SELECT max(run_date) FROM prod_snaps)) AS prev
        FROM prod_snaps""",
    "moves": """
        SELECT url, old_price, new_price, (new_price - old_price) / old_price * 100 AS pct, COUNT(*) AS n_pairs
        FROM (
          SELECT cp.url, b.price_usd AS old_price, a.price_usd AS new_price
          FROM comp_products cp, price_days d, prod_snaps a, prod_snaps b
          WHERE a.product_id = cp.product_id AND b.product_id = cp.product_id AND a.run_date = d.cur
            AND b.run_date = d.prev AND a.price_usd > 0 AND b.price_usd > 0)
        WHERE abs(new_price - old_price) / old_price > 0.15 GROUP BY url, old_price, new_price""",
    "change_cells": """
        SELECT product_id AS url, scraped_at, id, unnest(['metal_type', 'description', 'price_usd']) AS field,
               unnest([metal_type, description, CAST(price_usd AS VARCHAR)]) AS val
        FROM prod_snaps""",
    "change_log": """
        SELECT url, field, old_value, new_value, detected_at FROM (
          SELECT url, field, lag(val) OVER w AS old_value, val AS new_value, scraped_at AS detected_at,
                 row_number() OVER w AS rn
          FROM change_cells WINDOW w AS (PARTITION BY url, field ORDER BY scraped_at, id))
        WHERE rn = 1 OR old_value IS DISTINCT FROM new_value""",
    "flags": """
        SELECT id, product_id, scraped_at, price_usd, metal_type, description,
               COALESCE(abs(price_usd - lag(price_usd) OVER w) > 0.01, false) AS price_changed,
               COALESCE(trim(description) <> '' AND trim(lag(description) OVER w) <> ''
                 AND substr(trim(description), 1, 200) <> substr(trim(lag(description) OVER w), 1, 200), false)
                 AS description_changed
        FROM prod_snaps WINDOW w AS (PARTITION BY product_id ORDER BY scraped_at, id)""",
    "owned": """
        SELECT cp.product_id, cp.url, c.domain FROM comp_products cp JOIN competitors c USING (competitor_id)""",
    "newest_snap": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY scraped_at DESC, id DESC) AS rn
          FROM flags) WHERE rn = 1""",
    "intel": """
        SELECT s.query, s.position, s.url, COALESCE(NULLIF(p.page_title, ''), NULLIF(s.title, ''), '') AS page_title,
               COALESCE(NULLIF(c.metal_type, ''), 'unknown') AS metal_type,
               COALESCE(NULLIF(c.karat, ''), 'unknown') AS karat,
               COALESCE(NULLIF(c.base_metal, ''), 'unknown') AS base_metal, c.price_usd,
               substr(COALESCE(c.evidence, ''), 1, 120) AS evidence,
               COALESCE(NULLIF(c.confidence, ''), 'unknown') AS confidence
        FROM serp s LEFT JOIN b_pages p ON p.url = s.url LEFT JOIN classes c ON c.url = s.url""",
    "counts": "SELECT metal_type, COUNT(*) AS n FROM intel GROUP BY 1",
    "shares": "SELECT metal_type, n, round_even(n / (SELECT SUM(n) FROM counts) * 100, 1) AS pct FROM counts",
    "pairs": """
        SELECT doc_id, lang, source, text, n_chars, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
        FROM documents""",
    "facts": """
        SELECT 'https://www.etsy.com/listing/' || doc_id || '/item' AS url, source AS title,
               CASE WHEN lang <> 'fr' THEN substr(NULLIF(text, ''), 1, 500) END AS description,
               CAST(n_chars + CASE WHEN lang = 'fr' THEN 0.75 ELSE 0.25 END AS DOUBLE) AS price_usd,
               CASE WHEN lang <> 'fr' THEN lang END AS shop, 'gold,silver' AS materials,
               source || ',' || lang AS tags, CAST(NULL AS INTEGER) AS reviews, CAST(n_chars AS INTEGER) AS favorites, doc_id
        FROM documents""",
}


def _with(sql: str) -> str:
    """Prefix the views a statement needs, following their own needs, in definition order."""

    def mentions(text: str, name: str) -> bool:
        return any(name == word for word in "".join(c if c.isalnum() or c == "_" else " " for c in text).split())

    needed: set[str] = set()
    for name in reversed(VIEWS):
        if mentions(sql, name) or any(mentions(VIEWS[other], name) for other in needed):
            needed.add(name)
    parts = [f"{name} AS ({body.strip()})" for name, body in VIEWS.items() if name in needed]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql


_RULE_CASE = "CASE " + " ".join(
    f"WHEN regexp_matches({{text}}, '{pattern}') THEN '{label}'" for label, pattern in TEXT_RULES
) + " ELSE 'unknown' END"

_DOMAIN = (
    "replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), 'www.', '')"
)

_BODY = (
    "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), "
    "'(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
)
_TITLE = _strip("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")

_LABELLED_URLS = "SELECT DISTINCT w.url FROM web w JOIN classes c ON c.url = w.p_partkey"
_UNCLASSIFIED = f"""
    SELECT url, MAX(scraped_at) AS scraped_at FROM web
    WHERE url NOT ILIKE '%BRAND-3.example.com%' AND url NOT IN ({_LABELLED_URLS}) GROUP BY url"""


def _printf(sentences: dict[str, str], code: str, values: list[str]) -> str:
    """CASE over summary codes: '%1$d' style placeholders become concatenated values."""
    arms = []
    for name, sentence in sentences.items():
        text = sentence.replace("'", "''").replace("%%", "%")
        for n, value in enumerate(values, start=1):
            for kind in "ds":
                text = text.replace(f"%{n}${kind}", f"' || {value} || '")
        arms.append(f"WHEN {code} = '{name}' THEN '{text}'")
    return "CASE " + " ".join(arms) + " END"


def _snapshots(run: str) -> str:
    """Headers of build_snapshots, with or without the run date in the key."""
    cols = "r.query, r.run_date" if run else "r.query"
    shown = "r.query, CAST(r.run_date AS VARCHAR) AS run_date" if run else "r.query"
    return f"""
        SELECT {shown}, p.handle AS our_handle, p.our_url,
               MIN(CASE WHEN r.domain = p.our_domain THEN r.position END) AS our_position,
               CAST(COUNT(*) AS INTEGER) AS total_results
        FROM (SELECT *, CAST(scraped_at AS DATE) AS run_date FROM web) r
        LEFT JOIN our_products p ON p.handle = r.query GROUP BY {cols}, p.handle, p.our_url"""


_DIGEST = """
    SELECT section, CAST(rank AS INTEGER) AS rank, icon, subject, detail, section_total, greatest(section_total - 10, 0) AS overflow FROM (
      SELECT section, icon, subject, detail, k0, k1, k2,
             CAST(SUM(size) OVER (PARTITION BY section) AS BIGINT) AS section_total,
             row_number() OVER (PARTITION BY section ORDER BY k0, k1, k2) AS rank
      FROM (
        SELECT 'entrants' AS section, '🆕' AS icon, domain AS subject, query AS detail, 1 AS size, 0.0 AS k0, query AS k1,
               domain AS k2
        FROM all_changes, newest_two WHERE run_date = cur AND change = 'entrant'
        UNION ALL
        SELECT 'dropouts', '👋', domain, query, 1, 0.0, query, domain
        FROM all_changes, newest_two WHERE run_date = cur AND change = 'dropout'
        UNION ALL
        SELECT 'price_changes', CASE WHEN pct > 0 THEN '⬆️' ELSE '⬇️' END, CAST(url AS VARCHAR), said, n_pairs,
               -abs(pct), CAST(url AS VARCHAR), said
        FROM (SELECT *, '$' || CAST(round_even(old_price, 0) AS BIGINT) || '→$' || CAST(round_even(new_price, 0) AS BIGINT)
                || ' (' || CASE WHEN round_even(pct, 0) >= 0 THEN '+' ELSE '' END || CAST(round_even(pct, 0) AS BIGINT)
                || '%)' AS said FROM moves)
        UNION ALL
        SELECT 'pos_shifts', CASE WHEN direction IN ('improved', 'entered results') THEN '🟢' ELSE '🔴' END, query,
               '#' || COALESCE(CAST(NULLIF(prev_pos, 0) AS VARCHAR), '—') || '→#'
               || COALESCE(CAST(NULLIF(curr_pos, 0) AS VARCHAR), '—'), 1, 0.0, query, ''
        FROM all_shifts, newest_two WHERE run_date = cur))
    WHERE rank <= 10"""

_CHANGE_PAGE = """
    SELECT c.url, COALESCE(page_title, '') AS page_title, field, old_value, new_value, detected_at
    FROM change_log c LEFT JOIN b_pages p ON p.url = c.url"""

_RESULT_LABELS = """
    COALESCE(NULLIF(l.metal_type, ''), '{missing}') AS metal_type, COALESCE(l.karat, '') AS karat,
    COALESCE(l.confidence, '') AS confidence"""

_MARKET = f"""
    SELECT s.query, s.position, s.url, COALESCE(NULLIF(l.title, ''), NULLIF(s.title, ''), '') AS title,
           COALESCE(NULLIF(l.price_usd, 0), s.price_usd) AS price_usd,
           COALESCE(NULLIF(l.shop, ''), NULLIF(s.shop, ''), '') AS shop, s.reviews, l.favorites, s.star_seller,
           {_RESULT_LABELS.format(missing='not_classified')},
           COALESCE(array_to_string(l.materials, ','), '') AS materials,
           COALESCE(array_to_string(l.tags[1:10], ','), '') AS tags
    FROM shop_serp s LEFT JOIN listings l ON l.url = s.url"""

_CONTEXT = """
    SELECT c.metal_type, c.karat, c.base_metal, c.price_usd, c.evidence, p.page_title, s.query, s.position, s.url
    FROM serp s JOIN b_pages p ON p.url = s.url JOIN classes c ON c.url = s.url"""

SQL: dict[str, str] = {
    "upsert_replace": "SELECT query, position, url, scraped_at, l_suppkey FROM ranked_rows WHERE rn = 1",
    "upsert_replace_multi": """
        SELECT url, listing_id, scraped_at, id, price_usd FROM (
          SELECT *, row_number() OVER (PARTITION BY url ORDER BY scraped_at DESC, id DESC) AS by_url,
                 row_number() OVER (PARTITION BY listing_id ORDER BY scraped_at DESC, id DESC) AS by_listing
          FROM (SELECT product_id AS url, scraped_at, id, price_usd,
                  CASE WHEN metal_type <> 'error' THEN CAST(floor(price_usd * 10) AS BIGINT) END AS listing_id
                FROM prod_snaps))
        WHERE by_url = 1 AND (listing_id IS NULL OR by_listing = 1)""",
    "upsert_update": f"""
        SELECT COALESCE(b.handle, a.handle) AS handle, COALESCE(b.updated_at, a.updated_at) AS updated_at,
               COALESCE(a.ordinal, b.ordinal) AS ordinal, COALESCE(b.title, a.title) AS title,
               COALESCE(a.views, b.views) AS views
        FROM (SELECT o_custkey AS handle, arg_max(o_orderdate, (o_orderdate, o_orderkey)) AS updated_at,
                     arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS ordinal,
                     arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS title,
                     arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS views
              FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}' GROUP BY 1) a
        FULL JOIN (SELECT o_custkey AS handle, arg_max(o_orderdate, (o_orderdate, o_orderkey)) AS updated_at,
                     arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS ordinal,
                     arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS title,
                     arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS views
              FROM orders WHERE o_orderdate >= TIMESTAMP '{CUT}' GROUP BY 1) b ON a.handle = b.handle""",
    "insert_ignore": """
        SELECT url, l_suppkey, scraped_at, l_orderkey, l_extendedprice FROM (
          SELECT *, row_number() OVER (PARTITION BY url, l_suppkey ORDER BY scraped_at, l_orderkey, l_extendedprice) AS nth
          FROM result_rows) WHERE nth = 1""",
    "touch_last_scraped": """
        SELECT product_id, url, competitor_id, first_seen_at, COALESCE(seen, last_scraped_at) AS last_scraped_at
        FROM comp_products LEFT JOIN (SELECT product_id, MAX(scraped_at) AS seen FROM prod_snaps GROUP BY 1)
        USING (product_id)""",
    "read_pages": f"""
        SELECT url, {_TITLE} AS page_title, md5(substr(html, 1, 50000)) AS html_md5,
               TIMESTAMP '2024-01-01' AS scraped_at
        FROM pages WHERE length(html) > 0""",
    "ranked_links": f"""
        SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY first_at) AS INTEGER) AS position, url, title,
               '' AS snippet
        FROM (SELECT doc_id AS query, '{LINK_SITE}' || md5(line) AS url, MIN(i) AS first_at,
                     MIN({_strip('line')}) AS title
              FROM pairs WHERE {_strip('line')} <> '' GROUP BY 1, 2)
        QUALIFY row_number() OVER (PARTITION BY query ORDER BY first_at) <= 10""",
    "marketplace_results": f"""
        SELECT query, CAST(CASE WHEN lang = 'de' THEN seq WHEN i = 0 THEN seq ELSE i END AS INTEGER) AS position,
               CAST(size AS VARCHAR) AS listing_id, 'https://www.etsy.com/listing/' || size || '/x' AS url,
               CASE WHEN lang <> 'de' THEN line
                    WHEN length({_strip('trim(line)')}) BETWEEN 10 AND 200 THEN {_strip("replace(trim(line), '<', '(')")}
                    ELSE '' END AS title,
               CAST(size + 0.5 AS DOUBLE) AS price_usd, false AS star_seller, CAST(seq AS INTEGER) AS seq
        FROM (SELECT doc_id AS query, lang, line, i, length(line) AS size,
                     row_number() OVER (PARTITION BY doc_id ORDER BY i) AS seq
              FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, length(line) ORDER BY i) AS nth FROM pairs)
              WHERE nth = 1)
        WHERE seq <= 48""",
    "fix_zero_positions": """
        SELECT query, url, CASE WHEN position = 1 THEN 1 ELSE position - 1 END AS position, position AS seq FROM serp""",
    "html_to_text": f"""
        SELECT page_id, substr({_squeeze("array_to_string(list_filter(parts, lambda x: " + _strip('x') + " <> ''), ' | ')")}, 1, 8000) AS page_text
        FROM (SELECT page_id, CASE WHEN length(title) < 100 THEN [title, substr({_squeeze('body')}, 1, 3000)] ELSE [title] END AS parts
              FROM (SELECT page_id, {_TITLE} AS title, {_BODY} AS body FROM pages))""",
    "jsonld_leaves": f"""
        SELECT doc_id, 0 AS block, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part_no, i) - 1 AS INTEGER) AS seq, key, value
        FROM (
          SELECT doc_id, 0 AS part_no, 0 AS i, '@type' AS key, 'Article' AS value FROM documents
          UNION ALL SELECT doc_id, 1, i, 'body', {_strip('line')} FROM pairs
          UNION ALL SELECT doc_id, 2, 0, 'n', CAST(n_chars AS VARCHAR) FROM documents
          UNION ALL SELECT doc_id, 3, 0, 'lang', lang FROM documents
          UNION ALL SELECT doc_id, 4, 0, 'ok', 'True' FROM documents)
        WHERE length(value) BETWEEN 1 AND {LEAF_LIMIT - 1}""",
    "listing_metadata": "SELECT * EXCLUDE (doc_id) FROM facts",
    "classification_text": """
        SELECT url, substr('Title: ' || title || COALESCE(' | Description: ' || description, '')
                 || ' | Materials: gold, silver | Tags: ' || replace(tags, ',', ', '), 1, 8000) AS page_text
        FROM facts""",
    "listing_row": """
        SELECT CAST(doc_id AS VARCHAR) AS listing_id, url, title, price_usd, shop, materials, tags, reviews, favorites,
               'unknown' AS metal_type, '14k' AS karat, 'low' AS confidence, TIMESTAMP '2024-01-01' AS scraped_at
        FROM facts""",
    "parse_model_json": """
        SELECT doc_id, CASE WHEN bad THEN 'unknown' ELSE 'vermeil' END AS metal_type,
               CASE WHEN bad THEN 'unknown' ELSE '14k' END AS karat, 'unknown' AS base_metal,
               CASE WHEN NOT bad THEN CAST(n_chars AS DOUBLE) END AS price_usd, CAST(NULL AS VARCHAR) AS price_raw,
               CASE WHEN bad THEN '' ELSE source END AS title, CASE WHEN bad THEN '' ELSE text END AS description,
               '' AS materials, 'unknown' AS availability,
               CASE WHEN bad THEN 'fallback: JSON parse error' ELSE '' END AS evidence,
               CASE WHEN bad THEN 'low' ELSE 'high' END AS confidence, true AS in_vocabulary
        FROM (SELECT *, lang = 'de' AS bad FROM documents)""",
    "page_guard": """
        SELECT page_id, CASE WHEN length(html) < 2000 THEN 'empty page (' || length(html) || ' chars)' END AS fallback_reason
        FROM pages""",
    "rule_labels": f"SELECT doc_id, {_RULE_CASE.format(text='text')} AS label FROM documents",
    "classify_products": f"""
        SELECT doc_id, metal_type, karat, base_metal,
               CASE WHEN metal_type = 'unknown' THEN 'low' WHEN karat = 'unknown' THEN 'medium' ELSE 'high' END AS confidence
        FROM (SELECT doc_id, {_RULE_CASE.format(text='t')} AS metal_type,
                CASE WHEN regexp_matches(t, '(?i)\\b9\\s*-?\\s*k(t|arat)?\\b') THEN '9k'
                     WHEN regexp_matches(t, '(?i)\\b10\\s*-?\\s*k(t|arat)?\\b') THEN '10k'
                     WHEN regexp_matches(t, '(?i)\\b14\\s*-?\\s*k(t|arat)?\\b') THEN '14k'
                     WHEN regexp_matches(t, '(?i)\\b18\\s*-?\\s*k(t|arat)?\\b') THEN '18k'
                     WHEN regexp_matches(t, '(?i)\\b24\\s*-?\\s*k(t|arat)?\\b') THEN '24k' ELSE 'unknown' END AS karat,
                CASE WHEN regexp_matches(t, '(?i)\\bsterling\\s+silver\\b|\\b925\\b') THEN 'sterling_silver'
                     WHEN regexp_matches(t, '(?i)\\bbrass\\b') THEN 'brass'
                     WHEN regexp_matches(t, '(?i)\\bcopper\\b') THEN 'copper'
                     WHEN regexp_matches(t, '(?i)\\bgold\\b') THEN 'gold' ELSE 'unknown' END AS base_metal
              FROM (SELECT doc_id, {_squeeze('text')} AS t FROM documents))""",
    "classify_products_custom": """
        SELECT doc_id, CASE WHEN length(text) > 1000 THEN 'vermeil' ELSE 'unknown' END AS metal_type,
               'unknown' AS karat, length(text) / 4 AS price_usd, 'low' AS confidence
        FROM documents""",
    "url_domain": f"SELECT page_id, url, {_DOMAIN} AS domain FROM pages",
    "keyword_queries": """
        SELECT query, item, pos FROM (
          SELECT query, handle AS item, CAST(pos AS INTEGER) AS pos,
                 row_number() OVER (PARTITION BY query ORDER BY handle, pos) AS nth FROM listed) WHERE nth = 1""",
    "query_product_map": """
        SELECT query, arg_max(handle, handle) AS our_handle, arg_max(our_url, handle) AS our_url FROM listed GROUP BY query""",
    "competitor_registry": """
        SELECT domain, MIN(scraped_at) AS first_seen_at, MAX(scraped_at) AS updated_at
        FROM snap_res JOIN snaps USING (snapshot_id) WHERE NOT is_ours GROUP BY domain""",
    "competitor_product_registry": """
        SELECT url, arg_min(domain, (scraped_at, domain)) AS domain, MIN(scraped_at) AS first_seen_at
        FROM snap_res JOIN snaps USING (snapshot_id) WHERE NOT is_ours GROUP BY url""",
    "build_snapshots": _snapshots(""),
    "build_snapshots_per_run": _snapshots("run_date"),
    "build_snapshot_results": f"""
        SELECT l_orderkey AS snapshot_id, position, url, title, domain,
               domain IN ({', '.join("'" + d.replace('www.', '') + "'" for d in OUR_SITES)}) AS is_ours
        FROM web""",
    "select_uncrawled": "SELECT DISTINCT url FROM serp WHERE url NOT IN (SELECT url FROM b_pages)",
    "select_unclassified": _UNCLASSIFIED,
    "select_unclassified_newest": _UNCLASSIFIED + " ORDER BY scraped_at DESC, url LIMIT 50",
    "select_unscraped_listings": "SELECT DISTINCT url FROM shop_serp WHERE url NOT IN (SELECT url FROM listings)",
    "delta_log": "SELECT url, field, old_value, new_value, detected_at FROM change_log",
    "detect_deltas": """
        SELECT c.url, c.field, l.new_value AS old_value, c.val AS new_value, TIMESTAMP '2024-03-01' AS detected_at
        FROM (SELECT url, unnest(['metal_type', 'karat', 'price_usd']) AS field,
                     unnest([metal_type, karat, CAST(price_usd AS VARCHAR)]) AS val FROM classes) c
        LEFT JOIN (
          SELECT * FROM (SELECT url, CASE WHEN field = 'description' THEN 'karat' ELSE field END AS field, new_value,
                   row_number() OVER (PARTITION BY url, field ORDER BY detected_at DESC) AS rn FROM change_log)
          WHERE rn = 1) l ON l.url = c.url AND l.field = c.field
        WHERE l.url IS NULL OR l.new_value IS DISTINCT FROM c.val""",
    "snapshot_change_flags": """
        SELECT id, product_id, price_changed, description_changed, substr(description, 1, 300) AS description
        FROM flags WHERE product_id IN (SELECT product_id FROM comp_products)""",
    "recent_runs": "SELECT CAST(run_date AS VARCHAR) AS run_date FROM runs ORDER BY 1 DESC LIMIT 2",
    "top_n_domains": "SELECT CAST(run_date AS VARCHAR) AS run_date, query, domain FROM tops",
    "entrants": "SELECT query, domain FROM all_changes, newest_two WHERE run_date = cur AND change = 'entrant'",
    "dropouts": "SELECT query, domain FROM all_changes, newest_two WHERE run_date = cur AND change = 'dropout'",
    "our_positions": "SELECT query, CAST(run_date AS VARCHAR) AS run_date, our_position FROM positions",
    "position_shifts": "SELECT query, prev_pos, curr_pos, direction FROM all_shifts, newest_two WHERE run_date = cur",
    "price_moves": "SELECT url, old_price, new_price, pct, n_pairs FROM moves",
    "price_move_ranges": """
        SELECT url, CAST(SUM(n_pairs) AS BIGINT) AS n_pairs, arg_max(old_price, (abs(pct), pct)) AS old_price,
               arg_max(new_price, (abs(pct), pct)) AS new_price, arg_max(pct, (abs(pct), pct)) AS pct,
               arg_max(pct, (-abs(pct), pct)) AS smallest_pct
        FROM moves GROUP BY url""",
    "price_moves_latest": """
        SELECT url, old_price, new_price, (new_price - old_price) / old_price * 100 AS pct, CAST(1 AS BIGINT) AS n_pairs
        FROM (SELECT product_id, arg_max(price_usd, (scraped_at, id)) AS new_price FROM prod_snaps, price_days
              WHERE run_date = cur AND price_usd > 0 GROUP BY 1)
        JOIN (SELECT product_id, arg_max(price_usd, (scraped_at, id)) AS old_price FROM prod_snaps, price_days
              WHERE run_date = prev AND price_usd > 0 GROUP BY 1) USING (product_id)
        JOIN comp_products USING (product_id)
        WHERE abs(new_price - old_price) / old_price > 0.15""",
    "run_diffs": """
        SELECT CAST(run_date AS VARCHAR) AS run_date, CAST(prev_run_date AS VARCHAR) AS prev_run_date, change, query, domain,
               prev_pos, curr_pos, direction
        FROM (
          SELECT run_date, prev_run_date, change, query, domain, CAST(NULL AS INTEGER) AS prev_pos,
                 CAST(NULL AS INTEGER) AS curr_pos, CAST(NULL AS VARCHAR) AS direction FROM all_changes
          UNION ALL
          SELECT run_date, prev_run_date, 'shift', query, NULL, prev_pos, curr_pos, direction FROM all_shifts)""",
    "digest": _DIGEST,
    "db_stats": """
        SELECT (SELECT COUNT(*) FROM serp) AS serp_results, (SELECT COUNT(DISTINCT query) FROM serp) AS keywords_count,
               (SELECT COUNT(*) FROM b_pages) AS product_pages, (SELECT COUNT(*) FROM classes) AS classifications,
               (SELECT MAX(classified_at) FROM classes) AS last_classified_at""",
    "label_histogram": "SELECT metal_type, COUNT(*) AS n FROM classes GROUP BY 1",
    "covered_queries": "SELECT DISTINCT query FROM serp",
    "competitor_intel": "SELECT * FROM intel",
    "competitor_intel_top": "SELECT * FROM intel ORDER BY query, position LIMIT 15",
    "competitor_intel_per_query": """
        SELECT * FROM intel QUALIFY row_number() OVER (PARTITION BY query ORDER BY position) <= 3""",
    "keyword_coverage": """
        SELECT c_custkey AS ordinal, c_custkey AS keyword, c_custkey IN (SELECT query FROM serp) AS found FROM customer""",
    "metal_summary": "SELECT metal_type, n FROM counts",
    "insight": f"""
        SELECT *, {_printf(INSIGHTS, 'insight_code', ['plated', 'vermeil', 'solid', 'total'])} AS insight FROM (
          SELECT *, CASE WHEN total = 0 THEN 'no_data' WHEN solid = 0 THEN 'none_solid'
                   WHEN solid <= total * 0.25 THEN 'few_solid' ELSE 'many_solid' END AS insight_code
          FROM (SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE metal_type = 'solid_gold') AS solid,
                  COUNT(*) FILTER (WHERE metal_type IN ('gold_plated', 'gold_filled')) AS plated,
                  COUNT(*) FILTER (WHERE metal_type = 'vermeil') AS vermeil FROM intel))""",
    "metal_breakdown": "SELECT metal_type, n, pct FROM shares",
    "metal_breakdown_by_query": """
        SELECT query, metal_type, COUNT(*) AS n FROM (
          SELECT * FROM intel QUALIFY row_number() OVER (PARTITION BY query ORDER BY position) <= 5) GROUP BY 1, 2""",
    "metal_breakdown_by_query_all": """
        SELECT query, metal_type, COUNT(*) AS n FROM intel GROUP BY 1, 2""",
    "breakdown_summary": f"""
        SELECT *, {_printf(SUMMARIES, 'summary_code', ['solid_pct', 'plated_vermeil_pct'])} AS summary FROM (
          SELECT *, CASE WHEN solid_pct = 0 THEN 'none_solid' WHEN solid_pct < 25 THEN 'few_solid'
                   WHEN solid_pct < 50 THEN 'some_solid' ELSE 'many_solid' END AS summary_code
          FROM (SELECT COALESCE(MAX(pct) FILTER (WHERE metal_type = 'solid_gold'), 0) AS solid_pct,
                  COALESCE(MAX(pct) FILTER (WHERE metal_type = 'gold_plated'), 0)
                  + COALESCE(MAX(pct) FILTER (WHERE metal_type = 'gold_filled'), 0)
                  + COALESCE(MAX(pct) FILTER (WHERE metal_type = 'vermeil'), 0) AS plated_vermeil_pct FROM shares))""",
    "keyword_context": _CONTEXT,
    "keyword_context_top": _CONTEXT + " ORDER BY s.position, s.query, s.url LIMIT 15",
    "list_serp_results": f"""
        SELECT query, position, url, title, snippet, classified, metal_type, karat, confidence, total, total > 5 AS has_more
        FROM (SELECT s.query, s.position, s.url, s.title, '' AS snippet, l.metal_type IS NOT NULL AS classified,
                {_RESULT_LABELS.format(missing='not classified')},
                COUNT(*) OVER (PARTITION BY s.query) AS total,
                row_number() OVER (PARTITION BY s.query ORDER BY s.position) AS nth
              FROM serp s LEFT JOIN classes l ON l.url = s.url)
        WHERE nth BETWEEN 3 AND 5""",
    "list_serp_results_all": f"""
        SELECT query, position, url, title, snippet, classified, metal_type, karat, confidence, total, false AS has_more
        FROM (SELECT s.query, s.position, s.url, s.title, '' AS snippet, l.metal_type IS NOT NULL AS classified,
                {_RESULT_LABELS.format(missing='not classified')},
                COUNT(*) OVER (PARTITION BY s.query) AS total
              FROM serp s LEFT JOIN classes l ON l.url = s.url)""",
    "similar_queries": """
        SELECT DISTINCT p_name AS query FROM part WHERE p_name ILIKE '%Small%' ORDER BY 1 LIMIT 5""",
    "product_classification": """
        SELECT c.url, 'classified' AS status, COALESCE(p.page_title, '') AS page_title, c.metal_type, c.karat, c.base_metal,
               c.price_usd, c.evidence, c.confidence, c.classified_at, s.query, s.position, s.title
        FROM classes c LEFT JOIN b_pages p ON p.url = c.url LEFT JOIN serp s ON s.url = c.url
        UNION ALL
        SELECT url, 'in_serp_not_classified', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, query, position, NULL FROM (
          SELECT *, row_number() OVER (PARTITION BY url ORDER BY position, query) AS nth FROM serp
          WHERE url NOT IN (SELECT url FROM classes)) WHERE nth <= 5""",
    "delta_changes": _CHANGE_PAGE + " ORDER BY detected_at DESC, c.url DESC, field DESC LIMIT 100",
    "delta_changes_all": _CHANGE_PAGE,
    "list_marketplace_results": f"""
        SELECT query, position, url, title, price_usd, shop, reviews, star_seller, classified, metal_type, karat,
               confidence, total
        FROM (SELECT s.query, s.position, s.url, s.title, s.price_usd, s.shop, s.reviews, s.star_seller,
                l.metal_type IS NOT NULL AS classified, {_RESULT_LABELS.format(missing='not classified')},
                COUNT(*) OVER (PARTITION BY s.query) AS total,
                row_number() OVER (PARTITION BY s.query ORDER BY s.position) AS nth
              FROM shop_serp s LEFT JOIN listings l ON l.url = s.url)
        WHERE nth <= 5""",
    "list_marketplace_results_all": f"""
        SELECT query, position, url, title, price_usd, shop, reviews, star_seller, classified, metal_type, karat,
               confidence, total
        FROM (SELECT s.query, s.position, s.url, s.title, s.price_usd, s.shop, s.reviews, s.star_seller,
                l.metal_type IS NOT NULL AS classified, {_RESULT_LABELS.format(missing='not classified')},
                COUNT(*) OVER (PARTITION BY s.query) AS total
              FROM shop_serp s LEFT JOIN listings l ON l.url = s.url)""",
    "marketplace_intel": _MARKET,
    "marketplace_metal_summary": f"SELECT query, metal_type, COUNT(*) AS n FROM ({_MARKET}) GROUP BY 1, 2",
    "serp_history": """
        SELECT query, snapshot_id, scraped_at, our_position, total_results, COALESCE(top_domains, '') AS top_domains
        FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY scraped_at DESC, snapshot_id DESC) AS nth FROM snaps)
        LEFT JOIN (SELECT snapshot_id, string_agg(domain || ':' || position, '|' ORDER BY position, domain) AS top_domains
                   FROM snap_res WHERE NOT is_ours AND position <= 5 GROUP BY 1) USING (snapshot_id)
        WHERE nth <= 20""",
    "serp_history_all": """
        SELECT query, snapshot_id, scraped_at, our_position, total_results, COALESCE(top_domains, '') AS top_domains
        FROM snaps
        LEFT JOIN (SELECT snapshot_id, string_agg(domain || ':' || position, '|' ORDER BY position, domain) AS top_domains
                   FROM snap_res WHERE NOT is_ours AND position <= 5 GROUP BY 1) USING (snapshot_id)""",
    "position_trend": """
        SELECT query, weeks_tracked, current_position,
               CASE WHEN current_position IS NULL THEN 'not_ranked' WHEN current_position < oldest THEN 'improving'
                    WHEN current_position > oldest THEN 'declining' ELSE 'stable' END AS trend
        FROM (SELECT query, COUNT(*) AS weeks_tracked,
                arg_max(our_position, (scraped_at, snapshot_id)) FILTER (WHERE our_position IS NOT NULL) AS current_position,
                arg_min(our_position, (scraped_at, snapshot_id)) FILTER (WHERE our_position IS NOT NULL) AS oldest
              FROM (SELECT * FROM snaps
                    QUALIFY row_number() OVER (PARTITION BY query ORDER BY scraped_at DESC, snapshot_id DESC) <= 20)
              GROUP BY query)""",
    "position_trend_all": """
        SELECT query, weeks_tracked, current_position,
               CASE WHEN current_position IS NULL THEN 'not_ranked' WHEN current_position < oldest THEN 'improving'
                    WHEN current_position > oldest THEN 'declining' ELSE 'stable' END AS trend
        FROM (SELECT query, COUNT(*) AS weeks_tracked,
                arg_max(our_position, (scraped_at, snapshot_id)) FILTER (WHERE our_position IS NOT NULL) AS current_position,
                arg_min(our_position, (scraped_at, snapshot_id)) FILTER (WHERE our_position IS NOT NULL) AS oldest
              FROM snaps
              GROUP BY query)""",
    "competitor_products": """
        SELECT cp.url, c.domain, c.name, n.price_usd, COALESCE(NULLIF(n.metal_type, ''), 'unknown') AS metal_type,
               'unknown' AS karat, COALESCE(n.description, '') AS description, cp.first_seen_at, cp.last_scraped_at,
               n.scraped_at AS snapshot_at
        FROM comp_products cp JOIN competitors c USING (competitor_id) LEFT JOIN newest_snap n USING (product_id)""",
    "competitor_products_changed": """
        SELECT cp.url, c.domain, n.price_usd, n.price_changed, n.description_changed, n.scraped_at AS snapshot_at
        FROM comp_products cp JOIN competitors c USING (competitor_id) JOIN newest_snap n USING (product_id)
        WHERE n.price_changed OR n.description_changed ORDER BY n.price_usd NULLS FIRST, cp.url LIMIT 30""",
    "competitor_products_changed_all": """
        SELECT cp.url, c.domain, n.price_usd, n.price_changed, n.description_changed, n.scraped_at AS snapshot_at
        FROM comp_products cp JOIN competitors c USING (competitor_id) JOIN newest_snap n USING (product_id)
        WHERE n.price_changed OR n.description_changed""",
    "price_history": """
        SELECT o.url, o.domain, s.scraped_at, s.id, s.price_usd, s.metal_type, 'unknown' AS karat, s.description,
               false AS price_changed
        FROM prod_snaps s JOIN owned o USING (product_id)""",
    "price_range": """
        SELECT o.url, o.domain, CASE WHEN f.n IS NULL THEN 'no_snapshots' ELSE 'ok' END AS status,
               COALESCE(f.n, 0) AS total_snapshots, COALESCE(f.flags, 0) AS price_changes_detected, f.min_price, f.max_price,
               c.price_usd AS current_price
        FROM owned o LEFT JOIN (
          SELECT product_id, COUNT(*) AS n, CAST(SUM(CASE WHEN price_changed THEN 1 ELSE 0 END) AS BIGINT) AS flags,
                 MIN(price_usd) AS min_price, MAX(price_usd) AS max_price FROM flags GROUP BY 1) f USING (product_id)
        LEFT JOIN newest_snap c USING (product_id)""",
    "run_summary": """
        SELECT (SELECT COUNT(*) FROM serp) AS serp_results, (SELECT COUNT(*) FROM snaps) AS serp_snapshots,
               (SELECT COUNT(*) FROM competitors) AS competitors, (SELECT COUNT(*) FROM b_pages) AS product_pages,
               (SELECT COUNT(*) FROM prod_snaps) AS product_snapshots, COUNT(*) AS classified,
               COUNT(*) FILTER (WHERE metal_type = 'solid_gold') AS solid_gold,
               COUNT(*) FILTER (WHERE metal_type = 'vermeil') AS vermeil,
               COUNT(*) FILTER (WHERE metal_type IN ('gold_plated', 'gold_filled')) AS plated_or_filled
        FROM classes""",
    "run_batch": f"""
        SELECT COUNT(*) AS serp_results, 2 * COUNT(DISTINCT doc_id) AS serp_snapshots, CAST(1 AS BIGINT) AS competitors, CAST(0 AS BIGINT) AS product_pages,
               COUNT(DISTINCT url) AS product_snapshots, COUNT(DISTINCT url) AS classified, CAST(0 AS BIGINT) AS solid_gold,
               CAST(0 AS BIGINT) AS vermeil, CAST(0 AS BIGINT) AS plated_or_filled
        FROM (SELECT doc_id, md5(line) AS url, MIN(i) AS i FROM pairs WHERE {_strip('line')} <> '' GROUP BY 1, 2
              QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY MIN(i)) <= 10)""",
}

_ASKED = """SELECT CAST(c_custkey AS VARCHAR) AS query FROM customer UNION SELECT c_custkey || ' ' || c_mktsegment FROM customer"""


def _first_five(asked: str, stored: str) -> str:
    """query, rank, similar."""
    return f"""
        SELECT query, CAST(rank AS INTEGER) AS rank, "similar" FROM (
          SELECT a.query, t.query AS "similar", row_number() OVER (PARTITION BY a.query ORDER BY t.query) AS rank
          FROM ({asked}) a JOIN (SELECT DISTINCT CAST(query AS VARCHAR) AS query FROM {stored}) t
            ON t.query ILIKE '%' || split_part(a.query, ' ', 1) || '%') WHERE rank <= 5"""


def _asked_report(report: str, stored: str) -> str:
    missing = f"SELECT query FROM ({_ASKED}) WHERE query NOT IN (SELECT CAST(query AS VARCHAR) FROM {stored})"
    return f"""
        SELECT CAST(query AS VARCHAR) AS query, * EXCLUDE (query), CAST(NULL AS VARCHAR) AS similar_queries FROM ({report})
        UNION ALL BY NAME
        SELECT query, COALESCE(string_agg("similar", '|' ORDER BY rank), '') AS similar_queries
        FROM ({missing}) LEFT JOIN ({_first_five(missing, stored)}) USING (query) GROUP BY query"""


SQL |= {
    "list_serp_results_asked": _asked_report(SQL["list_serp_results"], "serp"),
    "list_marketplace_results_asked": _asked_report(SQL["list_marketplace_results"], "shop_serp"),
    "serp_history_asked": _asked_report(SQL["serp_history"], "snaps"),
    "similar_queries_each": _first_five(f"{_ASKED} UNION SELECT lower(c_mktsegment) FROM customer UNION SELECT p_name FROM part", "listed"),
    "read_keywords": """
        SELECT CAST(handle AS VARCHAR) AS handle, CASE WHEN handle % 2 = 0 THEN our_url ELSE CAST(handle AS VARCHAR) END AS title, our_url,
               CAST(CASE WHEN handle % 3 = 0 THEN handle ELSE 0 END AS INTEGER) AS views_90d, array_to_string(queries, '|') AS queries
        FROM our_products""",
    "append_history": "SELECT CAST(url AS VARCHAR) AS url, field, old_value, new_value, detected_at FROM change_log",
    "load_tables": """
        SELECT 'serp_results' AS name, query || '|' || position AS key, CAST(url AS VARCHAR) AS value FROM serp
        UNION ALL SELECT 'classifications', CAST(url AS VARCHAR), metal_type FROM classes
        UNION ALL SELECT 'our_products', CAST(handle AS VARCHAR), our_url FROM our_products
        UNION ALL SELECT 'deltas', url || '|' || field, new_value FROM change_log""",
}


def oracle_sql() -> dict[str, str]:
    return {name: _with(sql) for name, sql in SQL.items()}

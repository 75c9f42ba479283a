"""SQL of the queries over the source dimension."""

from __future__ import annotations

from concord.plans.oracle import CLUSTERS, DOCS, KEPT, WIDGET, offers, rank, trimmed, words

SQL: dict[str, str] = {}

COLUMNS = "source, l_orderkey, l_linenumber, l_partkey, l_extendedprice"
ROWS = f"""
    rows AS (
        SELECT offers.*, price AS l_extendedprice FROM offers)"""
# offers with the part key
OFFERS = "WITH " + offers().replace("l_orderkey, l_linenumber, l_quantity,", "l_orderkey, l_linenumber, l_quantity, l_partkey, s_nationkey,") + "," + ROWS

STATUS = OFFERS + f""",
    run AS (
        SELECT s_name AS source, CASE WHEN s_nationkey <> 3 THEN s_name ELSE 'Unknown' END AS name, coalesce(n, 0) AS hits,
            CASE s_nationkey % 5 WHEN 0 THEN 'Client_Working' WHEN 1 THEN 'Client_Error' WHEN 2 THEN 'Client_Failed' ELSE 'Client_Idle' END AS state,
            CASE s_nationkey % 5 WHEN 1 THEN 2 ELSE 0 END AS diagnostic
        FROM supplier LEFT JOIN (SELECT l_suppkey, 2 * count(*) AS n FROM lineitem GROUP BY l_suppkey) ON s_suppkey = l_suppkey),
    fetched AS (
        SELECT source, count(*) AS f, count_if(yr NOT IN (1996, 1998)) AS x, count_if(l_quantity = 49) AS i, count_if(l_quantity = 50) AS r
        FROM offers WHERE position <= 100 GROUP BY source),
    status AS (
        SELECT source, name, hits::BIGINT AS hits, diagnostic, coalesce(f - x, 0) AS records, coalesce(x, 0) AS filtered,
            CASE WHEN f > 0 THEN ((10 * hits * (f - x)) // f + 5) // 10 ELSE hits END::BIGINT AS approximation,
            coalesce(i, 0) AS ingest_failures, coalesce(r, 0) AS record_failures, state
        FROM run LEFT JOIN fetched USING (source))"""
SQL["source_status"] = f"{STATUS} SELECT * FROM status"
SQL["run_summary"] = f"""{STATUS} SELECT count(*) AS sources, count_if(state = 'Client_Working') AS active, 0 AS connecting,
    count_if(state = 'Client_Idle') AS idle, count_if(state = 'Client_Working') AS working, count_if(state = 'Client_Failed') AS failed,
    count_if(state = 'Client_Error') AS error, 0 AS no_connection, sum(hits)::BIGINT AS hits, sum(records)::BIGINT AS records,
    round((count(*) - count_if(state = 'Client_Working')) / count(*), 2) AS progress FROM status"""
_FACET = "source AS id, name, hits AS frequency, approximation, records, filtered, state, diagnostic"
SQL["source_facet"] = f"{STATUS} SELECT {_FACET} FROM status WHERE hits > 0 ORDER BY hits DESC, source LIMIT 15"
SQL["source_facet_approximate"] = f"{STATUS} SELECT {_FACET} FROM status WHERE hits > 0 ORDER BY approximation DESC, source LIMIT 10"
SQL["result_counts"] = f"""{KEPT} SELECT count(DISTINCT key) AS merged, count(*) AS records, (SELECT 2 * count(*) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) AS total,
    ceil(count(DISTINCT key) / 20)::BIGINT AS pages FROM kept"""

SETTINGS = """
    settings AS (
        SELECT '*' AS target, 'pz:maxrecs' AS name, n_nationkey::VARCHAR AS value, n_regionkey AS precedence, n_nationkey AS ord FROM nation
        UNION ALL SELECT '*', 'pz:name', 'any', 0, 0
        UNION ALL SELECT '*', 'pz:limitmap:author', 'rpn:@attr 1=1003', 0, 0
        UNION ALL SELECT 'Supplier#0000000' || r_regionkey || '*', 'pz:name', r_name, 0, r_regionkey + 100 FROM region
        UNION ALL SELECT s_name, 'pz:name', 'S ' || s_suppkey, 0, s_suppkey FROM supplier WHERE s_acctbal < 500
        UNION ALL SELECT s_name, 'pz:allow', CASE WHEN s_nationkey < 2 THEN '0' ELSE '1' END, 0, s_suppkey FROM supplier WHERE s_nationkey < 4
        UNION ALL SELECT s_name, 'pz:native_score', CASE WHEN s_nationkey % 2 = 0 THEN 'position' ELSE 'price' END, 0, s_suppkey
            FROM supplier WHERE s_nationkey % 3 = 0),
    applied AS (
        SELECT s_name AS source, name, value, precedence, ord,
            CASE WHEN target = '*' THEN 0 WHEN target LIKE '%*' THEN 1 ELSE 2 END AS specific
        FROM supplier JOIN settings ON target = '*' OR target = s_name OR (target LIKE '%*' AND starts_with(s_name, rtrim(target, '*')))
        UNION ALL SELECT s_name, 'pz:limitmap:author', 'local:', 0, -1, 2 FROM supplier
        UNION ALL SELECT s_name, 'pz:maxrecs', '7', 2147483647, 1, 2 FROM supplier WHERE s_nationkey = 5),
    won AS (
        SELECT source, name, value FROM applied
        QUALIFY row_number() OVER (PARTITION BY source, name ORDER BY precedence DESC, specific DESC, ord DESC) = 1),
    wide AS (
        SELECT source, max(value) FILTER (name = 'pz:name') AS n, max(value) FILTER (name = 'pz:allow') AS allow,
            max(value) FILTER (name = 'pz:maxrecs') AS maxrecs, max(value) FILTER (name = 'pz:limitmap:author') AS author
        FROM won GROUP BY source)"""
SQL["resolve_settings"] = f"WITH {SETTINGS} SELECT * FROM won"
SQL["setting_limitmap"] = f"WITH {SETTINGS} SELECT source, author FROM wide"
_OPEN = "n IS NOT NULL AND coalesce(allow, '1') NOT LIKE '0%'"
SQL["filter_sources_all"] = f"""WITH {SETTINGS} SELECT source, n AS name FROM wide
    WHERE {_OPEN} AND (contains(n, 'A') OR contains(n, 'S 1')) AND source LIKE 'Supplier#0000000%'"""
SQL["filter_sources_any"] = f"WITH {SETTINGS} SELECT source, n AS name FROM wide WHERE {_OPEN} AND (n = 'ASIA' OR maxrecs = '7')"

SQL["conform_records"] = f"""{OFFERS} SELECT {COLUMNS}, title, CASE WHEN author = 'Brand#7' THEN 'no brand' ELSE author END AS author,
    medium AS kind, yr AS year, l_quantity AS price FROM rows"""
SQL["unknown_fields"] = f"{OFFERS} SELECT field, count(*) AS ignored FROM rows, (VALUES ('quantity'), ('remark')) f(field) GROUP BY field"
SQL["record_filter"] = f"""{OFFERS} SELECT {COLUMNS} FROM rows WHERE CASE s_nationkey % 4
    WHEN 0 THEN contains(title, 'widget') WHEN 1 THEN medium = 'LARGE' WHEN 2 THEN author <> 'Brand#7' ELSE true END"""
SQL["source_values"] = f"""{OFFERS} SELECT {COLUMNS}, medium || CASE WHEN s_nationkey < 9 THEN '|stock' ELSE '' END AS media,
    s_nationkey::VARCHAR AS param FROM rows"""

SQL["limit_records"] = f"{OFFERS} SELECT {COLUMNS} FROM rows WHERE title IN ('small widget', 'old rod') AND yr IN (1996, 2000)"
SQL["limit_prices"] = f"""{OFFERS} SELECT {COLUMNS} FROM rows WHERE yr IN (1995, 1997) AND price IN (
    SELECT l_extendedprice FROM (SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50))"""
SQL["limit_any_field"] = f"{OFFERS} SELECT {COLUMNS} FROM rows WHERE lower(medium) = 'standard' OR yr = 1997"
SQL["limit_unknown_field"] = f"{OFFERS} SELECT count(*) AS records, count(*) AS filtered FROM rows"
SQL["limit_clusters"] = f"""{KEPT}, {CLUSTERS} SELECT recid, members FROM clusters
    WHERE {words('title')} IN ('red widget', 'old rod') AND 1999 BETWEEN year_low AND year_high"""
SQL["limit_clusters_list"] = f"{KEPT} SELECT key AS recid, count(*) AS members FROM kept GROUP BY key HAVING bool_or(lower(medium) = 'large')"
SQL["limit_ids"] = """WITH ids AS (
        SELECT s_name AS source, p_brand AS term, max(p_size)::VARCHAR AS id
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
        WHERE s_nationkey < 12 GROUP BY s_name, p_brand),
    asked AS (SELECT s_name AS source, facet, value FROM supplier,
        (VALUES ('author', 'Brand#2'), ('author', 'Brand#4'), ('medium', 'LARGE')) want(facet, value)),
    found AS (SELECT asked.*, id, asked.source IN (SELECT source FROM ids) AND facet = 'author' AS has_ids
        FROM asked LEFT JOIN ids ON asked.source = ids.source AND value = term AND facet = 'author')
    SELECT source, facet, value, coalesce(id, value) AS id FROM found
    WHERE source NOT IN (SELECT source FROM found WHERE has_ids AND id IS NULL)"""
SQL["slice_sources"] = f"""{OFFERS} SELECT {COLUMNS}, position FROM rows
    WHERE position > 5 AND position <= 5 + CASE WHEN s_nationkey BETWEEN 1 AND 5 THEN s_nationkey ELSE 20 END"""
_ANY = "list_contains(string_split(lower(title || ' ' || medium), ' '), '{}')"
SQL["match_terms"] = f"""{OFFERS} SELECT {COLUMNS} FROM rows
    WHERE {_ANY.format('widget')} AND ({_ANY.format('large')} OR {_ANY.format('small')}) AND NOT {_ANY.format('red')}"""
SQL["match_phrase"] = f"SELECT doc_id FROM documents WHERE contains(' ' || {words('text')} || ' ', ' de la ')"
_PLACES = f"""places AS MATERIALIZED (
        SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (
            SELECT doc_id, string_split({words('text')}, ' ') AS w FROM documents)),
    spans AS (
        SELECT doc_id, 'side_by_side' AS condition, min(y.pos - x.pos) AS span FROM places x JOIN places y USING (doc_id)
        WHERE x.word = 'the' AND y.word = 'of' AND y.pos > x.pos GROUP BY doc_id
        UNION ALL SELECT doc_id, 'close', min(abs(y.pos - x.pos)) FROM places x JOIN places y USING (doc_id)
        WHERE x.word = 'la' AND y.word = 'de' GROUP BY doc_id
        UNION ALL SELECT y.doc_id, 'loose', min(z.pos - (SELECT max(x.pos) FROM places x WHERE x.doc_id = y.doc_id AND x.word = 'of' AND x.pos < y.pos))
        FROM (SELECT doc_id, pos, (SELECT min(z.pos) FROM places z WHERE z.doc_id = p.doc_id AND z.word = 'the' AND z.pos > p.pos) AS after
            FROM places p WHERE word = 'and') y JOIN places z ON z.doc_id = y.doc_id AND z.pos = y.after GROUP BY y.doc_id
        UNION ALL SELECT t.doc_id, 'twice', min(greatest(i.pos, t.later) - least(i.pos, t.pos)) FROM (
            SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS later FROM places WHERE word = 'the') t
        JOIN places i ON i.doc_id = t.doc_id AND i.word = 'in' WHERE later IS NOT NULL GROUP BY t.doc_id)"""
SQL["near_spans"] = f"""WITH {_PLACES} SELECT doc_id, min(span) FILTER (WHERE condition = 'side_by_side') AS side_by_side,
    min(span) FILTER (WHERE condition = 'close') AS close, min(span) FILTER (WHERE condition = 'loose') AS loose,
    min(span) FILTER (WHERE condition = 'twice') AS twice FROM spans WHERE span IS NOT NULL GROUP BY doc_id"""
SQL["match_near"] = f"""WITH {_PLACES} SELECT doc_id, condition FROM spans
    WHERE span <= CASE condition WHEN 'side_by_side' THEN 1 WHEN 'close' THEN 3 ELSE 10 END"""
SQL["match_truncated"] = f"""{OFFERS} SELECT {COLUMNS} FROM rows
    WHERE (len(list_filter(string_split(title, ' '), lambda x: starts_with(x, 'wid') OR ends_with(x, 'ate'))) > 0) AND yr BETWEEN 1997 AND 1999"""
SQL["match_open_range"] = f"{OFFERS} SELECT {COLUMNS} FROM rows WHERE yr <= 1995"

SQL["exact_dups_docs"] = f"WITH {DOCS} SELECT doc_id, key AS cluster FROM kept"
SQL["query_time_key"] = f"""WITH {offers(key=f"'content: ' || rtrim('medium ' || {words('p_type')}) || ' ' || rtrim('title ' || {words('p_name')})")}
    SELECT key AS cluster, count(*) AS offers FROM offers GROUP BY key"""
SQL["supplied_key"] = f"""WITH titled AS (
        SELECT doc_id, source, lang, CASE WHEN doc_id % 3 <> 0 THEN split_part(text, chr(10), 1) ELSE '' END AS title FROM documents),
    keyed AS (SELECT *, CASE WHEN doc_id % 2 = 0 AND lang IS NOT NULL THEN {words("'Lang: ' || lang")}
        WHEN title <> '' THEN rtrim('title ' || {words('title')}) ELSE '' END AS content FROM titled)
    SELECT doc_id, CASE WHEN content <> '' THEN 'content: ' || content
        ELSE 'position: ' || source || '-' || lpad(doc_id::VARCHAR, 6, '0') END AS cluster FROM keyed"""
_KEYS = f"""keyed AS (
        SELECT doc_id, source, lang, text, quality, title, 'title ' || {words('title')} AS t, 'body ' || md5({words('text')}) AS b
        FROM (SELECT doc_id, source, lang, text, quality, split_part(text, chr(10), 1) AS title FROM documents LEFT JOIN labels USING (doc_id))),
    links AS (SELECT t AS u, b AS v FROM keyed UNION SELECT b, t FROM keyed),
    reach AS (SELECT t AS k, t AS r FROM keyed UNION SELECT b, b FROM keyed UNION SELECT reach.k, links.v FROM reach JOIN links ON reach.r = links.u),
    roots AS (SELECT k, min(r) AS cluster FROM reach GROUP BY k)"""
SQL["multi_key_clusters"] = f"WITH RECURSIVE {_KEYS} SELECT doc_id, cluster FROM keyed JOIN roots ON t = k"
SQL["cluster_keys"] = f"WITH RECURSIVE {_KEYS} SELECT DISTINCT cluster, key FROM (SELECT cluster, unnest([t, b]) AS key FROM keyed JOIN roots ON t = k)"
SQL["record_by_key"] = f"""WITH RECURSIVE {_KEYS}, found AS (SELECT doc_id, cluster FROM keyed JOIN roots ON t = k)
    SELECT asked.n, f.doc_id FROM (VALUES (0, 3), (1, 30), (2, 60)) asked(n, id) JOIN found w ON w.doc_id = asked.id JOIN found f ON f.cluster = w.cluster"""
SQL["multi_key_merged"] = f"""WITH RECURSIVE {_KEYS},
    kept AS (SELECT doc_id AS arr, t, cluster, title FROM keyed JOIN roots ON t = k
        QUALIFY row_number() OVER (PARTITION BY cluster, source, {trimmed('title')}, {trimmed('text')}, lang, quality ORDER BY doc_id) = 1)
    SELECT min_by(t, arr) AS recid, count(*) AS members, first({trimmed('title')} ORDER BY strlen({trimmed('title')}) DESC, arr) FILTER (title <> '') AS title,
        min(arr) AS first_doc FROM kept GROUP BY cluster"""

_KEPT = OFFERS + f""", scored AS (
        SELECT k.key, k.source, k.position, k.arr, k.price, k.s_nationkey % 3 AS m FROM kept k)"""
SQL["native_scores"] = f"""{_KEPT}, {rank(WIDGET)}
    SELECT source, position, CASE m WHEN 0 THEN 'position' WHEN 1 THEN 'price' ELSE 'internal' END AS mode,
        round(CASE m WHEN 0 THEN 1.0::DOUBLE / position WHEN 1 THEN price ELSE relevance::DOUBLE END, 9) AS score
    FROM scored JOIN ranked ON key = recid"""
SQL["normalize_scores_ols"] = f"""{_KEPT}
    SELECT source, CASE WHEN any_value(m) = 0 THEN 1000000.0 ELSE round(regr_slope(1.0::DOUBLE / position, price) * 1e6, 6) END AS a_millionth,
        CASE WHEN any_value(m) = 0 THEN 0.0 ELSE round(regr_intercept(1.0::DOUBLE / position, price), 6) END AS b
    FROM scored WHERE m < 2 GROUP BY source"""
_NORMAL = f"""{_KEPT}, {rank(WIDGET)},
    given AS (SELECT s.*, 1.0::DOUBLE / position AS t, CASE m WHEN 0 THEN 1.0::DOUBLE / position WHEN 1 THEN price ELSE relevance::DOUBLE END AS own
        FROM scored s JOIN ranked ON key = recid),
    fit AS (SELECT source, CASE WHEN any_value(m) = 0 THEN 1.0 ELSE coalesce(regr_slope(t, own), 0) END AS a, any_value(m) AS kind, avg(t) AS t, avg(own) AS o
        FROM given GROUP BY source),
    normal AS (SELECT key, arr, a * own + CASE WHEN kind = 0 THEN 0 ELSE fit.t - a * o END AS score FROM given JOIN fit USING (source))"""
SQL["native_cluster_scores"] = f"""{_NORMAL},
    best AS (SELECT key, trunc(10000 * max(score))::BIGINT AS s FROM normal GROUP BY key)
    SELECT recid, coalesce(s, relevance) AS relevance FROM ranked LEFT JOIN best ON key = recid"""
SQL["native_cluster_first"] = f"""{_NORMAL},
    best AS (SELECT key, trunc(10000 * min_by(score, arr))::BIGINT AS s FROM normal GROUP BY key)
    SELECT recid, coalesce(s, relevance) AS relevance FROM ranked LEFT JOIN best ON key = recid"""

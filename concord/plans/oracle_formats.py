"""SQL of the queries over record formats and sinks: what the records say, straight from the tables."""

from __future__ import annotations

from concord.plans.oracle import ARRIVAL, CLUSTERS, KEPT, WIDGET, rank, snippet, words
from concord.plans.oracle_sources import SETTINGS

SQL: dict[str, str] = {}
NONE = "'empty:NULL_VALUE'"


def fields(table: str, key: str, rows: list[tuple[str, str, str]], where: str = "true") -> str:
    """One row per (field, value, condition)."""
    return " UNION ALL ".join(
        f"SELECT {key}, '{field}' AS field, ({value})::VARCHAR AS value FROM {table} WHERE {where} AND {condition}"
        for field, value, condition in rows
    )


def after(x: str, mark: str) -> str:
    return f"CASE WHEN strpos({x}, '{mark}') > 0 THEN substr({x}, strpos({x}, '{mark}') + {len(mark)}) ELSE '' END"


def before(x: str, mark: str) -> str:
    return f"CASE WHEN strpos({x}, '{mark}') > 0 THEN substr({x}, 1, strpos({x}, '{mark}') - 1) ELSE '' END"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


# -- internal records ----------------------------------------------------------------------------------------------------

LINES = f"""WITH lines AS (
        SELECT l_orderkey AS position, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ARRIVAL}) - 1 AS sub,
            p_name, p_type, year(l_shipdate) AS yr, l_quantity, (l_orderkey % 97 = 0 OR l_orderkey % 89 = 0) AS bad
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""
SQL["internal_failures"] = f"""{LINES} SELECT 'orders ' || position % 10 AS source, count(DISTINCT position) AS payloads,
    count(DISTINCT position) FILTER (bad) AS failures FROM lines GROUP BY ALL"""
SQL["rejected_records"] = f"{LINES} SELECT DISTINCT 'orders ' || position % 10 AS source, position FROM lines WHERE bad"
SQL["internal_values"] = f"""{LINES}
    SELECT position, sub, 'title' AS field, p_name AS value, NULL AS rank, NULL AS placeholder FROM lines WHERE NOT bad
    UNION ALL SELECT position, sub, 'medium', p_type, '3', NULL FROM lines WHERE NOT bad
    UNION ALL SELECT position, sub, 'date', yr::VARCHAR, NULL, NULL FROM lines WHERE NOT bad
    UNION ALL SELECT position, sub, 'author', NULL, NULL, 'nobody' FROM lines WHERE NOT bad
    UNION ALL SELECT position, sub, 'quantity', l_quantity::VARCHAR, NULL, NULL FROM lines WHERE NOT bad"""
SQL["cluster_payloads"] = LINES.replace("WITH lines", "WITH RECURSIVE lines") + f""",
    keyed AS (SELECT *, 'content: ' || rtrim('title ' || {words('p_name')}) || ' ' || rtrim('medium ' || {words('p_type')}) AS k FROM lines WHERE NOT bad),
    heads AS (SELECT position, min(k) AS head, count(DISTINCT k) AS n_keys FROM keyed GROUP BY position),
    links AS (SELECT head AS u, k AS v FROM keyed JOIN heads USING (position) UNION SELECT k, head FROM keyed JOIN heads USING (position)),
    reach AS (SELECT DISTINCT k AS k, k AS r FROM keyed UNION SELECT reach.k, links.v FROM reach JOIN links ON reach.r = links.u),
    roots AS (SELECT k, min(r) AS cluster FROM reach GROUP BY k)
    SELECT position, sub, cluster, n_keys FROM keyed JOIN heads USING (position) JOIN roots USING (k)"""
_COUNT = "len(list_filter(string_split({}, ' '), lambda x: x = '{}'))"
SQL["value_ranks"] = f"""{LINES} SELECT position, sub,
    6 * {_COUNT.format('p_name', 'widget')} / len(string_split(p_name, ' ')) + 3 * {_COUNT.format('lower(p_type)', 'widget')} AS tf_widget,
    6 * {_COUNT.format('p_name', 'large')} / len(string_split(p_name, ' ')) + 3 * {_COUNT.format('lower(p_type)', 'large')} AS tf_large
    FROM lines WHERE NOT bad"""

# -- MARC ----------------------------------------------------------------------------------------------------------------

K, SIZE, NAME, KIND, BRAND = "p_partkey", "p_size", "p_name", "p_type", "p_brand"
YEAR = "(1950 + p_size)"
SUBPART = f"'Vol. ' || {SIZE} || ', issue ' || {SIZE} % 9 || ', p ' || {K} || '-' || ({K} + 9)"
MEDIUM = f"""CASE {SIZE} % 4 WHEN 0 THEN 'book' WHEN 1 THEN 'recording-cd' WHEN 2 THEN 'video-dvd' ELSE 'newspaper' END
    || CASE WHEN {K} % 5 = 0 THEN ' (electronic)' ELSE '' END"""
ALL = "true"
MARC = fields(
    "part",
    K,
    [
        ("id", f"CASE WHEN {K} % 2 = 0 THEN 'ocm' ELSE 'x' END || {K}", ALL),
        ("oclc-number", f"'ocm' || {K}", f"{K} % 2 = 0"),
        ("has-fulltext", "'no'", ALL),
        ("system-control-nr", f"'nr ' || {K}", ALL),
        ("isbn", f"'isbn ' || {K}", ALL),
        ("author", f"{BRAND} || ', Ann B.'", ALL),
        ("title", f"{NAME} || ' :'", ALL),
        ("title-remainder", KIND, ALL),
        ("title-responsibility", BRAND, ALL),
        ("title-complete", f"{NAME} || ' : ' || {KIND}", ALL),
        ("date", YEAR, f"{K} % 3 = 0"),
        ("publication-place", "'Town :'", f"{K} % 3 = 0"),
        ("publication-name", BRAND, f"{K} % 3 = 0"),
        ("publication-date", f"'[c' || {YEAR} || '].'", f"{K} % 3 = 0"),
        ("publication-statement", f"'Town : ' || {BRAND} || ' [c' || {YEAR} || '].'", f"{K} % 3 = 0"),
        ("date", YEAR, f"{K} % 3 <> 0 AND {K} % 2 = 0"),
        ("date", f"{YEAR} || '-' || ({YEAR} + 9)", f"{K} % 3 <> 0 AND {K} % 2 = 1"),
        ("date", f"{YEAR} + 1", f"{K} % 7 = 0"),
        ("publication-date", f"{YEAR} + 1", f"{K} % 7 = 0"),
        ("description", f"'note & more ' || {NAME}", ALL),
        ("subject", KIND, ALL),
        ("subject", NAME, ALL),
        ("subject-long", f"{KIND} || ', ' || {NAME} || ', ' || {BRAND}", ALL),
        ("subject-long", NAME, ALL),
        ("citation", f"'Journal of ' || {NAME} || ' ' || {SUBPART}", f"{K} % 4 = 0"),
        ("journal-title", f"'Journal of ' || {NAME}", f"{K} % 4 = 0"),
        ("journal-subpart", SUBPART, f"{K} % 4 = 0"),
        ("volume-number", f"{SIZE} || ','", f"{K} % 4 = 0"),
        ("issue-number", f"{SIZE} % 9", f"{K} % 4 = 0"),
        ("pages-number", f"{K} || '-' || ({K} + 9)", f"{K} % 4 = 0"),
        ("locallocation", f"'Main: ' || {KIND}", ALL),
        ("callnumber", f"'QA ' || {SIZE} || ' ' || {BRAND}", ALL),
        ("publicnote", f"CASE {SIZE} % 2 WHEN 1 THEN 'Available' ELSE 'Not Available' END", ALL),
        ("available", NONE, ALL),
        ("locallocation", KIND, ALL),
        ("callnumber", f"'C' || {SIZE}", ALL),
        ("publicnote", NONE, ALL),
        ("available", f"CASE {SIZE} % 2 WHEN 0 THEN 'Available' ELSE 'due' END", ALL),
        ("electronic-url", f"'http://x/' || {K}", ALL),
        ("electronic-text", "'Full text'", ALL),
        ("medium", MEDIUM, ALL),
    ],
)
SQL["marc21_fields"] = MARC
SQL["turbomarc_fields"] = MARC
_ROW = "SELECT p_partkey, '{}' AS tag, {} AS value, {} AS code, {} AS sub_value FROM part WHERE {}"


def _control(number: str, value: str) -> str:
    return _ROW.format(number, value, "NULL", "NULL", ALL)


def _data(number: str, subfields: list[tuple[str, str]], where: str = ALL) -> str:
    return " UNION ALL ".join(_ROW.format(number, "NULL", f"'{code}'", value, where) for code, value in subfields)


_C007 = f"CASE {SIZE} % 4 WHEN 1 THEN 'sd fsngnn' WHEN 2 THEN 'vd cvaizq' ELSE 'ta' END"
_C008 = f"""'960101' || CASE WHEN {K} % 2 = 0 THEN 's' ELSE 'd' END || {YEAR} || ({YEAR} + 9) || 'xxu   n' || ' '
    || CASE WHEN {K} % 5 = 0 THEN 'o' ELSE ' ' END || '         v  eng'"""
_DATA = [
    _data("020", [("a", f"'isbn ' || {K}")]),
    _data("035", [("b", f"'nr ' || {K}")]),
    _data("100", [("a", f"{BRAND} || ', Ann B.'")]),
    _data("245", [("a", f"{NAME} || ' :'"), ("b", KIND), ("c", BRAND)]),
    _data("260", [("a", "'Town :'"), ("b", BRAND), ("c", f"'[c' || {YEAR} || '].'")], f"{K} % 3 = 0"),
    _data("500", [("a", "'note & more'"), ("b", NAME)]),
    _data("650", [("a", KIND), ("x", f"{NAME} || ','"), ("z", BRAND)]),
    _data("650", [("a", NAME)]),
    _data("773", [("t", f"'Journal of ' || {NAME}"), ("g", SUBPART)], f"{K} % 4 = 0"),
    _data("852", [("a", "'Main'"), ("b", KIND), ("h", f"'QA ' || {SIZE}"), ("i", BRAND), ("y", f"({SIZE} % 2)::VARCHAR")]),
    _data("856", [("u", f"'http://x/' || {K}"), ("3", "'Full text'")]),
    _data("903", [("a", f"({YEAR} + 1)::VARCHAR")], f"{K} % 7 = 0"),
    _data("945", [("a", KIND), ("b", f"'C' || {SIZE}"), ("s", f"CASE {SIZE} % 2 WHEN 0 THEN 'N' ELSE '-' END"), ("d", "'due'")]),
]
_ID = f"CASE WHEN {K} % 2 = 0 THEN 'ocm' ELSE 'x' END || {K}"
SQL["marc_rows"] = " UNION ALL ".join([_control("001", _ID), _control("007", _C007), _control("008", _C008), *_DATA])
SQL["marc_files"] = " UNION ALL ".join([_control("007", _C007), _control("008", _C008), *_DATA])
_GOOD = f"FROM part WHERE {K} % 50 <> 0 AND {K} % 70 <> 0"
SQL["record_files"] = f"""SELECT field, value, rank, count(*) AS records FROM (
    SELECT 'title' AS field, {NAME} AS value, NULL AS rank {_GOOD} UNION ALL SELECT 'medium', {KIND}, '3' {_GOOD}
    UNION ALL SELECT 'id', {K}::VARCHAR, NULL {_GOOD}) GROUP BY ALL"""
SQL["converted_records"] = f"""SELECT p_size, count_if({K} % 50 <> 0) AS documents, count_if({K} % 50 = 0) AS failures FROM part GROUP BY p_size"""
_SIMPLE = f"CASE WHEN {K} % 4 = 0 THEN 'article' ELSE 'book' END"
SQL["marc_mapping"] = fields(
    "part",
    K,
    [
        ("id", f"CASE WHEN {K} % 2 = 0 THEN 'ocm' ELSE 'x' END || {K}", ALL),
        ("title", f"{NAME} || ' :'", ALL),
        ("title-all", f"{NAME} || ' : ' || {KIND} || ' ' || {BRAND}", ALL),
        ("subject", KIND, ALL),
        ("subject", NAME, ALL),
        ("subject-long", f"{KIND} || ' ' || {NAME} || ', ' || {BRAND}", ALL),
        ("subject-long", NAME, ALL),
        ("medium", _SIMPLE, ALL),
    ],
)
SQL["marc_medium_simple"] = f"SELECT p_partkey, {_SIMPLE} AS medium FROM part"
SQL["marc_open_url"] = f"""SELECT p_partkey, 'http://resolver/x?generatedby=catalog&aulast=' || {BRAND} || '&aufirst=Ann'
    || CASE WHEN {K} % 3 = 0 THEN '&date=' || {YEAR} ELSE '' END
    || CASE WHEN {K} % 4 = 0 THEN '&volume=' || substr({SUBPART}, 4) ELSE '' END || '&isbn=' || {K}
    || '&title=' || CASE WHEN {K} % 4 = 0 THEN 'Journal of ' || {NAME} || '&atitle=' || {NAME} || ' :' ELSE {NAME} || ' :' END AS url FROM part"""
_P = "lower(replace(t, '.', ' '))"
_TAIL = lambda *marks: "coalesce(" + ", ".join(f"nullif({after(_P, m)}, '')" for m in marks) + ", '')"
SQL["citation_parts"] = f"""WITH texts AS (SELECT {K}, CASE {K} % 4
        WHEN 0 THEN 'Vol. ' || {SIZE} || ', no. 4, issue ' || {K} % 12 || ' (May), p. ' || {K}
        WHEN 1 THEN 'v ' || {SIZE} || ' issue ' || {SIZE} || ',p' || {K} || '-' || ({K} + 3)
        WHEN 2 THEN {NAME} || ' pages ' || {K} ELSE {NAME} END AS t FROM part)
    SELECT {K}, {before(squeeze(_TAIL('vol ', 'v ')), ' ')} AS volume,
        {before(f"replace({squeeze(after(_P, 'issue'))}, ',', ' ')", ' ')} AS issue,
        {squeeze(_TAIL(' p ', ',p', ' p'))} AS pages FROM texts"""
SQL["unimarc_fields"] = fields(
    "part",
    K,
    [
        ("id", K, ALL),
        ("isbn", f"'i' || {K}", ALL),
        ("lccn", f"'l' || {K}", f"{K} % 2 = 0"),
        ("title", NAME, ALL),
        ("date", YEAR, ALL),
        ("description", KIND, ALL),
        ("subject", KIND, ALL),
        ("author", f"{BRAND} || ', Ann'", ALL),
    ],
)
_DAN = f"CASE WHEN {K} % 2 = 0 THEN 'x' || {KIND} ELSE 'article' END"
SQL["danmarc2_fields"] = fields(
    "part",
    K,
    [
        ("id", K, ALL),
        ("author", BRAND, ALL),
        ("title", NAME, ALL),
        ("title-medium", f"'[x' || {KIND} || '] y'", f"{K} % 2 = 0"),
        ("description", "'a note'", ALL),
        ("subject", KIND, ALL),
        ("subject", NAME, ALL),
        ("citation", f"'In all ' || {K}", ALL),
        ("medium", _DAN, ALL),
        ("key", f"'title ' || {NAME} || ' author ' || {BRAND} || ' medium ' || {_DAN}", ALL),
    ],
)

# -- Dublin Core, Solr, Primo, generic -------------------------------------------------------------------------------------

# the XML reader trims white space around a value
STRIP = lambda x: f"regexp_replace(regexp_replace({x}, '^[\\x00-\\x20]+', ''), '[\\x00-\\x20]+$', '')"
TITLE, TEXT = STRIP("split_part(text, chr(10), 1)"), STRIP("text")


def dc(identifier: str, more: list[tuple[str, str, str]] = ()) -> str:
    return fields(
        "documents",
        "doc_id",
        [
            ("id", identifier, ALL),
            ("title", f"md5({TITLE})", f"{TITLE} <> ''"),
            ("author", "source", "source <> ''"),
            ("subject", "lang", "lang <> ''"),
            ("subject", "n_chars", ALL),
            ("description", f"md5({TEXT})", f"{TEXT} <> ''"),
            ("electronic-url", "doc_id", ALL),
            *more,
        ],
    )


SQL["dc_fields"] = dc("doc_id", [("medium", "'text'", ALL)])
SQL["oai_dc_fields"] = dc("'oai:' || doc_id")
SQL["opensearch_fields"] = dc("'os:' || doc_id")
SQL["dkabm_fields"] = f"""SELECT doc_id, 0 AS sub, field, value FROM ({dc('doc_id', [('score', 'n_chars / 8.0', ALL)])})
    UNION ALL SELECT doc_id, 1, 'score', '0.5' FROM documents
    UNION ALL SELECT doc_id, 1, 'title', md5(source) FROM documents WHERE source <> ''"""
_LICENSE = f"CASE {SIZE} % 3 WHEN 0 THEN 'http://creativecommons.org/licenses/by-sa/4.0' WHEN 1 THEN 'http://creativecommons.org/about/cc0' ELSE 'http://other' END"
SQL["solr_fields"] = fields(
    "part",
    K,
    [
        ("id", K, ALL),
        ("price", "p_retailprice", ALL),
        ("date", YEAR, ALL),
        ("title", NAME, ALL),
        ("title", KIND, ALL),
        ("medium", KIND, ALL),
        ("license_url", _LICENSE, ALL),
        ("license_name", f"CASE {SIZE} % 3 WHEN 0 THEN 'CC By-SA' WHEN 1 THEN 'CC0 (public domain)' ELSE '[unknown]' END", ALL),
    ],
)
SQL["solr_fields_medium"] = fields("part", K, [("medium", "'book'", ALL)])
SQL["primo_fields"] = fields(
    "part",
    K,
    [
        ("id", f"'TN_' || {K}", ALL),
        ("date", YEAR, ALL),
        ("journal-month", f"{YEAR} % 10", ALL),
        ("volume-number", SIZE, ALL),
        ("pages-number", f"{K} || '-' || ({K} + 7)", f"{K} % 6 = 0"),
        ("pages-number", f"{K} || '-' || ({K} + 5)", f"{K} % 6 <> 0 AND {K} % 4 = 0"),
        ("pages-number", K, f"{K} % 6 <> 0 AND {K} % 4 = 2"),
        ("issn", f"'1234-' || {SIZE}", ALL),
        ("journal-title", KIND, ALL),
        ("has-fulltext", f"CASE {K} % 2 WHEN 0 THEN 'yes' ELSE 'no' END", ALL),
        ("medium", f"CASE WHEN {K} % 3 <> 0 THEN 'book' WHEN {K} % 2 = 0 THEN 'e-article' ELSE 'article' END", ALL),
        ("title", NAME, ALL),
        ("journal-subpart", KIND, ALL),
        ("citation", KIND, ALL),
        ("subject", NAME, ALL),
        ("subject", KIND, ALL),
        ("electronic-url", f"'http://o/' || {K}", ALL),
        ("author", BRAND, ALL),
        ("author", "'Second'", ALL),
    ],
)
_T = "trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1))"
SQL["generic_fields"] = fields(
    "pages",
    "page_id",
    [
        ("medium", "'web'", ALL),
        ("pages-number", "page_id || CASE WHEN page_id % 2 = 0 THEN '-' || (page_id + 4) ELSE '' END", ALL),
        ("publication-date", "page_id", ALL),
        ("date", "page_id", ALL),
        ("electronic-url", "url", "url <> ''"),
        ("title", f"md5({_T})", f"{_T} <> ''"),
        ("title-complete", f"md5({_T})", f"{_T} <> ''"),
        ("startpage", "page_id", ALL),
        ("endpage", "page_id + 4", "page_id % 2 = 0"),
        ("body", "md5(trim(html))", "trim(html) <> ''"),
        ("due", NONE, ALL),
        ("locallocation", "'A & B'", ALL),
        ("callnumber", "page_id", ALL),
        ("available", NONE, ALL),
        ("publicnote", NONE, ALL),
    ],
)
SQL["opac_holdings"] = f"""WITH held AS (SELECT DISTINCT l_partkey AS position, l_suppkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey),
    t AS (SELECT p_partkey AS position, p_name FROM part)
    SELECT position, 'title' AS field, p_name AS value FROM t UNION ALL """ + fields(
    "held",
    "position",
    [
        ("locallocation", "'S' || l_suppkey", ALL),
        ("callnumber", f"CASE l_linenumber % 2 WHEN 0 THEN l_linenumber::VARCHAR ELSE {NONE} END", ALL),
        ("publicnote", NONE, ALL),
        ("available", "CASE l_linenumber % 2 WHEN 1 THEN 'Available' ELSE '2030' END", ALL),
    ],
)

# -- settings files, normalizers -------------------------------------------------------------------------------------------

SQL["settings_rows"] = """SELECT s_name AS file, s_name AS target, 'pz:name' AS name, s_suppkey::VARCHAR AS value, s_nationkey AS precedence FROM supplier
    UNION ALL SELECT s_name, '*', 'pz:allow', '1', 3 FROM supplier
    UNION ALL SELECT s_name, s_name, 'pz:map', '<map n="' || s_suppkey || '"><x>1 &amp; 2</x></map>', s_nationkey FROM supplier"""
SQL["settings_rejected"] = """SELECT s_name AS file, CASE s_suppkey % 2 WHEN 0 THEN 'pz:elements' END AS name, s_name AS target,
    CASE s_suppkey % 2 WHEN 0 THEN 'value' ELSE 'name' END AS missing FROM supplier"""
_NR = "regexp_extract(p_brand, '(\\d+)', 1)::INT % 4"
SQL["normalized_by_source"] = f"""SELECT p_brand AS source, p_partkey AS position, CASE {_NR} WHEN 3 THEN 'record' END AS failure,
    CASE {_NR} WHEN 1 THEN p_name || ' :' WHEN 3 THEN NULL ELSE p_name END AS title FROM part"""
SQL["converted_corpus"] = """SELECT p_size, count_if(p_partkey % 50 <> 0) AS documents, count_if(p_partkey % 50 = 0) AS failures FROM part GROUP BY p_size"""

# -- results ---------------------------------------------------------------------------------------------------------------

CHECKSUM = """list_reduce(list_transform(string_split(source, ''), lambda c: ascii(c)::HUGEINT),
        lambda h, c: (h * 65509 + c) % 4294967296, position::HUGEINT)::BIGINT"""
_SETTINGS = SETTINGS.strip()
SQL["result_locations"] = f"""{KEPT}, {_SETTINGS}
    SELECT kept.source AS id, coalesce(n, 'Unknown') AS name, {CHECKSUM.replace('source', 'kept.source')} AS checksum,
        coalesce({snippet('title', "'small', 'widget'")}, title) AS title, yr::VARCHAR AS date, printf('%.6f', price) AS price
    FROM kept LEFT JOIN wide ON kept.source = wide.source"""
SQL["result_docs"] = f"""{KEPT}, {CLUSTERS}, {_SETTINGS}
    SELECT recid, 'hit' AS kind, NULL::VARCHAR AS id, NULL::VARCHAR AS name, members AS number, title, NULL::VARCHAR AS author,
        NULL::VARCHAR AS medium, NULL::VARCHAR AS date, printf('%.6f', price_low) || '/' || printf('%.6f', price_high) AS price
    FROM clusters
    UNION ALL SELECT DISTINCT key, 'value', NULL, NULL, NULL::BIGINT, NULL, author, NULL, NULL, NULL FROM kept
    UNION ALL SELECT key, 'value', NULL, NULL, NULL::BIGINT, NULL, NULL, medium, NULL, NULL FROM kept
    UNION ALL SELECT key, 'member', kept.source, coalesce(n, 'Unknown'), {CHECKSUM.replace('source', 'kept.source')}, kept.title, kept.author,
        kept.medium, yr::VARCHAR, printf('%.6f', price) FROM kept LEFT JOIN wide ON kept.source = wide.source"""
SQL["result_json"] = f"""{KEPT}, {CLUSTERS}, {rank(WIDGET)}
    SELECT recid, to_json({{'title': title, 'medium': medium, 'members': clusters.members, 'relevance': relevance}})::VARCHAR AS doc
    FROM clusters JOIN ranked USING (recid) ORDER BY relevance DESC, recid LIMIT 20"""
_ONE = f"SELECT source, position, {CHECKSUM} AS checksum FROM kept WHERE key = 'content: title small widget author brand medium small' ORDER BY arr"
SQL["one_record"] = f"{KEPT} {_ONE}"
SQL["one_member"] = f"{KEPT} {_ONE} LIMIT 1 OFFSET 7"
SQL["snippet_docs"] = f"{KEPT}, {CLUSTERS} SELECT recid AS id, title, NULL::VARCHAR AS url, medium || ' ' || author AS snippet FROM clusters"

SQL["snippet_docs_listed"] = f"""WITH o AS (
        SELECT 'content: title ' || {words('p_name')} AS key, p_name, p_brand, p_type, ({ARRIVAL}) AS arr
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
    media AS (SELECT key, string_agg(p_type, ' ' ORDER BY a) AS media FROM (SELECT key, p_type, min(arr) AS a FROM o GROUP BY key, p_type) GROUP BY key),
    authors AS (SELECT key, string_agg(p_brand, ' ' ORDER BY a) AS authors FROM (SELECT key, p_brand, min(arr) AS a FROM o GROUP BY key, p_brand) GROUP BY key)
    SELECT key AS id, first(p_name ORDER BY strlen(p_name) DESC, arr) AS title, NULL::VARCHAR AS url, any_value(media) || ' ' || any_value(authors) AS snippet
    FROM o JOIN media USING (key) JOIN authors USING (key) GROUP BY key"""

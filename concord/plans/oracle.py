"""The registered queries in SQL, for DuckDB over the same tables."""

from __future__ import annotations

SQL: dict[str, str] = {}

ARRIVAL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity"


def words(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '[^A-Za-z]+', ' ', 'g')))"


def key_norm(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '[^0-9A-Za-z]+', ' ', 'g')))"


def sort_string(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '[A-Za-z]') THEN {key_norm(f'''regexp_replace({x}, '^[^A-Za-z]+', '')''')} END"


def no_article(x: str) -> str:
    return (
        f"CASE WHEN lower(split_part({x}, ' ', 1)) IN ('the', 'den', 'der', 'die', 'des', 'an', 'a') "
        f"THEN substr({x}, length(split_part({x}, ' ', 1)) + 1) ELSE {x} END"
    )


def trimmed(x: str) -> str:
    left = f"ltrim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return (
        f"CASE WHEN contains({x}, '://') THEN {x} WHEN rtrim({left}, ' ,/.:([') = '' THEN substr({left}, 1, 1) "
        f"ELSE rtrim({left}, ' ,/.:([') END"
    )


def part(name: str, x: str) -> str:
    """Part of a merge key."""
    return f"rtrim('{name} ' || {words(x)})"


def offers(key: str = f"'content: ' || {part('title', 'p_name')} || ' ' || {part('author', 'p_brand')} || ' ' || {part('medium', 'p_type')}", where: str = "true") -> str:
    """CTEs `offers` and `kept` (exact duplicates dropped); `arr` numbers the arrival."""
    return f"""
    offers AS (
        SELECT s_name AS source, row_number() OVER (ORDER BY {ARRIVAL}) AS arr,
            row_number() OVER (PARTITION BY s_name ORDER BY {ARRIVAL}) AS position,
            p_name AS title, p_brand AS author, p_type AS medium, year(l_shipdate)::INT AS yr, l_extendedprice AS price,
            l_orderkey, l_linenumber, l_quantity, {key} AS key
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
        WHERE {where}),
    kept AS (
        SELECT * FROM offers
        QUALIFY row_number() OVER (PARTITION BY key, source, title, author, medium, yr, price ORDER BY arr) = 1)"""


def longest(x: str) -> str:
    return f"first({x} ORDER BY strlen({x}) DESC, arr)"


CLUSTERS = f"""
    clusters AS (
        SELECT key AS recid, count(*) AS members, min(arr) AS first_arrival, min(position) AS first_position,
            {longest('title')} AS title, {longest('author')} AS author, {longest('medium')} AS medium,
            min(yr) AS year_low, max(yr) AS year_high, min(price) AS price_low, max(price) AS price_high
        FROM kept GROUP BY key)"""

PRINTED = """recid, members, title, author, medium,
    CASE WHEN year_low = year_high THEN year_low::VARCHAR ELSE year_low || '-' || year_high END AS date,
    printf('%.6f', price_low) AS price_low, printf('%.6f', price_high) AS price_high"""


def rank(
    terms: list[tuple[str, dict[str, int]]],
    length: str = "linear",
    cluster: bool = True,
    source: str = "kept",
    value: dict[str, str] | None = None,
) -> str:
    """CTEs up to `ranked`. `terms` are (word, weight per field); counts are per value of a field."""
    value = value or {"title": "title", "author": "author", "medium": "medium"}
    ranked = sorted({f for _, w in terms for f in w})
    tok = ", ".join(f"regexp_extract_all(lower({value[f]}), '[a-z]+') AS tok_{f}" for f in ranked)

    def count(i: int, f: str) -> str:
        word, weights = terms[i]
        return f"({weights.get(f, 0)} * len(list_filter(tok_{f}, lambda x: x = '{word}')))"

    def share(i: int, f: str) -> str:
        n = f"len(tok_{f})"
        over = {"linear": n, "log": f"log2(1 + {n})", "none": "1"}[length]
        return f"CASE WHEN {n} = 0 THEN 0 ELSE {count(i, f)}::DOUBLE / {over} END"

    k = range(len(terms))
    tf = ", ".join("(" + " + ".join(share(i, f) for f in ranked) + f") AS tf{i}" for i in k)
    hit = ", ".join("(" + " + ".join(count(i, f) for f in ranked) + f") > 0 AS hit{i}" for i in k)
    return f"""
    tokens AS (SELECT key, arr, {tok} FROM {source}),
    counted AS (SELECT key, arr, {tf}, {hit} FROM tokens),
    {scored(len(terms), cluster)}"""


def scored(k_terms: int, cluster: bool = True) -> str:
    """CTEs from `counted` (key, arr, tf_i, hit_i) to `ranked`."""
    k = range(k_terms)
    running = ", ".join(
        f"max(hit{i}::INT) OVER (PARTITION BY key ORDER BY arr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run{i}" for i in k
    )
    df = ", ".join(f"coalesce(sum(run{i}), 0)::BIGINT AS df{i}" for i in k)
    sums = ", ".join(f"sum(tf{i}) AS tf{i}" for i in k)
    idf = lambda i: f"(CASE WHEN df{i} > 0 THEN ln((1 + n)::DOUBLE / df{i}) ELSE 0 END)"
    score = " + ".join(f"trunc(100000 * tf{i} * {idf(i)})::BIGINT" for i in k)
    if not cluster:
        score = f"({score}) // members"
    return f"""
    running AS (SELECT *, {running} FROM counted),
    stats AS (SELECT count(*) AS n, {df} FROM running),
    summed AS (SELECT key AS recid, count(*) AS members, {sums} FROM counted GROUP BY key),
    ranked AS (SELECT summed.*, stats.* , ({score})::BIGINT AS relevance FROM summed CROSS JOIN stats)"""


TITLE6 = {"title": 6, "author": 2}
WIDGET = [("small", TITLE6), ("widget", TITLE6)]
RANKED = "SELECT recid, members, relevance FROM ranked"
KEPT = "WITH " + offers()

SQL["search_offers"] = f"""WITH {offers(where="list_contains(string_split(p_name, ' '), 'widget') AND NOT list_contains(string_split(p_name, ' '), 'old')")},
    {CLUSTERS} SELECT {PRINTED} FROM clusters"""
SQL["search_page"] = f"""WITH {offers(where="list_has_any(string_split(lower(p_name || ' ' || p_type), ' '), ['small', 'widget'])")}, {CLUSTERS}, {rank(WIDGET)}
    SELECT {PRINTED}, relevance FROM clusters JOIN (SELECT recid, relevance FROM ranked) USING (recid) ORDER BY relevance DESC, recid LIMIT 20"""
SQL["rank_offers"] = f"{KEPT}, {rank(WIDGET)} {RANKED}"
SQL["rank_offers_log"] = f"{KEPT}, {rank(WIDGET, 'log')} {RANKED}"
SQL["rank_offers_none"] = f"{KEPT}, {rank(WIDGET, 'none')} {RANKED}"
SQL["rank_offers_per_member"] = f"{KEPT}, {rank(WIDGET, cluster=False)} {RANKED}"
_W = {"medium": 4, "title": 1}
SQL["rank_offers_weights"] = f"{KEPT}, {rank([('small', _W), ('widget', _W), ('standard', _W)])} {RANKED}"
SQL["rank_offers_qualified"] = f"{KEPT}, {rank([('brand', {'title': 6, 'author': 9}), ('widget', TITLE6)])} {RANKED}"
# titles have two words: the second one decays by log2(1 + 0.5) and is doubled when the first one is the earlier term
SQL["rank_lead_follow"] = f"""{KEPT},
    tokens AS (SELECT key, arr, string_split(title, ' ') AS t FROM kept),
    weighed AS (SELECT key, arr,
        (CASE WHEN t[1] = 'small' THEN 6 ELSE 0 END) + (CASE WHEN t[2] = 'small' THEN trunc(6 / (1 + log2(1.5))) ELSE 0 END) AS w0,
        (CASE WHEN t[1] = 'widget' THEN 6 ELSE 0 END)
            + (CASE WHEN t[2] = 'widget' THEN trunc(6 / (1 + log2(1.5))) * (CASE WHEN t[1] = 'small' THEN 2 ELSE 1 END) ELSE 0 END) AS w1
        FROM tokens),
    counted AS (SELECT key, arr, w0::DOUBLE / 2 AS tf0, w1::DOUBLE / 2 AS tf1, w0 > 0 AS hit0, w1 > 0 AS hit1 FROM weighed),
    {scored(2)} {RANKED}"""
_IDF = "round(CASE WHEN df{0} > 0 THEN ln((1 + n)::DOUBLE / df{0}) ELSE 0 END, 9)"
SQL["rank_explain"] = f"""{KEPT}, {rank(WIDGET)}""" + " UNION ALL ".join(
    f"""
    SELECT recid, '{t}' AS term, tf{i} AS tf, df{i} AS df, n, {_IDF.format(i)} AS idf,
        trunc(100000 * tf{i} * (CASE WHEN df{i} > 0 THEN ln((1 + n)::DOUBLE / df{i}) ELSE 0 END))::BIGINT AS "add", 1 AS divided_by FROM ranked"""
    for i, t in enumerate(("small", "widget"))
)

DOCS = f"""
    docs AS (
        SELECT doc_id AS arr, doc_id, source, lang, text, quality, split_part(text, chr(10), 1) AS title
        FROM documents LEFT JOIN labels USING (doc_id)),
    keyed AS (
        SELECT *, CASE WHEN title <> '' THEN 'content: ' || {part('title', 'title')}
            ELSE 'position: ' || source || '-' || lpad(doc_id::VARCHAR, 6, '0') END AS key FROM docs),
    kept AS (
        SELECT * FROM keyed
        QUALIFY row_number() OVER (PARTITION BY key, source, {trimmed('title')}, {trimmed('text')}, lang, quality ORDER BY arr) = 1)"""
_B = {"title": 6, "text": 1}
SQL["rank_docs"] = f"WITH {DOCS}, {rank([('the', _B), ('tion', _B)], value={'title': 'title', 'text': 'text'})} {RANKED}"
_BY_AUTHOR = f"'content: ' || {part('author', 'p_brand')} || ' ' || {part('medium', 'p_type')}"
SQL["doc_freq_late"] = f"""WITH {offers(key=_BY_AUTHOR)}, {rank(WIDGET)}
    SELECT n AS records, n, df0 AS df_small, df1 AS df_widget FROM stats"""

SQL["merge_longest"] = f"{KEPT}, {CLUSTERS} SELECT recid, title, author FROM clusters"
SQL["merge_range"] = f"{KEPT}, {CLUSTERS} SELECT recid, year_low, year_high, price_low, price_high FROM clusters"
SQL["merge_unique"] = f"""{KEPT} SELECT key AS recid, author, l_orderkey, l_linenumber, 0 AS ord FROM kept
    QUALIFY row_number() OVER (PARTITION BY key, author ORDER BY arr) = 1"""
SQL["merge_all"] = f"{KEPT} SELECT key AS recid, author, l_orderkey, l_linenumber, 0 AS ord FROM kept"
SQL["merge_first"] = f"""{KEPT} SELECT key AS recid, author, l_orderkey, l_linenumber, 0 AS ord FROM kept
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY arr) = 1"""
SQL["merge_values_mixed"] = f"""WITH {DOCS},
    titled AS (SELECT key, {trimmed('title')} AS disp, doc_id FROM kept WHERE title <> ''
        QUALIFY row_number() OVER (PARTITION BY key ORDER BY strlen({trimmed('title')}) DESC, arr) = 1)
    SELECT key AS recid, 'title' AS field, disp, doc_id, NULL::DOUBLE AS num FROM titled
    UNION ALL SELECT key, 'lang', lang, min(doc_id), NULL FROM kept WHERE lang <> '' GROUP BY key, lang
    UNION ALL SELECT key, 'quality', NULL, min(doc_id), min(quality)::DOUBLE FROM kept WHERE quality IS NOT NULL GROUP BY key"""


def numbered(order: str, clusters: str = "clusters", cte: str | None = None) -> str:
    return f"{KEPT}, {cte or CLUSTERS} SELECT recid, row_number() OVER (ORDER BY {order}) AS rank FROM {clusters}"


TITLE_KEY = f"coalesce({sort_string(no_article('title'))}, title)"
AUTHOR_KEY = f"coalesce({sort_string('author')}, author)"
SQL["sort_title"] = numbered(f"{TITLE_KEY}, recid")
SQL["sort_author_title_desc"] = numbered(f"{AUTHOR_KEY} DESC, {TITLE_KEY} DESC, recid")
SQL["sort_date_asc"] = numbered(f"year_low ASC NULLS LAST, {TITLE_KEY}, recid")
SQL["sort_date_desc"] = numbered("year_high DESC NULLS LAST, recid")
SQL["sort_price_asc"] = numbered("price_low ASC NULLS FIRST, recid")
SQL["sort_price_desc"] = numbered("price_high DESC NULLS LAST, recid")
SQL["sort_position"] = numbered("first_position, recid")
SQL["sort_retrieval"] = numbered("first_arrival, recid")
SQL["sort_relevance"] = numbered("relevance DESC, recid", "ranked", rank(WIDGET))
SQL["sort_native"] = f"""{KEPT} SELECT key AS recid, row_number() OVER (ORDER BY min(position), key) AS rank FROM kept
    WHERE source = (SELECT min_by(s_name, s_suppkey) FROM supplier) GROUP BY key"""
SQL["page_title"] = f"{KEPT}, {CLUSTERS} SELECT recid, members FROM clusters ORDER BY {TITLE_KEY}, recid LIMIT 20 OFFSET 40"
SQL["page_past_end"] = f"{KEPT}, {CLUSTERS} SELECT recid, members FROM clusters ORDER BY recid LIMIT 20 OFFSET 1000000"
SQL["neighbours_title"] = f"""{KEPT}, {CLUSTERS}
    SELECT recid, lag(recid) OVER w AS prev, lead(recid) OVER w AS next FROM clusters WINDOW w AS (ORDER BY {TITLE_KEY}, recid)"""

OFFER_TERMS = """
    terms AS (
        SELECT source, 'title' AS facet, title AS term FROM kept UNION ALL SELECT source, 'author', author FROM kept
        UNION ALL SELECT source, 'medium', medium FROM kept UNION ALL SELECT source, 'date', yr::VARCHAR FROM kept)"""


def top(counts: str, num: int, where: str = "true") -> str:
    return f"""SELECT facet, rank, display, frequency FROM (
        SELECT facet, display, frequency, row_number() OVER (PARTITION BY facet ORDER BY frequency DESC, display) AS rank
        FROM {counts} WHERE {where}) WHERE rank <= {num}"""


COUNTS = "counts AS (SELECT facet, term AS display, count(*) AS frequency FROM terms GROUP BY facet, term)"
SQL["facets_top"] = f"{KEPT}, {OFFER_TERMS}, {COUNTS} {top('counts', 15)}"
SQL["facets_chained"] = f"""{KEPT}, {OFFER_TERMS},
    formed AS (SELECT facet, CASE facet WHEN 'medium' THEN upper(term) WHEN 'author' THEN lower(regexp_replace(term, '[0-9]+$', '')) ELSE term END AS term FROM terms)
    SELECT facet, term AS norm, term AS display, count(*) AS frequency FROM formed WHERE term <> '' GROUP BY facet, term"""
SQL["facets_all"] = f"""WITH {DOCS} SELECT 'lang' AS facet, lang AS norm, lang AS display, count(*) AS frequency FROM kept
    WHERE lang <> '' GROUP BY lang"""
SQL["facets_year"] = f"""WITH docs AS (SELECT doc_id, list_filter(regexp_extract_all(text, '\\d+'), lambda x: length(x) = 4) AS y FROM documents),
    ends AS (SELECT unnest(list_distinct([list_min(y)::INT::VARCHAR, list_max(y)::INT::VARCHAR])) AS term FROM docs WHERE len(y) > 0)
    SELECT 'quality' AS facet, term AS norm, term AS display, count(*) AS frequency FROM ends GROUP BY term
    UNION ALL SELECT 'lang', lang, lang, count(*) FROM documents WHERE lang <> '' GROUP BY lang"""
SQL["facets_scaled"] = f"""{KEPT}, {OFFER_TERMS},
    factors AS (SELECT s_name AS source, greatest(greatest(floor(s_acctbal), 0)::BIGINT, 100) // 100 AS factor FROM supplier),
    counts AS (SELECT facet, term AS display, sum(factor)::BIGINT AS frequency FROM terms JOIN factors USING (source) GROUP BY facet, term)
    {top('counts', 10, "facet IN ('medium', 'author')")}"""
REPORTED = """
    told AS (
        SELECT s_name AS source, {term} AS term, sum(l_quantity)::BIGINT AS frequency
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
        WHERE s_nationkey < 5 GROUP BY s_name, {term})"""
SQL["facets_reported"] = f"""{KEPT}, {OFFER_TERMS}, {REPORTED.format(term='p_brand')},
    every AS (
        SELECT facet, term, 1 AS frequency FROM terms
        WHERE facet <> 'author' OR source NOT IN (SELECT source FROM told)
        UNION ALL SELECT 'author', term, frequency FROM told)
    SELECT facet, term AS norm, term AS display, sum(frequency)::BIGINT AS frequency FROM every GROUP BY facet, term"""
_SPLIT = REPORTED.format(term="p_size || ':' || p_brand")
SQL["facets_split"] = f"""{KEPT}, {OFFER_TERMS}, {_SPLIT},
    every AS (
        SELECT facet, term, 1 AS frequency FROM terms WHERE facet <> 'author' OR source NOT IN (SELECT source FROM told)
        UNION ALL SELECT 'author', split_part(term, ':', 2), frequency FROM told)
    SELECT facet, term AS norm, term AS display, sum(frequency)::BIGINT AS frequency FROM every GROUP BY facet, term"""
SQL["facet_id_lookup"] = f"""WITH {_SPLIT}
    SELECT source, 'author' AS facet, split_part(term, ':', 2) AS term, max_by(split_part(term, ':', 1), term) AS id
    FROM told GROUP BY source, split_part(term, ':', 2)"""
SQL["facets_named"] = f"""{KEPT}, {OFFER_TERMS}, {COUNTS}, best AS ({top('counts', 5, "facet = 'medium'")})
    SELECT asked.facet, rank, display, frequency FROM (VALUES ('medium'), ('nothing')) asked(facet) LEFT JOIN best USING (facet)"""

SQL["scalar_text"] = f"""WITH {DOCS}
    SELECT doc_id, {trimmed('title')} AS trimmed, {key_norm('title')} AS key, {sort_string('title')} AS sort,
        {no_article('title')} AS no_article, {words('title')} AS words, md5({words('text')}) AS text_words,
        len(regexp_extract_all(text, '[A-Za-z]+')) AS n_words
    FROM docs"""
_RUNS = "regexp_extract_all(html, '\\d+')"
SQL["scalar_numbers"] = f"""WITH runs AS (
        SELECT page_id, regexp_extract(url, '/(\\d+[^/]*)$', 1) AS tail,
            list_transform(list_filter({_RUNS}, lambda x: length(x) = 4), lambda x: x::INT) AS y,
            list_transform(list_filter({_RUNS}, lambda x: length(x) BETWEEN 4 AND 8),
                lambda x: x::INT * CASE WHEN length(x) = 4 THEN 10000 ELSE 1 END) AS d
        FROM pages)
    SELECT page_id, list_min(y) AS year_low, list_max(y) AS year_high, list_min(d) AS date_low, list_max(d) AS date_high,
        CASE WHEN list_min(y) = list_max(y) THEN list_min(y)::VARCHAR ELSE coalesce(list_min(y) || '-' || list_max(y), '') END AS years,
        coalesce(try_cast(regexp_extract(tail, '^\\d+\\.?\\d*') AS DOUBLE), 0) AS number,
        coalesce(try_cast(regexp_extract(tail, '^\\d+') AS INT), 0) AS whole
    FROM runs"""
SQL["member_checksums"] = f"""WITH {offers()}
    SELECT source, position, list_reduce(list_transform(string_split(source, ''), lambda c: ascii(c)::HUGEINT),
        lambda h, c: (h * 65509 + c) % 4294967296, position::HUGEINT)::BIGINT AS checksum FROM offers"""


def snippet(x: str, terms: str) -> str:
    pieces = f"regexp_extract_all({x}, '[^A-Za-z]*[A-Za-z]+|[^A-Za-z]+$')"
    word = "lower(regexp_replace(p, '[^A-Za-z]+', '', 'g'))"
    open_, close = "chr(57344)", "chr(57345)"
    marked = f"array_to_string(list_transform({pieces}, lambda p: CASE WHEN {word} IN ({terms}) THEN {open_} || p || {close} ELSE p END), '')"
    out = f"replace({marked}, {close} || {open_}, '')"
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
        out = f"replace({out}, '{char}', '{entity}')"
    out = f"replace(replace({out}, {open_}, '<match>'), {close}, '</match>')"
    return f"CASE WHEN contains({out}, '<match>') THEN {out} END"


SQL["snippets_titles"] = f"SELECT p_partkey, {snippet('p_name', repr(('small', 'widget', 'red'))[1:-1])} AS snippet FROM part"
SQL["snippets_pages"] = f"SELECT page_id, md5({snippet('html', repr(('the', 'de', 'und'))[1:-1])}) AS snippet FROM pages"

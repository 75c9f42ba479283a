"""Queries over the offers and documents: search, rank, merge, sort, facets, status, filters."""

from __future__ import annotations

from dataclasses import replace
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from concord.catalog import Catalog
from concord.functions import text as X, values as V
from concord.functions.chains import ENGLISH, TextChain, trim_trailing
from concord.operators import clusters as C, facets as FA, filters as FI, merge as M, order as O, rank as R
from concord.operators.records import md
from concord.plans.views import DOCS, OFFERS, docs, docs_table, line_slices, offers, table
from concord.session import stored, stored_parts, tidy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
QUERY = "small widget"


def register(query):
    QUERIES[query.__name__] = query
    return query


def kept_offers(
    spark: SparkSession, sf: str, catalog: Catalog = OFFERS, condition: Column | None = None, position: bool = False
) -> DataFrame:
    """Offers with merge key, exact duplicates dropped."""
    rows = offers(spark, sf, position, catalog)
    if condition is not None:
        rows = rows.filter(condition)
    if not position:
        # every offer has a title, so the key never falls back on the position
        rows = rows.withColumn("position", F.lit(0))
    return C.drop_exact_duplicates(C.with_merge_key(rows, catalog), catalog)


def kept_docs(spark: SparkSession, sf: str, catalog: Catalog = DOCS) -> DataFrame:
    return C.drop_exact_duplicates(C.with_merge_key(docs(spark, sf, catalog), catalog), catalog)


def with_fields(catalog: Catalog, **changes: dict) -> Catalog:
    """The catalog with some options of some fields changed."""
    return replace(catalog, fields=tuple(replace(f, **changes.get(f.name, {})) for f in catalog))


# -- search and rank -------------------------------------------------------------------------------------------------


def shown_clusters(clusters: DataFrame, *more: str) -> DataFrame:
    date, price = F.col("merged.date"), F.col("merged.price")
    return clusters.select(
        "recid",
        "members",
        F.col("merged.title").alias("title"),
        F.col("merged.author").alias("author"),
        F.col("merged.medium").alias("medium"),
        V.print_range(date["min"], date["max"]).alias("date"),
        V.print_float(price["min"]).alias("price_low"),
        V.print_float(price["max"]).alias("price_high"),
        *more,
    )


@register
def search_page(spark: SparkSession, sf: str) -> DataFrame:
    """First page of the search: match, cluster, merge, rank, sort, page."""
    records = kept_offers(spark, sf, condition=FI.match(OFFERS, any_=["small", "widget"]))
    ranked = R.rank(records, OFFERS, QUERY)
    return shown_clusters(O.page(ranked, OFFERS), "relevance")


@register
def search_offers(spark: SparkSession, sf: str) -> DataFrame:
    """All clusters of offers that match, with merged fields."""
    records = kept_offers(spark, sf, condition=FI.match(OFFERS, all_=["widget"], none_=["old"]))
    return shown_clusters(M.merge_records(records, OFFERS))


def _ranked(spark: SparkSession, sf: str, **options) -> DataFrame:
    ranked = R.rank(kept_offers(spark, sf), OFFERS, QUERY, **options)
    return ranked.select("recid", "members", "relevance")


@register
def rank_offers(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf)


@register
def rank_offers_log(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf, length="log")


@register
def rank_offers_none(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf, length="none")


@register
def rank_offers_per_member(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf, cluster=False)


@register
def rank_offers_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Query-time weights: only the listed fields are ranked."""
    ranked = R.rank(kept_offers(spark, sf), OFFERS, "small widget standard", weights={"medium": "4", "title": "1"})
    return ranked.select("recid", "members", "relevance")


@register
def rank_offers_qualified(spark: SparkSession, sf: str) -> DataFrame:
    """A term qualified by a field takes the weight that the rank specification has for it."""
    ranked = R.rank(kept_offers(spark, sf), OFFERS, [("au", "brand"), "widget"])
    return ranked.select("recid", "members", "relevance")


@register
def rank_lead_follow(spark: SparkSession, sf: str) -> DataFrame:
    """Position decay and proximity bonus."""
    return _ranked(spark, sf, lead=0.5, follow=1.0)


@register
def rank_explain(spark: SparkSession, sf: str) -> DataFrame:
    ranked = R.rank(kept_offers(spark, sf), OFFERS, QUERY, explain=True)
    steps = ranked.select("recid", F.inline("explain"))
    return steps.select("recid", "term", "tf", "df", "n", F.round("idf", 9).alias("idf"), "add", "divided_by")


@register
def rank_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Ranking over the whole texts of the documents."""
    ranked = R.rank(kept_docs(spark, sf), DOCS, "the tion")
    return ranked.select("recid", "members", "relevance")


@register
def doc_freq_late(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequency when a term shows up late in a cluster: clusters by author only.

    The records are made once, in slices: copies have the same price, so that they are found in one slice.
    """
    catalog = with_fields(OFFERS, title={"mergekey": "no", "limitcluster": None}, medium={"mergekey": "no"}, author={"mergekey": "required"})
    terms = R.query_terms(QUERY, catalog)

    def counted_records(where: Column) -> DataFrame:
        rows = offers(spark, sf, catalog=catalog, where=where).withColumn("position", F.lit(0))
        records = C.drop_exact_duplicates(C.with_merge_key(rows, catalog, keys=["author", "medium"]), catalog)
        return R.with_term_counts(records, catalog, terms)

    counted = stored_parts((counted_records(s) for s in line_slices(spark, sf, "l_extendedprice")), "records")
    clusters = R.ranked_clusters(counted, catalog, terms).select("cluster", "members", "first_arrival", "first_hit")
    with tidy(spark):
        # stored, so that it is known before the join of records whether the clusters are few
        found = R.doc_freq(stored(clusters, "clusters"), counted, terms)
    # the numbers are on the driver; a count over the records carries them
    total = counted.agg(F.count(F.lit(1)).alias("records"))
    return total.select("records", F.lit(found.n).alias("n"), *[F.lit(d).alias(f"df_{t.text}") for t, d in zip(terms, found.df)])


# -- merge -----------------------------------------------------------------------------------------------------------


@register
def merge_longest(spark: SparkSession, sf: str) -> DataFrame:
    merged = M.merge_records(kept_offers(spark, sf), OFFERS)
    return merged.select("recid", F.col("merged.title").alias("title"), F.col("merged.author").alias("author"))


@register
def merge_range(spark: SparkSession, sf: str) -> DataFrame:
    merged = M.merge_records(kept_offers(spark, sf), OFFERS)
    return merged.select(
        "recid",
        F.col("merged.date.min").alias("year_low"),
        F.col("merged.date.max").alias("year_high"),
        F.col("merged.price.min").alias("price_low"),
        F.col("merged.price.max").alias("price_high"),
    )


def _merged_author(spark: SparkSession, sf: str, policy: str) -> DataFrame:
    catalog = with_fields(OFFERS, author={"merge": policy, "sortkey": "no"})
    rows = M.merge_values(kept_offers(spark, sf, catalog), catalog, ["author"])
    return rows.select(
        F.col("cluster").alias("recid"), F.col("disp").alias("author"), "arrival.l_orderkey", "arrival.l_linenumber", "ord"
    )


@register
def merge_unique(spark: SparkSession, sf: str) -> DataFrame:
    return _merged_author(spark, sf, "unique")


@register
def merge_all(spark: SparkSession, sf: str) -> DataFrame:
    return _merged_author(spark, sf, "all")


@register
def merge_first(spark: SparkSession, sf: str) -> DataFrame:
    return _merged_author(spark, sf, "first")


@register
def merge_values_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Merged values of the documents, one policy per field, in one pass."""
    rows = M.merge_values(kept_docs(spark, sf), DOCS, ["title", "lang", "quality"])
    return rows.select(F.col("cluster").alias("recid"), "field", "disp", F.col("arrival").alias("doc_id"), "num")


# -- sort and page ---------------------------------------------------------------------------------------------------


def _numbered(spark: SparkSession, sf: str, spec: list[tuple[str, bool]], clusters: DataFrame | None = None) -> DataFrame:
    """Clusters numbered along a sort order."""
    if clusters is None:
        clusters = M.merge_records(kept_offers(spark, sf), OFFERS)
    # the ranges are sampled first, so the clusters are needed twice
    clusters = stored(clusters, "clusters")
    return O.number_rows(clusters, O.sort_columns(OFFERS, spec), "rank").select("recid", "rank")


@register
def sort_title(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered(spark, sf, [("title", True)])


@register
def sort_author_title_desc(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered(spark, sf, [("author", False), ("title", False)])


@register
def sort_date_asc(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered(spark, sf, [("date", True), ("title", True)])


@register
def sort_date_desc(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered(spark, sf, [("date", False)])


@register
def sort_price_asc(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered(spark, sf, [("price", True)])


@register
def sort_price_desc(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered(spark, sf, [("price", False)])


@register
def sort_position(spark: SparkSession, sf: str) -> DataFrame:
    clusters = M.merge_records(kept_offers(spark, sf, position=True), OFFERS)
    return _numbered(spark, sf, [("position", False)], clusters)


@register
def sort_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieval order of the clusters, numbered from 1."""
    return _numbered(spark, sf, [("retrieval", True)])


@register
def sort_relevance(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered(spark, sf, [("relevance", False)], R.rank(kept_offers(spark, sf), OFFERS, QUERY))


@register
def sort_native(spark: SparkSession, sf: str) -> DataFrame:
    """The order of the only active source, which sorts its records itself; of several sources it would be that of the titles."""
    supplier = table(spark, sf, "supplier")
    first = F.col("s_suppkey") == supplier.agg(F.min("s_suppkey")).scalar()
    status = stored(supplier.select(F.col("s_name").alias("source"), first.alias("active"), F.lit(True).alias("native_sort")), "status")
    records = kept_offers(spark, sf, position=True).join(status.filter("active").select("source"), "source", "left_semi")
    spec = [("position", True)] if O.keeps_native_order(status) else [("title", True)]
    return _numbered(spark, sf, spec, M.merge_records(records, OFFERS))


@register
def page_title(spark: SparkSession, sf: str) -> DataFrame:
    """Third page of twenty by title."""
    clusters = stored(M.merge_records(kept_offers(spark, sf), OFFERS), "clusters")
    return O.page(clusters, OFFERS, [("title", True)], 40, 20).select("recid", "members")


@register
def page_past_end(spark: SparkSession, sf: str) -> DataFrame:
    """A page behind the last cluster is empty."""
    clusters = stored(M.merge_records(kept_offers(spark, sf), OFFERS), "clusters")
    return O.page(clusters, OFFERS, [("title", True)], 1000000, 20).select("recid", "members")


@register
def neighbours_title(spark: SparkSession, sf: str) -> DataFrame:
    clusters = stored(M.merge_records(kept_offers(spark, sf), OFFERS), "clusters")
    return O.neighbours(clusters, O.sort_columns(OFFERS, [("title", True)])).select("recid", "prev", "next")


# -- facets ----------------------------------------------------------------------------------------------------------


@register
def facets_top(spark: SparkSession, sf: str) -> DataFrame:
    counts = FA.facets(kept_offers(spark, sf), OFFERS)
    return FA.top_facets(counts, 15)


CHAINS = {"upper": TextChain((F.upper,)), "short": TextChain((trim_trailing("0123456789"), F.lower)), "mergekey": ENGLISH}


@register
def facets_chained(spark: SparkSession, sf: str) -> DataFrame:
    """Facets of fields with a chain of their own: the rule of a facet, and the rule of a field."""
    catalog = replace(with_fields(OFFERS, medium={"facetrule": "upper"}, author={"icurule": "short"}), chains={n: CHAINS[n] for n in ("upper", "short")})
    return FA.facets(kept_offers(spark, sf), catalog)


@register
def stemmed_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Documents clustered by the English stems of their titles; no SQL for the stems."""
    catalog = replace(DOCS, chains={"mergekey": CHAINS["mergekey"]})
    return C.with_merge_key(docs(spark, sf, catalog), catalog).select(F.col("arrival").alias("doc_id"), "cluster")


@register
def facets_all(spark: SparkSession, sf: str) -> DataFrame:
    return FA.facets(kept_docs(spark, sf), DOCS)


@register
def facets_year(spark: SparkSession, sf: str) -> DataFrame:
    """All facets of the documents, with the years of the whole texts: both ends of a range count."""
    catalog = with_fields(DOCS, quality={"type": "year", "termlist": True, "sortkey": "no"})
    rows = docs_table(spark, sf).withColumn("quality", F.col("text"))
    records = _docs_records(rows, catalog)
    return FA.facets(records, catalog)


def _docs_records(rows: DataFrame, catalog: Catalog) -> DataFrame:
    from concord.operators.records import table_records

    columns = {"title": "title", "body": "text", "lang": "lang", "quality": "quality"}
    return table_records(rows, catalog, columns, "source", "doc_id", "doc_id")


def _source_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of a supplier are ten times its account, at most 100 records are fetched."""
    hits = F.greatest(F.floor(F.col("s_acctbal")), F.lit(0))
    return table(spark, sf, "supplier").select(F.col("s_name").alias("source"), FA.term_factor(hits, F.lit(100)).alias("factor"))


@register
def facets_scaled(spark: SparkSession, sf: str) -> DataFrame:
    counts = FA.facets(kept_offers(spark, sf), OFFERS, weights=_source_weights(spark, sf))
    return FA.top_facets(counts, 10, ["medium", "author"])


def _reported(spark: SparkSession, sf: str, term: str) -> DataFrame:
    """Facets that the suppliers of one nation report themselves: brands by quantity."""
    line = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    supplier = table(spark, sf, "supplier").filter("s_nationkey < 5").select("s_suppkey", "s_name")
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    grouped = joined.groupBy(F.col("s_name").alias("source"), F.expr(term).alias("term"))
    counts = grouped.agg(F.sum("l_quantity").cast("long").alias("frequency"))
    return counts.select("source", F.lit("author").alias("facet"), "term", "frequency", F.col("term").alias("arrival"))


@register
def facets_reported(spark: SparkSession, sf: str) -> DataFrame:
    return FA.facets(kept_offers(spark, sf), OFFERS, reported=_reported(spark, sf, "p_brand"))


@register
def facets_split(spark: SparkSession, sf: str) -> DataFrame:
    """Reported terms of the form id:term."""
    told = _reported(spark, sf, "concat(p_size, ':', p_brand)")
    return FA.facets(kept_offers(spark, sf), OFFERS, reported=told, split={"author"})


@register
def facet_id_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return FA.facet_ids(_reported(spark, sf, "concat(p_size, ':', p_brand)"), OFFERS, {"author"})


@register
def facets_named(spark: SparkSession, sf: str) -> DataFrame:
    """A requested facet without terms still gives one row."""
    counts = FA.facets(kept_offers(spark, sf), OFFERS)
    return FA.top_facets(counts, 5, ["medium", "nothing"])


# -- scalar functions ------------------------------------------------------------------------------------------------


@register
def scalar_text(spark: SparkSession, sf: str) -> DataFrame:
    """Text functions over the whole texts and titles of the documents."""
    rows = docs_table(spark, sf)
    title, text = F.col("title"), F.col("text")
    return rows.select(
        "doc_id",
        X.trim_generic(title).alias("trimmed"),
        X.key_norm(title).alias("key"),
        X.sort_string(title).alias("sort"),
        X.skip_article(title).alias("no_article"),
        X.az_joined(title).alias("words"),
        F.md5(X.az_joined(text)).alias("text_words"),
        F.size(X.az_tokens(text)).alias("n_words"),
    )


@register
def scalar_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Years, dates and numbers in the urls and props of pages and events."""
    pages = table(spark, sf, "pages")
    year, date = V.years(F.col("html")), V.dates(F.col("html"))
    tail = F.regexp_extract("url", r"/(\d+[^/]*)$", 1)
    return pages.select(
        "page_id",
        year["min"].alias("year_low"),
        year["max"].alias("year_high"),
        date["min"].alias("date_low"),
        date["max"].alias("date_high"),
        V.print_range(year["min"], year["max"]).alias("years"),
        V.to_float(tail).alias("number"),
        V.leading_int(tail).alias("whole"),
    )


@register
def member_checksums(spark: SparkSession, sf: str) -> DataFrame:
    rows = offers(spark, sf, position=True)
    return rows.select("source", "position", V.checksum(F.col("source"), F.col("position")).alias("checksum"))


@register
def snippets_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Part names with the matching words marked."""
    part = table(spark, sf, "part")
    return part.select("p_partkey", X.snippet(F.col("p_name"), ["small", "widget", "red"]).alias("snippet"))


@register
def snippets_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Whole pages with the matching words marked and everything else escaped."""
    pages = table(spark, sf, "pages")
    return pages.select("page_id", F.md5(X.snippet(F.col("html"), ["the", "de", "und"])).alias("snippet"))

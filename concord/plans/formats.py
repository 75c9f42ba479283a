"""Queries over record formats and sinks. The records are made out of the tables, as XML, by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from concord.functions.text import sort_string, xml_escape
from concord.operators import clusters as C, merge as M, normalize as NO, rank as R, records as RE
from concord.plans.core import QUERY, kept_offers, with_fields
from concord.plans.sources import resolved
from concord.plans.views import ARRIVAL, DOCS, OFFERS, line_slices, offers_table, table
from concord.session import scratch_path, stored, stored_parts
from concord.sources import formats as FO, internal as I, marc as MA, settings as SE, sinks as SI, splits as SP

QUERIES = {}


def register(query):
    QUERIES[query.__name__] = query
    return query


# -- XML out of columns ------------------------------------------------------------------------------------------------


def _text(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else xml_escape(F.coalesce(value.cast("string"), F.lit("")))


def tag(element: str, *inner: Column | str, **attrs: str) -> Column:
    """An element around text columns or elements made by `tag` (which must not be escaped again)."""
    head = element + "".join(f' {k}="{v}"' for k, v in attrs.items())
    return F.concat(F.lit(f"<{head}>"), *[F.lit(x) if isinstance(x, str) else x for x in inner], F.lit(f"</{element}>"))


def leaf(element: str, value: Column | str, **attrs: str) -> Column:
    return tag(element, _text(value), **attrs)


def maybe(condition: Column, element: Column) -> Column:
    return F.when(condition, element).otherwise("")


def exploded(raw: DataFrame, *keep: str) -> DataFrame:
    """Rows of dynamic values; a value that is only a placeholder shows that."""
    rows = raw.select(*keep, F.explode_outer("values").alias("v")).filter("v IS NOT NULL")
    return rows.select(*keep, F.col("v.field").alias("field"), F.coalesce("v.value", F.concat(F.lit("empty:"), F.col("v.attrs")["empty"])).alias("value"))


# -- internal records ----------------------------------------------------------------------------------------------------


def order_payloads(spark: SparkSession, sf: str, where: Column | None = None) -> DataFrame:
    """Every order is a payload: a cluster of its line items, or one record. Some payloads are broken. `where` picks orders.

    The line items of an order are brought together as they are, which takes less than their XML.
    """
    record = tag(
        "record",
        leaf("metadata", F.col("p_name"), type="title"),
        leaf("metadata", F.col("p_type"), type="medium", rank="3"),
        leaf("metadata", F.col("l_year"), type="date"),
        '<metadata type="author" empty="nobody"/>',
        leaf("metadata", F.col("l_quantity"), type="quantity"),
    )
    lines = offers_table(spark, sf, where=where).select(*ARRIVAL, "p_name", "p_type", "l_year")
    rows = lines.repartition("l_orderkey").select("l_orderkey", F.struct(*ARRIVAL).alias("a"), record.alias("xml"))
    # the line items of one order
    orders = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("a", "xml"))).alias("r"))
    body = F.array_join(F.col("r.xml"), "")
    payload = F.when(F.size("r") > 1, F.concat(F.lit('<pz:cluster xmlns:pz="urn:x">'), body, F.lit("</pz:cluster>"))).otherwise(body)
    broken = F.when(F.col("l_orderkey") % 97 == 0, F.substr(payload, F.lit(1), F.length(payload) - 5)).when(
        F.col("l_orderkey") % 89 == 0, F.concat(F.lit("<other>"), payload, F.lit("</other>"))
    )
    return orders.select(
        F.concat(F.lit("orders "), F.col("l_orderkey") % 10).alias("source"),
        F.col("l_orderkey").alias("position"),
        F.col("l_orderkey").alias("arrival"),
        F.coalesce(broken, payload).alias("payload"),
    )


@register
def internal_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads and failures per source; a broken payload does not stop the others."""
    parsed = I.parse_payloads(order_payloads(spark, sf))
    return parsed.groupBy("source").agg(F.count(F.lit(1)).alias("payloads"), F.count("failure").alias("failures"))


def subrecords(spark: SparkSession, sf: str, where: Column | None = None) -> DataFrame:
    parsed = I.parse_payloads(order_payloads(spark, sf, where)).drop("payload", "failure")
    return C.explode_subrecords(parsed, OFFERS)


@register
def internal_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = subrecords(spark, sf).select("position", F.col("arrival.sub").alias("sub"), F.explode_outer("values").alias("v")).filter("v IS NOT NULL")
    return rows.select("position", "sub", "v.field", "v.value", F.col("v.attrs")["rank"].alias("rank"), F.col("v.attrs")["empty"].alias("placeholder"))


@register
def cluster_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Sub-records share the keys of their payload; payloads with a common key are one cluster.

    The payloads are parsed once: links and clusters are made of stored keys. They are made in slices of orders, since the shuffles of the
    joins and of the orders take several times the tables.
    """
    slices = (subrecords(spark, sf, where) for where in line_slices(spark, sf, "l_orderkey"))
    columns = ["position", F.col("arrival.sub").alias("sub"), "keys", F.size("keys").alias("n_keys")]
    rows = stored_parts((rows.select(*columns) for rows in slices), "subrecords")
    # the sub-records of a payload have the same keys
    return C.assign_clusters(rows, rows.filter("sub = 0")).select("position", "sub", "cluster", "n_keys")


@register
def value_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """A rank that comes with a value goes before the catalog."""
    records = RE.type_values(RE.conform(subrecords(spark, sf), OFFERS), OFFERS)
    terms = R.query_terms("widget large", OFFERS)
    counted = R.with_term_counts(records, OFFERS, terms, value_rank=True)
    return counted.select("position", F.col("arrival.sub").alias("sub"), *[F.col("tf")[i].alias(f"tf_{t.text}") for i, t in enumerate(terms)])


# -- MARC ------------------------------------------------------------------------------------------------------------------


def parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part")


def _marc(turbo: bool) -> Column:
    """A MARC record of a part, with tag attributes or with an element per tag."""
    key, name, brand, kind, size = (F.col(c) for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    sub = (lambda c, v: leaf(f"s{c}", v)) if turbo else (lambda c, v: leaf("subfield", v, code=c))
    field = (lambda t, *s: tag(f"d{t}", *s, i1=" ")) if turbo else (lambda t, *s: tag("datafield", *s, tag=t, ind1=" "))
    ctrl = (lambda t, v: leaf(f"c{t}", v)) if turbo else (lambda t, v: leaf("controlfield", v, tag=t))
    kind4 = size % 4
    leader = F.when(kind4 == 0, "00000cam").when(kind4 == 1, "00000cjm").when(kind4 == 2, "00000cgm").otherwise("00000cas")
    c007 = F.when(kind4 == 1, "sd fsngnn").when(kind4 == 2, "vd cvaizq").otherwise("ta")
    year = F.lit(1950) + size
    form = F.when(key % 5 == 0, "o").otherwise(" ")
    # date type, years, then the form at 24, the serial type at 22 and the visual type at 34
    c008 = F.concat(F.lit("960101"), F.when(key % 2 == 0, "s").otherwise("d"), year, year + 9, F.lit("xxu   n"), F.lit(" "), form, F.lit("         v  eng"))
    return tag(
        "r" if turbo else "record",
        leaf("l" if turbo else "leader", leader),
        ctrl("001", F.concat(F.when(key % 2 == 0, "ocm").otherwise("x"), key)),
        ctrl("007", c007),
        ctrl("008", c008),
        field("020", sub("a", F.concat(F.lit("isbn "), key))),
        field("035", sub("b", F.concat(F.lit("nr "), key))),
        field("100", sub("a", F.concat(brand, F.lit(", Ann B.")))),
        field("245", sub("a", F.concat(F.lit(" "), name, F.lit(" : "))), sub("b", kind), sub("c", brand)),
        maybe(key % 3 == 0, field("260", sub("a", F.lit("Town :")), sub("b", brand), sub("c", F.concat(F.lit("[c"), year, F.lit("]."))))),
       
        field("500", sub("a", F.lit("note & more")), sub("b", name)),
        field("650", sub("a", kind), sub("x", F.concat(name, F.lit(","))), sub("z", brand)),
        field("650", sub("a", name)),
        maybe(key % 4 == 0, field("773", sub("t", F.concat(F.lit("Journal of "), name)), sub("g", F.concat(F.lit("Vol. "), size, F.lit(", issue "), size % 9, F.lit(", p "), key, F.lit("-"), key + 9)))),
        field("852", sub("a", F.lit("Main")), sub("b", kind), sub("h", F.concat(F.lit("QA "), size)), sub("i", brand), sub("y", (size % 2).cast("string"))),
        field("856", sub("u", F.concat(F.lit("http://x/"), key)), sub("3", F.lit("Full text"))),
        maybe(key % 7 == 0, field("903", sub("a", (year + 1).cast("string")))),
        field("945", sub("a", kind), sub("b", F.concat(F.lit("C"), size)), sub("s", F.when(size % 2 == 0, "N").otherwise("-")), sub("d", F.lit("due"))),
        field("9", sub("a", F.lit("short tag"))) if not turbo else F.lit(""),
    )


def marc_payloads(spark: SparkSession, sf: str, turbo: bool = False) -> DataFrame:
    return parts(spark, sf).select(F.col("p_partkey"), _marc(turbo).alias("payload"))


def marc_frame(spark: SparkSession, sf: str) -> DataFrame:
    return MA.parse_marcxml(marc_payloads(spark, sf)).drop("payload")


@register
def marc_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Long rows of the MARC records: tags have three characters, values are trimmed."""
    return MA.marc_rows(marc_frame(spark, sf), "p_partkey").select("p_partkey", "tag", "value", "code", "sub_value")


def _files(spark: SparkSession, records: DataFrame, name: str) -> str:
    """Records `p_size, value` as a file of XML per size, with line breaks inside the records; the path of the folder."""
    path = scratch_path(spark, name)
    lines = records.select("p_size", F.regexp_replace("value", "><", ">\n<").alias("value"))
    lines.repartition("p_size").write.partitionBy("p_size").text(path)
    return path


@register
def marc_files(spark: SparkSession, sf: str) -> DataFrame:
    """The long rows of MARC records that are read from files, in splits."""
    path = _files(spark, parts(spark, sf).select("p_size", _marc(False).alias("value")), "marc")
    found = MA.marc_rows(MA.read_marcxml(spark, path), "c001").filter("tag <> '001'")
    key = F.regexp_extract("c001", r"(\d+)", 1).cast("bigint").alias("p_partkey")
    return found.select(key, "tag", "value", "code", "sub_value")


def _part_records(spark: SparkSession, sf: str) -> DataFrame:
    """Internal records of the parts; every 50th lacks its end, and every 70th is empty."""
    title = leaf("metadata", F.col("p_name"), type="title")
    medium = leaf("metadata", F.col("p_type"), type="medium", rank="3")
    key = leaf("metadata", F.col("p_partkey"), type="id")
    broken = F.concat(F.lit("<record>"), title, F.lit('<metadata type="medium">lost'))
    value = F.when(F.col("p_partkey") % 50 == 0, broken).when(F.col("p_partkey") % 70 == 0, "<record/>")
    return parts(spark, sf).select("p_size", F.coalesce(value, tag("record", title, medium, key)).alias("value"))


def record_folder(spark: SparkSession, sf: str) -> str:
    """A folder of files of these records, one per size."""
    return _files(spark, _part_records(spark, sf), "internal")


@register
def record_files(spark: SparkSession, sf: str) -> DataFrame:
    """Values of internal records that are read from files, in splits."""
    rows = I.read_records(spark, record_folder(spark, sf))
    rows = I.first_values(rows).select(F.posexplode_outer("values").alias("n", "v")).filter("v IS NOT NULL")
    return rows.groupBy("v.field", "v.value", F.col("v.attrs")["rank"].alias("rank")).agg(F.count(F.lit(1)).alias("records"))


@register
def converted_records(spark: SparkSession, sf: str) -> DataFrame:
    """Files of internal records to documents in as many tasks as there are splits, with a log per file."""
    source = record_folder(spark, sf)
    done = SP.convert_records(spark, source, scratch_path(spark, "converted"), I.parse_payloads)
    return done.log.select(F.regexp_extract("file", r"p_size=(\d+)", 1).cast("int").alias("p_size"), "documents", "failures")


@register
def marc21_fields(spark: SparkSession, sf: str) -> DataFrame:
    return exploded(MA.map_marc21(marc_frame(spark, sf)), "p_partkey")


@register
def turbomarc_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The same records from the element-per-tag form."""
    parsed = MA.parse_turbomarc(marc_payloads(spark, sf, turbo=True)).drop("payload")
    return exploded(MA.map_marc21(parsed), "p_partkey")


MAPPING = """
001 $ id

245 a title
245 * title-all
650 a subject
650 * subject-long
"""


@register
def marc_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """A mapping table of the caller; the table is read from a text file."""
    path = scratch_path(spark, "mapping")
    lines = [(line,) for line in MAPPING.splitlines()]
    spark.createDataFrame(lines, "value string").coalesce(1).write.text(path)
    mapping = MA.read_mapping(spark, path)
    return exploded(MA.map_marc(marc_frame(spark, sf), mapping), "p_partkey")


@register
def marc_medium_simple(spark: SparkSession, sf: str) -> DataFrame:
    return marc_frame(spark, sf).select("p_partkey", MA.derive_medium("simple").alias("medium"))


@register
def marc_open_url(spark: SparkSession, sf: str) -> DataFrame:
    return marc_frame(spark, sf).select("p_partkey", MA.open_url(F.lit("http://resolver/x"), "catalog").alias("url"))


@register
def citation_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Volume, issue and pages out of citations of several forms."""
    key, size = F.col("p_partkey"), F.col("p_size")
    text = (
        F.when(key % 4 == 0, F.concat(F.lit("Vol. "), size, F.lit(", no. 4, issue "), key % 12, F.lit(" (May), p. "), key))
        .when(key % 4 == 1, F.concat(F.lit("v "), size, F.lit(" issue "), size, F.lit(",p"), key, F.lit("-"), key + 3))
        .when(key % 4 == 2, F.concat(F.col("p_name"), F.lit(" pages "), key))
        .otherwise(F.col("p_name"))
    )
    return parts(spark, sf).select("p_partkey", F.inline(F.array(MA.parse_citation(text))))


@register
def unimarc_fields(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    sub = lambda c, v: leaf("subfield", v, code=c)
    field = lambda t, *s: tag("datafield", *s, tag=t)
    payload = tag(
        "record",
        leaf("controlfield", key, tag="001"),
        field("010", sub("a", F.concat(F.lit("i"), key))),
        field("020", sub("a", F.when(key % 2 == 0, "US").otherwise("FR")), sub("b", F.concat(F.lit("l"), key))),
        field("200", sub("a", F.col("p_name"))),
        field("210", sub("d", F.lit(1950) + F.col("p_size"))),
        field("300", sub("a", F.col("p_type")), sub("b", F.lit("x"))),
        field("325", sub("a", F.lit("not a note"))),
        field("606", sub("a", F.col("p_type"))),
        field("701", sub("a", F.col("p_brand")), sub("b", F.lit("Ann"))),
    )
    rows = parts(spark, sf).select("p_partkey", payload.alias("payload"))
    return exploded(MA.map_unimarc(MA.parse_marcxml(rows)), "p_partkey")


@register
def danmarc2_fields(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    sub = lambda c, v: leaf("subfield", v, code=c)
    field = lambda t, *s: tag("datafield", *s, tag=t)
    payload = tag(
        "record",
        field("001", sub("a", key)),
        field("100", sub("a", F.col("p_brand"))),
        maybe(key % 2 == 0, field("245", sub("a", F.col("p_name")), sub("h", F.concat(F.lit("[x"), F.col("p_type"), F.lit("] y"))))),
        maybe(key % 2 == 1, field("245", sub("a", F.col("p_name")))),
        field("504", sub("a", F.lit("a note")), sub("b", F.lit("x"))),
        field("530", sub("a", F.lit("not a note"))),
        field("666", sub("a", F.col("p_type")), sub("b", F.col("p_name"))),
        field("773", sub("t", F.lit(" In  all ")), sub("g", key)),
    )
    rows = parts(spark, sf).select("p_partkey", payload.alias("payload"))
    mapped = MA.map_danmarc2(MA.parse_marcxml(rows))
    key_rows = mapped.select("p_partkey", F.lit("key").alias("field"), F.col("key").alias("value"))
    return exploded(mapped, "p_partkey").union(key_rows)


# -- Dublin Core, Solr, Primo, generic -----------------------------------------------------------------------------------------


def doc_payload(root: str = "dc") -> Column:
    title = F.substring_index("text", "\n", 1)
    return tag(
        root,
        leaf("dc:identifier", F.col("doc_id"), **{"xmlns:dc": "urn:dc"}),
        leaf("dc:title", title, **{"xmlns:dc": "urn:dc"}),
        leaf("dc:creator", F.col("source"), **{"xmlns:dc": "urn:dc"}),
        leaf("dc:subject", F.col("lang"), **{"xmlns:dc": "urn:dc"}),
        leaf("dc:subject", F.col("n_chars"), **{"xmlns:dc": "urn:dc"}),
        leaf("dc:description", F.col("text"), **{"xmlns:dc": "urn:dc"}),
    )


def doc_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _doc_values(raw: DataFrame) -> DataFrame:
    """Values of documents, long ones as digests."""
    rows = exploded(raw, "doc_id")
    return rows.withColumn("value", F.when(F.col("field").isin("description", "title"), F.md5("value")).otherwise(F.col("value")))


@register
def dc_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Dublin Core records of the whole documents."""
    return _doc_values(FO.map_dc(doc_rows(spark, sf).select("doc_id", doc_payload().alias("payload")), medium="text"))


@register
def oai_dc_fields(spark: SparkSession, sf: str) -> DataFrame:
    header = tag("header", leaf("identifier", F.concat(F.lit("oai:"), F.col("doc_id"))))
    payload = tag("record", header, tag("metadata", doc_payload("dc")))
    return _doc_values(FO.map_oai_dc(doc_rows(spark, sf).select("doc_id", payload.alias("payload"))))


@register
def opensearch_fields(spark: SparkSession, sf: str) -> DataFrame:
    payload = tag("object", leaf("identifier", F.concat(F.lit("os:"), F.col("doc_id"))), doc_payload("record"))
    return _doc_values(FO.map_opensearch(doc_rows(spark, sf).select("doc_id", payload.alias("payload"))))


@register
def dkabm_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Objects with a score around DKABM records; a payload is a cluster of two objects."""
    one = tag("object", leaf("score", F.col("n_chars") / 8), doc_payload("record"))
    two = tag("object", leaf("score", F.lit("0.5")), tag("record", leaf("title", F.col("source"))))
    payload = tag("searchResult", one, two)
    parsed = FO.map_dkabm(doc_rows(spark, sf).select("doc_id", payload.alias("payload")))
    rows = parsed.select("doc_id", F.posexplode_outer("subrecords").alias("sub", "r")).select("doc_id", "sub", F.explode_outer("r.values").alias("v"))
    value = F.when(F.col("v.field").isin("description", "title"), F.md5("v.value")).otherwise(F.col("v.value"))
    return rows.select("doc_id", "sub", "v.field", value.alias("value"))


def solr_payload() -> Column:
    licenses = F.when(F.col("p_size") % 3 == 0, "http://creativecommons.org/licenses/by-sa/4.0").when(F.col("p_size") % 3 == 1, "http://creativecommons.org/about/cc0").otherwise("http://other")
    return tag(
        "doc",
        leaf("str", F.col("p_partkey"), name="id"),
        leaf("float", F.col("p_retailprice"), name="price"),
        leaf("date", F.lit(1950) + F.col("p_size"), name="date"),
        tag("arr", leaf("str", F.col("p_name")), leaf("str", F.col("p_type")), name="title"),
        tag("arr", leaf("str", F.col("p_type")), name="medium"),
        tag("arr", leaf("str", licenses), name="license_url"),
    )


@register
def solr_fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = parts(spark, sf).select("p_partkey", solr_payload().alias("payload"))
    return exploded(FO.map_solr_doc(rows), "p_partkey")


@register
def solr_fields_medium(spark: SparkSession, sf: str) -> DataFrame:
    """A medium of the caller takes the place of the one in the document."""
    rows = parts(spark, sf).select("p_partkey", solr_payload().alias("payload"))
    return exploded(FO.map_solr_doc(rows, medium="book"), "p_partkey").filter("field = 'medium'")


@register
def primo_fields(spark: SparkSession, sf: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    addata = tag(
        "addata",
        leaf("date", F.concat(F.lit(1950) + size, F.lit("0102"))),
        leaf("volume", size),
        maybe(key % 2 == 0, leaf("spage", key)),
        maybe(key % 4 == 0, leaf("epage", key + 5)),
        maybe(key % 6 == 0, leaf("pages", F.concat(key, F.lit("-"), key + 7))),
        leaf("issn", F.concat(F.lit("1234-"), size)),
        leaf("jtitle", F.col("p_type")),
    )
    record = tag(
        "record",
        tag("control", leaf("recordid", F.concat(F.lit("TN_"), key))),
        tag("display", leaf("type", F.when(key % 3 == 0, "article").otherwise("book")), leaf("title", F.col("p_name")), leaf("ispartof", F.col("p_type"))),
        tag("search", leaf("creatorcontrib", F.col("p_brand")), leaf("creatorcontrib", F.lit("Second")), leaf("sub", F.col("p_type"))),
        tag("facets", leaf("topic", F.col("p_name"))),
        tag("delivery", leaf("fulltext", F.when(key % 2 == 0, "fulltext").otherwise("no_fulltext"))),
        addata,
    )
    payload = tag("DOC", tag("PrimoNMBib", record), tag("LINKS", leaf("openurl", F.concat(F.lit("http://o/"), key))))
    rows = parts(spark, sf).select("p_partkey", payload.alias("payload"))
    return exploded(FO.map_primo(rows), "p_partkey")


@register
def generic_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as generic connector records: url, title and any other element."""
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    payload = tag(
        "record",
        leaf("date", F.col("page_id")),
        leaf("url", F.col("url")),
        leaf("title", title),
        leaf("medium", "web"),
        leaf("startpage", F.col("page_id")),
        maybe(F.col("page_id") % 2 == 0, leaf("endpage", F.col("page_id") + 4)),
        leaf("body", F.col("html")),
        tag("item", leaf("location", F.lit("A & B")), leaf("callno", F.col("page_id"))),
    )
    rows = table(spark, sf, "pages").select("page_id", payload.alias("payload"))
    values = exploded(FO.map_generic(rows), "page_id")
    return values.withColumn("value", F.when(F.col("field").isin("body", "title", "title-complete"), F.md5("value")).otherwise(F.col("value")))


@register
def opac_holdings(spark: SparkSession, sf: str) -> DataFrame:
    """Holdings of an OPAC record go to its bibliographic record: suppliers that hold a part."""
    line = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber").distinct()
    held = tag(
        "holding",
        leaf("localLocation", F.concat(F.lit("S"), F.col("l_suppkey"))),
        maybe(F.col("l_linenumber") % 2 == 0, leaf("callNumber", F.col("l_linenumber"))),
        tag("circulations", tag("circulation", F.concat(F.lit('<availableNow value="'), F.col("l_linenumber") % 2, F.lit('"/>')), leaf("availabilityDate", "2030"))),
    )
    # the suppliers of one part
    rows = line.groupBy(F.col("l_partkey").alias("position")).agg(F.array_join(F.collect_list(held), "").alias("h"))
    payloads = rows.select(F.lit("opac").alias("source"), "position", tag("opacRecord", tag("holdings", F.col("h"))).alias("payload"))
    value = F.struct(F.lit("title").alias("field"), F.col("p_name").alias("value"), F.create_map().cast(RE.ATTRS).alias("attrs"))
    raw = parts(spark, sf).select(F.lit("opac").alias("source"), F.col("p_partkey").alias("position"), F.array(value).alias("values"))
    return exploded(FO.map_opac_holdings(payloads, raw), "position")


# -- settings files, normalizers -------------------------------------------------------------------------------------------------


def settings_files(spark: SparkSession, sf: str) -> DataFrame:
    """One settings document per supplier; the value may come from the parent, some rows are incomplete."""
    key = F.col("s_suppkey")
    opening = F.concat(F.lit('<settings target="'), F.col("s_name"), F.lit('" precedence="'), F.col("s_nationkey"), F.lit('">'))
    body = F.concat(
        F.lit('<set name="pz:name" value="'), key, F.lit('"/>'),
        F.lit('<set name="pz:allow" value="1" target="*" precedence="3"/>'),
        F.lit('<set name="pz:map" value="not this">\n  <map n="'), key, F.lit('"><x>1 &amp; 2</x></map>\n</set>'),
        F.when(key % 2 == 0, '<set name="pz:elements"/>').otherwise('<set value="x"/>'),
    )
    payload = F.concat(opening, body, F.lit("</settings>"))
    return table(spark, sf, "supplier").select(F.col("s_name").alias("file"), payload.alias("payload"))


@register
def settings_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = SE.complete_settings(SE.parse_settings(settings_files(spark, sf)))
    return rows.select("file", "target", "name", "value", "precedence")


@register
def settings_rejected(spark: SparkSession, sf: str) -> DataFrame:
    return SE.rejected_settings(SE.parse_settings(settings_files(spark, sf)))


@register
def normalized_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Every brand is a source with a format of its own; one names a normalizer that does not exist."""
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    dc = tag("dc", leaf("title", F.col("p_name")))
    payload = F.when(number % 4 == 0, dc).when(number % 4 == 1, _marc(False)).otherwise(solr_payload())
    raw = parts(spark, sf).select(F.col("p_brand").alias("source"), F.col("p_partkey").alias("position"), payload.alias("payload"))
    name = F.when(number % 4 == 0, "dc").when(number % 4 == 1, "auto").when(number % 4 == 2, "solr,keep").otherwise("nothing")
    settings = F.create_map(F.lit("pz:xslt"), name, F.lit("pz:requestsyntax"), F.lit("MARC21"))
    sources = parts(spark, sf).select("p_brand").distinct().select(F.col("p_brand").alias("source"), settings.alias("settings"))
    registry = {"dc": FO.map_dc, "marc21": lambda df: MA.map_marc21(MA.parse_marcxml(df)), "solr": FO.map_solr_doc, "keep": lambda df: df}
    done = NO.normalize_by_source(raw, sources, registry, chains=["solr,keep"])
    titles = F.transform(F.filter("values", lambda v: v["field"] == "title"), lambda v: v["value"])
    return done.select("source", "position", "failure", F.get(titles, F.lit(0)).alias("title"))


@register
def rejected_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records that did not come through the normalizer."""
    raw = order_payloads(spark, sf)
    return NO.normalize(raw, [I.parse_payloads])[1]


@register
def converted_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Files of raw records to documents, with a log per file."""
    source, target = scratch_path(spark, "raw"), scratch_path(spark, "documents")
    broken = F.when(F.col("p_partkey") % 50 == 0, "<doc><str>").otherwise(solr_payload())
    rows = parts(spark, sf).select(F.regexp_replace(broken, "\n", " ").alias("value"), "p_size")
    rows.repartition("p_size").write.partitionBy("p_size").text(source)

    def records(files: DataFrame) -> DataFrame:
        lines = files.select("file", F.explode(F.split("payload", "\n")).alias("payload")).filter("payload <> ''")
        return FO.map_solr_doc(lines)

    log = SI.convert_corpus(spark, source, target, records)
    return log.select(F.regexp_extract("file", r"p_size=(\d+)", 1).cast("int").alias("p_size"), "documents", "failures")


# -- results -----------------------------------------------------------------------------------------------------------------------


def _results(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    records = kept_offers(spark, sf, position=True)
    return R.rank(records, OFFERS, QUERY), records


@register
def result_locations(spark: SparkSession, sf: str) -> DataFrame:
    """Members as they are shown: id, name or Unknown, checksum, printed fields, snippet of the title."""
    from concord.functions.text import snippet

    records = kept_offers(spark, sf, position=True)
    mark = lambda text: snippet(text, ["small", "widget"])
    rows = SI.locations(records, resolved(spark, sf), OFFERS, brief=True, snippet=mark)
    one = lambda n: F.get(F.col(f"md.{n}"), F.lit(0))["value"]
    return rows.select("id", "name", "checksum", one("title").alias("title"), one("date").alias("date"), one("price").alias("price"))


@register
def result_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Hits with all merged values, list fields too, and all fields of every member."""
    catalog = with_fields(OFFERS, author={"merge": "unique", "sortkey": "no"}, medium={"merge": "all"})
    records = stored(kept_offers(spark, sf, position=True), "records")
    docs = SI.to_result_docs(R.rank(records, catalog, QUERY), records, catalog, resolved(spark, sf))
    none = F.lit(None).cast("string")
    value = lambda n: F.get(F.col(f"md.`{n}`"), F.lit(0))["value"].alias(n)
    ends = lambda n, form: F.concat_ws("/", form(F.col(f"merged.{n}.min")), form(F.col(f"merged.{n}.max"))).alias(n)
    money = lambda c: F.format_string("%.6f", c)
    hit = docs.hits.select(
        "recid", F.lit("hit").alias("kind"), none.alias("id"), none.alias("name"), F.col("count").alias("number"),
        "merged.title", none.alias("author"), none.alias("medium"), none.alias("date"), ends("price", money),
    )
    only = lambda n: F.when(F.col("field") == n, F.col("disp")).alias(n)
    listed = docs.values.select(
        "recid", F.lit("value"), none, none, F.lit(None).cast("bigint"), none, only("author"), only("medium"), none, none
    )
    shown = [value(n) for n in ("title", "author", "medium", "date", "price")]
    member = docs.members.select("recid", F.lit("member"), "id", "name", "checksum", *shown)
    return hit.union(listed).union(member)


@register
def result_json(spark: SparkSession, sf: str) -> DataFrame:
    """First page of hits as JSON documents."""
    clusters, _ = _results(spark, sf)
    brief = SI.project(clusters, OFFERS, brief=True)
    return brief.orderBy(F.col("relevance").desc(), "recid").limit(20).select("recid", F.to_json(F.struct("merged.title", "merged.medium", "members", "relevance")).alias("doc"))


@register
def one_record(spark: SparkSession, sf: str) -> DataFrame:
    """Members of one cluster with their checksums."""
    clusters, records = _results(spark, sf)
    rows = SI.get_record(clusters, records, "content: title small widget author brand medium small")
    return rows.select("source", "position", "checksum")


@register
def one_member(spark: SparkSession, sf: str) -> DataFrame:
    clusters, records = _results(spark, sf)
    rows = SI.get_record(clusters, records, "content: title small widget author brand medium small", offset=7)
    return rows.select("source", "position", "checksum")


@register
def snippet_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents for result clustering."""
    clusters = M.merge_records(kept_offers(spark, sf), OFFERS)
    return SI.to_snippet_docs(clusters, snippet=("medium", "author"))


@register
def snippet_docs_listed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents for result clustering whose snippets are lists: all media and authors of the offers of a title."""
    catalog = with_fields(OFFERS, author={"merge": "unique", "sortkey": "no", "mergekey": "no"}, medium={"merge": "unique", "mergekey": "no"})
    records = kept_offers(spark, sf, catalog)
    values = M.merge_values(records, catalog, ["author", "medium"])
    return SI.to_snippet_docs(M.merge_records(records, catalog), snippet=("medium", "author"), values=values)

"""Other record formats: Dublin Core, OAI-DC, DKABM, Solr documents, Primo, generic connector records, OPAC holdings.

Every mapper takes a frame with a payload column and adds `values`, the dynamic values of a raw frame, and `failure`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from concord.sources.elements import with_children
from concord.sources.internal import RAW_VALUES

XML_OPTIONS = {"mode": "PERMISSIVE", "ignoreNamespace": "true"}
# placeholder shown for an empty value
EMPTY = "NULL_VALUE"

# -- fixed values ------------------------------------------------------------------------------------------------------

# element of a Dublin Core record and the field it gives
DC_FIELDS = (
    ("title", "title"),
    ("date", "date"),
    ("subject", "subject"),
    ("creator", "author"),
    ("description", "description"),
    ("identifier", "electronic-url"),
    ("type", "medium"),
    ("bibliographicCitation", "citation"),
)

# license URL, whether it is a prefix, and its name
LICENSES = (
    ("http://creativecommons.org/licenses/by/", True, "CC By"),
    ("http://creativecommons.org/licenses/by-sa/", True, "CC By-SA"),
    ("http://creativecommons.org/licenses/by-nd/", True, "CC By-ND"),
    ("http://creativecommons.org/licenses/by-nc/", True, "CC By-NC"),
    ("http://creativecommons.org/licenses/by-nc-sa/", True, "CC By-NC-SA"),
    ("http://creativecommons.org/licenses/by-nc-nd/", True, "CC By-NC-ND"),
    ("http://creativecommons.org/licenses/by-nd-sa/", True, "CC By-ND-SA"),
    ("http://creativecommons.org/about/cc0", False, "CC0 (public domain)"),
    ("http://creativecommons.org/about/pdm2", False, "CC PDL (public domain)"),
    ("http://www.rioxx.net/licenses/all-rights-reserved", False, "All rights reserved"),
    ("http://www.rioxx.net/licenses/under-embargo-all-rights-reserved", False, "Under embargo"),
)

# element of a generic connector record and the fields it gives; other elements give a field of their own name
GENERIC_FIELDS = {
    "date": ("publication-date", "date"),
    "url": ("electronic-url",),
    "title": ("title", "title-complete"),
    "journaltitle": ("journal-title",),
    "location": ("locallocation",),
    "callno": ("callnumber",),
    "volume": ("volume-number",),
    "issue": ("issue-number",),
}
# parts of an item and of an affiliation
GENERIC_PARTS = {
    "item": (("due", "due"), ("location", "locallocation"), ("callno", "callnumber"), ("available", "available"), ("publicnote", "publicnote")),
    "affiliation": (("person", "affiliation-person"), ("institution", "affiliation-institution")),
}


# -- helpers -----------------------------------------------------------------------------------------------------------


def _value(field: str | Column, text: Column, empty: bool = False) -> Column:
    attrs = F.create_map(F.lit("empty"), F.lit(EMPTY)) if empty else F.create_map().cast("map<string,string>")
    text = F.nullif(text, F.lit("")) if empty else text
    name = F.lit(field) if isinstance(field, str) else field
    return F.struct(name.alias("field"), text.alias("value"), attrs.alias("attrs"))


def _each(field: str, texts: Column) -> Column:
    none = F.array().cast(RAW_VALUES)
    return F.coalesce(F.transform(F.filter(texts, lambda t: t.isNotNull()), lambda t: _value(field, t)), none)


def _one(field: str, text: Column) -> Column:
    return _each(field, F.array(text))


def _parse(payloads: DataFrame, column: str, schema: str) -> DataFrame:
    parsed = payloads.withColumn("x", F.from_xml(F.col(column), f"{schema}, _corrupt_record string", XML_OPTIONS))
    failure = F.when(F.col("x").isNull() | F.col("x._corrupt_record").isNotNull(), "ingest")
    return parsed.withColumn("failure", failure)


def _finish(parsed: DataFrame, values: Column) -> DataFrame:
    kept = F.filter(values, lambda v: (v["value"] != "") | F.map_contains_key(v["attrs"], "empty"))
    return parsed.withColumn("values", F.when(F.col("failure").isNull(), kept).cast(RAW_VALUES)).drop("x")


def _texts(*names: str) -> str:
    return ", ".join(f"`{n}` array<string>" for n in names)


def _texts_in(*names: str) -> str:
    return ",".join(f"`{n}`:array<string>" for n in names)


# -- Dublin Core family --------------------------------------------------------------------------------------------------

_DC_NAMES = ("identifier", "title", "date", "subject", "creator", "description", "type", "bibliographicCitation")


def _dc_values(record: str, identifier: Column) -> Column:
    return F.concat(_one("id", identifier), *[_each(field, F.col(f"{record}.{name}")) for name, field in DC_FIELDS])


def map_dc(payloads: DataFrame, column: str = "payload", medium: str | None = None) -> DataFrame:
    """Dublin Core records; `medium` is added as a constant."""
    parsed = _parse(payloads, column, _texts(*_DC_NAMES))
    values = F.concat(_dc_values("x", F.get("x.identifier", F.lit(0))), _one("medium", F.lit(medium).cast("string")))
    return _finish(parsed, values)


def map_oai_dc(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """OAI records with a Dublin Core part; the id comes from the header."""
    dc = _texts_in(*_DC_NAMES)
    parsed = _parse(payloads, column, f"header struct<identifier:string>, metadata struct<dc:struct<{dc}>>")
    return _finish(parsed, _dc_values("x.metadata.dc", F.col("x.header.identifier")))


def map_dkabm(payloads: DataFrame, column: str = "payload", medium: str | None = None) -> DataFrame:
    """DKABM records in OpenSearch objects, with the relevance score of the object. Several objects per payload give
    `subrecords array<struct<key, values>>`."""
    dc = _texts_in(*_DC_NAMES)
    parsed = _parse(payloads, column, f"object array<struct<score:string,record:struct<{dc}>>>")

    def record(o: Column) -> Column:
        r = o["record"]
        parts = [_one("score", o["score"]), _one("id", F.get(r["identifier"], F.lit(0)))]
        parts += [_each(field, r[name]) for name, field in DC_FIELDS]
        parts.append(_one("medium", F.lit(medium).cast("string")))
        return F.struct(F.lit(None).cast("string").alias("key"), F.concat(*parts).alias("values"))

    return parsed.withColumn("subrecords", F.transform("x.object", record)).drop("x")


def map_opensearch(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """OpenSearch objects with one DKABM record; the id comes from the object."""
    dc = _texts_in(*_DC_NAMES)
    parsed = _parse(payloads, column, f"identifier string, record struct<{dc}>")
    return _finish(parsed, _dc_values("x.record", F.col("x.identifier")))


# -- Solr ----------------------------------------------------------------------------------------------------------------


def license_name(url: Column) -> Column:
    """Name of a license URL."""
    name = F
    for address, prefix, label in LICENSES:
        condition = F.startswith(url, F.lit(address)) if prefix else url == address
        name = name.when(condition, label)
    return name.otherwise("[unknown]")


def map_solr_doc(payloads: DataFrame, column: str = "payload", medium: str | None = None) -> DataFrame:
    """Solr documents: every named `str`, `float`, `date` and every member of a named `arr` is a field of that name.

    A `medium` of the caller comes instead of the one in an array. License URLs in arrays also give their name.
    """
    named = "array<struct<_name:string,_VALUE:string>>"
    parsed = _parse(payloads, column, f"str {named}, float {named}, date {named}, arr array<struct<_name:string,str:array<string>>>")
    none = F.array().cast(RAW_VALUES)
    plain = lambda kind: F.coalesce(
        F.transform(F.filter(f"x.{kind}", lambda v: v["_name"].isNotNull()), lambda v: _value(v["_name"], v["_VALUE"])), none
    )

    def array_values(a: Column) -> Column:
        values = F.transform(a["str"], lambda t: _value(a["_name"], t))
        names = F.when(a["_name"] == "license_url", F.transform(a["str"], lambda t: _value("license_name", license_name(t))))
        return F.concat(values, F.coalesce(names, none))

    arrays = F.filter("x.arr", lambda a: a["str"].isNotNull() & ~((a["_name"] == "medium") & F.lit(bool(medium))))
    members = F.coalesce(F.flatten(F.transform(arrays, array_values)), none)
    values = F.concat(_one("medium", F.lit(medium or None).cast("string")), plain("float"), plain("str"), plain("date"), members)
    return _finish(parsed, values)


# -- Primo ---------------------------------------------------------------------------------------------------------------


def map_primo(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Primo records: a document with the record in `PrimoNMBib` and the links beside it."""
    bib = (
        f"control:struct<{_texts_in('recordid')}>,"
        f"addata:struct<{_texts_in('date', 'volume', 'issue', 'spage', 'epage', 'pages', 'issn', 'jtitle')}>,"
        f"delivery:struct<fulltext:string>,"
        f"display:struct<{_texts_in('type', 'title', 'ispartof')}>,"
        f"facets:struct<{_texts_in('topic')}>,"
        f"search:struct<{_texts_in('creatorcontrib', 'description', 'sub')}>"
    )
    parsed = _parse(payloads, column, f"PrimoNMBib struct<record:struct<{bib}>>, LINKS struct<{_texts_in('openurl')}>")
    r = "x.PrimoNMBib.record"
    col = lambda path: F.col(f"{r}.{path}")
    first = lambda path: F.get(col(path), F.lit(0))
    start, end, pages = first("addata.spage"), first("addata.epage"), first("addata.pages")
    has_range = lambda t: F.coalesce(F.contains(t, F.lit("-")), F.lit(False))
    page_range = (
        F.when(has_range(start), start)
        .when(has_range(pages), pages)
        .when(start.isNotNull(), F.concat_ws("-", start, F.nullif(end, F.lit(""))))
    )
    fulltext = F.when(col("delivery.fulltext") == "fulltext", "yes").otherwise("no")
    medium = lambda t: F.when((t == "article") & (fulltext == "yes"), "e-article").otherwise(t)
    values = F.concat(
        _each("id", col("control.recordid")),
        _each("date", F.transform(col("addata.date"), lambda d: F.substr(d, F.lit(1), F.lit(4)))),
        _each("journal-month", F.transform(col("addata.date"), lambda d: F.substr(d, F.lit(4), F.lit(1)))),
        _each("volume-number", col("addata.volume")),
        _each("issue-number", col("addata.issue")),
        _one("pages-number", page_range),
        _each("issn", col("addata.issn")),
        _each("journal-title", col("addata.jtitle")),
        _one("has-fulltext", F.when(F.col(f"{r}.delivery").isNotNull(), fulltext)),
        _each("medium", F.transform(col("display.type"), medium)),
        _each("title", col("display.title")),
        _each("journal-subpart", col("display.ispartof")),
        _each("citation", col("display.ispartof")),
        _each("subject", col("facets.topic")),
        _each("electronic-url", F.col("x.LINKS.openurl")),
        _each("author", col("search.creatorcontrib")),
        _each("description", col("search.description")),
        _each("subject", col("search.sub")),
    )
    return _finish(parsed, values)


# -- generic connector records ---------------------------------------------------------------------------------------------


def map_generic(payloads: DataFrame, column: str = "payload", medium: str | None = None) -> DataFrame:
    """Records of any elements: some have fields of their own, an element that is not known gives a field of its name with
    all the text in it.

    A page range is made of start and end page. `medium` of the caller comes instead of the one in the record. A payload
    that isn't well-formed, or whose root isn't `record`, fails and gives no values.
    """
    read = with_children(payloads, column)
    failed = F.col("root").isNull() | (F.col("root") != "record")
    parsed = read.withColumn("failure", F.when(failed, "ingest"))
    renamed = F.create_map(*[x for n, fields in GENERIC_FIELDS.items() for x in (F.lit(n), F.array(*[F.lit(f) for f in fields]))])
    plain = lambda text: F.trim(text)

    def parts_of(name: str, e: Column) -> Column:
        part = lambda p: plain(F.get(F.filter(e["parts"], lambda x: x["name"] == p), F.lit(0))["text"])
        return F.array(*[_value(field, F.coalesce(part(p), F.lit("")), empty=True) for p, field in GENERIC_PARTS[name]])

    def fields_of(e: Column) -> Column:
        found = F.transform(F.coalesce(renamed[e["name"]], F.array(e["name"])), lambda f: _value(f, plain(e["text"])))
        out = F
        for name in GENERIC_PARTS:
            out = out.when(e["name"] == name, parts_of(name, e))
        return out.otherwise(found)

    first = lambda name: plain(F.get(F.filter("elements", lambda e: e["name"] == name), F.lit(0))["text"])
    start, end = F.nullif(first("startpage"), F.lit("")), F.nullif(first("endpage"), F.lit(""))
    values = F.concat(
        _one("medium", F.coalesce(F.lit(medium or None).cast("string"), first("medium"))),
        _one("pages-number", F.when(start.isNotNull(), F.concat_ws("-", start, end))),
        F.flatten(F.transform(F.filter("elements", lambda e: e["name"] != "medium"), fields_of)),
    )
    return _finish(parsed, values).drop("elements", "root")


# -- OPAC holdings ---------------------------------------------------------------------------------------------------------

HOLDING = (
    "struct<localLocation:string,callNumber:string,publicNote:string,"
    "circulations:struct<circulation:array<struct<availableNow:struct<_value:string>,availabilityDate:string>>>>"
)


def opac_holdings(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Values `locallocation, callnumber, publicnote, available` for every holding of an OPAC record."""
    parsed = _parse(payloads, column, f"holdings struct<holding:array<{HOLDING}>>")

    def values(h: Column) -> Column:
        rings = h["circulations"]["circulation"]
        now = lambda flag: F.exists(rings, lambda c: c["availableNow"]["_value"] == flag)
        date = F.get(rings, F.lit(0))["availabilityDate"]
        available = F.when(now("1"), "Available").when(now("0"), date)
        return F.array(
            _value("locallocation", h["localLocation"], empty=True),
            _value("callnumber", h["callNumber"], empty=True),
            _value("publicnote", h["publicNote"], empty=True),
            _value("available", available, empty=True),
        )

    rows = F.flatten(F.transform("x.holdings.holding", values))
    return _finish(parsed, F.coalesce(rows, F.array().cast(RAW_VALUES)))


def map_opac_holdings(payloads: DataFrame, raw: DataFrame, on: tuple[str, ...] = ("source", "position"), column: str = "payload") -> DataFrame:
    """Add the holdings of OPAC records to the values of their bibliographic records."""
    held = opac_holdings(payloads, column).select(*on, F.col("values").alias("held"))
    joined = raw.join(held, list(on), "left")
    return joined.withColumn("values", F.concat("values", F.coalesce("held", F.array().cast(RAW_VALUES)))).drop("held")

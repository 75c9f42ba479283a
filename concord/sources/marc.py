"""MARC records: MARCXML and TurboMARC in, catalog values out by mapping tables and derived fields.

A MARC frame keeps a record in one row: `source, position, arrival, leader, fields array<struct<tag, value, subfields
array<struct<code, value>>>>, c001, c007, c008`, so that no shuffle is needed to map it.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from concord.functions.text import xml_escape
from concord.sources.internal import RAW_VALUES
from concord.sources.splits import split_records

XML_OPTIONS = {"mode": "PERMISSIVE", "ignoreNamespace": "true"}
SUBFIELDS = "array<struct<code:string,value:string>>"
FIELDS = f"array<struct<tag:string,value:string,subfields:{SUBFIELDS}>>"
MARC_SCHEMA = (
    "leader string, controlfield array<struct<_tag:string,_VALUE:string>>,"
    " datafield array<struct<_tag:string,subfield:array<struct<_code:string,_VALUE:string>>>>, _corrupt_record string"
)
CONTROLS = ("001", "007", "008")

# -- fixed values: mapping tables as `tag subfield field`; `$` is the field itself, `*` all subfields ------------------

MARC21 = """
001 $ id
010 a lccn
020 a isbn
022 a issn
027 a tech-rep-nr
100 a author
100 c author-title
100 d author-date
110 a corporate-name
110 c corporate-location
110 d corporate-date
111 a meeting-name
111 c meeting-location
111 d meeting-date
130 a title-uniform
130 m title-uniform-media
130 n title-uniform-parts
130 p title-uniform-partname
130 r title-uniform-key
245 a title
245 b title-remainder
245 c title-responsibility
245 f title-dates
245 h title-medium
245 n title-number-section
245 p title-parts
250 a edition
260 a publication-place
260 b publication-name
260 c publication-date
264 a publication-place
264 b publication-name
264 c publication-date
300 a physical-extent
300 b physical-format
300 c physical-dimensions
300 e physical-accomp
300 f physical-unittype
300 g physical-unitsize
300 3 physical-specified
440 a series-title
500 * description
505 * description
518 * description
520 * description
522 * description
911 * description
600 a subject
610 a subject
611 a subject
630 a subject
648 a subject
650 a subject
651 a subject
653 a subject
654 a subject
655 a subject
656 a subject
657 a subject
658 a subject
662 a subject
69X a subject
856 u electronic-url
856 z electronic-note
856 i electronic-format-instruction
856 q electronic-format-type
773 t journal-title
773 p journal-title-abbrev
900 a fulltext
900 b fulltext
900 e fulltext
900 f fulltext
900 i fulltext
900 k fulltext
900 q fulltext
900 s fulltext
900 u fulltext
900 y fulltext
901 a iii-id
907 a iii-id
948 * holding
991 * holding
"""

UNIMARC = """
001 $ id
010 a isbn
011 a issn
200 a title
210 d date
606 a subject
610 a subject
856 u url
"""

DANMARC2 = """
010 a lccn
020 a isbn
022 a issn
027 a tech-rep-nr
100 a author
100 c author-title
100 d author-date
110 a corporate-name
110 c corporate-location
110 d corporate-date
111 a meeting-name
111 c meeting-location
111 d meeting-date
260 c date
245 a title
245 b title-remainder
245 c title-responsibility
245 f title-dates
245 h title-medium
250 a edition
260 a publication-place
260 b publication-name
260 c publication-date
300 a physical-extent
300 b physical-format
300 c physical-dimensions
300 e physical-accomp
300 f physical-unittype
300 g physical-unitsize
300 3 physical-specified
440 a series-title
856 u electronic-url
856 y electronic-text
856 z electronic-note
900 a fulltext
900 b fulltext
"""

SUBJECT_TAGS = ("600", "610", "611", "630", "648", "650", "651", "653", "654", "655", "656", "657", "658", "662", "69X")
# year type characters of control field 008, and those that have an end year
YEAR_TYPES, RANGE_TYPES = "cestpudikmr", "dikmr"
# placeholder shown for an empty value
EMPTY = "NULL_VALUE"


# -- reading -----------------------------------------------------------------------------------------------------------


def _marc_fields(x: str) -> Column:
    """All fields of a parsed record: three-character tags only, values trimmed."""
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    control = F.transform(
        F.coalesce(F.col(f"{x}.controlfield"), F.array().cast("array<struct<_tag:string,_VALUE:string>>")),
        lambda f: F.struct(f["_tag"].alias("tag"), trimmed(f["_VALUE"]).alias("value"), F.lit(None).cast(SUBFIELDS).alias("subfields")),
    )
    data = F.transform(
        F.coalesce(
            F.col(f"{x}.datafield"),
            F.array().cast("array<struct<_tag:string,subfield:array<struct<_code:string,_VALUE:string>>>>"),
        ),
        lambda f: F.struct(
            f["_tag"].alias("tag"),
            F.lit(None).cast("string").alias("value"),
            F.transform(
                F.filter(f["subfield"], lambda s: s["_VALUE"].isNotNull()),
                lambda s: F.struct(s["_code"].alias("code"), trimmed(s["_VALUE"]).alias("value")),
            ).alias("subfields"),
        ),
    )
    return F.filter(F.concat(control, data), lambda f: F.length(f["tag"]) == 3).cast(FIELDS)


def parse_marcxml(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """MARC frame out of a column with MARCXML records; `failure` marks what is not well formed."""
    parsed = payloads.withColumn("x", F.from_xml(F.col(column), MARC_SCHEMA, XML_OPTIONS))
    return _with_controls(
        parsed.withColumns(
            {
                "leader": F.col("x.leader"),
                "fields": _marc_fields("x"),
                "failure": F.when(F.col("x._corrupt_record").isNotNull() | F.col("x").isNull(), "ingest"),
            }
        ).drop("x")
    )


def _with_controls(marc: DataFrame) -> DataFrame:
    """The control fields that rules look into, as columns `c001, c007, c008`."""
    first = lambda t: F.get(F.filter("fields", lambda f: f["tag"] == t), F.lit(0))["value"]
    return marc.withColumns({f"c{t}": first(t) for t in CONTROLS})


def plain_markup(payload: Column) -> Column:
    """XML without comments and with the text of CDATA sections escaped, so that every `<` begins a tag. One pass from left to right
    finds both, so that neither is looked for inside the other."""
    pattern = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>"
    outside, inside = F.split(payload, pattern, -1), F.regexp_extract_all(payload, F.lit(pattern), F.lit(0))
    text = lambda s: xml_escape(F.substr(s, F.lit(10), F.length(s) - 12))
    replaced = F.transform(inside, lambda s: F.when(F.startswith(s, F.lit("<!--")), "").otherwise(text(s)))
    joined = F.array_join(F.transform(F.arrays_zip(outside.alias("o"), replaced.alias("i")), lambda p: F.concat(p["o"], F.coalesce(p["i"], F.lit("")))), "")
    return F.when(F.contains(payload, F.lit("<!")), joined).otherwise(payload)


def turbo_to_marcxml(payload: Column) -> Column:
    """Element-per-tag records rewritten to tag and code attributes: `<d245><sa>` to `<datafield><subfield>`."""
    prefix, payload = r"(?:[\w.-]+:)?", plain_markup(payload)
    for pattern, new in (
        (f"<(/?){prefix}r(?=[\\s>/])", "<$1record"),
        (f"<(/?){prefix}l(?=[\\s>/])", "<$1leader"),
        (f"<{prefix}c(\\w{{3}})(?=[\\s>/])", '<controlfield tag="$1"'),
        (f"</{prefix}c\\w{{3}}\\s*>", "</controlfield>"),
        (f"<{prefix}d(\\w{{3}})(?=[\\s>/])", '<datafield tag="$1"'),
        (f"</{prefix}d\\w{{3}}\\s*>", "</datafield>"),
        (f"<{prefix}s(\\w)(?=[\\s>/])", '<subfield code="$1"'),
        (f"<{prefix}s(?=[\\s>/])", "<subfield"),
        (f"</{prefix}s\\w?\\s*>", "</subfield>"),
    ):
        payload = F.regexp_replace(payload, pattern, new)
    return payload


def parse_turbomarc(payloads: DataFrame, column: str = "payload") -> DataFrame:
    return parse_marcxml(payloads.withColumn(column, turbo_to_marcxml(F.col(column))), column)


def read_marcxml(spark: SparkSession, path: str, row_tag: str = "record") -> DataFrame:
    """MARC frame `file, block, leader, fields, failure` out of MARCXML files, read in splits."""
    return parse_marcxml(split_records(spark, path, row_tag)).drop("payload")


def marc_rows(marc: DataFrame, *keep: str) -> DataFrame:
    """Long rows: `keep..., field_no, tag, value, sub_no, code, sub_value`."""
    fields = marc.select(*keep, F.posexplode_outer("fields").alias("field_no", "f")).filter("f IS NOT NULL")
    return fields.select(*keep, "field_no", "f.tag", "f.value", F.posexplode_outer("f.subfields").alias("sub_no", "s")).select(
        *keep, "field_no", "tag", "value", "sub_no", F.col("s.code").alias("code"), F.col("s.value").alias("sub_value")
    )


# -- mapping -----------------------------------------------------------------------------------------------------------


def mapping_rows(text: str) -> list[tuple[str, str, str]]:
    """Rows of a mapping table; blank lines do not count."""
    rows = [tuple(line.split()) for line in text.splitlines() if line.strip()]
    if any(len(r) != 3 for r in rows):
        raise ValueError("a mapping line is: tag subfield field")
    return rows


def read_mapping(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    """Rows of a mapping file, in its order. A mapping is configuration, which becomes part of the plan."""
    lines = spark.read.text(path).select("value").collect()
    return mapping_rows("\n".join(r["value"] for r in lines))


def _value(field: str, value: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), value.alias("value"))


def map_fields(fields: Column, mapping: Sequence[tuple[str, str, str]]) -> Column:
    """`array<struct<field, value>>` of a record by a mapping table, in the order of the table.

    `$` is the whole field value, `*` all subfields joined by a space, a letter every subfield of that code. The table is
    a map in the plan, so a field costs one lookup, whatever the length of the table.
    """
    by_tag: dict[str, list] = {}
    for n, (tag, code, field) in enumerate(mapping):
        by_tag.setdefault(tag, []).append(F.struct(F.lit(n).alias("n"), F.lit(code).alias("code"), F.lit(field).alias("field")))
    table = F.create_map(*[x for tag, rows in by_tag.items() for x in (F.lit(tag), F.array(*rows))])

    def by_rule(f: Column, at: Column, rule: Column) -> Column:
        every = F.array_join(F.transform(f["subfields"], lambda s: s["value"]), " ")
        some = F.transform(F.filter(f["subfields"], lambda s: s["code"] == rule["code"]), lambda s: s["value"])
        texts = F.when(rule["code"] == "$", F.array(f["value"])).when(rule["code"] == "*", F.array(every)).otherwise(some)
        return F.transform(
            F.coalesce(texts, F.array().cast("array<string>")),
            lambda t, i: F.struct(rule["n"].alias("n"), at.alias("at"), i.alias("i"), rule["field"].alias("field"), t.alias("value")),
        )

    def of(f: Column, at: Column) -> Column:
        return F.flatten(F.transform(table[f["tag"]], lambda rule: by_rule(f, at, rule)))

    known = F.filter(F.transform(fields, of), lambda a: a.isNotNull())
    ordered = F.array_sort(F.flatten(known))
    return F.transform(ordered, lambda v: F.struct(v["field"].alias("field"), v["value"].alias("value")))


# -- parts of a record ---------------------------------------------------------------------------------------------------


def tagged(*tags: str) -> Column:
    return F.filter("fields", lambda f: f["tag"].isin(*tags))


def subs(f: Column, *codes: str) -> Column:
    """Values of the subfields of a field with one of the codes."""
    return F.transform(F.filter(f["subfields"], lambda s: s["code"].isin(*codes)), lambda s: s["value"])


def first_sub(f: Column, *codes: str) -> Column:
    """First value of the first code that is there."""
    return F.coalesce(*[F.get(subs(f, c), F.lit(0)) for c in codes])


def tag_subs(tag: str, code: str) -> Column:
    return F.flatten(F.transform(tagged(tag), lambda f: subs(f, code)))


def control(tag: str) -> Column:
    return F.col(f"c{tag}")


def _char(text: Column, at: int, n: int = 1) -> Column:
    return F.coalesce(F.substr(text, F.lit(at), F.lit(n)), F.lit(""))


def _in(char: Column, chars: str) -> Column:
    """One of the characters; nothing counts as one of them, as in the rule it follows."""
    return (char == "") | F.contains(F.lit(chars), char)


def _one(field: str, value: Column) -> Column:
    """A single value, if it is there."""
    return F.filter(F.array(_value(field, value)), lambda v: v["value"] != "")


def _each(field: str, texts: Column) -> Column:
    return F.transform(texts, lambda t: _value(field, t))


# -- derived fields ------------------------------------------------------------------------------------------------------


def derive_medium(rule: str = "simple", raw: bool = False) -> Column:
    """Medium of a record. `simple`: 245$h (without ` []/` unless raw), 900, 773; `detailed`: leader, 007 and 008."""
    if rule == "simple":
        stated = F.get(tag_subs("245", "h"), F.lit(0))
        return (
            F.when(stated.isNotNull(), stated if raw else F.translate(stated, " []/", ""))
            .when(F.exists(tagged("900"), lambda f: F.size(subs(f, "a", "b")) > 0), "electronic resource")
            .when(F.size(tag_subs("773", "t")) > 0, "article")
            .otherwise("book")
        )
    if rule != "detailed":
        raise ValueError("medium rule must be simple or detailed")
    c007, c008 = control("007"), control("008")
    kind, level = _char(F.col("leader"), 7), _char(F.col("leader"), 8)
    form_book, form_other = _char(c008, 24), _char(c008, 30)
    visual, serial = _char(c008, 34), _char(c008, 22)
    a, b, d, e = _char(c007, 1), _char(c007, 2), _char(c007, 4), _char(c007, 5)
    carrier = (
        F.when((b == "d") & (d == "f"), "-cd")
        .when(b == "s", "-cassette")
        .when(((b == "d") & (d == "a")) | d.isin("b", "c", "d", "e"), "-vinyl")
        .otherwise("")
    )
    disc = (
        F.when((a == "v") & (b == "d") & (e == "v"), "-dvd")
        .when((a == "v") & (b == "d") & (e == "s"), "-blu-ray")
        .when((a == "v") & (b == "f") & (e == "b"), "-vhs")
        .otherwise("")
    )
    base = (
        F.when(kind.isin("a", "t") & (level == "m"), "book")
        .when(kind.isin("j", "i"), F.concat(F.lit("recording"), carrier))
        .when((kind == "g") & visual.isin("m", "v"), F.concat(F.lit("video"), disc))
        .when(kind == "g", "audio-visual")
        .when((kind == "a") & (level == "s") & (serial == "n"), "newspaper")
        .when((kind == "a") & (level == "s"), "journal")
        .when(kind.isin("e", "f"), "map")
        .when(kind.isin("c", "d"), "music-score")
        .when(form_book.isin("a", "b", "c"), "microform")
        .when(kind == "t", "thesis")
        .when(kind.isin("a", "i") & serial.isin("d", "w"), "web")
        .when((kind == "a") & (level == "b"), "article")
        .when(kind == "m", "electronic")
        .otherwise("other")
    )
    electronic = form_book.isin("s", "q", "o") | form_other.isin("s", "q", "o")
    large = (form_book == "d") | ((a == "t") & (b == "b"))
    suffix = F.when(electronic & (base != "electronic"), " (electronic)").when((base == "book") & large, " (large print)")
    return F.concat(base, F.coalesce(suffix, F.lit("")))


def derive_date() -> Column:
    """Dates: 260$c and 264$c without `cp[].`; without such a field the years of 008; and 903$a if it is above 0."""
    stated = F.flatten(F.transform(tagged("260", "264"), lambda f: subs(f, "c")))
    c008 = control("008")
    kind = _char(c008, 7)
    start = F.when(_in(kind, YEAR_TYPES), _char(c008, 8, 4)).otherwise("")
    end = F.when(_in(kind, RANGE_TYPES), _char(c008, 12, 4)).otherwise("")
    coded = F.when(start == "", "").when(end != "", F.concat_ws("-", start, end)).otherwise(start)
    years = F.transform(F.filter(tag_subs("903", "a"), lambda t: t.try_cast("double") > 0), lambda t: t.try_cast("double").cast("long").cast("string"))
    return F.concat(
        F.when(F.size(tagged("260", "264")) > 0, _each("date", F.transform(stated, lambda t: F.translate(t, "cp[].", "")))).otherwise(
            _one("date", coded)
        ),
        _each("date", years),
        _each("publication-date", years),
    )


def derive_ids() -> Column:
    """OCLC number out of 001 or 035$a, and whether there is full text."""
    marked = lambda t: F.coalesce(t.rlike("ocn|ocm|OCoLC"), F.lit(False))
    c001, c035 = control("001"), F.get(tag_subs("035", "a"), F.lit(0))
    number = F.when(marked(c001), c001).when(marked(c035), c035)
    full = (F.size(tag_subs("856", "q")) > 0) | F.array_contains(tag_subs("856", "i"), "TEXT*")
    control_nr = F.filter(F.transform(tagged("035"), lambda f: first_sub(f, "a", "b")), lambda t: t.isNotNull())
    local = F.filter(F.transform(tagged("999"), lambda f: first_sub(f, "a", "c", "d")), lambda t: t.isNotNull())
    return F.concat(
        _one("oclc-number", number),
        _one("has-fulltext", F.when(full, "yes").otherwise("no")),
        _each("system-control-nr", control_nr),
        _each("localid", local),
    )


def _squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _after(text: Column, mark: str) -> Column:
    at = F.instr(text, mark)
    return F.when(at > 0, F.substr(text, at + len(mark))).otherwise("")


def _before(text: Column, mark: str) -> Column:
    at = F.instr(text, mark)
    return F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise("")


def parse_citation(text: Column) -> Column:
    """struct(volume, issue, pages) out of a journal part such as `Vol. 3, issue 2, p 12-18`; empty when not there.

    Every part is one pattern over the lower-cased text: the word behind the first `vol ` (else `v `), the one behind the
    first `issue` up to a comma, and everything behind the first ` p ` (else `,p`, else ` p`).
    """
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ.", "abcdefghijklmnopqrstuvwxyz ")
    volume = r"(?s)^(?:(?>.*?vol )(?=.)|(?!.*vol .)(?>.*?v ))\s*(\S+)\s+\S"
    issue = r"(?s)^(?>.*?issue)\s*([^\s,]*)(?:,|\s+\S)"
    pages = r"(?s)^(?:(?>.*? p )(?=.)|(?!.* p .)(?>.*?,p)(?=.)|(?!.* p .)(?!.*,p.)(?>.*? p))(.*)$"
    return F.struct(
        F.regexp_extract(plain, volume, 1).alias("volume"),
        F.regexp_extract(plain, issue, 1).alias("issue"),
        _squeeze(F.regexp_extract(plain, pages, 1)).alias("pages"),
    )


def derive_citation() -> Column:
    """Citation, journal part and its volume, issue and pages out of 773."""
    part = lambda f: F.array_join(subs(f, "g"), "")
    line = lambda f: F.array_join(F.transform(f["subfields"], lambda s: _squeeze(s["value"])), " ")

    def split(text: Column) -> Column:
        found = parse_citation(text)
        return F.array(
            _value("journal-subpart", text),
            _value("volume-number", found["volume"]),
            _value("issue-number", found["issue"]),
            _value("pages-number", found["pages"]),
        )

    of = lambda f: F.concat(F.array(_value("citation", line(f))), F.flatten(F.transform(F.array(part(f)), split)))
    return F.filter(F.flatten(F.transform(tagged("773"), of)), lambda v: v["value"] != "")


def derive_titles() -> Column:
    """Complete title, publication statements, long subjects, text of electronic locations."""
    complete = F.filter(
        F.transform(tagged("245"), lambda f: F.when(F.size(subs(f, "a")) > 0, F.array_join(subs(f, "a", "b", "n", "p"), " "))),
        lambda t: t.isNotNull(),
    )
    published = F.transform(tagged("260", "264"), lambda f: F.array_join(subs(f, "a", "b", "c"), " "))
    published = F.filter(published, lambda t: t != "")
    no_comma = lambda t: F.regexp_replace(_squeeze(t), ",$", "")
    long = F.transform(
        tagged(*SUBJECT_TAGS), lambda f: F.array_join(F.transform(f["subfields"], lambda s: no_comma(s["value"])), ", ")
    )
    text = F.filter(F.transform(tagged("856"), lambda f: first_sub(f, "y", "3", "a")), lambda t: t.isNotNull())
    return F.concat(
        _each("title-complete", complete),
        _each("publication-statement", published),
        _each("subject-long", long),
        _each("electronic-text", text),
    )


def derive_holdings() -> Column:
    """Location, call number, note, availability and loan period out of 852, 926, 945 and 876."""
    none = F.lit(EMPTY)
    or_none = lambda t: F.when(t != "", t).otherwise(none)
    joined = lambda f: F.concat_ws(": ", first_sub(f, "a"), F.nullif(F.array_join(subs(f, "b"), ": "), F.lit("")))
    per = lambda tag, field, value: F.transform(tagged(tag), lambda f: _value(field, or_none(value(f))))
    note = lambda t: F.when(t == "1", "Available").when(t == "0", "Not Available").otherwise(t)
    loans = F.filter(
        F.transform(tagged("876"), lambda f: F.when(F.size(subs(f, "f")) > 0, F.concat(F.coalesce(first_sub(f, "5"), F.lit("")), F.lit(":"), first_sub(f, "f")))),
        lambda t: t.isNotNull(),
    )
    return F.concat(
        per("852", "locallocation", joined),
        per("852", "callnumber", lambda f: F.array_join(subs(f, "h", "i"), " ")),
        _each("publicnote", F.transform(tag_subs("852", "y"), note)),
        F.transform(tagged("852"), lambda f: _value("available", none)),
        per("926", "locallocation", lambda f: first_sub(f, "a")),
        per("926", "callnumber", lambda f: first_sub(f, "c")),
        per("926", "available", lambda f: first_sub(f, "e")),
        per("945", "locallocation", lambda f: first_sub(f, "a")),
        per("945", "callnumber", lambda f: first_sub(f, "b")),
        per("945", "publicnote", lambda f: first_sub(f, "c")),
        per("945", "available", lambda f: F.when(F.array_contains(subs(f, "s"), "N"), "Available").otherwise(first_sub(f, "d"))),
        _each("loan-period", loans),
    )


# -- OpenURL -------------------------------------------------------------------------------------------------------------


def open_url(resolver: Column, generated_by: str = "concord") -> Column:
    """OpenURL of a MARC record, with the name of who made it: author, date, volume, isbn, issn, title and article title, as far as they are there."""
    first = lambda tag, code: F.get(tag_subs(tag, code), F.lit(0))
    text = lambda c: F.coalesce(c, F.lit(""))
    author = F.array_join(F.transform(tagged("100", "700"), lambda f: F.coalesce(first_sub(f, "a"), F.lit(""))), "")
    last = _squeeze(_before(author, ","))
    given = _before(_squeeze(_after(author, ",")), " ")
    given = F.when(F.length(F.translate(given, ".", "")) > 1, given).otherwise("")
    date = F.array_join(F.transform(tagged("260"), lambda f: F.coalesce(first_sub(f, "c"), F.lit(""))), "")
    in_journal = F.size(tagged("773")) > 0
    title = F.coalesce(first("773", "t"), first("245", "a"))
    plain = lambda c: F.translate(_squeeze(text(c)), ".", "")
    parts = [
        ("aulast", last),
        ("aufirst", given),
        ("date", F.translate(date, ".[]c;", "")),
        ("volume", _after(text(first("773", "g")), "Vol")),
        ("isbn", F.regexp_replace(text(F.coalesce(first("773", "z"), first("020", "a"))), "[^0-9X]", "")),
        ("issn", F.regexp_replace(text(F.coalesce(first("773", "x"), first("022", "a"))), "[^0-9X-]", "")),
        ("title", plain(title)),
        ("atitle", F.when(in_journal, plain(first("245", "a"))).otherwise("")),
    ]
    pieces = [F.when(v != "", F.concat(F.lit(f"&{n}="), v)).otherwise("") for n, v in parts]
    return F.concat(resolver, F.lit(f"?generatedby={generated_by}"), *pieces)


# -- whole records -------------------------------------------------------------------------------------------------------


def _as_raw(values: Column) -> Column:
    """Values with the placeholder of empty ones, as raw values."""
    real = F.filter(values, lambda v: v["value"] != "")
    attrs = lambda v: F.when(v["value"] == EMPTY, F.create_map(F.lit("empty"), v["value"])).otherwise(F.create_map().cast("map<string,string>"))
    return F.transform(
        real,
        lambda v: F.struct(
            v["field"].alias("field"), F.when(v["value"] != EMPTY, v["value"]).alias("value"), attrs(v).alias("attrs")
        ),
    ).cast(RAW_VALUES)


def _finish(mapped: DataFrame) -> DataFrame:
    return mapped.withColumn("values", _as_raw(F.col("values"))).drop("leader", "fields", *[f"c{t}" for t in CONTROLS])


def map_marc21(marc: DataFrame, medium: str = "detailed", resolver: str | None = None) -> DataFrame:
    """Raw frame out of MARC21 records: the mapping table plus all derived fields."""
    parts = {
        "v_map": map_fields(F.col("fields"), mapping_rows(MARC21)),
        "v_ids": derive_ids(),
        "v_date": derive_date(),
        "v_title": derive_titles(),
        "v_cite": derive_citation(),
        "v_hold": derive_holdings(),
        "v_medium": _one("medium", derive_medium(medium)),
    }
    if resolver is not None:
        parts["v_url"] = _one("open-url", open_url(F.lit(resolver)))
    # a column per group of fields keeps the expressions small
    mapped = marc.withColumns(parts)
    return _finish(mapped.withColumn("values", F.concat(*parts)).drop(*parts))


def map_marc(marc: DataFrame, mapping: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Raw frame by a mapping table of the caller, with the raw form of the simple medium."""
    values = F.concat(map_fields(F.col("fields"), mapping), _one("medium", derive_medium("simple", raw=True)))
    return _finish(marc.withColumn("values", values))


def map_unimarc(marc: DataFrame) -> DataFrame:
    """UNIMARC: its table, notes 300-345 but 325, LCCN of the US agency, authors with both name parts."""
    noted = F.filter("fields", lambda f: f["tag"].between("300", "345") & (f["tag"] != "325"))
    notes = F.filter(F.transform(noted, lambda f: F.get(f["subfields"], F.lit(0))["value"]), lambda t: t.isNotNull())
    us = F.filter(tagged("020"), lambda f: F.array_contains(subs(f, "a"), "US"))
    lccn = F.filter(F.transform(us, lambda f: first_sub(f, "b")), lambda t: t.isNotNull())
    name = lambda f: F.concat(F.coalesce(first_sub(f, "a"), F.lit("")), F.lit(", "), F.coalesce(first_sub(f, "b"), F.lit("")))
    values = F.concat(
        map_fields(F.col("fields"), mapping_rows(UNIMARC)),
        _each("lccn", lccn),
        _each("description", notes),
        _each("author", F.transform(tagged("700", "701", "702"), name)),
    )
    return _finish(marc.withColumn("values", values))


def map_danmarc2(marc: DataFrame) -> DataFrame:
    """danMARC2: its table, notes 500-599 with exceptions, all subject subfields, medium, and a merge key of its own."""
    noted = F.filter("fields", lambda f: f["tag"].between("500", "599") & ~f["tag"].isin("506", "522", "530", "540", "546"))
    notes = F.filter(F.transform(noted, lambda f: F.get(f["subfields"], F.lit(0))["value"]), lambda t: t.isNotNull())
    subjects = F.flatten(F.transform(tagged("630", "650", "653", "666"), lambda f: F.transform(f["subfields"], lambda s: s["value"])))
    line = F.transform(tagged("773"), lambda f: F.array_join(F.transform(f["subfields"], lambda s: _squeeze(s["value"])), " "))
    stated = F.get(tag_subs("245", "h"), F.lit(0))
    medium = (
        F.when(stated.isNotNull(), _after(_before(stated, "]"), "["))
        .when(F.exists(tagged("900"), lambda f: F.size(subs(f, "a", "b")) > 0), "electronic resource")
        .when(F.size(tag_subs("856", "u")) > 0, "electronic resource")
        .when(F.size(tag_subs("773", "t")) > 0, "article")
        .otherwise("book")
    )
    values = F.concat(
        map_fields(F.col("fields"), mapping_rows(DANMARC2)),
        _each("id", tag_subs("001", "a")),
        _each("description", notes),
        _each("subject", subjects),
        _each("citation", line),
        _one("medium", medium),
    )
    first = lambda tag: F.coalesce(F.get(tag_subs(tag, "a"), F.lit(0)), F.lit(""))
    key = F.concat(F.lit("title "), first("245"), F.lit(" author "), first("100"), F.lit(" medium "), medium)
    return _finish(marc.withColumn("key", key).withColumn("values", values))

"""Internal records as XML: `<record>` or `<cluster>` of `<metadata type=...>`."""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from concord.operators.records import ATTRS
from concord.sources.splits import split_records

RAW_VALUES = f"array<struct<field:string,value:string,attrs:{ATTRS}>>"
XML_OPTIONS = {"mode": "PERMISSIVE", "ignoreNamespace": "true", "ignoreSurroundingSpaces": "false"}


def root_name(payload: Column) -> Column:
    """Local name of the first element."""
    return F.regexp_extract(payload, r"<(?:[\w.-]+:)?([A-Za-z_][\w.-]*)[\s/>]", 1)


def _metadata_schema(attributes: Sequence[str]) -> str:
    extra = "".join(f",`_{a}`:string" for a in attributes)
    return f"array<struct<_VALUE:string,_type:string,_empty:string{extra}>>"


def _values(metadata: Column, attributes: Sequence[str]) -> Column:
    """Values of a record. A value without a type is dropped; attributes become a map."""

    def one(m: Column) -> Column:
        pairs = [F.struct(F.lit(a).alias("key"), m[f"_{a}"].alias("value")) for a in ("empty", *attributes)]
        attrs = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))
        return F.struct(m["_type"].alias("field"), m["_VALUE"].alias("value"), attrs.alias("attrs"))

    typed = F.filter(metadata, lambda m: m["_type"].isNotNull())
    return F.coalesce(F.transform(typed, one), F.array().cast(RAW_VALUES))


def _plain_class(without: str) -> str:
    """Class of the Latin-1 characters that XML reads as themselves; one by one, since that makes a table of them."""
    return "[" + "".join(re.escape(chr(c)) for c in (*range(0x20, 0x7F), *range(0xA0, 0x100)) if chr(c) not in without) + "]"


# Texts and values of attributes that are not empty and do not begin with white space.
_TEXT = _plain_class("<>& \xa0") + _plain_class("<>&") + "*"
_QUOTED = _plain_class('<>&"= \xa0') + _plain_class('<>&"=') + "*"
#: Longer payloads are left to the parser, which has bounds of its own.
_PLAIN_BYTES = 500_000


def _plain_pattern(attributes: Sequence[str]) -> str:
    """Pattern for payloads that are written plainly: records of metadata, attributes in the order type, empty and `attributes`, no
    entities, comments or white space around. Groups are repeated possessively, so that long payloads take no stack."""
    extra = "".join(f'(?: {re.escape(a)}="{_QUOTED}")?+' for a in ("empty", *attributes))
    value = f'<metadata type="{_QUOTED}"{extra}(?:/>|>{_TEXT}</metadata>)'
    record = f"<record>(?:{value})++</record>"
    prefixed = f'<((?![xX][mM][lL])[a-z]++):cluster xmlns:\\1="(?!http){_QUOTED}">'
    return f"^(?:{record}|<cluster>(?:{record})++</cluster>|{prefixed}(?:{record})++</\\1:cluster>)\\z"


def _plain_subrecords(payload: Column, attributes: Sequence[str]) -> Column:
    """Sub-records of a payload that matches the pattern."""

    def one(v: Column) -> Column:
        head = F.substring_index(v, ">", 1)
        # no value has a quotation mark or an equals sign
        found = lambda m: F.when(F.contains(head, F.lit(m)), F.substring_index(F.substring_index(head, m, -1), '"', 1))
        pairs = [x for a in ("empty", *attributes) for x in (F.lit(a), found(f' {a}="'))]
        some = F.map_filter(F.create_map(*pairs), lambda _, value: value.isNotNull())
        attrs = F.when(F.contains(head, F.lit('" ')), some).otherwise(F.create_map().cast(ATTRS))
        field = F.substring_index(F.substring_index(v, '"', 2), '"', -1)
        return F.struct(field.alias("field"), F.nullif(F.substring_index(v, ">", -1), F.lit("")).alias("value"), attrs.alias("attrs"))

    def sub(record: Column) -> Column:
        values = F.filter(F.split(record, "<"), lambda v: F.startswith(v, F.lit('metadata type="')))
        return F.struct(F.lit(None).cast("string").alias("key"), F.transform(values, one).alias("values"))

    # a plain payload has no line ends, and a split by one character takes no pattern
    lines = F.split(F.replace(payload, F.lit("</record>"), F.lit("\n")), "\n")
    records = F.filter(lines, lambda r: F.contains(r, F.lit("<record>")))
    return F.transform(records, sub)


def parse_payloads(payloads: DataFrame, column: str = "payload", attributes: Sequence[str] = ("rank",)) -> DataFrame:
    """Add `subrecords array<struct<key, values>>` and `failure` to a frame with internal XML.

    A `cluster` has several sub-records. A payload that is not well formed or has another root gets `failure = 'ingest'`
    and no sub-records; nothing stops. `attributes` names the value attributes to keep.

    Payloads that are written plainly are taken apart by patterns, which takes a fraction of the time; all others are parsed, with the
    same results.
    """
    metadata = _metadata_schema(attributes)
    schema = (
        f"_mergekey string, metadata {metadata}, record array<struct<_mergekey:string,metadata:{metadata}>>,"
        " _corrupt_record string"
    )
    short = F.octet_length(F.col(column)) <= _PLAIN_BYTES
    plain = F.coalesce(short & F.col(column).rlike(_plain_pattern(attributes)), F.lit(False))
    parsed = payloads.withColumn("plain", plain).withColumns(
        {
            "x": F.when(~F.col("plain"), F.from_xml(F.col(column), schema, XML_OPTIONS)),
            "root": F.when(~F.col("plain"), root_name(F.col(column))),
        }
    )
    sub = lambda r: F.struct(r["_mergekey"].alias("key"), _values(r["metadata"], attributes).alias("values"))
    good = F.col("x._corrupt_record").isNull()
    simple = _plain_subrecords(F.col(column), attributes)
    subrecords = F.when(F.col("plain"), simple).when(good & (F.col("root") == "cluster"), F.transform("x.record", sub)).when(
        good & (F.col("root") == "record"), F.array(sub(F.col("x")))
    )
    return parsed.withColumn("subrecords", subrecords).withColumn(
        "failure", F.when(F.col("subrecords").isNull(), "ingest")
    ).drop("x", "root", "plain")


def read_records(
    spark: SparkSession, path: str, row_tag: str = "record", attributes: Sequence[str] = ("rank",)
) -> DataFrame:
    """Sub-records of internal XML files: `file, block, subrecords, failure`, files read in splits. Broken records are rows with
    a failure."""
    return parse_payloads(split_records(spark, path, row_tag), attributes=attributes).drop("payload")


def first_values(payloads: DataFrame) -> DataFrame:
    """Payloads of one record each as a raw frame `..., key, values`; failed ones are left out."""
    one = F.get("subrecords", F.lit(0))
    return payloads.filter("failure IS NULL").withColumns({"key": one["key"], "values": one["values"]}).drop("subrecords", "failure")

"""Records over the driver tables: offers, documents, pages, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from concord.catalog import Catalog, FieldSpec
from concord.operators.filters import Limits, SourceColumn, table_condition
from concord.operators.order import number_rows
from concord.operators.records import table_records

OFFERS = Catalog(
    (
        FieldSpec("title", brief=True, termlist=True, rank="6", sortkey="skiparticle", merge="longest", mergekey="required", limitcluster="title"),
        FieldSpec("author", brief=True, termlist=True, rank="2 au 9", sortkey="text", merge="longest", mergekey="optional"),
        FieldSpec("medium", brief=True, termlist=True, merge="longest", mergekey="optional"),
        FieldSpec("date", type="year", brief=True, termlist=True, sortkey="numeric", limitcluster="date"),
        FieldSpec("price", type="float", brief=True, sortkey="numeric", merge="range"),
    )
)

DOCS = Catalog(
    (
        FieldSpec("title", brief=True, rank="6", sortkey="skiparticle", merge="longest", mergekey="required"),
        FieldSpec("body", rank="1", merge="first"),
        FieldSpec("lang", brief=True, termlist=True, merge="unique"),
        FieldSpec("quality", type="float", merge="range", sortkey="numeric"),
    )
)


ARRIVAL = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: What the fields of an offer are made of, where limits can be turned into conditions on the table.
OFFER_SOURCES = {"date": SourceColumn("l_shipdate", "year"), "price": SourceColumn("l_extendedprice")}


def offers_table(spark: SparkSession, sf: str, position: bool = False, where: Column | None = None) -> DataFrame:
    """lineitem with part and supplier; `position` numbers the line items of a supplier as they arrive, before the joins.

    lineitem and part grow together, so they are joined by a shuffle on the part, and what is made of titles comes behind it, in
    as many tasks as there are partitions and not in as many as files have row groups.
    """
    line = table(spark, sf, "lineitem").select(*ARRIVAL)
    if where is not None:
        if position:
            raise ValueError("positions count all line items of a supplier")
        line = line.filter(where)
    if position:
        line = number_rows(line, [F.col(c) for c in ARRIVAL], "position", ["l_suppkey"])
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    return (
        line.join(part.hint("merge"), line["l_partkey"] == part["p_partkey"])
        .join(supplier, line["l_suppkey"] == supplier["s_suppkey"])
        .withColumn("l_year", F.year("l_shipdate"))
    )


#: Bytes of lineitem that are joined at a time, and the most slices.
SLICE_BYTES, MOST_SLICES = 64 << 20, 8


def line_slices(spark: SparkSession, sf: str, key: str) -> list[Column]:
    """Conditions that deal all line items to slices by `key`; those with equal keys are in the same one.

    What is made of line items slice by slice (`stored_parts`) needs the shuffle files of one slice at a time. The hash is another one than
    that of shuffles, which would leave partitions empty.
    """
    read = table(spark, sf, "lineitem")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    n = min(MOST_SLICES, 1 + int(str(read)) // SLICE_BYTES)
    return [F.pmod(F.xxhash64(key), F.lit(n)) == i for i in range(n)]


def offers(
    spark: SparkSession,
    sf: str,
    position: bool = False,
    catalog: Catalog = OFFERS,
    limits: Limits | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Every line item is the offer of a supplier; `position` numbers the offers of a supplier as they arrive. With `limits`
    only line items that may meet them are read, else with `where` only those that it is true for."""
    where = table_condition(catalog, limits, OFFER_SOURCES) if limits else where
    rows = offers_table(spark, sf, position, where)
    columns = {"title": "p_name", "author": "p_brand", "medium": "p_type", "date": "l_year", "price": "l_extendedprice"}
    arrival = f"struct({', '.join(ARRIVAL)})"
    return table_records(rows, catalog, columns, "s_name", arrival, "position" if position else None)


def docs_table(spark: SparkSession, sf: str) -> DataFrame:
    """documents with their quality label and the first line as title."""
    label = table(spark, sf, "labels").select("doc_id", "quality")
    text = table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    return text.join(label, "doc_id", "left").withColumn("title", F.substring_index("text", "\n", 1))


def docs(spark: SparkSession, sf: str, catalog: Catalog = DOCS) -> DataFrame:
    columns = {"title": "title", "body": "text", "lang": "lang", "quality": "quality"}
    return table_records(docs_table(spark, sf), catalog, columns, "source", "doc_id", "doc_id")

"""Merge policy no, the native order of a single source, and a pandas UDF in a text chain."""

import pandas as pd
from pyspark.sql import functions as F, types as T

from concord import Catalog, FieldSpec
from concord.functions.chains import TOKENIZE, TextChain, WholeArrays, lower
from concord.operators.clusters import with_merge_key
from concord.operators.facets import facets
from concord.operators.merge import merge_records, merge_values
from concord.operators.order import keeps_native_order, sort_clusters
from concord.operators.records import table_records


def test_fields_without_a_merge_policy_stay_in_the_members(spark):
    catalog = Catalog((FieldSpec("title", merge="longest"), FieldSpec("note", merge="no", termlist=True)))
    rows = spark.createDataFrame([(1, "a", "n1", 1990), (2, "a b", "n2", 1991)], "id int, t string, n string, y int")
    records = table_records(rows, catalog, {"title": "t", "note": "n"}, "'s'", "id").withColumn("cluster", F.lit("c"))
    merged = merge_records(records, catalog)
    assert merged.schema["merged"].dataType.names == ["title"] and merged.first()["merged"]["title"] == "a b"
    assert {r["field"] for r in merge_values(records, catalog).collect()} == {"title"}
    assert sorted(r["norm"] for r in facets(records, catalog).collect()) == ["n1", "n2"]
    assert sorted(r[0] for r in records.select(F.explode("md.note.value")).collect()) == ["n1", "n2"]


def test_native_order_of_a_single_source(spark):
    catalog = Catalog((FieldSpec("title", merge="longest", sortkey="text"),))
    rows = spark.createDataFrame([(i, f"{9 - i}") for i in range(1, 6)], "id int, t string")
    records = table_records(rows, catalog, {"title": "t"}, "'s'", "id", "id").withColumn("cluster", F.col("arrival").cast("string"))
    clusters = merge_records(records, catalog)
    status = lambda *r: spark.createDataFrame(list(r), "active boolean, native_sort boolean")
    assert keeps_native_order(status((True, True), (False, False)))
    assert not keeps_native_order(status((True, True), (True, True))) and not keeps_native_order(status((True, False)))
    assert not keeps_native_order(status((True, None)))
    order = lambda native: [r["recid"] for r in sort_clusters(clusters, catalog, [("title", True)], native).collect()]
    assert order(True) == ["1", "2", "3", "4", "5"] and order(False) == ["5", "4", "3", "2", "1"]


def test_a_pandas_udf_in_a_chain(spark):
    @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def backwards(texts: pd.Series) -> pd.Series:
        return texts.map(lambda row: [[t[::-1] for t in terms] for terms in row])

    chain = TextChain((TOKENIZE, lower, WholeArrays(backwards)))
    catalog = Catalog((FieldSpec("title", mergekey="required"),), chains={"mergekey": chain})
    rows = spark.createDataFrame([(1, "Ab cD"), (2, "ab CD")], "id int, t string")
    records = table_records(rows, catalog, {"title": "t"}, "'s'", "id", "id")
    assert {r["cluster"] for r in with_merge_key(records, catalog).collect()} == {"content: title ba dc"}

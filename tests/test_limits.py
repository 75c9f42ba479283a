"""No caps: scores above 32 bits, many parameters, long facet terms, a limit of no records."""

from datetime import date
from math import log

import pytest

from concord import Catalog, FieldSpec
from concord.operators import facets as FA, filters as FI, rank as R, records as RE
from concord.plans import sources as plans


def test_scores_have_64_bits(spark):
    frame = spark.createDataFrame([("a", 3, [1e6])], "cluster string, members bigint, tf array<double>")
    whole = int(100000 * 1e6 * log(1001))
    assert R.with_relevance(frame, R.Frequency(1000, (1,)), [None]).first()["relevance"] == whole > 2**31
    assert R.with_relevance(frame, R.Frequency(1000, (1,)), [None], cluster=False).first()["relevance"] == whole // 3


def test_all_parameters_reach_the_normalizer(spark):
    names = [f"p{i:02d}" for i in range(20)]
    catalog = Catalog(tuple(FieldSpec(n, setting="parameter") for n in names))
    sources = spark.createDataFrame([("s", {n: n.upper() for n in names})], "source string, settings map<string,string>")
    raw = spark.createDataFrame([("s", 1)], "source string, position int")
    assert len(RE.with_source_params(raw, sources, catalog).first()["params"]) == 20


def test_long_facet_terms_count(spark):
    catalog = Catalog((FieldSpec("title", termlist=True),))
    rows = spark.createDataFrame([(1, "x" * 300), (2, "x" * 300)], "id bigint, name string")
    found = FA.facets(RE.table_records(rows, catalog, {"title": "name"}, "'s'", "id"), catalog).collect()
    assert [(len(r["norm"]), r["frequency"]) for r in found] == [(300, 2)]


def test_a_source_can_be_limited_to_nothing(spark):
    records = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "source string, position int")
    sources = spark.createDataFrame([("a", {"pz:maxrecs": "0"}), ("b", {"x": "1"})], "source string, settings map<string,string>")
    kept = FI.slice_sources(records, 0, 1, sources).select("source", "position").collect()
    assert [tuple(r) for r in kept] == [("b", 1)]


def test_sources_without_a_limit_of_their_own_give_the_whole_window(spark, tmp_path):
    line = [(s, n, 1, s, 1.0, date(1995, 1, 1), 1.0) for s in (1, 2, 3) for n in range(1, 31)]
    columns = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate date, l_quantity double"
    spark.createDataFrame(line, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    part = spark.createDataFrame([(1, "red widget", "Brand#1", "LARGE")], "p_partkey long, p_name string, p_brand string, p_type string")
    part.write.parquet(str(tmp_path / "part.parquet"))
    supplier = spark.createDataFrame([(1, "a", 0), (2, "b", 3), (3, "c", 6)], "s_suppkey long, s_name string, s_nationkey int")
    supplier.write.parquet(str(tmp_path / "supplier.parquet"))
    found = sorted((r["source"], r["position"]) for r in plans.slice_sources(spark, str(tmp_path)).collect())
    assert found == [(s, p) for s, n in (("a", 20), ("b", 3), ("c", 20)) for p in range(6, 6 + n)]


def test_limits_reach_the_reader(spark, tmp_path):
    rows = [(i, f"t{i}", date(1990 + i % 12, 1 + i % 12, 1 + i % 28), float(i % 5)) for i in range(200)] + [(200, "x", None, None)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "id int, name string, shipped date, price double").write.parquet(path)
    table = spark.read.parquet(path)
    catalog = Catalog((FieldSpec("title"), FieldSpec("date", type="year"), FieldSpec("price", type="float")))
    sources = {"date": FI.SourceColumn("shipped", "year"), "price": FI.SourceColumn("price"), "title": FI.SourceColumn("name")}
    records = lambda t: RE.table_records(t, catalog, {"title": "name", "date": "year(shipped)", "price": "price"}, "'s'", "id")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    ids = lambda found: sorted(r["arrival"] for r in found.collect())
    for limits in ({"date": ["1995", "1999-2000"]}, {"date": ["1995"], "price": ["2", "3.0"]}, {"price": ["4"], "title": ["t"]}, {"date": ["0", "x"]}):
        condition = FI.table_condition(catalog, limits, sources)
        pruned = FI.limit_records(records(table.filter(condition)), catalog, limits)
        assert ids(pruned) == ids(FI.limit_records(records(table), catalog, limits))
        plan = pruned._jdf.queryExecution().executedPlan().toString()
        if limits != {"date": ["0", "x"]}:  # nothing is read at all for these
            pushed = plan.split("PushedFilters: ")[1].split("ReadSchema")[0]
            assert all((name in pushed) == (field in limits) for name, field in (("shipped", "date"), ("price", "price")))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert FI.table_condition(catalog, {"title": ["t"], "*": ["1"], "nothing": ["x"]}, sources) is None
    with pytest.raises(ValueError):
        FI.SourceColumn("shipped", "month")

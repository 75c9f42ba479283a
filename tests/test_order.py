"""Row numbers, neighbours and pages against sorting on the driver; sort rules; settings golden."""

import random

from pyspark.sql import functions as F

from concord import Catalog, FieldSpec
from concord.operators import facets as FA, order as O, settings as S, status as ST
from concord.sources.settings import complete_settings, parse_settings, rejected_settings


def test_number_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(1000), i) for i in range(500)] + [("a", None, 1000)]
    frame = spark.createDataFrame(rows, "g string, x int, id int")
    out = O.number_rows(frame, [F.col("x"), F.col("id")], "n", ["g"])
    got = {r["id"]: r["n"] for r in out.collect()}
    want = {}
    for g in "ab":
        ordered = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want.update({r[2]: i + 1 for i, r in enumerate(ordered)})
    assert got == want


def test_neighbours(spark):
    rows = [(i * 7 % 101, f"r{i}") for i in range(101)]
    frame = spark.createDataFrame(rows, "x int, recid string")
    out = O.neighbours(frame, [F.col("x")]).collect()
    ordered = [r[1] for r in sorted(rows)]
    at = {r: i for i, r in enumerate(ordered)}
    for r in out:
        i = at[r["recid"]]
        assert r["prev"] == (ordered[i - 1] if i else None)
        assert r["next"] == (ordered[i + 1] if i + 1 < len(ordered) else None)


def test_equal_keys_are_dealt_evenly(spark):
    frame = spark.range(20_000).select(F.lit(1).alias("x"), F.col("id").cast("string").alias("recid"))
    dealt = frame.repartitionByRange(4, "x", "recid").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in dealt) <= 2 * 20_000 / 4
    numbered = O.number_rows(frame, [F.col("x"), F.col("recid")], "n")
    assert numbered.agg(F.count_distinct("n"), F.min("n"), F.max("n")).first() == (20_000, 1, 20_000)


def test_deep_pages(spark):
    catalog = Catalog((FieldSpec("title", sortkey="text", merge="longest"),))
    rows = [(f"r{i:03d}", (f"t{i % 7}",)) for i in range(100)]
    frame = spark.createDataFrame(rows, "recid string, sort struct<title:string>")
    ordered = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))]
    for start, num in ((0, 5), (37, 20), (95, 20), (100, 5)):
        page = O.page(frame, catalog, [("title", True)], start, num)
        assert [r["recid"] for r in page.collect()] == ordered[start : start + num]
        assert "Offset" not in page._jdf.queryExecution().optimizedPlan().toString()


CATALOG = Catalog((FieldSpec("date", type="year", sortkey="numeric"), FieldSpec("score", type="float", merge="range", sortkey="numeric")))


def test_missing_values(spark):
    schema = "recid string, sort struct<date:struct<min:int,max:int>,score:struct<min:double,max:double>>"
    rows = [("a", ((1990, 2000), (1.0, 1.0))), ("b", (None, None)), ("c", ((1995, 1996), (2.0, 2.0)))]
    frame = spark.createDataFrame(rows, schema)
    order = lambda spec: [r["recid"] for r in O.sort_clusters(frame, CATALOG, spec).collect()]
    assert order([("date", True)]) == ["a", "c", "b"]
    assert order([("date", False)]) == ["a", "c", "b"]
    assert order([("score", True)]) == ["b", "a", "c"]
    assert order([("score", False)]) == ["c", "a", "b"]


def test_settings_golden(spark):
    files = [
        ("1.xml", '<settings target="*"><set precedence="10" name="pz:cclmap:term" value="u=host_wildcard"/><set name="pz:requestsyntax" value="sutrs"/></settings>'),
        ("2.xml", '<settings target="z.example.com/*"><set name="pz:cclmap:term" value="u=db_wildcard"/><set name="pz:requestsyntax" value="marc21"/></settings>'),
        ("3.xml", '<settings target="z.example.com/marc"><set name="pz:name" value="Target name"/><set name="pz:cclmap:term" value="u=1016"/><set name="pz:x"/></settings>'),
    ]
    parsed = parse_settings(spark.createDataFrame(files, "file string, payload string"))
    won = S.winning_settings(complete_settings(parsed))
    assert {tuple(r) for r in won.collect()} == {
        ("z.example.com/marc", "pz:cclmap:term", "u=host_wildcard"),
        ("z.example.com/marc", "pz:requestsyntax", "marc21"),
        ("z.example.com/marc", "pz:name", "Target name"),
    }
    assert [r["missing"] for r in rejected_settings(parsed).collect()] == ["value"]


def test_database_wildcard(spark):
    rows = [("*/marc", "pz:name", "by db", 0, 1), ("h1/marc", "x", "1", 0, 2), ("h2/other", "x", "2", 0, 3)]
    won = S.winning_settings(spark.createDataFrame(rows, "target string, name string, value string, precedence int, ord int"))
    assert [r["source"] for r in won.filter("name = 'pz:name'").collect()] == ["h1/marc"]


def test_approximation(spark):
    row = spark.range(1).select(
        ST.approx_hits(F.lit(100), F.lit(20), F.lit(5)).alias("a"),
        ST.approx_hits(F.lit(7), F.lit(0), F.lit(0)).alias("b"),
        ST.approx_hits(F.lit(7), F.lit(3), F.lit(1)).alias("c"),
        FA.term_factor(F.lit(250), F.lit(100)).alias("f"),
    ).first()
    assert tuple(row) == (75, 7, ((10 * 7 * 2) // 3 + 5) // 10, 2)

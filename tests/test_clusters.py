"""Clusters of sub-records with the expected sizes and ids of the golden runs, and components against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from concord import Catalog, FieldSpec
from concord.functions.chains import WORDS
from concord.operators import clusters as C, merge as M, records as R
from concord.sources.internal import parse_payloads

CATALOG = Catalog(
    (
        FieldSpec("author", brief=True, termlist=True, merge="longest", mergekey="optional"),
        FieldSpec("medium", brief=True, merge="longest", mergekey="optional"),
        FieldSpec("date", brief=True, type="year", sortkey="numeric", termlist=True),
        FieldSpec("title", brief=True, sortkey="skiparticle", merge="longest", rank="6", mergekey="required"),
        FieldSpec("url", brief=True),
    ),
    chains={"mergekey": WORDS},
)


def record(volume, url=False):
    values = [("author", "Jack Collins"), ("medium", "book"), ("date", "1995"), ("title", f"How to program a computer vol{volume}")]
    if url:
        values.append(("url", "http://www.example.org/"))
    return "<record>" + "".join(f'<metadata type="{n}">{v}</metadata>' for n, v in values) + "</record>"


def payloads(spark):
    rows = [
        (1, "<c:cluster xmlns:c='u'>" + record(1, True) + record(2) + "</c:cluster>"),
        (2, "<cluster>" + record(3) + record(4) + "</cluster>"),
        (3, record(1, True)),
        (4, "<cluster>" + record(1) + record(4) + "</cluster>"),
        (5, "<record><metadata"),
        (6, "<thing/>"),
    ]
    frame = spark.createDataFrame(rows, "position int, payload string")
    return frame.withColumn("source", F.lit("localhost:9999")).withColumn("arrival", F.col("position"))


def fused(spark, upto):
    parsed = parse_payloads(payloads(spark).filter(F.col("position") <= upto)).drop("payload", "failure")
    subs = C.explode_subrecords(parsed, CATALOG)
    records = R.type_values(R.conform(subs, CATALOG), CATALOG)
    return C.drop_exact_duplicates(C.assign_clusters(records), CATALOG)


def test_failures(spark):
    failed = parse_payloads(payloads(spark)).filter("failure = 'ingest'").select("position").collect()
    assert sorted(r[0] for r in failed) == [5, 6]


@pytest.mark.parametrize("upto,sizes", [(1, [2]), (2, [2, 2]), (3, [2, 2]), (4, [5])])
def test_golden_sizes(spark, upto, sizes):
    merged = M.merge_records(fused(spark, upto), CATALOG).collect()
    assert sorted(r["members"] for r in merged) == sizes


def test_golden_cluster(spark):
    row = M.merge_records(fused(spark, 4), CATALOG).first()
    assert row["recid"] == "content: author jack collins medium book title how to program a computer vol1"
    assert row["merged"]["title"] == "How to program a computer vol1"
    assert tuple(row["merged"]["date"]) == (1995, 1995)
    assert row["sort"]["title"] == "how to program a computer vol1"


def brute_components(groups):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for keys in groups:
        for k in keys[1:]:
            a, b = sorted((find(keys[0]), find(k)))
            parent[b] = a
        find(keys[0])
    return {k: find(k) for k in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed):
    rng = random.Random(seed)
    # a long chain, a hub and random links
    groups = [[f"c{i:03}", f"c{i + 1:03}"] for i in range(60)] + [["hub", f"h{i}"] for i in range(40)]
    groups += [[f"r{rng.randrange(80)}" for _ in range(rng.randrange(1, 4))] for _ in range(60)]
    frame = spark.createDataFrame([(i, list(dict.fromkeys(g))) for i, g in enumerate(groups)], "id int, keys array<string>")
    got = {r["id"]: r["cluster"] for r in C.assign_clusters(frame).collect()}
    want = brute_components([list(dict.fromkeys(g)) for g in groups])
    assert got == {i: want[g[0]] for i, g in enumerate(groups)}


def test_merge_keys(spark):
    catalog = Catalog(
        (
            FieldSpec("title", merge="longest", mergekey="required"),
            FieldSpec("author", merge="unique", mergekey="optional"),
            FieldSpec("medium", merge="longest", mergekey="optional"),
        )
    )
    rows = [
        (1, "The Book", None, "cd 2", None),
        (2, "The Book", "!", "cd", None),
        (3, None, "Ann", "cd", None),
        (4, "x", None, None, "Own, key"),
    ]
    table = spark.createDataFrame(rows, "id int, title string, author string, medium string, k string")
    records = R.table_records(table, catalog, {"title": "title", "author": "author", "medium": "medium"}, "'s'", "id", "id")
    records = records.join(table.select(F.col("id").alias("arrival"), "k"), "arrival")
    keys = lambda **o: [r["cluster"] for r in C.with_merge_key(records, catalog, **o).orderBy("arrival").collect()]
    assert keys(supplied="k") == [
        "content: title the book medium cd",
        "content: title the book author medium cd",
        "position: s-000003",
        "content: own key",
    ]
    assert keys(keys=["medium"])[2:] == ["content: medium cd", "position: s-000004"]

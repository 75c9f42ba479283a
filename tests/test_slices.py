"""Tables that are made of line items slice by slice."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from concord.operators import rank as R
from concord.plans import core, views
from concord.session import stored_parts

LINE = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_extendedprice double, l_shipdate timestamp, l_quantity double"
PARTS = [(1, "small gear", "Brand#1", "LARGE"), (2, "red widget", "Brand#1", "LARGE"), (3, "big bolt", "Brand#2", "SMALL"), (4, "bolt", "Brand#1", "LARGE"), (5, "small widget", "Brand#2", "SMALL")]


def tables(spark, folder):
    rng = random.Random(3)
    day = lambda: f"199{rng.randrange(8)}-03-01 00:00:00"
    price = lambda: rng.choice([None, 0.0, math.nan, *[float(n) for n in range(40)]])
    rows = [(o, n, rng.choice([1, 2, 3, 4, 5, 9]), rng.choice([1, 2]), price(), day(), 1.0) for o in range(200) for n in range(3)]
    # copies under other keys, and rows that come twice
    rows += [(1000 + o, n, part, supplier, p, d, q) for o, n, part, supplier, p, d, q in rows[:300]] + rows[:50]
    line = spark.createDataFrame(rows, LINE.replace("timestamp", "string")).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    line.write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(PARTS, "p_partkey bigint, p_name string, p_brand string, p_type string").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(1, "s"), (2, "t")], "s_suppkey bigint, s_name string").write.parquet(f"{folder}/supplier.parquet")
    return rows


@pytest.mark.parametrize("key", ["l_extendedprice", "l_orderkey"])
def test_every_line_item_is_in_one_slice(spark, tmp_path, monkeypatch, key):
    rows = tables(spark, str(tmp_path))
    assert len(views.line_slices(spark, str(tmp_path), key)) == 1
    monkeypatch.setattr(views, "SLICE_BYTES", 1)
    parts = [views.table(spark, str(tmp_path), "lineitem").filter(s).select(key).collect() for s in views.line_slices(spark, str(tmp_path), key)]
    assert len(parts) == 8 and min(map(len, parts)) > 0 and sum(map(len, parts)) == len(rows)
    keys = [{str(r[0]) for r in part} for part in parts]
    assert sum(map(len, keys)) == len(set().union(*keys))


def brute(rows):
    """Records, and those whose cluster had the term when they arrived."""
    names = {p: (name, brand, kind) for p, name, brand, kind in PARTS}
    kept = {}
    low = lambda x: (x is not None, x is not None and math.isnan(x), x or 0.0)  # null is least, NaN the largest number
    for o, n, part, supplier, price, day, quantity in rows:
        if part in names:
            key = (supplier, names[part], day[:4], str(price))
            kept[key] = min(kept.get(key, (math.inf,)), (o, n, part, supplier, low(price), day, quantity))
    first = {}
    for (_, (name, brand, kind), _, _), arrival in kept.items():
        # digits are no part of a key
        cluster = (re.sub("[^A-Za-z]", "", brand), kind)
        for t in name.split():
            first[cluster, t] = min(first.get((cluster, t), (math.inf,)), arrival)
    count = lambda t: sum(a >= first.get((("Brand", kind), t), (math.inf,)) for (_, (_, _, kind), _, _), a in kept.items())
    return len(kept), len(kept), count("small"), count("widget")


@pytest.mark.parametrize("slice_bytes", [1, 1 << 30])
def test_records_of_doc_freq_late_are_made_once(spark, tmp_path, monkeypatch, slice_bytes):
    rows = tables(spark, str(tmp_path))
    monkeypatch.setattr(views, "SLICE_BYTES", slice_bytes)
    plans = []
    doc_freq = R.doc_freq
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(R, "doc_freq", lambda clusters, counted, terms: plans.extend([plan(clusters), plan(counted)]) or doc_freq(clusters, counted, terms))
    got = core.doc_freq_late(spark, str(tmp_path))
    assert not re.search("Join|Window", "".join(plans) + plan(got))
    want = brute(rows)
    assert want[0] > want[2] > 0 < want[3] and want[0] < len(rows) - 50
    assert tuple(got.first()) == want


def test_parts_become_one_table(spark):
    frames = (spark.range(n, n + 3).withColumn("n", F.lit(n)) for n in (0, 10, 20))
    table = stored_parts(frames, "parts")
    assert sorted(map(tuple, table.collect())) == [(n + i, n) for n in (0, 10, 20) for i in range(3)]
    assert table.columns == ["id", "n"] and table.stored_path

"""Words near each other against a search over all choices of places."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from concord import Catalog, FieldSpec
from concord.functions.proximity import Near, near, span
from concord.operators.filters import match
from concord.operators.records import table_records


def brute_span(tokens, words, ordered):
    places = [[i for i, t in enumerate(tokens) if t == w] for w in words]
    best = None
    for choice in itertools.product(*places):
        if len(set(choice)) == len(choice) and (not ordered or list(choice) == sorted(choice)):
            width = max(choice) - min(choice)
            best = width if best is None else min(best, width)
    return best


@pytest.mark.parametrize("ordered", [True, False])
def test_span_is_the_narrowest_window(spark, ordered):
    random.seed(11)
    texts = [[random.choice("abcx") for _ in range(random.randint(0, 14))] for _ in range(200)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, tokens array<string>")
    for words in [("a",), ("a", "b"), ("b", "a"), ("a", "a"), ("a", "b", "c"), ("a", "b", "a"), ("c", "c", "b")]:
        got = {r["i"]: r["s"] for r in frame.select("i", span(F.col("tokens"), words, ordered).alias("s")).collect()}
        assert got == {i: brute_span(t, words, ordered) for i, t in enumerate(texts)}, words


def test_near_in_one_value_of_a_field(spark):
    catalog = Catalog((FieldSpec("title"), FieldSpec("note")))
    long = " ".join(["filler"] * 30_000 + ["red", "x", "Widget"] + ["filler"] * 30_000)
    rows = [(1, "red widget", ""), (2, "red", "widget"), (3, "widget, red!", None), (4, long, None), (5, None, "RED-small-widget")]
    table = spark.createDataFrame(rows, "id int, title string, note string")
    records = table_records(table, catalog, {"title": "title", "note": "note"}, "'s'", "id")
    found = lambda **k: {r["arrival"] for r in records.filter(match(catalog, **k)).collect()}
    assert found(near=Near(("red", "widget"), 1, True)) == {1}
    assert found(near=Near(("red", "widget"), 1)) == {1, 3}
    assert found(near=Near(("Red", "widget"), 2, True)) == {1, 4, 5}
    assert found(near=Near(("red", "widget"), 2, True), field="note") == {5}
    assert found(near=[Near(("red", "widget"), 2), Near(("x", "red"), 1)]) == {4}
    assert found(near=Near(("red", "red"), 5)) == set()


def test_near_without_text_is_false(spark):
    frame = spark.createDataFrame([(None,), ([],), (["a"],)], "tokens array<string>")
    assert [r[0] for r in frame.select(near(F.col("tokens"), Near(("a",), 0))).collect()] == [False, False, True]
    with pytest.raises(ValueError):
        Near((), 3)

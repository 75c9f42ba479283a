"""Stages of the pipeline: what they keep against brute force, odd rows, empty tables."""

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from concord.session import stored
from tests.llm.test_operators import CODER, brute_near, none, odd  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with labels for the odd rows."""
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(5, 1, 0), (6, 1, 0), (7, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_of_odd_rows(spark, odd, none, folder):  # noqa: F811
    for name, stage in pipeline.STAGES[:-1]:
        kept = stored(stage(spark, odd, folder), "stage")
        assert kept.columns == odd.columns, name
        assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in odd.collect()}, name
        assert stage(spark, none, folder).collect() == [], name
    tokens = pipeline.STAGES[-1][1]
    coded = tokens(spark, odd, folder).collect()
    assert len(coded) == odd.count() and all(r["round_trip"] for r in coded)
    texts = sorted(CODER.encode(r["text"] or "") for r in odd.collect())
    assert sorted(r["ids"] for r in coded) == texts
    assert tokens(spark, none, folder).collect() == []


def test_one_row_of_every_group_stays(spark, odd, folder):  # noqa: F811
    kept = pipeline.one_of_near(spark, odd, folder).collect()
    # the plain text stays once under its least id, the other texts of that id and rows without words stay
    assert sorted((r["doc_id"], len(r["text"] or "")) for r in kept if r["doc_id"] in (1, 2, 3, 5, 6)) == [
        (1, 0), (2, 0), (3, 4), (5, 30), (5, 213),
    ]
    assert not [r for r in kept if r["doc_id"] is None]
    # with nothing but a null id a group keeps that row
    alone = odd.filter("doc_id IS NULL").unionAll(odd.filter("doc_id IS NULL"))
    assert len(pipeline.one_of_near(spark, alone, folder).collect()) == 1
    # rows without words are in no group
    blank = odd.filter("doc_id IN (1, 2, 3)")
    assert pipeline.one_of_near(spark, blank.unionAll(blank), folder).count() == 6


def test_pipeline_is_its_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = docs
    for name, stage in pipeline.STAGES[:2]:
        before = {r["doc_id"] for r in kept.collect()}
        kept = stored(stage(spark, kept, FOLDER), "stage")
        after = {r["doc_id"] for r in kept.collect()}
        clean = {d for d in before if labels.get(d) == 1}
        assert len(after & clean) >= 0.9 * len(clean), name
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    wanted = {d for d, _, least, _ in brute_near(rows) if d == least}
    single = stored(pipeline.one_of_near(spark, kept, FOLDER), "stage")
    assert {r["doc_id"] for r in single.collect()} == wanted and single.count() == len(wanted)
    mixed = pipeline.mix(spark, single, FOLDER)
    result = pipeline.run(spark, FOLDER)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["ids"] for r in result.collect()}
    assert got.keys() == {r["doc_id"] for r in mixed.collect()} and got
    assert all(CODER.decode(ids) == texts[d].encode() for d, ids in got.items())
    assert result.filter(F.col("round_trip")).count() == len(got)

"""A ranked stream against ranking everything at once."""

import random

import pytest

from concord import Catalog, FieldSpec
from concord.operators import rank as R
from concord.operators.records import table_records
from concord.session import scratch_path
from concord.streaming import intake as ST, ranked as SR
from pyspark.sql import functions as F

CATALOG = Catalog(
    (
        FieldSpec("title", rank="6", merge="longest", sortkey="skiparticle"),
        FieldSpec("note", rank="2", merge="first"),
        FieldSpec("date", type="year", merge="range", sortkey="numeric"),
        FieldSpec("price", type="float", merge="range"),
    )
)
SCHEMA = "id bigint, cluster string, title string, note string, yr int, price double"


def rows(n, seed):
    random.seed(seed)
    word = lambda: random.choice(["The red", "small", "widget", "é rod", "of", ""])
    made = []
    for i in range(n):
        cluster = "hot" if i % 3 == 0 else f"c{random.randint(0, 12)}"
        title = " ".join(word() for _ in range(random.randint(0, 4))) or None
        note = random.choice([None, "red note", "x"])
        made.append((i, cluster, title, note, random.choice([None, 1990 + i % 7]), random.choice([None, float(i % 11)])))
    return made


def of_stream(table):
    """Typed records that keep the cluster of the table."""
    typed = table_records(table, CATALOG, {"title": "title", "note": "note", "date": "yr", "price": "price"}, "cluster", "id")
    return typed.withColumn("cluster", F.col("source"))


@pytest.mark.parametrize("cuts", [[0, 60, 61, 200], [0, 200], [0, 20, 20, 90, 200]])
def test_scores_after_batches_equal_those_of_all_records(spark, tmp_path, cuts):
    made = rows(200, len(cuts))
    terms = R.query_terms("red widget rod", CATALOG)
    own = ST.stream_session(spark)
    folder, path, checkpoint = str(tmp_path / "in"), scratch_path(spark, "ranked"), scratch_path(spark, "checkpoint")
    for low, high in zip(cuts, cuts[1:]):
        part = spark.createDataFrame(made[low:high], SCHEMA)
        part.repartition(3).write.mode("append").parquet(folder)
        stream = own.readStream.schema(SCHEMA).parquet(folder)
        SR.write_ranked(SR.ranked_stream(of_stream(stream), CATALOG, terms), path, checkpoint).awaitTermination()
        if high > low:
            so_far = of_stream(spark.createDataFrame(made[:high], SCHEMA))
            wanted = R.rank(so_far, CATALOG, "red widget rod")
            columns = ["cluster", "recid", "members", "first_arrival", "merged", "sort", "relevance"]
            key = lambda r: repr(r)
            got = SR.running_ranks(spark, path, CATALOG, terms).select(*columns).collect()
            assert sorted(got, key=key) == sorted(wanted.select(*columns).collect(), key=key)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ST.STORE


def test_arrivals_must_be_numbers(spark):
    with pytest.raises(ValueError):
        SR.ranked_stream(of_stream(spark.createDataFrame(rows(3, 1), SCHEMA)).withColumn("arrival", F.lit("x")), CATALOG, R.query_terms("red", CATALOG))

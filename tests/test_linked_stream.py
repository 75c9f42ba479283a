"""Components that grow by batches against components of all records."""

import random

import pytest
from pyspark.sql import functions as F

from concord.operators.clusters import assign_clusters, key_index
from concord.sources.sinks import get_record
from concord.streaming import linked as SL

SCHEMA = "id bigint, keys array<string>"


def clusters_of(frame):
    return {r["id"]: r["cluster"] for r in frame.select("id", "cluster").collect()}


def run(spark, tmp_path, parts):
    folder, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    sizes = []
    for n, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        SL.write_links(stream, path, checkpoint).awaitTermination()
        whole = spark.createDataFrame([r for p in parts[: n + 1] for r in p], SCHEMA)
        got = SL.with_running_clusters(whole, SL.running_components(spark, path))
        assert clusters_of(got) == clusters_of(assign_clusters(whole)), n
        written = lambda name: spark.read.schema("key string, id string, root string, batch bigint").parquet(f"{path}/{name}")
        sizes.append(tuple(written(name).filter(F.col("batch") == n).count() for name in ("keys", "roots")))
    return path, sizes


def test_a_batch_joins_two_old_clusters(spark, tmp_path):
    big = [(i, ["m", f"m{i}"]) for i in range(50)]
    parts = [big + [(60, ["x", "y"]), (61, ["alone"])], [(70, ["p", "q"]), (71, ["x", "z"])], [(80, ["z", "m7"]), (81, ["a", "q"]), (82, None), (83, [])]]
    path, sizes = run(spark, tmp_path, parts)
    # joining the clusters of x and of m wrote no key again, and one new name for x
    assert sizes == [(53, 2), (3, 1), (1, 3)]
    # a repeated batch changes nothing
    before = sorted(map(tuple, SL.running_components(spark, path).collect()))
    SL.add_links(spark, path, spark.createDataFrame(parts[2], SCHEMA), 2)
    assert sorted(map(tuple, SL.running_components(spark, path).collect())) == before


@pytest.mark.parametrize("seed", [1, 2])
def test_random_batches(spark, tmp_path, seed):
    random.seed(seed)
    key = lambda: f"k{random.randint(0, 70)}"
    parts = [[(100 * b + i, [key() for _ in range(random.choice([1, 1, 2, 2, 3]))]) for i in range(12)] for b in range(4)]
    run(spark, tmp_path, parts)


def test_a_cluster_is_found_by_any_of_its_keys(spark):
    rows = [(1, ["a", "b"]), (2, ["c"]), (3, ["b", "c", None]), (4, ["d"]), (5, None)]
    frame = spark.createDataFrame(rows, SCHEMA).select(F.col("id").alias("arrival"), "keys", F.lit("s").alias("source"), F.col("id").alias("position"))
    records = assign_clusters(frame.withColumn("keys", F.filter("keys", lambda k: k.isNotNull())))
    index = key_index(records)
    assert sorted(map(tuple, index.collect())) == [("a", "a"), ("a", "b"), ("a", "c"), ("d", "d")]
    merged = records.groupBy("cluster").agg(F.min("cluster").alias("recid"))
    found = lambda key, **k: [r["arrival"] for r in get_record(merged, records, key, keys=index, **k).collect()]
    assert [found(k) for k in "abcdx"] == [[1, 2, 3], [1, 2, 3], [1, 2, 3], [4], []]
    assert found("c", offset=1) == [2]

"""Streams in several micro-batches against the batch result, and state that expires."""

import os

from pyspark.sql import functions as F

from concord import Catalog, FieldSpec
from concord.operators.facets import facets
from concord.operators.merge import merge_records
from concord.operators.records import table_records
from concord.session import numbered_folders
from concord.streaming import intake as ST

CATALOG = Catalog((FieldSpec("title", termlist=True, merge="longest"), FieldSpec("price", type="float", merge="range")))
SCHEMA = "cluster string, name string, num double, id bigint"
ROWS = [(f"c{i % 5}", f"word{i % 3} number {i % 4}", float(i * 7 % 11), i) for i in range(60)]


def batches(spark, tmp_path, parts):
    """Every part is a file, and every file a micro-batch."""
    folder = str(tmp_path / "files")
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder, spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(folder)


def records(rows):
    typed = table_records(rows, CATALOG, {"title": "name", "price": "num"}, "'s'", "id")
    return typed.withColumn("cluster", F.concat(F.lit("c"), (F.col("arrival") % 5).cast("string")))


def test_clusters_and_facets_of_several_batches(spark, tmp_path):
    folder, stream = batches(spark, tmp_path, [ROWS[i::4] for i in range(4)])
    whole = records(spark.read.schema(SCHEMA).parquet(folder))
    running = ST.stream_clusters(records(stream), CATALOG)
    path = ST.run_to_table(running, "clusters")
    assert spark.read.parquet(path).select("batch").distinct().count() == 4
    found = ST.latest(spark, path, ["cluster"], running.schema).select("cluster", "members", "merged")
    assert sorted(found.collect()) == sorted(merge_records(whole, CATALOG).select("cluster", "members", "merged").collect())
    running = ST.stream_facets(records(stream), CATALOG)
    path = ST.run_to_table(running, "facets")
    found = ST.latest(spark, path, ["facet", "norm"], running.schema).select("facet", "norm", "frequency")
    assert sorted(found.collect()) == sorted(facets(whole, CATALOG).select("facet", "norm", "frequency").collect())


def test_idle_clusters_are_forgotten(spark, tmp_path):
    a, b = ("a", "x", 1.0, 1), ("b", "x", 5.0, 2)
    folder, _ = batches(spark, tmp_path, [[a, a, ("a", "x", 9.0, 3)], [b], [a]])
    own = ST.stream_session(spark, spark_sql_streaming_noDataMicroBatches_enabled="false")
    stream = own.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(folder)
    for ttl, members in ((1, 1), (3_600_000, 4)):
        running = ST.stream_idle_clusters(stream, ttl)
        path = ST.run_to_table(running, "idle")
        newest = {r["cluster"]: r for r in ST.latest(spark, path, ["cluster"], spark.createDataFrame([], ST.IDLE_ROW).schema).collect()}
        assert newest["a"]["members"] == members and newest["b"]["members"] == 1
        assert newest["a"]["high"] == (1.0 if members == 1 else 9.0)


def test_tables_of_updates_are_compacted(spark, tmp_path):
    folder, stream = batches(spark, tmp_path, [ROWS[i::9] for i in range(9)])
    running = ST.stream_clusters(records(stream), CATALOG)
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    ST.write_updates(running, path, checkpoint, keys=["cluster"], compact_every=3).awaitTermination()
    whole = merge_records(records(spark.read.schema(SCHEMA).parquet(folder)), CATALOG).select("cluster", "members", "merged")
    found = lambda: sorted(ST.latest(spark, path, ["cluster"], running.schema).select("cluster", "members", "merged").collect())
    assert found() == sorted(whole.collect())
    # the base of all nine batches, the one before it, and what stands behind that
    assert numbered_folders(spark, f"{path}_base", "upto") == [5, 8] and numbered_folders(spark, path, "batch") == [6, 7, 8]
    assert ST.compact(spark, path, ["cluster"], running.schema) is None
    # a base that was not written whole counts for nothing
    os.makedirs(f"{path}_base/upto=99")
    assert found() == sorted(whole.collect())

"""Clusters of records with several keys that follow a stream: components grow by the links of every micro-batch.

Two tables are kept below a path, both by batch. `keys` has every key once, with the number of the component that it first belonged to, here
called its id; rows are only added. `roots` tells to which component an id belongs now, newest row first; a join of old components changes
a row per id and none per key. A batch looks up the keys that it links, runs the star rounds over its links between what
they belong to now, and writes what is new. So old components are touched only where a batch links them.

A component is named by its least key, as `assign_clusters` does, and the result is the same as that over all records so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from concord.operators.clusters import components
from concord.session import stored

KEYS, ROOTS = "key string, id string", "id string, root string"


def _table(spark: SparkSession, path: str, name: str, schema: str, before: int | None) -> DataFrame:
    """Rows of the batches before `before`, all without it."""
    if before == 0:
        return spark.createDataFrame([], f"{schema}, batch bigint")
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(f"{path}/{name}")
    return rows if before is None else rows.filter(F.col("batch") < before)


def _newest(roots: DataFrame) -> DataFrame:
    return roots.groupBy("id").agg(F.max_by("root", "batch").alias("root"))


def add_links(spark: SparkSession, path: str, records: DataFrame, batch: int) -> None:
    """Take the records of a batch (with an array column `keys`) into the tables at `path`. A repeated batch replaces itself."""
    several = records.select(F.array_distinct(F.filter("keys", lambda k: k.isNotNull())).alias("keys")).filter(F.size("keys") > 1)
    links = several.select(F.array_min("keys").alias("v"), F.explode("keys").alias("u")).filter("u <> v")
    links = stored(links.distinct(), "links")
    ends = links.select(F.col("u").alias("key")).union(links.select(F.col("v").alias("key"))).distinct()

    keys, roots = _table(spark, path, "keys", KEYS, batch), _table(spark, path, "roots", ROOTS, batch)
    met = ends.join(keys.select("key", "id"), "key", "left")
    touched = _newest(roots.join(met.select("id").distinct(), "id", "left_semi"))
    # what every key of the batch belongs to: a component, or itself if it is new
    now = stored(met.join(touched, "id", "left").select("key", "id", F.coalesce("root", "key").alias("name")), "now")
    side = lambda k, name: now.select(F.col("key").alias(k), F.col("name").alias(name))
    edges = links.join(side("u", "a"), "u").join(side("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    joined = stored(components(edges), "joined")

    new = now.filter("id IS NULL").join(joined, F.col("key") == F.col("node")).select("key", F.col("component").alias("id"))
    moved = joined.filter("node <> component").select(F.col("node").alias("root"), F.col("component").alias("to"))
    changed = _newest(roots).join(moved, "root").select("id", F.col("to").alias("root"))
    named = joined.select(F.col("component").alias("id")).distinct().join(roots.select("id"), "id", "left_anti")
    new.write.mode("overwrite").parquet(f"{path}/keys/batch={batch}")
    changed.unionByName(named.select("id", F.col("id").alias("root"))).write.mode("overwrite").parquet(f"{path}/roots/batch={batch}")


def running_components(spark: SparkSession, path: str) -> DataFrame:
    """`key, cluster` for every key so far that is linked to another one."""
    keys = _table(spark, path, "keys", KEYS, None).select("key", "id")
    roots = _newest(_table(spark, path, "roots", ROOTS, None))
    return keys.join(roots, "id").select("key", F.col("root").alias("cluster"))


def write_links(records: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep the components of a stream of records with an array column `keys` at `path`."""
    writer = records.select("keys").writeStream.foreachBatch(lambda rows, batch: add_links(rows.sparkSession, path, rows, batch))
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def with_running_clusters(records: DataFrame, found: DataFrame) -> DataFrame:
    """Records with `keys` and the `cluster` that their first key belongs to in `found` (`key, cluster`); a key that is linked to no
    other is a cluster of its own."""
    first = records.withColumn("key", F.get("keys", F.lit(0)))
    return first.join(found, "key", "left").withColumn("cluster", F.coalesce("cluster", "key")).drop("key")

"""Continuous intake: records as a stream, running facets, status and clusters, duplicates, readiness, idle expiry.

The batch operators run unchanged on streams. What a stream updates goes to a table in the shared folder, one set of rows
per micro-batch, and a reader takes the newest row of every key.
"""

from __future__ import annotations

from typing import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.errors import StreamingQueryException
from pyspark.sql.streaming import StreamingQuery

from concord.catalog import Catalog
from concord.operators.facets import facets
from concord.operators.merge import merge_records
from concord.operators.status import ACTIVE
from concord.session import delete, numbered_folders, scratch_path
from concord.sources.internal import parse_payloads
from concord.sources.splits import stream_split_records
from concord.streaming.expiry import TimedClusters


def stream_session(spark: SparkSession, **settings: str) -> SparkSession:
    """A session of its own for streams whose state is typed or kept for a time, with the state store that they need; the
    caller's session keeps its settings. `settings` are further ones, with `_` for `.` in names."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    for name, value in settings.items():
        own.conf.set(name.replace("_", "."), value)
    return own


#: Keeps state on disk, by column families, with times to live.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def stream_records(
    spark: SparkSession, folder: str, attributes: Sequence[str] = ("rank",), per_trigger: int = 1000, row_tag: str = "record"
) -> DataFrame:
    """Files of internal XML as a stream of parsed records, files read in splits: `file, block, payload, subrecords, failure`."""
    return parse_payloads(stream_split_records(spark, folder, row_tag, per_trigger), attributes=attributes)


def stream_facets(records: DataFrame, catalog: Catalog) -> DataFrame:
    """Running facet counts."""
    return facets(records, catalog)


def stream_status(fetched: DataFrame) -> DataFrame:
    """Running counts per source of records that arrived, were filtered or failed."""
    return fetched.groupBy("source").agg(
        F.count(F.lit(1)).alias("fetched"),
        F.count_if("filtered").alias("filtered"),
        F.count_if(F.col("failure").isNotNull()).alias("failures"),
    )


def stream_dedup(records: DataFrame, same: Sequence[str], arrival: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Drop records that share `same` with an earlier one. With an `arrival` time, the state is kept for `delay` only."""
    if arrival is None:
        return records.dropDuplicates(list(same))
    return records.withWatermark(arrival, delay).dropDuplicatesWithinWatermark(list(same))


def stream_clusters(records: DataFrame, catalog: Catalog, extra: Sequence[Column] = ()) -> DataFrame:
    """Merged fields and counts per merge key; a micro-batch emits the clusters it changed.

    The state is one aggregate row per cluster and a batch is combined before the shuffle, so a hot key costs no more than
    any other. Records with several keys need the batch operator `assign_clusters`.
    """
    return merge_records(records, catalog, list(extra))


# -- running and reading ---------------------------------------------------------------------------------------------------


def write_updates(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    mode: str = "update",
    available_now: bool = True,
    keys: Sequence[str] = (),
    compact_every: int = 0,
) -> StreamingQuery:
    """Append every micro-batch to the table at `path` with its number in `batch`; a repeated batch replaces itself. With `keys`, the
    table is compacted behind every so many batches."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        if keys and compact_every and (batch + 1) % compact_every == 0:
            compact(rows.sparkSession, path, keys, rows.schema)

    writer = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(spark: SparkSession, path: str, keys: Sequence[str], schema: T.StructType) -> DataFrame:
    """Newest row of every key of a table made by `write_updates`: of its last base and the batches behind it."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(full).parquet(path)
    bases = numbered_folders(spark, f"{path}_base", "upto")
    if bases:
        base = spark.read.schema(schema).parquet(f"{path}_base/upto={bases[-1]}")
        rows = rows.filter(F.col("batch") > bases[-1]).unionByName(base.withColumn("batch", F.lit(bases[-1]).cast("bigint")))
    others = [c for c in schema.names if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("row"))
    return newest.select(*keys, "row.*")


def compact(spark: SparkSession, path: str, keys: Sequence[str], schema: T.StructType) -> int | None:
    """Write the newest rows of a table made by `write_updates` as its base, and drop what the base before it stood for; the
    number of the last batch in the base, or None if there is no new one.

    The base of before and the batches behind it stay until the next call, for readers that have begun with them. A call that
    breaks off leaves the table as it was.
    """
    batches, bases = numbered_folders(spark, path, "batch"), numbered_folders(spark, f"{path}_base", "upto")
    if not batches or bases and batches[-1] <= bases[-1]:
        return None
    latest(spark, path, keys, schema).write.mode("overwrite").parquet(f"{path}_base/upto={batches[-1]}")
    if bases:
        for n in batches:
            if n <= bases[-1]:
                delete(spark, f"{path}/batch={n}")
        for n in bases[:-1]:
            delete(spark, f"{path}_base/upto={n}")
    return batches[-1]


def run_to_table(stream: DataFrame, name: str, mode: str = "update") -> str:
    """Run a stream over what is there now; the path of its table."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    write_updates(stream, path, scratch_path(spark, f"{name}-checkpoint"), mode).awaitTermination()
    return path


# -- gate and stop -------------------------------------------------------------------------------------------------------------


class Stopped(Exception):
    """Raised in a batch that came while its query was being stopped."""


def run_until(
    stream: DataFrame,
    write: Callable[[DataFrame, int], None],
    gate: Callable[[SparkSession, int], bool],
    checkpoint: str,
    mode: str = "append",
    available_now: bool = True,
) -> int | None:
    """Run a stream through `write(rows, batch)` until `gate(spark, batch)` holds behind a batch, then stop it; the number of
    that batch, or None if the input came to its end before.

    A batch that has begun meanwhile writes nothing and isn't committed, so that what was written is just the finished batches,
    and a later run from the same checkpoint goes on behind them.
    """
    opened: list[int] = []

    def each(rows: DataFrame, batch: int) -> None:
        if opened:
            raise Stopped
        write(rows, batch)
        if gate(rows.sparkSession, batch):
            opened.append(batch)

    writer = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if available_now else writer).start()
    try:
        while not opened and not query.awaitTermination(0.2):
            pass
        if opened:
            query.stop()
            query.awaitTermination()
    except StreamingQueryException:
        if not opened:
            raise
    return opened[0] if opened else None


# -- readiness ---------------------------------------------------------------------------------------------------------------


def ready(status: DataFrame, mode: str = "any") -> Column | DataFrame:
    """One row `ready`: may a reader be served?

    `any`: a record is there or no source is active; `preferred`: no preferred source is active; `all`: no source is
    active. `status` is `state, records, preferred boolean`.
    """
    active = F.col("state").isin(*ACTIVE)
    rules = {
        "any": (F.coalesce(F.sum("records"), F.lit(0)) > 0) | (F.count_if(active) == 0),
        "preferred": F.count_if(active & F.col("preferred")) == 0,
        "all": F.count_if(active) == 0,
    }
    return status.agg(rules[mode].alias("ready"))


# -- idle expiry -------------------------------------------------------------------------------------------------------------

IDLE_ROW = "cluster string, members long, low double, high double"


def stream_idle_clusters(records: DataFrame, ttl_ms: int = 60_000) -> DataFrame:
    """Clusters `cluster, members, low, high` of a stream `cluster, num`, forgotten by the state store when idle for `ttl_ms` by the
    clock. The session must have been made by `stream_session`.

    Rows are combined per cluster inside the tasks first, so a hot cluster sends a few rows to its state.
    """

    def combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.groupby("cluster", dropna=False)["num"].agg(members="size", low="min", high="max").reset_index()

    rows = records.select("cluster", "num").mapInPandas(combined, IDLE_ROW)
    return rows.groupBy("cluster").transformWithStateInPandas(TimedClusters(ttl_ms), IDLE_ROW, "Update", "ProcessingTime")

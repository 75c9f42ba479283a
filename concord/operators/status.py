"""Status of the sources of a run, counted from what they sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

STATES = ("Client_Connecting", "Client_Idle", "Client_Working", "Client_Failed", "Client_Error", "Client_Disconnected")
ACTIVE = ("Client_Connecting", "Client_Working")


def approx_hits(hits: Column, fetched: Column, filtered: Column) -> Column:
    """Hits that are left under local limits: ((10 hits (fetched - filtered)) div fetched + 5) div 10."""
    div = lambda a, b: F.call_function("div", a.cast("bigint"), b.cast("bigint"))
    scaled = div(10 * hits.cast("bigint") * (fetched - filtered), F.nullif(fetched, F.lit(0)))
    return F.when(fetched > 0, div(scaled + 5, F.lit(10))).otherwise(hits.cast("bigint"))


def status_by_source(sources: DataFrame, fetched: DataFrame) -> DataFrame:
    """Per source: hits, records kept, records filtered, approximation, failures, diagnostic, state.

    `sources` is `source, name, hits, state, diagnostic`; `fetched` has one row per record that arrived:
    `source, filtered boolean, failure string` (null, `ingest` or `record`).
    """
    counts = fetched.groupBy("source").agg(
        F.count(F.lit(1)).alias("fetched"),
        F.count_if("filtered").alias("filtered"),
        F.count_if(F.col("failure") == "ingest").alias("ingest_failures"),
        F.count_if(F.col("failure") == "record").alias("record_failures"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    joined = sources.join(counts, "source", "left").select(
        "source",
        F.when(F.coalesce("name", F.lit("")) != "", F.col("name")).otherwise("Unknown").alias("name"),
        "hits",
        "state",
        "diagnostic",
        *[zero(c) for c in ("fetched", "filtered", "ingest_failures", "record_failures")],
    )
    return joined.select(
        "source",
        "name",
        "hits",
        "diagnostic",
        (F.col("fetched") - F.col("filtered")).alias("records"),
        "filtered",
        approx_hits(F.col("hits"), F.col("fetched"), F.col("filtered")).alias("approximation"),
        "ingest_failures",
        "record_failures",
        "state",
    )


def run_summary(status: DataFrame) -> DataFrame:
    """One row: sources per state, without connection, hits, records, and progress (n - active) / n to two decimals."""
    n = F.count(F.lit(1))
    active = F.count_if(F.col("state").isin(*ACTIVE))
    return status.agg(
        n.alias("sources"),
        active.alias("active"),
        *[F.count_if(F.col("state") == s).alias(s.removeprefix("Client_").lower()) for s in STATES[:5]],
        F.count_if(F.col("state") == "Client_Disconnected").alias("no_connection"),
        F.sum("hits").alias("hits"),
        F.sum("records").alias("records"),
        F.round((n - active) / n, 2).alias("progress"),
    )

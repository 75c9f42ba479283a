"""One intake for payloads: parse, conform, type, filter, key and duplicates, in one pass over every micro-batch.

Each record gets an outcome: `rejected` (not well formed, another root), `filtered` (outside of the limits), `duplicate` (an exact copy of a kept
record of its source, of this batch or an earlier one) or `kept`. A batch is prepared and written once, partitioned by outcome, so
that rejects, counts and records all come out of the same pass; duplicates are looked up by fingerprint among the kept records.
`take` does the same with a whole table, and batches that come in the order of `arrival` give the same rows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from concord.catalog import Catalog
from concord.operators.clusters import fingerprint, with_merge_key
from concord.operators.filters import Limits, limit_condition
from concord.operators.records import conform, type_values
from concord.session import stored
from concord.sources.internal import RAW_VALUES, parse_payloads

OUTCOMES = ("kept", "duplicate", "filtered", "rejected")


def file_payloads(records: DataFrame, source: Column) -> DataFrame:
    """`source, position, arrival, payload` of records that are read from files in splits (`file, block, payload`)."""
    numbered = records.withColumn("id", F.monotonically_increasing_id())
    return numbered.select(source.alias("source"), F.col("id").alias("position"), F.struct("file", "block", "id").alias("arrival"), "payload")


def prepared(payloads: DataFrame, catalog: Catalog, limits: Limits | None = None, attributes: Sequence[str] = ("rank",)) -> DataFrame:
    """`source, position, arrival, failure, ignored, md, cluster, outcome, print_1, print_2` of every record in `payloads` (`source,
    position, arrival, payload`), and one row for every payload that is rejected.

    `arrival` gets the place of the record in its payload behind it; `ignored` are the field names of its values that the catalog
    does not know. No shuffle, so it works on tables and on streams.
    """
    parsed = parse_payloads(payloads, attributes=attributes)
    rows = parsed.select("source", "position", "arrival", "failure", F.posexplode_outer("subrecords").alias("sub", "record"))
    rows = rows.select(
        "source",
        "position",
        F.struct("arrival", F.coalesce("sub", F.lit(0)).alias("sub")).alias("arrival"),
        F.when(F.col("failure").isNotNull() | F.col("record").isNull(), F.coalesce("failure", F.lit("ingest"))).alias("failure"),
        F.coalesce("record.values", F.array().cast(RAW_VALUES)).alias("values"),
        F.col("record.key").alias("supplied"),
    )
    ignored = F.filter(F.transform("values", lambda v: v["field"]), lambda f: ~f.isin(catalog.names))
    typed = type_values(conform(rows.withColumn("ignored", ignored), catalog), catalog)
    keyed = with_merge_key(typed, catalog, supplied="supplied").drop("supplied")
    inside = limit_condition(catalog, limits) if limits else F.lit(True)
    outcome = F.when(F.col("failure").isNotNull(), "rejected").when(~inside, "filtered").otherwise("kept")
    return fingerprint(keyed.withColumn("outcome", outcome), catalog)


def _judged(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """`rows` with copies of records in `known` (`print_1, print_2`) or of earlier rows as `duplicate`."""
    prints = ["print_1", "print_2"]
    order = W.partitionBy(*prints).orderBy("arrival")
    narrow = rows.filter("outcome = 'kept'").select("arrival", *prints)
    copies = narrow.withColumn("n", F.row_number().over(order)).filter("n > 1").select("arrival")
    if known is not None:
        # the batch is the small side: only prints that it has are looked at further
        met = known.select(*prints).join(narrow.select(*prints).distinct(), prints, "left_semi").distinct()
        copies = copies.union(narrow.join(met, prints, "left_semi").select("arrival")).distinct()
    marked = rows.join(copies.select(F.col("arrival").alias("copy")), F.col("arrival") == F.col("copy"), "left")
    return marked.withColumn("outcome", F.when(F.col("copy").isNotNull(), "duplicate").otherwise(F.col("outcome"))).drop("copy")


def take(payloads: DataFrame, catalog: Catalog, limits: Limits | None = None, attributes: Sequence[str] = ("rank",)) -> DataFrame:
    """All records of a table with their outcome."""
    return _judged(stored(prepared(payloads, catalog, limits, attributes), "prepared"), None)


# -- streams -----------------------------------------------------------------------------------------------------------


def write_batch(rows: DataFrame, batch: int, path: str) -> None:
    """Rows that are `prepared`, of a micro-batch, to the table at `path`; a repeated batch replaces itself."""
    earlier = (F.col("batch") < batch) & (F.col("outcome") == "kept")
    known = _rows(rows.sparkSession, path, rows.schema).filter(earlier) if batch else None
    done = _judged(stored(rows, "prepared"), known)
    done.write.partitionBy("outcome").mode("overwrite").parquet(f"{path}/batch={batch}")


def _rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    written = [f for f in schema.fields if f.name != "outcome"]
    parts = [T.StructField("batch", T.LongType()), T.StructField("outcome", T.StringType())]
    return spark.read.schema(T.StructType([*written, *parts])).parquet(path)


def run_intake(
    payloads: DataFrame, catalog: Catalog, path: str, checkpoint: str, limits: Limits | None = None, available_now: bool = True
) -> StreamingQuery:
    """Take a stream of payloads into the table at `path`."""
    stream = prepared(payloads, catalog, limits)
    writer = stream.writeStream.foreachBatch(lambda rows, batch: write_batch(rows, batch, path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def taken(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The rows that `run_intake` has written so far, with `batch` and `outcome`; `like` is a frame made by `prepared`."""
    return _rows(spark, path, like.schema)


def intake_status(rows: DataFrame) -> DataFrame:
    """Records per source by outcome."""
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("records"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])


def intake_unknown(rows: DataFrame) -> DataFrame:
    """How many values of all records had a field name that the catalog does not know."""
    names = rows.select(F.explode_outer("ignored").alias("field")).filter("field IS NOT NULL")
    return names.groupBy("field").agg(F.count(F.lit(1)).alias("ignored"))

"""Records out of large XML files without reading a file as one row.

The text reader takes the end tag of a record for the end of a line, so that Spark splits files by bytes like any other text,
and a task reads the records that begin in its part of a file. What lies before the start tag of a record (the head of the file, white
space, the end of the collection) is left out. A record without an end tag comes out as it is and then fails in the parser, and the
one behind it is whole again.
"""

from __future__ import annotations

import re
from typing import Callable, NamedTuple, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def _records(lines: DataFrame, tag: str) -> DataFrame:
    """The records in the texts before an end tag. All but the last of a text lack theirs, unless they are empty elements."""
    name = re.escape(tag)
    empty = f"^<{name}(?:\\s[^<>]*)?/>"
    pieces = F.filter(F.split("value", f"(?=<{name}[\\s/>])", -1), lambda p: p.rlike(f"^<{name}[\\s/>]"))
    rows = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), pieces.alias("pieces"))
    rows = rows.select("file", "block", F.size("pieces").alias("n"), F.posexplode_outer("pieces").alias("at", "piece"))
    piece = F.col("piece")
    whole = F.when(piece.rlike(empty), F.regexp_extract(piece, empty, 0)).when(F.col("at") == F.col("n") - 1, F.concat(piece, F.lit(f"</{tag}>")))
    return rows.filter("piece IS NOT NULL").select("file", "block", F.coalesce(whole, piece).alias("payload"))


def split_records(spark: SparkSession, path: str | Sequence[str], tag: str = "record") -> DataFrame:
    """`file, block, payload`: every element `tag` (with its prefix, if it has one) of the UTF-8 files at `path`; `block` is the byte
    at which the part of the file begins that a task has read.

    Elements of this name must not be nested, and their tags must not stand in comments or CDATA sections, where they cut a
    record in two, both of which fail in the parser. A last record that breaks off behind a complete child counts as whole.
    """
    reader = spark.read.option("lineSep", f"</{tag}>").option("recursiveFileLookup", "true")
    return _records(reader.text(path), tag)


def stream_split_records(spark: SparkSession, folder: str, tag: str = "record", files_per_trigger: int = 1000) -> DataFrame:
    """The same from a folder that gets new files, as a stream."""
    reader = spark.readStream.option("lineSep", f"</{tag}>").option("maxFilesPerTrigger", str(files_per_trigger))
    return _records(reader.text(folder), tag)


class Converted(NamedTuple):
    """Documents, records that failed, and a log `file, blocks, documents, failures`."""

    documents: DataFrame
    failures: DataFrame
    log: DataFrame


def convert_records(
    spark: SparkSession,
    source_path: str,
    target_path: str,
    normalizer: Callable[[DataFrame], DataFrame],
    tag: str = "record",
    format: str = "parquet",
) -> Converted:
    """Files of records to documents, in as many tasks as the files have splits.

    `normalizer` takes `file, block, payload` and gives rows with these columns and `failure`. Everything is written once, partitioned by
    outcome, failed records with their payload; the log reads the written columns `file`, `block` and the outcome only.
    """
    done = normalizer(split_records(spark, source_path, tag)).withColumn("failed", F.col("failure").isNotNull())
    kept = F.when(F.col("failed"), F.col("payload")).alias("payload")
    done.select(*[kept if c == "payload" else F.col(c) for c in done.columns]).write.partitionBy("failed").format(format).save(target_path)
    written = spark.read.format(format).schema(done.schema).load(target_path)
    log = written.groupBy("file").agg(
        F.count_distinct("block").alias("blocks"),
        F.count_if(~F.col("failed")).alias("documents"),
        F.count_if("failed").alias("failures"),
    )
    return Converted(written.filter("NOT failed").drop("failed", "failure", "payload"), written.filter("failed").drop("failed"), log)

"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(app: str = "concord", **extra: str) -> SparkSession:
    """A session with the settings the library counts on; `extra` uses `_` for `.` in names."""
    builder = SparkSession.builder.appName(app)
    for name, value in {**SETTINGS, **{k.replace("_", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (`spark.checkpoint.dir`); a local one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    folder = spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="concord-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Whether Spark deletes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the frames that are made and run in here go when their query ends; else they stay until the driver
    happens to collect its garbage, and those of many steps add up."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and cut its lineage."""
    shared_dir(df.sparkSession)
    with tidy(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


_made: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: made once, read with column pruning, and safe when
    executors are lost. The table stays until `drop_table` or `drop_stored`."""
    return stored_parts([df], name)


def stored_parts(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """Frames of the same columns as one `stored` table, written one after another: the shuffle files of one are gone before the next."""
    path = None
    for df in parts:
        path = path or scratch_path(df.sparkSession, name)
        with tidy(df.sparkSession):
            df.write.mode("append").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_path = path
    _made.append(path)
    return table


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    place, files = _place(spark, path)
    files.delete(place, True)


def numbered_folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers n of the folders `name=n` below `path`, in order; of tables only those that are written whole."""
    place, files = _place(spark, path)
    if not files.exists(place):
        return []
    jvm = spark.sparkContext._jvm
    found = [s.getPath() for s in files.listStatus(place) if s.isDirectory() and s.getPath().getName().startswith(f"{name}=")]
    whole = [p for p in found if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in whole)


def drop_table(table: DataFrame) -> None:
    """Delete a table that `stored` has made, once everything that was made of it is written."""
    delete(table.sparkSession, table.stored_path)


def drop_stored(spark: SparkSession) -> int:
    """Delete the tables that `stored` has made since the last call; their number. Call it when the results that were made
    of them are written: frames that read them are of no use any more."""
    n = len(_made)
    while _made:
        delete(spark, _made.pop())
    return n

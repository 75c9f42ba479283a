"""Tables in the shared folder."""

import os
import time

from pyspark.sql import functions as F

from concord.operators import clusters
from concord.session import cut, drop_stored, stored


def test_stored_tables_stay_until_they_are_dropped(spark):
    drop_stored(spark)
    frame = stored(spark.range(5), "five")
    path = frame.inputFiles()[0].removeprefix("file://")
    assert frame.count() == 5 and os.path.exists(path)
    assert drop_stored(spark) == 1 and not os.path.exists(path)
    assert drop_stored(spark) == 0


def test_shuffle_files_go_with_their_query(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = blocks.getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    def left(before):
        for _ in range(50):
            if not shuffled() - before:
                return set()
            time.sleep(0.2)
        return shuffled() - before

    before, setting = shuffled(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    counted = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    table, rows = stored(counted, "counted"), cut(counted)
    links = spark.createDataFrame([(k + 1, k) for k in range(9)], "u bigint, v bigint")
    reached = clusters.components(links)
    assert not left(before)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    assert table.count() == rows.count() == 7 and {r["component"] for r in reached.collect()} == {0}

"""Normalizers: named steps from payloads to raw records, chosen per source.

A normalizer is a function from frame to frame. It keeps `source` and `position` and marks what it can not handle with
`failure`; it may give several rows per payload.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from concord.session import scratch_path, stored

Normalizer = Callable[[DataFrame], DataFrame]


def chain(steps: Sequence[Normalizer]) -> Normalizer:
    """Run steps one after the other; a record that fails in a step does not reach the next one but stays marked."""

    def run(frame: DataFrame) -> DataFrame:
        if "failure" not in frame.columns:
            frame = frame.withColumn("failure", F.lit(None).cast("string"))
        for step in steps:
            before = frame.withColumnRenamed("failure", "failed_before")
            after = step(before)
            if "failure" not in after.columns:
                after = after.withColumn("failure", F.lit(None).cast("string"))
            frame = after.withColumn("failure", F.coalesce("failed_before", "failure")).drop("failed_before")
        return frame

    return run


def normalize(raw: DataFrame, steps: Sequence[Normalizer], ids: Sequence[str] = ("source", "position")) -> tuple[DataFrame, DataFrame]:
    """Records that came through all steps, and the ids of those that did not. The steps run once; what they give is stored."""
    done = stored(chain(steps)(raw), "normalized")
    good = done.filter(F.col("failure").isNull()).drop("failure")
    marked = done.filter(F.col("failure").isNotNull()).select(*ids)
    # a step may also give no row for a record, or a failed row beside good ones
    silent = raw.select(*ids).join(done.select(*ids), list(ids), "left_anti")
    return good, marked.join(good.select(*ids), list(ids), "left_anti").unionByName(silent).distinct()


def choice(settings: Column) -> Column:
    """Name of the normalizer of a source: `pz:xslt`, where `auto` means the record syntax in lower case."""
    stated = settings["pz:xslt"]
    return F.when(stated == "auto", F.lower(settings["pz:requestsyntax"])).otherwise(stated)


def normalize_by_source(
    raw: DataFrame, sources: DataFrame, registry: Mapping[str, Normalizer], chains: Sequence[str] = ()
) -> DataFrame:
    """Every source through the normalizer it names; a comma separated list is a chain.

    One branch per registered name and per chain in `chains`. Records of a source with a normalizer that is neither, or
    with none, come out with `failure`.
    """
    chosen = sources.select("source", choice(F.col("settings")).alias("normalizer"))
    known = sorted(registry)
    known += [c for c in chains if all(n.strip() in registry for n in c.split(","))]
    table = scratch_path(raw.sparkSession, "chosen")
    given = raw.join(chosen, "source", "left")
    # written once by normalizer, so that every branch reads its own part
    given.withColumn("part", F.coalesce("normalizer", F.lit(""))).write.partitionBy("part").parquet(table)
    part = T.StructField("part", T.StringType())
    joined = raw.sparkSession.read.schema(T.StructType([*given.schema.fields, part])).parquet(table)
    branches = []
    for name in known:
        steps = [registry[n.strip()] for n in name.split(",")]
        branches.append(chain(steps)(joined.filter(F.col("part") == name).drop("part")))
    lost = joined.filter(~F.col("part").isin(known)).drop("part").withColumn("failure", F.lit("record"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*branches, lost]).drop("normalizer")

"""Result documents and bulk conversion."""

from __future__ import annotations

from typing import Callable, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from concord.catalog import Catalog
from concord.functions.values import checksum, print_float, print_range
from concord.operators.merge import merge_values
from concord.operators.records import filled, md, shown


def printed(catalog: Catalog, name: str, snippet: Callable[[Column], Column] | None = None) -> Column:
    """Values of a field of a record as they are shown: `array<struct<value, attrs>>`."""
    spec = catalog[name]

    def one(v: Column) -> Column:
        if spec.type == "generic":
            text = shown(v)
            text = F.coalesce(snippet(v["value"]), text) if snippet else text
        elif spec.type == "float":
            text = print_float(v["num"])
        else:
            text = print_range(v["min"], v["max"])
        attrs = F.map_filter(v["attrs"], lambda k, _: k != "empty")
        return F.struct(text.alias("value"), attrs.alias("attrs"))

    return F.transform(md(name), one)


def shown_fields(catalog: Catalog, brief: bool) -> list[str]:
    return [f.name for f in catalog if f.brief or not brief]


def project(clusters: DataFrame, catalog: Catalog, brief: bool = True) -> DataFrame:
    """Merged fields of the brief or full view as columns."""
    names = shown_fields(catalog, brief)
    have = clusters.schema["merged"].dataType.names
    merged = F.struct(*[F.col(f"merged.`{n}`").alias(n) for n in have if n in names])
    return clusters.withColumn("merged", merged)


def locations(
    records: DataFrame, sources: DataFrame | None, catalog: Catalog, brief: bool = True, snippet=None
) -> DataFrame:
    """Member records as they are shown below their cluster: `cluster, arrival, id, name, checksum, md`."""
    fields = F.struct(*[printed(catalog, n, snippet).alias(n) for n in shown_fields(catalog, brief)])
    named = records
    if sources is not None:
        names = sources.select("source", F.col("settings")["pz:name"].alias("name"))
        named = records.join(names, "source", "left")
    else:
        named = records.withColumn("name", F.lit(None).cast("string"))
    return named.select(
        "cluster",
        "arrival",
        F.col("source").alias("id"),
        F.when(filled(F.col("name")), F.col("name")).otherwise("Unknown").alias("name"),
        checksum(F.col("source"), F.col("position")).alias("checksum"),
        fields.alias("md"),
    )


class ResultDocs(NamedTuple):
    """Hits `recid, count, merged`; list fields as rows `recid, field, arrival, ord, disp, min, max, num`; members as rows
    `recid, arrival, id, name, checksum, md`. Nothing is gathered, so a hit may have any number of members."""

    hits: DataFrame
    values: DataFrame
    members: DataFrame


def to_result_docs(
    clusters: DataFrame, records: DataFrame, catalog: Catalog, sources: DataFrame | None = None, brief: bool = True
) -> ResultDocs:
    """Everything that is shown of the hits `clusters`, made of `records`: merged values of all policies, and the fields of
    every member."""
    wanted = clusters.select("cluster", "recid")
    hits = project(clusters, catalog, brief).select("recid", F.col("members").alias("count"), "merged")
    lists = [n for n in shown_fields(catalog, brief) if catalog[n].merge in ("unique", "all")]
    values = merge_values(records, catalog, lists).join(wanted, "cluster").drop("cluster") if lists else None
    if values is None:
        schema = "recid string, field string, arrival string, ord int, disp string, min int, max int, num double"
        values = clusters.sparkSession.createDataFrame([], schema)
    members = locations(records, sources, catalog, brief).join(wanted, "cluster").drop("cluster")
    return ResultDocs(hits, values, members)


def get_record(
    clusters: DataFrame,
    records: DataFrame,
    recid: str,
    offset: int | None = None,
    checksum_: int | None = None,
    keys: DataFrame | None = None,
) -> DataFrame:
    """Members of one cluster in order of arrival; one of them by its offset or by its checksum.

    With an index `keys` (`cluster, key`, see `key_index`), `recid` may be any key of the cluster, also one that the cluster
    took over when others were joined to it.
    """
    one = clusters.filter(F.col("recid") == recid).select("cluster")
    if keys is not None:
        one = one.union(keys.filter(F.col("key") == recid).select("cluster"))
    members = records.join(one, "cluster", "left_semi").withColumn(
        "checksum", checksum(F.col("source"), F.col("position"))
    )
    if checksum_ is not None:
        return members.filter(F.col("checksum") == checksum_).orderBy("arrival").limit(1)
    if offset is not None:
        return members.orderBy("arrival").offset(offset).limit(1)
    return members.orderBy("arrival")


def to_snippet_docs(
    clusters: DataFrame,
    title: str = "title",
    url: Column | None = None,
    snippet: tuple[str, ...] = ("description", "title-responsibility"),
    values: DataFrame | None = None,
) -> DataFrame:
    """Documents for result clustering: `id, title, url, snippet`; the snippet is descriptions and responsibility.

    Fields whose merged values are lists come out of `values` (rows of `merge_values`), all of them in their order. Such a snippet is
    as long as the values of its cluster, so give the hits that are shown.
    """
    have = clusters.schema["merged"].dataType.names
    listed = [n for n in snippet if n not in have] if values is not None else []
    if listed:
        text = F.struct("field", "arrival", "ord", "disp")
        of = values.filter(F.col("field").isin(listed) & filled(F.col("disp"))).join(clusters.select("cluster"), "cluster", "left_semi")
        lists = of.groupBy("cluster").agg(F.sort_array(F.collect_list(text)).alias("listed"))
        clusters = clusters.join(lists, "cluster", "left")

    def part(name: str) -> Column:
        if name in have:
            return F.col(f"merged.`{name}`")
        return F.nullif(F.array_join(F.transform(F.filter("listed", lambda v: v["field"] == name), lambda v: v["disp"]), " "), F.lit(""))

    parts = [part(n) for n in snippet if n in have or n in listed]
    link = url if url is not None else (F.col("merged.url") if "url" in have else F.lit(None).cast("string"))
    return clusters.select(
        F.col("recid").alias("id"),
        F.col(f"merged.`{title}`").alias("title"),
        link.alias("url"),
        F.concat_ws(" ", *parts).alias("snippet"),
    )


def convert_corpus(
    spark: SparkSession,
    source_path: str,
    target_path: str,
    normalizer: Callable[[DataFrame], DataFrame],
    format: str = "parquet",
) -> DataFrame:
    """Raw files to normalized documents: every file is a payload, the log counts documents and failures per file.

    The documents are written once, partitioned by outcome; the log reads what was written.
    """
    files = spark.read.text(source_path, wholetext=True, recursiveFileLookup=True).select(
        F.input_file_name().alias("file"), F.col("value").alias("payload")
    )
    done = normalizer(files).withColumn("failed", F.col("failure").isNotNull())
    done.drop("payload").write.partitionBy("failed").format(format).save(target_path)
    written = spark.read.format(format).load(target_path)
    return written.groupBy("file").agg(
        F.count_if(~F.col("failed")).alias("documents"), F.count_if(F.col("failed")).alias("failures")
    )

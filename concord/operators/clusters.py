"""Merge keys, clusters and exact duplicates."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from concord.catalog import Catalog, FieldSpec
from concord.functions.chains import TextChain
from concord.operators.records import filled, md, raw_texts, shown
from concord.session import cut, stored, tidy

CONTENT = "content: "


def _field_key(name: str, texts: Column, chain: TextChain) -> Column:
    """`name token token` for every text, joined by spaces."""
    return F.array_join(F.transform(chain.joined_all(texts), lambda j: F.rtrim(F.concat(F.lit(f"{name} "), j))), " ")


def _key_fields(catalog: Catalog, keys: Sequence[str] | None) -> list[FieldSpec]:
    if keys:
        return [catalog[k] if k in catalog else FieldSpec(k) for k in keys]
    return [f for f in catalog if f.mergekey != "no"]


def _content(parts: dict[FieldSpec, Column], keys: Sequence[str] | None, supplied: Column | None) -> Column:
    """Key text out of the parts of the fields; empty or null when there is none."""
    content = F.array_join(F.filter(F.array(*parts.values()), filled), " ") if parts else F.lit("")
    if not keys:
        for f, part in parts.items():
            if f.mergekey == "required":
                content = F.when(part != "", content)
        if supplied is not None:
            content = F.coalesce(supplied, content)
    return content


def _key_or_alone(content: Column, source: Column, position: Column) -> Column:
    alone = F.format_string("position: %s-%06d", source, position.cast("bigint"))
    return F.when(content != "", F.concat(F.lit(CONTENT), content)).otherwise(alone)


def with_merge_key(
    records: DataFrame, catalog: Catalog, keys: Sequence[str] | None = None, supplied: str | None = None
) -> DataFrame:
    """Add the merge key as `cluster`; records with the same key are one cluster.

    In order: the fields named at query time (`keys`), the key the record brings along (column `supplied`), the required
    and optional fields of the catalog. A missing required field discards the key. A record without key stands alone.
    """
    chain = catalog.chain("mergekey")
    fields = _key_fields(catalog, keys)
    # every part is a column of its own, so that it is computed once
    parts = {f"key_{i}": _field_key(f.name, raw_texts(f), chain) for i, f in enumerate(fields)}
    if supplied:
        parts["key_s"] = F.when(filled(F.col(supplied)), chain.joined(F.col(supplied)))
    named = {f: F.col(f"key_{i}") for i, f in enumerate(fields)}
    content = _content(named, keys, F.col("key_s") if supplied else None)
    with_content = records.withColumns(parts).withColumn("key_c", content)
    key = _key_or_alone(F.col("key_c"), F.col("source"), F.col("position"))
    return with_content.withColumn("cluster", key).drop("key_c", *parts)


def explode_subrecords(payloads: DataFrame, catalog: Catalog, keys: Sequence[str] | None = None) -> DataFrame:
    """One row per sub-record; all sub-records of a payload carry the distinct merge keys of the payload.

    Payloads without sub-records, such as broken ones, give no row. `payloads` has `source, position, arrival, subrecords array<struct<key, values>>`.
    """

    chain = catalog.chain("mergekey")
    fields = _key_fields(catalog, keys)

    # step by step over all sub-records, so that every part is computed once
    def parts(sub: Column) -> Column:
        texts = lambda n: F.filter(sub["values"], lambda v: (v["field"] == n) & filled(v["value"]))["value"]
        supplied = F.when(filled(sub["key"]), chain.joined(sub["key"]))
        return F.struct(supplied.alias("s"), *[_field_key(f.name, texts(f.name), chain).alias(f"f{i}") for i, f in enumerate(fields)])

    def content(part: Column) -> Column:
        return _content({f: part[f"f{i}"] for i, f in enumerate(fields)}, keys, part["s"])

    def key(text: Column) -> Column:
        return _key_or_alone(text, F.col("source"), F.col("position"))

    found = F.transform(F.transform(F.transform("subrecords", parts), content), key)
    with_keys = payloads.withColumn("keys", F.array_distinct(found))
    return with_keys.select(
        "source", "position", "arrival", "keys", F.posexplode_outer("subrecords").alias("sub", "record")
    ).filter("record IS NOT NULL").select(
        "source",
        "position",
        F.struct("arrival", "sub").alias("arrival"),
        "keys",
        F.col("record.values").alias("values"),
    )


# -- records with several keys ---------------------------------------------------------------------------------------


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    linked = moved.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Connected components of the links `u, v`: `node, component` for every node that is linked to another one, named by
    its least node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): every round is a group-by with map-side minimum
    and an equi-join, and the number of rounds grows with the logarithm of the longest chain.
    """
    edges = cut(edges.filter("u <> v").select("u", "v").distinct())

    def digest(links: DataFrame):
        with tidy(links.sparkSession):
            return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = digest(edges)
    for _ in range(max_rounds):
        edges = cut(_small_star(_large_star(edges)))
        after = digest(edges)
        if after == before:
            roots = edges.select(F.col("v").alias("node")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                roots.select("node", F.col("node").alias("component"))
            )
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def key_components(keys: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Connected components of merge keys: `key, cluster` for every key that is linked to another one.

    Takes a frame with an array column `keys`. Only records with several keys take part.
    """
    links = keys.filter(F.size("keys") > 1).select(F.array_min("keys").alias("v"), F.explode("keys").alias("u"))
    return components(links, max_rounds).toDF("key", "cluster")


def assign_clusters(records: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Add `cluster` to records with an array of merge `keys`: records that share a key, directly or by way of other
    records, are one cluster. `links` are rows with every list of `keys` that the records have, if there are fewer of them.

    The components are stored, so that it is known before the join whether they are few.
    """
    components = stored(key_components(records if links is None else links), "components")
    first = records.withColumn("key", F.get("keys", F.lit(0)))
    return first.join(components, "key", "left").withColumn("cluster", F.coalesce("cluster", "key")).drop("key")


def key_index(records: DataFrame) -> DataFrame:
    """`cluster, key` for every merge key that a cluster has, each once: what results are found by.

    Records have `cluster` and, if they can have several keys, `keys`. A pair is made distinct inside the tasks first and then by
    cluster and key together, so that the keys of one cluster are spread over tasks.
    """
    if "keys" not in records.columns:
        return records.select("cluster", F.col("cluster").alias("key")).distinct()
    pairs = records.select("cluster", F.explode_outer("keys").alias("key"))
    return pairs.filter("key IS NOT NULL").distinct()


# -- exact duplicates ------------------------------------------------------------------------------------------------


def _equal_part(spec: FieldSpec) -> Column:
    """What two records must share in a field to be the same record."""
    if spec.type == "generic":
        return F.transform(md(spec.name), shown)
    if spec.type == "float":
        return md(spec.name, "num")
    return F.transform(md(spec.name), lambda v: F.struct(v["min"], v["max"]))


def fingerprint(records: DataFrame, catalog: Catalog) -> DataFrame:
    """Records with `print_1, print_2`: 128 bits of cluster, source and all typed values."""
    same = []
    for f in catalog:
        # the size tells [a, b] and [] from [a] and [b]
        same += [F.size(md(f.name)), _equal_part(f)]
    parts = {f"same_{i}": part for i, part in enumerate(same)}
    columns = ["cluster", "source", *parts]
    prints = {"print_1": F.xxhash64(*columns), "print_2": F.xxhash64(F.lit(1), *columns)}
    return records.withColumns(parts).withColumns(prints).drop(*parts)


def drop_exact_duplicates(records: DataFrame, catalog: Catalog) -> DataFrame:
    """Keep the first of the records that share cluster, source and all typed values.

    Records are compared by a fingerprint of those. `row_number() = 1` is pushed below the shuffle as a group limit, so copies
    of one record do not travel.
    """
    marked = fingerprint(records, catalog)
    order = W.partitionBy("print_1", "print_2").orderBy("arrival")
    return (
        marked.withColumn("copy", F.row_number().over(order)).filter("copy = 1").drop("copy", "print_1", "print_2")
    )

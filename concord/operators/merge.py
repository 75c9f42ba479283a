"""Merged fields of a cluster, one policy per field, and its sort keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from concord.catalog import Catalog, FieldSpec
from concord.functions.text import skip_article, trim_generic
from concord.operators.records import real_values, unfold

SINGLE = ("longest", "range", "first")
PARTS = (("disp", "string"), ("min", "int"), ("max", "int"), ("num", "double"))


def _parts(spec: FieldSpec) -> tuple[str, ...]:
    return ("disp",) if spec.type == "generic" else ("num",) if spec.type == "float" else ("min", "max")


def _norm_disp(spec: FieldSpec, catalog: Catalog, value: Column) -> tuple[Column, Column]:
    """Normal and display form a text has in the cluster."""
    if spec.icurule:
        chain = catalog.chain(spec.icurule)
        return chain.joined(value), chain.display(value)
    return trim_generic(value), trim_generic(value)


def longest_entry(spec: FieldSpec, catalog: Catalog) -> Column:
    """`size, arrival, ord, disp` of the value of a record that is before its others; null without values."""

    def entry(v: Column, i: Column) -> Column:
        norm, disp = _norm_disp(spec, catalog, v["value"])
        return F.struct((-F.octet_length(norm)).alias("size"), F.col("arrival"), i.alias("ord"), disp.alias("disp"))

    return F.array_min(F.transform(real_values(spec), entry))


def _longest(spec: FieldSpec, catalog: Catalog) -> Column:
    return F.min(longest_entry(spec, catalog))


def range_ends(spec: FieldSpec) -> tuple[Column, Column]:
    """Both ends of the values of a record."""
    low, high = ("num", "num") if spec.type == "float" else ("min", "max")
    values = real_values(spec)
    return F.array_min(F.transform(values, lambda v: v[low])), F.array_max(F.transform(values, lambda v: v[high]))


def _range(spec: FieldSpec) -> list[tuple[str, Column]]:
    low, high = range_ends(spec)
    return [("min", F.min(low)), ("max", F.max(high))]


def _plain(spec: FieldSpec, catalog: Catalog, v: Column) -> Column:
    none = {n: F.lit(None).cast(t) for n, t in PARTS}
    if spec.type == "generic":
        none["disp"] = _norm_disp(spec, catalog, v["value"])[1]
    for n in _parts(spec):
        if n != "disp":
            none[n] = v[n]
    return F.struct(*[none[n].alias(n) for n, _ in PARTS])


def first_values(spec: FieldSpec, catalog: Catalog) -> Column:
    """All values of a record in the form that a merge keeps."""
    return F.transform(real_values(spec), lambda v: _plain(spec, catalog, v))


def _first(spec: FieldSpec, catalog: Catalog) -> Column:
    values = first_values(spec, catalog)
    return F.min(F.when(F.size(values) > 0, F.struct(F.col("arrival"), values.alias("values"))))


def merge_records(records: DataFrame, catalog: Catalog, extra: list[Column] = ()) -> DataFrame:
    """One row per cluster from one aggregation with map-side combine.

    `cluster, recid, members, first_arrival, first_position, merged struct, sort struct` plus the `extra` aggregates.
    `merged` has the fields that give one value per cluster (`longest`, `range`) or the values of one record (`first`);
    lists that grow with the cluster are rows of `merge_values`.
    """
    aggregates: list[Column] = [
        F.count(F.lit(1)).alias("members"),
        F.min("arrival").alias("first_arrival"),
    ]
    if "position" in records.columns:
        aggregates.append(F.min("position").alias("first_position"))
    if "keys" in records.columns:
        aggregates.append(F.min(F.struct(F.col("arrival"), F.col("keys")[0].alias("key")))["key"].alias("recid"))
    for n, f in enumerate(single_fields(catalog)):
        if f.merge == "longest":
            aggregates.append(_longest(f, catalog).alias(f"m{n}"))
        elif f.merge == "range":
            aggregates += [column.alias(f"m{n}_{end}") for end, column in _range(f)]
        else:
            aggregates.append(_first(f, catalog).alias(f"m{n}"))
    grouped = records.groupBy(F.xxhash64("cluster").alias("cluster_hash"), "cluster").agg(*aggregates, *extra)
    if "keys" not in records.columns:
        grouped = grouped.withColumn("recid", F.col("cluster"))
    return shaped(grouped, catalog).drop("cluster_hash")


def single_fields(catalog: Catalog) -> list[FieldSpec]:
    """Fields that have one merged value per cluster."""
    return [f for f in catalog if f.merge in SINGLE]


def shaped(grouped: DataFrame, catalog: Catalog) -> DataFrame:
    """The structs `merged` and `sort` in place of the columns `m0, m1, ...` of an aggregation of clusters."""
    merged, sort = [], []
    for n, f in enumerate(single_fields(catalog)):
        if f.merge == "longest":
            disp = F.col(f"m{n}.disp")
            merged.append(disp.alias(f.name))
            if f.sortkey != "no":
                body = skip_article(disp) if f.sortkey == "skiparticle" else disp
                sort.append(F.coalesce(catalog.chain("sort").sort(body), disp).alias(f.name))
        elif f.merge == "range":
            pair = F.when(
                F.col(f"m{n}_min").isNotNull(),
                F.struct(F.col(f"m{n}_min").alias("min"), F.col(f"m{n}_max").alias("max")),
            )
            merged.append(pair.alias(f.name))
            if f.sortkey != "no":
                sort.append(pair.alias(f.name))
        else:
            merged.append(F.col(f"m{n}.values").alias(f.name))
    internal = [c for c in grouped.columns if c[0] == "m" and c[1:2].isdigit()]
    return (
        grouped.withColumn("merged", F.struct(*merged) if merged else F.lit(None))
        .withColumn("sort", F.struct(*sort) if sort else F.lit(None))
        .drop(*internal)
    )


def _units(spec: FieldSpec, catalog: Catalog) -> Column:
    """What a record gives to the merge of a field: `field, pick, size, ord, list`.

    Units with the same `pick` compete: one per normal form for unique, all of a field for the other policies. The
    smallest (size, arrival, ord) wins; its `list` becomes the merged values.
    """
    generic = spec.type == "generic"

    def unit(pick: Column, size: Column, ord_: Column, values: Column) -> Column:
        return F.struct(
            F.lit(spec.name).alias("field"), pick.alias("pick"), size.alias("size"), ord_.alias("ord"), values.alias("list")
        )

    def one(v: Column, i: Column) -> Column:
        norm = _norm_disp(spec, catalog, v["value"])[0] if generic else F.lit("")
        pick = norm if spec.merge == "unique" else F.lit("")
        size = -F.octet_length(norm) if spec.merge == "longest" else F.lit(0)
        return unit(pick, size, i, F.array(_plain(spec, catalog, v)))

    if spec.merge == "first":
        values = F.transform(real_values(spec), lambda v: _plain(spec, catalog, v))
        return F.filter(F.array(unit(F.lit(""), F.lit(0), F.lit(0), values)), lambda u: F.size(u["list"]) > 0)
    return F.transform(real_values(spec), one)


def merge_values(records: DataFrame, catalog: Catalog, fields: list[str] | None = None) -> DataFrame:
    """Merged values as rows `cluster, field, arrival, ord, disp, min, max, num`; (arrival, ord) is their order.

    All policies in one aggregation with map-side combine. A list of values is never gathered, so a cluster may have any
    number of them. A float range has its low end in `num`; both ends are in `merge_records`.
    """
    chosen = [f for f in catalog if f.merge != "no" and (fields is None or f.name in fields)]
    out = ["cluster", "field", "arrival", "ord", "disp", "min", "max", "num"]
    frames = []
    picked = [f for f in chosen if f.merge != "all"]
    if picked:
        units = unfold(records, ["cluster", "arrival"], F.concat(*[_units(f, catalog) for f in picked]), "field")
        one = lambda n: F.get(F.col("list"), F.lit(0))[n]
        best = units.groupBy("cluster", "field", "pick").agg(
            F.min(F.struct("size", "arrival", "ord", "list")).alias("b"),
            F.min(one("min")).alias("low"),
            F.max(one("max")).alias("high"),
            F.min(one("num")).alias("num_low"),
        )
        rows = best.select("cluster", "field", "low", "high", "num_low", "b.arrival", "b.ord", F.posexplode("b.list").alias("n", "v"))
        ranges = F.col("field").isin([f.name for f in picked if f.merge == "range"])
        frames.append(
            rows.select(
                "cluster",
                "field",
                "arrival",
                (F.col("ord") + F.col("n")).alias("ord"),
                "v.disp",
                F.when(ranges, F.col("low")).otherwise(F.col("v.min")).alias("min"),
                F.when(ranges, F.col("high")).otherwise(F.col("v.max")).alias("max"),
                F.when(ranges, F.col("num_low")).otherwise(F.col("v.num")).alias("num"),
            )
        )
    for f in chosen:
        if f.merge == "all":
            values = F.transform(real_values(f), lambda v: _plain(f, catalog, v))
            rows = records.select("cluster", F.lit(f.name).alias("field"), "arrival", F.posexplode_outer(values).alias("ord", "v"))
            frames.append(rows.filter("ord IS NOT NULL").select("cluster", "field", "arrival", "ord", "v.*"))
    return reduce(lambda a, b: a.unionByName(b), [f.select(*out) for f in frames])


def result_counts(clusters: DataFrame, status: DataFrame, num: int = 20) -> DataFrame:
    """Clusters, hits of all sources and pages of `num` clusters."""
    merged = clusters.agg(F.count(F.lit(1)).alias("merged"), F.coalesce(F.sum("members"), F.lit(0)).alias("records"))
    total = status.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("total")).scalar()
    return merged.select("merged", "records", total.alias("total"), F.ceil(F.col("merged") / num).alias("pages"))

"""Records: from dynamic values to typed fields of the catalog.

Frames used by all operators:

raw      `source, position, arrival, key, values array<struct<field, value, attrs map>>`
records  `source, position, arrival, md struct<one array per catalog field>`

`arrival` is any orderable column that is unique over all records. A value of `md` is a struct `value, attrs`, with
`min, max` (year, date) or `num` (float) behind it. Numbers that come from a table have no text in `value`.
"""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from concord.catalog import Catalog, FieldSpec
from concord.functions.text import trim_generic
from concord.functions.values import dates, to_float, years

ATTRS = "map<string,string>"
RAW_VALUE = f"struct<value:string,attrs:{ATTRS}>"
TYPED_VALUE = {
    "generic": RAW_VALUE,
    "year": f"struct<value:string,attrs:{ATTRS},min:int,max:int>",
    "date": f"struct<value:string,attrs:{ATTRS},min:int,max:int>",
    "float": f"struct<value:string,attrs:{ATTRS},num:double>",
}


def md(name: str, part: str | None = None) -> Column:
    """Values of a field; `part` gives one member of every value as an array."""
    path = f"md.`{name}`"
    return F.col(f"{path}.`{part}`" if part else path)


def filled(text: Column) -> Column:
    # null is not filled: callers use it in conditions only
    return text != ""


def real(spec: FieldSpec, v: Column) -> Column:
    """A value of its own, not the placeholder of an empty one."""
    return filled(v["value"]) if spec.type == "generic" else filled(v["value"]) | v["attrs"].isNull()


def real_values(spec: FieldSpec) -> Column:
    return F.filter(md(spec.name), lambda v: real(spec, v))


def text_of(spec: FieldSpec, v: Column) -> Column:
    """The text a value came with."""
    if spec.type == "generic":
        return v["value"]
    return F.coalesce(v["value"], v["num" if spec.type == "float" else "min"].cast("string"))


def shown(v: Column) -> Column:
    """Display form of a generic value or of its placeholder."""
    return trim_generic(F.when(filled(v["value"]), v["value"]).otherwise(v["attrs"]["empty"]))


def raw_texts(spec: FieldSpec) -> Column:
    """The non-empty texts of a field, placeholders left out."""
    if spec.type == "generic":
        return F.filter(md(spec.name, "value"), filled)
    return F.transform(real_values(spec), lambda v: text_of(spec, v))


def unfold(df: DataFrame, keep: Sequence[str], structs: Column, required: str) -> DataFrame:
    """One row per struct of an array, its members as columns; `required` is a member that is never null.

    The outer form with a filter behind it: for a plain `inline` the optimizer puts a test of the array below it, and the
    expressions of the array would run twice.
    """
    return df.select(*keep, F.inline_outer(structs)).filter(F.col(required).isNotNull())


# -- conform and type ------------------------------------------------------------------------------------------------


def conform(raw: DataFrame, catalog: Catalog) -> DataFrame:
    """Keep catalog fields only. An empty value stays only if it has an `empty` placeholder."""

    def of(name: str) -> Column:
        kept = F.filter(
            "values", lambda v: (v["field"] == name) & (filled(v["value"]) | F.map_contains_key(v["attrs"], "empty"))
        )
        return F.transform(kept, lambda v: F.struct(v["value"].alias("value"), v["attrs"].alias("attrs")))

    fields = F.struct(*[F.coalesce(of(n), F.array().cast(f"array<{RAW_VALUE}>")).alias(n) for n in catalog.names])
    return raw.withColumn("md", fields).drop("values")


def unknown_fields(raw: DataFrame, catalog: Catalog) -> DataFrame:
    """How many values had a field name that the catalog does not know."""
    names = raw.select(F.explode_outer("values.field").alias("field"))
    return names.filter(~F.col("field").isin(catalog.names)).groupBy("field").agg(F.count(F.lit(1)).alias("ignored"))


def _typed(spec: FieldSpec, v: Column) -> Column:
    """Typed struct of one value, null when it does not parse."""
    if spec.type == "generic":
        return v
    text = F.when(filled(v["value"]), v["value"]).otherwise(v["attrs"]["empty"])
    head = [v["value"].alias("value"), v["attrs"].alias("attrs")]
    if spec.type == "float":
        return F.struct(*head, to_float(text).alias("num"))
    found = years(text) if spec.type == "year" else dates(text)
    return F.when(found.isNotNull(), F.struct(*head, found["min"].alias("min"), found["max"].alias("max")))


def type_values(records: DataFrame, catalog: Catalog) -> DataFrame:
    """Typed values of every field; values that do not parse are dropped."""

    def of(spec: FieldSpec) -> Column:
        if spec.type == "generic":
            return md(spec.name)
        return F.filter(F.transform(md(spec.name), lambda v: _typed(spec, v)), lambda v: v.isNotNull())

    return records.withColumn("md", F.struct(*[of(s).alias(s.name) for s in catalog]))


def table_records(
    table: DataFrame,
    catalog: Catalog,
    columns: Mapping[str, str | list[str]],
    source: str,
    arrival: str,
    position: str | None = None,
) -> DataFrame:
    """Records straight from a table.

    `columns` maps a field to an SQL expression, or to a list of them that each give one value. Integer expressions are
    taken as years or dates, numbers as floats, as they are; everything else is text.
    """
    given = {f.name: columns.get(f.name, []) for f in catalog}
    given = {n: [e] if isinstance(e, str) else list(e) for n, e in given.items()}
    flat = [e for es in given.values() for e in es]
    kinds = {e: kind for e, (_, kind) in zip(flat, table.selectExpr(*[f"({e}) AS c{i}" for i, e in enumerate(flat)]).dtypes)}
    bare = f"'value', CAST(NULL AS STRING), 'attrs', CAST(NULL AS {ATTRS})"

    def one(spec: FieldSpec, e: str) -> tuple[str, str]:
        """Condition and struct of one value."""
        kind = kinds[e]
        if spec.type in ("year", "date") and kind in ("int", "bigint", "smallint"):
            return f"({e}) IS NOT NULL", f"named_struct({bare}, 'min', int({e}), 'max', int({e}))"
        if spec.type == "float" and kind in ("double", "float", "int", "bigint"):
            return f"({e}) IS NOT NULL", f"named_struct({bare}, 'num', double({e}))"
        return f"string({e}) <> ''", f"named_struct('value', string({e}), 'attrs', CAST(NULL AS {ATTRS}))"

    def of(spec: FieldSpec) -> str:
        parts = [one(spec, e) for e in given[spec.name]]
        if not parts:
            return f"CAST(array() AS array<{TYPED_VALUE[spec.type]}>)"
        if len(parts) == 1:
            return f"CASE WHEN {parts[0][0]} THEN array({parts[0][1]}) ELSE array() END"
        return "array_compact(array(" + ", ".join(f"CASE WHEN {c} THEN {v} END" for c, v in parts) + "))"

    fields = ", ".join(f"{of(f)} AS `{f.name}`" for f in catalog)
    head = [f"{source} AS source", f"{arrival} AS arrival"] + ([f"bigint({position}) AS position"] if position else [])
    records = table.selectExpr(*head, f"struct({fields}) AS md")
    numbers = ("int", "bigint", "smallint", "double", "float")
    if any(kinds[e] not in numbers for f in catalog if f.numeric for e in given[f.name]):
        return type_values(records, catalog)
    return records


def explode_values(records: DataFrame, catalog: Catalog, fields: list[str], keep: list[str]) -> DataFrame:
    """One row per value of `fields`, placeholders left out: `keep..., field, ord, value, min, max, num`."""

    def wide(spec: FieldSpec) -> Column:
        have = () if spec.type == "generic" else ("num",) if spec.type == "float" else ("min", "max")
        part = lambda v, n, t: (v[n] if n in have else F.lit(None).cast(t)).alias(n)
        return F.transform(
            real_values(spec),
            lambda v, i: F.struct(
                F.lit(spec.name).alias("field"),
                i.alias("ord"),
                text_of(spec, v).alias("value"),
                part(v, "min", "int"),
                part(v, "max", "int"),
                part(v, "num", "double"),
            ),
        )

    arrays = [wide(catalog[f]) for f in fields]
    return unfold(records, keep, F.concat(*arrays), "field")


# -- constants of a source -------------------------------------------------------------------------------------------

def add_source_values(raw: DataFrame, sources: DataFrame, catalog: Catalog) -> DataFrame:
    """Append the per-source constants of the `postproc` fields to the values of every record.

    `sources` is `source, settings map<string,string>`, one row per source.
    """
    names = [f.name for f in catalog if f.setting == "postproc"]
    constants = [
        F.when(
            F.col("settings")[n].isNotNull(),
            F.array(
                F.struct(
                    F.lit(n).alias("field"),
                    F.col("settings")[n].alias("value"),
                    F.create_map().cast(ATTRS).alias("attrs"),
                )
            ),
        ).otherwise(F.array().cast(f"array<struct<field:string,value:string,attrs:{ATTRS}>>"))
        for n in names
    ]
    joined = raw.join(sources.select("source", "settings"), "source", "left")
    return joined.withColumn("values", F.concat("values", *constants)).drop("settings")


def with_source_params(raw: DataFrame, sources: DataFrame, catalog: Catalog) -> DataFrame:
    """Give the normalizer the constants of the `parameter` fields as a map column `params`."""
    names = [f.name for f in catalog if f.setting == "parameter"]
    joined = raw.join(sources.select("source", "settings"), "source", "left")
    params = F.map_filter("settings", lambda k, v: k.isin(names) & v.isNotNull())
    return joined.withColumn("params", params).drop("settings")


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All sources as one frame."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

"""Filters over sources, records and clusters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from concord.catalog import Catalog, FieldSpec
from concord.functions.chains import LETTERS, clean_words
from concord.functions.proximity import Near, near as is_near
from concord.functions.text import word_pattern
from concord.functions.values import leading_int
from concord.operators.records import filled, md

Limits = Mapping[str, Sequence[str]]


def _any(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def _all(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


# -- sources ---------------------------------------------------------------------------------------------------------


def source_match(source: Column, pattern: str) -> Column:
    """Wildcard match of a source id: `*`, `*/db` (the part behind the first slash), `prefix*`, or the id itself."""
    if pattern == "*":
        return F.lit(True)
    if pattern.startswith("*/"):
        slash = F.instr(source, "/")
        return (slash > 0) & (F.substr(source, slash + 1) == pattern[2:])
    if pattern.endswith("*"):
        return F.startswith(source, F.lit(pattern[:-1]))
    return source == pattern


def filter_sources(
    sources: DataFrame, criteria: Sequence[tuple[str, str, Sequence[str]]] = (), any_of: bool = False
) -> DataFrame:
    """Sources that are allowed, have a name and meet the criteria (setting, `=` or `~`, values).

    Values are alternatives. Criteria must all hold, or one of them with `any_of`. A setting that is not there does not
    match. `sources` is `source, settings map<string,string>`.
    """

    def one(name: str, op: str, values: Sequence[str]) -> Column:
        value = F.col("source") if name == "pz:id" else F.col("settings")[name]
        if op == "~":
            hit = _any([F.contains(value, F.lit(v)) for v in values])
        elif name == "pz:id":
            hit = _any([source_match(value, v) for v in values])
        else:
            hit = value.isin(list(values))
        return F.coalesce(hit, F.lit(False))

    gate = ~F.coalesce(F.startswith(F.col("settings")["pz:allow"], F.lit("0")), F.lit(False))
    gate = gate & F.col("settings")["pz:name"].isNotNull()
    met = [one(*c) for c in criteria]
    return sources.filter(gate & ((_any(met) if any_of else _all(met)) if met else F.lit(True)))


# -- records ---------------------------------------------------------------------------------------------------------


def record_filter(raw: DataFrame, sources: DataFrame, setting: str = "pz:recordfilter") -> DataFrame:
    """Per-source filter on dynamic values: `field`, `field=value` (equal) or `field~value` (part of it).

    An equal sign anywhere decides for equality. Works on frames with `values`; a source without filter keeps all.
    """
    rules = sources.select("source", F.col("settings")[setting].alias("rule"))
    rules = rules.filter(filled(F.col("rule")))
    op = F.when(F.contains("rule", F.lit("=")), "=").when(F.contains("rule", F.lit("~")), "~")
    at = F.when(op == "=", F.instr("rule", "=")).otherwise(F.instr("rule", "~"))
    rules = rules.select(
        "source",
        op.alias("op"),
        F.when(op.isNull(), F.col("rule")).otherwise(F.substr("rule", F.lit(1), at - 1)).alias("field"),
        F.when(op.isNotNull(), F.substr("rule", at + 1)).alias("wanted"),
    )

    def hit(v: Column) -> Column:
        text = v["value"]
        same = F.when(F.col("op").isNull(), True).when(F.col("op") == "=", text == F.col("wanted"))
        return (v["field"] == F.col("field")) & filled(text) & same.otherwise(F.contains(text, F.col("wanted")))

    joined = raw.join(rules, "source", "left")
    return joined.filter(F.col("field").isNull() | F.exists("values", hit)).drop("op", "field", "wanted")


def _value_limit(
    spec: FieldSpec, catalog: Catalog, values: Column, wanted: Sequence[str], text: str = "value"
) -> Column:
    """Does any value of a field meet one of the wanted values?"""
    if spec.type in ("year", "date"):
        numbers = [_leading(w) for w in wanted]
        return F.exists(values, lambda v: _any([F.lit(n).between(v["min"], v["max"]) for n in numbers]))
    if spec.type == "float":
        return F.exists(values, lambda v: v["num"].isin([float(w) for w in wanted]))
    chain = catalog.chain("mergekey")
    forms = [chain.joined(F.lit(w)) for w in wanted]
    return F.exists(values, lambda v: chain.joined(v[text]).isin(forms))


def _leading(text: str) -> int:
    import re

    found = re.match(r"\s*([+-]?\d+)", text)
    return int(found.group(1)) if found else 0


def limit_condition(catalog: Catalog, limits: Limits) -> Column:
    """Condition of `limit_records`: values of a field are alternatives, fields must all match, `*` is any field."""

    def one(name: str, wanted: Sequence[str]) -> Column:
        if name == "*":
            fields = [f for f in catalog if f.type != "float" or all(_is_number(w) for w in wanted)]
            return _any([_value_limit(f, catalog, md(f.name), wanted) for f in fields])
        if name not in catalog:
            return F.lit(False)
        return _value_limit(catalog[name], catalog, md(name), wanted)

    return _all([F.coalesce(one(n, w), F.lit(False)) for n, w in limits.items()])


def _is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


@dataclass(frozen=True)
class SourceColumn:
    """The table column that a field is made of, and how: `plain` (the field is the column itself) or `year` (of a date or timestamp)."""

    name: str
    made: str = "plain"

    def __post_init__(self) -> None:
        if self.made not in ("plain", "year"):
            raise ValueError(f"no inverse for {self.made!r}")


def table_condition(catalog: Catalog, limits: Limits, sources: Mapping[str, SourceColumn]) -> Column | None:
    """What the limits mean for the columns of the table that records are made of, or None if they mean nothing there.

    Years become ranges of dates, numbers a list of values: both reach the reader, which leaves out files, row groups and
    partitions by them. Rows that it lets through are still to be limited as records: text, fields without a source and `*` have no
    such condition. A null in the column meets no limit, and neither does a record without the value.
    """
    conditions = []
    for field, wanted in limits.items():
        source = sources.get(field)
        if source is None or field not in catalog:
            continue
        column, spec = F.col(source.name), catalog[field]
        if source.made == "year" and spec.type in ("year", "date"):
            days = [(F.make_date(F.lit(y), F.lit(1), F.lit(1)), F.make_date(F.lit(y + 1), F.lit(1), F.lit(1))) for y in {_leading(w) for w in wanted} if 0 < y < 9999]
            conditions.append(_any([(column >= low) & (column < high) for low, high in days]))
        elif source.made == "plain" and spec.type == "float" and all(_is_number(w) for w in wanted):
            conditions.append(column.isin([float(w) for w in wanted]))
        elif source.made == "plain" and spec.type in ("year", "date"):
            conditions.append(column.isin([_leading(w) for w in wanted]))
    return _all(conditions) if conditions else None


def limit_records(records: DataFrame, catalog: Catalog, limits: Limits, mark: bool = False) -> DataFrame:
    """Records within the limits. With `mark` all records stay and `filtered` tells which ones the limits remove."""
    condition = limit_condition(catalog, limits)
    return records.withColumn("filtered", ~condition) if mark else records.filter(condition)


def limit_clusters(clusters: DataFrame, catalog: Catalog, limits: Limits, merged_values: DataFrame | None = None) -> DataFrame:
    """Clusters whose merged values meet the limits of the fields that have a `limitcluster`.

    Fields with one merged value are tested in place; for lists (`unique`, `all`) give `merged_values`.
    """
    kept = clusters
    for name, wanted in limits.items():
        if name not in catalog or not catalog[name].limitcluster:
            continue
        spec = catalog[catalog[name].limitcluster]
        if spec.merge == "longest":
            chain = catalog.chain("mergekey")
            value = F.col(f"merged.`{spec.name}`")
            kept = kept.filter(F.coalesce(chain.joined(value).isin([chain.joined(F.lit(w)) for w in wanted]), F.lit(False)))
        elif spec.merge == "range":
            value = F.col(f"merged.`{spec.name}`")
            numbers = [_leading(w) if spec.type != "float" else float(w) for w in wanted]
            kept = kept.filter(_any([F.lit(n).between(value["min"], value["max"]) for n in numbers]))
        elif spec.merge == "first":
            kept = kept.filter(_value_limit(spec, catalog, F.col(f"merged.`{spec.name}`"), wanted, "disp"))
        else:
            if merged_values is None:
                raise ValueError(f"limit on {spec.name}: merged_values is needed for merge={spec.merge}")
            one = F.array(F.struct("disp", "min", "max", "num"))
            hits = merged_values.filter((F.col("field") == spec.name) & _value_limit(spec, catalog, one, wanted, "disp"))
            kept = kept.join(hits.select("cluster").distinct(), "cluster", "left_semi")
    return kept


def resolve_limit_ids(sources: DataFrame, limits: Limits, ids: DataFrame) -> DataFrame:
    """Limit values as each source knows them: `source, facet, value, id`.

    `ids` is the lookup `source, facet, term, id`. A source that has ids for a facet but none for a wanted value gives
    nothing at all, so it is left out. A source without ids for the facet keeps the value.
    """
    wanted = [(facet, value) for facet, values in limits.items() for value in values]
    asked = sources.select("source").withColumn(
        "want", F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.lit(v).alias("value")) for f, v in wanted]))
    ).select("source", "want.facet", "want.value")
    known = ids.select("source", "facet").distinct().withColumn("has_ids", F.lit(True))
    found = asked.join(known, ["source", "facet"], "left").join(
        ids.select("source", "facet", F.col("term").alias("value"), "id"), ["source", "facet", "value"], "left"
    )
    failed = found.filter("has_ids and id is null").select("source").distinct()
    return found.join(failed, "source", "left_anti").select(
        "source", "facet", "value", F.coalesce("id", "value").alias("id")
    )


def slice_sources(records: DataFrame, start: int = 0, maxrecs: int = 100, sources: DataFrame | None = None) -> DataFrame:
    """Window of the result of every source: skip `start`, take `maxrecs`; a source may have its own `pz:maxrecs`.

    The position in the source is a column, so this is a filter, not a window function.
    """
    if sources is None:
        return records.filter(F.col("position").between(start + 1, start + maxrecs))
    stated = F.col("settings")["pz:maxrecs"]
    own = sources.select("source", F.when(filled(stated), leading_int(stated)).alias("own")).filter("own >= 0")
    limit = F.coalesce("own", F.lit(maxrecs))
    joined = records.join(own, "source", "left")
    return joined.filter((F.col("position") > start) & (F.col("position") <= start + limit)).drop("own")


# -- terms -----------------------------------------------------------------------------------------------------------


def match(
    catalog: Catalog,
    all_: Sequence[str] = (),
    any_: Sequence[str] = (),
    none_: Sequence[str] = (),
    phrase: str | None = None,
    field: str | Sequence[str] | None = None,
    prefix: str | None = None,
    suffix: str | None = None,
    between: tuple[int | None, int | None] | None = None,
    near: Near | Sequence[Near] = (),
) -> Column:
    """Term predicate over the fields of a record, to be used in `filter`.

    `all_`, `any_` and `none_` take words, `phrase` words side by side in one value, `near` words within a distance in
    one value, `prefix` and `suffix` a cut-off word, `between` the bounds of a year or date (null is open). `field`
    restricts it to some fields.
    """
    names = [field] if isinstance(field, str) else list(field) if field else [f.name for f in catalog if f.type == "generic"]
    chain = catalog.chain("relevance")

    def anywhere(test) -> Column:
        return _any([F.exists(md(n, "value"), lambda v: F.coalesce(test(v), F.lit(False))) for n in names if catalog[n].type == "generic"])

    def word(w: str) -> Column:
        if chain is LETTERS:
            return anywhere(lambda v: v.rlike(word_pattern([w])) if w.isascii() and w.isalpha() else F.lit(False))
        return anywhere(lambda v: F.array_contains(chain.tokens(v), w))

    conditions = [word(w) for w in all_]
    if any_:
        conditions.append(_any([word(w) for w in any_]))
    conditions += [~word(w) for w in none_]
    if phrase:
        # the joined form has one space between words, so a phrase is a part of it on word borders
        padded = lambda v: F.concat(F.lit(" "), chain.joined(v), F.lit(" "))
        conditions.append(anywhere(lambda v: F.contains(padded(v), F.concat(F.lit(" "), chain.joined(F.lit(phrase)), F.lit(" ")))))
    for asked in [near] if isinstance(near, Near) else near:
        cleaned = Near(tuple(t for w in asked.words for t in clean_words(w, chain)), asked.distance, asked.ordered)
        # texts without one of the words needn't be taken apart
        conditions += [word(w) for w in dict.fromkeys(cleaned.words)]
        conditions.append(anywhere(lambda v, c=cleaned: is_near(chain.tokens(v), c)))
    if prefix:
        conditions.append(anywhere(lambda v: F.exists(chain.tokens(v), lambda t: F.startswith(t, F.lit(prefix.lower())))))
    if suffix:
        conditions.append(anywhere(lambda v: F.exists(chain.tokens(v), lambda t: F.endswith(t, F.lit(suffix.lower())))))
    if between:
        low, high = between
        numbers = [n for n in names if catalog[n].type in ("year", "date")]
        inside = lambda v: _all(
            ([v["max"] >= low] if low is not None else []) + ([v["min"] <= high] if high is not None else [])
        )
        conditions.append(_any([F.exists(md(n), inside) for n in numbers]))
    return _all(conditions)

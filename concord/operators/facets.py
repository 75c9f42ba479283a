"""Facet counts over the values of records."""

from __future__ import annotations

from typing import Collection, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from concord.catalog import Catalog
from concord.functions.chains import WHOLE
from concord.operators.records import explode_values, filled


def term_factor(hits: Column, maxrecs: Column) -> Column:
    """How many hits one fetched record stands for: max(hits, maxrecs) div max(1, maxrecs)."""
    return F.call_function("div", F.greatest(hits, maxrecs).cast("bigint"), F.greatest(F.lit(1), maxrecs).cast("bigint"))


def facet_values(records: DataFrame, catalog: Catalog, keep: Sequence[str] = ("source", "arrival")) -> DataFrame:
    """One row per counted term: `keep..., facet, ord, term`.

    A year counts for its high end and, if different, for its low end. Other fields count with the text as it came, or
    with the display form of the chain in `icurule`.
    """
    fields = [f for f in catalog if f.termlist]
    values = explode_values(records, catalog, [f.name for f in fields], list(keep))
    years = [f.name for f in fields if f.type == "year"]
    ends = F.array_distinct(F.array(F.col("max").cast("string"), F.col("min").cast("string")))
    text = F.col("value")
    for f in fields:
        if f.icurule:
            text = F.when(F.col("field") == f.name, catalog.chain(f.icurule).display(F.col("value"))).otherwise(text)
    terms = F.when(F.col("field").isin(years), ends).otherwise(F.array(text)) if years else F.array(text)
    return values.select(*keep, F.col("field").alias("facet"), "ord", F.explode_outer(terms).alias("term"))


def _forms(terms: DataFrame, catalog: Catalog) -> DataFrame:
    """Add `norm` and `display` by the facet chain of the field."""
    default = catalog.chain("facet")
    norm, display = default.joined(F.col("term")), default.display(F.col("term"))
    for f in catalog:
        if f.facetrule:
            chain = catalog.chain(f.facetrule)
            mine = F.col("facet") == f.name
            norm = F.when(mine, chain.joined(F.col("term"))).otherwise(norm)
            display = F.when(mine, chain.display(F.col("term"))).otherwise(display)
    formed = terms.withColumn("norm", norm).withColumn("display", display)
    return formed.filter(filled(F.col("norm")))


def split_ids(terms: DataFrame, split: Collection[str]) -> DataFrame:
    """Take `id:term` of the `split` facets apart: `id`, null elsewhere, and the bare term."""
    colon = F.instr("term", ":")
    here = F.col("facet").isin(list(split)) & (colon > 0)
    return terms.withColumn("id", F.when(here, F.expr("substring(term, 1, instr(term, ':') - 1)"))).withColumn(
        "term", F.when(here, F.expr("substring(term, instr(term, ':') + 1)")).otherwise(F.col("term"))
    )


def facet_ids(reported: DataFrame, catalog: Catalog, split: Collection[str]) -> DataFrame:
    """Lookup `source, facet, term, id` of the ids that came with split facets; the last one reported wins."""
    found = _forms(split_ids(reported, split), catalog).filter("id is not null")
    return found.groupBy("source", "facet", F.col("display").alias("term")).agg(F.max_by("id", "arrival").alias("id"))


def facets(
    records: DataFrame,
    catalog: Catalog,
    weights: DataFrame | None = None,
    reported: DataFrame | None = None,
    split: Collection[str] = (),
) -> DataFrame:
    """Facet counts: `facet, norm, display, frequency`.

    Counts every value of every record that was kept, not of every cluster. `weights` (`source, factor`) scales the
    counts of a source. `reported` (`source, facet, term, arrival, frequency`) are counts a source gave itself: they
    replace the counted ones of that source and facet. Both sum up, the first display form stays.
    """
    counted = facet_values(records, catalog).withColumn("frequency", F.lit(1).cast("long"))
    if weights is not None:
        scaled = counted.join(weights.select("source", "factor"), "source", "left")
        counted = scaled.withColumn("frequency", F.coalesce(F.col("factor"), F.lit(1)).cast("long"))
    # reported counts come with the answer of a source, before its records
    at = [F.col("arrival"), F.col("ord")]
    if reported is not None:
        own = reported.select("source", "facet").distinct()
        counted = counted.join(own, ["source", "facet"], "left_anti")
        bare = split_ids(reported, split) if split else reported
        seen = F.struct(*at)
        kind = counted.select(seen.alias("seen")).schema["seen"].dataType
        place = lambda turn, told, seen: F.struct(
            F.lit(turn).alias("turn"), told.cast("string").alias("told"), seen.cast(kind).alias("seen")
        ).alias("at")
        first = bare.select(
            "facet", "term", F.col("frequency").cast("long").alias("frequency"), place(0, F.col("arrival"), F.lit(None))
        )
        then = counted.select("facet", "term", "frequency", place(1, F.lit(None), seen))
        every = first.unionByName(then)
    else:
        every = counted.select("facet", "term", "frequency", F.struct(*at).alias("at"))
    formed = _forms(every, catalog)
    if catalog.chain("facet") is WHOLE and not any(f.facetrule for f in catalog):
        # the display form is the term itself: a plain sum is enough
        total = formed.groupBy("facet", "norm").agg(F.sum("frequency").alias("frequency"))
        return total.select("facet", "norm", F.col("norm").alias("display"), "frequency")
    total = formed.groupBy("facet", "norm").agg(
        F.sum("frequency").alias("frequency"), F.min(F.struct("at", "display"))["display"].alias("display")
    )
    shown = F.when(F.col("display") != "", F.col("display")).otherwise(F.col("norm"))
    return total.select("facet", "norm", shown.alias("display"), "frequency")


def top_facets(counts: DataFrame, num: int = 15, names: Sequence[str] | None = None) -> DataFrame:
    """The `num` most frequent terms of every facet with their rank; ties by display form.

    With `names`, a facet without terms still gives one row with nulls. The rank filter is pushed below the shuffle.
    """
    w = W.partitionBy("facet").orderBy(F.col("frequency").desc(), F.col("display").asc(), F.col("norm").asc())
    wanted = counts if names is None or "*" in names else counts.filter(F.col("facet").isin(list(names)))
    top = wanted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= num)
    top = top.filter(filled(F.col("display"))).select("facet", "rank", "display", "frequency")
    if names is None or "*" in names:
        return top
    asked = counts.sparkSession.createDataFrame([(n,) for n in names], "facet string")
    return asked.join(top, "facet", "left")


def source_facet(status: DataFrame, num: int = 15, approximate: bool = False) -> DataFrame:
    """Sources by hits (or by approximation): the first `num`, as long as they have hits.

    `status` is the frame of `status_by_source`. The list ends at the first source without hits.
    """
    key = "approximation" if approximate else "hits"
    top = status.orderBy(F.col(key).desc(), F.col("source").asc()).limit(num)
    w = W.orderBy(F.col(key).desc(), F.col("source").asc())
    open_ = F.min(F.when(F.col("hits") > 0, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))
    named = F.when(filled(F.col("name")), F.col("name")).otherwise("Unknown")
    return top.withColumn("open", open_).filter("open = 1").select(
        F.col("source").alias("id"),
        named.alias("name"),
        F.col("hits").alias("frequency"),
        "approximation",
        "records",
        "filtered",
        "state",
        "diagnostic",
    )

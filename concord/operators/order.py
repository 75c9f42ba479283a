"""Sort orders, pages, row numbers and neighbours."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from concord.catalog import Catalog
from concord.session import stored

SortSpec = Sequence[tuple[str, bool]]


def sort_columns(catalog: Catalog, spec: SortSpec | None = None) -> list[Column]:
    """Sort expressions of a list of (field, ascending); ties always by recid.

    Text: missing is empty. Year and date: ascending by the low end, descending by the high end, missing last both ways.
    Float: missing is smallest. Position: smallest member position, always ascending.
    """
    columns: list[Column] = []
    for name, ascending in spec or catalog.default_sort:
        if name == "relevance":
            columns.append(F.col("relevance").asc() if ascending else F.col("relevance").desc())
        elif name == "position":
            columns.append(F.col("first_position").asc())
        elif name == "retrieval":
            columns.append(F.col("first_arrival").asc() if ascending else F.col("first_arrival").desc())
        elif name not in catalog or catalog[name].sortkey == "no":
            raise ValueError(f"no sort key for {name!r} in the catalog")
        elif catalog[name].type in ("year", "date"):
            key = F.col(f"sort.`{name}`")
            columns.append(key["min"].asc_nulls_last() if ascending else key["max"].desc_nulls_last())
        elif catalog[name].type == "float":
            key = F.col(f"sort.`{name}`")
            columns.append(key["min"].asc_nulls_first() if ascending else key["max"].desc_nulls_last())
        else:
            key = F.coalesce(F.col(f"sort.`{name}`"), F.lit(""))
            columns.append(key.asc() if ascending else key.desc())
    return [*columns, F.col("recid").asc()]


def sort_clusters(
    clusters: DataFrame, catalog: Catalog, spec: SortSpec | None = None, native_order: bool = False
) -> DataFrame:
    """Sorted clusters. `native_order`: keep the order of the only active source, if it sorted natively."""
    return clusters.orderBy(*sort_columns(catalog, [("position", True)] if native_order else spec))


def keeps_native_order(status: DataFrame) -> bool:
    """True when exactly one source is active and it sorts natively; `status` has `active, native_sort`."""
    row = status.filter("active").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("native_sort").cast("int")).alias("s")).first()
    return row["n"] == 1 and row["s"] == 1


def page(
    clusters: DataFrame, catalog: Catalog, spec: SortSpec | None = None, start: int = 0, num: int = 20, native_order: bool = False
) -> DataFrame:
    """Rows start .. start + num - 1 of the sorted clusters; none when the start lies past the end.

    The first page is a top-k. A later one is cut out of the numbered rows, so that the rows before it don't travel.
    """
    spec = [("position", True)] if native_order else spec
    order = sort_columns(catalog, spec)
    if start == 0:
        return clusters.orderBy(*order).limit(num)
    numbered = number_rows(clusters, order, "number_")
    return numbered.filter(F.col("number_").between(start + 1, start + num)).orderBy("number_").drop("number_")


# -- numbers along an order ------------------------------------------------------------------------------------------


def number_rows(df: DataFrame, order: Sequence[Column], name: str, by: Sequence[str] = ()) -> DataFrame:
    """Row numbers from 1 along `order`, per `by` or over all rows.

    Rows are dealt by ranges of (by, order), sorted within each range and stored; a row number is the place of a row in its
    range plus the rows of its group in the ranges before, one row per range and group. So no group and no equal key is
    in one task, as long as `order` tells rows apart; rows that it doesn't are numbered in any order.
    """
    keys = [*[F.col(b) for b in by], *order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the upper bits are the range, the lower 33 the place in it
    placed = stored(dealt.withColumn("place_", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("range_", F.shiftright("place_", 33))
    sizes = placed.groupBy("range_", *by).agg(F.count(F.lit(1)).alias("size_"), F.min("place_").alias("least_"))
    before = W.partitionBy(*by).orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("range_", *by, (F.coalesce(F.sum("size_").over(before), F.lit(0)) - F.col("least_") + 1).alias("offset_"))
    renamed = offsets.withColumnsRenamed({n: f"{n}_g" for n in ("range_", *by)})
    same = [F.col(n).eqNullSafe(F.col(f"{n}_g")) for n in ("range_", *by)]
    return placed.join(renamed, reduce(lambda a, b: a & b, same)).select(
        *df.columns, (F.col("place_") + F.col("offset_")).alias(name)
    )


def neighbours(df: DataFrame, order: Sequence[Column], name: str = "recid") -> DataFrame:
    """Previous and next `name` of every row along `order`, by the row numbers."""
    numbered = number_rows(df, order, "number_")
    near = lambda step, to: numbered.select((F.col("number_") + step).alias("number_"), F.col(name).alias(to))
    joined = numbered.join(near(1, "prev"), "number_", "left").join(near(-1, "next"), "number_", "left")
    return joined.select(*df.columns, "prev", "next")

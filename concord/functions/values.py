"""Scalar functions over years, dates, numbers and record identity, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _digit_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))


def years(text: Column) -> Column:
    """struct(min, max) over digit runs of exactly four digits; null when there is none."""
    runs = F.filter(_digit_runs(text), lambda d: F.length(d) == 4)
    found = F.transform(runs, lambda d: d.cast("int"))
    return F.when(F.size(found) > 0, F.struct(F.array_min(found).alias("min"), F.array_max(found).alias("max")))


def dates(text: Column) -> Column:
    """struct(min, max) over digit runs of four to eight digits; four digits count as year * 10000."""
    runs = F.filter(_digit_runs(text), lambda d: F.length(d).between(4, 8))
    found = F.transform(runs, lambda d: d.cast("int") * F.when(F.length(d) == 4, 10000).otherwise(1))
    return F.when(F.size(found) > 0, F.struct(F.array_min(found).alias("min"), F.array_max(found).alias("max")))


def to_float(text: Column) -> Column:
    """Number at the start of the text, 0 when there is none."""
    number = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.when(number == "", F.lit(0.0)).otherwise(number.try_cast("double"))


def leading_int(text: Column) -> Column:
    """Integer at the start of the text, 0 when there is none."""
    number = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
    return F.coalesce(number.try_cast("int"), F.lit(0))


def print_range(low: Column, high: Column) -> Column:
    return F.when(low == high, low.cast("string")).otherwise(F.concat_ws("-", low.cast("string"), high.cast("string")))


def print_float(number: Column) -> Column:
    return F.format_string("%.6f", number)


def checksum(source: Column, position: Column) -> Column:
    """Member checksum modulo 2^32: start with the position, then h * 65509 + byte over the source id."""
    digits = F.hex(source)
    # an empty id has no byte to add
    steps = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2)))
    byte = lambda at: F.conv(F.substr(digits, at, F.lit(2)), 16, 10).cast("long")
    start = F.pmod(position.cast("long"), F.lit(1 << 32))
    fold = F.aggregate(steps, start, lambda h, at: F.pmod(h * 65509 + byte(at), F.lit(1 << 32)))
    return F.coalesce(fold, start)

"""Settings of sources: who wins when several settings apply."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from concord.catalog import Catalog

EXACT, PREFIX, ANY = 2, 1, 0
OVERRIDE = 2**31 - 1


def _pattern(target: str = "target") -> list:
    """How a target is looked up: kind of key, key, and how specific it is."""
    t = F.col(target)
    kind = (
        F.when(t == "*", "prefix").when(t.startswith("*/"), "db").when(t.endswith("*"), "prefix").otherwise("exact")
    )
    key = (
        F.when(t == "*", "")
        .when(t.startswith("*/"), F.substr(t, F.lit(3)))
        .when(t.endswith("*"), F.substr(t, F.lit(1), F.length(t) - 1))
        .otherwise(t)
    )
    specific = F.when(t.startswith("*"), ANY).when(t.endswith("*"), PREFIX).otherwise(EXACT)
    return [kind.alias("kind"), key.alias("key"), specific.alias("specific")]


def winning_settings(
    settings: DataFrame,
    sources: DataFrame | None = None,
    catalog: Catalog | None = None,
    overrides: DataFrame | None = None,
) -> DataFrame:
    """`source, name, value`: the setting in force for every source and name.

    `settings` is `target, name, value, precedence, ord`. A target matches by `*`, `*/db`, `prefix*` or exactly; an exact
    target makes a source. Higher precedence wins, then the more specific target, then the later row. A `limitmap` of the
    catalog is a default that ranks like an exact target that came first. `overrides` (`source, name, value, ord`) win.

    Every source lists the keys under which a target can name it (its prefixes, its part behind the slash, itself), so
    the wildcard match is an equi-join.
    """
    rows = settings.select(
        "target", "name", "value", F.coalesce(F.col("precedence"), F.lit(0)).alias("precedence"), F.col("ord")
    )
    # one row per target and name before it meets the sources
    kind = rows.schema["ord"].dataType
    rank = F.struct("precedence", "ord", "value")
    rows = rows.groupBy("target", "name").agg(F.max(rank).alias("r")).select("target", "name", "r.*")
    found = rows.filter(~F.endswith("target", F.lit("*")) & ~F.startswith("target", F.lit("*")) & (F.col("target") != ""))
    every = found.select(F.col("target").alias("source"))
    if sources is not None:
        every = every.union(sources.select("source"))
    if overrides is not None:
        every = every.union(overrides.select("source"))
    every = every.distinct()
    prefix = lambda n: F.struct(F.lit("prefix").alias("kind"), F.substr("source", F.lit(1), n).alias("key"))
    slash = F.instr("source", "/")
    keys = F.concat(
        F.transform(F.sequence(F.lit(0), F.length("source")), prefix),
        F.array(F.struct(F.lit("exact").alias("kind"), F.col("source").alias("key"))),
        F.when(slash > 0, F.array(F.struct(F.lit("db").alias("kind"), F.substr("source", slash + 1).alias("key")))).otherwise(
            F.array().cast("array<struct<kind:string,key:string>>")
        ),
    )
    reach = every.select("source", F.inline(keys))
    patterns = rows.select(*_pattern(), "name", "value", "precedence", "ord")
    applied = reach.join(patterns, ["kind", "key"]).select("source", "name", "value", "precedence", "specific", "ord")
    defaults = [(f"pz:limitmap:{f.name}", f.limitmap) for f in (catalog or ()) if f.limitmap]
    if defaults:
        # null comes before every other row
        pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in defaults])
        applied = applied.union(
            every.select("source", F.inline(pairs)).select(
                "source", "name", "value", F.lit(0), F.lit(EXACT), F.lit(None).cast(kind)
            )
        )
    if overrides is not None:
        applied = applied.union(
            overrides.select("source", "name", "value", F.lit(OVERRIDE), F.lit(EXACT), F.col("ord").cast(kind))
        )
    winner = F.max(F.struct("precedence", "specific", "ord", "value"))["value"]
    return applied.groupBy("source", "name").agg(winner.alias("value"))


def resolve_settings(
    settings: DataFrame,
    sources: DataFrame | None = None,
    catalog: Catalog | None = None,
    overrides: DataFrame | None = None,
) -> DataFrame:
    """`source, settings map<string,string>` with the settings in force; a map holds the names of one source."""
    won = winning_settings(settings, sources, catalog, overrides)
    return won.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("settings"))


def setting_family(settings: str, family: str):
    """Members of a name family such as `pz:limitmap:` as a map without the prefix."""
    return F.transform_keys(
        F.map_filter(settings, lambda k, _: F.startswith(k, F.lit(family))), lambda k, _: F.substr(k, F.lit(len(family) + 1))
    )

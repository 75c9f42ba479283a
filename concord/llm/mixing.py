"""Mixing sources to target weights: iterative proportional fitting over source, language and topic, then sampling.

Tokens are summed per cell (source, language, topic). The fit scales cells in turn to the targets of each marginal until
all three hold. It never wants more tokens than a cell has: what a full cell can't give goes to the others, and targets that
the tokens can't meet are told. A document is taken with the probability by which the fitted tokens of its cell stand to its
tokens, drawn by a hash of its id.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from concord.session import stored

DIMENSIONS = ("source", "lang", "topic")
_CELL = tuple(f"cell_{d}" for d in DIMENSIONS)
_ADDED = ("topic", "n_tokens", "rate", "taken", "settled", *_CELL, "cell_rate")
#: Rounds of the fit at most, the relative distance from a marginal at which it ends before, and that at which it counts as settled.
ROUNDS, EXACT, TOLERANCE = 40, 1e-11, 1e-6
#: Stands for a missing source or language.
NONE = "(none)"
SEED = "mix-1"

# topics by the first pattern that a text has; RE2 and Java read them alike
TOPICS = (
    ("legal", r"(Licensed|licensed|Released) under"),
    ("table", r" \| "),
    ("contact", r"[a-z0-9.]+@[a-z0-9]+\.[a-z]+|\([0-9]{3}\) [0-9]{3}"),
)
OTHER = "prose"


class Targets(NamedTuple):
    """Share of a value among all tokens: its own share to the power given, so that 1 leaves and 0 levels a marginal.
    `budget` is the size of the mix as a share of all tokens."""

    source: float = 0.5
    lang: float = 0.7
    topic: float = 0.8
    budget: float = 0.5


def topic_of(text: Column, topics: Sequence[tuple[str, str]] = TOPICS) -> Column:
    found = F.lit(OTHER)
    for name, pattern in reversed(topics):
        found = F.when(text.rlike(pattern), name).otherwise(found)
    return found


def described(docs: DataFrame, topics: Sequence[tuple[str, str]] = TOPICS) -> DataFrame:
    """`docs` with cell columns `cell_source, cell_lang, cell_topic` and `n_tokens`, words of the whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns(
        {
            "cell_source": F.coalesce(F.col("source").cast("string"), F.lit(NONE)),
            "cell_lang": F.coalesce(F.col("lang").cast("string"), F.lit(NONE)),
            "cell_topic": topic_of(text, topics),
            "n_tokens": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint"),
        }
    )


def _targets(cells: DataFrame, targets: Targets) -> DataFrame:
    """`cells` with tokens, and with `target_d` and `wanted_d` of every dimension d: the target by share; and the target where the
    value has as many tokens, all it has otherwise, with what is then missing dealt over the rest by the same shares.

    Values that have too little are those with the least tokens for their target. In that order it is known for each value
    by how much the targets from it on would be raised, and the first that has more than its raised target ends the search.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    budget = F.lit(total * targets.budget)
    every = [
        cells.select(F.lit(d).alias("dimension"), F.col(f"cell_{d}").alias("value"), "tokens", F.lit(getattr(targets, d)).alias("power"))
        for d in DIMENSIONS
    ]
    values = every[0].unionByName(every[1]).unionByName(every[2]).groupBy("dimension", "value", "power")
    values = values.agg(F.sum("tokens").cast("double").alias("own")).withColumn("share", F.pow("own", "power"))
    whole = W.partitionBy("dimension")
    values = values.withColumn("target", F.col("share") / F.sum("share").over(whole) * budget)
    order = whole.orderBy(F.col("own") / F.col("target"), "value")
    values = values.withColumns(
        {
            "poorer": F.coalesce(F.sum("own").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
            "rest": F.sum("target").over(order.rowsBetween(0, W.unboundedFollowing)),
        }
    ).withColumn("raised", (budget - F.col("poorer")) / F.col("rest"))
    enough = F.col("own") > F.col("target") * F.col("raised")
    scale = F.min(F.when(enough, F.struct(F.col("own") / F.col("target"), "value", "raised"))).over(whole)["raised"]
    wanted = F.coalesce(F.least("own", F.col("target") * F.col("scale")), F.col("own"))
    values = stored(values.withColumn("scale", scale).withColumn("wanted", wanted).select("dimension", "value", "target", "wanted"), "targets")
    for d in DIMENSIONS:
        own = values.filter(F.col("dimension") == d)
        own = own.select(F.col("value").alias(f"cell_{d}"), F.col("target").alias(f"target_{d}"), F.col("wanted").alias(f"wanted_{d}"))
        cells = cells.join(own, f"cell_{d}")
    return cells


def _rounds(cells: DataFrame, scaled, rounds: int, tolerance: float) -> DataFrame:
    """Rounds over all dimensions until every marginal is within `tolerance` before it is scaled, `rounds` at most.

    `scaled(d, window)` gives the factor of a cell and the relative distance of its marginal. The targets are columns of the
    cells and a marginal is a sum over a window, so a round has an exchange per dimension and no join. Rounds are
    written two at a time, and so the plan doesn't grow with them.
    """
    for _ in range(0, rounds, 2):
        for _ in range(2):
            for d in DIMENSIONS:
                factor, off = scaled(d, W.partitionBy(f"cell_{d}"))
                cells = cells.withColumns({"factor": factor, f"off_{d}": off})
                cells = cells.withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
        cells = stored(cells, "cells")
        worst = cells.agg(F.max(F.greatest(*[f"off_{d}" for d in DIMENSIONS]))).first()[0]
        if worst is None or worst < tolerance:
            break
    return cells.drop(*[f"off_{d}" for d in DIMENSIONS])


def bounded_fit(
    cells: DataFrame, targets: Targets, rounds: int = ROUNDS, tolerance: float = TOLERANCE
) -> tuple[DataFrame, DataFrame]:
    """`cells` (`cell_source, cell_lang, cell_topic, tokens`) with `fitted`, tokens of a cell in the mix and at most its own, and
    `settled`; and the marginals (`dimension, value, own, target, wanted, held`) of those fitted tokens.

    A cell has a weight, of which its tokens are the bound. Every value of a dimension scales the weights of its cells so
    that the full ones and the others together hold what is wanted. Full cells keep their weight and come down again when
    others rise. `settled` says that all marginals hold what is wanted; where `wanted` is below `target`, the value has no
    more tokens. Values that need each other's tokens may leave no mix at all that holds; the marginals tell how far it is off.
    """
    cells = _targets(cells.filter("tokens > 0"), targets).withColumn("weight", F.col("tokens") * F.lit(targets.budget))
    fitted = F.least(F.col("weight"), F.col("tokens").cast("double"))
    full = F.col("weight") >= F.col("tokens")

    def scaled(d: str, w: W) -> tuple[Column, Column]:
        wanted, held = F.col(f"wanted_{d}"), F.sum(fitted).over(w)
        taken = F.sum(F.when(full, F.col("tokens")).otherwise(0)).over(w)
        free = F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).over(w)
        left = (wanted - taken) / F.when(free > 0, free)
        # with the full cells above what is wanted they come down, and full cells that are wanted whole stay
        factor = F.when(left > 0, left).otherwise(F.least(F.lit(1.0), wanted / held))
        return factor, F.abs(held / wanted - 1)

    cells = stored(_rounds(cells, scaled, rounds, EXACT).withColumn("fitted", fitted), "fitted")
    sides = [
        cells.select(
            F.lit(d).alias("dimension"), F.col(f"cell_{d}").alias("value"), "tokens", "fitted",
            F.col(f"target_{d}").alias("target"), F.col(f"wanted_{d}").alias("wanted"),
        )
        for d in DIMENSIONS
    ]
    marginals = sides[0].unionByName(sides[1]).unionByName(sides[2]).groupBy("dimension", "value").agg(
        F.sum("tokens").cast("double").alias("own"), F.first("target").alias("target"), F.first("wanted").alias("wanted"),
        F.sum("fitted").alias("held"),
    )
    marginals = stored(marginals, "marginals")
    worst = marginals.agg(F.max(F.abs(F.col("held") / F.col("wanted") - 1))).first()[0]
    settled = F.lit(worst is None or worst < tolerance)
    return cells.withColumn("settled", settled).select(*_CELL, "tokens", "fitted", "settled"), marginals


def _uniform(key: Column) -> Column:
    """A number in [0, 1) from the digest of a key."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def mix(docs: DataFrame, targets: Targets = Targets(), topics: Sequence[tuple[str, str]] = TOPICS) -> DataFrame:
    """`docs` (`doc_id, text, lang, source` and more) with `topic, n_tokens, rate, taken, settled` for every row.

    `rate` is the share of its cell's tokens that the fit wants, which is the probability of a document; at 1 all of the cell are
    taken. `settled` says whether the fit holds its marginals. Texts without words weigh nothing and get rate 0. A missing source or
    language is a value of its own. Rows with equal doc_id draw the same number; a null doc_id draws that of the empty key.
    Columns of these names in `docs` are replaced; an empty table gives an empty result.
    """
    columns = [c for c in docs.columns if c not in _ADDED]
    return sampled(described(docs.select(*columns), topics), targets).select(*columns, *_ADDED[:5])


def sampled(rows: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """`rows`, which are `described`, with the other columns of `mix`. They are read twice, so store them if describing is dear."""
    cells = stored(rows.groupBy(*_CELL).agg(F.sum("n_tokens").alias("tokens")), "cells")
    fitted = bounded_fit(cells, targets)[0].select(*_CELL, (F.col("fitted") / F.col("tokens")).alias("cell_rate"), "settled")
    met = rows.join(stored(fitted, "rates"), [*_CELL], "left")
    rate = F.when(F.col("n_tokens") > 0, F.coalesce("cell_rate", F.lit(0.0))).otherwise(0.0)
    drawn = _uniform(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"/{SEED}")))
    met = met.withColumn("rate", F.round(rate, 9))
    return met.withColumns({"topic": F.col("cell_topic"), "taken": drawn < F.col("rate")})


def sql(targets: Targets = Targets(), rounds: int = 20) -> str:
    """The rates and the draw over the view `documents`, with a fixed number of rounds that is more than enough."""
    case = " ".join(f"WHEN regexp_matches(t, '{pattern}') THEN '{name}'" for name, pattern in TOPICS)
    parts = [
        rf"""
d AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, CASE {case} ELSE '{OTHER}' END AS topic,
    CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
g AS MATERIALIZED (
  SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS w FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
b AS (SELECT sum(w) * {targets.budget}::DOUBLE AS budget FROM g)"""
    ]
    for x in DIMENSIONS:
        power = getattr(targets, x)
        parts.append(f"""
v_{x} AS MATERIALIZED (
  SELECT {x}, own, budget, p / sum(p) OVER () * budget AS target
  FROM (SELECT {x}, sum(w) AS own, pow(sum(w), {power}) AS p FROM g GROUP BY {x}), b),
t_{x} AS MATERIALIZED (
  SELECT {x}, coalesce(least(own, target * (
    SELECT min_by(raised, own / target) FROM (
      SELECT own, target, (budget - coalesce(sum(own) OVER (ORDER BY own / target, {x} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(target) OVER (ORDER BY own / target, {x} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS raised FROM v_{x})
    WHERE own > target * raised)), own) AS wanted FROM v_{x})""")
    parts.append(f"""
c0 AS MATERIALIZED (
  SELECT g.*, w * {targets.budget}::DOUBLE AS f, t_source.wanted AS w_source, t_lang.wanted AS w_lang, t_topic.wanted AS w_topic
  FROM g JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic))""")
    n = 0
    for _ in range(rounds):
        for x in DIMENSIONS:
            parts.append(f"""
c{n + 1} AS MATERIALIZED (
  SELECT * EXCLUDE (held, taken, free) REPLACE (f * CASE WHEN free > 0 AND w_{x} > taken THEN (w_{x} - taken) / free
    ELSE least(1, w_{x} / held) END AS f)
  FROM (SELECT *, sum(least(f, w)) OVER (PARTITION BY {x}) AS held, sum(CASE WHEN f >= w THEN w ELSE 0 END) OVER (PARTITION BY {x}) AS taken,
    sum(CASE WHEN f >= w THEN 0 ELSE f END) OVER (PARTITION BY {x}) AS free FROM c{n}))""")
            n += 1
    return f"""
WITH {",".join(parts)},
r AS (
  SELECT d.*, CASE WHEN n_tokens > 0 THEN round(coalesce(least(f, w) / w, 0), 9) ELSE 0.0 END AS rate
  FROM d LEFT JOIN c{n} USING (source, lang, topic))
SELECT doc_id, source, lang, topic, n_tokens, round(rate, 6) AS rate,
  CAST('0x' || substr(md5(concat(doc_id, '/{SEED}')), 1, 8) AS BIGINT) / 4294967296.0 < rate AS taken
FROM r"""

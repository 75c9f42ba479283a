"""Scores that sources give themselves, brought to one scale."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from concord.catalog import Catalog
from concord.operators.records import md

ENOUGH = 100.0
STEP_CHANGE = 0.5


def native_scores(
    records: DataFrame, sources: DataFrame, catalog: Catalog, clusters: DataFrame | None = None
) -> DataFrame:
    """Score of every record of a source with `pz:native_score`: `cluster, source, position, arrival, mode, score`.

    `position` gives 1 / position, `internal` the relevance of the cluster (`clusters` is needed for it), any other word
    is a float field of the catalog. Sources without the setting take no part.
    """
    mode = F.col("settings")["pz:native_score"]
    modes = sources.select("source", mode.alias("mode")).filter(F.coalesce("mode", F.lit("")) != "")
    score = F.when(F.col("mode") == "position", 1.0 / F.col("position"))
    for f in catalog:
        if f.type == "float":
            score = score.when(F.col("mode") == f.name, F.get(md(f.name), F.lit(0))["num"])
    narrow = records.join(modes, "source").select("cluster", "source", "position", "arrival", "mode", score.alias("score"))
    if clusters is not None:
        relevance = clusters.select("cluster", F.col("relevance").cast("double").alias("internal"))
        narrow = narrow.join(relevance, "cluster", "left").withColumn(
            "score", F.when(F.col("mode") == "internal", F.col("internal")).otherwise(F.col("score"))
        ).drop("internal")
    return narrow.filter("score is not null")


def _moments(scores: DataFrame) -> DataFrame:
    """What the fit needs to know of a source: counts, means, centred sums. Two numbers per source come out of it."""
    target = 1.0 / F.col("position")
    n = F.count(F.lit(1))
    return scores.groupBy("source", "mode").agg(
        n.alias("n"),
        F.avg("score").alias("s"),
        F.avg(target).alias("t"),
        (F.var_pop("score") * n).alias("ss"),
        (F.var_pop(target) * n).alias("tt"),
        (F.covar_pop("score", target) * n).alias("st"),
        F.min("score").alias("low"),
        F.max("score").alias("high"),
    )


def _search(m: pd.DataFrame, max_rounds: int) -> tuple[np.ndarray, ...]:
    """Fit a s + b to 1 / position by coordinate steps, for all rows at once.

    The squared error is a quadratic in a and b, so the moments of a source stand for all its records. Also says which
    searches came to their end within `max_rounds`.
    """
    n, s, t, ss, tt, st = (m[c].to_numpy(float) for c in ("n", "s", "t", "ss", "tt", "st"))
    low, high = m["low"].to_numpy(float), m["high"].to_numpy(float)
    error = lambda a, b: n * (t - b - a * s) ** 2 + tt - 2 * a * st + a * a * ss
    span = np.where(high - low < 1e-6, high, high - low)
    usable = span != 0
    span = np.where(usable, span, 1.0)
    a, b = 1.0 / span, -low / span
    step_a, step_b = a / 10, np.abs(b) / 10
    best = error(a, b)
    going = usable.copy()
    for _ in range(max_rounds):
        if not going.any():
            break
        tries = np.stack([error(a + step_a, b), error(a - step_a, b), error(a, b + step_b), error(a, b - step_b)])
        order = np.sort(tries, axis=0)
        move = np.argmin(tries, axis=0)
        # a move must beat the error so far and every other move
        better = going & (order[0] < best) & (order[0] < order[1])
        change_a = np.abs(0.5 * (tries[0] + tries[1]) - best) > np.abs(0.5 * (tries[2] + tries[3]) - best)
        stuck = going & ~better
        for k, sign in ((0, 1), (1, -1)):
            here = better & (move == k)
            a = np.where(here, a + sign * step_a, a)
        for k, sign in ((2, 1), (3, -1)):
            here = better & (move == k)
            b = np.where(here, b + sign * step_b, b)
        best = np.where(better, order[0], best)
        step_a = np.where(better & (move < 2), step_a * (1 + STEP_CHANGE), step_a)
        step_b = np.where(better & (move >= 2), step_b * (1 + STEP_CHANGE), step_b)
        step_a = np.where(stuck & change_a, step_a * (1 - STEP_CHANGE), step_a)
        step_b = np.where(stuck & ~change_a, step_b * (1 - STEP_CHANGE), step_b)
        settled = (np.abs(step_a) * ENOUGH < np.abs(a)) & (np.abs(step_b) * ENOUGH < np.abs(b))
        going &= ~settled
    return np.where(usable, a, 1.0), np.where(usable, b, 0.0), ~going


def _fit(max_rounds: int):
    @F.pandas_udf("a double, b double, settled boolean")
    def fit(m: pd.DataFrame) -> pd.DataFrame:
        a, b, settled = _search(m, max_rounds)
        return pd.DataFrame({"a": a, "b": b, "settled": settled})

    return fit


def score_fit(scores: DataFrame, method: str = "search", max_rounds: int = 1000) -> DataFrame:
    """`source, a, b, settled` that bring the scores of a source to the curve 1 / position; a search that isn't settled was
    ended after `max_rounds`.

    `search` steps along one coordinate at a time, `ols` is the least squares solution of the same objective.
    Scores by position stay as they are.
    """
    moments = _moments(scores)
    if method == "search":
        m = F.struct("n", "s", "t", "ss", "tt", "st", "low", "high")
        fitted = moments.withColumn("fit", _fit(max_rounds)(m))
    elif method == "ols":
        slope = F.when(F.col("ss") > 0, F.col("st") / F.col("ss")).otherwise(0.0)
        fitted = moments.withColumn("fit", F.struct(slope.alias("a"), (F.col("t") - slope * F.col("s")).alias("b"), F.lit(True).alias("settled")))
    else:
        raise ValueError("method must be search or ols")
    by_position = F.col("mode") == "position"
    return fitted.select(
        "source",
        F.when(by_position, 1.0).otherwise(F.col("fit.a")).alias("a"),
        F.when(by_position, 0.0).otherwise(F.col("fit.b")).alias("b"),
        (by_position | F.col("fit.settled")).alias("settled"),
    )


def normalize_scores(scores: DataFrame, method: str = "search") -> DataFrame:
    """Scores with `norm_score` on the common scale."""
    return scores.join(score_fit(scores, method), "source").withColumn(
        "norm_score", F.col("a") * F.col("score") + F.col("b")
    ).drop("a", "b", "settled")


def cluster_scores(clusters: DataFrame, scored: DataFrame, combine: str = "max") -> DataFrame:
    """Replace `relevance` by trunc(10000 r) of a member: the best one, or the first to arrive.

    Clusters without a scored member keep their relevance.
    """
    pick = F.max("norm_score") if combine == "max" else F.min(F.struct("arrival", "norm_score"))["norm_score"]
    best = scored.groupBy("cluster").agg((10000 * pick).cast("bigint").alias("native"))
    return clusters.join(best, "cluster", "left").withColumn(
        "relevance", F.coalesce(F.col("native"), F.col("relevance"))
    ).drop("native")

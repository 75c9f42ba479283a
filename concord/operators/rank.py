"""Ranking of clusters: weighted term counts, document frequency, tf-idf score."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from concord.catalog import Catalog, FieldSpec, parse_weight
from concord.functions.chains import LETTERS, TextChain, clean_words
from concord.functions.text import word_pattern
from concord.operators.merge import merge_records
from concord.operators.records import real_values, text_of
from concord.session import stored


@dataclass(frozen=True)
class Term:
    """A word of the query, with the field it was asked for, if any."""

    text: str
    qualifier: str | None = None


def query_terms(query: str | Sequence[str | tuple[str, str]], catalog: Catalog) -> list[Term]:
    """Terms of a query in order: words of the text, cleaned by the relevance chain.

    A query is a text, or a list of texts and (field, text) pairs. A repeated word counts once, for its first place.
    """
    chain = catalog.chain("relevance")
    terms: list[Term] = []
    for part in [query] if isinstance(query, str) else query:
        qualifier, text = (None, part) if isinstance(part, str) else part
        for word in text.split(" "):
            terms += [Term(t, qualifier) for t in clean_words(word, chain)]
    kept: dict[str, Term] = {}
    for t in terms:
        kept.setdefault(t.text, t)
    return list(kept.values())


# -- weighted term counts --------------------------------------------------------------------------------------------


def _count_words(text: Column, terms: list[Term], weights: list[Column], chain: TextChain) -> Column:
    """struct(len, w0, w1, ...) without position decay and proximity: weight times occurrences."""
    if chain is LETTERS:
        length = F.regexp_count(text, F.lit("[A-Za-z]+"))
        counts = [F.regexp_count(text, F.lit(word_pattern([t.text]))) for t in terms]
    else:
        tokens = chain.tokens(text)
        length = F.size(tokens)
        occurrences = lambda word: F.size(F.filter(tokens, lambda x: x == word))
        counts = [occurrences(t.text) for t in terms]
    return F.struct(length.alias("len"), *[(w * c).cast("int").alias(f"w{i}") for i, (w, c) in enumerate(zip(weights, counts))])


def _fold_words(
    text: Column, terms: list[Term], weights: list[Column], chain: TextChain, lead: float, follow: float
) -> Column:
    """struct(len, w0, w1, ...) by a fold over the words of the text.

    A word at position p adds weight / (1 + log2(1 + lead p)). If the word matched before it is an earlier query term at
    distance d, the count then grows by count * follow / (1 + log2 d). Counts are integers at every step.
    """
    zero, n = F.lit(0), len(terms)
    start = F.struct(
        zero.alias("pos"), F.lit(-1).alias("last"), zero.alias("at"), *[zero.alias(f"w{i}") for i in range(n)]
    )

    def step(s: Column, word: Column) -> Column:
        hit = reduce(lambda e, i: F.when(word == terms[i].text, i).otherwise(e), reversed(range(n)), F.lit(-1))
        decay = 1 + F.log2(1 + F.lit(float(lead)) * s["pos"])
        near = 1 + F.log2((s["pos"] - s["at"]).cast("double"))
        updated = []
        for i in range(n):
            grown = (s[f"w{i}"] + weights[i] / decay).cast("int")
            bonus = (grown + grown * F.lit(float(follow)) / near).cast("int")
            value = F.when((s["last"] >= 0) & (s["last"] < i), bonus).otherwise(grown)
            updated.append(F.when(hit == i, value).otherwise(s[f"w{i}"]).alias(f"w{i}"))
        return F.struct(
            (s["pos"] + 1).alias("pos"),
            F.when(hit >= 0, hit).otherwise(s["last"]).alias("last"),
            F.when(hit >= 0, s["pos"]).otherwise(s["at"]).alias("at"),
            *updated,
        )

    done = lambda s: F.struct(s["pos"].alias("len"), *[s[f"w{i}"].alias(f"w{i}") for i in range(n)])
    return F.aggregate(chain.tokens(text), start, step, done)


def _length_divide(count: Column, length: Column, mode: str) -> Column:
    divided = {
        "none": count.cast("double"),
        "log": count / F.log2((1 + length).cast("double")),
        "linear": count / length,
    }[mode]
    return F.when((count == 0) | (length == 0), 0.0).otherwise(divided)


def _weights(spec: FieldSpec, terms: list[Term], weights: Mapping[str, str] | None) -> list[int] | None:
    """Weight of every term in a field, None when the field is not ranked."""
    rank = spec.rank if weights is None else weights.get(spec.name)
    return None if rank is None else [parse_weight(rank, t.qualifier) for t in terms]


def _value_weight(rank: Column, term: Term) -> Column:
    """The weight of a rank specification that comes with a value."""
    parts = F.split(rank, " +")
    base = F.get(parts, F.lit(0)).try_cast("int")
    if not term.qualifier:
        return base
    return F.when(F.get(parts, F.lit(1)) == term.qualifier, F.get(parts, F.lit(2)).try_cast("int")).otherwise(base)


def with_term_counts(
    records: DataFrame,
    catalog: Catalog,
    terms: list[Term],
    weights: Mapping[str, str] | None = None,
    lead: float | None = None,
    follow: float | None = None,
    length: str | None = None,
    value_rank: bool = False,
) -> DataFrame:
    """Add `tf array<double>` and `hit array<boolean>`, one entry per term, summed over the ranked values of a record.

    The weight of a field comes from `weights` (only the fields listed there are ranked then), else from the `rank`
    attribute of a value if `value_rank` is set, else from the catalog.
    """
    lead = catalog.rank_lead if lead is None else lead
    follow = catalog.rank_follow if follow is None else follow
    mode = length or catalog.rank_length
    chain = catalog.chain("relevance")
    dynamic = value_rank and weights is None

    def value_counts(f: FieldSpec, fixed: list[int] | None) -> Column:
        def one(v: Column) -> Column:
            text = catalog.chain(f.icurule).display(v["value"]) if f.icurule else text_of(f, v)
            if dynamic:
                rank = F.coalesce(v["attrs"]["rank"], F.lit(f.rank))
                w = [F.coalesce(_value_weight(rank, t), F.lit(0)) for t in terms]
            else:
                w = [F.lit(x) for x in fixed]
            if lead == 0 and follow == 0:
                return _count_words(text, terms, w, chain)
            return _fold_words(text, terms, w, chain, lead, follow)

        return F.transform(real_values(f), one)

    fixed = {f: _weights(f, terms, weights) for f in catalog}
    counted = [value_counts(f, w) for f, w in fixed.items() if w is not None or dynamic]
    if not counted:
        zero = F.array(*[F.lit(0.0) for _ in terms])
        return records.withColumn("tf", zero).withColumn("hit", F.array(*[F.lit(False) for _ in terms]))
    every = F.concat(*counted) if len(counted) > 1 else counted[0]
    with_counts = records.withColumn("counts", every)
    sum_of = lambda w: F.aggregate("counts", F.lit(0.0), lambda a, c: a + _length_divide(c[w], c["len"], mode))
    any_of = lambda w: F.exists("counts", lambda c: c[w] > 0)
    tf = [sum_of(f"w{i}") for i in range(len(terms))]
    hit = [any_of(f"w{i}") for i in range(len(terms))]
    return with_counts.withColumn("tf", F.array(*tf)).withColumn("hit", F.array(*hit)).drop("counts")


# -- clusters --------------------------------------------------------------------------------------------------------


def ranked_clusters(counted: DataFrame, catalog: Catalog, terms: list[Term]) -> DataFrame:
    """Merged clusters with `tf` (sum over members) and `first_hit` (arrival of the first member with the term)."""
    extra = [F.sum(F.col("tf")[i]).alias(f"tf{i}") for i in range(len(terms))]
    extra += [F.min(F.when(F.col("hit")[i], F.col("arrival"))).alias(f"hit{i}") for i in range(len(terms))]
    merged = merge_records(counted, catalog, extra)
    names = range(len(terms))
    return (
        merged.withColumn("tf", F.array(*[F.col(f"tf{i}") for i in names]))
        .withColumn("first_hit", F.array(*[F.col(f"hit{i}") for i in names]))
        .drop(*[f"tf{i}" for i in names], *[f"hit{i}" for i in names])
    )


@dataclass(frozen=True)
class Frequency:
    """Records in the result and, per term, records whose cluster had the term when they arrived."""

    n: int
    df: tuple[int, ...]

    def idf(self, i: int) -> float:
        return math.log((1 + self.n) / self.df[i]) if self.df[i] else 0.0


def doc_freq(clusters: DataFrame, counted: DataFrame, terms: list[Term]) -> Frequency:
    """Document frequency of the terms: a few numbers, counted by one pass over the clusters.

    Every member of a cluster with the term counts, less the members that came before its first hit. Such members can
    only be records without the term in a cluster whose first member lacks it; the second pass joins just those, and runs
    only if there are such clusters.
    """
    names = range(len(terms))
    late = reduce(
        lambda a, b: a | b, [F.coalesce(F.col("first_hit")[i] > F.col("first_arrival"), F.lit(False)) for i in names]
    )
    whole = clusters.agg(
        F.sum("members").alias("n"),
        F.count_if(late).alias("late"),
        *[F.sum(F.when(F.col("first_hit")[i].isNotNull(), F.col("members"))).alias(f"df{i}") for i in names],
    ).first()
    df = [whole[f"df{i}"] or 0 for i in names]
    if whole["late"]:
        lacking = counted.filter(~F.forall("hit", lambda h: h)).select("cluster", "arrival")
        joined = lacking.join(clusters.filter(late).select("cluster", "first_hit"), "cluster")
        early = joined.agg(*[F.count_if(F.col("arrival") < F.col("first_hit")[i]) for i in names]).first()
        df = [d - e for d, e in zip(df, early)]
    return Frequency(whole["n"] or 0, tuple(df))


def with_relevance(
    clusters: DataFrame,
    frequency: Frequency,
    terms: list[Term],
    cluster: bool = True,
    explain: bool = False,
) -> DataFrame:
    """Add `relevance`: sum over terms of trunc(100000 tf idf), idf = ln((1 + n) / df).

    With `cluster=False` it is divided by the number of members. `explain=True` adds the numbers of every step.
    """
    add = [(100000 * F.col("tf")[i] * F.lit(frequency.idf(i))).cast("bigint") for i in range(len(terms))]
    total = reduce(lambda a, b: a + b, add)
    # integer division toward zero
    score = total if cluster else F.call_function("div", total, F.col("members"))
    out = clusters.withColumn("relevance", score)
    if explain:
        steps = [
            F.struct(
                F.lit(t.text).alias("term"),
                F.col("tf")[i].alias("tf"),
                F.lit(frequency.df[i]).alias("df"),
                F.lit(frequency.n).alias("n"),
                F.lit(frequency.idf(i)).alias("idf"),
                add[i].alias("add"),
                (F.lit(1).cast("long") if cluster else F.col("members")).alias("divided_by"),
            )
            for i, t in enumerate(terms)
        ]
        out = out.withColumn("explain", F.array(*steps))
    return out


def rank(
    records: DataFrame,
    catalog: Catalog,
    query: str | Sequence[str | tuple[str, str]],
    weights: Mapping[str, str] | None = None,
    lead: float | None = None,
    follow: float | None = None,
    length: str | None = None,
    cluster: bool | None = None,
    explain: bool = False,
    value_rank: bool = False,
) -> DataFrame:
    """Merged and scored clusters of records that carry `cluster`.

    The clusters are made once and stored, since both the document frequency and the scores need them.
    """
    terms = query_terms(query, catalog)
    if not terms:
        return merge_records(records, catalog).withColumn("relevance", F.lit(0).cast("bigint"))
    counted = with_term_counts(records, catalog, terms, weights, lead, follow, length, value_rank)
    clusters = stored(ranked_clusters(counted, catalog, terms), "clusters")
    by_cluster = catalog.rank_cluster if cluster is None else cluster
    return with_relevance(clusters, doc_freq(clusters, counted, terms), terms, by_cluster, explain)

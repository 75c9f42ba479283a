"""From raw documents to token ids: five stages, each over all that the one before it kept.

Every stage takes `(spark, docs, sf_dir)` and returns the columns of `docs`, the last one token ids. Results are written as
Parquet in the shared folder between the stages, so that a lost executor never takes more than a stage back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from concord.llm import bpe, fertility, lm, mixing, near
from concord.llm.common import table
from concord.session import stored


def _new(docs: DataFrame, name: str) -> str:
    """A column name that `docs` doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def _chosen(docs: DataFrame, rows: DataFrame, once: bool = False) -> DataFrame:
    """The rows of `docs` whose id and text hash are in `rows` (`doc_id, text_key`); `once`: one of several."""
    key = _new(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    wanted = rows.select(F.col("doc_id").alias("wanted_id"), F.col("text_key").alias("wanted_key")).distinct()
    same = (keyed[key] == wanted["wanted_key"]) & keyed["doc_id"].cast("bigint").eqNullSafe(wanted["wanted_id"])
    met = keyed.join(wanted, same, "left_semi")
    return (met.dropDuplicates(["doc_id", key]) if once else met).drop(key)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, by the labels of `sf_dir`. Repeated rows stay or go together."""
    return _chosen(docs, lm.classify(docs, table(spark, sf_dir, "labels")).filter("kept"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Repeated rows stay or go together."""
    vocabulary = fertility.Vocabulary.read(public_tokenizers.path("piece_bpe_32k.model"))
    return _chosen(docs, fertility.judge(docs, vocabulary).filter("kept"))


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near duplicates: that of the least doc_id, then of the least text hash; a row without
    doc_id only if the group has no other. Rows without words are in no group and all stay."""
    word = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    first = near.groups(docs).filter("component IS NOT NULL").groupBy("component").agg(F.min(order).alias("first"))
    rows = first.select("first.doc_id", "first.text_key")
    return _chosen(docs.filter(word), rows, once=True).unionByName(docs.filter(~word))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes."""
    mixed = mixing.mix(docs.withColumn(_new(docs, "row"), F.struct(*docs.columns)))
    return mixed.filter("taken").select(f"{_new(docs, 'row')}.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`doc_id, source, lang, ids, n_tokens, round_trip` of every document; `round_trip` says that the ids decode to its
    text."""
    coder = bpe.ByteBpe(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    text = F.coalesce(F.col("text"), F.lit(""))
    digested = docs.select("doc_id", "source", "lang", "text", F.md5(text.cast("binary")).alias("digest"))
    decoded = bpe.decode(bpe.encode(digested, coder), coder)
    return decoded.select(
        "doc_id",
        "source",
        "lang",
        "ids",
        F.size("ids").cast("bigint").alias("n_tokens"),
        (F.md5("decoded") == F.col("digest")).alias("round_trip"),
    )


STAGES = [
    ("quality classifier", quality),
    ("quality rules", rules),
    ("near duplicates", one_of_near),
    ("mix", mix),
    ("token ids", tokens),
]

#: The stages fit models, components and marginals; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

"""The registered queries over the operators of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from concord.llm import bpe, chat, fertility, fim, flac, html, ids, licences, lm, mixing, near, trie, urls
from concord.llm.common import table
from concord.session import stored


def op1_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # the path of a page ends with the number of the document it shows, which is the one that is labelled
    shown = F.regexp_extract("url", r"/([0-9]+)(?:\.html|/)?(?:[?#].*)?$", 1)
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    numbered = pages.select("url", F.when(shown != "", shown).cast("bigint").alias("doc_id"))
    return urls.judge(pages, urls.mine(numbered.join(labels, "doc_id").select("url", "blocked")))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coder = bpe.ByteBpe(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), coder), coder)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mixing.sampled(stored(mixing.described(docs).drop("text"), "described"))
    cell = [F.col(f"cell_{c}").alias(c) for c in ("source", "lang")]
    return mixed.select("doc_id", *cell, "topic", "n_tokens", F.round("rate", 6).alias("rate"), "taken")


def op4_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return lm.classify(docs, table(spark, sf_dir, "labels")).drop("text_key")


def op6_token_id_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    coder = ids.Coder.read(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ids.read(ids.write(docs, coder, ids.folder(spark), end_id=2))


def op7_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = fertility.Vocabulary.read(public_tokenizers.path("piece_bpe_32k.model"))
    judged = fertility.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), vocabulary)
    return judged.drop("lang", "text_key")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = flac.load(flac.store(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return read.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.restore(fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return cut.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


def op13_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.examples(chat.planted(table(spark, sf_dir, "conversations"))))


QUERIES = {
    "op1_url_association_rules": op1_url_association_rules,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_source_mixing": op3_source_mixing,
    "op4_licence_digests": op4_licence_digests,
    "op5_kneser_ney_quality": op5_kneser_ney_quality,
    "op6_token_id_shards": op6_token_id_shards,
    "op7_tokenizer_fertility": op7_tokenizer_fertility,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_flac_media": op9_flac_media,
    "op10_html_main_text": op10_html_main_text,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_chat_examples": op13_chat_examples,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op3_source_mixing": mixing.sql(),
    "op4_licence_digests": licences.sql(),
    "op11_fill_in_middle": fim.sql(),
    "op12_conversation_trie": trie.sql(),
    "op13_chat_examples": chat.sql(),
    "op8_minhash_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE text IS NOT NULL),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i : i + 4] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * n_both >= 75 * (p.n + q.n - n_both)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN least ON least.a = d.doc_id""",
}

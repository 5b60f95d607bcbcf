"""Registered queries of the corpus operators: whole tables, production parameters, digests from operator outputs."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, language, licenses, media, neardup, pages, pieces, secrets, tokens, toxicity
from .common import held_out, table, train_side

TOKENIZERS = os.environ.get("QUILLFORGE_TOKENIZERS", "")
TOXIC = 0.3


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; the folder is a parameter (QUILLFORGE_TOKENIZERS)."""
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.find_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokens.write_shards(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return tokens.read_shards(spark, path)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.fit(docs))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *map(count, secrets.KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = media.write_archives(docs)
    read = media.describe(media.read_archives(spark, manifest))
    return read.withColumn("doc_id", F.col("key").cast(docs.schema["doc_id"].dataType)).select("doc_id", *media.DIGEST[1:])


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs.where(train_side(F.col("doc_id"))), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted")
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.classify(docs, language.fit(docs.where(train_side(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files <source>/<thousand of the id>/<id>."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", neardup.hex_digits(F.col("fp")).alias("fingerprint"), "component_id", "n_class")


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_token_shards,
        op3_secrets,
        op4_media,
        op5_toxicity,
        op6_language,
        op7_main_text,
        op8_pieces,
        op9_licenses,
        op10_neardup,
    )
}

ORACLE_SQL = {
    "op1_decontamination": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS win, least(10, len(w)) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT pos.r, pos.k, pos.n, win.item FROM pos JOIN win ON pos.win = win.win AND pos.n = win.n),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover ON d.r = cover.r LEFT JOIN its ON d.r = its.r
"""
}

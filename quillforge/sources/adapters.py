"""Canonical frames over the star-schema tables, and the same as SQL for oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_extendedprice", "l_tax", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, version, score_vlm, score_ocr, score, run, slice, partkey: the key is renamed before the window, for one shuffle."""
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "id")
    version = F.row_number().over(Window.partitionBy("id").orderBy(*ORDER)) - 1
    ocr, vlm = F.round(F.col("l_discount") * 10, 6), F.col("l_quantity") / 50
    return rows.select(
        "id", version.alias("version"), vlm.alias("score_vlm"), ocr.alias("score_ocr"), F.round(ocr * vlm, 6).alias("score"),
        F.col("l_returnflag").alias("run"), F.col("l_linestatus").alias("slice"), F.col("l_partkey").alias("partkey"),
    )


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    after = part.select((F.col("p_partkey") - 1).alias("sample_id"), F.col("p_name").alias("detected_text"))
    return part.select(F.col("p_partkey").alias("sample_id"), F.col("p_name").alias("target_text")).join(after, "sample_id")


def scored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score rows with target and detected text; the last part has none detected."""
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_partkey").alias("partkey"), F.col("p_name").alias("target_text"))
    after = part.select((F.col("p_partkey") - 1).alias("partkey"), F.col("p_name").alias("detected_text"))
    return score_rows(spark, sf_dir).join(names.join(after, "partkey", "left"), "partkey")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("target_text"), F.col("lang").alias("content_type"), F.col("source").alias("style"), "n_chars"
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("sample_id"), (F.col("quality") == 1).alias("expected_exact_match"), F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("human_label")
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", step.alias("step"), F.col("value").alias("reward"), "event_type")


CTES = {
    "score_rows": """SELECT l_orderkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
      l_quantity, l_discount, l_extendedprice, l_tax, l_shipdate) - 1 AS INTEGER) AS version, l_quantity / 50 AS score_vlm,
      round(l_discount * 10, 6) AS score_ocr, round(round(l_discount * 10, 6) * (l_quantity / 50), 6) AS score,
      l_returnflag AS run, l_linestatus AS slice, l_partkey AS partkey FROM lineitem""",
    "text_pairs": "SELECT a.p_partkey AS sample_id, a.p_name AS target_text, b.p_name AS detected_text FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1",
    "scored_texts": """SELECT s.*, a.p_name AS target_text, b.p_name AS detected_text FROM score_rows s JOIN part a ON a.p_partkey = s.partkey
      LEFT JOIN part b ON b.p_partkey = s.partkey + 1""",
    "prompts": "SELECT doc_id AS id, text AS target_text, lang AS content_type, source AS style, n_chars FROM documents",
    "gold": "SELECT doc_id AS sample_id, quality = 1 AS expected_exact_match, CASE WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS human_label FROM labels",
    "metrics": "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS step, value AS reward, event_type FROM events",
    "best": """SELECT id, count(*) AS n, max(struct_pack(s := score, v := version)) AS b, min(struct_pack(s := score, v := version)) AS w
      FROM score_rows GROUP BY id""",
    "pairs": """SELECT 'dpo:' || id || ':w' || b.v || ':l' || w.v || ':score' AS pair_id, id AS prompt_id, b.v AS winner_version, w.v AS loser_version,
      b.s AS winner_score, w.s AS loser_score, round(b.s - w.s, 12) AS margin FROM best WHERE n >= 2 AND b.s >= 0.5 AND b.s - w.s > 0 AND b.s - w.s >= 0.1""",
}
USES = {"scored_texts": ["score_rows"], "best": ["score_rows"], "pairs": ["score_rows", "best"]}


def oracle(names: str, query: str) -> str:
    """The query with the canonical frames that it names."""
    wanted: list[str] = []
    for n in names.split():
        wanted += [x for x in [*USES.get(n, []), n] if x not in wanted]
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in wanted)
    if head and query.lstrip().startswith("WITH "):
        return f"WITH {head}, {query.lstrip().removeprefix('WITH ')}"
    return f"WITH {head} {query}" if head else query

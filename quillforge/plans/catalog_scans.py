"""Registered queries of the remaining scans, batch scorers, plan expansion and windowed streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import series as E
from ..operators.scorers import phrases
from .catalog import PR, TP, A, P, S, T, add, c, on, pairs, prompts, readers, scored, scores, sinks, streaming, work_folder


def _benchmark_lines(spark, d):
    """The benchmark as one file of JSON lines in item order, a contract-size input."""
    path = work_folder(spark, "benchmark")
    rows = A.table(spark, d, "benchmark").select(c("item_id").cast("string").alias("id"), F.col("text").alias("target_text"))
    rows.orderBy(F.col("id").cast("long")).select(F.to_json(F.struct("id", "target_text")).alias("value")).coalesce(1).write.text(path)
    return path


ROWS = "(SELECT CAST(item_id AS VARCHAR) AS id, text, row_number() OVER (ORDER BY item_id) - 1 AS k FROM benchmark)"


@add("src_06", f"SELECT key, max(md5(text)) AS h FROM (SELECT lpad(CAST(k AS VARCHAR), 6, '0') AS key, text FROM {ROWS} UNION ALL SELECT id, text FROM {ROWS}) GROUP BY 1")
def src_06(spark, d):
    keyed = readers.prompt_keys(readers.numbered_lines(spark, _benchmark_lines(spark, d)))
    return keyed.select("key", F.md5("target_text").alias("h"))


@add("src_07", f"SELECT lpad(CAST(k AS VARCHAR), 6, '0') AS alias, id FROM {ROWS}")
def src_07(spark, d):
    lines = readers.numbered_lines(spark, _benchmark_lines(spark, d), count_blank=False)
    return lines.select(T.padded_id(c("position")).alias("alias"), F.get_json_object("value", "$.id").alias("id"))


@add("src_08", f"SELECT id FROM {ROWS} WHERE k >= 5 AND k < 25")
def src_08(spark, d):
    lines = readers.sliced(readers.numbered_lines(spark, _benchmark_lines(spark, d)), 5, 25)
    return lines.select(F.get_json_object("value", "$.id").alias("id"))


@add("src_11", "SELECT CAST(sample_id AS VARCHAR) AS sample_id, human_label FROM gold", "gold")
def src_11(spark, d):
    path = work_folder(spark, "gold") + ".jsonl"
    A.gold(spark, d).select("sample_id", "human_label").write.json(path)
    return readers.require(readers.records(spark, path), ["sample_id", "human_label"]).select("sample_id", "human_label")


@add("src_15", "SELECT CAST(sample_id AS VARCHAR) AS id, target_text, detected_text AS ocr_text FROM text_pairs", TP)
def src_15(spark, d):
    path = work_folder(spark, "ocr") + ".csv"
    pairs(spark, d).select(c("sample_id").alias("id"), "target_text", c("detected_text").alias("ocr_text")).write.option("header", True).csv(path)
    return readers.records(spark, path)


@add("src_04", "SELECT 'v1' AS schema_version, count(*) AS records FROM benchmark")
def src_04(spark, d):
    path = work_folder(spark, "envelope") + ".json"
    rows = A.table(spark, d, "benchmark").select("item_id")
    rows.groupBy(F.lit("v1").alias("schema_version")).agg(F.collect_list(F.struct("item_id")).alias("records")).write.json(path)
    whole = spark.read.json(path).select("schema_version")
    return whole.crossJoin(readers.records(spark, path).agg(F.count("*").alias("records")))  # one row each


on(prompts, "src_24", None, PR, lambda p: P.subset(p.select("id", "target_text"), 100, 3, "id"))
add("udf_01", "SELECT sample_id, CASE WHEN length(target_text) = length(detected_text) THEN 'yes' ELSE 'no' END AS answer FROM text_pairs", TP)(
    lambda s, d: scored(pairs(s, d), c("target_text"), c("detected_text")).select("sample_id", F.when(c("evidence.score_ocr") > 0.5, "yes").otherwise("no").alias("answer"))
)
add("udf_03", "SELECT sample_id, detected_text AS ocr_detected FROM text_pairs", TP)(
    lambda s, d: scored(pairs(s, d), c("target_text"), c("detected_text")).select("sample_id", "evidence.ocr_detected")
)


def _generator():
    return lambda part: pd.DataFrame({"sample_id": part["sample_id"], "phrase": "sign: " + part["target_text"]})


add("udf_05", "SELECT sample_id, 'sign: ' || target_text AS phrase FROM text_pairs", TP)(
    lambda s, d: phrases(pairs(s, d).select("sample_id", "target_text"), _generator, "sample_id long, phrase string")
)


@add("str_window", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def str_window(spark, d):
    """Hourly windows of the stream, closed by a watermark: the files are in no order, so the delay covers all of them, and
    a last event long after the others closes every window."""
    source, path = work_folder(spark, "events"), work_folder(spark, "hours")
    events = A.table(spark, d, "events").withColumn("ts", c("ts").cast("timestamp"))
    events.repartition(4).write.parquet(source)
    events.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.expr("ts + interval 10 years")).write.mode("append").parquet(source)
    rows = streaming.windowed(streaming.stream_table(spark, source), "ts", "3650 days", "1 hour", "value", "event_type")
    streaming.run_to_table(rows, path, work_folder(spark, "progress"))
    return spark.read.schema(rows.schema).parquet(path).withColumn("window_start", c("window_start").cast("timestamp_ntz"))


@add("snk_03", "SELECT pair_id, CAST(winner_version AS VARCHAR) AS winner_version FROM pairs", "pairs")
def snk_03(spark, d):
    path = work_folder(spark, "pairs")
    sinks.json_rows(S.select_pairs(scores(spark, d), "best_vs_worst").select("pair_id", "winner_version"), path)
    return spark.read.option("primitivesAsString", True).json(path)


CURVE = """WITH v AS (SELECT step, round(avg(reward), 6) AS v FROM metrics GROUP BY 1), m AS (SELECT step, avg(v) OVER (ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s, row_number() OVER (ORDER BY step) AS k FROM v),
  p AS (SELECT step, s, row_number() OVER (ORDER BY step) - 1 AS k, count(*) OVER () AS n, min(s) OVER () AS lo, max(s) OVER () AS hi FROM m WHERE k >= 5)
SELECT step, round(k * 640 / greatest(n - 1, 1), 3) AS x, round(360 * (1 - coalesce((s - lo) / nullif(hi - lo, 0), 0.5)), 3) AS y FROM p"""


@add("snk_20", CURVE, "metrics")
def snk_20(spark, d):
    """Points of a training curve: the mean reward of each step, smoothed over five."""
    steps = A.metrics(spark, d).groupBy("step").agg(F.round(F.avg("reward"), 6).alias("v"))
    smooth = E.moving_average(steps, "v", "step", 5).select("step", "smoothed")
    return sinks.scatter(smooth, "step", "smoothed")

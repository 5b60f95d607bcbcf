"""Registered queries of documents: pools, image lists, record hashes, manifests, plans, contracts and states."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..sources import documents
from . import provenance as V
from .catalog import PR, SR, A, M, P, Q, add, c, on, prompts, readers, scores, sinks, work_folder

POOLS = "SELECT lang AS theme, count(DISTINCT source) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1"


def _pools(spark, d):
    """Words (here: sources) by theme (here: language) as one JSON object, read back."""
    path = work_folder(spark, "pools") + ".json"
    pools = A.table(spark, d, "documents").where("lang is not null and source is not null").groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("words"))
    listed = F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "words"))))
    pools.agg(F.to_json(listed).alias("value")).write.text(path)
    return readers.word_pools(spark, path)


add("src_23", POOLS)(lambda s, d: _pools(s, d).select("theme", F.size("words").cast("long").alias("n")))


@add("udf_06")
def udf_06(spark, d):
    """Phrases without a model: every prompt gets two words of its theme's pool."""
    draws = prompts(spark, d).select(c("id").alias("draw"), c("content_type").alias("theme"))
    return P.pool_text(_pools(spark, d), draws, 2, 11)


on(prompts, "dat_02", None, PR, lambda p: p.select("id", P.number_text(5, c("id")).alias("number_text")))


@add("snk_13", "SELECT 'imgs/' || item_id || '.png' AS img_name, 512 AS width, length(text) AS n, 1 AS annotations FROM benchmark")
def snk_13(spark, d):
    path = work_folder(spark, "images") + ".json"
    rows = A.table(spark, d, "benchmark").select(
        c("item_id").cast("string").alias("id"), F.lit(512).alias("resolution"), c("text").alias("caption"), F.array(F.struct(c("text").alias("text"))).alias("annotations")
    )
    sinks.image_document(rows, "/data", path)
    entry = spark.read.json(path).select(F.explode("data_list").alias("e"))
    return entry.select("e.img_name", c("e.width").cast("int").alias("width"), F.length("e.caption").cast("long").alias("n"), F.size("e.annotations").alias("annotations"))


@add("snk_18", "SELECT lang AS slice, least(count(*), 5) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def snk_18(spark, d):
    """Benchmark prompts by slice as JSON lines with sorted keys, read back."""
    path = work_folder(spark, "benchmark-prompts")
    rows = A.table(spark, d, "documents").where("lang is not null").select(c("lang").alias("slice"), c("doc_id").alias("id"))
    none = rows.select(c("id").alias("key")).where("1 = 0")
    kept = Q.slice_quota(rows.withColumn("position", c("id")), none, 5, c("id"))
    sinks.json_rows(kept.select("slice", "id"), path)
    return spark.read.json(path).groupBy("slice").agg(F.count("*").alias("n"))


RECORDS = """SELECT id, sha256(unhex(string_agg(printf('%016x', strlen(r)) || hex(encode(r)), '' ORDER BY version))) AS sha256
FROM (SELECT id, version, '{"partkey":' || partkey || ',"run":"' || run || '"}' AS r FROM score_rows) GROUP BY id"""
on(scores, "jsn_03", RECORDS, SR, lambda r: sinks.record_list_hash(r, ["id"], "version", sinks.canonical_json({"run": c("run"), "partkey": c("partkey")})))

LEFT = {"model": {"name": "a", "steps": 50}, "seed": 1, "size": [512, 512]}
RIGHT = {"model": {"name": "b", "steps": 50}, "seed": 1, "host": "x"}


def of_source(spark, d, lang: str) -> dict:
    """A manifest of the documents of a language: what they are and how many there are."""
    rows = A.table(spark, d, "documents").where(c("lang") == lang)
    got = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars")).first()
    return {"lang": lang, "counts": {"documents": got.n, "chars": got.chars}, "labels": sorted(r.source for r in rows.where("source is not null").select("source").distinct().collect())}


SIZES = "(SELECT lang, count(*) AS n, sum(n_chars) AS chars, list_sort(list_distinct(list(source))) AS labels FROM documents WHERE lang IN ('en', 'de') GROUP BY 1)"


@add("jsn_04", f"""SELECT 'lang' AS path, '"en"' AS value UNION ALL SELECT 'counts.documents', CAST(n AS VARCHAR) FROM {SIZES} WHERE lang = 'en' UNION ALL SELECT 'counts.chars', CAST(chars AS VARCHAR) FROM {SIZES} WHERE lang = 'en'
UNION ALL SELECT 'labels', '["' || array_to_string(labels, '", "') || '"]' FROM {SIZES} WHERE lang = 'en'""")
def jsn_04(spark, d):
    return V.manifest_frame(spark, of_source(spark, d, "en"))


@add("prv_06", f"""SELECT 'lang' AS field, 'different' AS reason, 'blocking' AS severity UNION ALL SELECT 'counts.documents', 'different', 'note' FROM {SIZES} HAVING count(DISTINCT n) > 1
UNION ALL SELECT 'counts.chars', 'different', 'note' FROM {SIZES} HAVING count(DISTINCT chars) > 1 UNION ALL SELECT 'labels', 'different', 'note' FROM {SIZES} HAVING count(DISTINCT labels) > 1 UNION ALL SELECT 'host', 'missing_left', 'note'""")
def prv_06(spark, d):
    found = V.comparable(of_source(spark, d, "en"), of_source(spark, d, "de") | {"host": "x"}, {"lang"})
    return spark.createDataFrame([(x["field"], x["reason"], x["severity"]) for x in found], "field string, reason string, severity string")


@add("prv_09", """SELECT target, seed, step FROM (SELECT unnest(['base', 'tuned']) AS target), (SELECT unnest([1, 2, 3]) AS seed),
(SELECT unnest(['generate', 'score']) AS step) UNION ALL SELECT unnest(['base', 'tuned']), NULL, 'aggregate'""")
def prv_09(spark, d):
    steps = V.evaluation_grid(["base", "tuned"], [1, 2, 3])
    return spark.createDataFrame([(x["target"], x["seed"], x["step"]) for x in steps], "target string, seed int, step string")


@add("val_21", """SELECT * FROM (VALUES ('revision of b: 40 hex digits are needed'), ('seeds: unique whole numbers from 0 are needed'),
('targets: exactly one is the baseline')) AS t(error)""")
def val_21(spark, d):
    targets = [{"name": "a", "revision": "0" * 40}, {"name": "b", "revision": "main"}]
    return spark.createDataFrame([(e,) for e in V.evaluation_errors({"targets": targets, "seeds": [1, 1]})], "error string")


@add("val_24", "SELECT * FROM (VALUES ('a/b.csv', true), ('../b.csv', false), ('/etc/b.csv', false), ('a/../b.csv', true)) AS t(path, allowed)")
def val_24(spark, d):
    def allowed(path):
        try:
            return bool(V.safe_path("/data/out", path))
        except ValueError:
            return False

    return spark.createDataFrame([(p, allowed(p)) for p in ("a/b.csv", "../b.csv", "/etc/b.csv", "a/../b.csv")], "path string, allowed boolean")


@add("val_19", """SELECT doc_id, CASE WHEN lang IS NULL THEN 'missing' ELSE 'unexpected' END AS reason FROM documents WHERE lang IS DISTINCT FROM 'en'""")
def val_19(spark, d):
    """The language stands for the schema version of a document."""
    return readers.version_errors(A.table(spark, d, "documents").select("doc_id", "lang"), "en", "lang").select("doc_id", "reason")


@add("str_03", "SELECT * FROM (VALUES (0, 'in_progress', 1), (1, 'failed', 1), (2, 'in_progress', 2), (3, 'complete', 2)) AS t(step, status, attempt)")
def str_03(spark, d):
    """An attempt that fails and one that succeeds, each state stored and read again before the next."""
    rows, path = [], work_folder(spark, "attempt") + ".json"
    documents.write(spark, {}, path)
    for k, status in enumerate(("in_progress", "failed", "in_progress", "complete")):
        documents.write(spark, V.advance(documents.read(spark, path), status), path)
        now = documents.read(spark, path)
        rows.append((k, now["status"], now["attempt"]))
    return spark.createDataFrame(rows, "step int, status string, attempt int")


@add("str_04", "SELECT * FROM (VALUES ('first', true), ('same', true), ('other', false)) AS t(claimant, held)")
def str_04(spark, d):
    """Claims on one place of the shared folder, by contracts of the documents of two languages."""
    rows, path = [], work_folder(spark, "contract") + ".json"
    for who, lang in (("first", "en"), ("same", "en"), ("other", "de")):
        try:
            V.claim(spark, path, of_source(spark, d, lang))
            rows.append((who, True))
        except ValueError:
            rows.append((who, False))
    return spark.createDataFrame(rows, "claimant string, held boolean")


@add("prv_10", "SELECT * FROM (VALUES ('report', 'changed'), ('table', 'missing')) AS t(name, reason)")
def prv_10(spark, d):
    folder = work_folder(spark, "evidence")
    paths = {n: f"{folder}/{n}.json" for n in ("plot", "report", "table")}
    for lang, p in zip(("en", "de", "fr"), paths.values(), strict=True):
        documents.write(spark, of_source(spark, d, lang), p)
    entries = V.evidence(spark, paths)
    documents.write(spark, of_source(spark, d, "es") | {"note": 1}, paths["report"])
    documents.delete(spark, paths["table"])
    return spark.createDataFrame([(x["name"], x["reason"]) for x in V.verify_evidence(spark, entries)], "name string, reason string")


CONFIG = '{"api_key":"<redacted>","steps":50}'


@add("prv_01", f"""SELECT 'training-sft' AS slug, '{hashlib.sha256(CONFIG.encode()).hexdigest()}' AS config_sha256""")
def prv_01(spark, d):
    made = V.run_manifest("Training (SFT)", ["train"], {"steps": 50, "api_key": "k"})
    return spark.createDataFrame([(made["run_id"].split("-", 1)[1], made["config_sha256"])], "slug string, config_sha256 string")


@add("sup_15", """SELECT * FROM (VALUES ('cer_quality_min', 'cer', 'min'), ('entropy_quality_max', 'entropy', 'max'), ('score_vlm_min', 'score_vlm', 'min'),
('score_vlm', NULL, NULL)) AS t(threshold, field, side)""")
def sup_15(spark, d):
    rows = []
    for name in ("cer_quality_min", "entropy_quality_max", "score_vlm_min", "score_vlm"):
        rule = M.threshold_rule(name)
        rows.append((name, M.component_field(rule[0]) if rule else None, rule[1] if rule else None))
    return spark.createDataFrame(rows, "threshold string, field string, side string")


on(A.gold, "sup_04", "SELECT CAST(sample_id AS VARCHAR) AS sample_id, CAST(expected_exact_match AS VARCHAR) AS expected_exact_match, human_label, '' AS notes FROM gold", "gold", lambda g: sinks.pick(g, ["sample_id", "expected_exact_match", "human_label", "notes"]))


@add("sup_20", """SELECT style, content_type FROM prompts WHERE id % 2 = 0 AND style IS NOT NULL AND content_type IS NOT NULL GROUP BY 1, 2 UNION
SELECT style, content_type FROM prompts WHERE style IS NOT NULL AND content_type IS NOT NULL GROUP BY 1, 2""", PR)
def sup_20(spark, d):
    rows = prompts(spark, d).where("style is not null and content_type is not null").select("id", "style", "content_type")
    pool = rows.where("id % 2 = 0").groupBy("style", "content_type").agg(F.min("id").alias("id")).select("id", "style", "content_type")
    return P.add_scenes(pool, rows.where("id % 2 = 1"), ["style", "content_type"], "id").select("style", "content_type")


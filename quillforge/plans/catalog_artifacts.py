"""Registered queries of artifacts: sidecars, stage validation, merges, layouts, generation contracts, bundles, curricula.

Each query writes what its operator reads, from the tables, into the shared folder. Damage that a check has to find is done
by a rule on the rows, and the SQL counts those rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curriculum as U
from ..operators import diagnostics as D
from ..operators import scorefiles as Z
from ..operators.prompts import batches_by_shape
from ..session import without_shuffle_files
from ..sources import documents as O
from . import artifacts as X
from . import bundle as B
from . import configs as W
from . import generation as G
from . import provenance as V
from .catalog import PR, SHOWN, SR, ST, STRIP, TP, A, M, Q, R, S, T, add, c, on, pairs, prompts, readers, scored_texts, scores, sinks, work_folder

DIAGNOSTIC = X.formula_document(M.Formula())
PRODUCT = X.formula_document(M.vlm_ocr())


def frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def run_manifest(spark: SparkSession, folder: str, name: str, **config) -> str:
    path = f"{folder}/{name}.json"
    O.write(spark, V.run_manifest(name, ["score", name], config) | {"schema_version": "run-manifest/v1"}, path)
    return path


def refused(work) -> bool:
    try:
        work()
    except (ValueError, OSError):
        return True
    return False


def canonical(spark: SparkSession, d: str, damaged: bool = False) -> DataFrame:
    """Canonical score rows; if damaged, blank texts where the part is one of the first hundred, and a state that is unknown
    for run R."""
    r = scored_texts(spark, d)
    found = T.character_metrics(c("detected_text"), c("target_text"))
    blank = F.when(c("partkey") <= 100, "").otherwise(c("target_text")) if damaged else c("target_text")
    state = F.when(c("run") == "R", "seen").otherwise(found["detection_status"]) if damaged else found["detection_status"]
    own = {
        "sample_id": c("id").cast("string"), "version": c("version"), "score": c("score"), "product_score": c("score"), "target_text": blank, "score_vlm": c("score_vlm"),
        "score_ocr": c("score_ocr"), "cer": F.lit(None).cast("double"), "entropy": F.lit(None).cast("double"), "ocr_detected": c("detected_text"), "detection_status": state,
        "exact_text_match": found["exact_text_match"], "char_accuracy": found["char_accuracy"], "char_matches": found["char_matches"], "char_total": found["char_total"],
        "missing_components": F.lit("cer,entropy"), "formula_complete": F.lit("false"), "manifest_path": F.lit("m.json"), "text_metrics": F.lit("{}"), "scorer_metadata": F.lit("{}"), "thresholds": F.lit("{}"),
    }
    return r.select(*[v.cast("string").alias(k) for k, v in own.items()])


def plain_scores(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).select(c("id").cast("string").alias("id"), c("version").cast("string").alias("version"), c("score").cast("string").alias("score"), c("run").alias("target_text"), "run")


# ---------------------------------------------------------------- score tables and their sidecars
BATCH = "SELECT CASE WHEN run = 'A' THEN 0 ELSE 1 END AS batch, count(*) AS n FROM score_rows GROUP BY 1"


def _append(spark, d, path, whole: bool) -> dict:
    tasks = scores(spark, d).select("id", "version", "run")
    out = Z.append_scores(tasks.where("run = 'A'"), path, ["id", "version"], lambda t: t.withColumn("score", F.lit(0.5)), {})
    return Z.append_scores(tasks, path, ["id", "version"], lambda t: t.withColumn("score", F.lit(0.5)), {}) if whole else out


@add("snk_05", BATCH, SR)
def snk_05(spark, d):
    """Run A is scored first; the resumed run scores the rest and nothing twice."""
    path = work_folder(spark, "scores")
    assert _append(spark, d, path, True)["execution"]["status"] == "complete"
    return spark.read.parquet(path).groupBy("batch").agg(F.count("*").alias("n"))


@add("str_02", "SELECT id, version FROM score_rows WHERE run <> 'A'", SR)
def str_02(spark, d):
    """What a resumed run still has to do, from what is written."""
    path = work_folder(spark, "scores")
    _append(spark, d, path, False)
    return Z.pending(scores(spark, d).select("id", "version"), Z.scored_so_far(spark, path), ["id", "version"])


@add("snk_02", "SELECT count(*) AS total, count(*) FILTER (score >= 0.3) AS selected FROM score_rows", SR)
def snk_02(spark, d):
    path = work_folder(spark, "summary") + ".json"
    O.write(spark, scores(spark, d).agg(F.count("*").alias("total"), F.count_if(c("score") >= 0.3).alias("selected")).first().asDict(), path)
    got = O.read(spark, path)
    return frame(spark, [(got["total"], got["selected"])], "total long, selected long")


@add("snk_06", "SELECT 'product' AS primary_score, 'vlm_ocr_product' AS formula, count(*) AS n, 1 AS manifests FROM score_rows", SR)
def snk_06(spark, d):
    folder = work_folder(spark, "scored")
    plain_scores(spark, d).write.parquet(f"{folder}/scores")
    X.score_sidecar(spark, f"{folder}/scores", PRODUCT, "product", [run_manifest(spark, folder, "scoring")])
    got = O.read(spark, X.sidecar_path(f"{folder}/scores"))
    row = (got["primary_score"], got["formula"]["name"], got["execution"]["scored_row_count"], len(got["source_manifest_sha256"]))
    return frame(spark, [row], "primary_score string, formula string, n long, manifests int")


@add("snk_07", "SELECT 'written' AS step, count(*) AS n FROM score_rows UNION ALL SELECT 'refused after a change', 1", SR)
def snk_07(spark, d):
    folder = work_folder(spark, "evaluated")
    hashes = X.manifest_hashes(spark, [run_manifest(spark, folder, "evaluation")])
    canonical(spark, d).write.option("ignoreNullFields", False).json(f"{folder}/scores.jsonl")
    done = X.evaluation_sidecar(spark, f"{folder}/scores.jsonl", DIAGNOSTIC, "product", hashes)
    run_manifest(spark, folder, "evaluation", steps=2)
    again = refused(lambda: X.evaluation_sidecar(spark, f"{folder}/scores.jsonl", DIAGNOSTIC, "product", hashes))
    return frame(spark, [("written", done["execution"]["scored_row_count"]), ("refused after a change", int(again))], "step string, n long")


@add("snk_08", "SELECT count(*) AS published, false AS partial FROM score_rows WHERE score >= 0.8", SR)
def snk_08(spark, d):
    """A wrong number of rows publishes nothing; the right one everything."""
    path, rows = work_folder(spark, "published"), S.threshold(scores(spark, d), 0.8).select("id", "version")
    n = rows.count()
    refused(lambda: Z.publish(rows, path, n + 1))
    partial = O.exists(spark, path) or O.exists(spark, f"{path}.unpublished")
    Z.publish(rows, path, n)
    return spark.read.json(path).agg(F.count("*").alias("published"), F.lit(partial).alias("partial"))


def _shards(spark, d, folder: str, lost: bool = False) -> list[str]:
    """One score table a run, as shards of one scoring run."""
    rows, manifest = plain_scores(spark, d), run_manifest(spark, folder, "scoring")
    total, out = rows.count(), []
    for k, run in enumerate("ANR"):
        path = f"{folder}/shard-{k}"
        part = rows.where(c("run") == run).drop("run")
        (part.where("version <> '0'") if lost and run == "N" else part).write.parquet(path)
        n = part.count()
        X.score_sidecar(spark, path, DIAGNOSTIC, "product", [manifest], {"shard_idx": k, "num_shards": 3, "discovered_task_count": total, "expected_shard_count": n})
        out.append(path)
    return out


@add(
    "snk_10",
    """SELECT CAST(row_number() OVER (ORDER BY run) - 1 AS INTEGER) AS shard_idx, count(*) AS n, (SELECT count(*) FROM score_rows) AS total, true AS lost_refused
    FROM (SELECT CASE run WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS run FROM score_rows) GROUP BY run""",
    SR,
)
def snk_10(spark, d):
    folder, other = work_folder(spark, "shards"), work_folder(spark, "shards")
    out = X.merge_shards(spark, _shards(spark, d, folder), f"{folder}/merged", 3, delete=True)
    lost = refused(lambda: X.merge_shards(spark, _shards(spark, d, other, lost=True), f"{other}/merged", 3))
    assert not O.exists(spark, f"{folder}/shard-0") and not O.exists(spark, f"{other}/merged")
    total = spark.read.parquet(f"{folder}/merged").count()
    return frame(spark, [(s["shard_idx"], s["rows"], total, lost) for s in out["execution"]["merged_shards"]], "shard_idx int, n long, total long, lost_refused boolean")


def _seeds(spark, d, folder: str, short: bool = False) -> dict[int, str]:
    rows, manifest, out = plain_scores(spark, d).drop("run"), run_manifest(spark, folder, "scoring"), {}
    for seed in (3, 11):
        path = f"{folder}/seed-{seed}"
        own = rows.withColumn("score", (c("score").cast("double") * seed).cast("string"))
        (own.where("version <> '0'") if short and seed == 11 else own).write.parquet(path)
        X.score_sidecar(spark, path, DIAGNOSTIC, "product", [manifest])
        out[seed] = path
    return out


@add("snk_09", "SELECT seed, count(*) AS n, round(sum(score * seed), 3) AS total, true AS short_refused FROM score_rows, (SELECT unnest([3, 11]) AS seed) GROUP BY seed", SR)
def snk_09(spark, d):
    folder, other = work_folder(spark, "seeds"), work_folder(spark, "seeds")
    out = X.aggregate_seeds(spark, _seeds(spark, d, folder), f"{folder}/all")
    assert out["execution"]["seeds"] == [3, 11] and O.read(spark, f"{folder}/all.aggregate.json") == out
    short = refused(lambda: X.aggregate_seeds(spark, _seeds(spark, d, other, short=True), f"{other}/all"))
    rows = spark.read.parquet(f"{folder}/all").groupBy("seed").agg(F.count("*").alias("n"), F.round(F.sum(c("score").cast("double")), 3).alias("total"))
    return rows.withColumn("short_refused", F.lit(short))


@add("jon_15", "SELECT coalesce(run, '') AS source, CASE run WHEN 'A' THEN 'linked' WHEN 'N' THEN 'changed' WHEN 'R' THEN 'auxiliary' ELSE 'unlinked' END AS state FROM (SELECT DISTINCT run FROM score_rows UNION ALL SELECT NULL)", SR)
def jon_15(spark, d):
    """The tables of three runs: A as listed, N changed since, R not listed; one listed manifest has no table."""
    folder = work_folder(spark, "linked")
    tables = []
    for run in "ANR":
        plain_scores(spark, d).where(c("run") == run).write.parquet(f"{folder}/{run}")
        X.score_sidecar(spark, f"{folder}/{run}", DIAGNOSTIC, "product", [run_manifest(spark, folder, f"of-{run}")])
        tables.append(f"{folder}/{run}")
    run_manifest(spark, folder, "of-N", steps=7)
    listed = [f"{folder}/of-A.json", f"{folder}/of-N.json", run_manifest(spark, folder, "alone")]
    return X.links(spark, tables, listed).select(F.coalesce(F.regexp_extract("table", "([^/]+)$", 1), F.lit("")).alias("source"), "state")


@add("prv_13", "SELECT 'product' AS primary_score, 'vlm_ocr_product' AS formula, count(*) AS n, true AS short_refused FROM score_rows", SR)
def prv_13(spark, d):
    folder = work_folder(spark, "benchmark")
    path, n = f"{folder}/scores", scores(spark, d).count()
    plain_scores(spark, d).write.parquet(path)
    X.score_sidecar(spark, path, PRODUCT, "product", [run_manifest(spark, folder, "scoring")])
    got = X.benchmark_contract(spark, path, n)
    short = refused(lambda: X.benchmark_contract(spark, path, n + 1))
    return frame(spark, [(got["primary_score"], got["formula"]["name"], got["rows"], short)], "primary_score string, formula string, n long, short_refused boolean")


@add(
    "val_09",
    """SELECT * FROM (VALUES ('good', 0, ''), ('more rows', 2, 'execution.scored_row_count,execution.scores_sha256'), ('manifest changed', 1, 'source_manifest_sha256'),
    ('unfinished', 1, 'execution.status'), ('no formula', 2, 'formula,formula'), ('no sidecar', 1, 'missing')) AS t(kind, n, fields)""",
)
def val_09(spark, d):
    folder, rows = work_folder(spark, "sidecars"), []
    manifest = run_manifest(spark, folder, "scoring")
    for k, kind in enumerate(("good", "more rows", "manifest changed", "unfinished", "no formula", "no sidecar")):
        path = f"{folder}/t{k}"
        plain_scores(spark, d).where("run = 'A'").write.parquet(path)
        own = X.score_sidecar(spark, path, DIAGNOSTIC, "product", [manifest])
        if kind == "more rows":
            plain_scores(spark, d).where("run = 'N'").write.mode("append").parquet(path)
        elif kind == "manifest changed":
            O.write(spark, own | {"source_manifest_sha256": {manifest: "0" * 64}}, X.sidecar_path(path))
        elif kind == "unfinished":
            O.write(spark, own | {"execution": own["execution"] | {"status": "in_progress"}}, X.sidecar_path(path))
        elif kind == "no formula":
            O.write(spark, {k: v for k, v in own.items() if k != "formula"}, X.sidecar_path(path))
        elif kind == "no sidecar":
            O.delete(spark, X.sidecar_path(path))
        errors = X.sidecar_errors(spark, path)
        rows.append((kind, len(errors), ",".join(e.split(":")[0] if kind != "no sidecar" else "missing" for e in errors)))
    return frame(spark, rows, "kind string, n int, fields string")


ROW_ERRORS = """SELECT error, count(*) AS n FROM (SELECT unnest([CASE WHEN partkey <= 100 THEN 'target_text is blank' END, CASE WHEN run = 'R' THEN 'detection_status is unknown' END]) AS error
  FROM scored_texts) WHERE error IS NOT NULL GROUP BY 1"""
add("sup_10", ROW_ERRORS, ST)(lambda s, d: Z.row_errors(canonical(s, d, damaged=True)).groupBy("error").agg(F.count("*").alias("n")))


@add("sup_11", "SELECT * FROM (VALUES (false, 0, 1), (true, 1, 0)) AS t(ready, errors, warnings)")
def sup_11(spark, d):
    path, rows = {"logs_dir": work_folder(spark, "nowhere")}, []
    for ready in (False, True):
        found = X._Stage(spark, "logs", path, ready)
        X.STAGES["logs"](found)
        rows.append((ready, len(found.report.errors), len(found.report.warnings)))
    return frame(spark, rows, "ready boolean, errors int, warnings int")


@add("sup_12", """SELECT * FROM (VALUES ('both', 'product', 'product', 'vlm_ocr_product', 2), ('vlm', 'diagnostic', 'vlm', 'diagnostic_geometric_mean', 1),
('ocr', 'diagnostic', 'ocr', 'diagnostic_geometric_mean', 1)) AS t(scorer, wanted, primary_score, formula, scorers)""")
def sup_12(spark, d):
    rows = []
    for scorer, wanted in (("both", "product"), ("vlm", "diagnostic"), ("ocr", "diagnostic")):
        formula, primary = X.choose_formula({"scorer": scorer, "product_formula": wanted, "vlm_model_id": "m", "vlm_model_revision": "r"})
        rows.append((scorer, wanted, primary, formula["name"], len(formula["scorer_versions"])))
    return frame(spark, rows, "scorer string, wanted string, primary_score string, formula string, scorers int")


@add("sup_13", "SELECT * FROM (VALUES ('changed'), ('gone')) AS t(name)")
def sup_13(spark, d):
    folder = work_folder(spark, "drift")
    hashes = X.manifest_hashes(spark, [run_manifest(spark, folder, n) for n in ("same", "changed", "gone")])
    run_manifest(spark, folder, "changed", steps=1)
    O.delete(spark, f"{folder}/gone.json")
    return frame(spark, [(p.rsplit("/", 1)[1].removesuffix(".json"),) for p in X.drifted(spark, hashes)], "name string")


@add("sup_14", "SELECT 7 AS seed, count(*) AS n, true AS changed_refused, true AS malformed_refused FROM score_rows WHERE run = 'A'", SR)
def sup_14(spark, d):
    folder = work_folder(spark, "seed")
    plain_scores(spark, d).where("run = 'A'").write.parquet(f"{folder}/s")
    X.score_sidecar(spark, f"{folder}/s", DIAGNOSTIC, "product", [run_manifest(spark, folder, "scoring")])
    seed, path = readers.seed_input(f"7={folder}/s")
    n = X.checked_sidecar(spark, path)["execution"]["scored_row_count"]
    plain_scores(spark, d).where("run = 'N'").write.mode("append").parquet(path)
    row = (seed, n, refused(lambda: X.checked_sidecar(spark, path)), refused(lambda: readers.seed_input(path)))
    return frame(spark, [row], "seed int, n long, changed_refused boolean, malformed_refused boolean")


@add("val_26", """SELECT * FROM (VALUES ('diagnostic', 'formula.name'), ('product', ''), ('weights', 'formula.weights'), ('vlm', 'primary_score')) AS t(kind, fields)""")
def val_26(spark, d):
    kinds = {
        "product": {"primary_score": "product", "formula": PRODUCT},
        "diagnostic": {"primary_score": "product", "formula": DIAGNOSTIC},
        "weights": {"primary_score": "product", "formula": PRODUCT | {"weights": {"score_vlm": 2.0, "score_ocr": 1.0}}},
        "vlm": {"primary_score": "vlm", "formula": PRODUCT},
    }
    return frame(spark, [(k, ",".join(e.split(":")[0] for e in X.product_errors(v))) for k, v in kinds.items()], "kind string, fields string")


# ---------------------------------------------------------------- layouts of files, one set a nation
def nations(spark, d) -> DataFrame:
    return A.table(spark, d, "nation").select(c("n_nationkey").cast("string").alias("id"), c("n_regionkey").alias("region"), c("n_name").alias("name"))


def generated_files(spark, d, root: str) -> None:
    """Two images and latents a nation and a text embedding; latents lack in region 1, text embeddings in region 2."""
    n = nations(spark, d)
    each = n.select("id", "region", "name", F.explode(F.array(F.lit(0), F.lit(1))).alias("v"))
    image = each.select(F.concat(F.lit(f"{root}/images/"), "id", F.lit("/v"), "v", F.lit(".png")).alias("path"), c("name").alias("content"))
    latent = each.where("region <> 1").select(F.concat(F.lit(f"{root}/latents/"), "id", F.lit("/v"), "v", F.lit(".pt")).alias("path"), c("name").alias("content"))
    text = n.where("region <> 2").select(F.concat(F.lit(f"{root}/text_embeds/"), "id", F.lit(".pt")).alias("path"), c("name").alias("content"))
    odd = n.limit(1).select(F.lit(f"{root}/images/x/v01.png").alias("path"), c("name").alias("content"))
    sinks.files(image.unionByName(latent).unionByName(text).unionByName(odd).coalesce(2)).count()


@add("src_17", "SELECT CAST(n_nationkey AS VARCHAR) AS id, v AS version, true AS none_refused FROM nation, (SELECT unnest([0, 1]) AS v) WHERE n_regionkey <> 2")
def src_17(spark, d):
    root = work_folder(spark, "generated")
    generated_files(spark, d, root)
    nothing = refused(lambda: readers.scoring_tasks(spark, f"{root}/latents", f"{root}/text_embeds"))
    return readers.scoring_tasks(spark, f"{root}/images", f"{root}/text_embeds").select("id", "version", F.lit(nothing).alias("none_refused"))


@add(
    "src_18",
    """SELECT 'images' AS layout, CAST(n_nationkey AS VARCHAR) AS id, 2 AS files FROM nation UNION ALL SELECT 'latents', CAST(n_nationkey AS VARCHAR), 2 FROM nation WHERE n_regionkey <> 1
    UNION ALL SELECT 'text_embeds', CAST(n_nationkey AS VARCHAR), 1 FROM nation WHERE n_regionkey <> 2""",
)
def src_18(spark, d):
    root = work_folder(spark, "generated")
    generated_files(spark, d, root)
    out = None
    for name, versioned, suffix in (("images", True, ".png"), ("latents", True, ".pt"), ("text_embeds", False, ".pt")):
        rows = readers.layout(readers.listing(spark, f"{root}/{name}", f"*{suffix}"), versioned, suffix).where("id is not null")
        part = rows.groupBy("id").agg(F.count("*").cast("int").alias("files")).select(F.lit(name).alias("layout"), "id", "files")
        out = part if out is None else out.unionByName(part)
    return out


@add("src_26", "SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_regionkey = 0 THEN NULL ELSE 64 END AS h FROM nation WHERE n_regionkey NOT IN (1, 2)")
def src_26(spark, d):
    """Latents lack in region 1 and text embeddings in region 2; shapes.csv says nothing of region 0."""
    root, n = work_folder(spark, "masked"), nations(spark, d)
    paths = [n.where(f"region <> {lacks}").select(F.concat(F.lit(f"{root}/{f}/"), "id", F.lit(".pt")).alias("path"), c("name").alias("content")) for f, lacks in (("latents", 1), ("text_embeds", 2))]
    sinks.files(paths[0].unionByName(paths[1]).coalesce(2)).count()
    n.where("region <> 0").select("id", F.lit(64).alias("H"), F.lit(32).alias("W")).write.option("header", True).csv(f"{root}/shapes.csv")
    return readers.masked_samples(spark, root).select("id", c("H").cast("int").alias("h"))


@add("src_27", "SELECT CAST(n_nationkey AS VARCHAR) AS id FROM nation WHERE n_regionkey <> 2 ORDER BY CAST(n_nationkey AS VARCHAR) LIMIT 7")
def src_27(spark, d):
    root = work_folder(spark, "generated")
    generated_files(spark, d, root)
    found = readers.head_of_folder(spark, f"{root}/text_embeds", 7)
    return found.select(F.regexp_extract("path", "([^/]+)\\.pt$", 1).alias("id"))


@add("snk_19", "SELECT layout, count(*) AS n FROM nation, (SELECT unnest(['flat', 'by-region']) AS layout) GROUP BY 1")
def snk_19(spark, d):
    root, n = work_folder(spark, "fan"), nations(spark, d)
    sinks.files(n.select(F.concat(F.lit(f"{root}/raw/"), "id", F.lit(".png")).alias("path"), c("name").alias("content")).coalesce(1)).count()
    layouts = F.array(F.concat(F.lit("flat/"), "id"), F.concat(F.lit("by-region/"), "region", F.lit("/"), "id"))
    wanted = n.select(F.concat(F.lit(f"{root}/raw/"), "id", F.lit(".png")).alias("path"), F.explode(layouts).alias("to"))
    sinks.fan_out(wanted.select("path", F.concat(F.lit(f"{root}/"), "to", F.lit(".png")).alias("target")).coalesce(2)).count()
    there = readers.listing(spark, root).select(F.regexp_extract("path", "/(flat|by-region)/", 1).alias("layout")).where("layout <> ''")
    return there.groupBy("layout").agg(F.count("*").alias("n"))


@add(
    "val_20",
    """SELECT stage, message FROM (SELECT 'generated' AS stage, count(*) || ' rows: images without a text embedding (first: ' || min(CAST(n_nationkey AS VARCHAR)) || ')' AS message FROM nation WHERE n_regionkey = 2
    UNION ALL SELECT 'generated', 2 * count(*) || ' rows: images without a latent (first: ' || min(n_nationkey || '/0') || ')' FROM nation WHERE n_regionkey = 1
    UNION ALL SELECT 'generated', '1 rows: name is not of the layout (.png)'
    UNION ALL SELECT 'scoring', count(*) || ' rows: images without a text embedding (first: ' || min(CAST(n_nationkey AS VARCHAR)) || ')' FROM nation WHERE n_regionkey = 2
    UNION ALL SELECT 'scoring', '1 rows: name is not of the layout (.png)'
    UNION ALL SELECT 'checkpoint', 'resume_lora: no weights' UNION ALL SELECT 'dpo', 'preference_pairs: not there')""",
)
def val_20(spark, d):
    root = work_folder(spark, "generated")
    generated_files(spark, d, root)
    paths = {"images_dir": f"{root}/images", "latents_dir": f"{root}/latents", "text_embeds_dir": f"{root}/text_embeds"}
    found = [("generated", e) for e in X.validate(spark, "generation", paths).errors]
    found += [("scoring", e) for e in X.validate(spark, "score_inputs", paths).errors]
    plain_scores(spark, d).where("run = 'A'").write.parquet(f"{root}/scores")
    training = paths | {"scores_csv": f"{root}/scores", "resume_lora": f"{root}/images/0", "preference_pairs": f"{root}/none.jsonl"}
    for e in X.validate(spark, "dpo", training).errors:
        found.append(("checkpoint", "resume_lora: no weights") if e.startswith("resume_lora") else ("dpo", "preference_pairs: not there"))
    rows = frame(spark, found, "stage string, message string")
    return rows.withColumn("message", F.regexp_replace("message", " \\(first: .*/x/v01.png\\)$", ""))


@add(
    "val_10",
    """WITH broken AS (SELECT count(*) AS n FROM prompts WHERE content_type = 'de'), bad AS (SELECT count(*) AS n FROM scored_texts WHERE partkey <= 100)
    SELECT stage, CASE WHEN stage = 'prompts' THEN (SELECT CASE WHEN n > 0 THEN 1 ELSE 0 END FROM broken) WHEN stage = 'score-outputs' THEN (SELECT CASE WHEN n > 0 THEN 2 ELSE 1 END FROM bad)
    WHEN stage IN ('no such stage', 'masked-sft') THEN 1 ELSE 0 END AS errors, CASE WHEN stage IN ('logs', 'checkpoints', 'evaluation', 'data_source_comparison') THEN 1 ELSE 0 END AS warnings
    FROM (SELECT unnest(['prompts', 'scores', 'score-outputs', 'generated', 'score_inputs', 'masked-sft', 'sft', 'dpo', 'synthetic', 'checkpoints', 'logs', 'evaluation', 'manifest',
    'dataset-manifest', 'prompt-quality', 'synthetic_quality', 'data_source_comparison', 'selected_samples', 'preference_pairs', 'no such stage']) AS stage)""",
    "prompts scored_texts",
)
def val_10(spark, d):
    """All stages over artifacts made from the tables; German prompts are broken lines, some canonical rows are damaged."""
    root = work_folder(spark, "stages")
    n = nations(spark, d)
    line = F.to_json(F.struct("id", c("target_text").alias("prompt"), F.concat(F.lit("t"), "id").alias("target_text")))
    shown = prompts(spark, d).where("trim(coalesce(target_text, '')) <> ''")
    shown.select(F.when(c("content_type") == "de", "{broken").otherwise(line).alias("value")).write.text(f"{root}/prompts.jsonl")
    plain_scores(spark, d).drop("run").write.option("header", True).csv(f"{root}/scores.csv")
    manifest = run_manifest(spark, root, "scoring")
    canonical(spark, d, damaged=True).where("sample_id is not null").write.option("ignoreNullFields", False).json(f"{root}/canonical.jsonl")
    X.score_sidecar(spark, f"{root}/canonical.jsonl", DIAGNOSTIC, "product", [manifest], kind=X.SCORE_FILES[1])
    each = n.select("id", "name", F.explode(F.array(F.lit(0), F.lit(1))).alias("v"))
    parts = [each.select(F.concat(F.lit(f"{root}/{f}/"), "id", F.lit("/v"), "v", F.lit(s)).alias("path"), c("name").alias("content")) for f, s in (("images", ".png"), ("latents", ".pt"))]
    parts += [n.select(F.concat(F.lit(f"{root}/{f}/"), "id", F.lit(".pt")).alias("path"), c("name").alias("content")) for f in ("text_embeds", "masked/latents")]
    parts += [n.where("id <> '3'").select(F.concat(F.lit(f"{root}/masked/text_embeds/"), "id", F.lit(".pt")).alias("path"), c("name").alias("content"))]
    n.select("id", F.lit(8).alias("H"), F.lit(8).alias("W")).write.option("header", True).csv(f"{root}/masked/shapes.csv")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    sinks.files(every.coalesce(4)).count()
    best = S.sample_rows(S.threshold(scores(spark, d), 0.8), "threshold", 0.8)
    sinks.json_rows(best.withColumn("schema_version", F.lit("selected-samples/v1")), f"{root}/selected.jsonl")
    sinks.json_rows(S.select_pairs(scores(spark, d), "best_vs_worst").withColumn("schema_version", F.lit("preference-pairs/v1")), f"{root}/pairs.jsonl")
    for key, (kind, fields) in X.REPORTS.items():
        if key != "data_source_comparison":
            O.write(spark, {"schema_version": kind, **dict.fromkeys(fields, [])}, f"{root}/{key}.json")
    layout = {"images_dir": f"{root}/images", "latents_dir": f"{root}/latents", "text_embeds_dir": f"{root}/text_embeds"}
    lines = {"selected_samples": f"{root}/selected.jsonl", "preference_pairs": f"{root}/pairs.jsonl"}
    reports = {key: f"{root}/{key}.json" for key in X.REPORTS}
    given = {
        "prompts": {"prompts_jsonl": f"{root}/prompts.jsonl"}, "scores": {"scores_csv": f"{root}/scores.csv"}, "score-outputs": {"scores_jsonl": f"{root}/canonical.jsonl"},
        "generated": layout, "score_inputs": layout, "masked-sft": {"data_dir": f"{root}/masked"}, "sft": layout | {"scores_csv": f"{root}/scores.csv", "selected_samples": lines["selected_samples"]},
        "dpo": layout | {"scores_csv": f"{root}/scores.csv", "preference_pairs": lines["preference_pairs"]}, "synthetic": {"raw_dir": f"{root}/images"} | reports, "checkpoints": {"checkpoints_dir": f"{root}/none"},
        "logs": {"logs_dir": f"{root}/none"}, "evaluation": {"outputs_dir": f"{root}/none", "scores_csv": f"{root}/scores.csv"}, "manifest": {"manifest_json": manifest},
        "dataset-manifest": reports, "prompt-quality": reports, "synthetic_quality": reports, "data_source_comparison": reports, "selected_samples": lines, "preference_pairs": lines, "no such stage": {},
    }
    rows = [(stage, len(r.errors), len(r.warnings)) for stage, paths in given.items() for r in [X.validate(spark, stage, paths)]]
    return frame(spark, rows, "stage string, errors int, warnings int")


# ---------------------------------------------------------------- scans that may lack files or lines
@add("src_10", "SELECT count(*) FILTER (style IS DISTINCT FROM 'web') AS records, count(*) FILTER (style = 'web') AS malformed, 0 AS absent FROM prompts", PR)
def src_10(spark, d):
    """Evidence lines of which those of one source are broken, and evidence that is not there at all."""
    from pyspark.sql import types as Y

    path = work_folder(spark, "evidence")
    line = F.to_json(F.struct("id", "content_type"))
    prompts(spark, d).select(F.when(c("style") == "web", F.concat(line, F.lit("}"))).otherwise(line).alias("value")).write.text(path)
    good, bad = readers.json_lines(spark, path, Y.StructType([Y.StructField("id", Y.LongType()), Y.StructField("content_type", Y.StringType())]))
    absent = readers.optional(spark, f"{path}-none.jsonl", "id string").count()
    counts = good.select(F.lit(1).alias("g"), F.lit(0).alias("b")).unionAll(bad.select(F.lit(0), F.lit(1)))
    return counts.agg(F.sum("g").alias("records"), F.sum("b").alias("malformed"), F.lit(absent).alias("absent"))


@add(
    "src_14",
    """SELECT k AS id, max(p_partkey) AS last, max(p_size) FILTER (p_partkey = m) AS h, 0 AS absent FROM (SELECT p_type AS k, p_partkey, p_size, max(p_partkey) OVER (PARTITION BY p_type) AS m FROM part) GROUP BY 1""",
)
def src_14(spark, d):
    """Index and shapes of one id each by the last row that names it; prompts that are not there are empty."""
    folder, part = work_folder(spark, "synthetic"), A.table(spark, d, "part")
    rows = part.select(c("p_type").alias("id"), c("p_partkey").alias("position"), c("p_size").alias("H"))
    rows.select("id", "position").write.option("header", True).csv(f"{folder}/index.csv")
    rows.write.json(f"{folder}/shapes.jsonl")
    index = Q.last_wins(readers.optional(spark, f"{folder}/index.csv", "id string, position string").withColumn("k", c("position").cast("long")), ["id"], "k")
    shapes = Q.last_wins(readers.optional(spark, f"{folder}/shapes.jsonl", "id string, position string, H string").withColumn("k", c("position").cast("long")), ["id"], "k")
    none = readers.optional(spark, f"{folder}/prompts.jsonl", "id string, prompt string").count()
    return index.select("id", c("k").alias("last")).join(shapes.select("id", c("H").cast("int").alias("h")), "id").withColumn("absent", F.lit(none))


@add("src_16", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_size AS resolution, p_name || ' | ' || p_brand AS text, true AS twice_refused FROM part WHERE p_size > 10 AND p_size % 2 = 0")
def src_16(spark, d):
    """Small parts have no document, parts of odd size one without annotations."""
    folder, part = work_folder(spark, "raw"), A.table(spark, d, "part")
    part.select(c("p_partkey").cast("string").alias("id"), c("p_size").alias("resolution_index")).write.json(f"{folder}/index.jsonl")
    notes = F.when(c("p_size") % 2 == 0, F.array(F.struct(c("p_name").alias("text")), F.struct(c("p_brand").alias("text")))).otherwise(F.array().cast("array<struct<text:string>>"))
    document = F.to_json(F.struct(c("p_size").alias("resolution"), notes.alias("annotations")))
    part.where("p_size > 10").select(c("p_partkey").cast("string").alias("id"), document.alias("value")).write.json(f"{folder}/meta.jsonl")
    index, meta = readers.records(spark, f"{folder}/index.jsonl"), readers.records(spark, f"{folder}/meta.jsonl")
    clash = index.limit(1).withColumn("id", F.lit("A")).unionByName(index.limit(1).withColumn("id", F.lit("a")))
    twice = refused(lambda: readers.synthetic_records(index.unionByName(clash), meta))
    found = sinks.masked_index(readers.synthetic_records(index, meta).select("id", "resolution", "annotations"))
    sized = readers.synthetic_records(index, meta).select("id", "resolution")
    return sized.join(found.select("id", "text"), "id").withColumn("twice_refused", F.lit(twice))


@add(
    "src_25",
    """SELECT 'threshold' AS mode, count(*) AS n FROM score_rows WHERE score >= 0.7 UNION ALL SELECT 'materialised', count(*) FROM score_rows WHERE score >= 0.7
    UNION ALL SELECT 'pairs', count(*) FROM best WHERE n >= 2 AND b.s >= 0.5 AND b.s - w.s >= 0.1 UNION ALL SELECT 'materialised pairs', count(*) FROM pairs""",
    "score_rows pairs",
)
def src_25(spark, d):
    """All four ways a trainer reads its samples; rows that were written are checked against their scores when read."""
    r, folder = scores(spark, d), work_folder(spark, "training")
    sinks.json_rows(S.sample_rows(S.threshold(r, 0.7), "threshold", 0.7), f"{folder}/samples")
    sinks.json_rows(S.select_pairs(r, "best_vs_worst"), f"{folder}/pairs")
    samples, chosen = spark.read.json(f"{folder}/samples"), spark.read.json(f"{folder}/pairs")
    if not S.violations_of_samples(samples, r, 0.7).isEmpty() or not S.violations_of_pairs(chosen, r, 0.5, 0.1).isEmpty():
        raise readers.ContractError("written rows differ from their scores")
    modes = {"threshold": S.threshold(r, 0.7), "materialised": samples, "pairs": S.select_pairs(r, "loader"), "materialised pairs": chosen}
    out = None
    for name, rows in modes.items():
        part = rows.agg(F.lit(name).alias("mode"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


on(
    scores, "val_14", "SELECT 'sft:' || id || ':v' || version || ':score' AS sample_id, CASE WHEN run = 'A' THEN 'changed' ELSE 'missing' END AS violation FROM score_rows WHERE score >= 0.3 AND run IN ('A', 'R')", SR,
    lambda r: S.violations_of_samples(
        S.sample_rows(S.threshold(r, 0.3), "threshold", 0.3), r.where("run <> 'R'").withColumn("score", c("score") + F.when(c("run") == "A", 0.01).otherwise(0.0)), 0.3
    ).select("sample_id", "violation"),
)
on(
    scores, "val_15",
    """SELECT pair_id, CASE WHEN winner_version % 3 = 0 THEN 'inverted' ELSE 'below_threshold' END AS violation FROM pairs WHERE winner_version % 3 = 0 OR winner_score < 0.6""", "pairs",
    lambda r: _damaged_pairs(r),
)


def _damaged_pairs(r: DataFrame) -> DataFrame:
    """Pairs whose winner has a version divisible by three are written the wrong way round; the bar is raised afterwards."""
    p = S.select_pairs(r, "best_vs_worst")
    swap = c("winner_version") % 3 == 0
    sides = {f"{a}_{x}": F.when(swap, c(f"{b}_{x}")).otherwise(c(f"{a}_{x}")) for a, b in (("winner", "loser"), ("loser", "winner")) for x in ("version", "score")}
    return S.violations_of_pairs(p.withColumns(sides), r, 0.6, 0.1).select("pair_id", "violation")


# ---------------------------------------------------------------- diagnostics
SCORED = """(SELECT sample_id, target_text, detected_text, round(1 - abs(length(target_text) - length(detected_text)) / greatest(length(target_text), length(detected_text)), 6) AS score_vlm,
  CASE WHEN length(detected_text) % 7 = 0 THEN NULL ELSE (length(detected_text) % 10) / 10.0 END AS score_ocr, length(target_text) / 100.0 AS cer FROM text_pairs)"""
SECTIONS = f"""WITH r AS (SELECT x.*, g.human_label FROM {SCORED} x LEFT JOIN gold g ON g.sample_id = x.sample_id),
  k AS (SELECT *, CASE WHEN score_vlm >= 0.9 AND coalesce(human_label = 'pass', false) = false THEN 'false_positive' WHEN score_vlm <= 0.6 AND human_label = 'pass' THEN 'false_negative' END AS kind FROM r),
  w AS (SELECT *, list_filter(string_split(trim(target_text), ' '), lambda t: t <> '') AS ws FROM k),
  l AS (SELECT *, list_filter([CASE WHEN len(ws) >= 2 THEN 'multi_word_phrase' WHEN len(ws) = 1 THEN 'short_word' END, CASE WHEN len(list_filter(ws, lambda t: length({STRIP.format('t')}) >= 10)) > 0 THEN 'long_word' END], lambda t: t IS NOT NULL) AS labels FROM w),
  e AS (SELECT *, unnest(CASE WHEN len(labels) = 0 THEN ['unsliced'] ELSE labels END) AS slice FROM l)
SELECT 'counts' AS section, 'total' AS key, CAST(count(*) AS VARCHAR) AS value FROM r UNION ALL SELECT 'counts', 'with_both', CAST(count(score_ocr) AS VARCHAR) FROM r
UNION ALL SELECT 'counts', 'missing_evidence', CAST(count(*) - count(score_ocr) AS VARCHAR) FROM r
UNION ALL SELECT 'missing', 'score_ocr', CAST(count(*) AS VARCHAR) FROM r WHERE score_ocr IS NULL HAVING count(*) > 0
UNION ALL SELECT 'false_rows', kind, CAST(count(*) AS VARCHAR) FROM k WHERE kind IS NOT NULL GROUP BY kind
UNION ALL SELECT 'slices', slice || '/records', CAST(count(*) AS VARCHAR) FROM e GROUP BY slice
UNION ALL SELECT 'slices', slice || '/false_positives', CAST(count(*) FILTER (kind = 'false_positive') AS VARCHAR) FROM e GROUP BY slice
UNION ALL SELECT 'slices', slice || '/false_negatives', CAST(count(*) FILTER (kind = 'false_negative') AS VARCHAR) FROM e GROUP BY slice
UNION ALL SELECT 'slices', slice || '/missing_evidence', CAST(count(*) FILTER (score_ocr IS NULL) AS VARCHAR) FROM e GROUP BY slice"""


def disagreement(spark, d) -> dict[str, DataFrame]:
    p, n, m = pairs(spark, d), F.length("target_text"), F.length("detected_text")
    rows = p.withColumns({
        "score_vlm": F.round(1 - F.abs(n - m) / F.greatest(n, m), 6), "score_ocr": F.when(m % 7 != 0, (m % 10) / 10.0), "cer": n / 100.0,
        "exact_match": F.lit(False),
    })
    labels = F.filter(T.slice_labels(c("target_text")), lambda x: x.isin(*[s for s in SHOWN if not s.startswith("has_")]))
    return D.report(rows.withColumn("score", c("score_vlm")), A.gold(spark, d), 0.9, 0.6, labels)


add("sup_01", SECTIONS, "text_pairs gold")(lambda s, d: D.summary(disagreement(s, d)))
add(
    "snk_16",
    f"""SELECT sample_id, kind, kind || ' | ' || sample_id || ' | ' || printf('%.3f', score_vlm) AS caption FROM (SELECT x.*, CASE WHEN score_vlm >= 0.9 AND coalesce(human_label = 'pass', false) = false THEN 'false_positive'
    WHEN score_vlm <= 0.6 AND human_label = 'pass' THEN 'false_negative' END AS kind FROM {SCORED} x LEFT JOIN gold g ON g.sample_id = x.sample_id) WHERE kind IS NOT NULL
    ORDER BY kind DESC, CASE WHEN kind = 'false_positive' THEN -score_vlm ELSE score_vlm END, sample_id LIMIT 12""",
    "text_pairs gold",
)(lambda s, d: D.sheet(disagreement(s, d)["false_rows"]))
on(scores, "sup_02", "SELECT id, version, CASE WHEN run = 'A' THEN NULL ELSE score END AS s FROM score_rows", SR, lambda r: (lambda q: q.select("id", "version", D.diagnostic_score(q).alias("s")))(r.withColumn("product_score", F.when(c("run") != "A", c("score")))))


@add(
    "sup_03",
    """SELECT missing || ' of ' || total || ' gold samples have no prediction' AS finding FROM (SELECT count(*) AS total, count(*) FILTER (p.id IS NULL) AS missing FROM gold g LEFT JOIN (SELECT id FROM prompts WHERE content_type = 'en') p ON p.id = g.sample_id) WHERE missing > 0
    UNION ALL SELECT 'exact match: agreement of ' || printf('%.3f', a) || ' is below 0.9' FROM (SELECT avg(CASE WHEN (n_chars > 1000) = expected_exact_match THEN 1.0 ELSE 0.0 END) AS a FROM gold g JOIN prompts p ON p.id = g.sample_id WHERE content_type = 'en') WHERE a < 0.9
    UNION ALL SELECT 'detection: nothing to compare'""",
    "gold prompts",
)
def sup_03(spark, d):
    g = A.gold(spark, d).withColumns({"expected_ocr_detected": F.lit(None).cast("boolean"), "target_text": F.lit("x")})
    p = prompts(spark, d).where("content_type = 'en'").select(
        c("id").alias("sample_id"), (c("n_chars") > 1000).alias("exact_text_match"), F.lit(True).alias("ocr_detected"), F.lit("x").alias("detected_text"), F.lit(0).alias("position")
    )
    got = R.gold_report(g, p).first()
    compared = got.exact_agree + got.exact_disagree
    found = B.findings(got.total, got.missing, got.exact_agree / compared if compared else None, None, 1.0)
    return frame(spark, [(x,) for x in found], "finding string")


# ---------------------------------------------------------------- sources of training data
DISTS = """SELECT 'content_type' AS dimension, 'generated' AS source, coalesce(content_type, 'unknown') AS value, CAST(count(*) AS DOUBLE) AS number FROM prompts GROUP BY ALL
UNION ALL SELECT 'style', 'generated', coalesce(style, 'unknown'), count(*) FROM prompts GROUP BY ALL
UNION ALL SELECT 'style', 'synthetic', 'font.' || p_brand, count(*) FROM part GROUP BY ALL UNION ALL SELECT 'resolution', 'synthetic', p_size || 'x' || p_size, count(*) FROM part GROUP BY ALL"""


@add("sup_05", DISTS, PR)
def sup_05(spark, d):
    def counts(rows: DataFrame, key) -> dict:
        return {r.k: r["count"] for r in rows.groupBy(F.coalesce(key, F.lit("unknown")).alias("k")).count().collect()}  # one row a label

    folder, p, part = work_folder(spark, "sources"), prompts(spark, d), A.table(spark, d, "part")
    O.write(spark, {"content_type_distribution": counts(p, c("content_type")), "style_distribution": counts(p, c("style"))}, f"{folder}/prompts.json")
    O.write(spark, {"font_coverage": counts(part, c("p_brand")), "resolution_distribution": counts(part, Q.resolution_key(c("p_size"), F.lit(None), F.lit(None)))}, f"{folder}/synthetic.json")
    both = B.compare_sources(spark, O.read(spark, f"{folder}/prompts.json"), O.read(spark, f"{folder}/synthetic.json"))
    assert both["health"]["ocr_summary"] is None and both["health"]["contrast"] == {}
    return B.distribution_frame(spark, both)


@add("sup_06", "SELECT * FROM (VALUES (0, 'prompts', 'available'), (1, 'pairs', 'missing'), (2, 'synthetic', 'available')) AS t(position, name, state)")
def sup_06(spark, d):
    folder = work_folder(spark, "evidence")
    for name in ("prompts", "synthetic"):
        O.write(spark, {}, f"{folder}/{name}.json")
    return B.provenance(spark, {n: f"{folder}/{n}.json" for n in ("prompts", "pairs", "synthetic")}).select("position", "name", "state")


@add("sup_07", "SELECT * FROM (VALUES ('generated', 2, 3), ('synthetic', 2, 3)) AS t(source, helps, fails)")
def sup_07(spark, d):
    both = B.compare_sources(spark, None, None)
    return frame(spark, [(s, len(both["expected_help"][s]), len(both["expected_failure"][s])) for s in B.SOURCES], "source string, helps int, fails int")


on(prompts, "sup_08", "SELECT content_type, count(*) AS count FROM prompts WHERE content_type <> '' GROUP BY 1", PR, lambda p: Q.content_types(p))
on(
    prompts, "sup_09", "SELECT k AS position, ch AS char, len(list_filter([1], lambda x: true)) AS fields, (SELECT count(*) FROM prompts WHERE contains(lower(target_text), ch)) > 0 AS there FROM (VALUES (0, 'ñ'), (1, 'ß'), (2, 'q')) v(k, ch)", PR,
    lambda p: _required(p, {"required_rare_characters": ["Ñ", "ß", "ñ", "Q"], "required_fields": ["target_text"]}),
)


def _required(p: DataFrame, thresholds: dict) -> DataFrame:
    found = Q.required_coverage(Q.character_counts(p, c("target_text")), "".join(Q.required_letters(thresholds)))
    return found.select(c("position").cast("int").alias("position"), "char", F.lit(len(Q.required_fields(thresholds))).cast("long").alias("fields"), (c("count") > 0).alias("there"))


# ---------------------------------------------------------------- curricula
CONFIG = {
    "schema_version": "prompt-generation-config/v1", "mode": "curriculum", "seed": 7, "output_path": "data/prompts.jsonl", "generation": {"n": 2000},
    "curriculum_stages": [
        {"name": "letters", "family": "single_letters", "sample_count": 500, "scripts": ["cyrillic", "latin"]},
        {"name": "lines", "family": "multiline", "weight": 3.0, "cases": ["upper"], "content_types": ["sign"]},
        {"name": "mixed", "family": "mixed_case", "weight": 2.0, "tiers": [5], "languages": ["ru", "en"]},
    ],
}


@add(
    "val_22",
    """SELECT * FROM (VALUES ('curriculum_stages: names repeat'), ('curriculum_stages: sample counts exceed generation.n'), ('curriculum_stages[0].family: unknown'), ('curriculum_stages[1].scripts: a single letter can''t be mixed'),
    ('curriculum_stages[1].tiers: 1 to 5'), ('output_path: a path below data, outputs, runs is needed'), ('seed: a whole number from 0 is needed')) AS t(error)""",
)
def val_22(spark, d):
    bad = CONFIG | {"seed": -1, "output_path": "../x", "curriculum_stages": [
        {"name": "a", "family": "riddles", "sample_count": 3000}, {"name": "a", "family": "single_letters", "scripts": ["mixed"], "tiers": [9]},
    ]}
    path = work_folder(spark, "curriculum") + ".json"
    O.write(spark, CONFIG, path)
    assert U.errors(O.read(spark, path)) == []
    return frame(spark, [(e,) for e in U.errors(bad)], "error string")


@add("sup_16", """SELECT * FROM (VALUES ('whole', 'letters', 500, 0), ('whole', 'lines', 900, 500), ('whole', 'mixed', 600, 1400), ('short', 'letters', 500, 0), ('short', 'unallocated', 1500, 500)) AS t(plan, stage_name, n, first)""")
def sup_16(spark, d):
    """A plan that weights fill up, and one whose fixed counts leave rows for the fallback."""
    short = CONFIG | {"curriculum_stages": CONFIG["curriculum_stages"][:1]}
    rows = U.plan(spark, U.parse(CONFIG)).withColumn("plan", F.lit("whole")).unionByName(U.plan(spark, U.parse(short)).withColumn("plan", F.lit("short")))
    return rows.groupBy("plan", "stage_name").agg(F.count("*").cast("int").alias("n"), F.min("position").cast("int").alias("first"))


DRAWN = """SELECT stage_name, array_to_string(list_sort(types), ',') AS types, array_to_string(list_sort(tiers), ',') AS tiers, array_to_string(list_sort(cases), ',') AS cases, array_to_string(list_sort(langs), ',') AS langs FROM (VALUES {0}) AS t(stage_name, types, tiers, cases, langs)"""


def _drawn(spark, curriculum) -> DataFrame:
    rows = U.stage_metadata(U.plan(spark, curriculum), curriculum)
    listed = [F.array_join(F.array_sort(F.collect_set(c(x).cast("string"))), ",").alias(n) for x, n in (("content_type", "types"), ("tier", "tiers"), ("case", "cases"), ("lang", "langs"))]
    return rows.groupBy("stage_name").agg(*listed)


@add("sup_17", DRAWN.format("('letters', ['sign', 'label', 'poster'], ['1'], ['upper', 'title', 'lower'], ['ru']), ('lines', ['sign'], ['4', '5'], ['upper'], ['ru']), ('mixed', ['sign', 'label', 'poster'], ['5'], ['mixed', 'title'], ['ru', 'en'])"))
def sup_17(spark, d):
    """What is drawn of each stage: given values, else those of its family."""
    return _drawn(spark, U.parse(CONFIG))


@add("sup_18", DRAWN.format("('letters', ['label'], ['1', '2'], ['upper', 'title'], ['ru']), ('lines', ['label'], ['1', '2'], ['upper', 'title'], ['ru']), ('mixed', ['label'], ['1', '2'], ['upper', 'title'], ['ru'])"))
def sup_18(spark, d):
    return _drawn(spark, U.simple_profile(U.parse(CONFIG), {"label": 1.0}))


@add("sup_19", "SELECT * FROM (VALUES ('letters', 500), ('lines', 900), ('mixed', 600)) AS t(name, samples)")
def sup_19(spark, d):
    got = U.settings(spark, U.parse(CONFIG))
    assert got["mode"] == "curriculum" and set(got["content_type_weights"]) == {"sign", "label", "poster"}
    return frame(spark, list(got["stage_allocations"].items()), "name string, samples int")


@add("sup_37", "SELECT content_type AS shape, count(*) // 8 AS batches, 3 AS fonts FROM prompts GROUP BY 1 HAVING count(*) >= 64", PR)
def sup_37(spark, d):
    """Full batches of one shape an epoch, and how many of three fonts their rows draw."""
    rows = U.styles(prompts(spark, d).select(c("content_type").alias("shape"), c("id").alias("sample")), "sample", {"font": ["serif", "mono", "hand"]}, 5)
    got = batches_by_shape(rows, 8, 1, 0).groupBy("shape").agg(F.count_distinct("batch").alias("batches"), F.count_distinct("font").cast("int").alias("fonts"), F.count("*").alias("n"))
    return got.join(rows.groupBy("shape").count().where("count >= 64").select(c("shape").alias("s")), c("shape").eqNullSafe(c("s")), "left_semi").select("shape", "batches", "fonts")


LETTERS = "abcdefghijklmnopqrstuvwxyz"
add(
    "mth_14",
    f"""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part), l AS (SELECT unnest(string_split('{LETTERS}', '')) AS ch),
    e AS (SELECT word, ch FROM (SELECT word, unnest(list_distinct(string_split(lower(word), ''))) AS ch FROM w) SEMI JOIN l USING (ch)),
    n AS (SELECT ch, count(*) AS n FROM e GROUP BY 1), p AS (SELECT ch, count(*) AS c FROM (SELECT unnest(string_split(lower(p_type), '')) AS ch FROM part) SEMI JOIN l USING (ch) GROUP BY 1),
    f AS (SELECT l.ch, (SELECT max(n) FROM n) / coalesce(n.n, 1) AS rarity, coalesce(p.c, 0) / ((SELECT sum(c) FROM p) / 26) AS share, CASE WHEN l.ch IN ('q', 'w') THEN 1.5 ELSE 1.0 END AS render FROM l LEFT JOIN n USING (ch) LEFT JOIN p USING (ch))
    SELECT word, round(max(rarity) * product(CASE WHEN share < 0.5 THEN 2.0 WHEN share < 0.7 THEN 1.6 WHEN share < 1.0 THEN 1.2 ELSE 1.0 END) * max(render), 4) AS weight FROM e JOIN f USING (ch) GROUP BY 1""",
)(lambda s, d: _weights(s, d))


def _weights(spark, d) -> DataFrame:
    part = A.table(spark, d, "part")
    words = part.select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    placed = Q.character_counts(part, c("p_type"))
    return U.word_weights(words, placed, LETTERS, {"q": 1.5, "w": 1.5}).select("word", F.round("weight", 4).alias("weight"))


# ---------------------------------------------------------------- formulas kept in one place
add("prj_10", "SELECT p_partkey, CASE WHEN p_size <= 20 THEN p_size || 'x' || p_size WHEN p_size <= 40 THEN 'latent-' || p_size || 'x8' ELSE '640x' || p_size END AS k FROM part")(
    lambda s, d: A.table(s, d, "part").select(
        "p_partkey",
        Q.resolution_key(F.when(c("p_size") <= 20, c("p_size")), F.when((c("p_size") > 20) & (c("p_size") <= 40), F.struct(c("p_size").alias("H"), F.lit(8).alias("W"))), F.struct(F.lit(640).alias("W"), c("p_size").alias("H"))).alias("k"),
    )
)
on(
    prompts, "prj_11", "SELECT id, target_text, CASE WHEN style = 'web' THEN 'item-' || id ELSE style END AS name FROM prompts ORDER BY id LIMIT 20", PR,
    lambda p: Q.eval_items(p.select("id", c("target_text").alias("target"), F.when(c("style") != "web", c("style")).alias("name")), 20),
)
on(
    prompts, "val_03", "SELECT id, CASE WHEN length(target_text) < 10 THEN 'too_short' WHEN length(target_text) > 200 THEN 'too_long' END AS warning FROM prompts WHERE length(target_text) < 10 OR length(target_text) > 200", PR,
    lambda p: p.select("id", Q.length_warning(c("target_text"), 10, 200).alias("warning")).where("warning is not null"),
)
add("mth_16", "SELECT p_partkey, round((p_size / 50.0) * 0.5, 6) AS area, round(p_size / 50.0, 6) AS width, 0.5 AS height, round(abs(p_size - 25) / 255.0, 6) AS contrast FROM part")(
    lambda s, d: A.table(s, d, "part").select("p_partkey", Q.box_fractions(F.array(F.lit(10.0), F.lit(20.0), 10.0 + c("p_size"), F.lit(70.0)), F.lit(50), F.lit(100)).alias("b"), Q.contrast(c("p_size"), F.lit(25)).alias("contrast")).select("p_partkey", F.round("b.area", 6).alias("area"), F.round("b.width", 6).alias("width"), F.round("b.height", 6).alias("height"), F.round("contrast", 6).alias("contrast"))
)
add(
    "agg_46", "SELECT event_type, round(avg(m), 6) AS loss, count(*) AS anchors FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY 1, 2) GROUP BY 1",
)(lambda s, d: R.validation_loss(A.table(s, d, "events").select("event_type", c("user_id").alias("anchor"), c("value").alias("loss")), ["event_type"]))
on(
    scores, "sup_33", "SELECT run, round(avg(CASE WHEN z >= 0 THEN ln(1 + exp(-abs(z))) ELSE ln(1 + exp(-abs(z))) - z END), 6) AS loss, round(avg(z), 6) AS margin, round(avg(CASE WHEN z > 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM (SELECT run, 2.0 * ((score_vlm - score_ocr) - (0.5 - score_ocr)) AS z FROM score_rows) GROUP BY 1", SR,
    lambda r: R.preference_metrics(r.select("run", c("score_ocr").alias("winner_policy"), c("score_ocr").alias("loser_policy"), c("score_vlm").alias("winner_reference"), F.lit(0.5).alias("loser_reference")), 2.0, ["run"]),
)
on(
    scores, "sup_34", "SELECT id, version, round(score_vlm * score_ocr, 6) AS score, true AS complete, 0 AS missing, score_vlm >= 0.5 AS good FROM score_rows", SR,
    lambda r: r.select("id", "version", M.result(M.Formula({"score_vlm": 1.0, "score_ocr": 1.0}, {"score_vlm_min": 0.5}, product=True, require_all=True)).alias("r")).select("id", "version", F.round("r.score", 6).alias("score"), "r.complete", F.size("r.missing").alias("missing"), c("r.flags")["score_vlm_min"].alias("good")),
)


# ---------------------------------------------------------------- generation contracts
MODEL = {"model_id": "m", "model_revision": "a" * 40, "versions": 2, "steps": 50}


def _prompt_file(spark, d, folder: str, changed: bool = False) -> str:
    """A nation's name is its prompt; one file in key order, a contract-size input."""
    n = A.table(spark, d, "nation").orderBy("n_nationkey")
    name = F.when(c("n_nationkey") == 3, "changed").otherwise(c("n_name")) if changed else c("n_name")
    path = f"{folder}/prompts-{int(changed)}.jsonl"
    n.select(F.to_json(F.struct(c("n_nationkey").cast("string").alias("id"), name.alias("target_text"))).alias("value")).coalesce(1).write.text(path)
    return path


def _contract(spark, d, folder: str) -> dict:
    return G.build(spark, MODEL, _prompt_file(spark, d, folder), f"{folder}/out")


@add("sup_22", """SELECT kind, count(*) AS expected, count(*) FILTER (there) AS there FROM (SELECT 'image' AS kind, true AS there, n_nationkey FROM nation, (SELECT unnest([0, 1]) AS v)
UNION ALL SELECT 'latent', n_regionkey <> 1, n_nationkey FROM nation, (SELECT unnest([0, 1]) AS v) UNION ALL SELECT 'text_embed', n_regionkey <> 2, n_nationkey FROM nation) GROUP BY 1""")
def sup_22(spark, d):
    root = work_folder(spark, "generated")
    generated_files(spark, d, root)
    state = G.path_state(spark, G.expected_paths(nations(spark, d), 2, root), root)
    return state.groupBy("kind").agg(F.count("*").alias("expected"), F.count("length").alias("there"))


@add("sup_24", "SELECT count(*) FILTER (n_regionkey = 2) AS missing_first, 0 AS missing_then, 'complete' AS status FROM nation")
def sup_24(spark, d):
    """A first completion record lacks files; when they are there a second one replaces it."""
    folder = work_folder(spark, "generation")
    root, n = f"{folder}/out", nations(spark, d)
    generated_files(spark, d, root)
    made = G.build(spark, MODEL, _prompt_file(spark, d, folder), root)
    expected = G.expected_paths(n, 2, root)
    first = G.complete(made, G.path_state(spark, expected, root), "run.json")
    assert first["completion"]["status"] == "in_progress"
    lacking = G.path_state(spark, expected, root).where("length is null").select(F.concat(F.lit("file://" if root.startswith("file:") else ""), "path").alias("path"), F.lit("x").alias("content"))
    sinks.files(lacking).count()
    then = G.complete(first, G.path_state(spark, expected, root), "run.json")["completion"]
    return frame(spark, [(first["completion"]["missing"]["text_embed"], sum(then["missing"].values()), then["status"])], "missing_first long, missing_then int, status string")


@add("sup_21", "SELECT * FROM (VALUES ('sha256'), ('slice_sha256')) AS t(field)")
def sup_21(spark, d):
    folder = work_folder(spark, "generation")
    source = _contract(spark, d, folder)["contract"]["prompt_source"]
    assert G.source_changes(spark, source) == []
    return frame(spark, [(x,) for x in G.source_changes(spark, source | {"path": _prompt_file(spark, d, folder, changed=True)})], "field string")


@add("prv_03", """SELECT count(*) AS prompts, 2 * count(*) AS images, 'completion.status: not complete' AS planned, 'contract_sha256: the contract has changed,prompt_source.slice_records: has changed,prompt_source.slice_sha256: has changed' AS altered FROM nation""")
def prv_03(spark, d):
    made = _contract(spark, d, work_folder(spark, "generation"))
    contract = made["contract"]
    source = contract["prompt_source"] | {"slice_records": 1, "slice_sha256": ""}
    altered = G.errors(spark, made | {"contract": contract | {"prompt_source": source}}, finished=False)
    row = (contract["expected"]["text_embed"], contract["expected"]["image"], ",".join(G.errors(spark, made)), ",".join(altered))
    return frame(spark, [row], "prompts long, images long, planned string, altered string")


@add("sup_23", "SELECT * FROM (VALUES ('siblings', 'other.json'), ('difference', 'settings.steps'), ('identity', 'file'), ('identity', 'folder'), ('identity', 'missing'), ('same', 'true')) AS t(what, value)")
def sup_23(spark, d):
    folder = work_folder(spark, "generation")
    made = _contract(spark, d, folder)
    for name in ("this", "other"):
        O.write(spark, made, f"{folder}/manifests/{name}.json")
    O.write(spark, {"schema_version": "x"}, f"{folder}/manifests/note.json")
    other = made["contract"] | {"settings": made["contract"]["settings"] | {"steps": 51}}
    rows = [("siblings", s["path"].rsplit("/", 1)[1]) for s in G.siblings(spark, f"{folder}/manifests", f"{folder}/manifests/this.json")]
    rows += [("difference", x["field"]) for x in G.differences(made["contract"], other)]
    places = [G.identity(spark, f"{folder}/{x}") for x in ("manifests/this.json", "manifests", "none")]
    rows += [("identity", p["kind"]) for p in places]
    rows.append(("same", str(places[1] == G.identity(spark, f"{folder}/manifests")).lower()))
    return frame(spark, rows, "what string, value string")


@add("prv_02", "SELECT * FROM (VALUES ('run', true), ('generation', true), ('planned', false), ('branch', false), ('other', false), ('none', false)) AS t(name, accepted)")
def prv_02(spark, d):
    folder = work_folder(spark, "sources")
    run = run_manifest(spark, folder, "run")
    done = {"schema_version": "generation-manifest/v4", "contract": {"model_revision": "b" * 40}, "completion": {"status": "complete", "run_manifest_path": run}}
    O.write(spark, done, f"{folder}/generation.json")
    O.write(spark, done | {"completion": {"status": "planned"}}, f"{folder}/planned.json")
    O.write(spark, done | {"contract": {"model_revision": "main"}}, f"{folder}/branch.json")
    O.write(spark, {"schema_version": "notes/v1"}, f"{folder}/other.json")
    names = ("run", "generation", "planned", "branch", "other", "none")
    return frame(spark, [(n, not refused(lambda n=n: X.source_manifest(spark, f"{folder}/{n}.json"))) for n in names], "name string, accepted boolean")


@add("prv_04", "SELECT 'region' AS name, count(*) AS rows, true AS hashed, 'complete' AS kind FROM region UNION ALL SELECT 'nation', count(*), true, 'complete' FROM nation UNION ALL SELECT 'weights', NULL, false, 'complete'")
def prv_04(spark, d):
    """Text files are hashed and their rows counted; binaries are named only."""
    folder = work_folder(spark, "dataset")
    paths = []
    for name in ("region", "nation"):
        O.write_bytes(spark, "\n".join(r[0] for r in A.table(spark, d, name).select(f"{name[0]}_name").collect()).encode(), f"{folder}/{name}.txt")  # tables of fixed size
        paths.append(f"{folder}/{name}.txt")
    O.write_bytes(spark, b"\0" * 64, f"{folder}/weights.pt")
    path = f"{folder}/dataset.manifest.json"
    V.write_dataset_manifest(spark, path, "prompts", [*paths, f"{folder}/weights.pt"], {"seed": 1})
    got = V.load_dataset_manifest(spark, path)
    rows = [(e["path"].rsplit("/", 1)[1].split(".")[0], spark.read.text(e["path"]).count() if e["sha256"] else None, e["sha256"] is not None, "complete") for e in got["dataset_paths"]]
    return frame(spark, rows, "name string, rows long, hashed boolean, kind string")


add("snk_11", "SELECT 'prompts' AS dataset_kind, 3 AS entries, 2 AS hashed")(lambda s, d: _dataset_entries(s, d))


def _dataset_entries(spark, d) -> DataFrame:
    folder = work_folder(spark, "dataset")
    for name, data in (("a.txt", b"a"), ("b.csv", b"x\n1"), ("c.bin", b"0")):
        O.write_bytes(spark, data, f"{folder}/{name}")
    V.write_dataset_manifest(spark, f"{folder}/m.json", "prompts", [f"{folder}/{n}" for n in ("a.txt", "b.csv", "c.bin")], {})
    got = V.load_dataset_manifest(spark, f"{folder}/m.json")
    return frame(spark, [(got["dataset_kind"], len(got["dataset_paths"]), sum(e["sha256"] is not None for e in got["dataset_paths"]))], "dataset_kind string, entries int, hashed int")


# ---------------------------------------------------------------- manifests of two runs over the tables
def run_of(spark, d, run: str) -> dict:
    got = scores(spark, d).where(c("run") == run).agg(F.count("*").alias("rows"), R.mean(c("score")).alias("mean")).first()
    return {"run_id": run, "stage": "scoring", "config_snapshot": {"model_id": "m", "seed": 1, "run": run}, "metrics": {"rows": got.rows, "mean": got.mean}, "environment": {"python": "3"}}


RUNS = "(SELECT run, count(*) AS n, round(avg(score), 6) AS m FROM score_rows WHERE run IN ('A', 'N') GROUP BY run)"
CHANGED = f"""SELECT path FROM (SELECT 'run_id' AS path UNION ALL SELECT 'config_snapshot.run' UNION ALL SELECT 'metrics.rows' FROM {RUNS} HAVING count(DISTINCT n) > 1 UNION ALL SELECT 'metrics.mean' FROM {RUNS} HAVING count(DISTINCT m) > 1)"""
add("prv_05", CHANGED, SR)(lambda s, d: V.manifest_diff(s, run_of(s, d, "A"), run_of(s, d, "N")).select("path"))
add("sup_29", f"SELECT 'metrics.rows' AS field, CAST(n AS VARCHAR) AS value FROM {RUNS} WHERE run = 'A' UNION ALL SELECT 'config_snapshot.seed', '1'", SR)(
    lambda s, d: frame(s, [(k, str(v)) for k, v in G.known_fields(run_of(s, d, "A"), ("metrics.rows", "config_snapshot.seed", "metrics.none")).items()], "field string, value string")
)


@add("sup_30", f"SELECT 'diff' AS part, path AS field FROM ({CHANGED}) UNION ALL SELECT 'blocking', 'config_snapshot.run'", SR)
def sup_30(spark, d):
    a, b = run_of(spark, d, "A"), run_of(spark, d, "N")
    out = V.manifest_diff(spark, a, b).select(F.lit("diff").alias("part"), c("path").alias("field"))
    keep = ("config_snapshot.run", "config_snapshot.seed", "config_snapshot.model_id")
    found = V.comparable(G.known_fields(a, keep), G.known_fields(b, keep), {"config_snapshot"})
    return out.unionByName(frame(spark, [(x["severity"], x["field"]) for x in found], "part string, field string"))


@add("sup_27", "SELECT * FROM (VALUES ('hashed', 'data'), ('named', 'big'), ('path', 'model.adapter_path'), ('path', 'scores_csv'), ('secret', '<redacted>')) AS t(what, value)")
def sup_27(spark, d):
    folder = work_folder(spark, "inputs")
    O.write_bytes(spark, b"1", f"{folder}/data.txt")
    entries = V.input_hashes(spark, {"data": f"{folder}/data.txt", "big": f"{folder}/none.bin"})
    rows = [("hashed" if e["sha256"] else "named", e["name"]) for e in entries]
    rows += [("path", p) for p in V.path_fields({"scores_csv": "a/b.csv", "steps": 5, "model": {"adapter_path": "x/y", "name": "m"}})]
    rows.append(("secret", V.redact({"API_TOKEN": "t"})["API_TOKEN"]))
    return frame(spark, rows, "what string, value string")


add("sup_28", "SELECT * FROM (VALUES ('in', 'scores_csv'), ('in', 'latents_dir'), ('out', 'run_dir'), ('out', 'checkpoints_dir'), ('out', 'logs_dir')) AS t(side, name)")(
    lambda s, d: frame(s, [("in", k) for k in W.run_inputs(TRAIN)] + [("out", k) for k in W.run_outputs(TRAIN)], "side string, name string")
)
TRAIN = {"scores_csv": "data/s.csv", "latents_dir": "data/l", "output_dir": "runs", "experiment_name": "e", "sft_lora_path": None}


@add("sup_36", """SELECT target, seed, step FROM (SELECT unnest(['base', 'tuned']) AS target), (SELECT DISTINCT l_linenumber AS seed FROM lineitem), (SELECT unnest(['generate', 'score']) AS step)
UNION ALL SELECT unnest(['base', 'tuned']), NULL, 'aggregate'""")
def sup_36(spark, d):
    """The written plan of an evaluation whose seeds are the line numbers."""
    path = work_folder(spark, "plan") + ".json"
    seeds = sorted(r[0] for r in A.table(spark, d, "lineitem").select("l_linenumber").distinct().collect())  # at most seven
    O.write(spark, {"schema_version": "evaluation-plan/v1", "steps": V.evaluation_grid(["base", "tuned"], seeds)}, path)
    return frame(spark, [(x["target"], x["seed"], x["step"]) for x in O.read(spark, path)["steps"]], "target string, seed int, step string")


# ---------------------------------------------------------------- configurations
GOOD = {
    "model_id": "m", "num_training_steps": 10, "batch_size": 1, "gradient_accumulation_steps": 1, "lr": 0.001, "seed": 1, "num_train_timesteps": 1000, "shift": 3.0, "resolution": 512, "lora": {"r": 8},
    "log_interval": 1, "save_interval": 5, "output_dir": "runs", "experiment_name": "e", "mixed_precision": "no", "latents_dir": "data/l", "text_embeds_dir": "data/t", "scores_csv": "data/s.csv",
}


@add(
    "val_23",
    """SELECT * FROM (VALUES ('sft', 'colour: unknown field'), ('sft', 'lr: more than 0 is needed'), ('sft', 'mixed_precision: one of no, fp16, bf16 is needed'), ('sft', 'sample_weighting: score_weighted and score_normalized go together'),
    ('sft', 'resume_step: resume_lora_path is needed'), ('dpo', 'beta: missing'), ('dpo', 'pair_construction_mode: preference_pairs_path is needed'), ('dpo', 'pair_weighting: margin_weighted and margin_normalized go together'),
    ('masked_sft', 'data_dir: missing'), ('masked_sft', 'latents_dir: unknown field'), ('masked_sft', 'masked_lambda: at most 1 is allowed'), ('masked_sft', 'scores_csv: unknown field'), ('masked_sft', 'text_embeds_dir: unknown field'),
    ('other', 'stage: ''other'' is unknown')) AS t(stage, error)""",
)
def val_23(spark, d):
    assert W.training_errors("sft", GOOD) == [] and W.training_config("sft", GOOD)["score_threshold"] == 0.3
    bad = {
        "sft": GOOD | {"colour": 1, "lr": 0, "mixed_precision": "int8", "selection_mode": "score_weighted", "resume_step": 3},
        "dpo": GOOD | {"pair_construction_mode": "margin_weighted"},
        "masked_sft": GOOD | {"masked_lambda": 2.0},
        "other": {},
    }
    return frame(spark, [(k, e) for k, v in bad.items() for e in W.training_errors(k, v)], "stage string, error string")


@add("val_25", """SELECT * FROM (VALUES ('output_dir: text is needed'), ('table_specs[0].source: none.csv is no declared evidence'), ('table_specs[1].output: leaves the output folder'), ('svg_plot_specs[0]: y missing'),
('contact_sheet_specs[0].output: written twice')) AS t(error)""")
def val_25(spark, d):
    config = {
        "table_specs": [{"source": "none.csv", "output": "a.md"}, {"source": "s.csv", "output": "../b.md"}], "svg_plot_specs": [{"source": "s.csv", "output": "p.svg", "x": "step"}],
        "contact_sheet_specs": [{"source": "s.csv", "output": "a.md"}],
    }
    return frame(spark, [(e,) for e in W.bundle_errors(config, {"s.csv"})], "error string")


@add("prv_07", "SELECT * FROM (VALUES ('pinned', 'base_model', 'true'), ('pinned', 'scorer_model', 'false'), ('seed', 'seed', '1'), ('seed', 'data.split_seed', '4'), ('secret', 'TOKEN', 'true'), ('git', 'commit', 'null')) AS t(kind, name, value)")
def prv_07(spark, d):
    config = {"base_model_id": "m", "base_model_revision": "c" * 40, "scorer_model_id": "s", "seed": 1, "data": {"split_seed": 4, "seedling": "x"}}
    rows = [("pinned", k, str(v["pinned"]).lower()) for k, v in W.revisions(config).items()]
    rows += [("seed", k, str(v)) for k, v in W.seeds(config).items()]
    rows += [("secret", k, str(v).lower()) for k, v in W.environment(secret_names=("TOKEN",), environ={"TOKEN": "t"})["secrets_present"].items()]
    rows.append(("git", "commit", "null" if W.git_state("/proc")["commit"] is None else "known"))
    return frame(spark, rows, "kind string, name string, value string")


@add("prv_08", "SELECT * FROM (VALUES ('paths', 'x/data/images,x/data/text_embeds,x/data/scores'), ('support', 'scoring: the language model scorer needs an accelerator'), ('support', 'mixed_precision: an accelerator is needed')) AS t(what, value)")
def prv_08(spark, d):
    rows = [("paths", ",".join(W.stage_paths("scoring", "x/")))] + [("support", e) for e in W.support_errors("scoring", False, "fp16")]
    assert W.support_errors("scoring", False, scorer="ocr") == []
    return frame(spark, rows, "what string, value string")


add("udf_09", "SELECT * FROM (VALUES ('scorer'), ('generator'), ('formula'), ('selection'), ('pairing'), ('quality_rule'), ('reader'), ('sink'), ('artifact_stage'), ('stream')) AS t(name)")(
    lambda s, d: frame(s, [(W.extension(n)["name"],) for n in W.EXTENSIONS], "name string")
)


# ---------------------------------------------------------------- preflight, bundles, Markdown
def _product_scores(spark, d, folder: str, formula: dict) -> str:
    path = f"{folder}/product_scores"
    plain_scores(spark, d).drop("run").write.parquet(path)
    X.score_sidecar(spark, path, formula, "product", [run_manifest(spark, folder, "scoring")])
    return path


@add("prv_12", "SELECT * FROM (VALUES ('product', true, 0), ('diagnostic', false, 1), ('no folder', false, 1)) AS t(kind, ok, errors)")
def prv_12(spark, d):
    rows = []
    for kind, formula in (("product", PRODUCT), ("diagnostic", DIAGNOSTIC), ("no folder", PRODUCT)):
        folder = work_folder(spark, "preflight")
        path = _product_scores(spark, d, folder, formula)
        paths = {"scores_csv": path, "latents_dir": folder, "text_embeds_dir": folder if kind != "no folder" else f"{folder}/none"}
        got = W.preflight(spark, "sft", GOOD | {"scores_csv": path, "output_dir": f"{folder}/runs"}, paths)
        rows.append((kind, got["ok"], len(got["errors"])))
    return frame(spark, rows, "kind string, ok boolean, errors int")


def _evaluated(spark, d) -> tuple[str, str]:
    """The table of canonical rows, whole and written once, with its sidecar, and the manifest that it is made from. Columns,
    as most of them repeat a few values: JSON lines took 26 times the input on sf0.1."""
    folder = work_folder(spark, "evaluated")
    canonical(spark, d).write.parquet(f"{folder}/scores")
    manifest = run_manifest(spark, folder, "evaluation")
    X.score_sidecar(spark, f"{folder}/scores", DIAGNOSTIC, "product", [manifest])
    return f"{folder}/scores", manifest


def _bundle(spark, folder: str, scored: str, manifest: str) -> dict:
    O.write(spark, {"schema_version": "gold/v1", "total": 1}, f"{folder}/gold.json")
    return {
        "output_dir": f"{folder}/out", "source_manifests": [manifest], "score_reports": [scored], "diagnostic_reports": [f"{folder}/gold.json"],
        "table_specs": [{"source": scored, "output": "table.md", "columns": ["sample_id", "version"], "limit": 5}],
        "svg_plot_specs": [{"source": scored, "output": "plot.svg", "x": "version", "y": "score"}],
        "contact_sheet_specs": [{"source": scored, "output": "sheet.md", "limit": 3}],
    }


@add(
    "prv_11",
    """SELECT 'linked' AS kind, true AS ready, 0 AS errors, 3 AS outputs, 3 AS warnings, count(*) AS scored FROM score_rows UNION ALL SELECT 'unlinked', false, 2, 0, 0, count(*) FROM score_rows""",
    SR,
)
def prv_11(spark, d):
    """A bundle whose table is made from the listed manifest, and one whose table is not; both take the same table."""
    rows = []
    with without_shuffle_files(spark):
        scored, manifest = _evaluated(spark, d)
    for kind in ("linked", "unlinked"):
        folder = work_folder(spark, "bundle")
        listed = manifest if kind == "linked" else run_manifest(spark, folder, "other")
        with without_shuffle_files(spark):
            made = B.build(spark, _bundle(spark, folder, scored, listed), ready=False)
        state = made["readiness"]
        written = sum(O.exists(spark, f"{folder}/out/{n}") for n in ("table.md", "plot.svg", "sheet.md"))
        rows.append((kind, state["ready"], len(state["blocking_errors"]), written, len(state["warnings"]), made["score_reports"][0]["rows"]))
    return frame(spark, rows, "kind string, ready boolean, errors int, outputs int, warnings int, scored long")


@add("sup_25", "SELECT * FROM (VALUES ('manifest', 'scoring'), ('evidence', 'schema_version,total'), ('error', 'none')) AS t(what, value)")
def sup_25(spark, d):
    folder, errors = work_folder(spark, "evidence"), []
    O.write(spark, {"schema_version": "gold/v1", "total": 1}, f"{folder}/gold.json")
    rows = [("manifest", m["stage"]) for m in B.manifests(spark, [run_manifest(spark, folder, "scoring"), f"{folder}/none.json"], errors)]
    rows += [("evidence", ",".join(e["keys"])) for e in B.evidence(spark, [f"{folder}/gold.json"], errors)]
    return frame(spark, rows + [("error", "none" if "none.json" in e else e) for e in errors], "what string, value string")


on(
    prompts, "sup_26", "SELECT id, style, coalesce(style, '') = '' AS lacks FROM prompts ORDER BY style, id LIMIT 5", PR,
    lambda p: (lambda shown: shown[0].select("id", "style", (F.coalesce("style", F.lit("")) == "").alias("lacks")))(B.contact_sheet(p.select("id", "style", c("style").alias("image_path")), ["style", "id"], 5)),
)


@add(
    "snk_17",
    """SELECT line FROM (SELECT unnest(['# Gold report', '## Counts', '| field | value |', '| --- | --- |', '| total | ' || count(*) || ' |', '| pass | ' || count(*) FILTER (human_label = 'pass') || ' |', '## Findings', '* all samples agree', '## Labels', '| human_label | count |', '| --- | --- |']) AS line FROM gold)
    UNION ALL SELECT '| ' || human_label || ' | ' || count(*) || ' |' FROM gold GROUP BY human_label""",
    "gold",
)
def snk_17(spark, d):
    g = A.gold(spark, d)
    got = g.agg(F.count("*").alias("total"), F.count_if(c("human_label") == "pass").alias("pass")).first()
    labels = g.groupBy("human_label").agg(F.count("*").alias("count")).orderBy("human_label")
    text = B.markdown("Gold report", {"Counts": got.asDict(), "Findings": B.findings(got.total, 0, 1.0, 1.0, 1.0), "Labels": labels})
    path = work_folder(spark, "report") + ".md"
    O.write_bytes(spark, text.encode(), path)
    return B.read_markdown(spark, path).select(c("value").alias("line"))

"""Artifacts between stages: sidecars of score tables, validation by stage, merging of shards and seeds.

A score table is a folder of Parquet, CSV or JSON lines; its sidecar is the document ``<table>.schema.json``. Row checks run
on the cluster and come back as counts by message with one example, so a report stays small however many rows are wrong.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scores as M
from ..functions.coerce import integral
from ..operators import reconcile
from ..operators.scorefiles import REQUIRED, content_digest, row_errors
from ..operators.selection import duplicates
from ..sources import documents, readers
from ..sources.documents import DocumentError

# fixed values: versions of documents and the fields that they must have
SIDECAR = "reward-score-metadata/v1"
SCORE_FILES = ("reward-score-file/v1", "reward-score-jsonl/v1", "heldout-score-aggregate/v1")
SIDECAR_FIELDS = ("schema_version", "score_file_schema_version", "formula", "primary_score", "source_manifest_paths", "source_manifest_sha256", "execution")
FORMULA_FIELDS = ("name", "weights", "thresholds", "scorer_versions", "aggregation", "require_all")
SOURCE_MANIFESTS = ("run-manifest/v1", "generation-manifest/v4")
REPORTS = {
    "dataset_manifest": ("dataset-manifest/v1", ("dataset_kind", "dataset_paths")),
    "prompt_quality_report": ("prompt-quality/v1", ("valid_records",)),
    "synthetic_quality_report": ("synthetic-quality/v1", ("sample_count",)),
    "data_source_comparison": ("data-source-comparison/v1", ("evidence_available", "evidence_missing")),
}
LINES = {
    "selected_samples": ("selected-samples/v1", ("sample_id", "prompt_id", "version", "selected_score")),
    "preference_pairs": ("preference-pairs/v1", ("pair_id", "prompt_id", "winner_version", "loser_version", "winner_score", "loser_score")),
}
ALIASES = {
    "prompt_generation": "prompts", "image_generation": "generated", "generation": "generated", "scoring": "scores", "score": "scores",
    "score_inputs": "scoring_inputs", "masked-sft": "masked_sft", "dataset-manifest": "dataset_manifest",
    "prompt-quality": "prompt_quality_report", "prompt_quality": "prompt_quality_report",
    "synthetic-quality": "synthetic_quality_report", "synthetic_quality": "synthetic_quality_report",
    "source-comparison": "data_source_comparison", "data-comparison": "data_source_comparison",
    "manifests": "run_manifest", "manifest": "run_manifest",
    "evaluation-scores": "evaluation_scores", "score_outputs": "evaluation_scores", "score-outputs": "evaluation_scores",
}
WEIGHTS = (".bin", ".pt", ".safetensors")


class ArtifactError(ValueError):
    """Artifacts that a stage needs are not ready; all problems are listed."""


# ---------------------------------------------------------------- tables and sidecars


def table(spark: SparkSession, path: str) -> DataFrame:
    """A score table; text formats as strings."""
    if path.endswith(".csv"):
        return readers.csv(spark, path)
    if path.endswith((".jsonl", ".json")):
        return spark.read.option("primitivesAsString", True).json(path)
    return spark.read.parquet(path)


def sidecar_path(path: str) -> str:
    return f"{path}.schema.json"


def formula_document(formula: M.Formula, scorer_versions: dict[str, str] | None = None) -> dict:
    return {
        "name": "vlm_ocr_product" if formula.product else "diagnostic_geometric_mean",
        "weights": formula.weights,
        "thresholds": formula.thresholds,
        "scorer_versions": scorer_versions or {},
        "aggregation": "weighted_product" if formula.product else "weighted_geometric_mean",
        "require_all": formula.require_all,
    }


def choose_formula(config: dict) -> tuple[dict, str]:
    """The formula and the primary score that a scoring configuration asks for."""
    scorer = config.get("scorer", "both")
    primary = {"vlm": "vlm", "ocr": "ocr", "both": "product"}
    if scorer not in primary:
        raise ValueError(f"no scorer is named {scorer!r}")
    versions = {}
    if scorer != "ocr":
        versions["vlm"] = "@".join(x for x in (config["vlm_model_id"], config.get("vlm_model_revision")) if x)
    if scorer != "vlm":
        versions["ocr"] = f"{config.get('ocr_name', 'ocr')}-entropy-{config.get('entropy_lambda', 1.0)}"
    return formula_document(M.formula_for(config.get("product_formula", "diagnostic")), versions), primary[scorer]


def manifest_hashes(spark: SparkSession, paths: list[str]) -> dict[str, str | None]:
    return {p: documents.sha256(spark, p) for p in paths}


def drifted(spark: SparkSession, expected: dict[str, str | None]) -> list[str]:
    """Manifests that are gone or hold something else than when their hash was taken."""
    return [p for p, h in sorted(expected.items()) if not documents.is_file(spark, p) or documents.sha256(spark, p) != h]


def score_sidecar(
    spark: SparkSession, path: str, formula: dict, primary: str, manifests: list[str], execution: dict | None = None, kind: str = SCORE_FILES[0], digest: dict | None = None
) -> dict:
    """Describe a finished score table: what made it, from which manifests, how many rows, and their digest."""
    if not manifests:
        raise ValueError("a score table names at least one source manifest")
    digest = digest or content_digest(table(spark, path))
    payload = {
        "schema_version": SIDECAR,
        "score_file_schema_version": kind,
        "formula": formula,
        "primary_score": primary,
        "source_manifest_paths": sorted(manifests),
        "source_manifest_sha256": manifest_hashes(spark, manifests),
        "required_fields": sorted(REQUIRED),
        "execution": {"status": "complete", "scored_row_count": digest["rows"], "scores_sha256": digest["sha256"]} | (execution or {}),
    }
    documents.write(spark, payload, sidecar_path(path))
    return payload


def evaluation_sidecar(spark: SparkSession, path: str, formula: dict, primary: str, hashes: dict[str, str | None]) -> dict:
    """Sidecar of an evaluation's JSON lines; manifests that changed since their hash was taken are an error."""
    if changed := drifted(spark, hashes):
        raise ArtifactError(f"source manifests changed during the evaluation: {', '.join(changed)}")
    return score_sidecar(spark, path, formula, primary, sorted(hashes), kind=SCORE_FILES[1])


def source_manifest(spark: SparkSession, path: str) -> dict:
    """A manifest that scores may name as their source; other documents are refused."""
    payload = documents.read(spark, path)
    kind = payload.get("schema_version")
    if kind not in SOURCE_MANIFESTS:
        raise DocumentError(f"{path}: {kind!r} is no manifest of a source")
    if kind == SOURCE_MANIFESTS[0]:
        lacking = [k for k in ("run_id", "stage", "config_snapshot") if k not in payload]
        if lacking:
            raise DocumentError(f"{path}: {', '.join(lacking)} missing")
        return payload
    completion = payload.get("completion") or {}
    if completion.get("status") != "complete":
        raise DocumentError(f"{path}: the generation is not complete")
    revision = str((payload.get("contract") or {}).get("model_revision") or "")
    if len(revision) != 40 or set(revision) - set("0123456789abcdef"):
        raise DocumentError(f"{path}: the model's revision is no commit")
    link = completion.get("run_manifest_path")
    if not link:
        raise DocumentError(f"{path}: no run manifest is linked")
    source_manifest(spark, link)
    return payload


def sidecar_errors(spark: SparkSession, path: str, canonical: bool = True, digest: dict | None = None) -> list[str]:
    """What is wrong with the sidecar of a score table."""
    try:
        payload = documents.read(spark, sidecar_path(path))
    except DocumentError as e:
        return [str(e)]
    if not canonical:
        return [] if isinstance(payload.get("schema_version"), str) and payload["schema_version"] else ["schema_version: missing"]
    errors = [f"{k}: missing" for k in SIDECAR_FIELDS if k not in payload]
    if payload.get("schema_version") != SIDECAR:
        errors.append(f"schema_version: not {SIDECAR}")
    if payload.get("score_file_schema_version") not in SCORE_FILES:
        errors.append("score_file_schema_version: unknown")
    formula = payload.get("formula")
    errors += ["formula: no object"] if not isinstance(formula, dict) else [f"formula.{k}: missing" for k in FORMULA_FIELDS if k not in formula]
    if payload.get("primary_score") not in ("vlm", "ocr", "product"):
        errors.append("primary_score: unknown")
    named, hashes = payload.get("source_manifest_paths"), payload.get("source_manifest_sha256")
    if not isinstance(named, list) or not named or not isinstance(hashes, dict):
        errors.append("source_manifest_paths: a list with hashes is needed")
    else:
        for manifest in map(str, named):
            try:
                source_manifest(spark, manifest)
            except DocumentError as e:
                errors.append(f"source_manifest_paths: {e}")
                continue
            if hashes.get(manifest) != documents.sha256(spark, manifest):
                errors.append(f"source_manifest_sha256: {manifest} has changed")
    state = payload.get("execution")
    if not isinstance(state, dict):
        return [*errors, "execution: no object"]
    if state.get("status") != "complete":
        errors.append("execution.status: not complete")
    digest = digest or content_digest(table(spark, path))
    if state.get("scored_row_count", state.get("row_count")) != digest["rows"]:
        errors.append("execution.scored_row_count: differs from the table")
    if state.get("scores_sha256") != digest["sha256"]:
        errors.append("execution.scores_sha256: differs from the table")
    if payload.get("required_fields") and set(REQUIRED) - set(payload["required_fields"]):
        errors.append("required_fields: canonical fields are missing")
    return errors


def checked_sidecar(spark: SparkSession, path: str) -> dict:
    """The sidecar of a complete table whose rows and digest agree with it."""
    payload = documents.read(spark, sidecar_path(path))
    state, digest = payload.get("execution") or {}, content_digest(table(spark, path))
    if state.get("status") != "complete":
        raise ArtifactError(f"{path}: not complete")
    if state.get("scores_sha256") != digest["sha256"] or state.get("scored_row_count", state.get("row_count")) != digest["rows"]:
        raise ArtifactError(f"{path}: rows differ from the sidecar")
    return payload


def links(spark: SparkSession, sidecars: list[str], manifests: list[str]) -> DataFrame:
    """table, manifest and state of every manifest that a sidecar names or the configuration lists.

    linked: same hash on both sides; changed: another hash; auxiliary: named by a sidecar only; unlinked: listed only.
    """
    named = [(p, m, h) for p in sidecars for m, h in documents.read(spark, sidecar_path(p)).get("source_manifest_sha256", {}).items()]
    ours = spark.createDataFrame([(m, documents.sha256(spark, m)) for m in manifests], "manifest string, configured string")
    theirs = spark.createDataFrame(named, "table string, manifest string, declared string")
    both = theirs.join(ours, "manifest", "full_outer")
    state = F.when(F.col("table").isNull(), "unlinked").when(F.col("configured").isNull(), "auxiliary")
    return both.select("table", "manifest", state.when(F.col("configured") == F.col("declared"), "linked").otherwise("changed").alias("state"))


# ---------------------------------------------------------------- validation by stage


@dataclass
class Report:
    """What a stage's artifacts lack; errors block, warnings don't."""

    stage: str
    checked: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    metadata: dict[str, Any] = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return not self.errors


class _Stage:
    """One validation: the paths given, and the report that checks add to."""

    def __init__(self, spark: SparkSession, stage: str, paths: dict[str, str], ready: bool):
        self.spark, self.paths, self.ready, self.report = spark, paths, ready, Report(stage)

    def error(self, message: str) -> None:
        self.report.errors.append(message)

    def path(self, key: str, required: bool = True) -> str | None:
        found = self.paths.get(key)
        if found is None:
            if required:
                self.error(f"{key}: no path is given")
        elif found not in self.report.checked:
            self.report.checked.append(found)
        return found

    def folder(self, key: str, required: bool = True) -> str | None:
        """A folder; one that needn't be there yet is only worth a warning."""
        found = self.path(key, required)
        if found is None or documents.is_dir(self.spark, found):
            return found
        (self.report.errors if required else self.report.warnings).append(f"{key}: there is no folder {found}")
        return None

    def counted(self, rows: DataFrame, message: str, example: str) -> None:
        """Row errors as a count by message, with the smallest example."""
        got = rows.groupBy(message).agg(F.count("*").alias("n"), F.min(example).alias("first"))
        for r in got.orderBy(message).limit(200).collect():
            self.error(f"{r.n} rows: {r[message]} (first: {r.first})")

    def scores(self, path: str, canonical: bool = False) -> None:
        if not documents.exists(self.spark, path):
            return self.error(f"{path}: there is no score table")
        rows = table(self.spark, path)
        wanted = REQUIRED if canonical else ("id", "version", "score", "target_text")
        lacking = [c for c in wanted if c not in rows.columns]
        if lacking:
            return self.error(f"{path}: missing columns {', '.join(lacking)}")
        key = "sample_id" if canonical else "id"
        bad = row_errors(rows) if canonical else readers.score_errors(rows).select(F.col("id").alias("sample_id"), "error")
        self.counted(bad, "error", "sample_id")
        twice = duplicates(rows.where(integral(F.col("version")).isNotNull()), key, "version")
        self.counted(twice.withColumn("error", F.lit("key occurs more than once")), "error", key)
        digest = content_digest(rows)
        self.report.metadata["rows"] = digest["rows"]
        if canonical or documents.is_file(self.spark, sidecar_path(path)):
            for e in sidecar_errors(self.spark, path, canonical, digest):
                self.error(f"{sidecar_path(path)}: {e}")

    def prompts(self, path: str) -> None:
        if not documents.exists(self.spark, path):
            return self.error(f"{path}: there are no prompts")
        schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "prompt", "target_text")])
        good, bad = readers.json_lines(self.spark, path, schema)
        blank = [F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(f"{c} is blank")) for c in ("prompt", "target_text")]
        wrong = good.select("id", F.explode(F.array_compact(F.array(*blank))).alias("error"))
        self.counted(bad.select(F.lit("malformed line").alias("error"), F.substring("value", 1, 40).alias("id")), "error", "id")
        self.counted(wrong, "error", "id")
        self.counted(duplicates(good.where("id is not null"), "id").withColumn("error", F.lit("id occurs more than once")), "error", "id")

    def report_document(self, key: str, required: bool) -> None:
        kind, fields = REPORTS[key]
        path = self.path(key, required)
        if path is None:
            return
        if not documents.exists(self.spark, path):
            (self.report.errors if required else self.report.warnings).append(f"{key}: {path} is not there")
            return
        try:
            payload = documents.read(self.spark, path)
        except DocumentError as e:
            return self.error(str(e))
        if payload.get("schema_version") != kind:
            self.error(f"{key}: schema_version is not {kind}")
        for name in fields:
            if name not in payload:
                self.error(f"{key}: {name} is missing")

    def lines(self, key: str, required: bool) -> None:
        kind, fields = LINES[key]
        path = self.path(key, required)
        if path is None:
            return
        if not documents.exists(self.spark, path):
            (self.report.errors if required else self.report.warnings).append(f"{key}: {path} is not there")
            return
        schema = T.StructType([T.StructField(c, T.StringType()) for c in ("schema_version", *fields)])
        good, bad = readers.json_lines(self.spark, path, schema)
        self.counted(bad.select(F.lit("malformed line").alias("error"), F.substring("value", 1, 40).alias("at")), "error", "at")
        wrong = [F.when(~F.col("schema_version").eqNullSafe(F.lit(kind)), F.lit(f"schema_version is not {kind}"))]
        wrong += [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in fields]
        self.counted(good.select(F.explode(F.array_compact(F.array(*wrong))).alias("error"), F.col(fields[0]).alias("at")), "error", "at")

    def layout(self, folder: str, versioned: bool, suffix: str) -> DataFrame:
        """id and version (null in flat layouts) of the files of a layout; other names are errors."""
        found = readers.listing(self.spark, folder, f"*{suffix}")
        rows = readers.layout(found, versioned, suffix)
        self.counted(rows.where("id is null").select(F.lit(f"name is not of the layout ({suffix})").alias("error"), "path"), "error", "path")
        return rows.where("id is not null").select("id", "version")

    def only(self, a: DataFrame, b: DataFrame, keys: list[str], message: str) -> None:
        key = F.concat_ws("/", *keys)
        lone = a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti")
        self.counted(lone.select(F.lit(message).alias("error"), key.alias("at")), "error", "at")

    def checkpoint(self, key: str) -> None:
        path = self.path(key)
        if path is None:
            return
        if documents.is_file(self.spark, path):
            if not path.endswith(WEIGHTS):
                self.error(f"{key}: {path} is no file of weights")
        elif not documents.is_dir(self.spark, path):
            self.error(f"{key}: {path} is not there")
        elif not any(n.endswith(WEIGHTS) for n in documents.names(self.spark, path)):
            self.error(f"{key}: {path} holds no weights")


def _prompts(s: _Stage) -> None:
    if path := s.path("prompts_jsonl"):
        s.prompts(path)


def _scores(s: _Stage) -> None:
    if path := s.path("scores_csv"):
        s.scores(path)


def _evaluation_scores(s: _Stage) -> None:
    """Score tables by their format; either may be left out."""
    given = [p for p in (s.path("scores_csv", False), s.path("scores_jsonl", False)) if p]
    if not given and s.ready:
        s.error("scores_csv or scores_jsonl: no path is given")
    for path in given:
        s.scores(path, canonical=True)


def _generated(s: _Stage) -> None:
    if path := s.path("prompts_jsonl", False):
        s.prompts(path)
    images, latents, texts = (s.folder(k) for k in ("images_dir", "latents_dir", "text_embeds_dir"))
    if not (images and latents and texts):
        return
    i, t, e = s.layout(images, True, ".png"), s.layout(latents, True, ".pt"), s.layout(texts, False, ".pt")
    s.only(i, e, ["id"], "images without a text embedding")
    s.only(i, t, ["id", "version"], "images without a latent")
    s.only(t, i, ["id", "version"], "latents without an image")
    s.report.metadata["versions"] = i.count()


def _scoring_inputs(s: _Stage) -> None:
    images, texts = s.folder("images_dir"), s.folder("text_embeds_dir")
    if images and texts:
        i = s.layout(images, True, ".png")
        s.only(i, s.layout(texts, False, ".pt"), ["id"], "images without a text embedding")
        if i.isEmpty():
            s.error("images_dir: there is nothing to score")


def _masked(s: _Stage) -> None:
    data = s.folder("data_dir", "data_dir" in s.paths)
    for key, name in (("latents_dir", "latents"), ("text_embeds_dir", "text_embeds"), ("shapes_csv", "shapes.csv")):
        if data and key not in s.paths:
            s.paths[key] = f"{data}/{name}"
    latents, texts = s.folder("latents_dir"), s.folder("text_embeds_dir")
    if latents and texts:
        a, b = s.layout(latents, False, ".pt"), s.layout(texts, False, ".pt")
        s.only(a, b, ["id"], "latents without a text embedding")
        s.only(b, a, ["id"], "text embeddings without a latent")
    shapes = s.path("shapes_csv", False)
    if shapes and documents.exists(s.spark, shapes):
        rows = readers.require(readers.csv(s.spark, shapes), ["id", "H", "W"])
        s.counted(rows.where((F.coalesce(integral(F.col("H")), F.lit(0)) <= 0) | (F.coalesce(integral(F.col("W")), F.lit(0)) <= 0)).withColumn("error", F.lit("shape is not positive")), "error", "id")
    elif shapes:
        s.report.warnings.append(f"shapes_csv: {shapes} is not there")
    if "resume_lora" in s.paths:
        s.checkpoint("resume_lora")


def _training(s: _Stage) -> None:
    _scores(s)
    for key in ("latents_dir", "text_embeds_dir"):
        s.folder(key)
    for key in LINES:
        if key in s.paths:
            s.lines(key, True)
    for key in ("resume_lora", "sft_lora"):
        if key in s.paths:
            s.checkpoint(key)


def _synthetic(s: _Stage) -> None:
    for key in ("raw_dir", "masked_dir", "anyword_dir"):
        s.folder(key, False)
    if "selected_samples" in s.paths:
        s.lines("selected_samples", False)
    for key in ("synthetic_quality_report", "dataset_manifest"):
        if key in s.paths:
            s.report_document(key, False)


def _evaluation(s: _Stage) -> None:
    s.folder("outputs_dir", s.ready)
    if "scores_csv" in s.paths:
        _scores(s)


def _run_manifest(s: _Stage) -> None:
    path = s.path("manifest_json", s.ready)
    if path is None:
        return
    if not documents.exists(s.spark, path):
        (s.report.errors if s.ready else s.report.warnings).append(f"manifest_json: {path} is not there")
        return
    try:
        s.report.metadata["schema_version"] = documents.read(s.spark, path).get("schema_version")
    except DocumentError as e:
        s.error(str(e))


STAGES: dict[str, Callable[[_Stage], Any]] = {
    "prompts": _prompts,
    "scores": _scores,
    "evaluation_scores": _evaluation_scores,
    "generated": _generated,
    "scoring_inputs": _scoring_inputs,
    "masked_sft": _masked,
    "sft": _training,
    "dpo": _training,
    "synthetic": _synthetic,
    "checkpoints": lambda s: s.folder("checkpoints_dir", s.ready),
    "logs": lambda s: s.folder("logs_dir", s.ready),
    "evaluation": _evaluation,
    "run_manifest": _run_manifest,
    **{key: lambda s, key=key: s.report_document(key, s.ready) for key in REPORTS},
    **{key: lambda s, key=key: s.lines(key, s.ready) for key in LINES},
}


def validate(spark: SparkSession, stage: str, paths: dict[str, str], ready: bool = False) -> Report:
    """Check a stage's artifacts; with ``ready`` they must be there and in order, else an error lists all problems."""
    key = ALIASES.get(stage, stage)
    s = _Stage(spark, stage, dict(paths), ready)
    if key in STAGES:
        STAGES[key](s)
    else:
        s.error(f"no stage is named {stage!r}")
    if ready and s.report.errors:
        raise ArtifactError("; ".join(s.report.errors))
    return s.report


def report_frame(spark: SparkSession, reports: list[Report]) -> DataFrame:
    """stage, kind (error or warning) and message."""
    rows = [(r.stage, kind, m) for r in reports for kind, ms in (("error", r.errors), ("warning", r.warnings)) for m in ms]
    return spark.createDataFrame(rows, "stage string, kind string, message string")


# ---------------------------------------------------------------- shards and seeds


def _same(documents_: list[dict], keys: tuple[str, ...], what: str) -> None:
    for d in documents_[1:]:
        for k in keys:
            if d.get(k) != documents_[0].get(k):
                raise ArtifactError(f"{what}: {k} differs")


CONTRACT = ("score_file_schema_version", "formula", "primary_score")


def merge_shards(spark: SparkSession, shards: list[str], output: str, expected: int, delete: bool = False) -> dict:
    """One score table of all shards, with its sidecar; shards that don't fit together are refused and nothing is written.

    Rows are range-partitioned by key, so the table is sorted as a whole without passing through one task.
    """
    sidecars = [checked_sidecar(spark, p) for p in shards]
    _same(sidecars, (*CONTRACT, "source_manifest_paths", "source_manifest_sha256"), "shards")
    states = [s["execution"] for s in sidecars]
    _same(states, ("num_shards", "discovered_task_count"), "shards")
    numbers = sorted(s["shard_idx"] for s in states)
    if numbers != list(range(expected)) or any(s["num_shards"] != expected for s in states):
        raise ArtifactError(f"shards: {numbers} are there, {expected} expected")
    if any(s["expected_shard_count"] != s["scored_row_count"] for s in states):
        raise ArtifactError("shards: rows are missing in a shard")
    discovered = states[0]["discovered_task_count"]
    if sum(s["expected_shard_count"] for s in states) != discovered:
        raise ArtifactError("shards: their tasks are not all that were discovered")
    frames = [table(spark, p).withColumn("shard_idx", F.lit(s["shard_idx"])) for p, s in zip(shards, states, strict=True)]
    if any(f.columns != frames[0].columns for f in frames):
        raise ArtifactError("shards: columns differ")
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    problems = reconcile.merge_shards(rows, expected, discovered).limit(5).collect()
    if problems:
        raise ArtifactError("shards: " + "; ".join(f"{p.problem} {p.what}" for p in problems))
    merged = rows.drop("shard_idx")
    by = ["id", F.col("version").cast("long")]
    merged.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(output)
    digest = content_digest(spark.read.parquet(output))
    parts = [{"path": p, "shard_idx": s["shard_idx"], "rows": s["scored_row_count"], "sha256": s["scores_sha256"]} for p, s in zip(shards, states, strict=True)]
    state = {"status": "complete", "num_shards": expected, "discovered_task_count": discovered, "expected_shard_count": discovered,
             "scored_row_count": digest["rows"], "scores_sha256": digest["sha256"], "merged_shards": sorted(parts, key=lambda x: x["shard_idx"])}
    out = sidecars[0] | {"execution": state}
    documents.write(spark, out, sidecar_path(output))
    if delete:
        for p in shards:
            documents.delete(spark, p)
            documents.delete(spark, sidecar_path(p))
    return out


def aggregate_seeds(spark: SparkSession, inputs: dict[int, str], output: str) -> dict:
    """Rows of all seeds in one table sorted by seed and key, with twin sidecars; seeds must cover the same samples."""
    paths = [p for _, p in sorted(inputs.items())]
    sidecars = [checked_sidecar(spark, p) for p in paths]
    _same(sidecars, CONTRACT, "seeds")
    common = set.intersection(*(set(s["source_manifest_paths"]) for s in sidecars))
    if not common:
        raise ArtifactError("seeds: no source manifest is common to all")
    for s in sidecars:
        if changed := drifted(spark, s["source_manifest_sha256"]):
            raise ArtifactError(f"seeds: {', '.join(changed)} changed")
    frames = {seed: table(spark, p) for seed, p in sorted(inputs.items())}
    rows = reconcile.seed_union(frames)
    per_key = rows.groupBy("id", "version").agg(F.count("*").alias("n"), F.count_distinct("seed").alias("seeds"))
    wrong = per_key.agg(F.count_if(F.col("n") > F.col("seeds")).alias("twice"), F.count_if(F.col("seeds") < len(frames)).alias("short"), F.count("*").alias("samples")).first()
    if wrong.twice:
        raise ArtifactError(f"seeds: {wrong.twice} keys occur twice within a seed")
    if wrong.short:
        raise ArtifactError(f"seeds: {wrong.short} keys are not in every seed")
    by = ["seed", "id", F.col("version").cast("long")]
    rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(output)
    digest = content_digest(spark.read.parquet(output))
    files = [{"seed": seed, "path": p, "sha256": s["execution"]["scores_sha256"]} for (seed, p), s in zip(sorted(inputs.items()), sidecars, strict=True)]
    state = {"status": "complete", "row_count": digest["rows"], "seed_count": len(frames), "seeds": sorted(frames),
             "sample_count_per_seed": wrong.samples, "scores_sha256": digest["sha256"], "source_files": files}
    out = {k: sidecars[0].get(k) for k in (*CONTRACT, "schema_version", "required_fields")} | {
        "score_file_schema_version": SCORE_FILES[2],
        "source_manifest_paths": sorted(common),
        "source_manifest_sha256": {p: sidecars[0]["source_manifest_sha256"][p] for p in sorted(common)},
        "execution": state,
    }
    for name in (sidecar_path(output), f"{output}.aggregate.json"):
        documents.write(spark, out, name)
    return out


def product_errors(sidecar: dict) -> list[str]:
    """Why a score table can't train on the product of both scores."""
    formula, errors = sidecar.get("formula"), []
    if sidecar.get("primary_score") != "product":
        errors.append("primary_score: not product")
    if not isinstance(formula, dict) or formula.get("name") != "vlm_ocr_product":
        return [*errors, "formula.name: not the product of both scores"]
    if formula.get("aggregation") != "weighted_product":
        errors.append("formula.aggregation: not weighted_product")
    if formula.get("require_all") is not True:
        errors.append("formula.require_all: both scores are needed")
    if formula.get("weights") != {"score_vlm": 1.0, "score_ocr": 1.0}:
        errors.append("formula.weights: not one each")
    return errors


def wants_product(config: dict, sidecar: dict | None = None) -> bool:
    """Whether a training run means product scores: by its names or by what the sidecar says."""
    named = (config.get("experiment_name"), str(config.get("scores_csv", "")).rsplit("/", 1)[-1], config.get("score_column"))
    said = (sidecar or {}).get("primary_score") or ((sidecar or {}).get("formula") or {}).get("name")
    return any("product" in str(x).lower() for x in (*named, said))


def benchmark_contract(spark: SparkSession, path: str, rows: int) -> dict:
    """What a benchmark run needs to know of a score table: its formula, primary score and digest, if it covers all rows."""
    payload = checked_sidecar(spark, path)
    state = payload["execution"]
    n = state.get("scored_row_count", state.get("row_count"))
    if n != rows:
        raise ArtifactError(f"{path}: {n} rows, {rows} expected")
    return {"formula": payload["formula"], "primary_score": payload["primary_score"], "sha256": state["scores_sha256"], "rows": n}


def identity(payload: dict) -> str:
    return hashlib.sha256(json.dumps(payload, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def as_dict(report: Report) -> dict:
    return asdict(report) | {"ok": report.ok}

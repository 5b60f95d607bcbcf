"""Configurations on the driver: strict training configurations, report bundles, preflight, stage paths, the registry."""

from __future__ import annotations

import os
import platform
import re
import subprocess
import sys
from typing import Any

from pyspark.sql import SparkSession

from ..sources import documents
from ..sources.documents import DocumentError
from . import artifacts

PRECISIONS = ("no", "fp16", "bf16")
REVISION = re.compile("[0-9a-f]{40}")
WHOLE, NUMBER, TEXT, FLAG, LIST, OBJECT = "whole number", "number", "text", "flag", "list", "object"
# name: kind, default (... is required), lowest, highest; an open bound is named by a tuple
_COMMON: dict[str, tuple] = {
    "model_id": (TEXT, ...), "model_revision": (TEXT, None), "num_training_steps": (WHOLE, ..., 1), "batch_size": (WHOLE, ..., 1),
    "gradient_accumulation_steps": (WHOLE, ..., 1), "lr": (NUMBER, ..., (0,)), "weight_decay": (NUMBER, 0.0, 0), "max_grad_norm": (NUMBER, 1.0, (0,)),
    "warmup_steps": (WHOLE, 0, 0), "seed": (WHOLE, ...), "num_train_timesteps": (WHOLE, ..., 1), "shift": (NUMBER, ..., (0,)), "resolution": (WHOLE, ..., 1),
    "lora": (OBJECT, ...), "sample_prompt": (TEXT, ""), "sample_target_text": (TEXT, ""), "sample_interval": (WHOLE, 200, 0), "eval_suite_path": (TEXT, None),
    "eval_suite_n_per_step": (WHOLE, 0, 0), "num_inference_steps": (WHOLE, 28, 1), "log_interval": (WHOLE, ..., 1), "save_interval": (WHOLE, ..., 1),
    "output_dir": (TEXT, ...), "experiment_name": (TEXT, ...), "gradient_checkpointing": (FLAG, True), "mixed_precision": (TEXT, ...),
}
_SCORED: dict[str, tuple] = {"latents_dir": (TEXT, ...), "text_embeds_dir": (TEXT, ...), "scores_csv": (TEXT, ...), "score_column": (TEXT, "score")}
_RESUMED: dict[str, tuple] = {"resume_lora_path": (TEXT, None), "resume_step": (WHOLE, 0, 0)}
FIELDS: dict[str, dict[str, tuple]] = {
    "sft": _COMMON | _SCORED | _RESUMED | {
        "score_threshold": (NUMBER, 0.3, 0, 1), "selection_mode": (TEXT, "threshold"), "selected_samples_path": (TEXT, None),
        "hard_negative_threshold": (NUMBER, 0.2, 0, 1), "sample_weighting": (TEXT, "uniform"),
    },
    "dpo": _COMMON | _SCORED | {
        "sft_lora_path": (TEXT, None), "score_threshold": (NUMBER, 0.5, 0, 1), "score_diff_min": (NUMBER, 0.1, (0,), 1),
        "pair_construction_mode": (TEXT, "best_vs_worst"), "preference_pairs_path": (TEXT, None), "ambiguity_margin": (NUMBER, 0.0, 0, 1),
        "pair_weighting": (TEXT, "uniform"), "beta": (NUMBER, ..., (0,)),
    },
    "masked_sft": _COMMON | _RESUMED | {
        "data_dir": (TEXT, ...), "val_n_samples": (WHOLE, 200, 0), "lr_min": (NUMBER, 1e-6, 0), "lr_schedule": (TEXT, "cosine"),
        "masked_lambda": (NUMBER, ..., 0, 1), "sample_interval": (WHOLE, 0, 0), "validation_interval": (WHOLE, 250, 1), "val_t_anchors": (LIST, [100, 300, 500, 700, 900]),
        "eval_suite_n_per_step": (WHOLE, 4, 1), "progress_bar_mininterval": (NUMBER, 30.0, (0,)),
    },
}
CHOICES = {
    "selection_mode": ("hard_positive", "score_weighted", "threshold", "top_k_per_prompt"),
    "sample_weighting": ("score_normalized", "uniform"),
    "pair_construction_mode": ("all_separated_pairs", "ambiguity_filtered", "best_vs_worst", "margin_weighted"),
    "pair_weighting": ("margin_normalized", "uniform"),
    "lr_schedule": ("cosine", "constant"),
    "mixed_precision": PRECISIONS,
}
KINDS = {WHOLE: int, NUMBER: (int, float), TEXT: str, FLAG: bool, LIST: list, OBJECT: dict}


def _bounded(name: str, value: Any, rule: tuple) -> str | None:
    kind, _, low, high = (*rule, None, None)[:4]
    if not isinstance(value, KINDS[kind]) or (isinstance(value, bool) and kind != FLAG):
        return f"{name}: a {kind} is needed"
    if isinstance(low, tuple) and value <= low[0]:
        return f"{name}: more than {low[0]} is needed"
    if isinstance(low, int) and value < low:
        return f"{name}: at least {low} is needed"
    return f"{name}: at most {high} is allowed" if high is not None and value > high else None


def training_errors(stage: str, config: dict, allowed_model: str | None = None) -> list[str]:
    """What is wrong with a training configuration: unknown and missing fields, kinds, bounds, and fields that contradict."""
    if stage not in FIELDS:
        return [f"stage: {stage!r} is unknown"]
    rules = FIELDS[stage]
    errors = [f"{k}: unknown field" for k in sorted(config.keys() - rules.keys())]
    c = {}
    for name, rule in rules.items():
        if name not in config or (config[name] is None and rule[1] is None):
            if rule[1] is ...:
                errors.append(f"{name}: missing")
            c[name] = None if rule[1] is ... else rule[1]
            continue
        c[name] = config[name]
        if bad := _bounded(name, config[name], rule):
            errors.append(bad)
        elif name in CHOICES and config[name] not in CHOICES[name]:
            errors.append(f"{name}: one of {', '.join(CHOICES[name])} is needed")
        elif name.endswith(("_dir", "_path", "_csv")) and ".." in str(config[name]).split("/"):
            errors.append(f"{name}: leaves its folder")
    if allowed_model and c["model_id"] not in (None, allowed_model):
        errors.append("model_id: unsupported")
    if stage != "dpo" and (c["resume_step"] or 0) and not c["resume_lora_path"]:
        errors.append("resume_step: resume_lora_path is needed")
    if stage == "sft":
        if c["selection_mode"] in ("hard_positive", "top_k_per_prompt") and not c["selected_samples_path"]:
            errors.append("selection_mode: selected_samples_path is needed")
        if (c["selection_mode"] == "score_weighted") != (c["sample_weighting"] == "score_normalized"):
            errors.append("sample_weighting: score_weighted and score_normalized go together")
    if stage == "dpo":
        plain = c["pair_construction_mode"] == "best_vs_worst" and c["pair_weighting"] == "uniform" and not c["ambiguity_margin"]
        if not plain and not c["preference_pairs_path"]:
            errors.append("pair_construction_mode: preference_pairs_path is needed")
        if (c["pair_construction_mode"] == "margin_weighted") != (c["pair_weighting"] == "margin_normalized"):
            errors.append("pair_weighting: margin_weighted and margin_normalized go together")
    return errors


def training_config(stage: str, config: dict) -> dict:
    """The configuration with its defaults, sorted, ready to be recorded."""
    if errors := training_errors(stage, config):
        raise ValueError("; ".join(errors))
    return dict(sorted({"stage": stage, **{k: config.get(k, r[1]) for k, r in FIELDS[stage].items()}}.items()))


INPUTS = ("scores_csv", "latents_dir", "text_embeds_dir", "selected_samples_path", "preference_pairs_path", "resume_lora_path", "sft_lora_path", "data_dir", "eval_suite_path")


def run_inputs(config: dict) -> dict[str, str]:
    return {k: config[k] for k in INPUTS if config.get(k)}


def run_outputs(config: dict) -> dict[str, str]:
    name = f"{config['output_dir'].rstrip('/')}/{config['experiment_name']}"
    return {"run_dir": name, "checkpoints_dir": f"{name}/checkpoints", "logs_dir": f"{name}/logs"}


# ---------------------------------------------------------------- preflight


def preflight(spark: SparkSession, stage: str, config: dict, paths: dict[str, str]) -> dict:
    """Whether a training run may start: its configuration, its artifacts, product scores where they are meant, its output."""
    errors = [f"config: {e}" for e in training_errors(stage, config)]
    report = artifacts.validate(spark, stage, paths)
    errors += [f"artifacts: {e}" for e in report.errors]
    scores = paths.get("scores_csv")
    sidecar: dict | None = None
    if scores:
        try:
            sidecar = documents.read(spark, artifacts.sidecar_path(scores))
        except DocumentError:
            sidecar = None
        if artifacts.wants_product(config, sidecar):
            errors += [f"scores: {e}" for e in (artifacts.product_errors(sidecar) if sidecar else ["product scores need a sidecar"])]
    out = config.get("output_dir")
    if out and documents.is_file(spark, out):
        errors.append("output_dir: a file is there")
    return {"stage": stage, "ok": not errors, "errors": errors, "warnings": report.warnings, "checked": report.checked, "inputs": run_inputs(config)}


# ---------------------------------------------------------------- report bundles

BUNDLE = "report-bundle-config/v1"
SPECS = {"table_specs": ("source", "output"), "svg_plot_specs": ("source", "output", "x", "y"), "contact_sheet_specs": ("source", "output")}


def bundle_errors(config: dict, evidence: set[str]) -> list[str]:
    """What is wrong with a bundle's configuration: its fields, sources that are no evidence, outputs that leave the folder."""
    errors = [] if config.get("schema_version", BUNDLE) == BUNDLE else [f"schema_version: not {BUNDLE}"]
    if not isinstance(config.get("output_dir"), str) or not config["output_dir"]:
        errors.append("output_dir: text is needed")
    for key in ("source_manifests", "score_reports", "diagnostic_reports", *SPECS):
        if not isinstance(config.get(key, []), list):
            errors.append(f"{key}: a list is needed")
    seen: set[str] = set()
    for key, fields in SPECS.items():
        for k, spec in enumerate(config.get(key) or []):
            lacking = [f for f in fields if not isinstance(spec, dict) or not spec.get(f)]
            if lacking:
                errors.append(f"{key}[{k}]: {', '.join(lacking)} missing")
                continue
            if spec["source"] not in evidence:
                errors.append(f"{key}[{k}].source: {spec['source']} is no declared evidence")
            if spec["output"].startswith(("/", "~")) or ".." in spec["output"].split("/"):
                errors.append(f"{key}[{k}].output: leaves the output folder")
            if spec["output"] in seen:
                errors.append(f"{key}[{k}].output: written twice")
            seen.add(spec["output"])
    return errors


# ---------------------------------------------------------------- surroundings of a run


def git_state(root: str = ".") -> dict:
    """Commit, branch and whether files are changed; nothing is known outside a repository."""

    def ask(*words: str) -> str | None:
        try:
            return subprocess.run(["git", "-C", root, *words], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return None

    status = ask("status", "--porcelain")
    return {"commit": ask("rev-parse", "HEAD"), "branch": ask("rev-parse", "--abbrev-ref", "HEAD"), "dirty": None if status is None else bool(status)}


def environment(packages: tuple[str, ...] = ("pyspark", "pyarrow", "pandas", "numpy"), secret_names: tuple[str, ...] = (), environ: dict | None = None) -> dict:
    """Versions, and which secrets are set, never what they hold."""
    from importlib.metadata import PackageNotFoundError, version

    def of(name: str) -> str | None:
        try:
            return version(name)
        except PackageNotFoundError:
            return None

    environ = dict(os.environ) if environ is None else environ
    return {
        "python": platform.python_version(), "platform": sys.platform, "packages": {p: of(p) for p in packages},
        "secrets_present": {n: bool(environ.get(n)) for n in secret_names},
    }


def revisions(config: dict) -> dict[str, dict]:
    """Models of a configuration with their revision, and whether it is a commit that can't move."""
    out = {}
    for key, value in sorted(config.items()):
        if key.endswith("model_id") and value:
            revision = config.get(key.removesuffix("_id") + "_revision")
            out[key.removesuffix("_id")] = {"id": value, "revision": revision, "pinned": bool(revision and REVISION.fullmatch(str(revision)))}
    return out


def seeds(config: dict, prefix: str = "") -> dict[str, int]:
    """Every whole number of a configuration whose name ends in seed, by its path."""
    out: dict[str, int] = {}
    for key, value in sorted(config.items()):
        path = f"{prefix}.{key}" if prefix else key
        if isinstance(value, dict):
            out |= seeds(value, path)
        elif key.endswith("seed") and isinstance(value, int) and not isinstance(value, bool):
            out[path] = value
    return out


PATHS = {
    "prompts": ("data/prompts.jsonl",),
    "generation": ("data/prompts.jsonl", "data/images", "data/latents", "data/text_embeds"),
    "scoring": ("data/images", "data/text_embeds", "data/scores"),
    "training": ("data/scores", "data/latents", "data/text_embeds", "runs"),
    "evaluation": ("outputs/scores", "outputs/reports"),
}


def stage_paths(stage: str, root: str = ".") -> list[str]:
    if stage not in PATHS:
        raise ValueError(f"no stage is named {stage!r}")
    return [f"{root.rstrip('/')}/{p}" for p in PATHS[stage]]


def support_errors(stage: str, accelerator: bool, mixed_precision: str = "no", scorer: str = "both") -> list[str]:
    """What a machine lacks for a stage; the engine's own stages need no accelerator."""
    errors = []
    if stage in ("generation", "training") and not accelerator:
        errors.append(f"{stage}: an accelerator is needed")
    if stage == "scoring" and scorer in ("vlm", "both") and not accelerator:
        errors.append("scoring: the language model scorer needs an accelerator")
    if mixed_precision not in PRECISIONS:
        errors.append("mixed_precision: unknown")
    elif mixed_precision != "no" and not accelerator:
        errors.append("mixed_precision: an accelerator is needed")
    return errors


# places where own code plugs in: what they are given, and what the engine does around them
EXTENSIONS = {
    "scorer": ("operators.scorers.scored", "pairs of texts by Arrow batch", "evidence columns"),
    "generator": ("operators.scorers.phrases", "a batch of rows", "as many rows"),
    "formula": ("functions.scores.Formula", "weights and thresholds", "a score column"),
    "selection": ("operators.selection.select_samples", "score rows", "sample rows"),
    "pairing": ("operators.selection.select_pairs", "score rows", "preference pairs"),
    "quality_rule": ("operators.quality.first_error", "named predicates", "the first that fails"),
    "reader": ("sources.readers.records", "a path", "a frame"),
    "sink": ("sources.sinks.json_rows", "a frame", "files"),
    "artifact_stage": ("plans.artifacts.STAGES", "paths", "a report"),
    "stream": ("streaming.collected", "a stream and a reduction", "partial aggregates"),
}


def extension(name: str) -> dict[str, str]:
    if name not in EXTENSIONS:
        raise KeyError(f"no extension point is named {name!r}")
    place, given, result = EXTENSIONS[name]
    return {"name": name, "place": place, "given": given, "result": result}

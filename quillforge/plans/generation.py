"""Contracts of a generation run: what it was to make, whether it is there, and what changed since."""

from __future__ import annotations

import hashlib
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import documents, readers
from ..sources.documents import DocumentError
from .provenance import canonical_sha256, comparable, flatten, utc_now

MANIFEST = "generation-manifest/v4"
KINDS = {"image": ("images", "png"), "latent": ("latents", "pt")}


def prompt_source(spark: SparkSession, path: str, start: int = 0, end: int | None = None) -> dict:
    """How many prompts a file has, and hashes of all of them and of the slice that a run takes, in file order."""
    lines = readers.numbered_lines(spark, path, count_blank=False)
    kept = readers.sliced(lines, start, end)

    def of(frame: DataFrame) -> tuple[int, str]:
        # the order is part of the hash; positions make each record's own hash, so one pass without a sort is enough
        h = F.conv(F.substring(F.sha2(F.concat_ws("\0", F.col("position").cast("string"), "value"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
        got = frame.agg(F.count("*").alias("n"), F.sum(h).alias("s")).first()
        return got.n, hashlib.sha256(f"{got.n}|{got.s}".encode()).hexdigest()

    (n, whole), (m, part) = of(lines), of(kept)
    return {"path": path, "records": n, "sha256": whole, "start": start, "end": end, "slice_records": m, "slice_sha256": part}


def expected_paths(prompts: DataFrame, versions: int, root: str) -> DataFrame:
    """id, version, kind and path of everything a run is to make; text embeddings have no version."""
    each = prompts.select("id", F.explode(F.sequence(F.lit(0), F.lit(versions - 1))).alias("version"))
    rows = None
    for kind, (folder, suffix) in KINDS.items():
        part = each.select("id", "version", F.lit(kind).alias("kind"), F.concat(F.lit(f"{root}/{folder}/"), "id", F.lit("/v"), "version", F.lit(f".{suffix}")).alias("path"))
        rows = part if rows is None else rows.unionByName(part)
    texts = prompts.select("id", F.lit(None).cast("int").alias("version"), F.lit("text_embed").alias("kind"), F.concat(F.lit(f"{root}/text_embeds/"), "id", F.lit(".pt")).alias("path"))
    return rows.unionByName(texts)


def path_state(spark: SparkSession, expected: DataFrame, root: str) -> DataFrame:
    """kind and path with the file's length, null where it is not there; one distributed listing, nothing is opened."""
    there = readers.listing(spark, root, "*").select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length"))
    wanted = expected.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    return wanted.join(there, "path", "left")


def paths_digest(state: DataFrame) -> str:
    h = F.xxhash64("path", F.coalesce("length", F.lit(-1)))
    got = state.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(f"{got.n}|{got.x}|{got.s}".encode()).hexdigest()


def folder_digest(spark: SparkSession, folder: str) -> str:
    """Hash of the names and lengths of all files below a folder."""
    found = readers.listing(spark, folder, "*")
    return paths_digest(found.select(F.regexp_replace("path", f"^.*{folder.rstrip('/').rsplit('/', 1)[-1]}/", "").alias("path"), "length"))


def identity(spark: SparkSession, place: str) -> dict:
    """What stands at a place: a file's hash, a folder's digest, or nothing."""
    if documents.is_file(spark, place):
        return {"kind": "file", "sha256": documents.sha256(spark, place)}
    if documents.is_dir(spark, place):
        return {"kind": "folder", "sha256": folder_digest(spark, place)}
    return {"kind": "missing", "sha256": None}


def build(spark: SparkSession, config: dict, prompts_path: str, root: str) -> dict:
    """The contract of a run: source slice, model, settings, and how many artifacts of each kind it makes."""
    source = prompt_source(spark, prompts_path, config.get("start_idx", 0), config.get("end_idx"))
    contract = {
        "prompt_source": source,
        "model_id": config["model_id"],
        "model_revision": config["model_revision"],
        "settings": {k: config[k] for k in sorted(config) if k not in ("model_id", "model_revision", "start_idx", "end_idx")},
        "versions": config["versions"],
        "root": root,
        "expected": {"image": source["slice_records"] * config["versions"], "latent": source["slice_records"] * config["versions"], "text_embed": source["slice_records"]},
    }
    return {"schema_version": MANIFEST, "created_at": utc_now(), "contract": contract, "contract_sha256": canonical_sha256(contract), "completion": {"status": "planned"}}


def source_changes(spark: SparkSession, source: dict) -> list[str]:
    """Fields of the prompt source that no longer hold: its records, its hash, the slice's hash."""
    now = prompt_source(spark, source["path"], source["start"], source["end"])
    return [k for k in ("records", "sha256", "slice_records", "slice_sha256") if now[k] != source[k]]


def complete(manifest: dict, state: DataFrame, run_manifest: str) -> dict:
    """The manifest with a new completion record; an earlier record is replaced, the contract never."""
    counts = {r.kind: r.n for r in state.where("length is not null").groupBy("kind").agg(F.count("*").alias("n")).collect()}
    lacking = {k: n - counts.get(k, 0) for k, n in manifest["contract"]["expected"].items() if counts.get(k, 0) < n}
    record = {"status": "in_progress" if lacking else "complete", "counts": counts, "missing": lacking, "paths_sha256": paths_digest(state), "run_manifest_path": run_manifest, "updated_at": utc_now()}
    return manifest | {"completion": record}


def errors(spark: SparkSession, manifest: dict, state: DataFrame | None = None, finished: bool = True) -> list[str]:
    """What is wrong with a generation manifest, its source, and (with the state of its paths) its artifacts."""
    if manifest.get("schema_version") != MANIFEST:
        return [f"schema_version: not {MANIFEST}"]
    contract, completion = manifest.get("contract") or {}, manifest.get("completion") or {}
    found = [] if canonical_sha256(contract) == manifest.get("contract_sha256") else ["contract_sha256: the contract has changed"]
    found += [f"prompt_source.{k}: has changed" for k in source_changes(spark, contract["prompt_source"])]
    if finished and completion.get("status") != "complete":
        found.append("completion.status: not complete")
    if state is not None and completion.get("paths_sha256") not in (None, paths_digest(state)):
        found.append("completion.paths_sha256: artifacts have changed")
    return found


def siblings(spark: SparkSession, folder: str, exclude: str = "") -> list[dict]:
    """Other generation manifests of a folder that hold the same prompts, by name; documents of other kinds are passed over."""
    out = []
    for name in documents.names(spark, folder):
        path = f"{folder}/{name}"
        if not name.endswith(".json") or path == exclude:
            continue
        try:
            payload = documents.read(spark, path)
        except DocumentError:
            continue
        if payload.get("schema_version") == MANIFEST:
            out.append({"path": path, "manifest": payload})
    return out


def differences(expected: Any, actual: Any) -> list[dict]:
    """Fields of two contracts that differ, at any depth."""
    return [{k: x[k] for k in ("field", "left", "right", "reason")} for x in comparable(expected, actual, set())]


def target_hashes(spark: SparkSession, prompts_path: str) -> DataFrame:
    lines = readers.numbered_lines(spark, prompts_path, count_blank=False)
    return lines.select("position", T.target_digest(F.get_json_object("value", "$.target_text")).alias("sha256"))


def known_fields(manifest: dict, names: tuple[str, ...]) -> dict:
    """The fields of a manifest that comparisons know, by dotted path."""
    flat = flatten(manifest)
    return {n: flat[n] for n in names if n in flat}

"""Manifests, contracts and plans: small documents on the driver, with their relational cores in ``operators``."""

from __future__ import annotations

import hashlib
import json
import re
from datetime import UTC, datetime
from itertools import product
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import SECRET_NAMES
from ..operators.reconcile import diff
from ..sources import documents

STATES = {"planned": {"in_progress"}, "in_progress": {"failed", "complete"}, "failed": {"in_progress"}, "complete": set()}


def utc_now(now: datetime | None = None) -> str:
    return (now or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")


def canonical_sha256(payload: Any) -> str:
    text = json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def records_sha256(parts: list[bytes]) -> str:
    """Length-prefixed, so that different splits of the same bytes differ."""
    h = hashlib.sha256()
    for p in parts:
        h.update(len(p).to_bytes(8, "big") + p)
    return h.hexdigest()


def file_sha256(path: str | Path, block: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(block):
            h.update(part)
    return h.hexdigest()


def flatten(value: Any, prefix: str = "") -> dict[str, Any]:
    """Nested mappings as dotted paths."""
    if not isinstance(value, dict):
        return {prefix: value}
    out: dict[str, Any] = {}
    for k in sorted(value):
        out |= flatten(value[k], f"{prefix}.{k}" if prefix else str(k))
    return out


def manifest_frame(spark: SparkSession, manifest: dict) -> DataFrame:
    rows = [(k, json.dumps(v, ensure_ascii=False, sort_keys=True)) for k, v in flatten(manifest).items()]
    return spark.createDataFrame(rows, "path string, value string")


def manifest_diff(spark: SparkSession, left: dict, right: dict) -> DataFrame:
    return diff(manifest_frame(spark, left), manifest_frame(spark, right), "path", "value")


def redact(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: "<redacted>" if re.search(SECRET_NAMES, str(k), re.IGNORECASE) else redact(v) for k, v in value.items()}
    if isinstance(value, list):
        return [redact(v) for v in value]
    return value


def run_manifest(stage: str, command: list[str], config: dict | None = None, now: datetime | None = None, **more: Any) -> dict:
    config = redact(config or {})
    slug = re.sub(r"[^a-z0-9]+", "-", stage.lower()).strip("-")
    return {
        "run_id": f"{utc_now(now).replace(':', '').replace('-', '')}-{slug}",
        "stage": stage,
        "created_at": utc_now(now),
        "command": command,
        "config_snapshot": config,
        "config_sha256": canonical_sha256(config),
        **more,
    }


def advance(document: dict, status: str, now: datetime | None = None, **more: Any) -> dict:
    """The next state of an attempt; steps that skip a state are refused."""
    if status not in STATES[document.get("status", "planned")]:
        raise ValueError(f"{document.get('status', 'planned')} does not lead to {status}")
    attempt = document.get("attempt", 0) + (status == "in_progress")
    return document | {"status": status, "attempt": attempt, "updated_at": utc_now(now)} | more


def evaluation_grid(targets: list[str], seeds: list[int]) -> list[dict]:
    """One step of generation and scoring for every target and seed, then one aggregation a target."""
    if len(set(seeds)) != len(seeds) or any(s < 0 for s in seeds):
        raise ValueError("seeds must be unique and not negative")
    steps = [{"target": t, "seed": s, "step": k} for t, s in product(targets, seeds) for k in ("generate", "score")]
    return steps + [{"target": t, "seed": None, "step": "aggregate"} for t in targets]


def comparable(left: dict, right: dict, blocking: set[str]) -> list[dict]:
    """Mismatched fields of two configurations; a missing field is a mismatch of its own kind."""
    a, b, out = flatten(left), flatten(right), []
    for field in sorted(a.keys() | b.keys()):
        if field in a and field in b and a[field] == b[field]:
            continue
        reason = "different" if field in a and field in b else "missing_left" if field not in a else "missing_right"
        out.append({"field": field, "left": a.get(field), "right": b.get(field), "reason": reason, "severity": "blocking" if field.split(".")[0] in blocking else "note"})
    return out


def safe_path(root: str | Path, relative: str) -> Path:
    """A path below the root; absolute ones and ones that climb out are refused."""
    path = (Path(root) / relative).resolve()
    if Path(relative).is_absolute() or not path.is_relative_to(Path(root).resolve()):
        raise ValueError(f"{relative!r} leaves the output folder")
    return path


def evaluation_errors(config: dict) -> list[str]:
    """What is wrong with a held-out evaluation: targets, baseline, seeds, revisions."""
    targets, seeds, errors = config.get("targets", []), config.get("seeds", []), []
    if len(targets) < 2:
        errors.append("targets: two or more are needed")
    if sum(bool(t.get("baseline")) for t in targets) != 1:
        errors.append("targets: exactly one is the baseline")
    if len({t.get("name") for t in targets}) != len(targets):
        errors.append("targets: names repeat")
    if not seeds or len(set(seeds)) != len(seeds) or any(isinstance(s, bool) or not isinstance(s, int) or s < 0 for s in seeds):
        errors.append("seeds: unique whole numbers from 0 are needed")
    errors += [f"revision of {t.get('name')}: 40 hex digits are needed" for t in targets if not re.fullmatch(r"[0-9a-f]{40}", str(t.get("revision", "")))]
    return errors


def evidence(spark: SparkSession, paths: dict[str, str]) -> list[dict]:
    """Name, path, size and hash of each file of evidence, in the order given; missing ones have neither size nor hash."""
    return input_hashes(spark, paths)


def verify_evidence(spark: SparkSession, entries: list[dict]) -> list[dict]:
    """Entries whose file is missing or has changed."""
    now = {e["name"]: e for e in evidence(spark, {e["name"]: e["path"] for e in entries})}
    found = []
    for e in entries:
        if now[e["name"]]["bytes"] is None:
            found.append({"name": e["name"], "reason": "missing"})
        elif (now[e["name"]]["sha256"], now[e["name"]]["bytes"]) != (e["sha256"], e["bytes"]):
            found.append({"name": e["name"], "reason": "changed"})
    return found


def claim(spark: SparkSession, path: str, contract: dict) -> dict:
    """The contract at the path: ours if we are the first to create it, else the one there, which must be the same."""
    if documents.create(spark, contract, path):
        return contract
    there = documents.read(spark, path)
    if canonical_sha256(there) != canonical_sha256(contract):
        changed = ", ".join(x["field"] for x in comparable(there, contract, set()))
        raise ValueError(f"another contract is at {path}: {changed}")
    return contract


DATASET = "dataset-manifest/v1"
HASHED_SUFFIXES = (".csv", ".json", ".jsonl", ".md", ".txt")


def input_hashes(spark: SparkSession, paths: dict[str, str], limit: int = 64 << 20) -> list[dict]:
    """Name, path, size and hash of inputs; larger ones, and ones that are not there, are named only."""
    out = []
    for name, path in paths.items():
        there = documents.is_file(spark, path)
        size = documents.size(spark, path) if there else None
        out.append({"name": name, "path": path, "bytes": size, "sha256": documents.sha256(spark, path) if there and size <= limit else None})
    return out


def path_fields(config: dict) -> list[str]:
    """Fields of a configuration that name files or folders, by dotted path."""
    return [k for k, v in flatten(config).items() if isinstance(v, str) and ("/" in v or k.endswith(("_path", "_dir", "_csv", "_json", "_jsonl")))]


def write_dataset_manifest(spark: SparkSession, path: str, kind: str, paths: list[str], config: dict, counts: dict[str, int] | None = None, limit: int = 10 << 20) -> dict:
    """What a dataset is made of: small text files with their hashes, others by name, the configuration and row counts."""
    entries = []
    for p in sorted(paths):
        small = p.endswith(HASHED_SUFFIXES) and documents.is_file(spark, p) and documents.size(spark, p) <= limit
        entries.append({"path": p, "bytes": documents.size(spark, p) if documents.is_file(spark, p) else None, "sha256": documents.sha256(spark, p) if small else None})
    payload = {
        "schema_version": DATASET, "dataset_kind": kind, "dataset_paths": entries, "config_snapshot": redact(config), "config_sha256": canonical_sha256(redact(config)),
        "output_counts": counts or {}, "created_at": utc_now(),
    }
    documents.write(spark, payload, path)
    return payload


def load_dataset_manifest(spark: SparkSession, path: str) -> dict:
    payload = documents.read(spark, path)
    lacking = [k for k in ("dataset_kind", "dataset_paths", "config_sha256") if k not in payload]
    if payload.get("schema_version") != DATASET or lacking:
        raise documents.DocumentError(f"{path}: no dataset manifest ({', '.join(lacking) or 'another version'})")
    return payload

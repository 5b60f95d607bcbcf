"""Report bundles: a gate over manifests and score tables, then tables, plots, contact sheets and Markdown."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import documents, readers, sinks
from ..sources.documents import DocumentError
from . import artifacts, configs

SOURCES = ("generated", "synthetic")
# what each source of training data is expected to do for a model, and where it may fall short
HELPS = {
    "generated": ["samples are what the model itself draws", "scores say which of several drawings is better"],
    "synthetic": ["masks say exactly where text stands", "rare letters and fonts are covered on purpose"],
}
FAILS = {
    "generated": ["errors of the scorer are learnt", "gaps of the prompts stay gaps", "score margins say nothing about held-out prompts"],
    "synthetic": ["scenes are simpler than photographs", "the renderer's own marks may be learnt", "a low reconstruction loss is no proof of legible text"],
}


def manifests(spark: SparkSession, paths: list[str], errors: list[str]) -> list[dict]:
    """Path, kind, stage and hash of each source manifest; ones that can't be used are errors."""
    out = []
    for p in paths:
        try:
            payload = artifacts.source_manifest(spark, p)
        except DocumentError as e:
            errors.append(str(e))
            continue
        out.append({"path": p, "schema_version": payload["schema_version"], "stage": payload.get("stage"), "sha256": documents.sha256(spark, p)})
    return out


def evidence(spark: SparkSession, paths: list[str], errors: list[str]) -> list[dict]:
    """Path, version, keys and hash of each diagnostic report."""
    out = []
    for p in paths:
        try:
            payload = documents.read(spark, p)
        except DocumentError as e:
            errors.append(str(e))
            continue
        out.append({"path": p, "schema_version": payload.get("schema_version", ""), "keys": sorted(payload), "sha256": documents.sha256(spark, p)})
    return out


def score_reports(spark: SparkSession, paths: list[str], listed: list[str], errors: list[str]) -> list[dict]:
    """Score tables with their links to the listed manifests; every table and every manifest must have one."""
    out, usable = [], []
    for p in paths:
        key = "scores_jsonl" if p.endswith(".jsonl") else "scores_csv"
        found = artifacts.validate(spark, "evaluation_scores", {key: p})
        errors += [f"{p}: {e}" for e in found.errors]
        if documents.is_file(spark, artifacts.sidecar_path(p)):
            usable.append(p)
            payload = documents.read(spark, artifacts.sidecar_path(p))
            out.append({"path": p, "rows": found.metadata.get("rows"), "formula": payload.get("formula"), "primary_score": payload.get("primary_score")})
    state = artifacts.links(spark, usable, listed).collect()
    errors += [f"{r.manifest}: no score table is made from it" for r in state if r.state == "unlinked"]
    errors += [f"{r.table}: {r.manifest} has changed" for r in state if r.state == "changed"]
    linked = {r.table for r in state if r.state == "linked"}
    errors += [f"{p}: made from none of the listed manifests" for p in usable if p not in linked]
    return out


def contact_sheet(rows: DataFrame, order: list[str], limit: int = 12, image: str = "image_path") -> tuple[DataFrame, list[str]]:
    """The rows a sheet shows, in order, and warnings for those without an image."""
    shown = rows.orderBy(*order).limit(limit)
    lacking = [r[0] for r in shown.where(F.trim(F.coalesce(image, F.lit(""))) == "").select(order[-1]).collect()]
    return shown, [f"{x}: no image" for x in lacking]


def build(spark: SparkSession, config: dict, ready: bool = True) -> dict:
    """Check everything first; only a bundle without errors writes its tables, plots and sheets."""
    errors: list[str] = []
    warnings: list[str] = []
    listed = manifests(spark, config.get("source_manifests", []), errors)
    reports = score_reports(spark, config.get("score_reports", []), [m["path"] for m in listed], errors)
    found = evidence(spark, config.get("diagnostic_reports", []), errors)
    errors += configs.bundle_errors(config, {r["path"] for r in [*reports, *found]})
    made: dict[str, list[Any]] = {k: [] for k in configs.SPECS}
    if not errors:
        root = config["output_dir"].rstrip("/")
        for spec in config.get("table_specs", []):
            rows = artifacts.table(spark, spec["source"])
            text = sinks.markdown_table(sinks.pick(rows, spec.get("columns", rows.columns)).limit(spec.get("limit", 100)))
            documents.write_bytes(spark, text.encode(), f"{root}/{spec['output']}")
            made["table_specs"].append(spec["output"])
        for spec in config.get("svg_plot_specs", []):
            rows = artifacts.table(spark, spec["source"]).select(F.col(spec["x"]).cast("double").alias("x"), F.col(spec["y"]).cast("double").alias("y"))
            points = sinks.scatter(rows.where("x is not null and y is not null").groupBy("x").agg(F.avg("y").alias("v")), "x", "v").limit(10_000).collect()
            documents.write_bytes(spark, sinks.svg([(p[1], p[2]) for p in points]).encode(), f"{root}/{spec['output']}")
            made["svg_plot_specs"].append(spec["output"])
        for spec in config.get("contact_sheet_specs", []):
            rows = artifacts.table(spark, spec["source"])
            rows = rows if "image_path" in rows.columns else rows.withColumn("image_path", F.lit(None).cast("string"))
            key = "sample_id" if "sample_id" in rows.columns else rows.columns[0]
            shown, more = contact_sheet(rows, [key], spec.get("limit", 12))
            documents.write_bytes(spark, sinks.markdown_table(shown.select(key, "image_path")).encode(), f"{root}/{spec['output']}")
            made["contact_sheet_specs"].append(spec["output"])
            warnings += more
    if ready and errors:
        raise artifacts.ArtifactError("; ".join(errors))
    return {
        "schema_version": "report-bundle/v1", "source_manifests": listed, "score_reports": reports, "diagnostic_reports": found, "made": made,
        "readiness": {"ready": not errors, "blocking_errors": errors, "warnings": warnings},
    }


# ---------------------------------------------------------------- comparing sources of training data


def provenance(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """position, name, path and state (available or missing) of evidence, in the order it is declared."""
    rows = [(k, n, p, "available" if documents.exists(spark, p) else "missing") for k, (n, p) in enumerate(paths.items())]
    return spark.createDataFrame(rows, "position int, name string, path string, state string")


def compare_sources(spark: SparkSession, generated: dict | None, synthetic: dict | None) -> dict:
    """Distributions and health of both sources side by side; what a report lacks is an empty object."""

    def part(payload: dict | None, key: str) -> dict:
        found = (payload or {}).get(key)
        return found if isinstance(found, dict) else {}

    return {
        "distributions": {
            "content_type": {"generated": part(generated, "content_type_distribution"), "synthetic": {}},
            "style": {"generated": part(generated, "style_distribution"), "synthetic": {"font": part(synthetic, "font_coverage")}},
            "resolution": {"generated": {}, "synthetic": part(synthetic, "resolution_distribution")},
        },
        "health": {k: part(synthetic, k) for k in ("mask_area_fraction", "contrast", "rejection_reasons")} | {"ocr_summary": part(synthetic, "ocr_summary") or None},
        "counts": {"generated": (generated or {}).get("valid_records"), "synthetic": (synthetic or {}).get("sample_count")},
        "expected_help": HELPS,
        "expected_failure": FAILS,
    }


def distribution_frame(spark: SparkSession, comparison: dict) -> DataFrame:
    """dimension, source, value and number of all distributions of a comparison."""
    rows = []
    for dimension, sides in comparison["distributions"].items():
        for side, values in sides.items():
            for value, number in values.items():
                rows += [(dimension, side, f"{value}.{k}", float(v)) for k, v in number.items()] if isinstance(number, dict) else [(dimension, side, value, float(number))]
    return spark.createDataFrame(rows, "dimension string, source string, value string, number double")


# ---------------------------------------------------------------- findings and Markdown


def findings(total: int, missing: int, exact: float | None, detected: float | None, text: float | None) -> list[str]:
    """Sentences on agreement with a gold set."""
    out = [f"{missing} of {total} gold samples have no prediction"] if missing else []
    for name, rate in (("exact match", exact), ("detection", detected), ("text", text)):
        if rate is None:
            out.append(f"{name}: nothing to compare")
        elif rate < 0.9:
            out.append(f"{name}: agreement of {rate:.3f} is below 0.9")
    return out or ["all samples agree"]


def markdown(title: str, sections: dict[str, Any], spark: SparkSession | None = None) -> str:
    """A report as Markdown: frames become tables, lists become bullets, objects become two-column tables."""
    lines = [f"# {title}", ""]
    for name, content in sections.items():
        lines += [f"## {name}", ""]
        if isinstance(content, DataFrame):
            lines.append(sinks.markdown_table(content))
        elif isinstance(content, dict):
            lines += ["| field | value |", "| --- | --- |", *[f"| {k} | {v} |" for k, v in content.items()], ""]
        elif isinstance(content, (list, tuple)):
            lines += [*([f"* {x}" for x in content] or ["* none"]), ""]
        else:
            lines += [str(content), ""]
    return "\n".join(lines).rstrip() + "\n"


def bundle_markdown(bundle: dict) -> str:
    return markdown(
        "Report bundle",
        {
            "Readiness": {"ready": bundle["readiness"]["ready"]},
            "Blocking errors": bundle["readiness"]["blocking_errors"],
            "Warnings": bundle["readiness"]["warnings"],
            "Source manifests": [m["path"] for m in bundle["source_manifests"]],
            "Outputs": [o for made in bundle["made"].values() for o in made],
        },
    )


def diff_markdown(changes: DataFrame) -> str:
    """A manifest diff as one section a kind of change."""
    return markdown("Changes", {kind: changes.where(F.col("change") == kind).drop("change").orderBy("path") for kind in ("added", "removed", "changed")})


def comparison_markdown(mismatches: list[dict]) -> str:
    """Comparability of two runs: what blocks it first."""
    of = lambda s: [f"{m['field']}: {m['reason']} ({m['left']} / {m['right']})" for m in mismatches if m["severity"] == s]
    return markdown("Comparability", {"Blocking": of("blocking"), "Notes": of("note")})


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """position and value of a written report's lines."""
    return readers.numbered_lines(spark, path)

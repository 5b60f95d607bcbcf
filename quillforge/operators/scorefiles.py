"""Score tables as artifacts: a digest of their content, checks of canonical rows, resumable appends and publication."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import boolean, finite, integral
from ..sources import documents

# fixed values: the columns that every canonical score row has, and the states of detection
REQUIRED = (
    "sample_id", "version", "score", "product_score", "target_text", "score_vlm", "score_ocr", "cer", "entropy", "ocr_detected",
    "detection_status", "exact_text_match", "char_accuracy", "char_matches", "char_total", "missing_components", "formula_complete",
    "manifest_path", "text_metrics", "scorer_metadata", "thresholds",
)
DETECTION = ("detected_exact", "detected_mismatch", "not_detected")
NUMBERS = ("score_vlm", "score_ocr", "cer", "entropy", "char_accuracy")


def content_digest(df: DataFrame) -> dict:
    """Rows and a hash that does not depend on their order or on the files they lie in; one distributed pass."""
    h = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in df.columns])
    got = df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    text = "|".join(map(str, (*df.columns, got.n, got.x, got.s)))
    return {"rows": got.n, "sha256": hashlib.sha256(text.encode()).hexdigest()}


def row_errors(rows: DataFrame) -> DataFrame:
    """sample_id, version and error of canonical rows (strings) that can't be used; a row may have several."""

    def given(name: str) -> Column:
        return F.trim(F.coalesce(F.col(name), F.lit(""))) != ""

    def wrong(bad: Column, message: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(True)), F.lit(message))

    found = [
        wrong(~given("sample_id"), "sample_id is blank"),
        wrong(~given("target_text"), "target_text is blank"),
        wrong(integral(F.col("version")).isNull() | (integral(F.col("version")) < 0), "version is no whole number from 0"),
        *[wrong(finite(F.col(c)).isNull(), f"{c} is no finite number") for c in ("score", "product_score")],
        *[wrong(given(c) & finite(F.col(c)).isNull(), f"{c} is no finite number") for c in NUMBERS],
        *[wrong(given(c) & (integral(F.col(c)).isNull() | (integral(F.col(c)) < 0)), f"{c} is no whole number from 0") for c in ("char_matches", "char_total")],
        wrong(~F.col("detection_status").isin(*DETECTION), "detection_status is unknown"),
        *[wrong(boolean(F.col(c)).isNull(), f"{c} is no truth value") for c in ("exact_text_match", "formula_complete")],
        *[wrong(given(c) & F.from_json(F.col(c), "map<string,string>").isNull(), f"{c} is no JSON object") for c in ("text_metrics", "scorer_metadata", "thresholds")],
    ]
    return rows.select("sample_id", "version", F.explode(F.array_compact(F.array(*found))).alias("error"))


def pending(tasks: DataFrame, done: DataFrame | None, keys: list[str]) -> DataFrame:
    """Tasks without a recorded row: what a resumed run still has to do."""
    return tasks if done is None else tasks.join(done.select(*keys).distinct(), keys, "left_anti")


def scored_so_far(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if documents.is_dir(spark, path) and documents.names(spark, path) else None


def append_scores(tasks: DataFrame, path: str, keys: list[str], score, sidecar: dict) -> dict:
    """Score the tasks that are still open, append them as one committed batch, and renew the sidecar.

    Batches are folders of one Parquet table. A batch that fails leaves nothing, as Spark's commit moves its files at the
    end; a batch repeated after a failure of the driver overwrites its own folder. The sidecar says how far the run is.
    """
    spark = tasks.sparkSession
    done = scored_so_far(spark, path)
    batch = 0 if done is None else 1 + done.agg(F.max("batch")).first()[0]
    score(pending(tasks, done, keys)).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    written = spark.read.parquet(path).drop("batch")
    digest, expected = content_digest(written), tasks.count()
    state = {
        "status": "complete" if digest["rows"] == expected else "in_progress",
        "expected_row_count": expected,
        "scored_row_count": digest["rows"],
        "scores_sha256": digest["sha256"],
    }
    out = sidecar | {"execution": sidecar.get("execution", {}) | state}
    documents.write(spark, out, f"{path}.schema.json")
    return out


def publish(rows: DataFrame, path: str, expected: int) -> None:
    """JSON lines that appear whole or not at all: written aside, counted, then moved into place."""
    spark = rows.sparkSession
    aside = f"{path}.unpublished"
    rows.write.mode("overwrite").json(aside)
    n = spark.read.text(aside).count()
    if n != expected:
        documents.delete(spark, aside)
        raise ValueError(f"{path}: {n} rows were written, {expected} expected")
    files, target, _ = documents._place(spark, path)
    files.delete(target, True)
    if not files.rename(spark._jvm.org.apache.hadoop.fs.Path(aside), target):
        raise OSError(f"{path}: could not be put in place")

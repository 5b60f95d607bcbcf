"""The whole report on disagreeing scorers, over one frame: counts, gaps, correlation, false rows, confusions, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.coerce import finite
from .reports import confusions, false_rows, pearson

EVIDENCE = ("score_vlm", "score_ocr", "cer")


def diagnostic_score(rows: DataFrame) -> Column:
    """``product_score`` if the table has that column, even where it is null; else ``score``."""
    return finite(F.col("product_score" if "product_score" in rows.columns else "score"))


def input_errors(rows: DataFrame) -> DataFrame:
    """error and count: samples without an id or text, and ids that occur more than once."""
    blank = F.array(*[F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(f"{c} is blank")) for c in ("sample_id", "target_text")])
    found = rows.select(F.explode(F.array_compact(blank)).alias("error")).groupBy("error").agg(F.count("*").alias("count"))
    twice = rows.where("sample_id is not null").groupBy("sample_id").count().where("count > 1")
    again = twice.agg(F.count("*").alias("count")).where("count > 0").select(F.lit("sample_id occurs more than once").alias("error"), "count")
    return found.unionByName(again)


def missing_evidence(rows: DataFrame) -> DataFrame:
    """Evidence that is not there, and in how many rows: fields without a number, and names the rows list themselves."""
    own = F.array(*[F.when(finite(F.col(c)).isNull(), F.lit(c)) for c in EVIDENCE])
    listed = F.col("missing_components") if "missing_components" in rows.columns else F.array().cast("array<string>")
    names = F.array_distinct(F.concat(F.array_compact(own), F.coalesce(listed, F.array().cast("array<string>"))))
    return rows.select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("count"))


def report(rows: DataFrame, gold: DataFrame, high: float = 0.8, low: float = 0.5, labels: Column | None = None) -> dict[str, DataFrame]:
    """Frames by section. Rows have sample_id, target_text, detected_text, scores and exact_match.

    The frame is read once a section; callers that compute all of them persist it first.
    """
    rows = rows.withColumn("score", diagnostic_score(rows))
    both = finite(F.col("score_vlm")).isNotNull() & finite(F.col("score_ocr")).isNotNull()
    gap = F.lit(False)
    for c in EVIDENCE:
        gap = gap | finite(F.col(c)).isNull()
    wrong = false_rows(rows, gold, high, low)
    labels = T.slice_labels(F.col("target_text")) if labels is None else labels
    sliced = rows.select("sample_id", gap.alias("gap"), F.explode(F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("unsliced")))).alias("slice"))
    kinds = wrong.groupBy("sample_id").agg(F.count_if(F.col("kind") == "false_positive").alias("fp"), F.count_if(F.col("kind") == "false_negative").alias("fn"))
    per_slice = sliced.join(kinds, "sample_id", "left").groupBy("slice").agg(
        F.count("*").alias("records"),
        F.coalesce(F.sum("fp"), F.lit(0)).alias("false_positives"),
        F.coalesce(F.sum("fn"), F.lit(0)).alias("false_negatives"),
        F.count_if("gap").alias("missing_evidence"),
    )
    counts = rows.agg(
        F.count("*").alias("total"), F.count_if(both).alias("with_both"), F.count_if(gap).alias("missing_evidence"),
        F.round(pearson(finite(F.col("score_vlm")), finite(F.col("score_ocr"))), 5).alias("pearson"),
    )
    return {
        "counts": counts,
        "input_errors": input_errors(rows),
        "missing": missing_evidence(rows),
        "false_rows": wrong,
        "confusions": confusions(rows),
        "slices": per_slice,
    }


def sheet(wrong: DataFrame, limit: int = 12) -> DataFrame:
    """Which false rows a contact sheet shows, in order: false positives of the highest score, then false negatives."""
    order = F.when(F.col("kind") == "false_positive", -F.col("score")).otherwise(F.col("score"))
    caption = F.concat_ws(" | ", "kind", "sample_id", F.format_string("%.3f", "score"))
    return wrong.orderBy(F.desc("kind"), order, "sample_id").limit(limit).select("sample_id", "kind", caption.alias("caption"))


def summary(sections: dict[str, DataFrame]) -> DataFrame:
    """All sections as section, key, value (a number as text): a report small enough to store as one table."""
    def part(section: str, key: Column, value: Column) -> DataFrame:
        return sections[section].select(F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("string").alias("value"))

    counts = sections["counts"].select(F.lit("counts").alias("section"), F.explode(F.create_map(*[x for c in ("total", "with_both", "missing_evidence") for x in (F.lit(c), F.col(c).cast("string"))])).alias("key", "value"))
    out = counts.unionByName(part("input_errors", F.col("error"), F.col("count"))).unionByName(part("missing", F.col("name"), F.col("count")))
    kinds = sections["false_rows"].groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("false_rows").alias("section"), F.col("kind").alias("key"), F.col("n").cast("string").alias("value"))
    for name in ("records", "false_positives", "false_negatives", "missing_evidence"):
        out = out.unionByName(part("slices", F.concat_ws("/", "slice", F.lit(name)), F.col(name)))
    return out.unionByName(kinds)

"""Benchmark, bias, diagnostics and gold reports as aggregations over score rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as M
from ..functions import text as T
from ..functions.coerce import finite
from .ranges import ranks


def mean(value: Column) -> Column:
    return F.round(F.avg(value), 6)


def median(value: Column) -> Column:
    """Exact, for values of few distinct kinds (lengths, error rates of short texts), as one buffer a group counts them;
    ``ranges.medians`` is for all others."""
    return F.round(F.median(value), 6)


def share(flag: Column) -> Column:
    return F.round(F.avg(flag.cast("double")), 6)


def augment(rows: DataFrame) -> DataFrame:
    """Benchmark columns of score rows with target_text and detected_text; nothing detected means an error rate of 1."""
    found, target = F.coalesce("detected_text", F.lit("")), F.coalesce("target_text", F.lit(""))
    strict = F.when(found == "", 1.0).otherwise(T.error_rate(found, target))
    loose = F.when(found == "", 1.0).otherwise(T.error_rate(found, target, True))
    glyphs = T.hard_glyphs(target)
    return rows.select(
        "*",
        T.letters(target).alias("target_length"),
        F.array_join(glyphs, ",").alias("hard_glyphs"),
        (F.size(glyphs) > 0).alias("contains_hard_glyph"),
        T.homoglyphs(found).alias("ocr_detected_normalized"),
        (F.trim(found) != "").alias("detected"),
        strict.alias("strict_cer"),
        loose.alias("normalized_cer"),
        (T.normal_match(found) == T.normal_match(target)).alias("strict_exact"),
        (T.normal_match(found, True) == T.normal_match(target, True)).alias("normalized_exact"),
        (F.col("score_vlm") * F.col("score_ocr")).alias("simple_product_score"),
        *[c.alias(n) for n, c in T.script_mix(found).items()],
    )


def summary_columns() -> list[Column]:
    return [
        F.count("*").alias("n"),
        share(F.col("detected")).alias("detection_rate"),
        share(F.col("strict_exact")).alias("strict_exact_rate"),
        share(F.col("normalized_exact")).alias("normalized_exact_rate"),
        mean(F.col("strict_cer")).alias("strict_cer_mean"),
        median(F.col("strict_cer")).alias("strict_cer_median"),
        mean(F.col("normalized_cer")).alias("normalized_cer_mean"),
        median(F.col("normalized_cer")).alias("normalized_cer_median"),
        share(F.col("script_mixing_flag")).alias("script_mixing_rate"),
        mean(F.col("latin_letter_rate")).alias("latin_letter_rate_mean"),
        mean(F.col("score_vlm")).alias("score_vlm_mean"),
        mean(F.col("score_ocr")).alias("score_ocr_mean"),
        mean(F.col("simple_product_score")).alias("simple_product_score_mean"),
        mean(F.col("score")).alias("recorded_product_score_mean"),
    ]


def benchmark_report(augmented: DataFrame, run: str = "run", part: str = "slice") -> DataFrame:
    """Summaries per run and per run and slice in one pass (grouping sets); slice is ``all`` for a whole run."""
    whole = F.grouping(part) == 1
    out = augmented.groupingSets([[F.col(run)], [F.col(run), F.col(part)]], run, part).agg(whole.alias("_whole"), *summary_columns())
    return out.withColumn(part, F.when(F.col("_whole"), F.lit("all")).otherwise(F.col(part))).drop("_whole")


def distribution(rows: DataFrame, key: str, name: str = "value") -> DataFrame:
    """Count and fraction of each value; null is ``unknown``, an empty string stays."""
    counts = rows.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias(name)).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return counts.withColumn("fraction", F.round(F.col("count") / total, 6))


def grouped(rows: DataFrame, key: str) -> DataFrame:
    """Counts per value; null and empty are both ``unknown``."""
    return rows.groupBy(F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit("unknown")).alias(key)).agg(F.count("*").alias("count"))


def distribution_delta(every: DataFrame, some: DataFrame) -> DataFrame:
    a = every.select(F.col("value"), F.col("fraction").alias("a"))
    b = some.select(F.col("value"), F.col("fraction").alias("b"))
    both = a.join(b, "value", "full_outer")
    return both.select("value", F.round(F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0)), 6).alias("delta"))


def bias_report(augmented: DataFrame, least: float) -> DataFrame:
    """One row: all rows against selected ones."""
    chosen = F.col("score") >= least

    def both(name: str, of) -> list[Column]:
        return [of(F.col(name)).alias(f"{name}_all"), of(F.when(chosen, F.col(name))).alias(f"{name}_selected")]

    got = augmented.agg(
        F.count("*").alias("rows_all"),
        F.count_if(chosen).alias("rows_selected"),
        F.count_distinct("id").alias("prompts_all"),
        F.count_distinct(F.when(chosen, F.col("id"))).alias("prompts_selected"),
        *both("target_length", median),
        *both("score", mean),
        *[c.alias(f"hard_share_{k}") for k, c in (("all", share(F.col("contains_hard_glyph"))), ("selected", share(F.when(chosen, F.col("contains_hard_glyph")))))],
    )
    return got.withColumn("median_length_delta", F.round(F.col("target_length_selected") - F.col("target_length_all"), 6))


def with_medians(out: DataFrame, middles: DataFrame, by: list[str]) -> DataFrame:
    """Add medians to a report; both have a row a key, and null keys meet null keys."""
    if not by:
        return out.crossJoin(F.broadcast(middles))  # one row each
    right = middles.select(*[F.col(k).alias(f"_{k}") for k in by], *[c for c in middles.columns if c not in by])
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return out.join(right, same, "left").drop(*[f"_{k}" for k in by])


def pearson(x: Column, y: Column) -> Column:
    """Null for one row or no variance, where the built-in raises."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 1e-15, F.covar_pop(x, y) / F.when(spread > 1e-15, spread))


def compare_scorers(rows: DataFrame, a: str, b: str, cut: float = 0.5) -> DataFrame:
    ranked = ranks(ranks(rows, a, "_ra"), b, "_rb")
    d = F.col(a) - F.col(b)
    return ranked.agg(
        F.count("*").alias("n"),
        mean(d).alias("mean_diff"),
        F.round(F.stddev_pop(d), 6).alias("std_diff"),
        F.round(F.max(F.abs(d)), 6).alias("max_abs_diff"),
        F.round(pearson(F.col(a), F.col(b)), 6).alias("pearson"),
        F.round(pearson(F.col("_ra"), F.col("_rb")), 6).alias("spearman"),
        share((F.col(a) >= cut) == (F.col(b) >= cut)).alias("agreement"),
    )


EDGES = (0.0, 0.1, 0.3, 0.5, 0.7, 0.9, 1.01)


def histogram(value: Column, edges: tuple[float, ...] = EDGES) -> Column:
    """Label of the bucket; null outside the edges."""
    parts = [F.when((value >= a) & (value < b), F.lit(f"[{a:g},{b:g})")) for a, b in zip(edges, edges[1:], strict=False)]
    return F.coalesce(*parts)


def expected_positive(label: Column, expected: Column, exact: Column) -> Column:
    """A human label decides first, then the gold expectation, then the row's own exact match."""
    low = F.lower(label)
    return F.coalesce(
        F.when(low.isin("pass", "positive", "ok", "true"), True).when(low.isin("fail", "negative", "bad", "false"), False), expected, exact
    )


def false_rows(rows: DataFrame, gold: DataFrame, high: float, low: float) -> DataFrame:
    """kind false_positive or false_negative; rows without a score or an expectation are left out."""
    joined = rows.join(gold.select("sample_id", "human_label", "expected_exact_match"), "sample_id", "left")
    want = expected_positive(F.col("human_label"), F.col("expected_exact_match"), F.col("exact_match"))
    s = finite(F.col("score"))
    kind = F.when((s >= high) & ~want, "false_positive").when((s <= low) & want, "false_negative")
    return joined.withColumn("kind", kind).where("kind is not null")


def confusions(rows: DataFrame) -> DataFrame:
    """Characters taken for others, by position, with the number of distinct samples; a missing character is ∅."""
    pairs = F.arrays_zip(T.chars(F.col("target_text")).alias("expected"), T.chars(F.col("detected_text")).alias("observed"))
    some = rows.where("target_text <> '' and detected_text <> ''")
    each = some.select("sample_id", F.explode(F.array_distinct(pairs)).alias("p"))
    each = each.select("sample_id", F.coalesce("p.expected", F.lit("∅")).alias("expected"), F.coalesce("p.observed", F.lit("∅")).alias("observed"))
    return each.where("expected <> observed").groupBy("expected", "observed").agg(F.count_distinct("sample_id").alias("count"))


def gold_report(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Agreement counters; the first prediction of a sample (lowest position) counts."""
    first = predictions.groupBy("sample_id").agg(F.min_by(F.struct("exact_text_match", "ocr_detected", "detected_text"), "position").alias("p"))
    both = gold.join(first, "sample_id", "left")
    same = T.normal_words(F.col("target_text")) == T.normal_words(F.col("p.detected_text"))
    return both.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("p").isNull()).alias("missing"),
        F.count_if(F.col("p.exact_text_match") == F.col("expected_exact_match")).alias("exact_agree"),
        F.count_if(F.col("p.exact_text_match") != F.col("expected_exact_match")).alias("exact_disagree"),
        F.count_if(F.col("p.ocr_detected") == F.col("expected_ocr_detected")).alias("detection_agree"),
        F.count_if(same).alias("text_agree"),
    )


def few(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """The rows as a table on the driver, if they are few; a grid over more of them is refused."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows to build a grid from")
    return rows.sparkSession.createDataFrame(got, rows.schema)


def coverage(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Violations of benchmark coverage per seed: missing, duplicate, unknown and mismatched rows."""
    seeds = F.broadcast(few(rows.select("seed").distinct()))
    grid = expected.select("id", F.col("target_text").alias("wanted")).crossJoin(seeds)
    n = rows.groupBy("seed", "id").agg(F.count("*").alias("n"), F.max("target_text").alias("got"))
    both = grid.join(n, ["seed", "id"], "full_outer")
    what = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unknown").when(F.col("n") > 1, "duplicate")
    return both.withColumn("violation", what.when(T.normal_match(F.col("got")) != T.normal_match(F.col("wanted")), "target_mismatch")).where("violation is not null")


def labelled(rows: DataFrame, labels: Column) -> DataFrame:
    """A row per label; rows without any are ``unsliced``."""
    return rows.withColumn("label", F.explode(F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("unsliced")))))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def validation_loss(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean over anchors of the mean loss over batches, so that an anchor counts once however many batches it has."""
    anchors = rows.groupBy(*by, "anchor").agg(F.avg("loss").alias("_m"))
    return anchors.groupBy(*by).agg(mean(F.col("_m")).alias("loss"), F.count("*").alias("anchors"))


def preference_metrics(rows: DataFrame, scale: float, by: list[str]) -> DataFrame:
    """Loss, margin and accuracy of preference batches, from the losses of policy and reference on winner and loser."""
    z = M.preference_logit(F.col("winner_policy"), F.col("loser_policy"), F.col("winner_reference"), F.col("loser_reference"), F.lit(scale))
    found = rows.withColumn("_z", z)
    return found.groupBy(*by).agg(mean(M.preference_loss(F.col("_z"))).alias("loss"), mean(F.col("_z")).alias("margin"), share(F.col("_z") > 0).alias("accuracy"))

"""Selection of fine-tuning samples and preference pairs from score rows (id, version, score, ...).

Everything is one shuffle on ``id`` at most. Ties between versions go to the higher version for winners and to the lower
one for losers, as rows order by (score, version). Scores that are null or not finite must have been refused before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_prompt() -> Window:
    return Window.partitionBy("id")


def threshold(rows: DataFrame, least: float, score: str = "score") -> DataFrame:
    return rows.where(F.col(score) >= least)


def top_k(rows: DataFrame, least: float, k: int, score: str = "score") -> DataFrame:
    """At most k rows a prompt among those that pass, best first, then lower versions."""
    rank = F.row_number().over(per_prompt().orderBy(F.desc(score), "version"))
    return threshold(rows, least, score).withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def hard_positive(rows: DataFrame, least: float, hard: float, score: str = "score") -> DataFrame:
    """Rows that pass, in prompts that also have a version below the hard threshold."""
    low = F.min(score).over(per_prompt())
    return rows.withColumn("_low", low).where((F.col(score) >= least) & (F.col("_low") < hard)).drop("_low")


def sample_weights(rows: DataFrame, score: str = "score") -> DataFrame:
    """score / greatest score of the selection, 12 decimals; zero if that is not positive."""
    top = rows.agg(F.max(score).alias("_top"))
    weight = F.when(F.col("_top") > 0, F.bround(F.col(score) / F.col("_top"), 12)).otherwise(0.0)
    return rows.crossJoin(F.broadcast(top)).withColumn("sample_weight", weight).drop("_top")  # one row


def select_samples(rows: DataFrame, mode: str, least: float = 0.3, score: str = "score", k: int = 1, hard: float = 0.2) -> DataFrame:
    if mode == "threshold":
        return threshold(rows, least, score)
    if mode == "score_weighted":
        return sample_weights(threshold(rows, least, score), score)
    if mode == "top_k_per_prompt":
        return top_k(rows, least, k, score)
    if mode == "hard_positive":
        return hard_positive(rows, least, hard, score)
    raise ValueError(f"unknown selection mode {mode!r}")


def sample_rows(selected: DataFrame, mode: str, least: float, score: str = "score", hard: float | None = None) -> DataFrame:
    """Output rows of a selection, with where they come from."""
    return selected.select(
        F.concat_ws(":", F.lit("sft"), "id", F.concat(F.lit("v"), F.col("version")), F.lit(score)).alias("sample_id"),
        F.col("id").alias("prompt_id"),
        "version",
        F.col(score).alias("selected_score"),
        F.lit(mode).alias("selection_mode"),
        F.lit(least).alias("score_threshold"),
        F.lit(hard).cast("double").alias("hard_negative_threshold"),
    )


def sample_stats(rows: DataFrame, least: float, k: int, hard: float, score: str = "score") -> DataFrame:
    """One row of counts over all modes, from one pass over prompts."""
    s = F.col(score)
    each = rows.groupBy("id").agg(
        F.count("*").alias("n"), F.count_if(s >= least).alias("passing"), F.coalesce(F.min(s) < hard, F.lit(False)).alias("has_hard")
    )
    return each.agg(
        F.sum("n").alias("total"),
        F.sum(F.col("n") - F.col("passing")).alias("below_threshold"),
        F.sum("passing").alias("selected_threshold"),
        F.sum(F.least("passing", F.lit(k))).alias("selected_top_k"),
        F.sum(F.greatest(F.col("passing") - k, F.lit(0))).alias("unselected_by_top_k"),
        F.sum(F.when(F.col("has_hard"), F.col("passing")).otherwise(0)).alias("selected_hard_positive"),
        F.count_if(~F.col("has_hard")).alias("prompts_without_hard_negative"),
    )


REASONS = ("insufficient_versions", "winner_below_threshold", "ambiguous_best_second_margin", "ambiguous_below_margin", "selected")


def best_and_worst(rows: DataFrame, score: str = "score") -> DataFrame:
    """id, best, second and worst (structs of score and version), n: one aggregation, two best by a bounded array."""
    key = F.struct(F.col(score).alias("score"), F.col("version").alias("version"))
    return rows.groupBy("id").agg(F.max(key).alias("best"), F.min(key).alias("worst"), F.count("*").alias("n"))


def with_second(rows: DataFrame, score: str = "score") -> DataFrame:
    """As ``best_and_worst`` with the second best score, for the ambiguity rule."""
    rank = F.row_number().over(per_prompt().orderBy(F.desc(score), F.desc("version")))
    key = F.struct(F.col(score).alias("score"), F.col("version").alias("version"))
    return (
        rows.withColumn("_rank", rank)
        .groupBy("id")
        .agg(F.max(key).alias("best"), F.min(key).alias("worst"), F.count("*").alias("n"), F.max(F.when(F.col("_rank") == 2, F.col(score))).alias("second"))
    )


def reason(least: float, margin: float, ambiguity: float, strict: bool = True, second: bool = False) -> Column:
    """The first rule that a prompt fails, else ``selected``."""
    gap = F.col("best.score") - F.col("worst.score")
    near = (gap <= ambiguity) | (gap < margin) if strict else gap < margin
    out = F.when(F.col("n") < 2, REASONS[0]).when(F.col("best.score") < least, REASONS[1])
    if second:
        out = out.when(F.col("best.score") - F.col("second") <= ambiguity, REASONS[2])
    return out.when(near, REASONS[3]).otherwise(REASONS[4])


def pair_rows(prompts: DataFrame, score: str = "score") -> DataFrame:
    """Pairs with their margin at 12 decimals; filters have used the raw difference."""
    return prompts.select(
        F.concat_ws(
            ":", F.lit("dpo"), "id", F.concat(F.lit("w"), F.col("best.version")), F.concat(F.lit("l"), F.col("worst.version")), F.lit(score)
        ).alias("pair_id"),
        F.col("id").alias("prompt_id"),
        F.col("best.version").alias("winner_version"),
        F.col("worst.version").alias("loser_version"),
        F.col("best.score").alias("winner_score"),
        F.col("worst.score").alias("loser_score"),
        F.bround(F.col("best.score") - F.col("worst.score"), 12).alias("margin"),
    )


def pair_weights(pairs: DataFrame) -> DataFrame:
    top = pairs.agg(F.max("margin").alias("_top"))
    weight = F.when(F.col("_top") > 0, F.bround(F.col("margin") / F.col("_top"), 12)).otherwise(0.0)
    return pairs.crossJoin(F.broadcast(top)).withColumn("pair_weight", weight).drop("_top")  # one row


def separated_pairs(rows: DataFrame, least: float, margin: float, score: str = "score") -> DataFrame:
    """Every two versions of a prompt, labelled; the winner has the higher score."""
    a = rows.select("id", F.col("version").alias("va"), F.col(score).alias("sa"))
    b = rows.select("id", F.col("version").alias("vb"), F.col(score).alias("sb"))
    both = a.join(b, "id").where("va < vb")
    up = F.col("sa") > F.col("sb")
    high, low = F.greatest("sa", "sb"), F.least("sa", "sb")
    label = F.when(F.col("sa") == F.col("sb"), "equal_score").when(high < least, REASONS[1]).when(high - low < margin, REASONS[3]).otherwise(REASONS[4])
    return both.select(
        "id",
        F.when(up, F.struct(F.col("sa").alias("score"), F.col("va").alias("version"))).otherwise(F.struct(F.col("sb").alias("score"), F.col("vb").alias("version"))).alias("best"),
        F.when(up, F.struct(F.col("sb").alias("score"), F.col("vb").alias("version"))).otherwise(F.struct(F.col("sa").alias("score"), F.col("va").alias("version"))).alias("worst"),
        label.alias("reason"),
    )


def select_pairs(rows: DataFrame, mode: str, least: float = 0.5, margin: float = 0.1, ambiguity: float = 0.0, score: str = "score") -> DataFrame:
    if mode in ("best_vs_worst", "margin_weighted", "loader"):
        prompts = best_and_worst(rows, score).where(reason(least, margin, ambiguity, strict=mode != "loader") == "selected")
        pairs = pair_rows(prompts, score)
        return pair_weights(pairs) if mode == "margin_weighted" else pairs
    if mode == "ambiguity_filtered":
        return pair_rows(with_second(rows, score).where(reason(least, margin, ambiguity, second=True) == "selected"), score)
    if mode == "all_separated_pairs":
        return pair_rows(separated_pairs(rows, least, margin, score).where("reason = 'selected'"), score)
    raise ValueError(f"unknown pair mode {mode!r}")


def with_zeros(counts: DataFrame, labels: tuple[str, ...], name: str = "reason") -> DataFrame:
    """Counts for every label, zero included."""
    every = counts.sparkSession.createDataFrame([(x,) for x in labels], f"{name} string")
    return F.broadcast(every).join(counts, name, "left").select(name, F.coalesce("count", F.lit(0)).alias("count"))


def margin_ablation(rows: DataFrame, margins: list[float], least: float, score: str = "score") -> DataFrame:
    """How many prompts would give a pair, for each margin; one pass over prompts."""
    each = best_and_worst(rows, score).where((F.col("n") >= 2) & (F.col("best.score") >= least))
    gap = F.col("best.score") - F.col("worst.score")
    got = each.agg(*[F.count_if(gap >= m).alias(str(k)) for k, m in enumerate(margins)])
    return got.select(F.explode(F.array(*[F.struct(F.lit(float(m)).alias("margin"), F.col(f"`{k}`").alias("pairs")) for k, m in enumerate(margins)])).alias("x")).select("x.*")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1")


def violations_of_samples(samples: DataFrame, source: DataFrame, least: float, score: str = "score") -> DataFrame:
    """Samples whose source row is missing, has another score, or is below the threshold."""
    own = source.select(F.col("id").alias("prompt_id"), F.col("version"), F.col(score).alias("source_score"))
    joined = samples.join(own, ["prompt_id", "version"], "left")
    what = F.when(F.col("source_score").isNull(), "missing").when(F.col("source_score") != F.col("selected_score"), "changed")
    return joined.withColumn("violation", what.when(F.col("selected_score") < least, "below_threshold")).where("violation is not null")


def violations_of_pairs(pairs: DataFrame, source: DataFrame, least: float, margin: float, score: str = "score") -> DataFrame:
    w = source.select(F.col("id").alias("prompt_id"), F.col("version").alias("winner_version"), F.col(score).alias("w"))
    x = source.select(F.col("id").alias("prompt_id"), F.col("version").alias("loser_version"), F.col(score).alias("l"))
    joined = pairs.join(w, ["prompt_id", "winner_version"], "left").join(x, ["prompt_id", "loser_version"], "left")
    what = (
        F.when(F.col("w").isNull() | F.col("l").isNull(), "missing")
        .when((F.col("w") != F.col("winner_score")) | (F.col("l") != F.col("loser_score")), "changed")
        .when(F.col("winner_version") == F.col("loser_version"), "same_version")
        .when(F.col("winner_score") <= F.col("loser_score"), "inverted")
        .when(F.col("winner_score") < least, "below_threshold")
        .when(F.col("winner_score") - F.col("loser_score") < margin, "below_margin")
    )
    return joined.withColumn("violation", what).where("violation is not null")

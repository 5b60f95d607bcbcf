"""Registered queries by operator id, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import coerce as C
from ..functions import scores as M
from ..functions import text as T
from ..operators import prompts as P
from ..operators import quality as Q
from ..operators import reconcile as K
from ..operators import reports as R
from ..operators import selection as S
from ..operators import series as E
from ..operators.ranges import medians, numbered
from ..operators.scorers import scored
from ..session import work_folder
from ..sources import adapters as A
from ..sources import readers, sinks
from ..sources.adapters import oracle
from .. import streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
c = F.col


def add(name: str, sql: str | None = None, frames: str = "") -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = oracle(frames, sql)
        return f

    return keep


def on(source: Callable, name: str, sql: str, frames: str, build: Callable[[DataFrame], DataFrame]) -> None:
    """A query over one canonical frame."""
    add(name, sql, frames)(lambda spark, d: build(source(spark, d)))


scores, pairs, scored_texts, prompts, metrics = A.score_rows, A.text_pairs, A.scored_texts, A.prompts, A.metrics
SR, TP, ST, PR, ME = "score_rows", "text_pairs", "scored_texts", "prompts", "metrics"
LOW = "trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '\\s+', ' ', 'g'))"
UP = "trim(regexp_replace(upper(replace({0}, 'ß', 'SS')), '\\s+', ' ', 'g'))"

# ---------------------------------------------------------------- selection
on(scores, "sel_01", "SELECT id, version, score FROM score_rows WHERE score >= 0.3", SR, lambda r: S.threshold(r, 0.3).select("id", "version", "score"))
on(
    scores, "sel_02",
    """SELECT id, version, score FROM (SELECT *, min(score) OVER (PARTITION BY id) AS low FROM score_rows) WHERE score >= 0.3 AND low < 0.1""",
    SR, lambda r: S.hard_positive(r, 0.3, 0.1).select("id", "version", "score"),
)
on(
    scores, "sel_03", "SELECT id, version, score, round(score / (SELECT max(score) FROM score_rows), 9) AS sample_weight FROM score_rows WHERE score >= 0.3",
    SR, lambda r: S.select_samples(r, "score_weighted", 0.3).select("id", "version", "score", F.round("sample_weight", 9).alias("sample_weight")),
)
on(
    scores, "sel_04",
    """SELECT 'sft:' || id || ':v' || version || ':score' AS sample_id, id AS prompt_id, version, score AS selected_score, 'threshold' AS selection_mode,
    CAST(0.3 AS DOUBLE) AS score_threshold FROM score_rows WHERE score >= 0.3""",
    SR, lambda r: S.sample_rows(S.threshold(r, 0.3), "threshold", 0.3).drop("hard_negative_threshold"),
)
PAIR = "SELECT * REPLACE (round(margin, 9) AS margin) FROM pairs"


def _nine(df: DataFrame) -> DataFrame:
    return df.withColumn("margin", F.round("margin", 9))


on(scores, "sel_05", PAIR, "pairs", lambda r: _nine(S.select_pairs(r, "best_vs_worst")))
on(
    scores, "sel_06", "SELECT id, version FROM score_rows WHERE score >= 0.25", SR,
    lambda r: r.withColumn("s", c("score").cast("string")).where(C.finite(c("s")) >= 0.25).select("id", "version"),
)


def _diagnostic(spark: SparkSession, d: str) -> DataFrame:
    return prompts(spark, d).select(c("id").alias("sample_id"), (c("n_chars") % 101 / 100).alias("score"), (c("n_chars") % 2 == 0).alias("exact_match"))


DIAG = "(SELECT id AS sample_id, n_chars % 101 / 100 AS score, n_chars % 2 = 0 AS exact_match FROM prompts)"


@add(
    "sel_07",
    f"""SELECT sample_id, kind FROM (SELECT sample_id, CASE WHEN score >= 0.8 AND NOT w THEN 'false_positive' WHEN score <= 0.5 AND w THEN 'false_negative' END AS kind
    FROM (SELECT d.sample_id, score, coalesce(CASE human_label WHEN 'pass' THEN true WHEN 'fail' THEN false END, exact_match) AS w FROM {DIAG} d LEFT JOIN gold USING (sample_id)))
    WHERE kind IS NOT NULL""",
    "prompts gold",
)
def sel_07(spark, d):
    return R.false_rows(_diagnostic(spark, d), A.gold(spark, d), 0.8, 0.5).select("sample_id", "kind")


add("sel_08", f"SELECT sample_id FROM {DIAG} ORDER BY score < 0.5 DESC, sample_id LIMIT 12", PR)(
    lambda s, d: _diagnostic(s, d).orderBy((c("score") < 0.5).desc(), "sample_id").limit(12).select("sample_id")
)
on(
    lambda s, d: A.table(s, d, "part"), "sel_09",
    """SELECT p_partkey, concat_ws(',', CASE WHEN p_size < 5 THEN 'size_low' END, CASE WHEN p_size > 45 THEN 'size_high' END, CASE WHEN p_retailprice < 950 THEN 'contrast_low' END) AS reasons FROM part""",
    "", lambda p: p.select("p_partkey", F.concat_ws(",", F.array_compact(F.array(F.when(c("p_size") < 5, "size_low"), F.when(c("p_size") > 45, "size_high"), F.when(c("p_retailprice") < 950, "contrast_low")))).alias("reasons")),
)

# ---------------------------------------------------------------- pairs and windows
on(scores, "pair_01", PAIR, "pairs", lambda r: _nine(S.select_pairs(r, "best_vs_worst", 0.5, 0.1)))
on(
    scores, "pair_02",
    """SELECT prompt_id, winner_version, loser_version FROM pairs JOIN (SELECT id, max(score) FILTER (k = 2) AS s2, max(score) AS s1 FROM
    (SELECT id, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, version DESC) AS k FROM score_rows) GROUP BY id) ON id = prompt_id WHERE s1 - s2 > 0.05""",
    "pairs", lambda r: S.pair_rows(S.with_second(r).where((S.reason(0.5, 0.1, 0.0) == "selected") & (c("best.score") - c("second") > 0.05))).select("prompt_id", "winner_version", "loser_version"),
)
on(
    scores, "pair_03", "SELECT pair_id, round(margin / (SELECT max(margin) FROM pairs), 9) AS pair_weight FROM pairs", "pairs",
    lambda r: S.select_pairs(r, "margin_weighted").select("pair_id", F.round("pair_weight", 9).alias("pair_weight")),
)
on(
    scores, "pair_04", "SELECT prompt_id, winner_version, loser_version FROM pairs ORDER BY 1, 2, 3", "pairs",
    lambda r: S.select_pairs(r, "best_vs_worst").select("prompt_id", "winner_version", "loser_version").orderBy("prompt_id", "winner_version", "loser_version"),
)
on(
    scores, "pair_05", "SELECT id AS prompt_id, b.v AS winner_version, w.v AS loser_version FROM best WHERE n >= 2 AND b.s >= 0.5 AND b.s - w.s >= 0", "best",
    lambda r: S.select_pairs(r, "loader", 0.5, 0.0).select("prompt_id", "winner_version", "loser_version"),
)
on(
    scores, "win_01", "SELECT id, version, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, version) AS k FROM score_rows WHERE score >= 0.3) WHERE k <= 2",
    SR, lambda r: S.top_k(r, 0.3, 2).select("id", "version", "score"),
)
on(
    scores, "win_02", "SELECT id, version, round(score / (SELECT max(score) FROM score_rows WHERE score >= 0.5), 9) AS w FROM score_rows WHERE score >= 0.5",
    SR, lambda r: S.sample_weights(S.threshold(r, 0.5)).select("id", "version", F.round("sample_weight", 9).alias("w")),
)
on(
    scores, "win_03", "SELECT pair_id, round(coalesce(CASE WHEN prompt_id % 5 = 0 THEN 0.25 END, margin / (SELECT max(margin) FROM pairs)), 9) AS w FROM pairs", "pairs",
    lambda r: S.pair_weights(S.select_pairs(r, "best_vs_worst")).select("pair_id", F.round(F.coalesce(F.when(c("prompt_id") % 5 == 0, 0.25), c("pair_weight")), 9).alias("w")),
)
on(
    metrics, "win_04",
    """SELECT user_id, step, round(CASE WHEN n < 5 THEN reward ELSE sm END, 6) AS smoothed FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n,
    avg(reward) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS sm FROM metrics) WHERE step >= 5 OR n < 5""",
    ME, lambda m: E.moving_average(m, "reward", "step", 5, ["user_id"]).select("user_id", "step", F.round("smoothed", 6).alias("smoothed")),
)
on(
    metrics, "win_05", "SELECT user_id, step, round(step / greatest(reward / 100, 0.1), 6) AS rate FROM metrics", ME,
    lambda m: m.select("user_id", "step", F.round(E.throughput(c("step"), c("reward") / 100), 6).alias("rate")),
)
add(
    "win_06",
    """WITH raw AS (SELECT style AS name, 1000 * count(*) / sum(count(*)) OVER () AS raw FROM (SELECT source AS style FROM documents) GROUP BY 1),
    k AS (SELECT *, floor(raw) AS base, row_number() OVER (ORDER BY round(raw - floor(raw), 12) DESC, name) AS rank, 1000 - sum(floor(raw)) OVER () AS rest FROM raw)
    SELECT name, CAST(base + CASE WHEN rank <= rest THEN 1 ELSE 0 END AS BIGINT) AS samples FROM k""",
)(lambda s, d: Q.allocate(prompts(s, d).groupBy(c("style").alias("name")).agg(F.count("*").alias("weight")).withColumn("priority", F.lit(0)), 1000))
on(
    prompts, "win_07", "SELECT target_text, arg_min(style, id) AS style, min(id) AS id FROM prompts GROUP BY target_text", PR,
    lambda p: Q.first_wins(p.select("target_text", "style", "id", c("id").alias("position")), ["target_text"], "position").select("target_text", "style", "id"),
)
on(
    prompts, "win_08", "SELECT id, CASE WHEN k > 1 THEN target_text || ' ' || k ELSE target_text END AS t FROM (SELECT *, row_number() OVER (PARTITION BY target_text, content_type ORDER BY id) AS k FROM prompts)",
    PR, lambda p: P.with_numbers_on_repeats(p.withColumn("t", c("target_text")), "t", ["target_text", "content_type"], "id").select("id", "t"),
)


on(
    prompts, "win_09", "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM prompts) WHERE k % 4 = 1", PR,
    lambda p: numbered(p, "id").where("position % 4 = 1").select("id"),
)


@add("win_10", "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM prompts) WHERE k >= ceil(n / 4) AND k < 2 * ceil(n / 4)", PR)
def win_10(spark, d):
    p = prompts(spark, d)
    size = -(-p.count() // 4)
    return numbered(p, "id").where((c("position") >= size) & (c("position") < 2 * size)).select("id")


SCENES = ["street", "shop", "book", "poster", "label", "sign"]
on(
    prompts, "win_11", f"SELECT id, ({SCENES})[CAST((row_number() OVER (ORDER BY id) - 1) % 6 AS INT) + 1] AS scene FROM prompts", PR,
    lambda p: numbered(p, "id").select("id", F.element_at(F.array(*map(F.lit, SCENES)), (c("position") % 6 + 1).cast("int")).alias("scene")),
)


@add(
    "win_12",
    f"""SELECT slice, position FROM (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY position) AS n FROM (SELECT content_type AS slice, id AS position, row_number() OVER
    (PARTITION BY {UP.format("target_text")} ORDER BY id) AS k FROM prompts WHERE {UP.format("target_text")} NOT IN (SELECT {UP.format("text")} FROM benchmark)) WHERE k = 1) WHERE n <= 20""",
    PR,
)
def win_12(spark, d):
    rows = prompts(spark, d).select(c("content_type").alias("slice"), c("id").alias("position"), "target_text")
    excluded = readers.excluded_targets(A.table(spark, d, "benchmark"), "text")
    return Q.slice_quota(rows, excluded, 20, T.normal_target(c("target_text"))).select("slice", "position")


# ---------------------------------------------------------------- aggregations
on(scores, "agg_01", "SELECT id, count(*) AS n, max(score) AS best FROM score_rows GROUP BY id", SR, lambda r: r.groupBy("id").agg(F.count("*").alias("n"), F.max("score").alias("best")))
on(prompts, "agg_02", "SELECT coalesce(nullif(content_type, ''), 'unknown') AS content_type, count(*) AS count FROM prompts GROUP BY 1", PR, lambda p: R.grouped(p, "content_type"))
on(
    scores, "agg_03",
    """SELECT sum(n)::BIGINT AS total, sum(n - p)::BIGINT AS below_threshold, sum(p)::BIGINT AS selected_threshold, sum(least(p, 2))::BIGINT AS selected_top_k, sum(greatest(p - 2, 0))::BIGINT AS unselected_by_top_k,
    sum(CASE WHEN h THEN p ELSE 0 END)::BIGINT AS selected_hard_positive, count(*) FILTER (NOT h) AS prompts_without_hard_negative
    FROM (SELECT id, count(*) AS n, count(*) FILTER (score >= 0.3) AS p, min(score) < 0.1 AS h FROM score_rows GROUP BY id)""",
    SR, lambda r: S.sample_stats(r, 0.3, 2, 0.1),
)
REASONS = "(VALUES ('insufficient_versions'), ('winner_below_threshold'), ('ambiguous_best_second_margin'), ('ambiguous_below_margin'), ('selected')) v(reason)"
on(
    scores, "agg_04",
    f"""SELECT v.reason, coalesce(count, 0) AS count FROM {REASONS} LEFT JOIN (SELECT CASE WHEN n < 2 THEN 'insufficient_versions' WHEN b.s < 0.5 THEN 'winner_below_threshold'
    WHEN b.s - w.s <= 0 OR b.s - w.s < 0.1 THEN 'ambiguous_below_margin' ELSE 'selected' END AS reason, count(*) AS count FROM best GROUP BY 1) x ON x.reason = v.reason""",
    "best", lambda r: S.with_zeros(S.best_and_worst(r).groupBy(S.reason(0.5, 0.1, 0.0).alias("reason")).count(), S.REASONS),
)
ALL_PAIRS = """SELECT a.id, CASE WHEN a.score > b.score THEN a.version ELSE b.version END AS wv, CASE WHEN a.score > b.score THEN b.version ELSE a.version END AS lv,
  CASE WHEN a.score = b.score THEN 'equal_score' WHEN greatest(a.score, b.score) < 0.5 THEN 'winner_below_threshold' WHEN abs(a.score - b.score) < 0.1 THEN 'ambiguous_below_margin' ELSE 'selected' END AS reason
  FROM score_rows a JOIN score_rows b ON a.id = b.id AND a.version < b.version"""
on(scores, "agg_05", f"SELECT reason, count(*) AS count FROM ({ALL_PAIRS}) GROUP BY reason", SR, lambda r: S.separated_pairs(r, 0.5, 0.1).groupBy("reason").count())
on(
    scores, "jon_06", f"SELECT id AS prompt_id, wv AS winner_version, lv AS loser_version FROM ({ALL_PAIRS}) WHERE reason = 'selected'", SR,
    lambda r: S.select_pairs(r, "all_separated_pairs", 0.5, 0.1).select("prompt_id", "winner_version", "loser_version"),
)
LETTERS = "len(regexp_extract_all({0}, '\\p{{L}}'))"
SUMMARY = f"""SELECT count(*) AS row_count, round(avg(score), 6) AS mean_score, round(median(score), 6) AS median_score,
  round(avg({LETTERS.format("target_text")}), 6) AS mean_target_length, round(median({LETTERS.format("target_text")}), 6) AS median_target_length FROM scored_texts"""


def _length_summary(r: DataFrame) -> DataFrame:
    rows = r.select("score", T.letters(c("target_text")).alias("n"))
    got = rows.agg(F.count("*").alias("row_count"), R.mean(c("score")).alias("mean_score"), R.mean(c("n")).alias("mean_target_length"))
    middles = medians(rows.select(c("score").alias("median_score"), c("n").alias("median_target_length")), [], ["median_score", "median_target_length"])
    return R.with_medians(got, middles, [])


on(scored_texts, "agg_06", SUMMARY, ST, _length_summary)


def _pair_summary(r: DataFrame) -> DataFrame:
    p = S.select_pairs(r, "best_vs_worst")
    got = p.agg(F.count("*").alias("pair_count"), R.mean(c("winner_score")).alias("winner_mean"), R.mean(c("margin")).alias("gap_mean"))
    return R.with_medians(got, medians(p.select(c("loser_score").alias("loser_median")), [], ["loser_median"]), [])


on(
    scores, "agg_07", "SELECT count(*) AS pair_count, round(avg(winner_score), 6) AS winner_mean, round(median(loser_score), 6) AS loser_median, round(avg(margin), 6) AS gap_mean FROM pairs", "pairs",
    _pair_summary,
)
DIST = "SELECT coalesce({0}, 'unknown') AS value, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM {1} GROUP BY 1"
on(prompts, "agg_08", DIST.format("style", "prompts"), PR, lambda p: R.distribution(p, "style"))
CER = f"""(CASE WHEN coalesce(detected_text, '') = '' THEN 1.0 ELSE levenshtein({LOW.format("detected_text")}, {LOW.format("target_text")}) / length({LOW.format("target_text")}) END)"""
SAME = f"({LOW.format('coalesce(detected_text, chr(32))')} = {LOW.format('target_text')})"
BENCH = f"""count(*) AS n, round(avg(CASE WHEN trim(coalesce(detected_text, '')) <> '' THEN 1.0 ELSE 0.0 END), 6) AS detection_rate,
  round(avg(CASE WHEN {SAME} THEN 1.0 ELSE 0.0 END), 6) AS strict_exact_rate, round(avg({CER}), 6) AS strict_cer_mean, round(median({CER}), 6) AS strict_cer_median,
  round(avg(score_vlm), 6) AS score_vlm_mean, round(avg(score_ocr), 6) AS score_ocr_mean, round(avg(score), 6) AS recorded_product_score_mean"""
KEPT = ["n", "detection_rate", "strict_exact_rate", "strict_cer_mean", "strict_cer_median", "score_vlm_mean", "score_ocr_mean", "recorded_product_score_mean"]
on(scored_texts, "agg_09", f"SELECT {BENCH} FROM scored_texts", ST, lambda r: R.augment(r).agg(*R.summary_columns()).select(*KEPT))
on(
    scored_texts, "agg_10", f"SELECT run, CASE WHEN grouping(slice) = 1 THEN 'all' ELSE slice END AS slice, {BENCH} FROM scored_texts GROUP BY GROUPING SETS ((run), (run, slice))", ST,
    lambda r: R.benchmark_report(R.augment(r)).select("run", "slice", *KEPT),
)
on(
    scored_texts, "agg_11",
    f"""SELECT count(*) AS rows_all, count(*) FILTER (score >= 0.5) AS rows_selected, count(DISTINCT id) AS prompts_all, count(DISTINCT id) FILTER (score >= 0.5) AS prompts_selected,
    round(median({LETTERS.format("target_text")}), 6) AS target_length_all, round(median({LETTERS.format("target_text")}) FILTER (score >= 0.5), 6) AS target_length_selected,
    round(avg(score), 6) AS score_all, round(avg(score) FILTER (score >= 0.5), 6) AS score_selected FROM scored_texts""",
    ST, lambda r: R.bias_report(R.augment(r), 0.5).select("rows_all", "rows_selected", "prompts_all", "prompts_selected", "target_length_all", "target_length_selected", "score_all", "score_selected"),
)
on(
    scores, "agg_12",
    f"""SELECT coalesce(a.value, b.value) AS value, round(coalesce(b.fraction, 0) - coalesce(a.fraction, 0), 6) AS delta FROM ({DIST.format("run", "score_rows")}) a
    FULL JOIN ({DIST.format("run", "(SELECT * FROM score_rows WHERE score >= 0.5)")}) b ON a.value = b.value""",
    SR, lambda r: R.distribution_delta(R.distribution(r, "run"), R.distribution(S.threshold(r, 0.5), "run")),
)


@add("agg_13", "SELECT pair_id, coalesce(content_type, 'unknown') AS content_type, coalesce(style, 'unknown') AS style FROM pairs LEFT JOIN prompts ON prompts.id = prompt_id", "pairs prompts")
def agg_13(spark, d):
    p = prompts(spark, d).select(c("id").alias("prompt_id"), "content_type", "style")
    found = S.select_pairs(scores(spark, d), "best_vs_worst").join(p, "prompt_id", "left")
    return found.select("pair_id", *[F.coalesce(x, F.lit("unknown")).alias(x) for x in ("content_type", "style")])


on(
    scores, "agg_14", "SELECT CAST(m AS DOUBLE) AS margin, (SELECT count(*) FROM best WHERE n >= 2 AND b.s >= 0.5 AND b.s - w.s >= m) AS pairs FROM (VALUES (0.0), (0.05), (0.1), (0.2), (0.4)) v(m)",
    "best", lambda r: S.margin_ablation(r, [0.0, 0.05, 0.1, 0.2, 0.4], 0.5),
)


@add(
    "agg_15",
    """SELECT seed, id, CASE WHEN n IS NULL THEN 'missing' WHEN w IS NULL THEN 'unknown' WHEN n > 1 THEN 'duplicate' END AS violation FROM
    (SELECT seed, id, w FROM (SELECT DISTINCT l_linenumber AS seed FROM lineitem), (SELECT p_partkey AS id, 1 AS w FROM part WHERE p_size < 50)) g
    FULL JOIN (SELECT l_linenumber AS seed, l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1, 2) h USING (seed, id) WHERE n IS NULL OR w IS NULL OR n > 1""",
)
def agg_15(spark, d):
    rows = A.table(spark, d, "lineitem").select(c("l_linenumber").alias("seed"), c("l_partkey").alias("id"), F.lit("t").alias("target_text"))
    wanted = A.table(spark, d, "part").where("p_size < 50").select(c("p_partkey").alias("id"), F.lit("t").alias("target_text"))
    return R.coverage(rows, wanted).select("seed", "id", "violation")


def _by_type(m: DataFrame) -> DataFrame:
    got = m.groupBy("event_type").agg(R.mean(c("reward")).alias("mean"), F.round(F.try_divide(F.sum("reward"), F.count_if(c("reward") > 50)), 6).alias("ratio"))
    return R.with_medians(got, medians(m.select("event_type", c("reward").alias("median")), ["event_type"], ["median"]), ["event_type"])


on(
    metrics, "agg_16", "SELECT event_type, round(avg(reward), 6) AS mean, round(median(reward), 6) AS median, round(sum(reward) / nullif(count(*) FILTER (reward > 50), 0), 6) AS ratio FROM metrics GROUP BY 1",
    ME, _by_type,
)
FOUR = "count({0}) AS count, round(min({0}), 6) AS min, round(max({0}), 6) AS max, round(avg({0}), 6) AS mean"


def _four(x: str, suffix: str = "") -> list:
    return [F.count(x).alias("count" + suffix), *[F.round(f(x), 6).alias(n + suffix) for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]]


on(metrics, "agg_17", f"SELECT {FOUR.format('reward')} FROM metrics", ME, lambda m: m.agg(*_four("reward")))
on(
    scores, "agg_18", "SELECT count(margin) AS count_m, round(min(margin), 6) AS min_m, round(max(margin), 6) AS max_m, round(avg(margin), 6) AS mean_m, count(winner_score) AS count_w, round(min(winner_score), 6) AS min_w, round(max(winner_score), 6) AS max_w, round(avg(winner_score), 6) AS mean_w FROM pairs",
    "pairs", lambda r: S.select_pairs(r, "best_vs_worst").agg(*_four("margin", "_m"), *[x.alias(n) for x, n in zip(_four("winner_score"), ("count_w", "min_w", "max_w", "mean_w"), strict=True)]),
)
on(
    prompts, "agg_19", "SELECT sum(n)::BIGINT AS total, sum(n - 1)::BIGINT AS repeats, round(sum(n - 1) / sum(n), 6) AS duplicate_rate FROM (SELECT count(*) AS n FROM prompts GROUP BY target_text, content_type)", PR,
    lambda p: Q.duplicate_rate(p, F.struct("target_text", "content_type")),
)
on(
    pairs, "agg_20", "SELECT CASE WHEN length(target_text) <= 4 THEN '1-4' WHEN length(target_text) <= 12 THEN '5-12' WHEN length(target_text) <= 24 THEN '13-24' ELSE '25+' END AS bucket, count(*) AS count FROM text_pairs GROUP BY 1", TP,
    lambda p: p.groupBy(Q.length_bucket(F.length("target_text")).alias("bucket")).count(),
)
on(
    prompts, "agg_21", "SELECT count(*) FILTER (regexp_matches(target_text, '[а-яёА-ЯЁ]')) AS cyrillic, count(*) FILTER (regexp_matches(target_text, '[A-Za-z]')) AS latin, count(*) FILTER (regexp_matches(target_text, '\\p{Nd}')) AS digits FROM prompts", PR,
    lambda p: p.agg(*[F.count_if(x).alias(n) for n, x in Q.scripts(c("target_text")).items() if n != "punctuation"]),
)
CHARS = "SELECT ch AS char, count(*) AS count FROM (SELECT unnest(string_split(regexp_replace(lower(target_text), '[\\s|]', '', 'g'), '')) AS ch FROM prompts) WHERE ch <> '' GROUP BY 1"
on(
    prompts, "agg_22", f"SELECT k AS position, v.ch AS char, coalesce(count, 0) AS count FROM (VALUES (0, 'q'), (1, 'ñ'), (2, 'ж'), (3, 'z')) v(k, ch) LEFT JOIN ({CHARS}) x ON x.char = v.ch", PR,
    lambda p: Q.required_coverage(Q.character_counts(p, c("target_text")), "qñЖzq"),
)
on(
    prompts, "agg_23", "SELECT key, value, count(*) AS count FROM (SELECT 'lang' AS key, content_type AS value FROM prompts UNION ALL SELECT 'source', style FROM prompts) GROUP BY 1, 2", PR,
    lambda p: p.select(F.explode(F.create_map(F.lit("lang"), c("content_type"), F.lit("source"), c("style"))).alias("key", "value")).groupBy("key", "value").count(),
)
on(
    prompts, "agg_24", "SELECT round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM prompts GROUP BY style)", PR,
    lambda p: Q.entropy(p.groupBy("style").count()),
)
on(
    prompts, "agg_25",
    f"""SELECT v.value, coalesce(fraction, 0.0) AS fraction, NOT (coalesce(fraction, 0.0) BETWEEN low AND high) AS out_of_range FROM (VALUES ('en', 0.5, 0.8), ('de', 0.5, 0.9), ('xx', 0.0, 0.1)) v(value, low, high)
    LEFT JOIN ({DIST.format("content_type", "prompts")}) x ON x.value = v.value""",
    PR, lambda p: Q.range_check(R.distribution(p, "content_type"), {"en": (0.5, 0.8), "de": (0.5, 0.9), "xx": (0.0, 0.1)}),
)
on(
    prompts, "agg_26",
    "SELECT content_type, count(*) AS records, count(DISTINCT target_text) AS unique_targets, round(avg(length(target_text)), 6) AS mean_length, count(*) FILTER (regexp_matches(target_text, '[0-9]')) AS with_digits FROM prompts GROUP BY 1",
    PR, lambda p: p.groupBy("content_type").agg(F.count("*").alias("records"), F.count_distinct("target_text").alias("unique_targets"), R.mean(F.length("target_text")).alias("mean_length"), F.count_if(Q.scripts(c("target_text"))["digits"]).alias("with_digits")),
)
on(
    lambda s, d: A.table(s, d, "part"), "agg_27",
    "SELECT p_brand, count(*) AS samples, count(*) FILTER (p_size >= 5 AND p_size <= 45 AND p_retailprice >= 950) AS accepted, min(p_retailprice) AS contrast_min, max(p_size) AS height_max FROM part GROUP BY 1",
    "", lambda p: p.groupBy("p_brand").agg(F.count("*").alias("samples"), F.count_if(c("p_size").between(5, 45) & (c("p_retailprice") >= 950)).alias("accepted"), F.min("p_retailprice").alias("contrast_min"), F.max("p_size").alias("height_max")),
)
on(prompts, "agg_28", CHARS, PR, lambda p: Q.character_counts(p, c("target_text")))
on(
    pairs, "agg_29", f"SELECT count(*) AS n, round(avg(CASE WHEN {SAME} THEN 1.0 ELSE 0.0 END), 6) AS exact_rate, round(avg({CER}), 6) AS mean_cer FROM text_pairs", TP,
    lambda p: p.agg(F.count("*").alias("n"), R.share(T.normal_match(c("detected_text")) == T.normal_match(c("target_text"))).alias("exact_rate"), R.mean(T.plain_error_rate(c("detected_text"), c("target_text"))).alias("mean_cer")),
)
PART = "(SELECT id, version, CASE WHEN version % 3 = 0 THEN NULL ELSE score_vlm END AS score_vlm, CASE WHEN version % 2 = 0 THEN NULL ELSE score_ocr END AS score_ocr, CASE WHEN id % 7 = 0 THEN NULL ELSE score END AS cer, score_ocr * 2 AS entropy, id % 2 = 0 AS exact_text_match FROM score_rows)"


def _evidence(r: DataFrame) -> DataFrame:
    return r.select(
        "id", "version", F.when(c("version") % 3 != 0, c("score_vlm")).alias("score_vlm"), F.when(c("version") % 2 != 0, c("score_ocr")).alias("score_ocr"),
        F.when(c("id") % 7 != 0, c("score")).alias("cer"), (c("score_ocr") * 2).alias("entropy"), (c("id") % 2 == 0).alias("exact_text_match"),
    )


on(
    scores, "agg_30", f"SELECT name, count(*) AS count FROM (SELECT unnest([CASE WHEN score_vlm IS NULL THEN 'score_vlm' END, CASE WHEN score_ocr IS NULL THEN 'score_ocr' END, CASE WHEN cer IS NULL THEN 'cer' END]) AS name FROM {PART}) WHERE name IS NOT NULL GROUP BY 1",
    SR, lambda r: _evidence(r).select(F.explode(M.Formula().missing()).alias("name")).groupBy("name").count(),
)
on(scores, "agg_31", "SELECT run, count(*) AS n, round(corr(score_vlm, score_ocr), 5) AS pearson FROM score_rows GROUP BY run", SR, lambda r: r.groupBy("run").agg(F.count("*").alias("n"), F.round(R.pearson(c("score_vlm"), c("score_ocr")), 5).alias("pearson")))
CONF = """SELECT e AS expected, o AS observed, count(DISTINCT sample_id) AS count FROM (SELECT sample_id, coalesce(nullif(substr(target_text, k, 1), ''), '∅') AS e, coalesce(nullif(substr(detected_text, k, 1), ''), '∅') AS o
  FROM (SELECT *, unnest(range(1, CAST(greatest(length(target_text), length(detected_text)) AS BIGINT) + 1)) AS k FROM text_pairs)) WHERE e <> o GROUP BY 1, 2"""
on(pairs, "agg_32", CONF, TP, R.confusions)
on(pairs, "jon_14", f"SELECT sum(count)::BIGINT AS total, count(*) AS kinds FROM ({CONF})", TP, lambda p: R.confusions(p).agg(F.sum("count").alias("total"), F.count("*").alias("kinds")))
on(pairs, "ord_04", f"SELECT * FROM ({CONF}) ORDER BY count DESC, expected, observed LIMIT 10", TP, lambda p: R.confusions(p).orderBy(F.desc("count"), "expected", "observed").limit(10))
STRIP = "regexp_replace({0}, '[!-/:-@\\[-`{{-~—–…«»№]', '', 'g')"
SLICES = f"""SELECT id, t, list_filter([CASE WHEN regexp_matches(t, '[0-9²³¹]') THEN 'has_digits' END, CASE WHEN regexp_matches(t, '[!-/:-@\\[-`{{-~—–…«»№]') THEN 'has_punctuation' END,
  CASE WHEN len(ws) >= 2 THEN 'multi_word_phrase' WHEN len(ws) = 1 THEN 'short_word' END, CASE WHEN len(list_filter(ws, lambda w: length({STRIP.format("w")}) >= 10)) > 0 THEN 'long_word' END], lambda x: x IS NOT NULL) AS labels
  FROM (SELECT id, t, list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '') AS ws FROM (SELECT id, trim(target_text) AS t FROM prompts)) WHERE t <> ''"""
SHOWN = ["has_digits", "has_punctuation", "multi_word_phrase", "short_word", "long_word"]


def _sliced(p: DataFrame) -> DataFrame:
    labels = F.filter(T.slice_labels(c("target_text")), lambda x: x.isin(*SHOWN))
    return p.where(F.trim("target_text") != "").withColumn("labels", labels)


on(
    prompts, "agg_33", f"SELECT label, count(*) AS records, count(*) FILTER (id % 2 = 0) AS even FROM (SELECT id, unnest(CASE WHEN len(labels) = 0 THEN ['unsliced'] ELSE labels END) AS label FROM ({SLICES})) GROUP BY 1", PR,
    lambda p: R.labelled(_sliced(p), c("labels")).groupBy("label").agg(F.count("*").alias("records"), F.count_if(c("id") % 2 == 0).alias("even")),
)
on(prompts, "agg_35", f"SELECT label, count(*) AS count FROM (SELECT unnest(labels) AS label FROM ({SLICES})) GROUP BY 1", PR, lambda p: _sliced(p).select(F.explode("labels").alias("label")).groupBy("label").count())
on(prompts, "scl_17", f"SELECT id, array_to_string(labels, ',') AS labels FROM ({SLICES})", PR, lambda p: _sliced(p).select("id", F.array_join("labels", ",").alias("labels")))


@add(
    "agg_34",
    """SELECT count(*) AS total, count(*) FILTER (p.id IS NULL) AS missing, count(*) FILTER (p.m = g.expected_exact_match) AS exact_agree, count(*) FILTER (p.m <> g.expected_exact_match) AS exact_disagree
    FROM gold g LEFT JOIN (SELECT id, n_chars % 2 = 0 AS m FROM prompts WHERE id % 3 > 0) p ON p.id = g.sample_id""",
    "gold prompts",
)
def agg_34(spark, d):
    g = A.gold(spark, d).withColumns({"expected_ocr_detected": F.lit(True), "target_text": F.lit("x")})
    p = prompts(spark, d).where("id % 3 > 0").select(
        c("id").alias("sample_id"), (c("n_chars") % 2 == 0).alias("exact_text_match"), F.lit(True).alias("ocr_detected"), F.lit("x").alias("detected_text"), F.lit(0).alias("position")
    )
    return R.gold_report(g, p).select("total", "missing", "exact_agree", "exact_disagree")


OVER = "SELECT coalesce(a.t, b.t) AS word, CASE WHEN b.t IS NULL THEN 'left' WHEN a.t IS NULL THEN 'right' ELSE 'both' END AS side FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS t FROM part) a FULL JOIN (SELECT DISTINCT unnest(string_split(p_type, ' ')) AS t FROM part) b ON a.t = b.t"


def _overlap(spark, d):
    part = A.table(spark, d, "part")
    words = [part.select(F.explode(F.split(x, " ")).alias("word")) for x in ("p_name", "p_type")]
    return K.overlap(*words, "word")


add("set_03", OVER)(_overlap)
add("agg_36", f"SELECT side, count(*) AS count FROM ({OVER}) GROUP BY side")(lambda s, d: _overlap(s, d).groupBy("side").count())
on(
    metrics, "agg_37",
    "SELECT user_id, count(*) AS steps, arg_min(reward, step) AS first, arg_max(reward, step) AS last, max(reward) AS best, round(avg(reward), 6) AS mean, round(arg_max(reward, step) - arg_min(reward, step), 6) AS delta FROM metrics GROUP BY 1",
    ME, lambda m: E.summary(m, "reward", "step", ["user_id"]),
)
on(
    metrics, "agg_38",
    """SELECT user_id, count(*) AS steps, round(avg(reward) FILTER (step <= 10), 6) AS first_mean, round(avg(reward) FILTER (step > n - 10), 6) AS last_mean
    FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM metrics) WHERE n >= 10 GROUP BY 1""",
    ME, lambda m: E.ends(m, "reward", "step", ["user_id"]),
)
on(
    scores, "agg_39",
    """SELECT bucket, count(*) AS count, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM (SELECT score, CASE WHEN score < 0 THEN NULL WHEN score < 0.1 THEN '[0,0.1)' WHEN score < 0.3 THEN '[0.1,0.3)'
    WHEN score < 0.5 THEN '[0.3,0.5)' WHEN score < 0.7 THEN '[0.5,0.7)' WHEN score < 0.9 THEN '[0.7,0.9)' WHEN score < 1.01 THEN '[0.9,1.01)' END AS bucket FROM score_rows) GROUP BY 1""",
    SR, lambda r: r.groupBy(R.histogram(c("score")).alias("bucket")).agg(F.count("*").alias("count"), R.mean(c("score")).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("std")),
)
on(
    scores, "agg_40",
    """SELECT count(*) AS n, round(avg(a - b), 6) AS mean_diff, round(stddev_pop(a - b), 6) AS std_diff, round(max(abs(a - b)), 6) AS max_abs_diff, round(corr(a, b), 5) AS pearson, round(corr(ra, rb), 5) AS spearman,
    round(avg(CASE WHEN (a >= 0.5) = (b >= 0.5) THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM (SELECT score_vlm AS a, score_ocr AS b,
    rank() OVER (ORDER BY score_vlm) + (count(*) OVER (PARTITION BY score_vlm) - 1) / 2 AS ra, rank() OVER (ORDER BY score_ocr) + (count(*) OVER (PARTITION BY score_ocr) - 1) / 2 AS rb FROM score_rows)""",
    SR, lambda r: R.compare_scorers(r, "score_vlm", "score_ocr").withColumns({x: F.round(x, 5) for x in ("pearson", "spearman")}),
)
def _by_run(r: DataFrame) -> DataFrame:
    got = r.groupBy("run").agg(F.count("*").alias("n"), R.mean(c("score")).alias("mean"), F.min("score").alias("min"), F.max("score").alias("max"))
    return R.with_medians(got, medians(r.select("run", c("score").alias("median")), ["run"], ["median"]), ["run"])


on(scores, "agg_41", "SELECT run, count(*) AS n, round(avg(score), 6) AS mean, round(median(score), 6) AS median, min(score) AS min, max(score) AS max FROM score_rows GROUP BY run", SR, _by_run)
on(
    prompts, "agg_42", "SELECT content_type, count(*) AS n, min(l) AS min, max(l) AS max, round(avg(l), 6) AS mean, list_sort(list(l))[CAST(count(*) // 2 AS INT) + 1] AS upper_median FROM (SELECT content_type, length(target_text) AS l FROM prompts) GROUP BY 1", PR,
    lambda p: _upper_median(p),
)


def _upper_median(p: DataFrame) -> DataFrame:
    """Counts of each length first, so no group's values are gathered."""
    n = p.groupBy("content_type", F.length("target_text").alias("l")).agg(F.count("*").alias("k"))
    line = Window.partitionBy("content_type").orderBy("l")
    n = n.withColumn("reach", F.sum("k").over(line)).withColumn("total", F.sum("k").over(Window.partitionBy("content_type")))
    upper = F.min(F.when(c("reach") > F.floor(c("total") / 2), c("l")))
    return n.groupBy("content_type").agg(F.sum("k").alias("n"), F.min("l").alias("min"), F.max("l").alias("max"), F.round(F.sum(c("l") * c("k")) / F.sum("k"), 6).alias("mean"), upper.alias("upper_median"))


WORDS = "(SELECT unnest(string_split(p_name, ' ')) AS word FROM part)"
RARE = f"SELECT ch AS char, count(*) AS words FROM (SELECT unnest(list_distinct(string_split(lower(word), ''))) AS ch FROM {WORDS}) WHERE ch <> '' GROUP BY 1"


def _words(spark, d):
    return A.table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word"))


add("agg_43", f"SELECT char, words, round(max(words) OVER () / words, 6) AS rarity FROM ({RARE})")(lambda s, d: P.rarity(_words(s, d)))
on(
    pairs, "agg_44", "SELECT sample_id, ch, count(*) AS n FROM (SELECT sample_id, unnest(string_split(target_text, '')) AS ch FROM text_pairs) GROUP BY 1, 2", TP,
    lambda p: p.select("sample_id", F.explode(T.count_map(c("target_text"))).alias("ch", "n")).withColumn("n", c("n").cast("long")),
)
on(
    scores, "agg_45", "SELECT n * 8 AS expected, got AS processed, n * 8 - got AS missing FROM (SELECT count(DISTINCT id) AS n, count(*) AS got FROM score_rows)", SR,
    lambda r: r.agg(F.count_distinct("id").alias("n"), F.count("*").alias("processed")).select((c("n") * 8).alias("expected"), "processed", (c("n") * 8 - c("processed")).alias("missing")),
)

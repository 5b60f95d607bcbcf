"""More registered queries: joins, sets, text, formulas, coercion, scans, sinks, checks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import (
    CER, DIAG, LOW, ME, PART, PR, SR, ST, TP, UP, A, C, K, M, P, Q, R, S, T, _diagnostic, _evidence, _words, add, c, metrics, on, pairs, prompts, readers, scored, scored_texts, scores, sinks, streaming, work_folder,
)


def md5(x):
    return F.md5(x)


# ---------------------------------------------------------------- joins
@add("jon_01", "SELECT s.id, version, coalesce(content_type, 'unknown') AS content_type, coalesce(length(target_text), 0) AS n FROM score_rows s LEFT JOIN prompts p ON p.id = s.id", "score_rows prompts")
def jon_01(spark, d):
    p = prompts(spark, d).select("id", "content_type", "target_text")
    out = scores(spark, d).join(p, "id", "left")
    return out.select("id", "version", F.coalesce("content_type", F.lit("unknown")).alias("content_type"), F.coalesce(F.length("target_text"), F.lit(0)).alias("n"))


@add("jon_02", "SELECT sample_id, p.id IS NULL AS missing FROM gold LEFT JOIN (SELECT id FROM prompts WHERE id % 3 > 0) p ON p.id = sample_id", "gold prompts")
def jon_02(spark, d):
    p = prompts(spark, d).where("id % 3 > 0").select(c("id").alias("sample_id"), F.lit(1).alias("there"))
    return A.gold(spark, d).join(p, "sample_id", "left").select("sample_id", c("there").isNull().alias("missing"))


@add("jon_03", f"SELECT sample_id, score, coalesce(human_label, 'none') AS label FROM {DIAG} LEFT JOIN gold USING (sample_id)", "prompts gold")
def jon_03(spark, d):
    return _diagnostic(spark, d).join(A.gold(spark, d), "sample_id", "left").select("sample_id", "score", F.coalesce("human_label", F.lit("none")).alias("label"))


@add("jon_04", "SELECT id AS prompt_id, version, CASE WHEN id % 11 = 0 THEN 'missing' WHEN id % 7 = 0 THEN 'changed' END AS violation FROM score_rows WHERE score >= 0.3 AND (id % 11 = 0 OR id % 7 = 0)", SR)
def jon_04(spark, d):
    r = scores(spark, d)
    samples = S.sample_rows(S.threshold(r, 0.3), "threshold", 0.3)
    source = r.where("id % 11 <> 0").withColumn("score", F.when(c("id") % 7 == 0, c("score") + 0.5).otherwise(c("score")))
    return S.violations_of_samples(samples, source, 0.3).select("prompt_id", "version", "violation")


@add("jon_05", "SELECT pair_id, 'changed' AS violation FROM pairs WHERE prompt_id % 7 = 0", "pairs")
def jon_05(spark, d):
    r = scores(spark, d)
    source = r.withColumn("score", F.when(c("id") % 7 == 0, c("score") + 0.5).otherwise(c("score")))
    return S.violations_of_pairs(S.select_pairs(r, "best_vs_worst"), source, 0.5, 0.1).select("pair_id", "violation")


@add(
    "jon_07",
    "SELECT p_partkey, coalesce(l.n, 0) AS n, coalesce(s.k, 0) AS k FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_partkey = p_partkey LEFT JOIN (SELECT s_suppkey, count(*) AS k FROM supplier GROUP BY 1) s ON s_suppkey = p_partkey",
)
def jon_07(spark, d):
    li = A.table(spark, d, "lineitem").groupBy(c("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    su = A.table(spark, d, "supplier").groupBy(c("s_suppkey").alias("p_partkey")).agg(F.count("*").alias("k"))
    out = A.table(spark, d, "part").select("p_partkey").join(li, "p_partkey", "left").join(su, "p_partkey", "left")
    return out.select("p_partkey", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n", "k")])


@add("jon_08", "SELECT s.id, count(*) AS rows FROM score_rows s LEFT JOIN prompts p ON p.id = s.id WHERE p.id IS NULL GROUP BY 1", "score_rows prompts")
def jon_08(spark, d):
    return scores(spark, d).join(prompts(spark, d).select("id"), "id", "left_anti").groupBy("id").agg(F.count("*").alias("rows"))


@add("jon_09", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT o_orderkey AS k FROM orders) a FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def jon_09(spark, d):
    a = A.table(spark, d, "orders").select(c("o_orderkey").alias("k"))
    return K.overlap(a, A.table(spark, d, "lineitem").select(c("l_orderkey").alias("k")), "k").where("side <> 'both'")


REST = "SELECT id, version FROM score_rows WHERE NOT (id % 3 = 0)"
on(scores, "jon_10", REST, SR, lambda r: K.remaining(r.select("id", "version"), r.where("id % 3 = 0"), "id", "version"))


@add("jon_11", f"SELECT id FROM prompts WHERE {UP.format('target_text')} NOT IN (SELECT {UP.format('text')} FROM benchmark WHERE text IS NOT NULL)", PR)
def jon_11(spark, d):
    excluded = readers.excluded_targets(A.table(spark, d, "benchmark"), "text")
    return prompts(spark, d).withColumn("key", T.normal_target(c("target_text"))).join(excluded, "key", "left_anti").select("id")


DIFF = """SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 10 > 0) a
  FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_partkey % 9 > 0) b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v"""


def _diff(spark, d):
    p = A.table(spark, d, "part").select(c("p_partkey").alias("k"), c("p_size").alias("v"))
    other = p.where("k % 9 > 0").withColumn("v", F.when(c("k") % 7 == 0, c("v") + 1).otherwise(c("v")))
    return K.diff(p.where("k % 10 > 0"), other, "k", "v").select("k", "change")


add("jon_12", f"SELECT change, count(*) AS count FROM ({DIFF}) GROUP BY 1")(lambda s, d: _diff(s, d).groupBy("change").count())
add("jon_13", DIFF)(_diff)

# ---------------------------------------------------------------- sets


@add("set_01", "SELECT 'duplicate_key' AS problem, l_orderkey || '/' || l_linenumber AS what FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 UNION ALL SELECT 'missing_shard', '4'")
def set_01(spark, d):
    rows = A.table(spark, d, "lineitem").select(c("l_orderkey").alias("id"), c("l_linenumber").alias("version"), (c("l_linenumber") % 4).alias("shard_idx"))
    return K.merge_shards(rows, 5, rows.count())


@add("set_02", "SELECT CAST(version AS INTEGER) AS seed, id, version FROM score_rows WHERE version < 3", SR)
def set_02(spark, d):
    r = scores(spark, d).select("id", "version")
    return K.seed_union({k: r.where(c("version") == k) for k in range(3)})


@add("set_04", "SELECT id, v AS version FROM (SELECT DISTINCT id FROM score_rows), (SELECT unnest(range(8)) AS v) EXCEPT SELECT id, version FROM score_rows", SR)
def set_04(spark, d):
    r = scores(spark, d).select("id", c("version").cast("long").alias("version"))
    grid = r.select("id").distinct().select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("version"))
    return grid.exceptAll(r)


@add("set_05", f"SELECT count(*) AS overlap FROM (SELECT sha256({UP.format('target_text')}) FROM prompts INTERSECT SELECT sha256({UP.format('text')}) FROM benchmark)", PR)
def set_05(spark, d):
    return readers.hash_index(prompts(spark, d)).intersect(readers.hash_index(A.table(spark, d, "benchmark"), "text")).agg(F.count("*").alias("overlap"))


@add("set_06", f"SELECT sha256({UP.format('target_text')}) AS sha256, 'left' AS side FROM prompts WHERE content_type <> 'en' GROUP BY 1 HAVING sha256({UP.format('min(target_text)')}) NOT IN (SELECT sha256({UP.format('target_text')}) FROM prompts WHERE content_type = 'en')", PR)
def set_06(spark, d):
    p = prompts(spark, d)
    a, b = readers.hash_index(p.where("content_type <> 'en'")), readers.hash_index(p.where("content_type = 'en'"))
    return K.key_drift(a, b, "sha256").where("side = 'left'")


on(scores, "set_07", "SELECT run, string_agg(DISTINCT CAST(version AS VARCHAR), ',' ORDER BY CAST(version AS VARCHAR)) AS versions FROM score_rows GROUP BY 1", SR, lambda r: r.groupBy("run").agg(F.array_join(F.array_sort(F.collect_set(c("version").cast("string"))), ",").alias("versions")))
RANGES = "(SELECT s_suppkey AS name, s_suppkey * 10 AS b, s_suppkey * 10 + CASE WHEN s_suppkey % 5 = 0 THEN 25 ELSE 10 END AS e FROM supplier)"


@add("set_08", f"SELECT name FROM (SELECT name, b, max(e) OVER (ORDER BY b, e, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {RANGES}) WHERE b < r")
def set_08(spark, d):
    s = A.table(spark, d, "supplier").select(c("s_suppkey").alias("name"), (c("s_suppkey") * 10).alias("begin"), (c("s_suppkey") * 10 + F.when(c("s_suppkey") % 5 == 0, 25).otherwise(10)).alias("end"))
    return K.overlapping_ranges(s).select("name")


@add("set_09", "SELECT DISTINCT p_type AS path FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_size < 3)")
def set_09(spark, d):
    p = A.table(spark, d, "part")
    return K.remaining(p.select(c("p_type").alias("path")).distinct(), p.where("p_size < 3").select(c("p_type").alias("path")), "path")


on(
    pairs, "set_10", "SELECT sample_id, array_to_string(list_transform(list_distinct_keep, lambda x: x.c), '') AS chars FROM (SELECT sample_id, list_sort(list(struct_pack(k := k, c := ch))) AS list_distinct_keep FROM (SELECT sample_id, ch, min(k) AS k FROM (SELECT sample_id, unnest(string_split(target_text, '')) AS ch, unnest(range(1, CAST(length(target_text) AS BIGINT) + 1)) AS k FROM text_pairs) GROUP BY 1, 2) GROUP BY 1)",
    TP, lambda p: p.select("sample_id", F.array_join(F.array_distinct(T.chars(c("target_text"))), "").alias("chars")),
)

# ---------------------------------------------------------------- text functions
on(prompts, "scl_01", f"SELECT id, md5({LOW.format('target_text')}) AS h FROM prompts", PR, lambda p: p.select("id", md5(T.normal_match(c("target_text"))).alias("h")))
GLYPH = "translate({0}, 'ABCEHKMOPTXaceopx', 'АВСЕНКМОРТХасеорх')"
on(prompts, "scl_02", f"SELECT id, md5({LOW.format(GLYPH.format('target_text'))}) AS h FROM prompts", PR, lambda p: p.select("id", md5(T.normal_match(c("target_text"), True)).alias("h")))
on(prompts, "scl_03", f"SELECT id, md5({GLYPH.format('target_text')}) AS h FROM prompts", PR, lambda p: p.select("id", md5(T.homoglyphs(c("target_text"))).alias("h")))
on(pairs, "scl_04", "SELECT sample_id, levenshtein(target_text, detected_text) AS distance FROM text_pairs", TP, lambda p: p.select("sample_id", F.levenshtein("target_text", "detected_text").cast("long").alias("distance")))
on(pairs, "scl_05", f"SELECT sample_id, round({CER}, 6) AS cer FROM text_pairs", TP, lambda p: p.select("sample_id", F.round(T.error_rate(c("detected_text"), c("target_text")), 6).alias("cer")))


def _piece_distance(p):
    return p.select("sample_id", F.round(T.pieces_error_rate(F.split("detected_text", " "), F.split("target_text", " ")), 6).alias("cer"))


PIECES = "lower(replace({0}, ' ', ''))"  # names have no capitals, so look-alikes turn into each other on both sides
on(
    pairs, "scl_06", f"SELECT sample_id, round(least(1.0, levenshtein({PIECES.format('detected_text')}, {PIECES.format('target_text')}) / greatest(length({PIECES.format('target_text')}), 1)), 6) AS cer FROM text_pairs", TP,
    _piece_distance,
)
on(pairs, "scl_07", f"SELECT sample_id, round({CER}, 6) AS cer FROM text_pairs", TP, lambda p: p.select("sample_id", F.round(T.plain_error_rate(c("detected_text"), c("target_text")), 6).alias("cer")))
METRICS = """SELECT sample_id, m AS char_matches, t AS char_total, round(CASE WHEN t = 0 THEN 1.0 ELSE m / t END, 6) AS char_accuracy, CASE WHEN b = '' THEN 'not_detected' WHEN a = b THEN 'detected_exact' ELSE 'detected_mismatch' END AS detection_status
  FROM (SELECT sample_id, a, b, greatest(length(a), length(b)) AS t, len(list_filter(range(1, CAST(least(length(a), length(b)) AS BIGINT) + 1), lambda k: substr(a, k, 1) = substr(b, k, 1))) AS m
  FROM (SELECT sample_id, lower(target_text) AS a, lower(detected_text) AS b FROM text_pairs))"""


def _metrics(p):
    m = T.character_metrics(c("detected_text"), c("target_text"))
    return p.select("sample_id", m["char_matches"].cast("long").alias("char_matches"), m["char_total"].cast("long").alias("char_total"), F.round(m["char_accuracy"], 6).alias("char_accuracy"), m["detection_status"].alias("detection_status"))


on(pairs, "scl_08", METRICS, TP, _metrics)
on(
    pairs, "scl_09",
    """SELECT sample_id, round(greatest(0, sum(least(na, nb)) / max(lb) - 0.5 * greatest(0, max(la) - max(lb)) / max(lb)), 6) AS accuracy FROM (SELECT sample_id, length(a) AS la, length(b) AS lb, ch,
    length(a) - length(replace(a, ch, '')) AS na, length(b) - length(replace(b, ch, '')) AS nb FROM (SELECT sample_id, lower(detected_text) AS a, lower(target_text) AS b, unnest(list_distinct(string_split(lower(target_text), ''))) AS ch FROM text_pairs)) GROUP BY 1""",
    TP, lambda p: p.select("sample_id", F.round(T.bag_accuracy(c("detected_text"), c("target_text")), 6).alias("accuracy")),
)
on(prompts, "scl_10", f"SELECT id, md5({LOW.format(chr(40) + 'regexp_replace(target_text, ' + chr(39) + '[^\\p{L}\\p{N}\\s]' + chr(39) + ', chr(32), ' + chr(39) + 'g' + chr(39) + ')' + chr(41))}) AS h FROM prompts", PR, lambda p: p.select("id", md5(T.normal_words(c("target_text"))).alias("h")))
on(prompts, "scl_11", f"SELECT id, md5({UP.format('target_text')}) AS h FROM prompts", PR, lambda p: p.select("id", md5(T.normal_target(c("target_text"))).alias("h")))
on(prompts, "scl_12", "SELECT id, md5(trim(regexp_replace(target_text, '\\s+', ' ', 'g'))) AS h FROM prompts", PR, lambda p: p.select("id", md5(T.normal_space(c("target_text"))).alias("h")))
on(prompts, "scl_13", f"SELECT id, sha256({UP.format('target_text')}) AS h FROM prompts", PR, lambda p: p.select("id", T.target_digest(c("target_text")).alias("h")))
on(
    prompts, "scl_14", "SELECT id, l AS latin_letters, y AS cyrillic_letters, n AS letter_count, round(CASE WHEN n = 0 THEN 0.0 ELSE l / n END, 6) AS latin_letter_rate FROM (SELECT id, len(regexp_extract_all(target_text, '[A-Za-z]')) AS l, len(regexp_extract_all(target_text, '[А-яЁё]')) AS y, len(regexp_extract_all(target_text, '\\p{L}')) AS n FROM prompts)",
    PR, lambda p: p.select("id", *[(F.round(x, 6) if n == "latin_letter_rate" else x.cast("long")).alias(n) for n, x in T.script_mix(c("target_text")).items() if n != "script_mixing_flag"]),
)
on(prompts, "scl_15", "SELECT id, len(regexp_extract_all(target_text, '\\p{L}')) AS n FROM prompts", PR, lambda p: p.select("id", T.letters(c("target_text")).cast("long").alias("n")))
on(prompts, "scl_16", "SELECT id, array_to_string(list_sort(list_filter(list_distinct(string_split(upper(replace(target_text, 'ß', 'SS')), '')), lambda x: x IN ('Q', 'Z', 'Ñ', 'X'))), '') AS g FROM prompts", PR, lambda p: p.select("id", F.array_join(T.hard_glyphs(c("target_text"), "QZÑX"), "").alias("g")))
on(prompts, "scl_18", "SELECT id, regexp_matches(t, '\\p{Ll}') AND regexp_matches(' ' || t, '\\s\\S+\\p{Lu}') AS mixed FROM (SELECT id, regexp_replace(trim(target_text), '[!-/:-@\\[-`{-~—–…«»№]', '', 'g') AS t FROM prompts)", PR, lambda p: p.select("id", T.mixed_case(F.trim("target_text")).alias("mixed")))
on(prompts, "scl_19", "SELECT id, coalesce(trim(style) <> '', false) OR coalesce(trim(content_type) <> '', false) AS there FROM prompts", PR, lambda p: p.select("id", T.present(c("style"), c("content_type")).alias("there")))
on(pairs, "scl_20", "SELECT sample_id, array_to_string(list_transform(string_split(target_text, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS t, upper(target_text) AS u FROM text_pairs WHERE NOT regexp_matches(target_text, '[^A-Za-z ]')", TP, lambda p: p.where(~c("target_text").rlike("[^A-Za-z ]")).select("sample_id", T.apply_case(c("target_text"), F.lit("title")).alias("t"), T.apply_case(c("target_text"), F.lit("upper")).alias("u")))
on(pairs, "scl_21", "SELECT sample_id, array_to_string(list_transform(range(1, CAST(length(target_text) AS BIGINT) + 1), lambda k: CASE WHEN k % 2 = 1 THEN upper(substr(target_text, k, 1)) ELSE lower(substr(target_text, k, 1)) END), '') AS t FROM text_pairs", TP, lambda p: p.select("sample_id", T.alternating_case(c("target_text")).alias("t")))
on(pairs, "scl_22", "SELECT sample_id, target_text AS t FROM text_pairs", TP, lambda p: p.select("sample_id", T.transliterate(F.translate("target_text", "abdegiklmnoprstuvzABDEGIKLMNOPRSTUVZ", "абдегиклмнопрстувзАБДЕГИКЛМНОПРСТУВЗ")).alias("t")))
TO_CYRILLIC = ("abdegiklmnoprstuvz", "абдегиклмнопрстувз")
HALF = f"""SELECT sample_id, array_to_string(list_transform(range(1, CAST(length(w) AS BIGINT) + 1), lambda k: CASE WHEN len(regexp_extract_all(substr(w, 1, k - 1), '[{TO_CYRILLIC[0]}]')) % 2 = 1
  THEN translate(substr(w, k, 1), '{TO_CYRILLIC[0]}', '{TO_CYRILLIC[1]}') ELSE substr(w, k, 1) END), '') AS t FROM (SELECT sample_id, regexp_replace(lower(target_text), '[^{TO_CYRILLIC[0]} ]', '', 'g') AS w FROM text_pairs)
  WHERE len(regexp_extract_all(w, '[{TO_CYRILLIC[0]}]')) >= 2"""
on(
    pairs, "scl_23", HALF, TP,
    lambda p: p.select("sample_id", F.regexp_replace(F.lower("target_text"), f"[^{TO_CYRILLIC[0]} ]", "").alias("w")).where(F.regexp_count("w", F.lit(f"[{TO_CYRILLIC[0]}]")) >= 2)
    .select("sample_id", T.half_transliterate(F.translate("w", *TO_CYRILLIC)).alias("t")),
)
on(pairs, "scl_24", "SELECT sample_id, CASE sample_id % 3 WHEN 0 THEN target_text || ' ' || sample_id WHEN 1 THEN target_text || '!' ELSE target_text END AS t FROM text_pairs", TP, lambda p: p.select("sample_id", T.stage_text(c("target_text"), F.element_at(F.array(F.lit("digits"), F.lit("punctuation"), F.lit("plain")), (c("sample_id") % 3 + 1).cast("int")), c("sample_id").cast("string"), F.lit("!")).alias("t")))
CUT = """SELECT id, CASE WHEN length(t) <= 30 THEN t WHEN n = 0 THEN substr(t, 1, 30) ELSE array_to_string(ws[1:n], ' ') END AS t FROM (SELECT id, t, ws,
  len(list_filter(range(1, CAST(least(len(ws), 31) AS BIGINT) + 1), lambda k: length(array_to_string(ws[1:k], ' ')) <= 30)) AS n FROM (SELECT id, target_text AS t, string_split(target_text, ' ') AS ws FROM prompts WHERE NOT contains(target_text, '  ') AND target_text NOT LIKE ' %'))"""
on(prompts, "scl_25", CUT, PR, lambda p: p.where(~F.contains("target_text", F.lit("  ")) & ~F.startswith("target_text", F.lit(" "))).select("id", T.truncate_words(c("target_text")).alias("t")))
on(pairs, "scl_26", "SELECT sample_id, 'a sign with ' || target_text || ' in ' || detected_text AS t FROM text_pairs", TP, lambda p: p.select("sample_id", T.fill_template(F.lit("a sign with {text} in {scene}"), text=c("target_text"), scene=c("detected_text")).alias("t")))


def _wrapped():
    return F.element_at(F.array(*[F.concat(F.lit(a), c("target_text"), F.lit(b)) for a, b in (('<think>x\ny</think> 12. "', '"'), ("- ", " "), ("3) «", "»"), ("  '", "'\n"))]), (F.length("target_text") % 4 + 1).cast("int"))


on(pairs, "scl_27", "SELECT sample_id, target_text AS t FROM text_pairs", TP, lambda p: p.select("sample_id", T.clean_phrase(_wrapped()).alias("t")))


def _secret_text():
    return F.when(F.length("target_text") % 3 == 0, F.concat(F.lit("api_key=abc"), c("sample_id"))).when(F.length("target_text") % 3 == 1, F.concat(F.lit("Bearer x"), c("sample_id"))).otherwise(F.concat(F.lit("keyboard="), c("sample_id")))


on(
    pairs, "scl_28", "SELECT sample_id, CASE length(target_text) % 3 WHEN 0 THEN 'api_key=<redacted>' WHEN 1 THEN 'Bearer <redacted>' ELSE 'keyboard=' || sample_id END || ' n=' || sample_id AS t FROM text_pairs", TP,
    lambda p: p.select("sample_id", T.redact(F.concat(_secret_text(), F.lit(" n="), c("sample_id"))).alias("t")),
)
on(pairs, "scl_29", "SELECT sample_id, regexp_replace(regexp_replace(lower(trim(target_text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, lpad(CAST(sample_id AS VARCHAR), 8, '0') AS padded FROM text_pairs", TP, lambda p: p.select("sample_id", T.slug(c("target_text")).alias("slug"), T.padded_id(c("sample_id"), 8).alias("padded")))
on(scores, "scl_30", "SELECT id, version, version AS parsed FROM score_rows", SR, lambda r: r.select("id", "version", T.version_of(F.concat(F.lit("images/"), c("id"), F.lit("/v"), c("version"), F.lit(".png"))).alias("parsed")))

# ---------------------------------------------------------------- formulas
GEO = f"""SELECT id, version, CASE WHEN greatest(coalesce(score_vlm <= 0, false), coalesce(score_ocr <= 0, false), coalesce(cer >= 1, false), NOT exact_text_match) THEN 0.0 ELSE
  round(exp((CASE WHEN score_vlm > 0 THEN 0.35 * ln(score_vlm) ELSE 0 END + CASE WHEN score_ocr > 0 THEN 0.25 * ln(score_ocr) ELSE 0 END + CASE WHEN cer < 1 THEN 0.2 * ln(1 - cer) ELSE 0 END - 0.1 * entropy)
  / (0.2 + CASE WHEN score_vlm IS NULL THEN 0 ELSE 0.35 END + CASE WHEN score_ocr IS NULL THEN 0 ELSE 0.25 END + CASE WHEN cer IS NULL THEN 0 ELSE 0.2 END)), 6) END AS score FROM {PART}"""
F0 = M.Formula(thresholds={"score_vlm_min": 0.5, "cer_quality_min": 0.6, "entropy_max": 1.0, "odd": 1.0})
on(scores, "mth_01", f"SELECT id, version, round(1 - cer, 6) AS cq, round(exp(-entropy), 6) AS eq FROM {PART}", SR, lambda r: _evidence(r).select("id", "version", F.round(F0.component("cer_quality"), 6).alias("cq"), F.round(F0.component("entropy_quality"), 6).alias("eq")))
on(scores, "mth_02", GEO, SR, lambda r: _evidence(r).select("id", "version", F.round(F0.score(), 6).alias("score")))
on(scores, "mth_03", f"SELECT id, version, round(CASE WHEN score_vlm IS NULL OR score_ocr IS NULL THEN 0.0 ELSE score_vlm * score_ocr END, 6) AS score FROM {PART}", SR, lambda r: _evidence(r).select("id", "version", F.round(M.vlm_ocr().score(), 6).alias("score")))
on(scores, "mth_04", "SELECT name, CAST(w AS DOUBLE) AS w FROM (VALUES ('score_vlm', 0.35), ('score_ocr', 0.25), ('cer_quality', 0.20), ('entropy_quality', 0.10), ('exact_text_match', 0.10)) v(name, w)", SR, lambda r: r.sparkSession.createDataFrame(list(M.DIAGNOSTIC.items()), "name string, w double"))
on(scores, "mth_05", f"SELECT id, version, coalesce(score_vlm >= 0.5, false) AS a, coalesce(1 - cer >= 0.6, false) AS b, entropy <= 1.0 AS d, false AS o FROM {PART}", SR, lambda r: _evidence(r).select("id", "version", *[x.alias(n) for n, x in zip("abdo", F0.flags().values(), strict=True)]))
on(scores, "mth_06", f"SELECT id, version, round(coalesce((1 - least(1, cer)) * exp(-entropy), 1 - least(1, cer)), 6) AS reward FROM {PART} WHERE cer IS NOT NULL", SR, lambda r: _evidence(r).where("cer is not null").select("id", "version", F.round(M.ocr_reward(c("cer"), c("entropy")), 6).alias("reward")))


def _frames(spark, d):
    e = A.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return e.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice(c("e"), k * 8 + 1, F.lit(8))).alias("frames"))


SOFT = """SELECT vec_id, k, list_transform(p, lambda x: exp(x - list_max(p))) AS ex, p FROM (SELECT vec_id, k, list_transform(embedding[k * 8 + 1:k * 8 + 8], lambda x: CAST(x AS DOUBLE)) AS p FROM (SELECT vec_id, embedding, unnest(range(8)) AS k FROM embeddings))"""
CTC = f"""SELECT vec_id, round(avg(h), 5) AS entropy, round(min(t), 5) AS min_p, round(avg(CASE WHEN t < 0.5 THEN 1.0 ELSE 0.0 END), 5) AS frac_unc FROM (SELECT vec_id, -list_sum(list_transform(q, lambda x: x * ln(greatest(x, 0) + 1e-9))) AS h, list_max(q) AS t
  FROM (SELECT vec_id, CASE WHEN abs(list_sum(p) - 1) <= 0.05 THEN p ELSE list_transform(ex, lambda x: x / list_sum(ex)) END AS q FROM ({SOFT})) WHERE list_position(q, list_max(q)) <> 1) GROUP BY 1"""


def _ctc(spark, d):
    m = M.frame_stats(c("frames"))
    return _frames(spark, d).select("vec_id", *[F.round(x, 5).alias(n) for n, x in m.items()]).where("entropy is not null")


add("mth_07", CTC)(_ctc)
add("mth_08", f"SELECT count(*) AS regions, round(avg(entropy), 4) AS entropy, round(min(min_p), 4) AS min_p FROM ({CTC})")(lambda s, d: _ctc(s, d).agg(F.count("*").alias("regions"), F.round(F.avg("entropy"), 4).alias("entropy"), F.round(F.min("min_p"), 4).alias("min_p")))
on(scores, "mth_09", "SELECT id, version, round(score_vlm / (score_vlm + score_ocr + 1e-8), 6) AS a, round(coalesce(score_vlm / nullif(score_vlm + score_ocr, 0), 0), 6) AS b FROM score_rows", SR, lambda r: r.select("id", "version", F.round(M.yes_ratio(c("score_vlm"), c("score_ocr")), 6).alias("a"), F.round(M.yes_ratio_plain(c("score_vlm"), c("score_ocr")), 6).alias("b")))
SIG = "(3.0 * t / 1000.0 / (1.0 + 2.0 * t / 1000.0))"
STEPS = "(SELECT DISTINCT step AS t FROM metrics)"


def _steps(m):
    return m.select(c("step").alias("t")).distinct()


on(metrics, "mth_10", f"SELECT t, round({SIG}, 6) AS sigma FROM {STEPS}", ME, lambda m: _steps(m).select("t", F.round(M.sigma(c("t"), 3.0), 6).alias("sigma")))
on(metrics, "mth_11", f"SELECT t, round(5.0 * (1 - {SIG}) ** 2 / 2, 6) AS beta FROM {STEPS}", ME, lambda m: _steps(m).select("t", F.round(M.beta(c("t"), 5.0, 3.0), 6).alias("beta")))
on(
    scores, "mth_12", "SELECT run, round(avg(CASE WHEN z >= 0 THEN ln(1 + exp(-abs(z))) ELSE ln(1 + exp(-abs(z))) - z END), 6) AS loss, round(avg(CASE WHEN z > 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM (SELECT run, 2.0 * ((0.3 - score_vlm) - (0.3 - score_ocr)) AS z FROM score_rows) GROUP BY 1", SR,
    lambda r: r.withColumn("z", M.preference_logit(c("score_vlm"), c("score_ocr"), F.lit(0.3), F.lit(0.3), F.lit(2.0))).groupBy("run").agg(R.mean(M.preference_loss(c("z"))).alias("loss"), R.share(c("z") > 0).alias("accuracy")),
)
on(scores, "mth_13", "SELECT id, version, round(0.7 * score_vlm + 0.3 * score_ocr, 6) AS loss FROM score_rows", SR, lambda r: r.select("id", "version", F.round(M.masked_blend(c("score_vlm"), c("score_ocr"), 0.7), 6).alias("loss")))
on(scores, "mth_15", "SELECT id, version, 42 + id * 8 + version AS seed FROM score_rows", SR, lambda r: r.select("id", "version", M.plan_seed(42, c("id"), 8, c("version")).alias("seed")))
on(metrics, "mth_17", f"SELECT t FROM {STEPS} WHERE t > 0 AND t % 25 = 0", ME, lambda m: _steps(m).where(M.at_interval(c("t"), 25)).select("t"))
on(metrics, "mth_18", f"SELECT t, t * 4 * 2 AS b FROM {STEPS}", ME, lambda m: _steps(m).select("t", M.batch_size(c("t"), F.lit(4), F.lit(2)).alias("b")))
on(metrics, "sup_31", f"SELECT t, round(0.001 * CASE WHEN t < 10 THEN t / 10 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1, greatest(0, (t - 10) / 90)))) END, 9) AS lr FROM {STEPS}", ME, lambda m: _steps(m).select("t", F.round(M.learning_rate(c("t"), 0.001, 0.0001, 10, 100), 9).alias("lr")))
add("sup_32", "SELECT k, round(CASE WHEN k = 10 THEN 0.0 ELSE 3 * s / (1 + 2 * s) END, 6) AS sigma FROM (SELECT unnest(range(11)) AS k, 1 + (0.001 - 1) * unnest(range(11)) / 9 AS s)")(lambda s, d: s.range(1).select(F.posexplode(M.sigma_grid(10)).alias("k", "sigma")).select(c("k").cast("long").alias("k"), F.round("sigma", 6).alias("sigma")))

# ---------------------------------------------------------------- coercion
RAW = "CASE id % 6 WHEN 0 THEN 'nan' WHEN 1 THEN '' WHEN 2 THEN ' 1.5 ' WHEN 3 THEN 'yes' WHEN 4 THEN 'inf' ELSE '0' END"


def _raw(r):
    values = F.array(*map(F.lit, ("nan", "", " 1.5 ", "yes", "inf", "0")))
    return r.select("id", "version", F.element_at(values, (c("id") % 6 + 1).cast("int")).alias("raw"))


NUM = "CASE id % 6 WHEN 2 THEN 1.5 WHEN 5 THEN 0.0 END"
on(scores, "coe_01", f"SELECT id, version, CAST({NUM} AS DOUBLE) AS x FROM score_rows", SR, lambda r: _raw(r).select("id", "version", C.finite(c("raw")).alias("x")))
on(scores, "coe_02", f"SELECT id, version, CAST({NUM} AS DOUBLE) AS x FROM score_rows", SR, lambda r: _raw(r).select("id", "version", C.finite_or_marker(c("raw")).alias("x")))
on(scores, "coe_03", "SELECT id, version, CASE id % 6 WHEN 3 THEN true WHEN 5 THEN false END AS x FROM score_rows", SR, lambda r: _raw(r).select("id", "version", C.boolean(c("raw")).alias("x")))
on(
    scores, "coe_04", "SELECT id, version, run = 'A' AS typed, CAST(NULL AS BOOLEAN) AS text FROM score_rows", SR,
    lambda r: (lambda q: q.select("id", "version", C.strict_boolean(q, "flag").alias("typed"), C.strict_boolean(q, "word").alias("text")))(r.withColumns({"flag": c("run") == "A", "word": F.when(c("run") == "A", "true").otherwise("false")})),
)
on(
    scores, "coe_05", "SELECT id, version, CASE WHEN run = 'A' AND slice = 'F' THEN 'cer,entropy' WHEN run = 'A' THEN 'entropy' WHEN slice = 'F' THEN 'cer' ELSE '' END AS x FROM score_rows", SR,
    lambda r: r.select("id", "version", F.array_join(C.missing_list(F.concat(F.when(c("run") == "A", " entropy ,").otherwise(", "), F.when(c("slice") == "F", "cer,").otherwise(""))), ",").alias("x")),
)
on(scores, "coe_06", "SELECT id, version, CASE WHEN version % 2 = 0 THEN '' ELSE printf('%.6f', score) END AS x FROM score_rows", SR, lambda r: r.select("id", "version", C.six_decimals(F.when(c("version") % 2 != 0, c("score"))).alias("x")))
on(scores, "coe_07", "SELECT id, version, id % 6 IN (0, 3, 4) AS bad FROM score_rows", SR, lambda r: _raw(r).select("id", "version", C.not_finite(c("raw")).alias("bad")))
on(scores, "coe_08", "SELECT run, count(*) FILTER (id % 6 IN (2, 5)) AS n FROM score_rows GROUP BY 1", SR, lambda r: r.join(_raw(r).select("id", "version", "raw"), ["id", "version"]).groupBy("run").agg(F.count(C.finite(c("raw"))).alias("n")))
on(scores, "coe_09", "SELECT id, version, CASE id % 6 WHEN 5 THEN CAST(0 AS BIGINT) END AS x FROM score_rows", SR, lambda r: _raw(r).select("id", "version", C.integral(c("raw")).alias("x")))

# ---------------------------------------------------------------- JSON, projections
on(pairs, "jsn_01", """SELECT sample_id, '{"a":' || sample_id || ',"b":"' || target_text || '"}' AS j FROM text_pairs""", TP, lambda p: p.select("sample_id", sinks.canonical_json({"b": c("target_text"), "a": c("sample_id")}).alias("j")))
on(pairs, "jsn_02", """SELECT sample_id, sha256('{"a":' || sample_id || ',"b":"' || target_text || '"}') AS j FROM text_pairs""", TP, lambda p: p.select("sample_id", F.sha2(sinks.canonical_json({"b": c("target_text"), "a": c("sample_id")}), 256).alias("j")))
add("jsn_05", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")(lambda s, d: A.table(s, d, "events").select("event_id", F.from_json("props", "map<string,string>")["k"].try_cast("int").alias("k")))
add("jsn_06", "SELECT p_brand, array_to_string(list_sort(list_distinct(list(p_type))), ',') AS fonts FROM part GROUP BY 1")(lambda s, d: A.table(s, d, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("fonts")))
on(pairs, "jsn_07", "SELECT sample_id, count(*) AS kinds FROM (SELECT sample_id, unnest(list_distinct(string_split(target_text, ''))) AS ch FROM text_pairs) GROUP BY 1", TP, lambda p: p.select("sample_id", F.size(T.count_map(c("target_text"))).cast("long").alias("kinds")))
add("dat_01", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS t FROM events")(lambda s, d: A.table(s, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t")))
on(scored_texts, "prj_01", f"SELECT id, version, printf('%.6f', score_vlm) AS score_vlm, '{{\"exact\":' || CASE WHEN coalesce(lower(detected_text) = lower(target_text), false) THEN 'true' ELSE 'false' END || '}}' AS text_metrics FROM scored_texts", ST, lambda r: r.select("id", "version", C.six_decimals(c("score_vlm")).alias("score_vlm"), sinks.canonical_json({"exact": T.character_metrics(c("detected_text"), c("target_text"))["exact_text_match"]}).alias("text_metrics")))
on(scored_texts, "prj_02", "SELECT id, version, score_vlm, round(score_vlm * score_ocr, 6) AS score FROM scored_texts", ST, lambda r: r.withColumn("score", F.round(M.vlm_ocr().score(), 6)).select("id", "version", "score_vlm", "score"))
on(scores, "prj_03", "SELECT id, version, score_ocr AS ocr FROM score_rows", SR, lambda r: r.select("id", "version", F.coalesce("score_ocr", "score_vlm").alias("ocr")))
on(prompts, "prj_04", "SELECT id, len(regexp_extract_all(target_text, '\\p{L}')) AS target_length, coalesce(style, 'unknown') AS font FROM prompts", PR, lambda p: p.select("id", T.letters(c("target_text")).cast("long").alias("target_length"), F.coalesce("style", F.lit("unknown")).alias("font")))
on(scored_texts, "prj_05", f"SELECT id, version, round({CER}, 6) AS strict_cer, trim(coalesce(detected_text, '')) <> '' AS detected, round(score_vlm * score_ocr, 6) AS simple FROM scored_texts", ST, lambda r: R.augment(r).select("id", "version", F.round("strict_cer", 6).alias("strict_cer"), "detected", F.round("simple_product_score", 6).alias("simple")))
on(scores, "prj_06", f"SELECT id, version, CAST({NUM} AS DOUBLE) AS score, CASE id % 6 WHEN 3 THEN true WHEN 5 THEN false END AS exact FROM score_rows", SR, lambda r: _raw(r).select("id", "version", C.finite_or_marker(c("raw")).alias("score"), C.boolean(c("raw")).alias("exact")))
on(prompts, "prj_07", "SELECT id, CASE WHEN id % 2 = 0 THEN style ELSE content_type END AS font FROM prompts", PR, lambda p: p.withColumn("m", F.when(c("id") % 2 == 0, F.create_map(F.lit("font"), c("style")))).select("id", F.coalesce(c("m")["font"], c("content_type")).alias("font")))
on(prompts, "prj_08", "SELECT CASE WHEN id % 2 = 0 THEN CAST(id AS VARCHAR) ELSE 'img' || id END AS sample_id FROM prompts", PR, lambda p: p.select(F.coalesce(C.filled(F.when(c("id") % 2 == 0, c("id").cast("string")).otherwise("")), F.nullif(F.regexp_extract(F.concat(F.lit("a/img"), c("id"), F.lit(".png")), "([^/]+)\\.[a-z]+$", 1), F.lit("")), F.lit("unknown")).alias("sample_id")))
on(prompts, "prj_09", "SELECT id, coalesce(nullif(target_text, ''), nullif(style, '')) AS t FROM prompts", PR, lambda p: p.select("id", C.filled(c("target_text"), c("style")).alias("t")))

# ---------------------------------------------------------------- checks
on(prompts, "val_01", "SELECT id, CASE WHEN trim(target_text) = '' THEN 'blank' WHEN length(target_text) > 200 THEN 'too_long' WHEN n_chars % 13 = 0 THEN 'odd' END AS error FROM prompts", PR, lambda p: p.select("id", Q.first_error([(F.trim("target_text") == "", "blank"), (F.length("target_text") > 200, "too_long"), (c("n_chars") % 13 == 0, "odd")]).alias("error")))
on(prompts, "val_02", "SELECT id, regexp_matches(target_text, '[^а-яёА-ЯЁA-Za-z0-9\\s!-/:-@\\[-`{-~—–−«»…№₽]') AS illegal FROM prompts", PR, lambda p: p.select("id", Q.illegal(c("target_text")).alias("illegal")))
on(
    prompts, "val_04", """SELECT id, coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(trim(target_text)), '\\s+')) AS w) WHERE w <> '' GROUP BY w)), 0) >= 4 AS repeated,
    length(target_text) - length(replace(target_text, '"', '')) AS quotes FROM prompts""", PR,
    lambda p: p.select("id", Q.warnings(c("target_text"))["repeated_token"].alias("repeated"), F.regexp_count("target_text", F.lit('"')).cast("long").alias("quotes")),
)
on(prompts, "val_05", "SELECT count(*) FILTER (target_text IS NULL OR trim(target_text) = '') AS bad FROM prompts", PR, lambda p: p.agg(F.count_if(F.trim(F.coalesce("target_text", F.lit(""))) == "").alias("bad")))
add("val_06", "SELECT l_orderkey AS id, l_linenumber AS version, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")(lambda s, d: S.duplicates(A.table(s, d, "lineitem").select(c("l_orderkey").alias("id"), c("l_linenumber").alias("version")), "id", "version"))
add("val_07", "SELECT event_id, event_type IN ('click', 'view') AS known, TRY_CAST(props AS JSON) IS NOT NULL AS json FROM events")(lambda s, d: A.table(s, d, "events").select("event_id", c("event_type").isin("click", "view").alias("known"), F.try_parse_json("props").isNotNull().alias("json")))
add("val_08", "SELECT event_id, json_extract(props, '$.k') IS NOT NULL AS typed FROM events")(lambda s, d: A.table(s, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "double").isNotNull().alias("typed")))
add("val_11", "SELECT doc_id AS sample_id, count(*) AS count FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 10 = 0) GROUP BY 1 HAVING count(*) > 1")(lambda s, d: (lambda g: S.duplicates(g.unionAll(g.where("sample_id % 10 = 0")), "sample_id"))(A.gold(s, d).select("sample_id")))
on(scores, "val_12", "SELECT id, count(*) AS count FROM score_rows GROUP BY 1 HAVING count(*) > 1", SR, lambda r: S.duplicates(r, "id"))
on(scores, "val_13", "SELECT count(*) FILTER (version < 0) AS negative, count(*) - count(DISTINCT (id, version)) AS repeated FROM score_rows", SR, lambda r: r.agg(F.count_if(c("version") < 0).alias("negative"), (F.count("*") - F.count_distinct("id", "version")).alias("repeated")))
on(scores, "val_16", "SELECT id, version FROM score_rows WHERE id % 9 = 0", SR, lambda r: K.recheck(r.withColumn("score", F.when(c("id") % 9 == 0, c("score") + 1e-4).otherwise(c("score"))), {"score": F.round(c("score_vlm") * c("score_ocr"), 6)}).select("id", "version"))
on(scores, "val_17", "SELECT count(*) >= 64 AS enough FROM score_rows", SR, lambda r: r.agg((F.count("*") >= 64).alias("enough")))
add("val_18", "SELECT lower(p_type) AS k, count(*) AS count FROM part GROUP BY 1 HAVING count(*) > 1")(lambda s, d: S.duplicates(A.table(s, d, "part").select(F.lower("p_type").alias("k")), "k"))


# ---------------------------------------------------------------- order and sampling
on(scores, "ord_01", "SELECT id, version FROM score_rows WHERE score >= 0.8 ORDER BY id, version", SR, lambda r: S.threshold(r, 0.8).select("id", "version").orderBy("id", "version"))
on(scores, "ord_02", "SELECT version AS seed, id FROM score_rows ORDER BY 1, 2", SR, lambda r: r.select(c("version").alias("seed"), "id").orderBy("seed", "id"))
on(scores, "ord_03", "SELECT id, version FROM score_rows ORDER BY 1, 2", SR, lambda r: r.select("id", "version").orderBy("id", "version"))
on(prompts, "ord_05", "SELECT target_text, count(*) AS count FROM prompts GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 5", PR, lambda p: S.duplicates(p, "target_text").orderBy("target_text").limit(5))
add("ord_06")(lambda s, d: P.weighted_words(_words_of(A.table(s, d, "documents").select(c("text").alias("target_text"))), prompts(s, d).select(c("id").alias("draw")), 7))
on(prompts, "ord_07", None, PR, lambda p: p.select("id", P.categorical(P.uniform(1, c("id")), {"ru": 0.8, "en": 0.2}).alias("lang")))
on(prompts, "ord_08", None, PR, lambda p: p.select("id", P.choice(["bold", "thin", "neon"], 3, c("id")).alias("effect")))
on(prompts, "ord_09", None, PR, lambda p: P.subset(p.select("id"), 50, 11, "id"))
on(prompts, "ord_10", "SELECT content_type AS shape, count(*) // 16 AS batches FROM prompts GROUP BY 1 HAVING count(*) >= 16", PR, lambda p: P.batches_by_shape(p.select(c("content_type").alias("shape"), c("id").alias("sample")), 16, 1, 0).groupBy("shape").agg(F.count_distinct("batch").alias("batches")))


def _words_of(p):
    words = p.select(F.explode(F.split(F.lower("target_text"), "\\s+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").cast("double").alias("weight"))


# ---------------------------------------------------------------- scans and sinks, through files of their own format
def _csv_scores(spark, d):
    path = work_folder(spark, "scores")
    scored_texts(spark, d).select("id", "version", "score", "target_text").write.option("header", True).csv(path)
    return path


BACK = "SELECT CAST(id AS VARCHAR) AS id, CAST(version AS BIGINT) AS version, score, target_text FROM scored_texts"
add("src_01", BACK, ST)(lambda s, d: readers.scores(s, _csv_scores(s, d)))
add("src_02", "SELECT CAST(id AS VARCHAR) AS id, CAST(version AS VARCHAR) AS version FROM scored_texts", ST)(lambda s, d: readers.csv(s, _csv_scores(s, d)).select("id", "version"))
add("src_05", BACK, ST)(lambda s, d: readers.scores(s, _csv_scores(s, d), unique=True))


@add("src_03", "SELECT CAST(id AS VARCHAR) AS id, CAST(version AS VARCHAR) AS version FROM score_rows", SR)
def src_03(spark, d):
    path = work_folder(spark, "records") + ".jsonl"
    scores(spark, d).select("id", "version").write.json(path)
    return readers.records(spark, path)


@add("src_09", "SELECT sum(good)::BIGINT AS good, sum(bad)::BIGINT AS bad FROM (SELECT CASE WHEN id % 10 > 0 THEN 1 ELSE 0 END AS good, CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END AS bad FROM prompts)", PR)
def src_09(spark, d):
    from pyspark.sql import types as X

    path = work_folder(spark, "lines")
    line = F.to_json(F.struct("id", "target_text"))
    prompts(spark, d).select(F.when(c("id") % 10 == 0, F.lit("{broken")).otherwise(line).alias("value")).write.text(path)
    good, bad = readers.json_lines(spark, path, X.StructType([X.StructField("id", X.LongType()), X.StructField("target_text", X.StringType())]))
    return good.agg(F.count("*").alias("good")).crossJoin(bad.agg(F.count("*").alias("bad")))  # one row each


add("src_12", f"SELECT DISTINCT {UP.format('text')} AS key FROM benchmark")(lambda s, d: readers.excluded_targets(A.table(s, d, "benchmark"), "text"))
add("src_13", f"SELECT DISTINCT sha256({UP.format('text')}) AS sha256 FROM benchmark")(lambda s, d: readers.hash_index(A.table(s, d, "benchmark"), "text"))


@add("src_19", "SELECT CAST(event_id AS DOUBLE) AS step, reward FROM metrics", ME)
def src_19(spark, d):
    path = work_folder(spark, "metrics")
    m = metrics(spark, d)
    zero = F.lit(0.0)
    m.select(c("event_id").cast("double").alias("step"), zero.alias("loss"), "reward", zero.alias("grad_norm"), zero.alias("lr"), zero.alias("elapsed_s")).write.option("header", True).csv(path)
    return readers.metrics(spark, path).select("step", "reward")


add("src_21", f"SELECT word, CAST(count(*) AS DOUBLE) AS frequency FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) WHERE regexp_matches(word, '^[A-Za-z]+$') AND length(word) BETWEEN 2 AND 20 GROUP BY 1")(
    lambda s, d: readers.word_frequencies(_words(s, d).groupBy("word").count().select(F.concat_ws(" ", "word", "count").alias("value")), "A-Za-z")
)
add("src_22", "SELECT p_type AS id, min(p_partkey) AS scene FROM part GROUP BY 1")(lambda s, d: readers.scene_pool(A.table(s, d, "part").select(c("p_type").alias("id"), c("p_partkey").alias("scene"), c("p_partkey").alias("position"))).select("id", "scene"))
on(prompts, "src_20", "SELECT id, style AS font, 2 AS a FROM prompts", PR, lambda p: readers.nested_prompts(p.select("id", c("style").alias("font"), F.lit("red").alias("color"), F.lit("x").alias("effect"), F.lit("m").alias("text_size"), F.lit('{"a":2}').alias("char_coverage"))).select("id", "style.font", c("char_coverage")["a"].cast("int").alias("a")))


@add("snk_01", "SELECT CAST(id AS VARCHAR) AS id, CAST(version AS VARCHAR) AS version FROM score_rows WHERE score >= 0.5", SR)
def snk_01(spark, d):
    path = work_folder(spark, "selected")
    sinks.json_rows(S.threshold(scores(spark, d), 0.5).select("version", "id"), path)
    return spark.read.option("primitivesAsString", True).json(path)


@add("snk_04", "SELECT CAST(id AS VARCHAR) AS id, CAST(version AS VARCHAR) AS version, CASE WHEN version = 0 THEN run END AS run FROM score_rows WHERE version < 2", SR)
def snk_04(spark, d):
    path, r = work_folder(spark, "augmented"), scores(spark, d)
    sinks.csv_rows([r.where("version = 0").select("id", "version", "run"), r.where("version = 1").select("id", "version")], path)
    return readers.csv(spark, path)


on(prompts, "snk_12", "SELECT id, target_text || ' | ' || style AS text, len(list_filter(regexp_split_to_array(target_text, '\\s+'), lambda w: w <> '')) + 1 AS n_words FROM prompts", PR, lambda p: sinks.masked_index(p.select("id", F.array(F.struct(c("target_text").alias("text")), F.struct(c("style").alias("text"))).alias("annotations"))).select("id", "text", c("n_words").cast("long").alias("n_words")))
on(prompts, "snk_14", "SELECT CAST(id AS VARCHAR) AS id, '' AS nothing FROM prompts", PR, lambda p: sinks.pick(p, ["id", "nothing"]))
on(metrics, "snk_15", "SELECT step, round(k * 640 / greatest(n - 1, 1), 3) AS x, round(360 * (1 - coalesce((v - lo) / nullif(hi - lo, 0), 0.5)), 3) AS y FROM (SELECT step, v, row_number() OVER (ORDER BY step) - 1 AS k, count(*) OVER () AS n, min(v) OVER () AS lo, max(v) OVER () AS hi FROM (SELECT step, count(*) AS v FROM metrics GROUP BY 1))", ME, lambda m: sinks.scatter(m.groupBy("step").agg(F.count("*").alias("v")).withColumn("v", c("v").cast("double")), "step", "v"))


# ---------------------------------------------------------------- scorer seam and streams
add("udf_02", "SELECT sample_id, round(1 - abs(length(target_text) - length(detected_text)) / greatest(length(target_text), length(detected_text), 1), 6) AS score_vlm FROM text_pairs", TP)(lambda s, d: scored(pairs(s, d), c("target_text"), c("detected_text")).select("sample_id", F.round("evidence.score_vlm", 6).alias("score_vlm")))
add("udf_04", "SELECT sample_id, CAST(CASE WHEN length(target_text) = length(detected_text) THEN 1 ELSE 0 END AS DOUBLE) AS score_ocr FROM text_pairs", TP)(lambda s, d: scored(pairs(s, d), c("target_text"), c("detected_text")).select("sample_id", c("evidence.score_ocr").alias("score_ocr")))


def _event_files(spark, d):
    path = work_folder(spark, "events")
    A.table(spark, d, "events").repartition(4).write.parquet(path)
    return path


@add("str_01", "SELECT event_id, value FROM events")
def str_01(spark, d):
    """Events of two types arrive twice, in later files; each is written once."""
    files = _event_files(spark, d)
    again = A.table(spark, d, "events").where(c("event_type").isin("click", "purchase"))
    again.repartition(2).write.mode("append").parquet(files)
    rows = streaming.stream_table(spark, files).select("event_id", "value")
    path = work_folder(spark, "scored")
    streaming.idempotent_sink(rows, path, work_folder(spark, "progress"), ["event_id"]).awaitTermination()
    return spark.read.parquet(path).select("event_id", "value")


@add("str_05", "SELECT user_id, count(*) AS steps, round(avg(value), 9) AS mean FROM events GROUP BY 1")
def str_05(spark, d):
    path = work_folder(spark, "partial")
    streaming.collected(streaming.stream_table(spark, _event_files(spark, d)), lambda b: b.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("s")), path, work_folder(spark, "progress"))
    return spark.read.parquet(path).groupBy("user_id").agg(F.sum("n").alias("steps"), F.round(F.sum("s") / F.sum("n"), 9).alias("mean"))


@add("str_06", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def str_06(spark, d):
    path = work_folder(spark, "coverage")
    streaming.collected(streaming.stream_table(spark, _event_files(spark, d)), lambda b: b.groupBy("event_type").agg(F.count("*").alias("n")), path, work_folder(spark, "progress"))
    return spark.read.parquet(path).groupBy("event_type").agg(F.sum("n").alias("n"))

"""Small literal cases of each operator family, awkward inputs included."""

import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillforge.functions import coerce as C
from quillforge.functions import scores as M
from quillforge.functions import text as T
from quillforge.operators import prompts, quality, reconcile, reports, series
from quillforge.operators import selection as S
from quillforge.plans import provenance
from quillforge.sources import readers, sinks

c = F.col


def score_rows(spark, *rows):
    return spark.createDataFrame([(i, v, float(s)) for i, v, s in rows], "id string, version int, score double")


def keys(df):
    return sorted((r.id, r.version) for r in df.collect())


# --- selection


def some_rows(seed):
    """Score rows as a plain list: few distinct scores, so that ties and bounds are met often."""
    import random

    rng = random.Random(seed)
    return [(f"q{k}", v, rng.randrange(0, 21) / 20) for k in range(40) for v in range(rng.randint(1, 5))]


def by_prompt(plain):
    out = {}
    for i, v, s in plain:
        out.setdefault(i, []).append((s, v))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_selection_against_plain_loops(spark, seed):
    plain = some_rows(seed)
    r = score_rows(spark, *plain)
    assert keys(S.select_samples(r, "threshold", 0.45)) == sorted((i, v) for i, v, s in plain if s >= 0.45)
    top = [(i, v) for i, sv in by_prompt(plain).items() for s, v in sorted((x for x in sv if x[0] >= 0.4), key=lambda x: (-x[0], x[1]))[:2]]
    assert keys(S.top_k(r, 0.4, 2)) == sorted(top)
    hard = [(i, v) for i, sv in by_prompt(plain).items() for s, v in sv if s >= 0.65 and min(sv)[0] < 0.15]
    assert keys(S.hard_positive(r, 0.65, 0.15)) == sorted(hard)
    most = max(s for _, _, s in plain if s >= 0.35)
    got = {(x.id, x.version): x.sample_weight for x in S.select_samples(r, "score_weighted", 0.35).collect()}
    assert got == {(i, v): round(s / most, 12) for i, v, s in plain if s >= 0.35}
    stats = S.sample_stats(r, 0.65, 1, 0.15).first()
    assert stats.below_threshold == sum(s < 0.65 for _, _, s in plain)
    assert stats.prompts_without_hard_negative == sum(min(sv)[0] >= 0.15 for sv in by_prompt(plain).values())


@pytest.mark.parametrize("seed", [3, 4])
def test_pairs_against_plain_loops(spark, seed):
    plain = some_rows(seed)
    r = score_rows(spark, *plain)
    want, reasons = [], {x: 0 for x in S.REASONS}
    for i, sv in by_prompt(plain).items():
        (ws, wv), (ls, lv) = max(sv), min(sv)
        if len(sv) < 2:
            reasons["insufficient_versions"] += 1
        elif ws < 0.55:
            reasons["winner_below_threshold"] += 1
        elif ws - ls <= 0 or ws - ls < 0.3:
            reasons["ambiguous_below_margin"] += 1
        else:
            reasons["selected"] += 1
            want.append((i, wv, lv, round(ws - ls, 12)))
    got = sorted((x.prompt_id, x.winner_version, x.loser_version, x.margin) for x in S.select_pairs(r, "best_vs_worst", 0.55, 0.3).collect())
    assert got == sorted(want)
    counts = S.with_zeros(S.best_and_worst(r).groupBy(S.reason(0.55, 0.3, 0.0).alias("reason")).count(), S.REASONS)
    assert {x.reason: x["count"] for x in counts.collect()} == reasons
    every = [
        (i, v, w, round(s - t, 12)) for i, sv in by_prompt(plain).items() for s, v in sv for t, w in sv if s > t and s >= 0.55 and not s - t < 0.3
    ]
    got = sorted((x.prompt_id, x.winner_version, x.loser_version, x.margin) for x in S.select_pairs(r, "all_separated_pairs", 0.55, 0.3).collect())
    assert got == sorted(every)


def test_equal_scores_pass_only_for_the_loader(spark):
    r = score_rows(spark, ("a", 1, 0.6), ("a", 2, 0.6))
    assert S.select_pairs(r, "best_vs_worst", 0.5, 0.0).count() == 0
    got = S.select_pairs(r, "loader", 0.5, 0.0).first()
    assert (got.winner_version, got.loser_version) == (2, 1)
    with pytest.raises(ValueError):
        S.select_pairs(r, "best")
    with pytest.raises(ValueError):
        S.select_samples(r, "some")


def test_tampered_artifacts_are_found(spark):
    r = score_rows(spark, ("a", 1, 0.9), ("a", 2, 0.1), ("b", 1, 0.8), ("b", 2, 0.2))
    samples = S.sample_rows(S.threshold(r, 0.5), "threshold", 0.5)
    assert S.violations_of_samples(samples, r, 0.5).count() == 0
    assert S.violations_of_samples(samples, r.where("id = 'a'"), 0.5).first().violation == "missing"
    pairs = S.select_pairs(r, "best_vs_worst")
    swapped = pairs.select("pair_id", "prompt_id", c("loser_version").alias("winner_version"), c("winner_version").alias("loser_version"), c("loser_score").alias("winner_score"), c("winner_score").alias("loser_score"))
    assert {x.violation for x in S.violations_of_pairs(swapped, r, 0.5, 0.1).collect()} == {"inverted"}


# --- formulas


def evidence(spark, *rows):
    return spark.createDataFrame(rows, "score_vlm double, score_ocr double, cer double, entropy double, exact_text_match boolean")


def test_diagnostic_formula(spark):
    f = M.Formula(entropy_scale=0.5)
    got = evidence(spark, (0.9, 0.8, 0.1, 0.4, True)).select(f.score().alias("s"), f.complete().alias("ok")).first()
    assert got.ok and math.isclose(got.s, 0.9**0.35 * 0.8**0.25 * 0.9**0.2 * math.exp(-0.2) ** 0.1, rel_tol=1e-12)


def test_missing_and_zero_components(spark):
    rows = evidence(spark, (0.8, 0.75, None, None, None), (0.8, None, None, None, None), (0.0, 0.5, None, None, None), (None, None, None, None, None))
    got = rows.select(M.vlm_ocr().score().alias("s"), M.vlm_ocr().missing().alias("m")).collect()
    assert [round(x.s, 12) for x in got] == [0.6, 0.0, 0.0, 0.0] and got[1].m == ["score_ocr"]
    f = M.Formula({"score_vlm": 0.5, "score_ocr": 0.3, "cer_quality": 0.2}, {"score_vlm_min": 0.8, "score_vlm_max": 0.7, "odd": 1})
    x = evidence(spark, (0.82, None, float("nan"), None, None)).select(f.score().alias("s"), f.missing().alias("m"), *[v.alias(k) for k, v in f.flags().items()]).first()
    assert math.isclose(x.s, 0.82) and x.m == ["score_ocr", "cer"] and (x.score_vlm_min, x.score_vlm_max, x.odd) == (True, False, False)
    with pytest.raises(ValueError):
        M.formula_for("other")


def test_frame_stats(spark):
    frames = [[0.8, 0.1, 0.1], [0.2, 0.6, 0.2], [0.1, 0.1, 0.8]]
    df = spark.createDataFrame([(frames,), ([[0.9, 0.1, 0.0]],)], "f array<array<double>>")
    a, b = df.select(*[v.alias(k) for k, v in M.frame_stats(c("f")).items()]).collect()
    h = [-sum(x * math.log(x + 1e-9) for x in row) for row in frames[1:]]
    assert (a.min_p, a.frac_unc) == (0.6, 0.0) and math.isclose(a.entropy, sum(h) / 2) and b.entropy is None


def test_preference_loss_is_stable(spark):
    got = spark.createDataFrame([(0.0,), (800.0,), (-800.0,)], "z double").select(M.preference_loss(c("z")).alias("l")).collect()
    assert [round(x.l, 6) for x in got] == [round(math.log(2), 6), 0.0, 800.0]


# --- text


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(expr.alias("x")).first().x


def test_lookalikes_and_rates(spark):
    assert one(spark, T.homoglyphs(c("a")), a="ABCEHKMOPTX") == "АВСЕНКМОРТХ"
    assert one(spark, T.error_rate(c("a"), c("b"), True), a="TEFT", b="ТЕСТ") == 0.25
    assert one(spark, T.error_rate(c("a"), c("b")), a="", b=" ") == 0.0 and one(spark, T.error_rate(c("a"), c("b")), a="x", b="") == 1.0
    assert one(spark, T.plain_error_rate(c("a"), c("b")), a="x", b="   ") == 1.0
    assert one(spark, T.normal_match(c("a")), a=" Straße   X ") == "strasse x"


def test_slices(spark):
    text = "Ёлка СКИДКА 50%! длиннющееслово\nТекст"
    assert one(spark, T.slice_labels(c("a")), a=text) == ["rare_cyrillic", "has_digits", "has_punctuation", "multiline", "mixed_case", "multi_word_phrase", "long_word"]
    assert one(spark, T.slice_labels(c("a")), a="мир") == ["short_word"] and one(spark, T.slice_labels(c("a")), a="  ") == []


def test_transliteration_and_case(spark):
    assert one(spark, T.transliterate(c("a")), a="Жук съел щи, ok") == "ZHuk sel shchi, ok"
    assert one(spark, T.half_transliterate(c("a")), a="абвг") == "aбvг" and one(spark, T.half_transliterate(c("a")), a="жx") == "жx"
    assert one(spark, T.apply_case(c("a"), F.lit("title")), a="иванов-петров x") == "Иванов-Петров X"
    assert one(spark, T.stage_text(c("a"), F.lit("multiline"), c("a"), c("a")), a="one two three") == "one\ntwo three"
    assert one(spark, T.truncate_words(c("a"), 10), a="alpha beta gamma") == "alpha beta" and one(spark, T.truncate_words(c("a"), 4), a="abcdefgh") == "abcd"


def test_cleaning(spark):
    assert one(spark, T.clean_phrase(c("a")), a="<think>no</think>\n1. «Привет»") == "Привет"
    assert one(spark, T.redact(c("a")), a="Authorization: Bearer abc my_token=xyz n=1").count("abc") == 0
    assert one(spark, F.to_json(T.redact_map(F.create_map(F.lit("api_key"), c("a"), F.lit("n"), c("a")))), a="v") == '{"api_key":"<redacted>","n":"v"}'


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.text("abС 1é😀", max_size=8), st.text("abС 1é😀", max_size=8)), min_size=1, max_size=30))
def test_metrics_against_a_plain_model(spark, rows):
    m = T.character_metrics(c("a"), c("b"))
    got = spark.createDataFrame(rows, "a string, b string").select("*", T.error_rate(c("a"), c("b")).alias("cer"), T.bag_accuracy(c("a"), c("b")).alias("bag"), *[v.alias(k) for k, v in m.items()]).collect()
    for r in got:
        a, b = (" ".join(x.lower().split()) for x in (r.a, r.b))
        assert math.isclose(r.cer, (0.0 if not a else 1.0) if not b else levenshtein(a, b) / len(b))
        same = sum(x == y for x, y in zip(a, b, strict=False))
        assert (r.char_matches, r.char_total, r.exact_text_match) == (same, max(len(a), len(b)), a == b != "")
        p, t = r.a.lower().strip(), r.b.lower().strip()
        want = (0.0 if p else 1.0) if not t else max(0.0, sum(min(p.count(x), t.count(x)) for x in set(t)) / len(t) - 0.5 * max(0, len(p) - len(t)) / len(t))
        assert math.isclose(r.bag, want, abs_tol=1e-12)


# --- coercion


def test_coercion_states(spark):
    rows = spark.createDataFrame([(x,) for x in (None, "", " 1.5 ", "nan", "inf", "1e3", "yes", "False", "x")], "v string")
    got = rows.select(C.finite(c("v")).alias("f"), C.boolean(c("v")).alias("b"), C.integral(c("v")).alias("i"), C.not_finite(c("v")).alias("n")).collect()
    assert [r.f for r in got] == [None, None, 1.5, None, None, 1000.0, None, None, None]
    assert [r.b for r in got] == [None] * 6 + [True, False, None]
    assert [r.i for r in got][5] == 1000 and [r.n for r in got] == [False, False, False, True, True, False, True, True, True]


# --- reports


def test_confusions_and_false_rows(spark):
    rows = spark.createDataFrame([("1", "щит", "шит"), ("2", "щи", "ши"), ("3", "аб", "а"), ("4", "x", None)], "sample_id string, target_text string, detected_text string")
    assert {(r.expected, r.observed): r["count"] for r in reports.confusions(rows).collect()} == {("щ", "ш"): 2, ("б", "∅"): 1}
    scored = spark.createDataFrame([("1", 0.9, True), ("2", 0.1, True), ("3", 0.9, None), ("4", None, False)], "sample_id string, score double, exact_match boolean")
    gold = spark.createDataFrame([("1", "FAIL", True)], "sample_id string, human_label string, expected_exact_match boolean")
    assert {(r.sample_id, r.kind) for r in reports.false_rows(scored, gold, 0.8, 0.5).collect()} == {("1", "false_positive"), ("2", "false_negative")}


def test_pearson_without_variance(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.select(reports.pearson(c("x"), c("y")).alias("r")).first().r is None
    assert df.limit(1).select(reports.pearson(c("x"), c("y")).alias("r")).first().r is None


def test_gold_report_takes_the_first_prediction(spark):
    gold = spark.createDataFrame([("a", True, True, "Тест!"), ("b", True, True, "x")], "sample_id string, expected_exact_match boolean, expected_ocr_detected boolean, target_text string")
    pred = spark.createDataFrame([("a", False, True, "тест", 1), ("a", True, True, "тест", 0)], "sample_id string, exact_text_match boolean, ocr_detected boolean, detected_text string, position int")
    got = reports.gold_report(gold, pred).first()
    assert (got.total, got.missing, got.exact_agree, got.exact_disagree, got.detection_agree, got.text_agree) == (2, 1, 1, 0, 1, 1)


# --- quality


def test_prompt_warnings_and_scripts(spark):
    rows = ["", "напиши слово", "a a a a", 'say "x', "«»", "СКИДКА 500 ₽ − 10%", "😀"]
    df = spark.createDataFrame([(x,) for x in rows], "t string")
    got = df.select(*[v.alias(k) for k, v in quality.warnings(c("t")).items()], quality.illegal(c("t")).alias("illegal")).collect()
    assert [r.empty for r in got] == [True] + [False] * 6 and got[1].instruction and got[2].repeated_token and got[3].unmatched_quote and got[4].quotes_only
    assert [r.illegal for r in got] == [False] * 6 + [True]


def test_allocation_and_wins(spark):
    w = spark.createDataFrame([("a", 1.0, 0), ("b", 1.0, 1), ("c", 1.0, 2)], "name string, weight double, priority int")
    assert {r.name: r.samples for r in quality.allocate(w, 10).collect()} == {"a": 4, "b": 3, "c": 3}
    rows = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y")], "id string, position int, v string")
    assert quality.first_wins(rows, ["id"], "position").first().v == "x" and quality.last_wins(rows, ["id"], "position").first().v == "y"
    assert quality.entropy(spark.createDataFrame([(2,), (1,)], "count long")).first().entropy == 0.636514


# --- reconcile, series, prompts


def test_shards_and_ranges(spark):
    shards = spark.createDataFrame([(0, "a", 1), (0, "a", 1), (2, "b", 1)], "shard_idx int, id string, version int")
    assert {(r.problem, r.what) for r in reconcile.merge_shards(shards, 3, 4).collect()} == {("missing_shard", "1"), ("duplicate_key", "a/1"), ("row_count", "3")}
    ranges = spark.createDataFrame([("x", 0, 10), ("y", 10, 20), ("z", 19, 30)], "name string, begin int, end int")
    assert [r.name for r in reconcile.overlapping_ranges(ranges).collect()] == ["z"]
    with pytest.raises(ValueError):
        reconcile.seed_union({1: shards, 2: shards.drop("id")})


def test_moving_average(spark):
    rows = spark.createDataFrame([(1, k, float(k)) for k in range(1, 6)] + [(2, 1, 9.0)], "u int, step int, v double")
    got = [(r.u, r.smoothed) for r in series.moving_average(rows, "v", "step", 3, ["u"]).orderBy("u", "step").collect()]
    assert got == [(1, 2.0), (1, 3.0), (1, 4.0), (2, 9.0)]


def test_draws_are_the_same_every_time(spark):
    rows = spark.range(4000)
    lang = lambda seed: rows.select("id", prompts.categorical(prompts.uniform(seed, c("id")), {"ru": 0.8, "en": 0.2}).alias("x"))
    a = {r.id: r.x for r in lang(1).collect()}
    assert a == {r.id: r.x for r in lang(1).repartition(7).collect()} != {r.id: r.x for r in lang(2).collect()}
    assert 0.77 < sum(x == "ru" for x in a.values()) / 4000 < 0.83
    words = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "word string, weight double")
    n = prompts.weighted_words(words, rows.select(c("id").alias("draw")), 5).groupBy("word").count().collect()
    assert sum(r["count"] for r in n) == 4000 and 0.7 < next(r["count"] for r in n if r.word == "b") / 4000 < 0.8


# --- sources, sinks, provenance


def test_score_scan_lists_its_errors(spark, tmp_path):
    path = str(tmp_path / "s.csv")
    (tmp_path / "s.csv").write_text("id,version,target_text,score\n000012,1,x,0.5\np,one,x,0.1\nq,1,x,nan\n")
    with pytest.raises(readers.ContractError, match="version is no integer.*no finite number"):
        readers.scores(spark, path)
    (tmp_path / "s.csv").write_text("id,version,target_text,score\n000012,1,x,0.5\n000012,1,x,0.5\n")
    assert readers.scores(spark, path).first().id == "000012"
    with pytest.raises(readers.ContractError, match="duplicate"):
        readers.scores(spark, path, unique=True)
    with pytest.raises(readers.ContractError, match="missing columns: reward"):
        readers.scores(spark, path, "reward")


def test_prompt_lines_are_keyed_twice(spark, tmp_path):
    f = tmp_path / "p.jsonl"
    f.write_text('{"id":"a","prompt":"x"}\n\n{"id":"b","prompt":"y"}\n')
    assert {r.key for r in readers.prompt_keys(readers.numbered_lines(spark, str(f))).collect()} == {"000000", "000002", "a", "b"}
    assert {r.position for r in readers.numbered_lines(spark, str(f), count_blank=False).collect()} == {0, 1}
    assert readers.sliced(readers.numbered_lines(spark, str(f)), 1, None).count() == 1


def test_records_of_all_formats(spark, tmp_path):
    rows = [{"id": "007", "v": 1}, {"id": "b", "v": 2}]
    (tmp_path / "a.json").write_text(json.dumps({"records": rows}))
    (tmp_path / "b.json").write_text(json.dumps(rows))
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "d.csv").write_text("id,v\n007,1\nb,2\n")
    for name in ("a.json", "b.json", "c.jsonl", "d.csv"):
        assert sorted((r.id, r.v) for r in readers.records(spark, str(tmp_path / name)).collect()) == [("007", "1"), ("b", "2")]
    with pytest.raises(readers.ContractError):
        readers.records(spark, "x.txt")
    assert readers.seed_input("7=a=b") == (7, "a=b")


def test_sinks(spark, tmp_path):
    sinks.document({"b": 1, "a": "ё"}, tmp_path / "x" / "d.json")
    assert (tmp_path / "x" / "d.json").read_text() == '{\n  "a": "ё",\n  "b": 1\n}\n'
    empty = spark.createDataFrame([], "a int")
    assert not sinks.csv_rows([empty], str(tmp_path / "none")) and not (tmp_path / "none").exists()
    assert sinks.markdown_table(spark.createDataFrame([(1, None)], "a int, b string")).splitlines()[-1] == "| 1 |  |"


def test_manifests(spark, tmp_path):
    left, right = {"a": {"b": 1, "c": 2}, "d": [1]}, {"a": {"b": 1, "c": 3}, "e": 0}
    assert {(r.path, r.change) for r in provenance.manifest_diff(spark, left, right).collect()} == {("a.c", "changed"), ("d", "removed"), ("e", "added")}
    doc = provenance.advance({}, "in_progress")
    assert provenance.advance(provenance.advance(doc, "failed"), "in_progress")["attempt"] == 2
    with pytest.raises(ValueError):
        provenance.advance({}, "complete")
    assert provenance.run_manifest("Score", [], {"api_key": "x", "n": 1})["config_snapshot"] == {"api_key": "<redacted>", "n": 1}
    assert len(provenance.evaluation_grid(["a", "b"], [1, 2])) == 10
    assert [(m["field"], m["severity"]) for m in provenance.comparable(left, right, {"a"})] == [("a.c", "blocking"), ("d", "note"), ("e", "note")]
    with pytest.raises(ValueError):
        provenance.safe_path(tmp_path, "../x")
    assert provenance.records_sha256([b"ab", b"c"]) != provenance.records_sha256([b"a", b"bc"])


def test_random_chain_of_ranks_is_spearman(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(rng.randint(0, 5) / 5.0, rng.randint(0, 5) / 5.0) for _ in range(200)], "x double, y double")
    got = reports.compare_scorers(rows, "x", "y").first()
    pdf = rows.toPandas()
    assert math.isclose(got.spearman, pdf.x.rank().corr(pdf.y.rank()), abs_tol=1e-5)


def test_number_text(spark):
    """Every kind appears in its form, and the same seed gives the same texts on any partitioning."""
    import re

    from quillforge.operators import prompts as P

    rows = spark.range(500).withColumnRenamed("id", "k")
    a = {r.k: r.x for r in rows.select("k", P.number_text(1, F.col("k")).alias("x")).collect()}
    b = {r.k: r.x for r in rows.repartition(7).select("k", P.number_text(1, F.col("k")).alias("x")).collect()}
    forms = [r"20[23]\d", r"−\d\d%", r"\d{2,4} ₽", r"[0-3]\d\.[01]\d\.202[4-7]", r"#\d{1,3}"]
    hits = [sum(bool(re.fullmatch(f, x)) for x in a.values()) for f in forms]
    assert a == b and sum(hits) == 500 and min(hits) > 50


def test_record_list_hash(spark):
    import hashlib

    from quillforge.sources import sinks

    rows = spark.createDataFrame([("a", 2, "é"), ("a", 1, "xy"), ("b", 1, "")], "k string, at int, r string")
    got = {r.k: r.sha256 for r in sinks.record_list_hash(rows, ["k"], "at", F.col("r")).collect()}

    def want(*parts):
        return hashlib.sha256(b"".join(len(p).to_bytes(8, "big") + p for p in parts)).hexdigest()

    assert got == {"a": want(b"xy", "é".encode()), "b": want(b"")}


def test_pool_text_and_errors(spark):
    from quillforge.operators import prompts as P
    from quillforge.plans import provenance as V

    pools = spark.createDataFrame([("t", ["a", "b"]), ("none", [])], "theme string, words array<string>")
    draws = spark.createDataFrame([(1, "t"), (2, "none"), (3, None)], "draw int, theme string")
    got = P.pool_text(pools, draws, 3, 1).collect()
    assert [r.draw for r in got] == [1] and set(got[0].phrase) <= {"a", "b", " "} and len(got[0].phrase.split()) == 3
    good = {"targets": [{"name": "a", "revision": "0" * 40, "baseline": True}, {"name": "b", "revision": "1" * 40}], "seeds": [0, 3]}
    assert V.evaluation_errors(good) == [] and len(V.evaluation_errors({})) == 3


def test_coverage_of_all_parts(spark):
    from collections import Counter

    from quillforge.plans import catalog

    d = "/root/testdata/sf0.01"
    n = Counter((r[0], r[1]) for r in spark.read.parquet(f"{d}/lineitem.parquet").select("l_linenumber", "l_partkey").collect())
    wanted = {r[0] for r in spark.read.parquet(f"{d}/part.parquet").where("p_size < 50").select("p_partkey").collect()}
    want = {(s, k, "missing") for s in {s for s, _ in n} for k in wanted if (s, k) not in n}
    want |= {(s, k, "unknown" if k not in wanted else "duplicate") for (s, k), x in n.items() if k not in wanted or x > 1}
    got = [tuple(r) for r in catalog.QUERIES["agg_15"](spark, d).collect()]
    assert max(k for _, k, _ in got) >= 200 and len(got) == len(want) and set(got) == want


def test_rare_words_are_drawn(spark):
    from quillforge.plans import catalog_more

    text = " ".join(f"w{k} " * (2 if k < 2000 else 1) for k in range(6000))
    words = catalog_more._words_of(spark.createDataFrame([(text,)], "target_text string"))
    draws = spark.range(40_000).withColumnRenamed("id", "draw")
    got = prompts.weighted_words(words, draws, 3).groupBy("word").count().collect()
    n = {r["word"]: r["count"] for r in got}
    assert sum(n.values()) == 40_000
    rare = sum(x for w, x in n.items() if int(w[1:]) >= 2000)
    assert abs(rare / 40_000 - 0.5) < 0.02 and len(n) > 5900


def test_words_of_later_lines_are_drawn(spark, tmp_path):
    from quillforge.plans import catalog, catalog_more

    assert catalog_more
    docs = spark.createDataFrame([(k, "one\ntwo three", "en", "s", 13) for k in range(200)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.word for r in catalog.QUERIES["ord_06"](spark, str(tmp_path)).collect()} == {"one", "two", "three"}

"""Documents, artifacts, ranges, draws and streams on small cases, against plain Python."""

import random
import statistics
import time
import uuid
from pathlib import Path

import pytest
import xxhash
from pyspark.sql import functions as F

from quillforge import streaming
from quillforge.operators import curriculum, diagnostics, prompts, ranges, reconcile, reports, scorefiles
from quillforge.plans import artifacts, bundle, catalog, catalog_artifacts, catalog_more, catalog_scans, configs, generation, provenance
from quillforge.sources import documents, readers, sinks

SF = "/root/testdata/sf0.001"
assert catalog_more and catalog_scans


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- documents


def test_documents_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/a/b.json"
    assert not documents.exists(spark, path)
    documents.write(spark, {"b": 1, "a": "é"}, path)
    documents.write(spark, {"b": 2, "a": "é"}, path)
    assert documents.read(spark, path) == {"a": "é", "b": 2} and documents.names(spark, f"file://{tmp_path}/a") == ["b.json"]
    assert not documents.create(spark, {"c": 1}, path) and documents.create(spark, {"c": 1}, path + "2")
    documents.write_bytes(spark, b"[1]", path)
    for bad in (path, f"file://{tmp_path}/none.json"):
        with pytest.raises(documents.DocumentError):
            documents.read(spark, bad)


def test_claims_hold_for_one_contract(spark, tmp_path):
    path = f"file://{tmp_path}/claim.json"
    assert provenance.claim(spark, path, {"a": 1}) == provenance.claim(spark, path, {"a": 1}) == {"a": 1}
    with pytest.raises(ValueError, match="a"):
        provenance.claim(spark, path, {"a": 2})


# --- score tables


def test_digests_do_not_depend_on_order_or_files(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("x"), F.when(F.col("id") % 5 == 0, None).otherwise("t").alias("y"))
    one = scorefiles.content_digest(df)
    assert one == scorefiles.content_digest(df.repartition(7).orderBy(F.desc("id"))) and one["rows"] == 500
    assert one["sha256"] != scorefiles.content_digest(df.withColumn("x", F.col("x") + 1))["sha256"]
    assert one["sha256"] != scorefiles.content_digest(df.unionAll(df.limit(1)))["sha256"]


def canonical_row(**changes):
    row = dict.fromkeys(scorefiles.REQUIRED, "")
    row |= {"sample_id": "s", "version": "0", "score": "0.5", "product_score": "0.5", "target_text": "t", "detection_status": "not_detected", "exact_text_match": "true", "formula_complete": "0"}
    return row | changes


@pytest.mark.parametrize(
    ("field", "value", "error"),
    [("sample_id", " ", "blank"), ("version", "1.5", "whole"), ("version", "-1", "whole"), ("score", "nan", "finite"), ("product_score", None, "finite"), ("cer", "x", "finite"),
     ("char_total", "2.5", "whole"), ("detection_status", None, "unknown"), ("exact_text_match", "maybe", "truth"), ("thresholds", "{", "JSON")],
)
def test_each_row_error_is_found(spark, field, value, error):
    schema = ", ".join(f"{c} string" for c in scorefiles.REQUIRED)
    rows = [canonical_row(), canonical_row(**{field: value})]
    got = scorefiles.row_errors(spark.createDataFrame([tuple(r[c] for c in scorefiles.REQUIRED) for r in rows], schema)).collect()
    assert len(got) == 1 and error in got[0].error and field in got[0].error


def test_a_resumed_run_appends_what_is_open(spark, tmp_path):
    path, tasks = f"file://{tmp_path}/scores", spark.range(10).withColumnRenamed("id", "key")
    seen = []

    def score(open_):
        seen.append(open_.count())
        return open_.withColumn("score", F.lit(1.0))

    first = scorefiles.append_scores(tasks.where("key < 4"), path, ["key"], score, {"formula": "f"})
    assert first["execution"]["status"] == "complete"
    out = scorefiles.append_scores(tasks, path, ["key"], score, {"formula": "f"})
    assert seen == [4, 6] and out["execution"]["scored_row_count"] == 10 and documents.read(spark, f"{path}.schema.json") == out


def test_publication_is_whole_or_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    with pytest.raises(ValueError):
        scorefiles.publish(spark.range(3), path, 4)
    assert not documents.exists(spark, path)
    scorefiles.publish(spark.range(3), path, 3)
    scorefiles.publish(spark.range(5), path, 5)
    assert spark.read.json(path).count() == 5


# --- stages and bundles


def test_unknown_stages_and_missing_paths(spark):
    assert not artifacts.validate(spark, "poetry", {}).ok
    for stage in artifacts.STAGES:
        found = artifacts.validate(spark, stage, {})
        optional = {"evaluation_scores", "checkpoints", "logs", "evaluation", "run_manifest", "synthetic", *artifacts.REPORTS, *artifacts.LINES}
        assert found.ok == (stage in optional), (stage, found.errors)
    with pytest.raises(artifacts.ArtifactError, match="checkpoints_dir"):
        artifacts.validate(spark, "checkpoints", {}, ready=True)
    assert len(artifacts.STAGES) == 19 and set(artifacts.ALIASES.values()) <= set(artifacts.STAGES)


def test_bundles_share_one_small_table_and_leave_no_shuffle_files(spark, tmp_path, monkeypatch):
    local = tmp_path / "bundles"
    monkeypatch.setattr(catalog_artifacts, "work_folder", lambda _, what: f"file://{local}/{what}-{uuid.uuid4().hex}")
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = manager.getAllFiles()
        found = (files.apply(k) for k in range(files.size()))
        return {f.getName(): f.length() for f in found if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}

    def left():
        return sum(n for name, n in shuffled().items() if name not in before)

    before = shuffled()
    got = {r.kind: r for r in catalog_artifacts.prv_11(spark, SF).collect()}
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert {r.scored for r in got.values()} == {n} and got["linked"].outputs == 3 and got["unlinked"].outputs == 0
    assert len({p.parent for p in local.rglob("part-*")}) == 1  # before, JSON lines for each bundle
    size = sum(p.stat().st_size for p in local.rglob("*") if p.is_file())
    assert size < 2 * (Path(SF) / "lineitem.parquet").stat().st_size
    deadline = time.time() + 20  # files go in the background
    while left() > 1000 and time.time() < deadline:
        time.sleep(0.2)
    assert left() <= 1000


def test_formula_choice_refuses_unknown_scorers():
    with pytest.raises(ValueError):
        artifacts.choose_formula({"scorer": "ear"})
    assert artifacts.wants_product({"experiment_name": "Product run"}) and not artifacts.wants_product({"scores_csv": "product/x.csv"}, {"primary_score": "vlm"})


def test_training_configs_take_the_defaults():
    good = catalog_artifacts.GOOD
    for stage, more, drop in (("sft", {}, ()), ("dpo", {"beta": 0.1}, ()), ("masked_sft", {"masked_lambda": 0.5, "data_dir": "d"}, ("latents_dir", "text_embeds_dir", "scores_csv"))):
        config = {k: v for k, v in (good | more).items() if k not in drop}
        assert configs.training_errors(stage, config) == []
        full = configs.training_config(stage, config)
        assert list(full) == sorted(full) and set(configs.FIELDS[stage]) < set(full)
    assert configs.training_errors("sft", good | {"seed": True}) == ["seed: a whole number is needed"]
    with pytest.raises(ValueError):
        configs.training_config("sft", {})


def test_markdown_of_all_reports(spark):
    changes = provenance.manifest_diff(spark, {"a": 1, "b": 2}, {"b": 3, "c": 4})
    text = bundle.diff_markdown(changes)
    assert text.index("## added") < text.index("## removed") < text.index("## changed") and "| c |" in text
    assert "* none" in bundle.comparison_markdown([]) and "| ready | True |" in bundle.bundle_markdown(
        {"readiness": {"ready": True, "blocking_errors": [], "warnings": []}, "source_manifests": [], "made": {}}
    )
    assert bundle.findings(3, 0, 1.0, None, 0.2) == ["detection: nothing to compare", "text: agreement of 0.200 is below 0.9"]


def test_generation_contracts_see_every_change(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    path.write_text('{"id":"a"}\n\n{"id":"b"}\n{"id":"c"}\n')
    source = generation.prompt_source(spark, str(path), 1, 3)
    assert (source["records"], source["slice_records"]) == (3, 2)
    path.write_text('{"id":"a"}\n{"id":"c"}\n{"id":"b"}\n')
    assert generation.source_changes(spark, source) == ["sha256", "slice_sha256"]


# --- curricula


def test_curricula_are_planned_whole(spark):
    base = catalog_artifacts.CONFIG
    for n in (0, 500, 501, 777):
        c = curriculum.parse(base | {"generation": {"n": n}} if n >= 500 else base | {"generation": {"n": 0}, "curriculum_stages": base["curriculum_stages"][1:]})
        got = [r.position for r in curriculum.plan(spark, c).collect()]
        assert sorted(got) == list(range(n))
    with pytest.raises(curriculum.CurriculumError):
        curriculum.parse(base | {"generation": {"n": 3}})
    assert curriculum.errors([]) == ["config: no object"] and "curriculum_stages: a list is needed" in curriculum.errors({})


def test_word_weights_against_plain_loops(spark):
    words, placed = ["ab", "bcd", "d", "zz", "q1", "ж"], {"a": 10, "b": 1, "c": 4, "d": 5, "q": 0}
    letters, render = "abcdqz", {"q": 1.5}
    got = curriculum.word_weights(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(list(placed.items()), "char string, count long"), letters, render)
    in_words = {x: sum(x in w for w in words) for x in letters}
    even = sum(placed.values()) / len(letters)
    want = {}
    for w in words:
        own = [x for x in set(w) if x in letters]
        weight = 0.01
        if own:
            weight = max(max(in_words.values()) / max(1, in_words[x]) for x in own) * max(render.get(x, 1.0) for x in own)
            for x in own:
                share = placed.get(x, 0) / even
                weight *= 2.0 if share < 0.5 else 1.6 if share < 0.7 else 1.2 if share < 1 else 1.0
        want[w] = round(weight, 6)
    assert {r.word: r.weight for r in got.collect()} == want


# --- ranges


@pytest.mark.parametrize("seed", [1, 2])
def test_medians_ranks_and_positions(spark, seed):
    rng = random.Random(seed)
    plain = [(rng.choice("abc") if rng.random() < 0.95 else None, rng.choice([rng.gauss(0, 3), rng.randint(-2, 2), 1e9 * rng.random(), None]), float(rng.randint(0, 3))) for _ in range(900)]
    df = spark.createDataFrame([(k, g, None if v is None else float(v), w) for k, (g, v, w) in enumerate(plain)], "id long, g string, v double, w double")
    got = {r.g: (r.v, r.w) for r in ranges.medians(df, ["g"], ["v", "w"]).collect()}
    for g in {g for g, _, _ in plain}:
        own = [float(v) for x, v, _ in plain if x == g and v is not None]
        assert abs(got[g][0] - statistics.median(own)) < 1e-5 and got[g][1] == statistics.median(w for x, _, w in plain if x == g)
    whole = ranges.medians(df, [], ["v"]).first()
    assert abs(whole.v - statistics.median(float(v) for _, v, _ in plain if v is not None)) < 1e-5
    values = sorted(float(v) for _, v, _ in plain if v is not None)
    for r in ranges.ranks(df, "v", "rank").collect():
        low = sum(x < r.v for x in values)
        assert r["rank"] == low + (sum(x == r.v for x in values) + 1) / 2
    order = [r.id for r in ranges.numbered(df.withColumn("k", F.col("id") * 3 % 901), "k").orderBy("position").collect()]
    assert order == [r.id for r in df.withColumn("k", F.col("id") * 3 % 901).orderBy("k").collect()]
    assert ranges.medians(df.limit(0), [], ["v"]).count() in (0, 1) and ranges.numbered(df.limit(0), "id").count() == 0


def test_overlaps_against_a_plain_scan(spark):
    rng = random.Random(5)
    plain = [(f"n{k}", b, b + rng.randint(0, 30)) for k, b in enumerate(rng.choices(range(2000), k=300))]
    reach, want = None, set()
    for name, b, e in sorted(plain, key=lambda x: (x[1], x[2], x[0])):
        if reach is not None and b < reach:
            want.add(name)
        reach = e if reach is None else max(reach, e)
    got = reconcile.overlapping_ranges(spark.createDataFrame(plain, "name string, begin int, end int"))
    assert {r.name for r in got.collect()} == want


def test_plans_stay_distributed(spark):
    """No sort of all rows in one task, no nested loops over data: windows without a partition see tables of ranges only."""
    big = spark.range(10_000).select("id", (F.rand(1) * 100).alias("v"), F.lit("t").alias("g"))
    for out in (ranges.ranks(big, "v", "rank"), ranges.numbered(big, "id"), ranges.medians(big, ["g"], ["v"])):
        plan = plan_of(out)
        assert "CartesianProduct" not in plan
        # a single partition only ever follows an aggregation by range
        for part in plan.split("Exchange SinglePartition")[1:]:
            assert "HashAggregate" in part.split("\n")[1] + part.split("\n")[2] + part.split("\n")[3]
    words = big.select(F.col("id").cast("string").alias("word"), "v").withColumnRenamed("v", "weight")
    drawn = plan_of(prompts.weighted_words(words, big.select(F.col("id").alias("draw")), 3))
    assert drawn.count("NestedLoop") <= 1  # one row of range totals
    with pytest.raises(ValueError):
        reports.few(big.select("id"), 10)


# --- draws: the hash stream in plain Python


def spark_hash(*parts):
    """Spark's xxhash64: each value's bytes hashed with the hash so far as seed, 42 first."""
    h = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else p[0].to_bytes(p[1], "little", signed=True)
        h = xxhash.xxh64_intdigest(data, h)
    return h - 2**64 if h >= 2**63 else h


def test_draws_against_a_plain_stream(spark):
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    lang = {r.id: r.lang for r in catalog.QUERIES["ord_07"](spark, SF).collect()}
    assert lang == {k: "ru" if spark_hash((1, 4), (k, 8)) % (1 << 30) / (1 << 30) < 0.8 else "en" for k in docs}
    effect = {r.id: r.effect for r in catalog.QUERIES["ord_08"](spark, SF).collect()}
    assert effect == {k: ["bold", "thin", "neon"][spark_hash((3, 4), (k, 8)) % 3] for k in docs}
    for name, n, seed in (("ord_09", 50, 11), ("src_24", 100, 3)):
        got = {r.id for r in catalog.QUERIES[name](spark, SF).collect()}
        assert got == set(sorted(docs, key=lambda k: (spark_hash((seed, 4), (k, 8)), k))[:n])


# --- files and streams


def test_files_and_fan_out(spark, tmp_path):
    rows = spark.createDataFrame([(f"file://{tmp_path}/raw/{k}.bin", bytes([k]) * k) for k in range(5)], "path string, content binary")
    assert {r.path[-5]: r.bytes for r in sinks.files(rows).collect()} == {str(k): k for k in range(5)}
    sinks.files(rows).collect()
    wanted = rows.select("path", F.regexp_replace("path", "/raw/", "/out/").alias("target"))
    for _ in range(2):
        assert {r.how for r in sinks.fan_out(wanted).collect()} == {"link"}
    assert sorted(p.name for p in tmp_path.joinpath("out").iterdir()) == [f"{k}.bin" for k in range(5)]


def test_layouts_take_strict_names_only(spark):
    paths = ["/x/images/a/v0.png", "/x/images/a/v10.png", "/x/images/b/v01.png", "/x/images/c/w1.png", "/x/images/d.png"]
    got = readers.layout(spark.createDataFrame([(p,) for p in paths], "path string"), True, ".png").collect()
    assert [(r.id, r.version) for r in got] == [("a", 0), ("a", 10), (None, None), (None, None), (None, None)]


def test_a_key_is_written_once_over_all_batches(spark, tmp_path):
    for k, ids in enumerate(([1, 2, 2], [2, 3], [1, 4])):
        spark.createDataFrame([(i, k) for i in ids], "id long, batch_of int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows = streaming.stream_table(spark, f"{tmp_path}/in")
    streaming.idempotent_sink(rows, f"file://{tmp_path}/out", f"{tmp_path}/progress", ["id"]).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3, 4]
    timed = rows.withColumn("at", F.timestamp_seconds(F.col("id")))
    streaming.idempotent_sink(timed, f"file://{tmp_path}/timed", f"{tmp_path}/progress2", ["id"], "at").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/timed").collect()) == [1, 2, 3, 4]


def test_windows_close_behind_the_watermark(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", 1.0), ("2024-01-01 00:50:00", 2.0), ("2024-01-01 01:05:00", 4.0), ("2024-01-01 09:00:00", 8.0)]
    spark.createDataFrame(rows, "t string, v double").withColumn("t", F.to_timestamp("t")).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = streaming.windowed(streaming.stream_table(spark, f"{tmp_path}/in"), "t", "1 hour", "1 hour", "v")
    streaming.run_to_table(out, f"{tmp_path}/out", f"{tmp_path}/progress")
    got = sorted((r.n, r.total) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect())
    assert got == [(1, 4.0), (2, 3.0)]  # the last window stays open


def test_csv_splits_unless_lines_break(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('id,text\n1,"a ""b"" c"\n2,"x\ny"\n')
    assert [r.text for r in readers.csv(spark, str(f), multi_line=True).collect()] == ['a "b" c', "x\ny"]
    f.write_text('id,text\n1,"a ""b"" c"\n2,é\n')
    assert [r.text for r in readers.csv(spark, str(f)).collect()] == ['a "b" c', "é"]
    with pytest.raises(readers.ContractError):
        readers.synthetic_records(spark.createDataFrame([("A",), ("a",)], "id string"), spark.createDataFrame([], "id string, value string"))


def test_a_report_on_no_rows(spark):
    rows = spark.createDataFrame([], "sample_id string, target_text string, detected_text string, score_vlm double, score_ocr double, cer double, score double, exact_match boolean")
    gold = spark.createDataFrame([], "sample_id string, human_label string, expected_exact_match boolean")
    got = diagnostics.summary(diagnostics.report(rows, gold)).collect()
    assert {(r.section, r.key): r.value for r in got} == {("counts", "total"): "0", ("counts", "with_both"): "0", ("counts", "missing_evidence"): "0"}

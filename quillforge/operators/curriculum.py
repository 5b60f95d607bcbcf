"""Prompt curricula: their configuration, the plan of what to generate, and the metadata of each planned prompt."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .prompts import categorical, choice, uniform
from .quality import allocate

# fixed values: families of stages, scripts, and the weights that plain prompts draw from
FAMILIES = ("single_letters", "short_words", "phrases", "digits", "punctuation", "mixed_case", "multiline", "style", "scene")
SCRIPTS = ("cyrillic", "latin", "mixed")
LANGUAGES = ("ru", "en")
CASES = ("upper", "title", "lower", "mixed")
ROOTS = ("data", "outputs", "runs")
MOST = 1_000_000
TIERS = {"single_letters": [1], "short_words": [1, 2], "digits": [1, 2], "multiline": [4, 5]}
TIERS_ELSE = [2, 3, 4]
CASES_OF = {"mixed_case": ["mixed", "title"]}
CASES_ELSE = ["upper", "title", "lower"]


class CurriculumError(ValueError):
    """A curriculum that can't be used; all problems are listed."""


@dataclass(frozen=True)
class Stage:
    name: str
    family: str
    weight: float = 1.0
    sample_count: int | None = None
    scripts: tuple[str, ...] = ("cyrillic",)
    content_types: tuple[str, ...] = ()
    tiers: tuple[int, ...] = ()
    cases: tuple[str, ...] = ()
    languages: tuple[str, ...] = ("ru",)


@dataclass(frozen=True)
class Curriculum:
    mode: str
    seed: int
    output_path: str
    n: int
    stages: tuple[Stage, ...]
    thresholds: dict[str, Any] = field(default_factory=dict)
    content_types: dict[str, float] = field(default_factory=lambda: {"sign": 0.6, "label": 0.3, "poster": 0.1})
    russian: float = 0.8


def _whole(x: Any, low: int, high: int = MOST) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and low <= x <= high


def errors(payload: Any, content_types: list[str] | None = None) -> list[str]:
    """Everything that is wrong with a curriculum's configuration, by field."""
    if not isinstance(payload, dict):
        return ["config: no object"]
    found: list[str] = []

    def need(ok: bool, message: str) -> None:
        if not ok:
            found.append(message)

    for key in ("schema_version", "mode", "output_path"):
        need(isinstance(payload.get(key), str) and bool(payload[key].strip()), f"{key}: text is needed")
    need(_whole(payload.get("seed"), 0, 1 << 62), "seed: a whole number from 0 is needed")
    path = str(payload.get("output_path") or "")
    parts = path.split("/")
    need(not path.startswith(("/", "~")) and ".." not in parts and parts[0] in ROOTS, f"output_path: a path below {', '.join(ROOTS)} is needed")
    generation = payload.get("generation")
    n = generation.get("n") if isinstance(generation, dict) else None
    need(_whole(n, 0), "generation.n: a whole number is needed")
    need(isinstance(payload.get("validation_thresholds", {}), dict), "validation_thresholds: no object")
    stages = payload.get("curriculum_stages")
    if not isinstance(stages, list) or not stages:
        return [*found, "curriculum_stages: a list is needed"]
    names = [s.get("name") for s in stages if isinstance(s, dict)]
    need(len(set(names)) == len(names), "curriculum_stages: names repeat")
    for k, s in enumerate(stages):
        at = f"curriculum_stages[{k}]"
        if not isinstance(s, dict):
            found.append(f"{at}: no object")
            continue
        need(isinstance(s.get("name"), str) and bool(s["name"].strip()), f"{at}.name: text is needed")
        need(s.get("family") in FAMILIES, f"{at}.family: unknown")
        weight = s.get("weight", 1.0)
        need(isinstance(weight, (int, float)) and not isinstance(weight, bool) and weight > 0, f"{at}.weight: not positive")
        need(s.get("sample_count") is None or _whole(s["sample_count"], 0), f"{at}.sample_count: a whole number is needed")
        scripts = s.get("scripts", ["cyrillic"])
        need(bool(set(scripts) & set(SCRIPTS)), f"{at}.scripts: none to write in")
        need(not (s.get("family") == "single_letters" and "mixed" in scripts), f"{at}.scripts: a single letter can't be mixed")
        need(all(_whole(t, 1, 5) for t in s.get("tiers", [])), f"{at}.tiers: 1 to 5")
        need(set(s.get("cases", [])) <= set(CASES), f"{at}.cases: unknown")
        need(set(s.get("languages", ["ru"])) <= set(LANGUAGES), f"{at}.languages: unknown")
        need(content_types is None or set(s.get("content_types", [])) <= set(content_types), f"{at}.content_types: unknown")
    fixed = sum(s["sample_count"] for s in stages if isinstance(s, dict) and _whole(s.get("sample_count"), 0))
    need(not _whole(n, 0) or fixed <= n, "curriculum_stages: sample counts exceed generation.n")
    return found


def parse(payload: dict, content_types: dict[str, float] | None = None) -> Curriculum:
    if found := errors(payload, list(content_types) if content_types else None):
        raise CurriculumError("; ".join(found))
    tuples = ("scripts", "content_types", "tiers", "cases", "languages")
    stages = [Stage(**{k: tuple(v) if k in tuples else v for k, v in s.items()}) for s in payload["curriculum_stages"]]
    more = {"content_types": content_types} if content_types else {}
    return Curriculum(payload["mode"], payload["seed"], payload["output_path"], payload["generation"]["n"], tuple(stages), dict(payload.get("validation_thresholds", {})), **more)


def simple_profile(c: Curriculum, content_types: dict[str, float], tiers: tuple[int, ...] = (1, 2), cases: tuple[str, ...] = ("upper", "title")) -> Curriculum:
    """The same curriculum with fewer kinds of prompts: given content types, tiers and cases, Russian only."""
    from dataclasses import replace

    stages = tuple(replace(s, content_types=tuple(content_types), tiers=tiers, cases=cases, languages=("ru",)) for s in c.stages)
    return replace(c, stages=stages, content_types=content_types, russian=1.0)


def allocations(spark: SparkSession, c: Curriculum) -> DataFrame:
    """name and samples of each stage: fixed counts first, the rest shared by weight (largest remainder, then family and name)."""
    fixed = [(s.name, s.sample_count) for s in c.stages if s.sample_count is not None]
    open_ = [(s.name, float(s.weight), FAMILIES.index(s.family)) for s in c.stages if s.sample_count is None]
    out = spark.createDataFrame(fixed, "name string, samples long")
    left = c.n - sum(n for _, n in fixed)
    return out.unionByName(allocate(spark.createDataFrame(open_, "name string, weight double, priority int"), left)) if open_ else out


def settings(spark: SparkSession, c: Curriculum) -> dict:
    """What a generator is given: the mode, the weights, and the samples of each stage."""
    return {"mode": c.mode, "content_type_weights": c.content_types, "stage_allocations": {r.name: r.samples for r in allocations(spark, c).collect()}}


def plan(spark: SparkSession, c: Curriculum) -> DataFrame:
    """position, stage_name, stage_family: exactly n rows, stages in order; cut at n, or filled up with fallback rows."""
    order = spark.createDataFrame([(k, s.name, s.family) for k, s in enumerate(c.stages)], "place int, name string, family string")
    sized = order.join(allocations(spark, c), "name")  # one row a stage
    line = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("begin", F.coalesce(F.sum("samples").over(line), F.lit(0))).where("samples > 0")
    rows = sized.select(F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("samples") - 1)).alias("position"), F.col("name").alias("stage_name"), F.col("family").alias("stage_family"))
    planned = rows.where(F.col("position") < c.n)
    filled = sum(s.sample_count or 0 for s in c.stages) if all(s.sample_count is not None for s in c.stages) else c.n
    rest = spark.range(min(filled, c.n), c.n).select(F.col("id").alias("position"), F.lit("unallocated").alias("stage_name"), F.lit("fallback").alias("stage_family"))
    return planned.unionByName(rest)


def stage_metadata(rows: DataFrame, c: Curriculum) -> DataFrame:
    """content_type, tier, case, lang and target_script of each planned prompt, drawn by hash of seed and position."""
    key = F.col("position")

    def of_stage(pick) -> Column:
        out = F.lit(None)
        for s in c.stages:
            out = F.when(F.col("stage_name") == s.name, pick(s)).otherwise(out)
        return out

    def one(part: int, values: list) -> Column:
        return choice([str(v) for v in values], c.seed, F.lit(part), key)

    types = categorical(uniform(c.seed, F.lit(0), key), c.content_types)
    return rows.withColumns(
        {
            "content_type": F.coalesce(of_stage(lambda s: one(1, list(s.content_types)) if s.content_types else one(1, list(c.content_types))), types),
            "tier": F.coalesce(of_stage(lambda s: one(2, list(s.tiers) or TIERS.get(s.family, TIERS_ELSE))), one(2, [1, 2, 3, 4, 5])).cast("int"),
            "case": F.coalesce(of_stage(lambda s: one(3, list(s.cases) or CASES_OF.get(s.family, CASES_ELSE))), one(3, CASES_ELSE)),
            "lang": F.coalesce(of_stage(lambda s: one(4, list(s.languages))), F.when(uniform(c.seed, F.lit(4), key) < c.russian, "ru").otherwise("en")),
            "target_script": of_stage(lambda s: one(5, [x for x in s.scripts if x in SCRIPTS])).cast("string"),
        }
    )


def styles(rows: DataFrame, key: str, pools: dict[str, list[str]], seed: int) -> DataFrame:
    """A style label of each pool (font, colour, effect, size) for every row."""
    return rows.withColumns({name: choice(values, seed, F.lit(name), F.col(key)) for name, values in sorted(pools.items())})


def word_weights(words: DataFrame, placed: DataFrame, letters: str, render: dict[str, float], boosts: tuple[tuple[float, float], ...] = ((0.5, 2.0), (0.7, 1.6), (1.0, 1.2))) -> DataFrame:
    """word and weight: rarity of its rarest letter, times a boost for each letter placed too seldom so far, times the
    largest render boost. ``placed`` has char and count; letters that should be even are each an equal share of the total.

    A letter's numbers are a table of the alphabet's size, so words only join with that.
    """
    spark = words.sparkSession
    alphabet = spark.createDataFrame([(x, float(render.get(x, 1.0))) for x in dict.fromkeys(letters)], "char string, render double")
    each = words.select("word", F.explode(F.array_distinct(F.split(F.lower("word"), ""))).alias("char")).join(F.broadcast(alphabet), "char")
    in_words = each.groupBy("char").agg(F.count("*").alias("n"))
    total = placed.join(F.broadcast(alphabet.select("char")), "char", "left_semi").agg(F.sum("count").alias("total"))
    table = alphabet.join(in_words, "char", "left").join(placed, "char", "left").crossJoin(F.broadcast(total))  # the alphabet by one row
    most = F.max("n").over(Window.partitionBy())
    share = F.coalesce("count", F.lit(0)) / (F.greatest(F.coalesce("total", F.lit(0)), F.lit(1)) / alphabet_size(letters))
    boost = F.lit(1.0)
    for limit, factor in reversed(boosts):
        boost = F.when(share < limit, factor).otherwise(boost)
    table = table.select("char", (most / F.coalesce("n", F.lit(1))).alias("rarity"), boost.alias("boost"), "render")
    joined = each.select("word", "char").join(F.broadcast(table), "char")
    weight = F.max("rarity") * F.exp(F.sum(F.ln("boost"))) * F.max("render")
    scored = joined.groupBy("word").agg(weight.alias("weight"))
    return words.select("word").distinct().join(scored, "word", "left").select("word", F.round(F.coalesce("weight", F.lit(0.01)), 6).alias("weight"))


def alphabet_size(letters: str) -> int:
    return max(1, len(dict.fromkeys(letters)))

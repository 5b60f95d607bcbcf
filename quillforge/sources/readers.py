"""Scans. Text formats are read as strings and coerced by rules with names; types are never inferred."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.coerce import filled, finite, integral
from ..operators.quality import first_wins, last_wins
from ..operators.selection import duplicates


class ContractError(ValueError):
    """An input breaks its contract; all problems are listed."""


def csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A CSV file with header, every column a string.

    Values with line breaks need ``multi_line``, for which Spark reads a file in one task; without it files are split.
    """
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ContractError(f"missing columns: {', '.join(lacking)}")
    return df


def exact(df: DataFrame, columns: list[str]) -> DataFrame:
    if df.columns != columns:
        raise ContractError(f"the header is {df.columns}, not {columns}")
    return df


def score_errors(rows: DataFrame, score: str = "score") -> DataFrame:
    """Rows of a score table that can't be used, and why."""
    why = (
        F.when(F.trim(F.coalesce("id", F.lit(""))) == "", "blank id")
        .when(integral(F.col("version")).isNull(), "version is no integer")
        .when(finite(F.col(score)).isNull(), f"{score} is no finite number")
    )
    return rows.withColumn("error", why).where("error is not null")


def scores(spark: SparkSession, path: str, score: str = "score", unique: bool = False) -> DataFrame:
    """id, version, score column and target_text, typed; anything that can't be used is an error with its rows."""
    raw = require(csv(spark, path), ["id", "version", "target_text", score])
    bad = score_errors(raw, score).limit(5).collect()
    if bad:
        raise ContractError("; ".join(f"id {r.id!r} version {r.version!r}: {r.error}" for r in bad))
    rows = raw.select(F.col("id"), integral(F.col("version")).alias("version"), finite(F.col(score)).alias(score), "target_text")
    if unique and (twice := duplicates(rows, "id", "version").limit(5).collect()):
        raise ContractError("duplicate keys: " + ", ".join(f"{r.id}/{r.version}" for r in twice))
    return rows


def records(spark: SparkSession, path: str, key: str = "records") -> DataFrame:
    """CSV, JSON lines, or one JSON document that is a list or holds a list under ``key``."""
    if path.endswith(".csv"):
        return csv(spark, path)
    if path.endswith(".jsonl"):
        return spark.read.option("primitivesAsString", True).json(path)
    if path.endswith(".json"):
        df = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
        kind = dict(df.dtypes).get(key, "")
        return df.select(F.explode(key).alias("r")).select("r.*") if kind.startswith("array<struct") else df
    raise ContractError(f"no format is known for {path}")


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows and malformed lines; blank lines are skipped."""
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    df = spark.read.text(path).where(F.trim("value") != "")
    parsed = df.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), "value")
    good = parsed.where("r._bad is null").select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields])
    return good, parsed.where("r._bad is not null").select("value")


CONTRACT_BYTES = 256 << 20


def numbered_lines(spark: SparkSession, path: str, count_blank: bool = True) -> DataFrame:
    """position (from 0) and value of the lines of a contract-size file; blank lines go, counted or not before.

    The file is one row for a moment, so larger ones than a contract may be are refused.
    """
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    if size > CONTRACT_BYTES:
        raise ContractError(f"{path}: {size} bytes are too many for a file that is read as a whole")
    whole = spark.read.text(path, wholetext=True)
    if count_blank:
        return whole.select(F.posexplode(F.split("value", "\n")).alias("position", "value")).where(F.trim("value") != "")
    return whole.select(F.posexplode(F.filter(F.split("value", "\n"), lambda v: F.trim(v) != "")).alias("position", "value"))


def prompt_keys(lines: DataFrame, schema: str = "id string, prompt string, target_text string") -> DataFrame:
    """Prompt metadata under both of its names, the padded position and its own id; the later prompt wins."""
    rows = lines.select("position", F.from_json("value", schema).alias("r")).select("position", "r.*")
    named = rows.withColumn("key", X.padded_id(F.col("position"))).unionByName(rows.where("id is not null").withColumn("key", F.col("id")))
    return last_wins(named, ["key"], "position")


def sliced(lines: DataFrame, begin: int, end: int | None) -> DataFrame:
    top = F.lit(True) if end is None else F.col("position") < end
    return lines.where((F.col("position") >= begin) & top)


def image_tasks(paths: DataFrame, strict: bool = True) -> DataFrame:
    """prompt_id and version from paths images/<id>/v<n>.png; other names are dropped."""
    rows = paths.select("path", F.regexp_extract("path", "images/([^/]+)/[^/]+$", 1).alias("prompt_id"), X.version_of(F.col("path"), strict).alias("version"))
    return rows.where("prompt_id <> '' and version is not null")


def listing(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """Paths only: the content column is never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "length")


METRICS = T.StructType([T.StructField(c, T.DoubleType()) for c in ("step", "loss", "reward", "grad_norm", "lr", "elapsed_s")])


def metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS).option("header", True).option("mode", "FAILFAST").csv(path)


def word_frequencies(lines: DataFrame, letters: str = "а-яёА-ЯЁ") -> DataFrame:
    """Lines of two tokens, a word of 2 to 20 letters and a number."""
    parts = F.split(F.trim("value"), "\\s+")
    rows = lines.where(F.size(parts) == 2).select(parts[0].alias("word"), parts[1].try_cast("double").alias("frequency"))
    return rows.where(F.col("word").rlike(f"^[{letters}]+$") & F.length("word").between(2, 20) & F.col("frequency").isNotNull())


def scene_pool(rows: DataFrame) -> DataFrame:
    return first_wins(rows, ["id"], "position")


def excluded_targets(rows: DataFrame, text: str = "target_text") -> DataFrame:
    return rows.select(X.normal_target(F.col(text)).alias("key")).where("key <> ''").distinct()


def hash_index(rows: DataFrame, text: str = "target_text") -> DataFrame:
    return rows.select(X.target_digest(F.col(text)).alias("sha256")).distinct()


def nested_prompts(flat: DataFrame) -> DataFrame:
    """Style columns into one struct, and coverage text into a map."""
    style = F.struct(*[F.col(c).alias(c.removeprefix("text_")) for c in ("font", "color", "effect", "text_size")])
    rest = [c for c in flat.columns if c not in ("font", "color", "effect", "text_size", "char_coverage")]
    return flat.select(*rest, style.alias("style"), F.from_json("char_coverage", "map<string,bigint>").alias("char_coverage"))


def sample_text(row_fields: list[str]):
    return filled(*map(F.col, row_fields))


def seed_input(value: str) -> tuple[int, str]:
    """SEED=PATH."""
    m = re.fullmatch(r"(\d+)=(.+)", value)
    if not m:
        raise ContractError(f"{value!r} is not SEED=PATH")
    return int(m[1]), m[2]


def word_pools(spark: SparkSession, path: str) -> DataFrame:
    """theme, words of one JSON object of string arrays; the object is read as a map, so its keys need no schema."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("pools"))
    return whole.select(F.explode("pools").alias("theme", "words"))


def version_errors(documents: DataFrame, expected: str, column: str = "schema_version") -> DataFrame:
    """Documents whose schema version is missing or another."""
    reason = F.when(F.col(column).isNull(), "missing").otherwise("unexpected")
    return documents.where(~F.col(column).eqNullSafe(F.lit(expected))).withColumn("reason", reason)


def layout(found: DataFrame, versioned: bool, suffix: str) -> DataFrame:
    """path, id and version of files <id>/v<n><suffix> or <id><suffix>; names of another form have no id.

    A version has no leading zeros, as both v1 and v01 would otherwise be the same version.
    """
    last = suffix.replace(".", "\\.")
    pattern = f"([^/]+)/v(0|[1-9][0-9]*){last}$" if versioned else f"([^/]+){last}$"
    version = F.regexp_extract("path", pattern, 2).try_cast("int") if versioned else F.lit(None).cast("int")
    return found.select("path", F.nullif(F.regexp_extract("path", pattern, 1), F.lit("")).alias("id"), version.alias("version"))


def scoring_tasks(spark: SparkSession, images: str, texts: str) -> DataFrame:
    """id, version and path of images that have a text embedding; a folder without any is an error."""
    found = layout(listing(spark, images), True, ".png").where("id is not null")
    known = layout(listing(spark, texts, "*.pt"), False, ".pt").select("id").distinct()
    tasks = found.join(known, "id", "left_semi").select("id", "version", "path")
    if tasks.isEmpty():
        raise ContractError(f"{images}: there is nothing to score")
    return tasks


def masked_samples(spark: SparkSession, folder: str) -> DataFrame:
    """id, H and W of latents that have a text embedding; shapes come from shapes.csv where it is there."""
    latents, texts = (layout(listing(spark, f"{folder}/{d}", "*.pt"), False, ".pt").select("id").distinct() for d in ("latents", "text_embeds"))
    both = latents.join(texts, "id", "left_semi")
    from .documents import exists

    if not exists(spark, f"{folder}/shapes.csv"):
        return both.withColumns({"H": F.lit(None).cast("long"), "W": F.lit(None).cast("long")})
    shapes = last_wins(csv(spark, f"{folder}/shapes.csv").withColumn("_at", F.monotonically_increasing_id()), ["id"], "_at")
    return both.join(shapes.select("id", integral(F.col("H")).alias("H"), integral(F.col("W")).alias("W")), "id", "left")


def head_of_folder(spark: SparkSession, folder: str, n: int | None = None) -> DataFrame:
    """Paths of a folder's tensors in the order of their names, the first n if a number is given."""
    paths = listing(spark, folder, "*.pt").select("path").orderBy("path")
    return paths if n is None else paths.limit(n)


def synthetic_records(index: DataFrame, meta: DataFrame) -> DataFrame:
    """Samples of a synthesis index with their own document (id, value as JSON text).

    Samples without a document, or whose document has no annotations, are left out. Ids that differ in case only are an
    error, as file systems may take them for one.
    """
    twice = index.groupBy(F.lower("id").alias("id")).count().where("count > 1").limit(5).collect()
    if twice:
        raise ContractError("ids occur more than once: " + ", ".join(r.id for r in twice))
    schema = "resolution int, bg_path string, label string, annotations array<struct<text:string,bbox:array<double>,font:string>>"
    parsed = meta.select("id", F.from_json("value", schema).alias("m")).select("id", "m.*")
    return index.join(parsed, "id").where(F.size("annotations") > 0)


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table by its suffix, or no rows if it is not there."""
    from .documents import exists

    if exists(spark, path):
        found = records(spark, path)
        wanted = T._parse_datatype_string(schema).names
        return found.select(*[F.col(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in wanted])
    return spark.createDataFrame([], schema)

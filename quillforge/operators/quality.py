"""Prompt and synthetic-data quality: first failing rule per record, and distributions over all records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# fixed values
MARKERS = ("ответь", "придумай", "сгенерируй", "напиши", "answer", "generate", "write", "return only")
EXTRA_SYMBOLS = "—–−«»…№₽"
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SYMBOLS = "".join("\\" + c for c in ASCII_PUNCTUATION) + EXTRA_SYMBOLS


def scripts(text: Column) -> dict[str, Column]:
    return {
        "cyrillic": text.rlike("[а-яёА-ЯЁ]"),
        "latin": text.rlike("[A-Za-z]"),
        "digits": text.rlike("\\p{Nd}"),
        "punctuation": text.rlike(f"[{_SYMBOLS}]"),
    }


def illegal(text: Column, extra_letters: str = "") -> Column:
    """Whether a character is none of the scripts, digits, white space or allowed symbols."""
    return text.rlike(f"[^а-яёА-ЯЁA-Za-z{extra_letters}\\p{{Nd}}\\s\\p{{Z}}{_SYMBOLS}]")


def most_repeated(text: Column) -> Column:
    """How often the most frequent token occurs."""
    tokens = F.filter(F.split(F.lower(F.trim(text)), "(?U)\\s+"), lambda t: t != "")
    ordered = F.array_sort(tokens)
    runs = F.aggregate(
        ordered,
        F.struct(F.lit("").alias("t"), F.lit(0).alias("n"), F.lit(0).alias("m")),
        lambda a, t: F.struct(
            t.alias("t"),
            F.when(a["t"] == t, a["n"] + 1).otherwise(1).alias("n"),
            F.greatest(a["m"], F.when(a["t"] == t, a["n"] + 1).otherwise(1)).alias("m"),
        ),
    )
    return runs["m"]


def warnings(text: Column) -> dict[str, Column]:
    bare = F.trim(text)
    low = F.lower(bare)
    marker = F.lit(False)
    for m in MARKERS:
        marker = marker | F.contains(low, F.lit(m))
    return {
        "empty": bare == "",
        "instruction": (bare != "") & marker,
        "repeated_token": (bare != "") & (most_repeated(text) >= 4),
        "unmatched_quote": (bare != "") & ((F.regexp_count(bare, F.lit('"')) % 2 != 0) | (F.regexp_count(bare, F.lit("'")) % 2 != 0)),
        "quotes_only": bare.isin('""', "''", "«»"),
    }


def first_error(rules: list[tuple[Column, str]]) -> Column:
    """The name of the first rule that fails, else null."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for bad, name in rules])


BUCKETS = ("1-4", "5-12", "13-24", "25+")


def length_bucket(n: Column) -> Column:
    return F.when(n <= 4, BUCKETS[0]).when(n <= 12, BUCKETS[1]).when(n <= 24, BUCKETS[2]).otherwise(BUCKETS[3])


def duplicate_rate(rows: DataFrame, key: Column) -> DataFrame:
    return rows.groupBy(key.alias("_k")).agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("total"), F.sum(F.col("n") - 1).alias("repeats"), F.round(F.sum(F.col("n") - 1) / F.sum("n"), 6).alias("duplicate_rate")
    )


def character_counts(rows: DataFrame, text: Column) -> DataFrame:
    """Occurrences of each lower-case character that is no white space or bar.

    Every character is a row for a moment, within a task; counts by character leave it, so little moves.
    """
    each = rows.select(F.explode(F.split(F.regexp_replace(F.lower(text), "(?U)[\\s|]", ""), "")).alias("char"))
    return each.where("char <> ''").groupBy("char").agg(F.count("*").alias("count"))


def required_coverage(counts: DataFrame, required: str) -> DataFrame:
    """Each required character with its count, in the required order."""
    spark = counts.sparkSession
    wanted = spark.createDataFrame([(k, c) for k, c in enumerate(dict.fromkeys(required.lower()))], "position int, char string")
    return F.broadcast(wanted).join(counts, "char", "left").select("position", "char", F.coalesce("count", F.lit(0)).alias("count"))


def range_check(dist: DataFrame, expected: dict[str, tuple[float, float]]) -> DataFrame:
    """Expected ratio ranges against a distribution (value, fraction); an absent value has ratio 0."""
    bounds = dist.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in expected.items()], "value string, low double, high double")
    both = F.broadcast(bounds).join(dist, "value", "left").withColumn("fraction", F.coalesce("fraction", F.lit(0.0)))
    return both.select("value", "fraction", (~F.col("fraction").between(F.col("low"), F.col("high"))).alias("out_of_range"))


def entropy(counts: DataFrame, n: str = "count") -> DataFrame:
    """Shannon entropy in nats of a frame of counts, from sums only."""
    x = F.col(n).cast("double")
    got = counts.where(F.col(n) > 0).agg(F.sum(x).alias("t"), F.sum(x * F.ln(x)).alias("s"))
    return got.select(F.round(F.ln("t") - F.col("s") / F.col("t"), 6).alias("entropy"))


def allocate(weights: DataFrame, total: int) -> DataFrame:
    """Largest-remainder shares of ``total`` for stages (name, weight, priority)."""
    every = Window.partitionBy()
    raw = weights.withColumn("raw", total * F.col("weight") / F.sum("weight").over(every)).withColumn("base", F.floor("raw"))
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("raw") - F.col("base"), 12)), "priority", "name"))
    left = F.lit(total) - F.sum("base").over(every)
    out = raw.withColumn("rank", rank).withColumn("left", left)
    return out.select("name", (F.col("base") + (F.col("rank") <= F.col("left")).cast("int")).cast("long").alias("samples"))


def first_wins(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """One row a key, the one of the lowest position: an aggregation, no sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(position)).alias("_r")).select(*keys, "_r.*")


def last_wins(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(position)).alias("_r")).select(*keys, "_r.*")


def slice_quota(rows: DataFrame, excluded: DataFrame, per_slice: int, key: Column) -> DataFrame:
    """Unique targets that are not excluded, at most ``per_slice`` a slice, first ones first; the key is unique overall."""
    keyed = rows.withColumn("_key", key).join(excluded.select(F.col("key").alias("_key")).distinct(), "_key", "left_anti")
    once = first_wins(keyed, ["_key"], "position")
    rank = F.row_number().over(Window.partitionBy("slice").orderBy("position"))
    return once.withColumn("_n", rank).where(F.col("_n") <= per_slice).drop("_n", "_key")


def length_warning(text: Column, least: int, most: int) -> Column:
    return F.when(F.length(text) < least, "too_short").when(F.length(text) > most, "too_long")


def content_types(rows: DataFrame, name: str = "content_type") -> DataFrame:
    """How often each content type occurs; only texts that are not empty are one."""
    return rows.where(F.coalesce(F.col(name).cast("string"), F.lit("")) != "").groupBy(name).agg(F.count("*").alias("count"))


def required_fields(thresholds: dict, default: tuple[str, ...] = ("id", "prompt", "target_text")) -> list[str]:
    return list(thresholds.get("required_fields") or default)


def required_letters(thresholds: dict) -> list[str]:
    """Lower-case letters that a set of prompts must hold, each once, in the order given."""
    return list(dict.fromkeys("".join(thresholds.get("required_rare_characters", ())).lower()))


def resolution_key(resolution: Column, latent: Column, image: Column) -> Column:
    """WIDTHxHEIGHT of a sample: its stated square, else its latent's shape, else its image's size."""
    square = F.when(resolution.isNotNull(), F.concat_ws("x", resolution, resolution))
    out = [square]
    for value, head, sides in ((latent, "latent-", ("H", "W")), (image, "", ("W", "H"))):
        if value._jc.toString() != "NULL":
            out.append(F.when(value.isNotNull(), F.concat(F.lit(head), value[sides[0]], F.lit("x"), value[sides[1]])))
    return F.coalesce(*out)


def eval_items(rows: DataFrame, limit: int, key: str = "id") -> DataFrame:
    """The first items of an evaluation suite under their usual names: target_text (or target), and a name for each."""
    text = [F.nullif(F.col(x), F.lit("")) for x in ("target_text", "target") if x in rows.columns]
    name = [F.nullif(F.col("name"), F.lit(""))] if "name" in rows.columns else []
    out = rows.select(key, F.coalesce(*text, F.lit("")).alias("target_text"), F.coalesce(*name, F.concat(F.lit("item-"), F.col(key))).alias("name"))
    return out.orderBy(key).limit(limit)


def box_fractions(box: Column, width: Column, height: Column) -> Column:
    """area, width and height of a box [left, top, right, bottom] as shares of its image."""
    w, h = (box[2] - box[0]) / width, (box[3] - box[1]) / height
    return F.struct((w * h).alias("area"), w.alias("width"), h.alias("height"))


def contrast(foreground: Column, background: Column, scale: float = 255.0) -> Column:
    """Difference of the mean brightness inside and outside a mask, as a share of the whole scale."""
    return F.abs(foreground - background) / scale

"""Prompt generation by hash-seeded choices: the same seed gives the same rows on any cluster and partitioning.

The draws follow the stated weights; they are a stream of their own, not that of any other generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from a hash of the seed and keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / float(1 << 30)


def categorical(draw: Column, weights: dict[str, float]) -> Column:
    """The label whose share of the total weight the draw falls into."""
    total, reach, out = sum(weights.values()), 0.0, None
    for label, w in weights.items():
        reach += w
        test = draw < reach / total
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(list(weights)[-1])


def choice(values: list[str], seed: int, *keys: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(len(values))) + 1).cast("int"))


def subset(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows without replacement."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def _first_above(listed: Column, x: Column, field: str) -> Column:
    """Place in a sorted array of structs of the first one whose field is above x, by halving; the last one if none is."""
    state = F.struct(F.lit(0).alias("a"), (F.size(listed) - 1).alias("b"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["a"] + s["b"]) / 2).cast("int")
        right = (s["a"] < s["b"]) & (F.get(listed, mid)[field] <= x)
        return F.struct(F.when(right, mid + 1).otherwise(s["a"]).alias("a"), F.when(right | (s["a"] >= s["b"]), s["b"]).otherwise(mid).alias("b"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(listed) + 1)).cast("int"))
    return F.aggregate(steps, state, halve, lambda s: s["a"])


def weighted_words(words: DataFrame, draws: DataFrame, seed: int, ranges: int = 4096) -> DataFrame:
    """A word for each draw (column draw), with replacement, by inverse cumulative weight over all words.

    Words are dealt into ranges by hash. A draw falls into a range by the ranges' totals, one row of a bounded array, and
    then meets its range's sorted array of words: two binary searches, no comparison with every word. Words of no weight
    are never drawn. Sums of fractions may differ in their last digit between ranges and words; the last one takes the rest.
    """
    dealt = words.where("weight > 0").select("word", "weight", F.pmod(F.xxhash64("word"), F.lit(ranges)).alias("_r"))
    reach = dealt.withColumn("to", F.sum("weight").over(Window.partitionBy("_r").orderBy("word")))
    listed = reach.groupBy("_r").agg(F.array_sort(F.collect_list(F.struct("to", "word"))).alias("_words"))
    totals = dealt.groupBy("_r").agg(F.sum("weight").alias("_w")).withColumn("end", F.sum("_w").over(Window.orderBy("_r")))
    ends = totals.agg(F.array_sort(F.collect_list(F.struct("end", F.col("_r").alias("r"), F.col("_w").alias("w")))).alias("_ends"), F.max("end").alias("_t"))
    # two hashes, as one alone has too few values for words of a tiny share
    u = uniform(seed, F.col("draw")) + uniform(seed, F.col("draw"), F.lit("fine")) / float(1 << 30)
    spun = draws.select("draw", u.alias("_u")).crossJoin(F.broadcast(ends)).withColumn("_at", F.col("_u") * F.col("_t"))  # one row
    spun = spun.withColumn("_e", F.get("_ends", _first_above(F.col("_ends"), F.col("_at"), "end")))
    spun = spun.select("draw", F.col("_e.r").alias("_r"), (F.col("_at") - (F.col("_e.end") - F.col("_e.w"))).alias("_at"))
    hit = spun.join(listed, "_r")
    return hit.select("draw", F.get("_words", _first_above(F.col("_words"), F.col("_at"), "to"))["word"].alias("word"))


def batches_by_shape(rows: DataFrame, size: int, seed: int, epoch: int) -> DataFrame:
    """Batches of one shape; incomplete ones are dropped. Every epoch has its own order."""
    line = Window.partitionBy("shape").orderBy(F.xxhash64(F.lit(seed), F.lit(epoch), F.col("sample")), "sample")
    out = rows.withColumn("_k", F.row_number().over(line) - 1).withColumn("_n", F.count("*").over(Window.partitionBy("shape")))
    out = out.where(F.col("_k") < F.floor(F.col("_n") / size) * size)
    return out.withColumn("batch", F.floor(F.col("_k") / size).cast("int")).drop("_k", "_n")


def rarity(words: DataFrame, word: str = "word") -> DataFrame:
    """For each character, the most frequent character's word count over its own."""
    each = words.select(F.explode(F.array_distinct(F.filter(F.split(F.lower(word), ""), lambda c: c != ""))).alias("char"))
    counts = each.groupBy("char").agg(F.count("*").alias("words"))
    return counts.withColumn("rarity", F.round(F.max("words").over(Window.partitionBy()) / F.col("words"), 6))


def with_numbers_on_repeats(rows: DataFrame, text: str, keys: list[str], position: str) -> DataFrame:
    """The second and later rows of a key get their number appended."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(position))
    return rows.withColumn("_n", n).withColumn(text, F.when(F.col("_n") > 1, F.concat_ws(" ", text, "_n")).otherwise(F.col(text))).drop("_n")


# fixed values: percentages and prices that number texts draw from
PERCENTS = [10, 15, 20, 25, 30, 40, 50, 70]
PRICES = [99, 149, 199, 299, 499, 999, 1490, 2990]


def number_text(seed: int, *keys: Column) -> Column:
    """A year, discount, price, date or tag, each kind as likely; every part has a hash of its own."""

    def between(part: str, low: int, high: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(part), *keys), F.lit(high - low + 1)) + low

    date = F.format_string("%02d.%02d.%d", between("day", 1, 28), between("month", 1, 12), between("year", 2024, 2027))
    percent = F.concat(F.lit("−"), choice(list(map(str, PERCENTS)), seed, F.lit("percent"), *keys), F.lit("%"))
    price = F.concat(choice(list(map(str, PRICES)), seed, F.lit("price"), *keys), F.lit(" ₽"))
    kinds = [between("since", 2020, 2030).cast("string"), percent, price, date, F.concat(F.lit("#"), between("tag", 1, 999).cast("string"))]
    return F.element_at(F.array(*kinds), between("kind", 1, len(kinds)).cast("int"))


def pool_text(pools: DataFrame, draws: DataFrame, words: int, seed: int) -> DataFrame:
    """A phrase of that many words for each draw, from the pool of its theme; pools are one row of bounded size a theme."""
    joined = draws.join(pools, "theme")
    at = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("draw")), F.size("words")) + 1).cast("int") for k in range(words)]
    return joined.where(F.size("words") > 0).select("draw", "theme", F.concat_ws(" ", *[F.element_at("words", i) for i in at]).alias("phrase"))


def add_scenes(pool: DataFrame, new: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The pool and those new scenes whose key it lacks; of new ones with one key the first stays."""
    first = F.min_by(F.struct(*pool.columns), position).alias("_row")
    fresh = new.join(pool.select(*keys), keys, "left_anti").groupBy(*keys).agg(first)
    return pool.unionByName(fresh.select("_row.*"))

"""Positions, ranks and medians of large frames from counts by range, so that no single task holds or sorts all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 1024


def bounds(rows: DataFrame, key: str, ranges: int = RANGES) -> list:
    """Cuts that part the key's values into about equal ranges; from a sketch of fixed size, ties stay together."""
    at = [k / ranges for k in range(1, ranges)]
    got = rows.agg(F.percentile_approx(F.col(key), at, ranges * 8).alias("cuts")).first()
    return sorted(set(got.cuts or []))


def ranged(rows: DataFrame, key: str, name: str = "_range", ranges: int = RANGES) -> DataFrame:
    """Rows with the number of their range: rows of a lower number have lower keys. Keys are numbers or times; nulls come first."""
    cuts = bounds(rows, key, ranges)
    if not cuts:
        return rows.withColumn(name, F.lit(0))
    kind = rows.schema[key].dataType
    listed = F.array(*[F.lit(c).cast(kind) for c in cuts])
    # a binary search in ten steps, as a scan of the list for every row would cost a thousand comparisons
    low, high = F.lit(0), F.lit(len(cuts))
    state = F.struct(low.alias("a"), high.alias("b"))
    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["a"] + s["b"]) / 2).cast("int")
        right = (s["a"] < s["b"]) & (F.get(listed, mid) <= F.col(key))
        return F.struct(
            F.when(right, mid + 1).otherwise(s["a"]).alias("a"), F.when(right | (s["a"] >= s["b"]), s["b"]).otherwise(mid).alias("b")
        )

    at = F.aggregate(steps, state, halve, lambda s: s["a"])
    return rows.withColumn(name, F.when(F.col(key).isNull(), -1).otherwise(at))


def numbered(rows: DataFrame, key: str, name: str = "position") -> DataFrame:
    """Positions from 0 in the order of a key: counts of ranges first, then numbers within each range.

    The table of ranges has a fixed size; a range holds about a thousandth of the rows, more only if they share one key.
    """
    if rows.schema[key].dataType.typeName() in ("string", "binary", "boolean"):
        raise ValueError(f"{key}: positions follow numbers or times")
    parted = ranged(rows, key)
    counts = parted.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("_range", before.alias("_begin")))  # at most as many rows as ranges
    within = F.row_number().over(Window.partitionBy("_range").orderBy(key)) - 1
    return parted.withColumn("_within", within).join(starts, "_range").withColumn(name, F.col("_begin") + F.col("_within")).drop("_range", "_begin", "_within")


def bucket(value: Column) -> Column:
    """A whole number that grows with the value: a few thousand buckets for all doubles, fine near zero, wide far out.

    It needs no pass over the data, so it suits values that are spread over some range, such as scores and lengths.
    """
    return (F.signum(value) * F.floor(256 * F.log2(1 + 1024 * F.abs(value)))).cast("int")


def ranks(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Average ranks: counts by value, summed within buckets and before them. Rows without the key go."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_v")).agg(F.count("*").alias("_n"))
    parted = counts.withColumn("_b", bucket(F.col("_v").cast("double")))
    line = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = parted.groupBy("_b").agg(F.sum("_n").alias("_s")).select("_b", F.coalesce(F.sum("_s").over(line), F.lit(0)).alias("_begin"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    table = parted.withColumn("_inside", inside).join(F.broadcast(starts), "_b")  # at most as many rows as buckets
    table = table.select("_v", (F.col("_begin") + F.col("_inside") + (F.col("_n") + 1) / 2).alias(name))
    return rows.join(table, rows[key] == table["_v"]).drop("_v")


def medians(rows: DataFrame, by: list[str], values: list[str], places: int = 6) -> DataFrame:
    """The keys ``by`` and the exact median of each value, from counts of each (key, value).

    Totals by bucket say which bucket holds the middle; only values of one bucket of one key are put in order in one
    place, never all values of a group.
    """
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(v).alias("_name"), F.col(v).cast("double").alias("_v")) for v in values])).alias("_x"))
    keys = [*by, "_name"]
    counts = long.select(*by, "_x.*").where("_v is not null").groupBy(*keys, "_v").agg(F.count("*").alias("_n")).withColumn("_b", bucket(F.col("_v")))
    part = Window.partitionBy(*keys)
    sums = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_s"))
    sums = sums.withColumns({"_all": F.sum("_s").over(part), "_to": F.sum("_s").over(part.orderBy("_b"))})
    # places floor((all - 1) / 2) and floor(all / 2), which are one for an odd number
    sums = sums.withColumns({"_begin": F.col("_to") - F.col("_s"), "_low": F.floor((F.col("_all") - 1) / 2), "_high": F.floor(F.col("_all") / 2)})
    held = sums.where((F.col("_to") > F.col("_low")) & (F.col("_begin") <= F.col("_high")))  # one or two buckets a key
    held = held.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_b").alias("_of_b"), "_begin", "_low", "_high")
    same = F.col("_b") == F.col("_of_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    near = counts.join(held, same)
    reach = F.col("_begin") + F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy("_v"))
    near = near.withColumn("_reach", reach)
    found = near.groupBy(*keys).agg(*[F.min(F.when(F.col("_reach") > F.col(c), F.col("_v"))).alias(c) for c in ("_low", "_high")])
    middle = F.round((F.col("_low") + F.col("_high")) / 2, places)
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == v, middle)).alias(v) for v in values])

"""Shard unions, seed unions, resume, coverage overlap and diffs: what must agree, as rows that show where it doesn't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_shards(shards: DataFrame, expected: int, discovered: int) -> DataFrame:
    """Problems of a set of shards (columns shard_idx and the key id, version); no rows if all is well."""
    spark = shards.sparkSession
    wanted = spark.range(expected).select(F.col("id").cast("int").alias("shard_idx"))
    missing = wanted.join(shards.select("shard_idx").distinct(), "shard_idx", "left_anti").select(F.lit("missing_shard").alias("problem"), F.col("shard_idx").cast("string").alias("what"))
    twice = shards.groupBy("id", "version").count().where("count > 1").select(F.lit("duplicate_key").alias("problem"), F.concat_ws("/", "id", "version").alias("what"))
    size = shards.agg(F.count("*").alias("n")).where(F.col("n") != discovered).select(F.lit("row_count").alias("problem"), F.col("n").cast("string").alias("what"))
    return missing.union(twice).union(size)


def seed_union(frames: dict[int, DataFrame]) -> DataFrame:
    """Rows of all seeds with a seed column; differing schemas are an error."""
    out = None
    for seed, frame in sorted(frames.items()):
        part = frame.withColumn("seed", F.lit(seed))
        if out is not None and out.schema != part.schema:
            raise ValueError(f"the schema of seed {seed} differs")
        out = part if out is None else out.unionByName(part)
    return out


def key_drift(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Keys that only one side has."""
    only_a = a.select(*keys).exceptAll(b.select(*keys)).withColumn("side", F.lit("left"))
    return only_a.unionByName(b.select(*keys).exceptAll(a.select(*keys)).withColumn("side", F.lit("right")))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each key of either side: both, left or right."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right").otherwise("both")
    return x.join(y, key, "full_outer").select(key, side.alias("side"))


def diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ, or that one side lacks."""
    x, y = a.select(key, F.col(value).alias("left")), b.select(key, F.col(value).alias("right"))
    both = x.withColumn("_a", F.lit(1)).join(y.withColumn("_b", F.lit(1)), key, "full_outer")
    what = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("left").eqNullSafe(F.col("right")), "changed")
    return both.select(key, "left", "right", what.alias("change")).where("change is not null")


def remaining(tasks: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    return tasks.join(done.select(*keys).distinct(), list(keys), "left_anti")


def overlapping_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges [begin, end) that overlap one before them (by begin, end and name), without a self join.

    The farthest end before a range is a running maximum: within parts of the order first, then over the parts' maxima.
    """
    from pyspark.sql import Window

    from .ranges import ranged

    parted = ranged(ranges, "begin", "_part")
    line = Window.partitionBy("_part").orderBy("begin", "end", "name").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parted.groupBy("_part").agg(F.max("end").alias("_m")).select("_part", F.max("_m").over(earlier).alias("_before"))
    joined = parted.withColumn("_here", F.max("end").over(line)).join(F.broadcast(before), "_part")  # at most as many rows as parts
    return joined.where(F.col("begin") < F.greatest("_here", "_before")).drop("_part", "_here", "_before")


def recheck(rows: DataFrame, recomputed: dict[str, Column], tolerance: float = 5e-6) -> DataFrame:
    """Rows whose recorded numbers differ from the recomputed ones by more than the tolerance."""
    bad = F.lit(False)
    for name, value in recomputed.items():
        bad = bad | ~(F.abs(F.col(name) - value) <= tolerance)
    return rows.where(F.coalesce(bad, F.lit(True)))

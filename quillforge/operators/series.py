"""Training-metric series: smoothing, summaries, first and last steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moving_average(rows: DataFrame, value: str, order: str, width: int, by: list[str] | None = None) -> DataFrame:
    """Valid mode: windows that are not full give no row; a series shorter than the window stays as it is."""
    part = Window.partitionBy(*(by or []))
    line = part.orderBy(order)
    n, k = F.count("*").over(part), F.row_number().over(line)
    smooth = F.avg(value).over(line.rowsBetween(-(width - 1), 0))
    out = rows.withColumns({"_n": n, "_k": k, "smoothed": smooth})
    out = out.where((F.col("_k") >= width) | (F.col("_n") < width))
    return out.withColumn("smoothed", F.round(F.when(F.col("_n") < width, F.col(value)).otherwise(F.col("smoothed")), 12)).drop("_n", "_k")


def summary(rows: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    v = F.col(value)
    got = rows.groupBy(*by).agg(
        F.count("*").alias("steps"),
        F.min_by(v, F.col(order)).alias("first"),
        F.max_by(v, F.col(order)).alias("last"),
        F.max(v).alias("best"),
        F.round(F.avg(v), 6).alias("mean"),
    )
    return got.withColumn("delta", F.round(F.col("last") - F.col("first"), 6))


def ends(rows: DataFrame, value: str, order: str, by: list[str], n: int = 10) -> DataFrame:
    """Averages of the first and last n steps of series that have so many."""
    up, down = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by).orderBy(F.desc(order))
    ranked = rows.withColumns({"_u": F.row_number().over(up), "_d": F.row_number().over(down)})
    got = ranked.groupBy(*by).agg(
        F.count("*").alias("steps"),
        F.round(F.avg(F.when(F.col("_u") <= n, F.col(value))), 6).alias("first_mean"),
        F.round(F.avg(F.when(F.col("_d") <= n, F.col(value))), 6).alias("last_mean"),
    )
    return got.where(F.col("steps") >= n)


def throughput(step: Column, elapsed: Column) -> Column:
    return step / F.greatest(elapsed, F.lit(0.1))

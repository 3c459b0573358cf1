"""Token streams cut into training windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def placed(df: DataFrame, ids: str, order: str) -> DataFrame:
    """Records with their place in the stream of all tokens: start, ids. Places come from sums by ranges of the
    order column, so no task sees more than a range's records."""
    sized = df.select(order, F.col(ids).alias("ids"), F.size(ids).cast("long").alias("n")).withColumn("__range", F.floor(F.col(order) / 10_000))
    starts = sized.groupBy("__range").agg(F.sum("n").alias("n")).select("__range", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sized.withColumn("__inside", inside).join(starts, "__range").select((F.col("__start") + F.col("__inside")).alias("start"), "ids")


def token_windows(stream: DataFrame, batch: int, length: int) -> DataFrame:
    """Windows of batch x length tokens and the one that follows: window_id, x, y (y one ahead). stream: start,
    ids, as placed() has them. A window's first token is the last of the one before; what doesn't fill a window is
    left out. Records are cut where windows end, so rows are as many as records and windows."""
    size, start = batch * length, F.col("start")
    end = start + F.size("ids")
    first, last = F.greatest(F.lit(0), F.ceil(start / size) - 1).cast("long"), F.floor((end - 1) / size).cast("long")
    cut = stream.where(F.size("ids") > 0).select("start", "ids", F.explode(F.sequence(first, last)).alias("window_id"))
    low, high = F.greatest(start, F.col("window_id") * size), F.least(start + F.size("ids"), (F.col("window_id") + 1) * size + 1)
    parts = cut.select("window_id", low.alias("low"), F.slice("ids", (low - start + 1).cast("int"), (high - low).cast("int")).alias("part"))
    tokens = F.flatten(F.col("all.part"))
    grouped = parts.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct("low", "part"))).alias("all")).select("window_id", tokens.alias("tokens"))
    return grouped.where(F.size("tokens") == size + 1).select("window_id", F.slice("tokens", 1, size).alias("x"), F.slice("tokens", 2, size).alias("y"))


def batch_starts(spark: SparkSession, tokens: int, batch: int, length: int, steps: int, position: int = 0) -> DataFrame:
    """Where each step's window starts and the next one would: step, start, next_position. A window that would run
    over the stream's end starts from its beginning; a stream shorter than a window is an error."""
    if batch <= 0 or length <= 0 or position < 0:
        raise ValueError("batch and length must be positive, position not negative")
    size = batch * length
    most = tokens - size - 1
    if most < 0:
        raise ValueError(f"{tokens} tokens don't fill a window of {size + 1}")
    before = 0 if position > most else (most - position) // size + 1  # steps until the first return
    start = F.when(F.col("id") < before, position + F.col("id") * size).otherwise((F.col("id") - before) % (most // size + 1) * size).cast("long")
    return spark.range(steps).select(F.col("id").alias("step"), start.alias("start")).withColumn("next_position", F.col("start") + size)


def shifted(df: DataFrame, ids: str) -> DataFrame:
    """df with x and y: all ids but the last, all but the first."""
    n = F.size(ids)
    return df.withColumn("x", F.slice(ids, F.lit(1), F.greatest(n - 1, F.lit(0)))).withColumn("y", F.slice(ids, F.lit(2), F.greatest(n - 1, F.lit(0))))

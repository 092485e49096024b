"""Event-time windows. Each works on a stream (with a watermark for late rows) and on a table alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def late(df: DataFrame, time_col: str, delay: str | None) -> DataFrame:
    return df.withWatermark(time_col, delay) if delay and df.isStreaming else df


def tumbling(df: DataFrame, time_col: str, size: str, keys: list[str], aggs: list[Column], delay: str | None = None) -> DataFrame:
    return sliding(df, time_col, size, size, keys, aggs, delay)


def sliding(df: DataFrame, time_col: str, size: str, step: str, keys: list[str], aggs: list[Column], delay: str | None = None) -> DataFrame:
    """window_start, window_end, the keys and the aggregates of every window of ``size`` that begins each ``step``."""
    w = F.window(time_col, size, step)
    out = late(df, time_col, delay).groupBy(w.alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def sessions(df: DataFrame, time_col: str, gap: str, keys: list[str], aggs: list[Column], delay: str | None = None) -> DataFrame:
    """Sessions of the keys: rows less than ``gap`` apart."""
    out = late(df, time_col, delay).groupBy(F.session_window(time_col, gap).alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[c for c in out.columns if c != "w"])


def distinct_events(df: DataFrame, time_col: str, keys: list[str], delay: str) -> DataFrame:
    """The first row of each key; a stream forgets keys older than the watermark."""
    return late(df, time_col, delay).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def running_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total) after each batch of a stream, for output in update mode; Spark's own state store keeps a row per key."""
    total = F.coalesce(F.sum(F.col(value).cast("double")), F.lit(0.0))
    return df.groupBy(key).agg(F.count("*").alias("n"), total.alias("total"))


def as_of_join(left: DataFrame, right: DataFrame, on: str, time_col: str, right_time: str, columns: list[str]) -> DataFrame:
    """Each left row with the columns of the last right row of its key at or before its time.

    One sort of both sides together and a running last value: no join of all pairs. Right rows win ties in time; of
    several at one time the greatest values count.
    """
    stamp = F.struct(*[F.col(c) for c in columns])
    a = left.select("*", F.lit(1).alias("__side"), F.col(time_col).alias("__at"), F.lit(None).alias("__seen"))
    names = left.columns
    b = right.select(F.col(on), F.lit(0).alias("__side"), F.col(right_time).alias("__at"), stamp.alias("__seen"))
    a = a.withColumn("__seen", F.lit(None).cast(b.schema["__seen"].dataType))

    w = Window.partitionBy(on).orderBy("__at", "__side", F.col("__seen")).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__last", F.last("__seen", ignorenulls=True).over(w)).where("__side = 1")
    return both.select(*names, *[F.col(f"__last.{c}").alias(c if c not in names else f"right_{c}") for c in columns])

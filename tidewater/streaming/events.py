"""Event streams: windowed counts, repeats and containment in trials, as Structured Streaming queries.

Late rows are dropped beyond the watermark and nowhere else. Sessions are numbered in batches only (a stream numbers rows in the
order in which they arrive, so late rows would get other numbers).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intervals


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    """by, begin, n: counts in windows of event time (sliding ones with ``slide``); rows later than ``late`` are left out."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(*by, w.alias("w")).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("begin"), "n")


def once_each(events: DataFrame, time: str, key: list[str], late: str) -> DataFrame:
    """Each key once: repeats within the watermark are dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def in_trials(events: DataFrame, trials: DataFrame, by: list[str], time: str, low: str, high: str, bucket: float = 3600.0) -> DataFrame:
    """Events of a stream with the trials of a table that hold them (closed): a stateless join by key and time bucket, so a
    key with many trials meets those of its hour only."""
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    told = trials.withColumns({"__from": seconds(low), "__to": seconds(high)})
    return intervals.contained(events.withColumn("__at", seconds(time)), told, by, "__at", "__at", "__from", "__to", "closed", bucket).drop("__at", "__from", "__to")

"""Interval, range and as-of joins over numeric times, cut into time buckets so that no key is one task's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a point or an event lies in an interval: of the event's start and end, and the interval's (closed: both ends in;
#: early: may begin up to a second before, if it lasts beyond 50 ms after the begin).
MODES = {
    "strict": lambda s, e, lo, hi: (s > lo) & (e < hi),
    "closed": lambda s, e, lo, hi: (s >= lo) & (s <= hi),
    "start": lambda s, e, lo, hi: (s > lo) & (s < hi),
    "half_open": lambda s, e, lo, hi: (s >= lo) & (s < hi),
    "early": lambda s, e, lo, hi: (s > lo - 1) & (e > lo + 0.05) & (s < hi),
}
#: How far before its interval an event may start.
REACH = {"early": 1.0}
#: Intervals longer than this many buckets get buckets that are so many times wider, and so on.
WIDER = 8


def contained(events: DataFrame, intervals: DataFrame, by: list[str], start: str, end: str, low: str, high: str, mode: str = "strict", bucket: float = 3600.0) -> DataFrame:
    """Inner join of events with the intervals that contain them, on equal ``by``. Intervals are copied to each time
    bucket that they touch, so the join has a key of (by, bucket); both sides shuffle once.

    An interval longer than ``WIDER`` buckets is put into wider ones, so none makes more than ``WIDER`` + 2 rows; events are
    copied once for each width that some interval needs (usually one; a handful at most, as widths grow by powers).
    """
    length = F.col(high) - F.col(low) + REACH.get(mode, 0.0)
    level = F.greatest(F.ceil(F.log(F.greatest(length, F.lit(1e-9)) / (bucket * WIDER)) / F.log(F.lit(float(WIDER)))), F.lit(0)).cast("int")
    levelled = intervals.where(F.col(low).isNotNull() & F.col(high).isNotNull()).withColumn("__level", level)
    levels = [r[0] for r in levelled.select("__level").distinct().collect()] or [0]  # the logarithms of lengths: a few numbers
    width = lambda: F.lit(bucket) * F.pow(F.lit(float(WIDER)), F.col("__level"))
    at = lambda c: F.floor(c / width())
    first = at(F.col(low) - REACH.get(mode, 0.0))
    right = levelled.withColumn("__bucket", F.explode(F.sequence(first, F.greatest(at(F.col(high)), first))))
    left = events.withColumn("__level", F.explode(F.array(*[F.lit(k) for k in sorted(levels)]))).withColumn("__bucket", at(F.col(start)))
    joined = left.join(right, [*by, "__level", "__bucket"])
    return joined.where(MODES[mode](F.col(start), F.col(end), F.col(low), F.col(high))).drop("__bucket", "__level")


def assign(events: DataFrame, intervals: DataFrame, by: list[str], key: list[str], start: str, end: str, low: str, high: str, **how) -> DataFrame:
    """Each contained event once (``key`` identifies it): where intervals overlap the one that begins last wins."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(low), F.desc(high)))
    return contained(events, intervals, by, start, end, low, high, **how).withColumn("__place", place).where("__place = 1").drop("__place")


def range_aggregate(intervals: DataFrame, samples: DataFrame, by: list[str], key: list[str], low: str, high: str, time: str, value: str, bucket: float = 3600.0) -> DataFrame:
    """n, mean and sample standard deviation of the samples in each closed interval; 0 and null where there is none."""
    inside = contained(samples.select(*by, time, value), intervals.select(*by, *key, low, high), by, time, time, low, high, "closed", bucket)
    stats = inside.groupBy(*key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return intervals.join(stats, key, "left").fillna({"n": 0})


def asof(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str], forward: bool = False, strict: bool = False, bucket: float = 86400.0) -> DataFrame:
    """``left`` with the ``values`` of the nearest earlier (or later) row of ``right``, null without one; equal times
    match unless ``strict``.

    Rows are windowed inside (by, time bucket); what a bucket hands on to the next ones is one row for each bucket, so a
    hot key is spread over its buckets.
    """
    sign = -1 if forward else 1
    named = F.struct(*[F.col(v).alias(v) for v in values])
    r = right.select(*by, F.col(time).alias(time), named.alias("__r"), F.lit(2 if strict else 0).alias("__side"))
    l = left.withColumn("__side", F.lit(1))  # noqa: E741
    both = l.unionByName(r, allowMissingColumns=True).withColumn("__t", F.col(time) * sign).withColumn("__b", F.floor(F.col("__t") / bucket))
    order = Window.partitionBy(*by, "__b").orderBy("__t", "__side", "__r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("__near", F.last("__r", ignorenulls=True).over(order)).where("__side = 1")
    ends = both.groupBy(*by, "__b").agg(F.max(F.when(F.col("__side") != 1, F.struct("__t", "__r"))).alias("__last"))
    past = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, "__b", F.last("__last", ignorenulls=True).over(past)["__r"].alias("__carry"))
    got = F.coalesce("__near", "__carry")
    return near.join(carried, [*by, "__b"], "left").select(*left.columns, *[got[v].alias(v) for v in values])


def windows(events: DataFrame, samples: DataFrame, by: list[str], key: list[str], onset: str, time: str, value: str, before: int, length: int, step: float, bucket: float = 3600.0) -> DataFrame:
    """Fixed-grid event-locked windows: an array of ``length`` values from ``before`` steps before the onset, half open;
    the place is the half-even round; the latest sample wins a place (of equal times the greatest value); places without one
    are null."""
    low, high = F.col(onset) - before * step, F.col(onset) + (length - before) * step
    some = contained(samples.select(*by, time, value), events.select(*by, *key, onset).withColumns({"__low": low, "__high": high}), by, time, time, "__low", "__high", "half_open", bucket)
    place = F.bround((F.col(time) - F.col("__low")) / step).cast("int")
    one = some.withColumn("__i", place).where(F.col("__i").between(0, length - 1)).groupBy(*key, "__i").agg(F.max(F.struct(time, value))[value].alias("__v"))
    maps = one.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("__i", "__v"))).alias("__m"))  # ``length`` entries at most
    grid = F.sequence(F.lit(0), F.lit(length - 1))
    return events.join(maps, key, "left").withColumn("window", F.transform(grid, lambda i: F.col("__m")[i])).drop("__m")


def adjacent(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: dict[str, str]) -> DataFrame:
    """Left rows with a right row that touches them exactly (the left row's time equals the right one's), with the right
    row's ``values`` under new names. Of several that touch the smallest is taken."""
    named = F.struct(*[F.col(old).alias(new) for old, new in values.items()])
    first = right.groupBy(*by, F.col(right_time).alias(left_time)).agg(F.min(named).alias("__v"))
    return left.join(first, [*by, left_time]).select(*left.columns, *[F.col(f"__v.{n}").alias(n) for n in values.values()])


def bucketed_lookup(facts: DataFrame, dim: DataFrame, on: list[str], order: list[Column]) -> DataFrame:
    """Left join with the first matching row of ``dim`` by ``order``."""
    first = dim.withColumn("__n", F.row_number().over(Window.partitionBy(*on).orderBy(*order))).where("__n = 1").drop("__n")
    return facts.join(first, on, "left")


def asof_or_first(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str], **how) -> DataFrame:
    """:func:`asof` backwards, where rows before the first one of ``right`` get that one's values (a look-up clipped at its
    begin). Groups without any row there have nulls."""
    named = F.struct(*[F.col(v).alias(v) for v in values])
    first = right.groupBy(*by).agg(F.min(F.struct(F.col(time).alias("__t"), named.alias("v"))).alias("__first"))
    near = asof(left, right, by, time, values, **how).join(first, by, "left")
    before = F.col(time) < F.col("__first.__t")
    return near.withColumns({v: F.when(before, F.col(f"__first.v.{v}")).otherwise(F.col(v)) for v in values}).drop("__first")

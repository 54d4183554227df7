"""Traces and patterns held as arrays: windows, baselines, regions, aggregation of vectors, grids, spectra."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors
from .quantiles import exact_quantiles


def window(x: Column, low: int, high: int) -> Column:
    """Elements low to high - 1, from 0."""
    return F.slice(x.cast("array<double>"), low + 1, high - low)


def mean(x: Column) -> Column:
    """Mean of the elements that are not null."""
    some = F.filter(x.cast("array<double>"), lambda v: v.isNotNull())
    return F.when(F.size(some) > 0, vectors.total(some) / F.size(some))


def power(x: Column, method: str = "mean") -> Column:
    """Mean of absolute values, greatest absolute value, or root mean square."""
    size = F.transform(x.cast("array<double>"), F.abs)
    return {"mean": mean(size), "max": F.array_max(size), "rms": F.sqrt(mean(F.transform(size, lambda v: v * v)))}[method]


def window_power(df: DataFrame, x: str, low: int, high: int, method: str = "mean", baseline: tuple[int, int] | None = None, name: str = "power") -> DataFrame:
    """Power over a window; with a baseline the relative change from it (null where that is 0)."""
    p = power(window(F.col(x), low, high), method)
    if baseline:
        base = power(window(F.col(x), *baseline), method)
        p = F.when(base != 0, (p - base) / base)
    return df.withColumn(name, p)


def population_codes(df: DataFrame, condition: str, channel: str, x: str, low: int, high: int, baseline: tuple[int, int] | None = None, standardise: bool = False) -> DataFrame:
    """condition, channel, code: the mean over the window (less that of the baseline), averaged over the condition's rows;
    ``standardise``: as z-scores over the channels of a condition (0 where they are all equal)."""
    value = mean(window(F.col(x), low, high))
    if baseline:
        value = value - mean(window(F.col(x), *baseline))
    codes = df.groupBy(condition, channel).agg(F.avg(value).alias("code"))
    if standardise:
        spread = codes.groupBy(condition).agg(F.avg("code").alias("__m"), F.stddev_pop("code").alias("__s"))
        codes = codes.join(spread, condition).withColumn("code", F.when(F.col("__s") > 0, (F.col("code") - F.col("__m")) / F.col("__s")).otherwise(0.0)).drop("__m", "__s")
    return codes


def region_traces(df: DataFrame, by: list[str], region: str, vertex: str, x: str, method: str = "mean") -> DataFrame:
    """One trace for each region: the mean over its vertices, or that of the vertex that reaches the greatest absolute
    value (ties: the smallest vertex)."""
    if method == "strongest":
        best = df.groupBy(*by, region).agg(F.max(F.struct(power(F.col(x), "max").alias("p"), (-F.col(vertex)).alias("v"), F.col(x).alias("x"))).alias("__b"))
        return best.select(*by, region, F.col("__b.x").alias(x))
    parts = df.select(*by, region, F.posexplode(x).alias("__pos", "__v")).groupBy(*by, region, "__pos").agg(F.avg("__v").alias("__v"))
    return _assembled(parts, [*by, region], x)


def _assembled(parts: DataFrame, by: list[str], name: str) -> DataFrame:
    """Arrays of (__pos, __v), one row each; as long as the arrays were."""
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__v"))), lambda s: s["__v"]).alias(name))


def pooled(df: DataFrame, by: list[str], x: str, dimensions: int, how: str = "mean") -> DataFrame:
    """One vector for each group: the mean or greatest of each element, or all in a row (``order`` by the vectors); groups
    without any get zeros (of ``dimensions``)."""
    if how == "concat":
        out = df.groupBy(*by).agg(F.flatten(F.array_sort(F.collect_list(F.col(x).cast("array<double>")))).alias("__x"))  # what is asked for is the list
    else:
        fold = F.avg("__v") if how == "mean" else F.max("__v")
        parts = df.where(F.col(x).isNotNull()).select(*by, F.posexplode(F.col(x).cast("array<double>")).alias("__pos", "__v"))
        out = _assembled(parts.groupBy(*by, "__pos").agg(fold.alias("__v")), by, "__x")
        out = df.select(*by).distinct().join(out, by, "left")
    zeros = F.array_repeat(F.lit(0.0), dimensions)
    return out.select(*by, F.when(F.size("__x") > 0, F.col("__x")).otherwise(zeros).alias(x))


def masked_after(df: DataFrame, x: str, end: str, step: float, start: float = 0.0) -> DataFrame:
    """Elements at times after ``end`` become null; element i is at start + i * step."""
    return df.withColumn(x, F.transform(x, lambda v, i: F.when(start + i * step <= F.col(end), v)))


def peak(df: DataFrame, by: list[str], t: str, value: str, t_range: tuple[float, float] | None = None) -> DataFrame:
    """By group the time of the greatest mean (over whatever else there is; ties: the first), and that mean."""
    some = df if t_range is None else df.where(F.col(t).between(*t_range))
    means = some.groupBy(*by, t).agg(F.avg(value).alias("__m")).where("__m is not null")
    best = means.groupBy(*by).agg(F.max(F.struct("__m", (-F.col(t)).alias("__t"))).alias("__b")) if by else means.agg(F.max(F.struct("__m", (-F.col(t)).alias("__t"))).alias("__b"))
    return best.select(*by, (-F.col("__b.__t")).alias(t), F.col("__b.__m").alias(value))


def nearest_time(df: DataFrame, by: list[str], t: str, target: float) -> DataFrame:
    """By group the row whose time is nearest to the target (ties: the earlier)."""
    rest = [c for c in df.columns if c not in (*by, t)]
    best = df.groupBy(*by).agg(F.min(F.struct(F.abs(F.col(t) - target).alias("d"), F.col(t).alias(t), *rest)).alias("__b"))
    return best.select(*by, F.col(f"__b.{t}").alias(t), *[F.col(f"__b.{c}").alias(c) for c in rest])


def winners(df: DataFrame, by: list[str], layer: str, value: str, least: float | None = None) -> DataFrame:
    """By group the layer of the greatest mean (ties: the smallest layer), -1 where that is below ``least``."""
    means = df.groupBy(*by, layer).agg(F.avg(value).alias("__m"))
    best = means.groupBy(*by).agg(F.max(F.struct("__m", (-F.col(layer)).alias("__l"))).alias("__b"))
    winner = -F.col("__b.__l")
    return best.select(*by, (winner if least is None else F.when(F.col("__b.__m") < least, -1).otherwise(winner)).cast("int").alias("winner"), F.col("__b.__m").alias("best"))


def on_grid(samples: DataFrame, by: list[str], time: str, value: str, begin: str, end: str, step: float, bucket: float, outside: float | None = None) -> DataFrame:
    """by, k, t, value at times begin + k * step to ``end`` of each group, by straight lines between samples; ``outside``
    (null) before the first and after the last one. ``begin`` and ``end`` are columns with one value for each group.

    Each pair of samples that follow each other makes the grid's times between them, so nothing is searched, and a long
    recording is spread over (by, time bucket): the sample after a bucket's last one is the next bucket's first.
    """
    rows = samples.where(F.col(time).isNotNull() & F.col(value).isNotNull()).select(*by, begin, end, F.col(time).cast("double").alias("__t"), F.col(value).cast("double").alias("__v"))
    rows = rows.groupBy(*by, begin, end, "__t").agg(F.max("__v").alias("__v")).withColumn("__b", F.floor(F.col("__t") / bucket))
    inside = Window.partitionBy(*by, "__b").orderBy("__t")
    firsts = rows.groupBy(*by, "__b").agg(F.min(F.struct("__t", "__v")).alias("__first"))
    after = firsts.withColumn("__after", F.lead("__first").over(Window.partitionBy(*by).orderBy("__b"))).drop("__first")
    pairs = rows.join(after, [*by, "__b"]).withColumn("__to", F.coalesce(F.lead(F.struct("__t", "__v")).over(inside), F.col("__after")))
    place = lambda c: F.ceil(F.round((c - F.col(begin)) / step, 9))
    last = F.floor(F.round((F.col(end) - F.col(begin)) / step, 9))
    low = F.greatest(place(F.col("__t")), F.lit(0))
    high = F.least(F.when(F.col("__to").isNull(), F.floor(F.round((F.col("__t") - F.col(begin)) / step, 9))).otherwise(place(F.col("__to.__t")) - 1), last)
    cells = pairs.where(low <= high).withColumn("k", F.explode(F.sequence(low, high)))
    t = F.col(begin) + F.col("k") * step
    line = F.col("__v") + F.when(F.col("__to").isNull(), 0.0).otherwise((F.col("__to.__v") - F.col("__v")) * (t - F.col("__t")) / (F.col("__to.__t") - F.col("__t")))
    got = cells.select(*by, F.col("k").cast("long").alias("k"), line.alias("value"))
    grid = rows.select(*by, begin, end).distinct().where(last >= 0).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return grid.join(got, [*by, "k"], "left").select(*by, "k", t.alias("t"), F.coalesce("value", F.lit(outside).cast("double")).alias("value"))


def sampling_rate(samples: DataFrame, by: list[str], time: str) -> DataFrame:
    """Whole samples a second: one over the median step."""
    w = Window.partitionBy(*by).orderBy(time)
    steps = samples.select(*by, (F.col(time) - F.lag(time).over(w)).alias("__d"))
    return exact_quantiles(steps, "__d", [0.5], by).select(*by, F.round(1 / F.col("__q")[0]).cast("long").alias("rate"))


def spectra(df: DataFrame, key: list[str], x: str, rate: float, length: int, overlap: int, average: str = "mean") -> DataFrame:
    """key, frequency, density: Welch's estimate from Hann-windowed stretches without their means. Narrow: one row's array
    at a time, stretches that would leave it are left out."""
    shape = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)
    scale = rate * (shape * shape).sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for trace in batch.column(batch.num_columns - 1).to_pylist():
                v = np.array(trace or [], float)
                begin = np.arange(0, len(v) - length + 1, length - overlap)
                if not len(begin):
                    out.append(None)
                    continue
                part = v[begin[:, None] + np.arange(length)]
                p = np.abs(np.fft.rfft((part - part.mean(1, keepdims=True)) * shape, axis=1)) ** 2 / scale
                p[:, 1 : (length + 1) // 2] *= 2
                out.append((np.median(p, 0) if average == "median" else p.mean(0)).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.float64()))], names=[*key, "p"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)
    rows = df.select(*key, F.col(x).cast("array<double>").alias(x)).mapInArrow(run, f"{kinds}, p array<double>")
    return rows.select(*key, F.posexplode("p").alias("__k", "density")).select(*key, (F.col("__k") * rate / length).alias("frequency"), "density")


def component_scores(components: DataFrame, signals: DataFrame, component: str, t: str, value: str, names: list[str]) -> DataFrame:
    """Correlation of each component's course with each signal over the times that both have."""
    both = components.join(signals, t)
    return both.groupBy(component).agg(F.count("*").alias("n"), *[F.corr(value, n).alias(f"r_{n}") for n in names])


def top_share(df: DataFrame, score: str, key: str, share: float) -> DataFrame:
    """The max(1, ceil(n * share)) rows of the greatest absolute score (ties: the smallest key)."""
    n = max(1, -int(-df.count() * share // 1))
    return df.orderBy(F.desc(F.abs(score)), key).limit(n)


def covariance_distance(a: DataFrame, b: DataFrame, value: str = "c") -> DataFrame:
    """One row: the Frobenius norm of a - b over that of a, of matrices given as i, j, value (absent cells are 0)."""
    both = a.select("i", "j", F.col(value).alias("__a")).join(b.select("i", "j", F.col(value).alias("__b")), ["i", "j"], "full_outer").fillna(0.0, ["__a", "__b"])
    return both.agg((F.sqrt(F.sum((F.col("__a") - F.col("__b")) ** 2)) / F.sqrt(F.sum(F.col("__a") ** 2))).alias("distance"))

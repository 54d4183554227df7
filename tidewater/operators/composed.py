"""Loaders and preparations that put operators together: samples in trials, kinds of events, pupil traces, scenes, examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import arrays, intervals, matrices, reports, sampling, sequence, vectors
from .quantiles import exact_quantiles, with_quantiles


def samples_in_trials(samples: DataFrame, trials: DataFrame, by: list[str], time: str, bucket: float = 60.0) -> tuple[DataFrame, DataFrame]:
    """Samples with the trial and scene whose closed window holds them (of several the later one), and a report on them.
    ``trials``: by, trial, scene, onset, offset."""
    missing = [c for c in (*by, "trial", "scene", "onset", "offset") if c not in trials.columns]
    if missing:
        raise ValueError(f"trials have no columns {missing}")
    inside = intervals.contained(samples.select(*by, time).distinct(), trials.select(*by, "trial", "scene", "onset", "offset"), by, time, time, "onset", "offset", "closed", bucket)
    last = inside.groupBy(*by, time).agg(F.max(F.struct("onset", "offset", "trial", "scene")).alias("__m"))
    out = samples.join(last, [*by, time], "left").select(*samples.columns, F.col("__m.trial").alias("trial"), F.col("__m.scene").alias("scene"))
    return out, reports.assignment_report(out, "scene", "trial")


def of_kind(events: DataFrame, kind: str, column: str = "type", recording: str | None = None, amplitude: tuple[str, str, str, str] | None = None) -> DataFrame:
    """Events of one kind ('all': any) and recording; with ``amplitude`` (start x, y, end x, y) it is computed anew."""
    df = events if kind == "all" else events.where(F.col(column) == kind)
    df = df if recording is None else df.where(F.col("recording") == recording)
    if amplitude:
        x0, y0, x1, y1 = map(F.col, amplitude)
        df = df.withColumn("amplitude", F.hypot(x1 - x0, y1 - y0))
    return df


def pupil_traces(df: DataFrame, by: list[str], x: str, end: str, step: float, tails: tuple[float, float] = (0.02, 0.98)) -> DataFrame:
    """Traces without what follows their event's end; those whose least or greatest value is beyond the group's tails go; the
    rest is scaled by the group's median and interquartile range over all elements."""
    cut = arrays.masked_after(df, x, end, step).withColumns({"__lo": F.array_min(x), "__hi": F.array_max(x)})
    low, high = (exact_quantiles(cut, c, [p], by).withColumnRenamed("__q", f"{c}_bar") for c, p in (("__lo", tails[0]), ("__hi", tails[1])))
    kept = cut.join(low, by).join(high, by).where((F.col("__lo") >= F.col("__lo_bar")[0]) & (F.col("__hi") <= F.col("__hi_bar")[0])).drop("__lo", "__hi", "__lo_bar", "__hi_bar")
    q = exact_quantiles(kept.select(*by, F.explode(x).alias("__v")), "__v", [0.25, 0.5, 0.75], by)
    iqr = F.col("__q")[2] - F.col("__q")[0]
    return kept.join(q, by).withColumn(x, F.transform(x, lambda v: (v - F.col("__q")[1]) / F.when(iqr > 0, iqr).otherwise(1.0))).drop("__q")


def scaled(df: DataFrame, by: list[str], value: str, how: str = "robust", name: str = "scaled") -> DataFrame:
    """robust ((x - median) / IQR), standard ((x - mean) / sd, population) or median (x - median), by group."""
    if how == "robust":
        return sequence.robust_scale(df, by, value, name)
    v = F.col(value)
    if how == "median":
        return with_quantiles(df, value, [0.5], by).withColumn(name, v - F.col("__q")[0]).drop("__q")
    joined = df.join(df.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s")), by)
    return joined.withColumn(name, (v - F.col("__m")) / F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)).drop("__m", "__s")


def complete(df: DataFrame, required: list[str]) -> DataFrame:
    """Rows without a null in those of the required columns that there are."""
    return df.dropna(subset=[c for c in required if c in df.columns])


def examples(df: DataFrame, dim: DataFrame, on: str, required: list[str], allowed: Column, group: str, key: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows of each group, by a seed, of those that are complete with what ``dim`` adds, and allowed."""
    return sampling.per_group(complete(df.join(dim, on, "left"), required).where(allowed), [group], key, n, seed)


def encode_texts(df: DataFrame, text: str, encoder, dimensions: int, name: str = "embedding") -> DataFrame:
    """Vectors of texts by a user's encoder (a function of a column, such as a pandas UDF); blank and null texts get zeros and
    are not given to it."""
    blank = F.coalesce(F.trim(F.col(text)) == "", F.lit(True))
    some = df.withColumn("__t", F.when(~blank, F.col(text)).otherwise(F.lit("")))
    zeros = F.array_repeat(F.lit(0.0), dimensions)
    return some.withColumn(name, F.when(blank, zeros).otherwise(encoder(F.col("__t")).cast("array<double>"))).drop("__t")


def flat_json(df: DataFrame, column: str, paths: dict[str, str]) -> DataFrame:
    """Fields of a nested JSON text as columns of texts, null where a path leads nowhere."""
    return df.withColumns({name: F.get_json_object(column, path) for name, path in paths.items()})


def averaged_on(reference: DataFrame, df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, order, value of the reference's keys: the mean of what there is, 0 where there is nothing."""
    means = df.groupBy(key).agg(F.avg(value).alias(value))
    return reference.select(key, order).join(means, key, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def status_grid(subjects: list[int], sessions: list[int], done: DataFrame) -> DataFrame:
    """One row for each subject and session: done, failed (with its message) or pending. ``done``: subject, session, error."""
    spark = done.sparkSession
    grid = spark.createDataFrame([(s,) for s in subjects], "subject long").crossJoin(spark.createDataFrame([(s,) for s in sessions], "session long"))  # two short lists
    last = done.groupBy("subject", "session").agg(F.max("error").alias("error"), F.lit(True).alias("__there"))
    status = F.when(F.col("__there").isNull(), "pending").when(F.col("error").isNotNull(), "failed").otherwise("done")
    return grid.join(last, ["subject", "session"], "left").select("subject", "session", status.alias("status"), "error")


def searchlight(patterns: DataFrame, neighbours: DataFrame, model: DataFrame, place: str, condition: str, value: str) -> DataFrame:
    """place, rho, n: of each place the rank correlation of the model's matrix with that of the patterns in its patch.
    ``patterns``: place, condition, value; ``neighbours``: place, other (itself among them); a place of fewer than two
    neighbours with values has none. One join by place, then one matrix for each."""
    patch = neighbours.join(patterns.select(F.col(place).alias("other"), condition, F.col(value).alias("__v")), "other")
    rows = patch.groupBy(place, condition).agg(F.transform(F.array_sort(F.collect_list(F.struct("other", "__v"))), lambda s: s["__v"]).alias("__x")).where(F.size("__x") > 1)
    return vectors.matrix_correlation(vectors.dissimilarity(rows, condition, "__x", [place]), model, [place])


def searchlight_null(patterns: DataFrame, neighbours: DataFrame, model: DataFrame, place: str, condition: str, value: str, draws: int = 30, seed: int = 0) -> DataFrame:
    """place, draw, rho: :func:`searchlight` with permuted models."""
    patch = neighbours.join(patterns.select(F.col(place).alias("other"), condition, F.col(value).alias("__v")), "other")
    rows = patch.groupBy(place, condition).agg(F.transform(F.array_sort(F.collect_list(F.struct("other", "__v"))), lambda s: s["__v"]).alias("__x")).where(F.size("__x") > 1)
    return matrices.permutation_null(vectors.dissimilarity(rows, condition, "__x", [place]), model, [place], draws, seed)


def ordered_matrix(matrix: DataFrame, places: DataFrame, key: str, place: str) -> DataFrame:
    """i_place, j_place, d of both triangles, conditions in the order of ``places`` (key, place)."""
    both = matrix.select("i", "j", "d").unionByName(matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    order = Window.partitionBy(F.lit(0)).orderBy(place, key)  # conditions of a matrix
    ranked = places.select(key, (F.row_number().over(order) - 1).alias("__k"))
    a, b = ranked.select(F.col(key).alias("i"), F.col("__k").alias("i_place")), ranked.select(F.col(key).alias("j"), F.col("__k").alias("j_place"))
    return both.join(a, "i").join(b, "j").select("i_place", "j_place", "d")


def agglomerate(matrix: DataFrame, k: int) -> DataFrame:
    """condition, cluster (from 1, by its smallest condition): average-linkage clustering of a matrix of conditions into k, on
    the driver (at most ``vectors.MOST_CONDITIONS`` conditions can have a matrix; this is for reports of a few hundred)."""
    import numpy as np

    rows = matrix.select("i", "j", "d").collect()
    names = sorted({r["i"] for r in rows} | {r["j"] for r in rows})
    at, d = {n: p for p, n in enumerate(names)}, np.full((len(names), len(names)), np.inf)
    for r in rows:
        d[at[r["i"]], at[r["j"]]] = d[at[r["j"]], at[r["i"]]] = r["d"]
    member, size = np.arange(len(names)), np.ones(len(names))
    for _ in range(len(names) - k):
        a, b = sorted(np.unravel_index(np.argmin(d), d.shape))
        d[a] = d[:, a] = (d[a] * size[a] + d[b] * size[b]) / (size[a] + size[b])
        d[b] = d[:, b] = d[a, a] = np.inf
        size[a] += size[b]
        member[member == b] = a
    number = {m: n for n, m in enumerate(dict.fromkeys(member.tolist()), 1)}
    kind = matrix.schema["i"].dataType.simpleString()
    return matrix.sparkSession.createDataFrame([(n, number[int(m)]) for n, m in zip(names, member, strict=True)], f"condition {kind}, cluster int")


def unmixed(samples: DataFrame, by: list[str], channels: str, weights: list[list[float]]) -> DataFrame:
    """Arrays of channels as components, by a given matrix (components x channels): an expression, narrow."""
    w = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in weights])
    return samples.withColumn(channels, F.transform(w, lambda row: vectors.dot(row, F.col(channels))))


def filtered(df: DataFrame, x: str, kernel: list[float]) -> DataFrame:
    """Traces convolved with a kernel of odd length (a finite impulse response), as long as they were; zeros beyond the ends."""
    half, taps = len(kernel) // 2, F.array(*[F.lit(float(v)) for v in kernel[::-1]])
    padded = F.concat(F.array_repeat(F.lit(0.0), half), F.col(x).cast("array<double>"), F.array_repeat(F.lit(0.0), half))
    return df.withColumn(x, F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: vectors.dot(F.slice(padded, i, len(kernel)), taps))).otherwise(F.col(x).cast("array<double>")))


def joined_runs(runs: DataFrame, by: list[str], run: str, time: str, length: DataFrame) -> DataFrame:
    """Times of runs that follow each other as one recording: each run's times plus the lengths of those before it.
    ``length``: by, run, seconds."""
    w = Window.partitionBy(*by).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    before = length.select(*by, run, F.coalesce(F.sum("seconds").over(w), F.lit(0.0)).alias("__before"))
    return runs.join(before, [*by, run]).withColumn(time, F.col(time) + F.col("__before")).drop("__before")

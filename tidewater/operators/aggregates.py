"""Grouped statistics: dense grids, two levels, shares, bins, ordered lists, elementwise medians of arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles, with_quantiles


#: Values that a label may have to be laid out in a grid.
MOST_LABELS = 10_000


def domain(df: DataFrame, keys: list[str], given: DataFrame | None = None) -> DataFrame:
    """All combinations of the values of ``keys``. All but the first are labels: more than ``MOST_LABELS`` of one are an
    error, so the grid grows with the first key alone. ``given``: values of the last key, instead of those in the rows."""
    out = None
    for k in keys:
        values = df.select(k).distinct() if given is None or k != keys[-1] else given.select(k)
        if out is None:
            out = values
            continue
        if values.limit(MOST_LABELS + 1).count() > MOST_LABELS:
            raise ValueError(f"{k} has over {MOST_LABELS} values: no label to lay out in a grid")
        out = out.crossJoin(F.broadcast(values))
    return out


def dense_counts(df: DataFrame, keys: list[str], given: DataFrame | None = None) -> DataFrame:
    """Counts over the full grid of ``keys``, zeros kept."""
    return domain(df, keys, given).join(df.groupBy(*keys).agg(F.count("*").alias("n")), keys, "left").fillna({"n": 0})


def top_dense_counts(df: DataFrame, by: str, label: str, k: int, without: list[str] | None = None) -> DataFrame:
    """Counts of the k labels that are most frequent overall, for every ``by``, zeros kept."""
    some = top_labels(df, label, k, without).select(label)
    return dense_counts(df, [by, label], some)


def label_report(df: DataFrame, by: list[str], label: str, nothing: str = "None", outside: str = "outside") -> DataFrame:
    """By group: rows, labelled ones, those of nothing and outside, their shares in percent, and distinct labels."""
    c = F.col(label)
    told = ~c.isin(nothing, outside)
    n = F.count("*")
    counts = {"labelled": F.count_if(told), "nothing": F.count_if(c == nothing), "outside": F.count_if(c == outside)}
    shares_ = {f"{k}_percent": 100 * v / n for k, v in counts.items()}
    return df.groupBy(*by).agg(n.alias("n"), *[v.alias(k) for k, v in (counts | shares_).items()], F.count_distinct(F.when(told, c)).alias("labels"))


def first_and_later(df: DataFrame, position: str, label: str, k: int) -> DataFrame:
    """Shares in percent of the labels that are among the k most frequent at position 0 or later, in both."""
    first, later = df.where(F.col(position) == 0), df.where(F.col(position) > 0)
    some = top_labels(first, label, k).select(label).union(top_labels(later, label, k).select(label)).distinct()
    counts = df.groupBy(label).agg(F.count_if(F.col(position) == 0).alias("__a"), F.count_if(F.col(position) > 0).alias("__b"))
    total = counts.agg(F.sum("__a").alias("__ta"), F.sum("__b").alias("__tb"))
    return counts.join(some, label, "left_semi").crossJoin(F.broadcast(total)).select(label, (100 * F.col("__a") / F.col("__ta")).alias("first"), (100 * F.col("__b") / F.col("__tb")).alias("later"))


def first_known(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Of each column the first value of the group that is not null, in order."""
    return df.groupBy(*by).agg(*[F.min(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("__v"))))["__v"].alias(c) for c in columns])


def fractions(df: DataFrame, by: list[str], label: str, labels: list[str]) -> DataFrame:
    """Share of each of the labels in its group's rows."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg((F.col(label) == v).cast("double")).alias(v) for v in labels])


def flags(df: DataFrame, checks: dict[str, Column], name: str = "flags") -> DataFrame:
    """The names of the checks that hold, comma-joined; 'none' where none does."""
    text = F.concat_ws(",", *[F.when(c, F.lit(k)) for k, c in checks.items()])
    return df.withColumn(name, F.when(text == "", "none").otherwise(text))


def distribution(df: DataFrame, value: str, points: list[float]) -> DataFrame:
    """point, share: the empirical distribution function at the given points."""
    n = F.count(value)
    row = df.agg(F.array(*[F.struct(F.lit(p).alias("point"), (F.count_if(F.col(value) <= p) / n).alias("share")) for p in points]).alias("__d"))
    return row.select(F.inline("__d"))


def two_level(df: DataFrame, keys: list[str], over: str) -> DataFrame:
    """Counts by (keys, over), then their mean, sd, standard error, least and most over ``over``; absent groups are no
    zeros."""
    counts = df.groupBy(*keys, over).agg(F.count("*").alias("c"))
    sd = F.stddev_samp("c")
    return counts.groupBy(*keys).agg(F.count("*").alias("groups"), F.avg("c").alias("mean"), sd.alias("sd"), (sd / F.sqrt(F.count("*"))).alias("sem"), F.min("c").alias("least"), F.max("c").alias("most"))


def shares(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """n and share in percent of each label in its group."""
    n = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    total = n.groupBy(*by).agg(F.sum("n").alias("__total")) if by else n.agg(F.sum("n").alias("__total"))
    joined = n.join(total, by) if by else n.crossJoin(total)
    return joined.withColumn("percent", 100 * F.col("n") / F.col("__total")).drop("__total")


def top_labels(df: DataFrame, label: str, k: int, without: list[str] | None = None) -> DataFrame:
    """The k most frequent labels, ties by name."""
    kept = df if not without else df.where(~F.col(label).isin(without))
    return kept.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(k)


def ordered_lists(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """For each group the values of each column in order, and the first of them."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order])))  # the list is what is asked for
    listed = df.groupBy(*by).agg(rows.alias("__rows"))
    return listed.select(*by, *[F.col("__rows")[c].alias(f"{c}_list") for c in columns], *[F.col("__rows")[0][c].alias(f"{c}_first") for c in columns])


def regressions(df: DataFrame, by: list[str], x: Column, y: Column, least: int = 10) -> DataFrame:
    """Least-squares line of y on x and their correlation, of groups of ``least`` rows or more."""
    rows = df.withColumns({"__x": x, "__y": y}).where("__x is not null and __y is not null")
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope("__y", "__x").alias("slope"), F.regr_intercept("__y", "__x").alias("intercept"), F.corr("__x", "__y").alias("r"))
    return out.where(F.col("n") >= least)


def quantile_bins(df: DataFrame, value: str, n: int, name: str = "bin") -> DataFrame:
    """bin from 0 to n - 1: how many of the n - 1 inner quantiles are not above the value. Edges are one row."""
    edges = exact_quantiles(df, value, [i / n for i in range(1, n)]).select(F.col("__q").alias("__edges"))
    return df.crossJoin(F.broadcast(edges)).withColumn(name, F.size(F.filter("__edges", lambda e: e <= F.col(value)))).drop("__edges")


def binned_means(df: DataFrame, x: str, y: str, bins: int = 20, least: int = 3) -> DataFrame:
    """Mean of y in equal-width bins of x between its 1st and 99th percentile, clipped."""
    edge = exact_quantiles(df, x, [0.01, 0.99]).select(F.col("__q").alias("__e"))
    low, high = F.col("__e")[0], F.col("__e")[1]
    at = F.least(F.greatest(F.floor((F.col(x) - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1))
    return df.crossJoin(F.broadcast(edge)).withColumn("bin", at.cast("long")).groupBy("bin").agg(F.count("*").alias("n"), F.avg(y).alias("mean")).where(F.col("n") >= least)


def elementwise_median(df: DataFrame, by: list[str], array: str, least: int = 1, domain: DataFrame | None = None) -> DataFrame:
    """Median of the arrays of each group, element by element; groups of fewer than ``least`` arrays are left out, or with a
    ``domain`` (the keys that are to be there) have a null."""
    parts = df.select(*by, F.posexplode(array).alias("pos", "x"))
    med = exact_quantiles(parts, "x", [0.5], [*by, "pos"], count="n").select(*by, "pos", F.col("__q")[0].alias("m"), "n").where(F.col("n") >= least)
    out = med.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias(array), F.max("n").alias("n"))
    return out if domain is None else domain.select(*by).join(out, by, "left")


def quantile_bin_arrays(df: DataFrame, value: str, array: str, n: int) -> DataFrame:
    """bin, the elementwise median of its arrays, its number of rows and its median value."""
    binned = quantile_bins(df, value, n)
    rows = binned.groupBy("bin").agg(F.count("*").alias("rows"))
    medians = exact_quantiles(binned, value, [0.5], ["bin"]).select("bin", F.col("__q")[0].alias("median"))
    return elementwise_median(binned, ["bin"], array).drop("n").join(rows, "bin").join(medians, "bin", "left")


def elementwise_mean(df: DataFrame, by: list[str], array: str) -> DataFrame:
    parts = df.select(*by, F.posexplode(array).alias("pos", "x"))
    sd = F.stddev_pop("x")
    return parts.groupBy(*by, "pos").agg(F.avg("x").alias("mean"), sd.alias("sd"), (sd / F.sqrt(F.count("x"))).alias("sem"), F.count("x").alias("n"))


def histogram2d(df: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float], bins: int = 50) -> DataFrame:
    """Counts in equal-width cells; the upper end belongs to the last cell; values outside are left out."""
    cell = lambda c, r: F.least(F.floor((F.col(c) - r[0]) / (r[1] - r[0]) * bins), F.lit(bins - 1)).cast("long")
    inside = df.where(F.col(x).between(*x_range) & F.col(y).between(*y_range))
    return inside.groupBy(cell(x, x_range).alias("bx"), cell(y, y_range).alias("by")).agg(F.count("*").alias("n"))


def smoothed(histogram: DataFrame, sigma: float, reach: int | None = None) -> DataFrame:
    """bx, by, density: a 2-D histogram blurred by a Gaussian (cut at ``reach`` cells, 3 sigma, without borders)."""
    import math

    reach = reach or math.ceil(3 * sigma)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    total = sum(w)
    kernel = F.explode(F.array(*[F.struct(F.lit(k).alias("d"), F.lit(v / total).alias("w")) for k, v in zip(range(-reach, reach + 1), w, strict=True)]))
    out = histogram.select("bx", "by", F.col("n").cast("double").alias("v"))
    for axis, other in (("bx", "by"), ("by", "bx")):
        moved = out.withColumn("__k", kernel).select((F.col(axis) + F.col("__k.d")).alias(axis), other, (F.col("v") * F.col("__k.w")).alias("v"))
        out = moved.groupBy(axis, other).agg(F.sum("v").alias("v"))
    return out.select("bx", "by", F.col("v").alias("density"))


def pivoted(df: DataFrame, row: str, col: str, value: str, columns: list) -> DataFrame:
    """One row for each ``row``, one column for each of ``columns``; two values of one cell are an error when it is read."""
    one = F.when(F.count("*") > 1, F.raise_error(F.lit(f"two values of one ({row}, {col})"))).otherwise(F.min(value))
    cells = df.groupBy(row, col).agg(one.alias("__v"))
    return cells.groupBy(row).pivot(col, columns).agg(F.min("__v"))


def quality_report(df: DataFrame, required: list[str], enums: dict[str, list[str]], key: list[str], ordered: tuple[str, str] | None = None) -> DataFrame:
    """One row for each check, with how many rows fail it: nulls, unknown values, rows whose begin (``ordered``) is not
    before their end, rows beyond the first of a key, columns that are missing."""
    checks = {f"null_{c}": F.count_if(F.col(c).isNull()) for c in required if c in df.columns}
    checks |= {f"unknown_{c}": F.count_if(~F.col(c).isin(v)) for c, v in enums.items()}
    if ordered:
        checks["not_before_end"] = F.count_if(F.col(ordered[0]) >= F.col(ordered[1]))
    one = df.agg(*[v.alias(k) for k, v in checks.items()]).unpivot([], list(checks), "check", "n")
    twice = df.groupBy(*key).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n")).select(F.lit("duplicate_key").alias("check"), "n")
    missing = [c for c in required if c not in df.columns]
    out = one.unionByName(twice)
    return out.unionByName(df.sparkSession.createDataFrame([(f"missing_{c}", 1) for c in missing], "check string, n long")) if missing else out


def percentile_filter(df: DataFrame, by: list[str], value: str, p: float) -> DataFrame:
    """Rows up to their group's exact percentile (without ``by``: the table's); nulls go."""
    return with_quantiles(df, value, [p], by).where(F.col(value) <= F.col("__q")[0]).drop("__q")


def last_winner(df: DataFrame, by: list[str], label: str, value: str, ties: list[str] | None = None) -> DataFrame:
    """The label of the greatest value of each group (ties: the smallest label)."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), label, *(ties or [])))
    return df.withColumn("__p", place).where("__p = 1").drop("__p")

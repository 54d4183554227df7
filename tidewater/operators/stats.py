"""Tests, intervals and corrections over groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import aggregates
from .quantiles import exact_quantiles, with_quantiles


def chi_square(df: DataFrame, row: str, col: str) -> DataFrame:
    """chi2 and degrees of freedom of independence. The table of counts has all combinations of labels: more than
    ``aggregates.MOST_LABELS`` of ``col`` are an error."""
    n = df.groupBy(row, col).agg(F.count("*").alias("n"))
    grid = aggregates.domain(n, [row, col]).join(n, [row, col], "left").fillna({"n": 0})
    everything = Window.partitionBy(F.lit(0))
    expected = F.sum("n").over(Window.partitionBy(row)) * F.sum("n").over(Window.partitionBy(col)) / F.sum("n").over(everything)
    return grid.withColumn("e", expected).agg(F.sum((F.col("n") - F.col("e")) ** 2 / F.col("e")).alias("chi2"), ((F.count_distinct(row) - 1) * (F.count_distinct(col) - 1)).alias("df"))


def t_test(df: DataFrame, by: list[str], value: str, mean: float = 0.0) -> DataFrame:
    """One-sample t statistic by group; null where the standard deviation is 0 or n is 1."""
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return out.withColumn("t", F.when(F.col("sd") > 0, (F.col("mean") - mean) / (F.col("sd") / F.sqrt("n"))))


def false_discovery(df: DataFrame, p: str, key: list[str], by: list[str] | None = None) -> DataFrame:
    """q: Benjamini-Hochberg adjusted p. Without ``by`` the table of tests is one family (its tests are ordered together:
    a family is a table of results, not of data)."""
    part = by or [F.lit(0)]
    w = Window.partitionBy(*part)
    m = df.withColumn("__raw", F.col(p) * F.count("*").over(w) / F.row_number().over(w.orderBy(p, *key)))
    return m.withColumn("q", F.least(F.min("__raw").over(w.orderBy(F.desc(p), *[F.desc(k) for k in key]).rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))).drop("__raw")


#: Cumulative shares of the Poisson distribution of mean 1: the weights that resampling gives a row.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)


def resampled_means(df: DataFrame, by: list[str], value: str, key: list[str], draws: int = 200, seed: int = 0) -> DataFrame:
    """by, draw, mean: means under seeded Poisson weights, one for each row (``key``) and draw. Rows are weighed where they
    are and summed with partial sums, so a group of any size is no one task's work."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "draw", *[F.col(k).cast("string") for k in key])), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in POISSON), F.lit(0))
    drawn = df.where(F.col(value).isNotNull()).select(*by, *key, F.col(value).cast("double").alias("__x"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("__w", weight)
    sums = drawn.groupBy(*by, "draw").agg(F.sum(F.col("__x") * F.col("__w")).alias("__s"), F.sum("__w").alias("__n"))
    return sums.where("__n > 0").select(*by, "draw", (F.col("__s") / F.col("__n")).alias("mean"))


def bootstrap_mean(df: DataFrame, by: list[str], value: str, key: list[str], draws: int = 200, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Percentile bootstrap interval of the mean by group: n, mean, low, high."""
    half = (1 - level) / 2
    q = F.percentile("mean", F.array(F.lit(half), F.lit(1 - half)))
    ends = resampled_means(df, by, value, key, draws, seed).groupBy(*by).agg(q.alias("__q"))  # ``draws`` values a group
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean")).join(ends, by, "left")
    return out.select(*by, "n", "mean", F.col("__q")[0].alias("low"), F.col("__q")[1].alias("high"))


def bootstrap_bca(df: DataFrame, by: list[str], value: str, key: list[str], draws: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Bias-corrected and accelerated interval of the mean by group: n, mean, low, high (both the mean where all rows are
    equal). The acceleration of a mean is its skewness / (6 sqrt(n)); the bias is the share of draws below the mean."""
    from statistics import NormalDist

    import numpy as np

    means = resampled_means(df, by, value, key, draws, seed).groupBy(*by).agg(F.sort_array(F.collect_list("mean")).alias("draws"))  # ``draws`` values a group
    stats = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.skewness(value).alias("skew")).join(means, by, "left")
    normal = NormalDist()

    def ends(mean: float, skew: float, n: int, drawn: list) -> tuple[float | None, float | None]:
        if mean is None or drawn is None or not len(drawn):
            return mean, mean
        x = np.asarray(drawn, float)
        if skew is None or skew != skew or x[0] == x[-1]:
            return mean, mean
        below = min(max(((x < mean).sum() + 0.5 * (x == mean).sum()) / len(x), 0.5 / len(x)), 1 - 0.5 / len(x))
        z0, a = normal.inv_cdf(float(below)), skew / (6 * n**0.5)
        out = []
        for z in (normal.inv_cdf((1 - level) / 2), normal.inv_cdf((1 + level) / 2)):
            out.append(float(np.percentile(x, 100 * normal.cdf(z0 + (z0 + z) / (1 - a * (z0 + z))))))
        return tuple(out)

    def run(batches):
        for rows in batches:
            rows[["low", "high"]] = [ends(*r) for r in zip(rows["mean"], rows["skew"], rows["n"], rows["draws"], strict=True)]
            yield rows.drop(columns=["skew", "draws"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    return stats.mapInPandas(run, f"{kinds}, n long, mean double, low double, high double")


def significant(df: DataFrame, category: str, subject: str, value: str, chance: float, least: int = 4, draws: int = 1000, seed: int = 0) -> DataFrame:
    """Rows of the categories with ``least`` subjects or more whose bootstrap interval leaves out ``chance``."""
    kept = bootstrap_mean(df, [category], value, [subject], draws, seed).where((F.col("low") > chance) | (F.col("high") < chance))
    enough = df.groupBy(category).agg(F.count_distinct(subject).alias("__n")).where(F.col("__n") >= least)
    return df.join(kept.select(category), category, "left_semi").join(enough.select(category), category, "left_semi")


def chi_square_tail(chi2: float, df: int) -> float:
    """P(X >= chi2) with ``df`` degrees of freedom: the upper incomplete gamma function, by series or continued fraction."""
    import math

    a, x = df / 2, chi2 / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        k = -i * (i - a)
        b += 2
        d, c = 1 / (k * d + b), b + k / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi_square_test(df: DataFrame, row: str, col: str) -> DataFrame:
    """chi2, df and p of independence."""
    found = chi_square(df, row, col)

    def run(batches):
        for rows in batches:
            rows["p"] = [chi_square_tail(float(c), int(d)) if c == c and d > 0 else None for c, d in zip(rows["chi2"].fillna(float("nan")), rows["df"], strict=True)]
            yield rows

    return found.select("chi2", F.col("df").cast("long").alias("df")).mapInPandas(run, "chi2 double, df long, p double")


def clustered_regression(df: DataFrame, y: str, xs: list[str], cluster: str) -> DataFrame:
    """term (intercept first), coef, se: least squares with errors that are clustered (sandwich, with the usual factor for
    few clusters). Two passes of partial sums; only terms x terms numbers go to the driver."""
    import numpy as np

    rows = df.select(cluster, F.col(y).cast("double").alias("__y"), *[F.col(x).cast("double").alias(x) for x in xs]).dropna(subset=["__y", *xs])
    terms, k = [F.lit(1.0), *map(F.col, xs)], len(xs) + 1
    sums = rows.agg(F.count("*"), F.array(*[F.sum(a * b) for a in terms for b in terms]), F.array(*[F.sum(a * F.col("__y")) for a in terms])).first()
    n, inverse = sums[0], np.linalg.inv(np.array(sums[1]).reshape(k, k))
    beta = inverse @ np.array(sums[2])
    left = F.col("__y") - sum((F.lit(float(b)) * t for b, t in zip(beta, terms, strict=True)), F.lit(0.0))
    scores = rows.groupBy(cluster).agg(*[F.sum(t * left).alias(f"__s{i}") for i, t in enumerate(terms)])
    got = scores.agg(F.count("*"), F.array(*[F.sum(F.col(f"__s{i}") * F.col(f"__s{j}")) for i in range(k) for j in range(k)])).first()
    cov = inverse @ np.array(got[1]).reshape(k, k) @ inverse * (got[0] / (got[0] - 1)) * ((n - 1) / (n - k))
    out = [(t, float(b), float(v**0.5)) for t, b, v in zip(["intercept", *xs], beta, np.diag(cov), strict=True)]
    return df.sparkSession.createDataFrame(out, "term string, coef double, se double")


def typical(df: DataFrame, key: str, array: str, amplitude: float = 0.99, likeness: float = 0.01) -> DataFrame:
    """Rows without the two kinds of outliers: first those whose greatest absolute element is not below the ``amplitude``
    quantile; of the rest those whose correlation with the elementwise median is not above the ``likeness`` quantile."""
    from . import vectors

    sized = df.withColumn("__amp", F.array_max(F.transform(array, F.abs)).cast("double"))
    kept = with_quantiles(sized, "__amp", [amplitude]).where(F.col("__amp") < F.col("__q")[0]).drop("__amp", "__q")
    parts = exact_quantiles(kept.select(F.posexplode(array).alias("__pos", "__v")), "__v", [0.5], ["__pos"]).select("__pos", F.col("__q")[0].alias("__v"))
    middle = parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__v"))), lambda s: s["__v"]).alias("__middle"))  # one pattern
    like = kept.crossJoin(F.broadcast(middle)).withColumn("__r", vectors.correlation(F.col(array), F.col("__middle")))
    return with_quantiles(like, "__r", [likeness]).where(F.col("__r") > F.col("__q")[0]).select(df.columns)

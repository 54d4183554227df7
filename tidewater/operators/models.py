"""Encoding, decoding and clustering models over rows with feature arrays. Folds are a column; rows of a group share one.

Linear models are fitted from sums of products that tasks add up, so rows are read in place and only features x features
(and features x targets) numbers come together; classifiers and clusterings are those of Spark's own library.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import shared
from . import aggregates, matrices, vectors
from .quantiles import exact_quantiles

ALPHAS = (1e-2, 1e-1, 1.0, 1e1, 1e2, 1e3)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def moments(df: DataFrame, x: str, y: str, fold: str) -> list[dict]:
    """Of each fold: n, sums and sums of products of [1, x, y], as matrices (folds x (features + targets) squared numbers)."""
    first = df.select(F.size(x), F.size(y)).first()
    if first is None:
        return []
    p, q = first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            folds = batch.column(0).to_numpy(zero_copy_only=False)
            z = np.concatenate([np.ones((len(folds), 1)), _matrix(batch.column(1), p), _matrix(batch.column(2), q)], 1)
            for f in np.unique(folds):
                some = z[folds == f]
                total[int(f)] = total.get(int(f), 0) + some[:, : 1 + p].T @ some
                total[int(f), "yy"] = total.get((int(f), "yy"), 0) + (some[:, 1 + p :] ** 2).sum(0)
        names = [f for f in total if isinstance(f, int)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([total[f].ravel() for f in names], pa.list_(pa.float64())), pa.array([total[f, "yy"] for f in names], pa.list_(pa.float64()))], names=["fold", "xz", "yy"])

    parts = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(fold).cast("int").alias("fold"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y")).mapInArrow(run, "fold int, xz array<double>, yy array<double>")
    add = lambda c, n: F.array(*[F.sum(F.get(c, F.lit(k))) for k in range(n)]) if n <= 256 else None
    width = (1 + p) * (1 + p + q)
    if width <= 256:
        got = parts.groupBy("fold").agg(add("xz", width).alias("xz"), add("yy", q).alias("yy")).orderBy("fold").collect()
    else:  # long sums: by place
        of = lambda c: parts.select("fold", F.posexplode(c).alias("k", "v")).groupBy("fold", "k").agg(F.sum("v").alias("v")).groupBy("fold").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias(c))
        got = of("xz").join(of("yy"), "fold").orderBy("fold").select("fold", "xz", "yy").collect()
    return [{"fold": r["fold"], "xz": np.array(r["xz"]).reshape(1 + p, 1 + p + q), "yy": np.array(r["yy"]), "p": p} for r in got]


def ridge(xz: np.ndarray, alpha: float, standardise: bool = True) -> np.ndarray:
    """Coefficients (1 + features, targets) on features that are scaled to unit variance (``standardise``) or as they are; the
    intercept is not shrunk."""
    p = xz.shape[0] - 1
    n, mean_x, mean_y = xz[0, 0], xz[0, 1 : p + 1] / xz[0, 0], xz[0, p + 1 :] / xz[0, 0]
    cov = xz[1:, 1 : p + 1] - n * np.outer(mean_x, mean_x)
    cross = xz[1:, p + 1 :] - n * np.outer(mean_x, mean_y)
    scale = np.sqrt(np.maximum(np.diag(cov) / n, 0))
    scale[(scale == 0) | (not standardise)] = 1
    w = np.linalg.solve(cov / np.outer(scale, scale) + alpha * np.eye(p), cross / scale[:, None]) / scale[:, None]
    return np.concatenate([(mean_y - mean_x @ w)[None], w])


def _fit_quality(w: np.ndarray, held: dict) -> tuple[np.ndarray, np.ndarray]:
    """Correlation and R squared of each target's predictions on held-out sums."""
    xz, yy, p = held["xz"], held["yy"], held["p"]
    n, sy = xz[0, 0], xz[0, p + 1 :]
    sp, spy = xz[0, : p + 1] @ w, (xz[:, p + 1 :] * w).sum(0)
    spp = np.einsum("iq,ij,jq->q", w, xz[:, : p + 1], w)
    var_p, var_y = spp - sp * sp / n, yy - sy * sy / n
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (spy - sp * sy / n) / np.sqrt(np.maximum(var_p, 0) * np.maximum(var_y, 0))
        r2 = 1 - (yy - 2 * spy + spp) / var_y
    return np.where(np.isfinite(r), r, 0.0), np.where(np.isfinite(r2), r2, 0.0)


def encode(df: DataFrame, x: str, y: str, fold: str, test_fold: int, alphas: tuple[float, ...] = ALPHAS, standardise: bool = True) -> DataFrame:
    """target (place in y), alpha, r, r2 on the test fold. alpha is chosen for each target by the mean R squared over the
    other folds, each held out once."""
    sums = moments(df, x, y, fold)
    train, test = [m for m in sums if m["fold"] != test_fold], [m for m in sums if m["fold"] == test_fold]
    if len(train) < 2 or not test:
        raise ValueError("a test fold and two others at least are needed")
    score = np.array([np.mean([_fit_quality(ridge(sum(m["xz"] for m in train if m is not held), a, standardise), held)[1] for held in train], 0) for a in alphas])
    best, everything = score.argmax(0), sum(m["xz"] for m in train)
    out = []
    for k, a in enumerate(alphas):
        w = ridge(everything, a, standardise)
        r, r2 = _fit_quality(w, test[0])
        out += [(int(t), float(a), float(r[t]), float(r2[t])) for t in np.flatnonzero(best == k)]
    return df.sparkSession.createDataFrame(sorted(out), "target int, alpha double, r double, r2 double")


def principal_axes(df: DataFrame, x: str, share: float = 0.7) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and the axes (rows) that hold ``share`` of the variance, from sums of products (features squared numbers)."""
    (m,) = moments(df.select(F.lit(0).alias("f"), x, F.array(F.lit(0.0)).alias("y")), x, "y", "f")
    p = m["p"]
    n, mean = m["xz"][0, 0], m["xz"][0, 1 : p + 1] / m["xz"][0, 0]
    values, basis = np.linalg.eigh(m["xz"][1:, 1 : p + 1] / n - np.outer(mean, mean))
    order = np.argsort(-values)
    k = int(np.searchsorted(np.cumsum(values[order]) / max(values.sum(), 1e-300), share) + 1)
    axes = basis[:, order[:k]].T
    return mean, axes * np.where(axes[np.arange(k), np.abs(axes).argmax(1)] < 0, -1, 1)[:, None]


def projected(x: Column, mean: np.ndarray, axes: np.ndarray) -> Column:
    """x on the axes, as an expression."""
    row = lambda v: F.array(*[F.lit(float(a)) for a in v])
    centred = F.zip_with(x.cast("array<double>"), row(mean), lambda a, b: a - b)
    return F.transform(F.array(*[row(a) for a in axes]), lambda a: vectors.dot(a, centred))


def decode(df: DataFrame, x: str, label: str, fold: str, key: list[str], steps: int = 50, one_vs_rest: bool = False) -> DataFrame:
    """key, label, predicted: each row by a logistic classifier of the other folds, softmax or a machine for each label
    against the rest, of which the surest wins. ``label``: whole numbers from 0."""
    from pyspark.ml.classification import LogisticRegression, OneVsRest
    from pyspark.ml.functions import array_to_vector

    rows = df.select(*key, F.col(label).cast("double").alias("__y"), F.col(fold).alias("__f"), array_to_vector(F.col(x).cast("array<double>")).alias("__x"))
    out = None
    for f in sorted(r[0] for r in rows.select("__f").distinct().collect()):  # folds: a few
        machine = LogisticRegression(featuresCol="__x", labelCol="__y", predictionCol="__p", maxIter=steps, regParam=1e-3)
        machine = OneVsRest(classifier=machine, featuresCol="__x", labelCol="__y", predictionCol="__p") if one_vs_rest else machine
        model = machine.fit(rows.where(F.col("__f") != f))
        got = model.transform(rows.where(F.col("__f") == f)).select(*key, F.col("__y").cast("int").alias(label), F.col("__p").cast("int").alias("predicted"))
        out = got if out is None else out.unionByName(got)
    return out


def balanced_accuracy(predictions: DataFrame, label: str, predicted: str = "predicted") -> DataFrame:
    """By label (``aggregates.MOST_LABELS`` at most), against all others: n, recall, specificity, their mean, and that less 1/2 in percent."""
    domain = predictions.select(F.col(label).alias("__c")).distinct()
    if domain.limit(aggregates.MOST_LABELS + 1).count() > aggregates.MOST_LABELS:
        raise ValueError(f"{label} has over {aggregates.MOST_LABELS} values")
    cells = predictions.groupBy(label, predicted).agg(F.count("*").alias("n"))  # labels squared
    of = cells.crossJoin(F.broadcast(domain))
    is_c, says_c = F.col(label) == F.col("__c"), F.col(predicted) == F.col("__c")
    share = lambda top, all_: F.coalesce(F.sum(F.when(top, F.col("n"))), F.lit(0)) / F.sum(F.when(all_, F.col("n")))
    out = of.groupBy("__c").agg(F.sum(F.when(is_c, F.col("n"))).alias("n"), share(is_c & says_c, is_c).alias("recall"), share(~is_c & ~says_c, ~is_c).alias("specificity"))
    both = (F.col("recall") + F.coalesce("specificity", "recall")) / 2
    return out.select(F.col("__c").alias(label), "n", "recall", "specificity", both.alias("balanced_accuracy"), (100 * both - 50).alias("above_chance"))


def macro_accuracy(predictions: DataFrame, label: str, predicted: str = "predicted") -> DataFrame:
    """One row: the mean over labels of the share of their rows that is told right."""
    each = predictions.groupBy(label).agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("__a"))
    return each.agg(F.avg("__a").alias("macro_accuracy"))


def learning_curve(df: DataFrame, x: str, label: str, fold: str, key: list[str], sizes: list[int], seed: int = 0) -> DataFrame:
    """size, macro_accuracy of :func:`decode` on ``size`` rows of each label (all, if fewer), chosen by a seed."""
    from . import sampling

    out = None
    for n in sizes:
        some = sampling.per_group(df, [label], key, n, seed)
        got = macro_accuracy(decode(some, x, label, fold, key), label).select(F.lit(n).alias("size"), "macro_accuracy")
        out = got if out is None else out.unionByName(got)
    return out


def nearest_centre(x: Column, centres: list[np.ndarray]) -> Column:
    """Number of the centre that is nearest (ties: the first)."""
    far = F.transform(F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres]), lambda c: vectors.euclidean(x, c))
    return (F.array_position(far, F.array_min(far)) - 1).cast("int")


def select_clusters(df: DataFrame, x: str, split: str, key: list[str], ks: list[int], seed: int = 0) -> DataFrame:
    """k, silhouette, best: k-means on the rows outside of each split, silhouettes of those inside among each other, each with
    the clusters of its nearest centres; mean over a row's splits, median over rows; the greatest wins (ties: the smallest k)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select(*key, split, F.col(x).cast("array<double>").alias("__a")).withColumn("__x", array_to_vector("__a"))
    out, names = None, {f"__c{k}": k for k in ks}
    for s in sorted(r[0] for r in rows.select(split).distinct().collect()):  # splits: a few
        outside = rows.where(F.col(split) != s)
        centres = {name: KMeans(featuresCol="__x", k=k, seed=seed).fit(outside).clusterCenters() for name, k in names.items()}
        inside = rows.where(F.col(split) == s).select(*key, split, "__a", *[nearest_centre(F.col("__a"), c).alias(name) for name, c in centres.items()])
        out = inside if out is None else out.unionByName(inside)
    told = matrices.silhouettes_of_each(out, key, "__a", list(names), [split])
    path = shared.folder(df.sparkSession, "silhouettes")  # all pairs: taken once, then read again and again
    told.groupBy(*key, F.substring("clustering", 4, 10).cast("int").alias("k")).agg(F.avg("silhouette").alias("__s")).write.parquet(path)
    middle = exact_quantiles(df.sparkSession.read.parquet(path), "__s", [0.5], ["k"])
    each = middle.select("k", F.col("__q")[0].alias("silhouette"))
    best = each.agg(F.max(F.struct("silhouette", (-F.col("k")).alias("k"))).alias("__b")).select((-F.col("__b.k")).alias("__k"))
    return each.crossJoin(F.broadcast(best)).select("k", "silhouette", (F.col("k") == F.col("__k")).alias("best"))

"""Similarity of vectors, dissimilarity matrices of conditions and rank statistics on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def total(a: Column) -> Column:
    return F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def correlation(a: Column, b: Column) -> Column:
    n = F.size(a)
    cov = dot(a, b) - total(a) * total(b) / n
    var = lambda x: dot(x, x) - total(x) * total(x) / n
    return cov / F.sqrt(var(a) * var(b))


def euclidean(a: Column, b: Column) -> Column:
    d = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x - y)
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))


#: Conditions for which all pairs are laid out: a matrix of more is no result to look at.
MOST_CONDITIONS = 20_000
#: Vectors of a group whose pairs are summed up.
MOST_OF_GROUP = 2_000


def few_of_group(df: DataFrame, by: list[str], most: int) -> None:
    """ValueError where a group has over ``most`` rows: all pairs of them are no result to ask for. Counted before pairs are made."""
    if not df.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > most).isEmpty():
        raise ValueError(f"over {most} rows of one {', '.join(by) or 'matrix'}: all pairs of them are no result to ask for")


def dissimilarity(conditions: DataFrame, key: str, array: str, by: list[str] | None = None, metric: str = "correlation", domain: DataFrame | None = None) -> DataFrame:
    """by, i < j, d over a table of conditions (one row each, for each of ``by``: a matrix is asked for). ``metric``:
    correlation (1 - r) or euclidean. ``domain`` (i, j of all pairs that are to be there): pairs without vectors have d
    null. More than ``MOST_CONDITIONS`` conditions of one matrix are an error."""
    by = by or []
    few_of_group(conditions, by, MOST_CONDITIONS)
    a = conditions.select(*by, F.col(key).alias("i"), F.col(array).alias("__a"))
    b = conditions.select(*by, F.col(key).alias("j"), F.col(array).alias("__b"))
    x, y = F.col("__a"), F.col("__b")
    d = 1 - correlation(x, y) if metric == "correlation" else euclidean(x, y)
    joined = a.join(b, by).where("i < j") if by else a.join(b, F.col("i") < F.col("j"))
    out = joined.select(*by, "i", "j", d.alias("d"))
    if domain is None:
        return out
    full = domain.select("i", "j") if not by else conditions.select(*by).distinct().crossJoin(domain.select("i", "j"))  # a matrix' pairs, for each matrix
    return full.join(out, [*by, "i", "j"], "left")


def whitened(conditions: DataFrame, rows: DataFrame, array: str, ridge: float = 1e-6) -> DataFrame:
    """Conditions whose Euclidean distances are Mahalanobis distances under the covariance of ``rows`` (dimension x
    dimension sums, the only thing that goes to the driver; ``ridge`` times the mean variance is added to the diagonal)."""
    import numpy as np

    d = len(rows.select(array).where(F.col(array).isNotNull()).first()[0])
    x = [F.get(F.col(array), F.lit(k)).cast("double") for k in range(d)]
    sums = rows.where(F.col(array).isNotNull()).agg(F.count("*"), F.array(*[F.sum(v) for v in x]), F.array(*[F.sum(x[i] * x[j]) for i in range(d) for j in range(i, d)])).first()
    n, total_, cross = sums[0], np.array(sums[1]), np.zeros((d, d))
    cross[np.triu_indices(d)] = sums[2]
    cross = cross + np.triu(cross, 1).T
    cov = (cross - np.outer(total_, total_) / n) / (n - 1)
    values, basis = np.linalg.eigh(cov + ridge * np.trace(cov) / d * np.eye(d))
    w = (basis / np.sqrt(values)) @ basis.T
    flat = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in w])
    return conditions.withColumn(array, F.transform(flat, lambda row: dot(row, F.col(array))))


def average_rank(value: str, *by: str) -> Column:
    """Rank from 1 inside ``by`` where ties share the mean of their ranks. For one ranking over a whole table there is
    :func:`global_rank`, which does not put it into one task."""
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    first = F.rank().over(part.orderBy(value))
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return first + (ties - 1) / 2


def global_rank(df: DataFrame, value: str, name: str = "rank", parts: int = 200) -> DataFrame:
    """Rank from 1 over the whole table, ties share the mean of their ranks; null for null. Values are counted, cut into
    ranges by approximate quantiles, ranked inside their range, and moved by the counts of the ranges before: no task has
    more than a range, and the driver has ``parts`` numbers."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n"))
    cuts = counts.agg(F.percentile_approx(value, F.array(*[F.lit(k / parts) for k in range(1, parts)]), 10_000)).first()[0] or []
    at = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col(value))) if cuts else F.lit(0)
    ranged = counts.withColumn("__part", at)
    total_ = ranged.groupBy("__part").agg(F.sum("__n").alias("__t"))
    before = total_.select("__part", (F.sum("__t").over(Window.partitionBy(F.lit(0)).orderBy("__part")) - F.col("__t")).alias("__before"))  # ``parts`` rows
    inside = F.sum("__n").over(Window.partitionBy("__part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    ranks = ranged.withColumn("__inside", inside).join(F.broadcast(before), "__part").select(value, (F.col("__before") + F.col("__inside") + (F.col("__n") + 1) / 2).alias(name))
    return df.join(ranks, value, "left")


def rank_transform(matrix: DataFrame, value: str = "d") -> DataFrame:
    """The upper triangle's average ranks, in both triangles."""
    ranked = global_rank(matrix, value, "r").select("i", "j", "r")
    return ranked.unionByName(ranked.select(F.col("j").alias("i"), F.col("i").alias("j"), "r"))


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if by:
        ranked = both.withColumns({"__x": average_rank(x, *by).cast("double"), "__y": average_rank(y, *by).cast("double")})
    else:
        ranked = global_rank(global_rank(both, x, "__x"), y, "__y")
    return ranked.groupBy(*by).agg(F.corr("__x", "__y").alias("rho"), F.count("*").alias("n"))


def matrix_correlation(series: DataFrame, model: DataFrame, by: list[str]) -> DataFrame:
    """Spearman's correlation of each matrix (i, j, d, for each of ``by``) with a model's, over pairs that both have."""
    both = series.select(*by, "i", "j", F.col("d").alias("__x")).join(model.select("i", "j", F.col("d").alias("__y")), ["i", "j"])
    return spearman(both, "__x", "__y", by)


def permuted(model: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """draw, i < j, d: the model's matrix with its conditions renamed by seeded permutations (rows and columns together)."""
    names = model.select(F.col("i").alias("c")).union(model.select("j")).distinct()
    dealt = names.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    order = Window.partitionBy("draw").orderBy("c")
    mixed = Window.partitionBy("draw").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "draw", "c")), "c")
    a = dealt.select("draw", "c", F.row_number().over(order).alias("k"))
    b = dealt.select("draw", F.col("c").alias("new"), F.row_number().over(mixed).alias("k"))
    renamed = a.join(b, ["draw", "k"]).select("draw", "c", "new")  # draws x conditions
    out = model.join(renamed.withColumnRenamed("c", "i").withColumnRenamed("new", "__i"), "i").join(renamed.withColumnRenamed("c", "j").withColumnRenamed("new", "__j"), ["draw", "j"])
    return out.select("draw", F.least("__i", "__j").alias("i"), F.greatest("__i", "__j").alias("j"), "d")


def noise_ceiling(series: DataFrame, subject: str, by: list[str]) -> DataFrame:
    """by, lower, upper, from all pairs of (few) subjects: mean less and plus the standard deviation of the correlations of all pairs of subjects' matrices,
    within 0 and 1; 0 and 1 where there is one subject. The rule to fall back to; :func:`tidewater.operators.matrices.noise_ceiling` is the other."""
    a = series.select(*by, F.col(subject).alias("__p"), "i", "j", F.coalesce("d", F.lit(0.0)).alias("__x"))
    b = series.select(*by, F.col(subject).alias("__q"), "i", "j", F.coalesce("d", F.lit(0.0)).alias("__y"))
    pairs = a.join(b, [*by, "i", "j"]).where("__p < __q").groupBy(*by, "__p", "__q").agg(F.corr("__x", "__y").alias("__r"))
    stats = pairs.where("__r is not null").groupBy(*by).agg(F.avg("__r").alias("__m"), F.stddev_pop("__r").alias("__s"))
    every = series.select(*by).distinct().join(stats, by, "left")
    return every.select(*by, F.coalesce(F.greatest(F.lit(0.0), F.col("__m") - F.col("__s")), F.lit(0.0)).alias("lower"), F.coalesce(F.least(F.lit(1.0), F.col("__m") + F.col("__s")), F.lit(1.0)).alias("upper"))


def similarity_summary(df: DataFrame, by: list[str], key: str, array: str) -> DataFrame:
    """By group over all pairs of its vectors (few, as captions of one scene: ``MOST_OF_GROUP``): n, mean, most, least and sd
    of the cosines."""
    few_of_group(df, by, MOST_OF_GROUP)
    a = df.select(*by, F.col(key).alias("__i"), F.col(array).alias("__a"))
    b = df.select(*by, F.col(key).alias("__j"), F.col(array).alias("__b"))
    pairs = a.join(b, by).where("__i < __j").select(*by, cosine(F.col("__a"), F.col("__b")).alias("__c"))
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg("__c").alias("mean"), F.max("__c").alias("most"), F.min("__c").alias("least"), F.stddev_pop("__c").alias("sd"))


def classical_scaling(matrix: DataFrame, dimensions: int = 2) -> DataFrame:
    """key, axis, value: coordinates whose distances are nearest to d (principal coordinates). The matrix of a few
    conditions is solved on the driver (``MOST_CONDITIONS`` bounds it; signs: the greatest part of an axis is positive)."""
    import numpy as np

    rows = matrix.select("i", "j", "d").collect()  # a matrix of conditions
    names = sorted({r["i"] for r in rows} | {r["j"] for r in rows})
    at, d = {n: k for k, n in enumerate(names)}, np.zeros((len(names), len(names)))
    for r in rows:
        d[at[r["i"]], at[r["j"]]] = d[at[r["j"]], at[r["i"]]] = r["d"]
    centre = np.eye(len(names)) - 1 / max(1, len(names))
    values, basis = np.linalg.eigh(-0.5 * centre @ (d * d) @ centre)
    top = np.argsort(-values)[:dimensions]
    x = basis[:, top] * np.sqrt(np.maximum(values[top], 0))
    x *= np.where(x[np.abs(x).argmax(0), range(x.shape[1])] < 0, -1, 1) if len(names) else 1
    kind = matrix.schema["i"].dataType.simpleString()
    return matrix.sparkSession.createDataFrame([(n, a, float(x[k, a])) for k, n in enumerate(names) for a in range(x.shape[1])], f"key {kind}, axis int, value double")

"""Nulls and noise ceilings of series of dissimilarity matrices (i < j, d, for each of ``by``)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stats, vectors

#: Matrices and pairs of conditions that meet in one product.
PLACES, PAIRS = 512, 4096


def _blocks(n: int, size: int) -> int:
    return max(1, -(-n // size))


def permutation_null(series: DataFrame, model: DataFrame, by: list[str], draws: int = 30, seed: int = 0, places: int = PLACES, pairs: int = PAIRS) -> DataFrame:
    """by, draw, rho: Spearman's correlation of each matrix with models whose conditions are renamed by seeded permutations,
    over pairs that both have.

    Ranks are taken once: a permutation of conditions moves a model's ranks with its cells, and a matrix that has all
    pairs of the model keeps its own. What is left is a product of (matrices x pairs) with (pairs x draws), in blocks: rows of matrices are shuffled once,
    whatever the number of draws. Matrices that lack pairs are ranked for each draw, over the pairs that they have."""
    model = model.where(F.col("d").isNotNull()).select("i", "j", "d")
    known = series.where(F.col("d").isNotNull()).select(*by, "i", "j", F.col("d").alias("__x")).join(model.select("i", "j"), ["i", "j"])
    n, conditions = model.count(), model.select("i").union(model.select("j")).distinct().count()
    sizes = known.groupBy(*by).agg(F.count("*").alias("__n"))
    n_places = sizes.count()
    of = [F.col(b) for b in by]
    ranked = known.join(sizes.where(F.col("__n") == n), by).withColumn("__x", vectors.average_rank("__x", *by) - (n + 1) / 2)
    if 2 * n == conditions * (conditions - 1):
        drawn = vectors.permuted(vectors.global_rank(model, "d", "__r").select("i", "j", F.col("__r").alias("d")), draws, seed)
    else:  # cells move to pairs that the model may lack: those left are ranked by draw
        drawn = vectors.permuted(model, draws, seed).join(model.select("i", "j"), ["i", "j"]).withColumn("d", vectors.average_rank("d", "draw"))
        full = drawn.groupBy("draw").count().where(F.col("count") == n).select("draw")
        if full.count() < draws:
            return _ranked_each(series, model, by, draws, seed)
    cells = drawn.groupBy("i", "j").agg(F.transform(F.array_sort(F.collect_list(F.struct("draw", (F.col("d") - (n + 1) / 2).cast("double").alias("y")))), lambda s: s["y"]).alias("__y"))  # ``draws`` values
    rows, columns = _blocks(n_places, places), _blocks(n, pairs)
    pair = F.xxhash64("i", "j")
    left = ranked.select(F.pmod(F.xxhash64(*of), F.lit(rows)).alias("p"), F.pmod(pair, F.lit(columns)).alias("q"), F.xxhash64(*of).alias("id"), pair.alias("pair"), F.col("__x").cast("double").alias("x"))
    right = cells.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))).alias("p"), F.pmod(pair, F.lit(columns)).alias("q"), pair.alias("pair"), F.col("__y").alias("y"))

    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("id", pa.int64()), ("xx", pa.float64()), ("xy", pa.list_(pa.float64())), ("yy", pa.list_(pa.float64()))])
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        ids, row = np.unique(a["id"].to_numpy(), return_inverse=True)
        names = b["pair"].to_numpy()
        order = np.argsort(names)
        y = b["y"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(names), -1)[order]
        x = np.zeros((len(ids), len(names)))
        x[row, np.searchsorted(names[order], a["pair"].to_numpy())] = a["x"].to_numpy()
        lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))
        return pa.Table.from_arrays([pa.array(ids), pa.array((x * x).sum(1)), lists(x @ y), lists(np.broadcast_to((y * y).sum(0), (len(ids), y.shape[1])))], schema=schema)

    parts = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInArrow(product, "id long, xx double, xy array<double>, yy array<double>")
    spread = parts.select("id", "xx", F.posexplode(F.arrays_zip(F.col("xy").alias("xy"), F.col("yy").alias("yy"))).alias("draw", "s")).groupBy("id", "draw").agg(F.sum("xx").alias("xx"), F.sum("s.xy").alias("xy"), F.sum("s.yy").alias("yy"))
    size = F.sqrt(F.col("xx") * F.col("yy"))
    told = spread.select(F.col("id").alias("__id"), F.col("draw").cast("int").alias("draw"), F.when(size > 0, F.col("xy") / size).alias("rho"))
    found = ranked.select(*by, F.xxhash64(*of).alias("__id")).distinct().join(told, "__id").select(*by, "draw", "rho")
    lacking = known.join(sizes.where(F.col("__n") < n), by).select(*by, "i", "j", F.col("__x").alias("d"))
    return found.unionByName(_ranked_each(lacking, model, by, draws, seed))


def _ranked_each(series: DataFrame, model: DataFrame, by: list[str], draws: int, seed: int) -> DataFrame:
    both = series.select(*by, "i", "j", F.col("d").alias("__x")).join(vectors.permuted(model, draws, seed).withColumnRenamed("d", "__y"), ["i", "j"])
    return vectors.spearman(both, "__x", "__y", [*by, "draw"]).select(*by, F.col("draw").cast("int").alias("draw"), "rho")


def left_out_correlations(series: DataFrame, subject: str, by: list[str]) -> DataFrame:
    """by, subject, lower, upper, subjects: rank correlation of each subject's matrix with the mean of the other subjects' ranks and with
    that of all. The mean of the others is what is left of a cell's sum without the own rank, so cells are summed once;
    a null cell counts as 0. With one subject both are null."""
    keys = [*by, subject]
    own = series.select(*keys, "i", "j", F.coalesce("d", F.lit(0.0)).alias("__d")).withColumn("__r", vectors.average_rank("__d", *keys))
    sums = own.groupBy(*by, "i", "j").agg(F.sum("__r").alias("__sum"), F.count("*").alias("__n"))
    means = own.join(sums, [*by, "i", "j"]).withColumns({"__others": F.when(F.col("__n") > 1, (F.col("__sum") - F.col("__r")) / (F.col("__n") - 1)), "__all": F.when(F.col("__n") > 1, F.col("__sum") / F.col("__n"))})
    ranked = means.withColumns({"__others": F.when(F.col("__others").isNotNull(), vectors.average_rank("__others", *keys)), "__all": F.when(F.col("__all").isNotNull(), vectors.average_rank("__all", *keys))})
    return ranked.groupBy(*keys).agg(F.corr("__r", "__others").alias("lower"), F.corr("__r", "__all").alias("upper"), F.max("__n").alias("subjects"))


def noise_ceiling(series: DataFrame, subject: str, by: list[str], draws: int = 0, seed: int = 0, level: float = 0.95) -> DataFrame:
    """by, lower, upper: means over subjects of :func:`left_out_correlations`; 0 and 1 where there is one subject. With ``draws`` also
    the ends of their percentile intervals (lower_low, lower_high, upper_low, upper_high), under seeded weights of subjects."""
    each = left_out_correlations(series, subject, by)
    bounds = each.groupBy(*by).agg(F.avg("lower").alias("__l"), F.avg("upper").alias("__u"), F.max("subjects").alias("__n"))
    one = F.col("__n") < 2
    out = bounds.select(*by, F.when(one, 0.0).otherwise(F.col("__l")).alias("lower"), F.when(one, 1.0).otherwise(F.col("__u")).alias("upper"))
    for side in ("lower", "upper") if draws else ():
        ends = stats.bootstrap_mean(each, by, side, [subject], draws, seed, level).select(*by, F.col("low").alias(f"{side}_low"), F.col("high").alias(f"{side}_high"))
        out = out.join(ends, by, "left")
    return out


#: Of a tile of a silhouette: rows, bytes of vectors and of sums, and rows that meet at once. A group has so many tiles at least, if it has so many rows for each.
TILE, TILE_BYTES, BLOCK, LEAST_TILES = 65_536, 16 << 20, 1024, 8


def _distance_sums(rows: pa.Table) -> pa.Table:
    """Of each row of two tiles that meet (or one with itself): sums of distances to the other tile's rows by cluster (code, clustering
    q, whether it is the row's own), and their numbers n, as lists. Distances are held for ``BLOCK`` x ``BLOCK`` rows."""
    ids, i = rows["id"].to_numpy(), rows["i"].to_numpy()
    lists = lambda c: rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    codes, points, width = lists("c").reshape(len(ids), -1), lists("x"), len(rows["x"][0])
    if len(points) != len(ids) * width or rows["x"].null_count:
        raise ValueError("vectors of unequal lengths")
    points, n_of = points.reshape(-1, width), np.arange(len(ids))
    kinds, first, at = np.unique(codes, return_index=True, return_inverse=True)
    at = at.reshape(codes.shape)
    is_in = np.zeros((len(ids), len(kinds)))
    for q in range(codes.shape[1]):
        is_in[n_of, at[:, q]] = 1
    low, high = rows["low"][0].as_py(), rows["high"][0].as_py()
    sides = [np.flatnonzero(i == low), np.flatnonzero(i == high)]
    squares, one = np.einsum("ij,ij->i", points, points)[:, None], np.ones((len(ids), 1))
    blocks = [[s[k : k + BLOCK] for k in range(0, len(s), BLOCK)] for s in sides]
    to = [np.hstack([points[b], one[b], squares[b]]) for b in blocks[1]]
    total, n = np.zeros(is_in.shape), np.zeros(is_in.shape, np.int64)
    for ka, a in enumerate(blocks[0]):
        of = np.hstack([-2 * points[a], squares[a], one[a]])
        for kb in range(ka if low == high else 0, len(blocks[1])):
            b = blocks[1][kb]
            d = of @ to[kb].T
            np.sqrt(np.maximum(d, 0, out=d), out=d)
            if low == high and ka == kb:
                np.fill_diagonal(d, 0)
            else:
                total[b] += d.T @ is_in[a]
            total[a] += d @ is_in[b]
    for mine, other in (sides, sides[::-1]):
        n[mine] = is_in[other].sum(0)
    ends = pa.array(np.arange(len(ids) + 1) * len(kinds), pa.int32())
    q = (first % codes.shape[1]).astype(np.int32)
    columns = [np.tile(q, len(ids)), np.tile(kinds, len(ids)), is_in.ravel() > 0, total.ravel(), n.ravel()]
    return pa.Table.from_arrays([pa.array(ids), *[pa.ListArray.from_arrays(ends, pa.array(v)) for v in columns]], names=["id", "q", "c", "own", "s", "n"])


def _dealt(named: DataFrame, clusters: list[str], by: list[str], tile: int) -> DataFrame:
    """Rows of ``by``, __id and __x as often as their tile meets one of their group: group g, tiles low <= high, own tile i."""
    group = F.xxhash64(*[F.col(b) for b in by], F.lit(0))
    codes = F.array(*[F.xxhash64(F.lit(q), *by, c) for q, c in enumerate(clusters)])
    coded = named.select(group.alias("g"), F.col("__id").alias("id"), codes.alias("c"), F.col("__x").alias("x"))
    width = F.max(F.size("x")) + sum((F.approx_count_distinct(F.col("c")[q]) for q in range(len(clusters))), F.lit(0))
    most = F.greatest(F.least(F.lit(tile), F.lit(TILE_BYTES) / (8 * width)), F.lit(1))
    n_tiles = F.greatest(F.ceil(F.count("*") / most), F.least(F.ceil(F.count("*") / BLOCK), F.lit(LEAST_TILES)), F.lit(1)).cast("int").alias("t")
    sized = coded.join(coded.groupBy("g").agg(n_tiles), "g").withColumn("i", F.pmod(F.xxhash64("id"), F.col("t")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("t") - 1), lambda j: F.struct(F.least("i", j).alias("low"), F.greatest("i", j).alias("high")))
    return sized.select("g", "id", "c", "i", "x", F.explode(meets).alias("m")).select("g", "m.low", "m.high", "id", "c", "i", "x")


def _silhouettes(named: DataFrame, clusters: list[str], by: list[str], tile: int) -> DataFrame:
    """__id, __q, silhouette of rows of ``by``, __id and __x, in each clustering (``clusters[__q]``)."""
    parts = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number is neither put together (few bytes take long here) nor replaced by the groups' own parts
    sums = _dealt(named, clusters, by, tile).repartition(parts, "g", "low", "high").groupBy("g", "low", "high").applyInArrow(_distance_sums, "id long, q array<int>, c array<long>, own array<boolean>, s array<double>, n array<long>")
    long = sums.repartition("id").select("id", F.explode(F.arrays_zip("q", "c", "own", "s", "n")).alias("e")).select("id", "e.*")
    each = long.groupBy("id", "q", "c").agg(F.max("own").alias("own"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    mean = F.col("s") / F.nullif(F.col("n") - F.col("own").cast("int"), F.lit(0))  # a row is no neighbour of its own
    both = each.groupBy("id", "q").agg(F.max(F.when(F.col("own"), F.col("n"))).alias("n"), F.max(F.when(F.col("own"), mean)).alias("a"), F.min(F.when(~F.col("own"), mean)).alias("b"))
    value = F.when(F.col("b").isNull(), None).when(F.col("n") == 1, 0.0).when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return both.select(F.col("id").alias("__id"), F.col("q").alias("__q"), value.alias("silhouette"))


def silhouettes(df: DataFrame, key: list[str], x: str, cluster: str, by: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """by, key, cluster, silhouette of each row: (b - a) / max(a, b) of its mean distances a to the others of its cluster and
    b to the nearest other cluster; 0 for a cluster's only row, null where there is one cluster.

    Exact, so all rows of a group meet: in tiles of ``tile`` rows and 16 MB (vectors and sums) at most on average, each pair of tiles once, which gives both
    sides their sums of distances for each cluster. A group of t tiles is sent t times, spread over t^2 / 2 tasks' groups: time grows with
    the square of its rows, memory doesn't, and n rows of 64 numbers are shuffled some n / 27,000 times, 8 at least from 8,000 rows on."""
    by = by or []
    named = df.select(*by, *key, F.xxhash64(*by, *key).alias("__id"), F.col(cluster).alias("__c"), F.col(x).cast("array<double>").alias("__x"))
    told = _silhouettes(named, ["__c"], by, tile).drop("__q")
    return named.select(*by, *key, F.col("__c").alias(cluster), "__id").join(told, "__id", "left").drop("__id")


def silhouettes_of_each(df: DataFrame, key: list[str], x: str, clusters: list[str], by: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """by, key, clustering (a name of ``clusters``), silhouette: :func:`silhouettes` in several clusterings of the same rows, whose
    distances are taken once."""
    by = by or []
    named = df.select(*by, *key, F.xxhash64(*by, *key).alias("__id"), *clusters, F.col(x).cast("array<double>").alias("__x"))
    told = _silhouettes(named, clusters, by, tile).withColumn("clustering", F.element_at(F.array(*map(F.lit, clusters)), F.col("__q") + 1)).drop("__q")
    return named.select(*by, *key, "__id").join(told, "__id").drop("__id")


def mixed_model(df: DataFrame, y: str, terms: dict[str, object], group: str, most_sizes: int = 10_000) -> DataFrame:
    """term, coef, se, z: a linear mixed model with a random intercept for each group, by restricted likelihood; and rows of the terms
    'group variance' and 'residual variance' (coef only). ``terms``: named columns besides the intercept. Rows with a
    null go.

    The likelihood needs the sums of products of all rows, and of each group its number of rows n, its sums of terms and
    of y, which it uses only as outer products weighed by a factor of n. So groups of one size are added up on the executors, and a few
    small matrices, one for each size, go to the driver, which finds the ratio of the variances (one dimension, by golden section)."""
    names = ["intercept", *terms]
    rows = df.select(F.col(group).alias("__g"), F.col(y).cast("double").alias("__y"), *[v.cast("double").alias(f"__t{k}") for k, v in enumerate(terms.values())]).dropna()
    z = [F.lit(1.0), *[F.col(f"__t{k}") for k in range(len(terms))], F.col("__y")]
    p = len(names)
    inner = [F.sum(a * b).alias(f"__p{i}_{j}") for i, a in enumerate(z) for j, b in enumerate(z) if i <= j]
    groups = rows.groupBy("__g").agg(F.count("*").alias("__n"), *[F.sum(v).alias(f"__s{i}") for i, v in enumerate(z)], *inner)
    outer = [F.sum(F.col(f"__s{i}") * F.col(f"__s{j}")) for i in range(p + 1) for j in range(i, p + 1)]
    added = [F.sum(f"__p{i}_{j}") for i in range(p + 1) for j in range(i, p + 1)]
    sums = groups.groupBy("__n").agg(F.count("*").alias("m"), F.array(*outer).alias("o"), F.array(*added).alias("p")).limit(most_sizes + 1).collect()
    if len(sums) > most_sizes:
        raise ValueError(f"over {most_sizes} different sizes of groups")
    if not sums:
        return df.sparkSession.createDataFrame([], "term string, coef double, se double, z double")
    upper = np.triu_indices(p + 1)

    def square(v: list[float]) -> np.ndarray:
        m = np.zeros((p + 1, p + 1))
        m[upper] = v
        return m + np.triu(m, 1).T

    n, m = np.array([r["__n"] for r in sums], float), np.array([r["m"] for r in sums], float)
    cross, whole = np.stack([square(r["o"]) for r in sums]), sum(square(r["p"]) for r in sums)
    total = float((n * m).sum())

    def fitted(ratio: float):
        s = whole - np.tensordot(ratio / (1 + ratio * n), cross, 1)
        a, b = s[:p, :p], s[:p, p]
        beta = np.linalg.solve(a, b)
        sigma = max((s[p, p] - b @ beta) / (total - p), 1e-300)
        return (total - p) * np.log(sigma) + (m * np.log1p(ratio * n)).sum() + np.linalg.slogdet(a)[1], beta, sigma, a

    cost = lambda t: fitted(np.exp(t))[0]
    grid = np.linspace(-16, 16, 65)
    best = int(np.argmin([cost(t) for t in grid]))
    low, high, g = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)], (5**0.5 - 1) / 2
    for _ in range(120):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if cost(a) < cost(b) else (a, high)
    ratio = float(np.exp((low + high) / 2))
    ratio = 0.0 if fitted(0.0)[0] <= fitted(ratio)[0] else ratio
    _, beta, sigma, a = fitted(ratio)
    se = np.sqrt(np.diag(np.linalg.inv(a)) * sigma)
    out = [(t, float(c), float(s), float(c / s) if s > 0 else None) for t, c, s in zip(names, beta, se, strict=True)]
    out += [("group variance", float(ratio * sigma), None, None), ("residual variance", float(sigma), None, None)]
    return df.sparkSession.createDataFrame(out, "term string, coef double, se double, z double")

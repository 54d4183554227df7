"""Nulls, ceilings, silhouettes and mixed models against plain restatements."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import matrices


@pytest.mark.parametrize("lacking", [False, True])
def test_null_is_that_of_ranking_each(spark, lacking):
    """Small blocks, ties, places that lack pairs; and a model that lacks a pair."""
    rng = np.random.default_rng(3)
    pairs = [(i, j) for i in range(7) for j in range(i + 1, 7)]
    model = spark.createDataFrame([(i, j, float(rng.integers(0, 9))) for i, j in pairs[lacking:]], "i int, j int, d double")
    data = [(p, i, j, float(rng.integers(0, 12))) for p in range(11) for i, j in pairs if not (p == 4 and i == 2)]
    series = spark.createDataFrame([*data, (12, 0, 1, None)], "p int, i int, j int, d double")
    got = {(r["p"], r["draw"]): r["rho"] for r in matrices.permutation_null(series, model, ["p"], 6, 5, places=3, pairs=4).collect()}
    want = {(r["p"], r["draw"]): r["rho"] for r in matrices._ranked_each(series.where("d is not null"), model, ["p"], 6, 5).collect()}
    if lacking:  # where cells move out of the model, ranks are taken for each matrix
        assert got == pytest.approx(want, abs=1e-9)
    else:
        assert got.keys() == want.keys() and len(got) == 66 and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_one_subject_has_open_bounds(spark):
    series = spark.createDataFrame([(1, 0, 0, 1, 0.3), (1, 0, 0, 2, 0.4), (1, 0, 1, 2, None)], "s int, t int, i int, j int, d double")
    assert [tuple(r) for r in matrices.noise_ceiling(series, "s", ["t"]).collect()] == [(0, 0.0, 1.0)]


def test_silhouettes(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 5)) + rng.integers(0, 4, 300)[:, None]
    c, g = rng.integers(0, 4, 300), rng.integers(0, 2, 300)
    c[:3], g[:3] = [9, 9, 8], [0, 1, 1]  # a cluster's only row
    df = spark.createDataFrame([(i, int(g[i]), int(c[i]), x[i].tolist()) for i in range(300)], "id int, g int, c int, x array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {}
    for i in range(300):
        near = {k: [d[i, j] for j in range(300) if j != i and g[j] == g[i] and c[j] == k] for k in set(c[g == g[i]])}
        a = np.mean(near[c[i]]) if near[c[i]] else None
        b = min(np.mean(v) for k, v in near.items() if k != c[i])
        want[i] = 0.0 if a is None else (b - a) / max(a, b)
    for tile in (16, 1024):
        got = {r["id"]: r["silhouette"] for r in matrices.silhouettes(df, ["id"], "x", "c", ["g"], tile).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in got)
    assert {r["silhouette"] for r in matrices.silhouettes(df.withColumn("c", F.lit(1)), ["id"], "x", "c").collect()} == {None}


def test_silhouettes_of_several_clusterings(spark, monkeypatch):
    """Distances are taken once for all clusterings, equal to each on its own, also over many tiles and blocks; what is sent of a
    large group is bounded by the bytes of its tiles."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3))
    data = [(i, i % 2, int(i % 3), f"c{i % 5 if i else 9}", x[i].tolist()) for i in range(200)]
    df = spark.createDataFrame(data, "id int, g int, a int, b string, x array<double>")
    alone = {(r["id"], c): r["silhouette"] for c in "ab" for r in matrices.silhouettes(df, ["id"], "x", c, ["g"]).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    same = [j for j in range(1, 200, 2) if j % 3 == 2]
    inner, outer = np.mean([d[5, j] for j in same if j != 5]), min(np.mean([d[5, j] for j in range(1, 200, 2) if j % 3 == k]) for k in (0, 1))
    assert alone[5, "a"] == pytest.approx((outer - inner) / max(inner, outer)) and alone[0, "b"] == 0
    for tile in (7, 1000):
        got = {(r["id"], r["clustering"]): r["silhouette"] for r in matrices.silhouettes_of_each(df, ["id"], "x", ["a", "b"], ["g"], tile).collect()}
        assert got == pytest.approx(alone, abs=1e-9)
    plan = matrices.silhouettes_of_each(df, ["id"], "x", ["a", "b"], ["g"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(g#\w+, low#\w+, high#\w+", plan)  # not a group in one task
    many = spark.range(40_000).select(F.col("id").alias("__id"), F.array(F.col("id").cast("double")).alias("__x"), *[(F.col("id") % k).alias(f"k{k}") for k in (2, 4, 8)])
    assert matrices._dealt(many, ["k2", "k4", "k8"], [], matrices.TILE).count() == 40_000 * 8  # 40,000 * 40 * 3 in tiles of 1,024 rows for each clustering
    monkeypatch.setattr(matrices, "TILE_BYTES", 8 * 15 * 2000)
    assert matrices._dealt(many, ["k2", "k4", "k8"], [], matrices.TILE).count() / 40_000 in range(18, 23)  # the number of clusters is an estimate


def test_choice_of_clusters_by_each_row(spark):
    """Held-out silhouettes against plain ones, with several splits and numbers of clusters at once."""
    from tidewater.operators import models

    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 2)) * 0.3 + np.array([[0, 0], [6, 0], [0, 6]])[np.arange(120) % 3]
    df = spark.createDataFrame([(i, i // 3 % 2, x[i].tolist()) for i in range(120)], "id int, split int, x array<double>")
    got = {r["k"]: (r["silhouette"], r["best"]) for r in models.select_clusters(df, "x", "split", ["id"], [2, 3]).collect()}
    value = []
    for i in range(120):
        near = [[np.linalg.norm(x[i] - x[j]) for j in range(120) if j != i and j // 3 % 2 == i // 3 % 2 and j % 3 == k] for k in range(3)]
        a, b = np.mean(near[i % 3]), min(np.mean(near[k]) for k in range(3) if k != i % 3)
        value.append((b - a) / max(a, b))
    assert got[3] == (pytest.approx(np.median(value)), True) and not got[2][1] and got[2][0] < got[3][0]


def test_mixed_model(spark):
    """Groups of unequal sizes: estimates equal those of the likelihood of the whole covariance."""
    rng = np.random.default_rng(1)
    g = np.repeat(np.arange(30), rng.integers(1, 9, 30))
    x = np.column_stack([np.ones(len(g)), rng.normal(size=len(g)), rng.integers(0, 2, len(g))])
    y = x @ [1, 2, -0.5] + rng.normal(size=30)[g] * 0.8 + rng.normal(size=len(g)) * 0.6
    df = spark.createDataFrame([(int(a), float(b[1]), int(b[2]), float(v)) for a, b, v in zip(g, x, y, strict=True)] + [(1, None, 1, 2.0)], "g int, a double, b int, y double")
    got = {r["term"]: (r["coef"], r["se"]) for r in matrices.mixed_model(df, "y", {"a": F.col("a"), "b": F.col("b")}, "g").collect()}

    def dense(u, e):
        v = e * np.eye(len(g)) + u * (g[:, None] == g[None])
        w = np.linalg.inv(v)
        a = x.T @ w @ x
        beta = np.linalg.solve(a, x.T @ w @ y)
        r = y - x @ beta
        return np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1] + r @ w @ r, beta, np.sqrt(np.diag(np.linalg.inv(a)))

    u, e = got["group variance"][0], got["residual variance"][0]
    best, beta, se = dense(u, e)
    assert all(dense(u * s, e * t)[0] >= best - 1e-7 for s in (0.97, 1, 1.03) for t in (0.97, 1, 1.03))
    assert np.allclose([got[t][0] for t in ("intercept", "a", "b")], beta, atol=1e-6) and np.allclose([got[t][1] for t in ("intercept", "a", "b")], se, atol=1e-6)
    assert matrices.mixed_model(df.limit(0), "y", {"a": F.col("a")}, "g").collect() == []


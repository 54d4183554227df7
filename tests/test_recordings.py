"""Recordings in chunks against one long computation; densities against direct sums; checks in the same pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import checked, recordings


@pytest.mark.parametrize(("up", "down"), [(1, 1), (3, 2), (2, 5)])
def test_results_do_not_depend_on_stretches(spark, up, down):
    rng = np.random.default_rng(up)
    kernel = recordings.low_pass(up, down, 3) if up != down else rng.normal(size=31).tolist()
    half, data, want = len(kernel) // 2, [], {}
    for rec, (first, n) in enumerate([(0, 900), (5, 1), (17, 331)]):
        x = rng.normal(size=n)
        at = 0
        while at < n:  # chunks of many lengths, also shorter than the kernel
            size = int(rng.choice([1, 2, 7, 40, 200]))
            data.append((rec, first + at, x[at : at + size].tolist()))
            at += size
        wide = np.zeros(n * up)
        wide[::up] = x
        full = np.convolve(wide, kernel)
        m = np.arange(-(-first * up // down), (first + n - 1) * up // down + 1)
        want[rec] = (m, full[m * down - first * up + half])
    chunks = spark.createDataFrame(data, "rec int, start long, x array<double>").repartition(4)
    for width in (10, 64, 100_000):
        got = {}
        for r in recordings.resampled(chunks, ["rec"], "start", "x", kernel, up, down, width).collect():
            got.setdefault(r["rec"], {}).update(enumerate(r["x"], r["start"]))
        assert {k: sorted(v) for k, v in got.items()} == {k: m.tolist() for k, (m, _) in want.items() if len(m)}
        assert all(np.allclose([got[k][i] for i in m], y) for k, (m, y) in want.items() if len(m))
    assert recordings.resampled(chunks.limit(0), ["rec"], "start", "x", kernel).collect() == []
    with pytest.raises(ValueError):
        recordings.resampled(chunks, ["rec"], "start", "x", [1.0, 1.0])


@pytest.mark.parametrize("spread", [None, ("t", 0.7)])
def test_assembled_with_gaps_and_unequal_ends(spark, spread):
    rng = np.random.default_rng(5)
    t = np.cumsum(np.where(rng.random(400) < 0.03, 0.5, 0.01)) + 3  # gaps of half a second
    a, b = rng.normal(size=400), rng.normal(size=400)
    there = (np.arange(400) > 60) & (np.arange(400) < 300) & (rng.random(400) < 0.8)
    df = spark.createDataFrame([(1, float(t[i]), float(a[i]), float(b[i]) if there[i] else None) for i in range(400)] + [(2, 0.0, 1.0, 1.0)], "rec int, t double, a double, b double").repartition(3)
    at = t[0] + np.arange(int(np.ceil(round((t[-1] - t[0]) * 100, 6)))) / 100
    want = {"a": np.interp(at, t, a), "b": np.interp(at, t[there], b[there], left=0, right=0)}
    for chunk in (64, 100_000):
        got: dict = {}
        for r in recordings.assembled(df, ["rec"], "t", ["a", "b"], chunk=chunk, spread=spread).collect():
            assert r["rec"] == 1 and r["rate"] == 100 and len(r["x"]) <= chunk
            got.setdefault(r["channel"], {})[r["start"]] = r["x"]
        for c, y in want.items():
            x = np.concatenate([got[c][s] for s in sorted(got[c])])
            sure = np.abs(at[:, None] - t[there][[0, -1]]).min(1) > 1e-6  # a grid point at a channel's end is a matter of rounding
            assert len(x) == len(at) and np.allclose(x[sure], y[sure], atol=1e-6)
    wide = recordings.gaps(df, ["rec"], "t", spread=spread).collect()
    assert sorted(round(r["onset"], 6) for r in wide) == sorted(round(float(t[i]), 6) for i in range(399) if t[i + 1] - t[i] > 0.1)
    with pytest.raises(KeyError):
        recordings.assembled(df, ["rec"], "t", ["c"])


def test_runs_in_order(spark):
    df = spark.createDataFrame([(1, 2, 0, [3.0, 4.0]), (1, 1, 0, [1.0]), (1, 1, 1, [2.0])], "rec int, run int, start long, x array<double>")
    got = sorted((r["start"], r["x"]) for r in recordings.joined_in_order(df, ["rec"], "run", "start", "x").collect())
    assert got == [(0, [1.0]), (1, [2.0]), (2, [3.0, 4.0])]


def test_density_is_near_the_direct_sum(spark):
    """On a fine grid the counts of cells are as good as the rows themselves; all of it sums to one."""
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=300), rng.gamma(2, size=300)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    rows = recordings.density(df, "x", "y", cells=120).collect()
    h = [v.std(ddof=1) * 300 ** (-1 / 6) for v in (x, y)]
    direct = lambda p, q: np.mean(np.exp(-0.5 * ((p - x) / h[0]) ** 2 - 0.5 * ((q - y) / h[1]) ** 2)) / (2 * np.pi * h[0] * h[1])
    top = max(r["density"] for r in rows)
    assert len(rows) == 14_400 and all(abs(r["density"] - direct(r["x"], r["y"])) < 0.02 * top for r in rows[::97])
    by = {(r["bx"], r["by"]): r for r in rows}
    cell = (by[1, 0]["x"] - by[0, 0]["x"]) * (by[0, 1]["y"] - by[0, 0]["y"])
    assert abs(sum(r["density"] for r in rows) * cell - 1) < 0.01
    few = recordings.density(df, "x", "y", cells=10, bounds=(-1, 1, 0, 2)).collect()
    assert min(r["x"] for r in few) == pytest.approx(-0.9) and max(r["y"] for r in few) == pytest.approx(1.9)


def test_checks_come_with_the_action(spark):
    df = spark.range(100).withColumn("v", F.when(F.col("id") % 10 != 3, F.col("id")))
    c = checked.Checked(df, "values", {"v is missing": F.col("v").isNull(), "v is negative": F.col("v") < 0}, {"rows": F.count("*")})
    assert c.df.agg(F.sum("v")).first()[0] > 0
    assert c.counts() == {"rows": 100}
    with pytest.raises(ValueError, match=r"values: v is missing \(10 rows\)$"):
        c.verify()
    layer = lambda n, size=3: spark.range(n).select("id", F.array_repeat(F.lit(0.5), size).alias("x"))
    good = checked.Layers({"one": layer(5), "two": layer(5)}, ["id"], "x")
    assert good.df.count() == 10
    good.verify()
    bad = checked.Layers({"one": layer(5), "two": layer(4), "three": layer(5, 2)}, ["id"], "x")
    bad.df.collect()
    with pytest.raises(ValueError, match="two: id of 4 rows are not those of one .5.; three: length 2, of one 3"):
        bad.verify()

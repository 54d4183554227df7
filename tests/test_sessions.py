"""Composed loaders: what is missing, captions, clipped look-ups, matching by five keys, splits by scene."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import encoding, intervals, models, sampling
from tidewater.sources import sessions, tables


def test_sessions(spark, tmp_path):
    folder = str(tmp_path)
    df = spark.range(20).select((F.col("id") % 2).alias("subject"), (F.col("id") % 3).alias("session"), F.col("id").alias("k"))
    tables.write_rows(df, f"{folder}/events.parquet", ("subject", "session"))
    tables.write_rows(df.where("subject = 0"), f"{folder}/log.parquet", ("subject", "session"))
    s = sessions.load_session(spark, folder, 1, 2, ["events", "log", "none"])
    assert s.missing == ["log", "none"] and sorted(r["k"] for r in s["events"].collect()) == [5, 11, 17] and s.get("log") is None
    with pytest.raises(KeyError, match="subject 1, session 2 has no log"):
        s["log"]
    with pytest.raises(FileNotFoundError):
        sessions.load_session(spark, folder, 1, 2, ["log"], required=("log",))
    assert sessions.first_existing(spark, [f"{folder}/a", f"{folder}/log.parquet", f"{folder}/events.parquet"]) == f"{folder}/log.parquet"
    assert sessions.first_existing(spark, [f"{folder}/a"]) is None
    wanted = spark.createDataFrame([(0, 0), (1, 1), (1, 1)], "subject long, session long")
    found, marks = sessions.load_sessions(spark, folder, wanted, ["events", "log", "none"])
    assert found.keys() == {"events", "log"} and found["events"].count() == 8
    assert sorted(map(tuple, marks.where("present").collect())) == [(0, 0, "events", True), (0, 0, "log", True), (1, 1, "events", True)] and marks.count() == 6


def test_captions_and_files(spark):
    log = spark.createDataFrame([(1, "['a', \"b c\"]"), (2, " \t"), (3, None), (4, "plain")], "id int, said string")
    more = spark.createDataFrame([(5, "x", 1)], "id int, said string, other int")
    instead = spark.createDataFrame([(4, ["new"]), (4, ["zz"]), (9, ["unused"])], "id int, captions array<string>")
    got = {r["id"]: r["captions"] for r in sessions.load_captions([log, more], "id", "said", instead).collect()}
    assert got == {1: ["a", "b c"], 4: ["new"], 5: ["x"]}
    there, gone = sessions.with_existing(log, spark.createDataFrame([(1,), (1,), (4,)], "id int"), "id")
    assert sorted(r["id"] for r in there.collect()) == [1, 4] and sorted(r["id"] for r in gone.collect()) == [2, 3]
    long = sessions.collected(spark.createDataFrame([(1, [1.0, 2.0], [3.0])], "k int, a array<double>, b array<double>"), ["k"], {"a": F.col("a"), "b": F.col("b")})
    assert sorted(map(tuple, long.collect())) == [(1, 0, 1.0, 3.0), (1, 1, 2.0, None)]


def test_clipped_look_up(spark):
    left = spark.createDataFrame([(1, 0.0), (1, 5.0), (2, 1.0)], "k int, t double")
    right = spark.createDataFrame([(1, 3.0, 30), (1, 4.0, 40)], "k int, t double, v int")
    got = intervals.asof_or_first(left, right, ["k"], "t", ["v"], bucket=2.0)
    assert sorted(map(tuple, got.collect())) == [(1, 0.0, 30), (1, 5.0, 40), (2, 1.0, None)]


def test_items_match_by_five_keys(spark):
    items = spark.createDataFrame([(1, 2, 3, 1.2349, 7), (1, 2, 3, 1.235, 7), (1, 2, 4, 0.29, 7), (9, 9, 9, 0.0, 9)], "subject int, trial int, fix_sequence int, start_time double, scene int")
    files = spark.createDataFrame([("a/1_2_3_1234_7.png", 5), ("b/1_2_3_1234_7.png", 4), ("1_2_4_290_7.png", 8), ("odd.png", 1), ("9_9_9_x_9.png", 2)], "file string, place int")
    got = encoding.matched_items(items, files).collect()
    assert sorted((r["start_time"], r["place"]) for r in got) == sorted([(1.2349, 4)] + [(0.29, 8)] * (int(0.29 * 1000) == 290))


def test_encoding_by_scene_is_what_numpy_gives(spark):
    """Robust scaling without the held-out scenes, axes of x, alpha by folds, scores on held-out scenes."""
    rng = np.random.default_rng(12)
    n = 240
    scene = rng.integers(0, 24, n)
    x = rng.normal(size=(n, 6)) @ rng.normal(size=(6, 6))
    y = np.column_stack([x[:, 0] + rng.normal(size=n), rng.normal(size=n), x @ rng.normal(size=6)])
    df = spark.createDataFrame([(i, int(scene[i]), x[i].tolist(), y[i].tolist()) for i in range(n)], "k int, scene int, x array<double>, y array<double>").repartition(3)
    split = {r["k"]: (r["held"], r["f"]) for r in encoding.scene_split(df, "scene", 0.2, 3).withColumn("f", F.conv(F.substring(sampling.seeded(3, "k"), 1, 8), 16, 10).cast("long") % 3).select("k", "held", "f").collect()}
    held, fold = np.array([split[i][0] for i in range(n)]), np.array([split[i][1] for i in range(n)])
    assert len(set(scene[held])) == 5 and not set(scene[held]) & set(scene[~held])
    scaled = lambda v: (v - np.median(v[~held], 0)) / np.subtract(*np.percentile(v[~held], [75, 25], 0))
    a, b = scaled(x), scaled(y)
    values, basis = np.linalg.eigh(np.cov(a[~held].T, bias=True))
    order = np.argsort(-values)
    a = (a - a[~held].mean(0)) @ basis[:, order[: int(np.searchsorted(np.cumsum(values[order]) / values.sum(), 0.7) + 1)]]

    def predicted(fit, rows, t, alpha):
        m, c = a[fit].mean(0), b[fit, t].mean()
        z = a[fit] - m
        return c + (a[rows] - m) @ np.linalg.solve(z.T @ z + alpha * np.eye(a.shape[1]), z.T @ (b[fit, t] - c))

    r2 = lambda p, v: 1 - ((v - p) ** 2).sum() / ((v - v.mean()) ** 2).sum()
    got = {r["target"]: r for r in encoding.encode_scenes(df, ["k"], "scene", "x", "y", seed=3).collect()}
    for t in range(3):
        score = [np.mean([r2(predicted(~held & (fold != f), ~held & (fold == f), t, al), b[~held & (fold == f), t]) for f in range(3)]) for al in models.ALPHAS]
        best = models.ALPHAS[int(np.argmax(score))]
        p = predicted(~held, held, t, best)
        assert got[t]["alpha"] == best and got[t]["r2"] == pytest.approx(r2(p, b[held, t]), abs=1e-8) and got[t]["r"] == pytest.approx(np.corrcoef(p, b[held, t])[0, 1], abs=1e-8)
    fewer = encoding.encode_scenes(df, ["k"], "scene", "x", "y", target_share=0.7, seed=3)
    assert 0 < fewer.count() < 3


def test_one_machine_for_each_label(spark):
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0], [8, 0], [0, 8]])
    df = spark.createDataFrame([(i, int(i % 3), int(i % 2), (centres[i % 3] + rng.normal(size=2)).tolist()) for i in range(90)], "id int, label int, fold int, x array<double>")
    got = models.decode(df, "x", "label", "fold", ["id"], 20, one_vs_rest=True)
    assert got.count() == 90 and models.macro_accuracy(got, "label").first()[0] > 0.95

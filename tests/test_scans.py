"""Operators along an order give equal results inside keys and dealt over buckets; grouped quantiles equal NumPy's."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import aggregates, enrich, quantiles, scans, sequence, triggers


@pytest.fixture(scope="module")
def stream(spark):
    """Runs and gaps that cross bucket borders, buckets of one row, and a key of nearly all rows."""
    rng = random.Random(2)
    out, t = [], 0
    for i in range(900):
        t += rng.choice([1, 1, 2, 3, 40])
        out.append((0 if rng.random() < 0.9 else rng.choice([1, 2]), t, i, rng.choice("aaab"), rng.choice([None, 0.0, 1.0, 2.5, 2.5]), rng.random()))
    return spark.createDataFrame(out, "k int, t long, i long, kind string, v double, size double").repartition(4)


def rows(df):
    return sorted((tuple(None if x is None else round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("width", [1.0, 7.0, 100.0])
def test_spread_is_no_spread(stream, width):
    spread, key = ("t", width), (["k"], ["t", "i"])
    anchor = F.col("size") < 0.1
    for f in (
        lambda s: sequence.merge_runs(stream, *key, "kind", "a", "t", spread=s),
        lambda s: sequence.drop_close(stream, *key, "t", 2.5, "size", spread=s),
        lambda s: sequence.moving_average(stream, *key, "v", 3, spread=s),
        lambda s: sequence.spans(stream, *key, "t", anchor, spread=s),
        lambda s: sequence.edges(stream, *key, "v", spread=s),
        lambda s: enrich.neighbours_by_kind(enrich.sequences(stream.withColumn("kind", F.when(F.col("kind") == "a", "fixation").otherwise("saccade")), *key, "kind", s), *key, "kind", ["v"], ["size"], s),
        lambda s: enrich.without_artifacts(stream.select("k", "t", "i", F.lit("saccade").alias("type"), F.col("t").cast("double").alias("start_time"), (F.col("t") + 0.9).alias("end_time"), F.lit(0.9).alias("duration"), F.col("size").alias("amplitude")), *key, least_gap=0.2, spread=s),
        lambda s: sequence.ranks(stream, ["k"], "size", ["i"], 0.1, s and s[1] / 50),
        lambda s: triggers.relabel(stream, *key, "kind", F.col("previous") == "b", F.lit("c"), spread=s),
    ):
        plain = rows(f(None))
        assert plain and rows(f(spread)) == plain


def test_scan_values(stream):
    """Every kind of running value against a loop."""
    what = {"sums": {"s": F.lit(1)}, "totals": {"all": F.lit(1)}, "lasts": {"l": F.when(F.col("kind") == "b", F.col("i"))}, "nexts": {"n": F.when(F.col("kind") == "b", F.col("i"))}, "before": {"b": F.col("v")}, "after": {"a": F.col("v")}}
    data = sorted(map(tuple, stream.collect()), key=lambda r: r[1:3])
    want = {}
    for k in (0, 1, 2):
        mine = [r for r in data if r[0] == k]
        for p, r in enumerate(mine):
            bs = [x[2] for x in mine if x[3] == "b"]
            want[r[2]] = (p + 1, len(mine), max((b for b in bs if b < r[2]), default=None), min((b for b in bs if b > r[2]), default=None), mine[p - 1][4] if p else None, mine[p + 1][4] if p + 1 < len(mine) else None)
    for spread in (None, ("t", 5.0)):
        got = scans.scan(stream, ["k"], ["t", "i"], spread, **what)
        assert {r["i"]: (r["s"], r["all"], r["l"], r["n"], r["b"], r["a"]) for r in got.collect()} == want


@pytest.mark.parametrize("width", [1.0, 30.0, 1000.0])
def test_trigger_streams_spread(spark, width):
    rng, data, previous = random.Random(5), [], 0
    for i in range(1500):
        code = [90, 91, 100, rng.choice([60, 61, 75, 98]), i // 10 % 30 + 1, 101, 112, 113, 110, 111][i % 10] if rng.random() < 0.95 else rng.choice([90, 5, 60])
        data.append((1, i * 10, code, previous))
        previous = code
    raw = spark.createDataFrame(data, "session int, sample long, code int, previous int").repartition(3)
    spread, how = ("sample", width), ("session", ["sample"])
    fixed = [triggers.repair(raw, *how, spread=s) for s in (None, spread)]
    assert rows(fixed[0]) == rows(fixed[1])
    for f in (lambda s: triggers.segments(fixed[0], *how, spread=s), lambda s: triggers.trial_of(fixed[0], *how, 112, reach=7, spread=s), lambda s: triggers.onsets(fixed[0], *how, spread=s)):
        plain = rows(f(None))
        assert plain and rows(f(spread)) == plain


def test_grouped_quantiles(spark):
    """One group of 90 % of all rows, ties, infinities, one row, only nulls, a null group; brackets from a coarse sketch."""
    rng = np.random.default_rng(7)
    groups = {"hot": rng.lognormal(0, 2, 18_000), "ties": np.repeat([1.0, 2.0, 2.0, 5.0], 400), "one": np.array([3.5]), "ends": np.array([-np.inf, 0.0, np.inf]), None: rng.normal(size=300)}
    data = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("hot", None), ("nulls", None)]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "g string, x double").repartition(6)
    ps = [0.9, 0.0, 0.25, 0.5, 0.999, 1.0, 0.5]
    for accuracy in (None, 50, 400):
        got = {r["g"]: (r["__q"], r["n"]) for r in quantiles.exact_quantiles(df, "x", ps, ["g"], accuracy, count="n").collect()}
        assert got.keys() == groups.keys()
        for g, xs in groups.items():
            assert got[g][1] == len(xs)
            if g != "ends":
                assert np.allclose(got[g][0], np.percentile(xs, [100 * p for p in ps]), rtol=1e-12)
        assert got["ends"][0][1] == -np.inf and got["ends"][0][3] == 0.0
    whole = quantiles.exact_quantiles(df, "x", ps, accuracy=100).first()[0]
    assert np.allclose(whole[3], np.median([x for _, x in data if x is not None]))
    scaled = sequence.robust_scale(df, ["g"], "x").where("g = 'ties'").agg(F.min("scaled"), F.max("scaled")).first()
    q = np.percentile(groups["ties"], [25, 50, 75])
    assert np.allclose(list(scaled), [(1 - q[1]) / (q[2] - q[0]), (5 - q[1]) / (q[2] - q[0])])
    assert aggregates.percentile_filter(df, ["g"], "x", 0.5).where("g = 'hot'").count() == 9_000
    assert quantiles.exact_quantiles(df.limit(0), "x", [0.5], ["g"]).collect() == []

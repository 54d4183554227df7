"""Edge cases of the order-dependent and interval operators, on hand-built rows."""

import pytest
from pyspark.sql import functions as F

from tidewater.functions import labels as fixed
from tidewater.functions import messages
from tidewater.operators import aggregates, arrays, enrich, intervals, labels, models, regions, sampling, sequence, stats, triggers, vectors
from tidewater.sources import tables


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_containment_borders(spark):
    trial = spark.createDataFrame([(1, 10.0, 14.0)], "u int, low double, high double")
    events = spark.createDataFrame([(1, "A", 10.0, 10.2), (1, "B", 10.1, 14.0), (1, "C", 10.1, 13.9), (1, "N", None, None)], "u int, k string, s double, e double")
    inside = lambda mode, b: [r[0] for r in rows(intervals.contained(events, trial, ["u"], "s", "e", "low", "high", mode, b), "k")]
    for bucket in (1.0, 3.0, 100.0):
        assert inside("strict", bucket) == ["C"]
        assert inside("closed", bucket) == ["A", "B", "C"]
        assert inside("start", bucket) == ["B", "C"]


def test_later_interval_wins(spark):
    trial = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 4.0, 8.0)], "u int, trial int, low double, high double")
    events = spark.createDataFrame([(1, 0, 5.0), (1, 1, 9.0)], "u int, k int, s double")
    assert rows(intervals.assign(events, trial, ["u"], ["k"], "s", "s", "low", "high", bucket=2.0), "k", "trial") == [(0, 2), (1, 1)]


@pytest.mark.parametrize("bucket", [1.0, 7.0, 1000.0])
def test_asof(spark, bucket):
    left = spark.createDataFrame([(1, t) for t in (-1.0, 0.0, 9.99, 10.0, 25.0)], "u int, t double")
    right = spark.createDataFrame([(1, t, i) for i, t in enumerate((0.0, 10.0, 20.0))], "u int, t double, block int")
    assert rows(intervals.asof(left, right, ["u"], "t", ["block"], bucket=bucket), "t", "block") == sorted([(-1.0, None), (0.0, 0), (9.99, 0), (10.0, 1), (25.0, 2)], key=repr)
    drift = spark.createDataFrame([(1, t) for t in (5.0, 4.9, 11.0)], "u int, t double")
    trial = spark.createDataFrame([(1, 5.0, 5), (1, 10.0, 10)], "u int, t double, trial int")
    assert rows(intervals.asof(drift, trial, ["u"], "t", ["trial"], forward=True, strict=True, bucket=bucket), "t", "trial") == [(11.0, None), (4.9, 5), (5.0, 10)]


def test_runs_and_positions(spark):
    df = spark.createDataFrame([(1, "fix", 0.0), (1, "sac", 0.30), (1, "sac", 0.34), (1, "sac", 0.36), (1, "fix", 0.40), (1, "blink", 0.5), (1, "sac", 0.6), (1, None, 0.7)], "u int, kind string, t double")
    out = sequence.merge_runs(df, ["u"], ["t"], "kind", "sac", "t")
    assert [(r[0], r[1]) for r in out.orderBy("t").select("t", "run_length").collect()] == [(0.0, 1), (0.30, 3), (0.40, 1), (0.5, 1), (0.6, 1), (0.7, 1)]
    assert out.where("t = 0.3").first()["span"] == pytest.approx(0.1)
    seq = sequence.positions(df, ["u"], ["t"], "n", F.col("kind") == "fix")
    assert [tuple(r) for r in seq.orderBy("t").select("n", "n_from_last").collect()] == [(0, -1), (None, None), (None, None), (None, None), (1, 0), (None, None), (None, None), (None, None)]


def test_close_rows_are_judged_in_pairs(spark):
    df = spark.createDataFrame([(1, 1.00, 3.0), (1, 1.01, 5.0), (1, 1.02, 4.0)], "u int, t double, amp double")
    assert rows(sequence.drop_close(df, ["u"], ["t"], "t", 0.02, "amp"), "t") == [(1.01,)]


def test_windows_pad_with_null(spark):
    events = spark.createDataFrame([(1, 0, 1.0), (1, 1, 50.0)], "u int, k int, onset double")
    samples = spark.createDataFrame([(1, 0.8, 8.0), (1, 1.0, 10.0), (1, 1.1, 11.0), (1, 1.2, 12.0)], "u int, t double, v double")
    out = {r["k"]: r["window"] for r in intervals.windows(events, samples, ["u"], ["k"], "onset", "t", "v", 2, 4, 0.1, 10.0).collect()}
    assert out[0] == [8.0, None, 10.0, 11.0] and out[1] in (None, [None] * 4)


def test_blocks_and_water_fill(spark):
    blocks = triggers.session_blocks(spark.createDataFrame([(1,), (2,), (6,), (7,)], "session int")).groupBy("session").agg(F.min("block"), F.max("block"))
    assert rows(blocks, *blocks.columns) == [(1, 1, 10), (2, 11, 24), (6, 67, 80), (7, 81, 94)]
    caps = spark.createDataFrame([("a", 1), ("b", 5), ("c", 5), ("d", 0)], "k string, cap long")
    assert rows(sampling.water_fill(caps, "k", "cap", 7), "k", "take") == [("a", 1), ("b", 3), ("c", 3), ("d", 0)]


def test_rank_transform_and_false_discovery(spark):
    m = spark.createDataFrame([("a", "b", 0.2), ("a", "c", 0.5), ("b", "c", 0.5)], "i string, j string, d double")
    assert {(r["i"], r["j"]): r["r"] for r in vectors.rank_transform(m).collect()}[("c", "a")] == 2.5
    q = stats.false_discovery(spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, 0.5)], "k int, p double"), "p", ["k"])
    assert [round(r["q"], 6) for r in q.orderBy("k").collect()] == [0.04, 0.053333, 0.053333, 0.5]


def test_tables_and_predicates(spark, tmp_path):
    df = spark.createDataFrame([(1, "dog", [1.0, 2.0, 3.0]), (2, None, [4.0, 5.0, 6.0]), (3, "cat", None)], "id int, label string, x array<double>")
    tables.write_table(df, f"{tmp_path}/t.parquet")
    tables.write_table(df.select("id", "label"), f"{tmp_path}/t.csv")
    assert tables.read_table(spark, f"{tmp_path}/t.csv").count() == 3
    with pytest.raises(ValueError):
        tables.read_table(spark, f"{tmp_path}/t.json")
    assert tables.read_or_empty(spark, f"{tmp_path}/none.parquet", "id int").count() == 0
    q = tables.CatalogQuery(tables.read_table(spark, f"{tmp_path}/t.parquet"), "x")
    assert rows(q.where("label == 'dog'").load(picks=[2, 0]), "id", "x") == [(1, [3.0, 1.0])]
    assert rows(q.where("label != 'dog'").load(decimate=2), "id", "x") == [(2, [4.0, 6.0]), (3, None)]
    assert rows(q.where("id in @ids and label in ['dog', 'cat']", ids=[1, 2]).metadata(), "id") == [(1,)]
    assert rows(q.only(label=None, id=3).metadata(), "id") == [(3,)]


def test_long_and_short_intervals(spark):
    """Intervals of very unequal lengths: the same pairs, and no interval of more than ten rows."""
    trial = spark.createDataFrame([(1, k, float(k), float(k) + 0.5) for k in range(50)] + [(1, 100, 0.0, 1e6), (1, 101, 5.0, 3000.0)], "u int, trial int, low double, high double")
    events = spark.createDataFrame([(1, t) for t in (0.25, 3.1, 7.7, 2999.0, 5e5, 2e6)], "u int, s double")
    got = rows(intervals.contained(events, trial, ["u"], "s", "s", "low", "high", "closed", 1.0), "s", "trial")
    assert got == sorted([(0.25, 0), (0.25, 100), (3.1, 3), (3.1, 100), (7.7, 100), (7.7, 101), (2999.0, 100), (2999.0, 101), (5e5, 100)], key=repr)


def test_events_that_begin_early(spark):
    trial = spark.createDataFrame([(1, 10.0, 14.0)], "u int, low double, high double")
    events = spark.createDataFrame([("a", 1, 9.5, 10.06), ("b", 1, 9.5, 10.04), ("c", 1, 8.9, 10.5)], "k string, u int, s double, e double")
    for bucket in (0.5, 1.0, 10.0):
        assert rows(intervals.contained(events, trial, ["u"], "s", "e", "low", "high", "early", bucket), "k") == [("a",)]


def test_adjacent_pairs(spark):
    sac = spark.createDataFrame([(1, 1.0, 1.05), (1, 2.0, 2.05)], "scene int, begin double, stop double")
    fix = spark.createDataFrame([(1, 1.05, 0.25), (1, 2.06, 0.24)], "scene int, begin double, duration double")
    assert rows(intervals.adjacent(sac, fix, ["scene"], "stop", "begin", {"duration": "associated"}), "begin", "associated") == [(1.0, 0.25)]


def test_labels(spark):
    assert len(fixed.rows()) == 183 and fixed.names()[0] == "unlabeled" and fixed.names()[1] == "person" and fixed.names()[92] == "banner" and fixed.names()[182] == "wood"
    ids = spark.createDataFrame([(i,) for i in (0, 1, 12, 91, 92, 182, 183, -1, None)], "c long")
    got = {r["c"]: (r["name"], r["kind"]) for r in labels.with_names(ids, "c").withColumn("kind", labels.kind(F.col("c"))).collect()}
    assert {k: v[1] for k, v in got.items()} == {0: "unlabeled", 1: "thing", 12: "unknown", 91: "unknown", 92: "stuff", 182: "stuff", 183: "unknown", -1: "unknown", None: "unknown"}
    assert got[183][0] == "unknown" and got[-1][0] == "unknown" and got[182][0] == "wood"
    names = spark.createDataFrame([("person",), ("banner",), ("nonexistent",), (None,)], "n string")
    assert rows(labels.with_ids(names, "n"), "n", "class_id") == sorted([("person", 1), ("banner", 92), ("nonexistent", None), (None, None)], key=repr)
    assert tuple(labels.summary(spark).first()) == (183, 80, 91, 11, 1, 90, 92, 182)
    assert len({n for n in fixed.names()}) == 183 and all(fixed.kind(i) in ("unlabeled", "thing", "stuff", "unknown") for i in range(183))
    order = labels.sorted_by_group(spark.createDataFrame([(1, "car"), (2, "person"), (3, "dog"), (4, "cat"), (5, "?")], "k int, name string").withColumn("g", F.lit(1)), ["g"], "name", ["k"])
    assert [r["name"] for r in order.orderBy("position").collect()] == ["dog", "cat", "person", "?", "car"]


STREAM = "session int, seq int, sample long, previous long, code long"


def test_trigger_repair(spark):
    data = [(1, 1, 10, 0, 100), (1, 2, 20, 100, 51), (1, 3, 30, 51, 7), (7, 1, 10, 100, 3), (7, 2, 20, 3, 100), (7, 3, 30, 1081, 3), (5, 1, 10, 100, 110), (5, 2, 20, 113, 110), (6, 1, 5, 100, 117), (6, 2, 9, 100, 1)]
    got = {(r["session"], r["seq"]): (r["previous"], r["code"]) for r in triggers.repair(spark.createDataFrame(data, STREAM), "session", ["seq"]).collect()}
    assert got[1, 2] == (100, 1001) and got[1, 3] == (1001, 7)
    assert got[7, 1] == (100, 1081) and got[7, 2] == (1081, 100) and got[7, 3] == (1081, 3)
    assert got[5, 1] == (100, 1060) and got[5, 2] == (1060, 110)
    assert got[6, 1] == (100, 1067) and got[6, 2] == (1067, 1079)


def test_trials_of_triggers(spark):
    codes = [90, 91, 100, 1011, 5, 101, 90, 100, 1012, 6, 101]
    stream = spark.createDataFrame([(2, k, 10 * k, codes[k - 1] if k else 0, c) for k, c in enumerate(codes)], STREAM)
    found = triggers.check_trials(triggers.segments(stream, "session", ["seq"]), "session", ["seq"])
    assert rows(found, "block", "trial", "issues", "ok", "start_sample", "n_events") == sorted([(11, 5, "", True, 0, 6), (12, 6, "missing codes: [91]", False, 60, 5)], key=repr)
    assert rows(triggers.onsets(stream, "session", ["seq"]), "block", "trial", "onset") == sorted([(11, 5, 35.0), (12, 6, 85.0)], key=repr)
    assert rows(triggers.onsets(stream, "session", ["seq"], timing="block"), "onset") == [(30.0,), (80.0,)]
    assert rows(triggers.trial_of(stream, "session", ["seq"], 101), "sample", "block", "trial") == sorted([(50, 11, 5), (100, 12, 6)], key=repr)
    assert rows(triggers.trial_of(stream, "session", ["seq"], 101, reach=0), "sample") == []


def test_blocks_without_a_code(spark):
    """Block 50 has no code: where a number occurs 14 times, its twelfth stands for it."""
    stream = spark.createDataFrame([(4, k, 10 * k, 1000 if k != 11 else 100, 5) for k in range(14)], STREAM)
    got = triggers.onsets(stream.withColumn("previous", F.when(F.col("seq") == 11, 100).otherwise(F.col("seq") + 1039).cast("long")), "session", ["seq"], timing="trial")
    assert got.where("block = 50").first()["onset"] == 110.0
    assert triggers.onsets(stream.where("seq < 13"), "session", ["seq"]).where("block = 50").isEmpty()


def test_trial_clock_and_numbers(spark):
    df = spark.createDataFrame([(1, 0, "scene", 0.0, 4.2), (1, 1, "microphone", 0.0, 1.1), (1, 2, "caption", 0.52, 0.2), (2, 0, "caption", 0.5, 0.1)], "trial int, k int, kind string, t double, d double")
    got = enrich.trial_clock(df, ["trial"], ["k"], "kind", "t", "d")
    assert [round(r["clock"], 6) for r in got.orderBy("trial", "k").collect()] == [0.0, 4.2, 5.82, 5.5]
    n = spark.createDataFrame([(1, 31), (2, 31)], "session int, trial int")
    assert rows(n.withColumn("t", enrich.session_trial(F.col("trial"), F.col("session"))), "session", "t") == [(1, 31), (2, 1)]


def test_enriched_events(spark):
    kinds = [("fixation", 10.5, 0.2, 0.0), ("saccade", 10.8, 0.02, 5.0), ("saccade", 10.84, 0.02, 6.0), ("fixation", 11.0, 0.3, 0.0), ("blink", 11.5, 0.1, 0.0), ("fixation", 12.0, 0.2, 0.0), ("fixation", 30.0, 0.2, 0.0)]
    events = spark.createDataFrame([(1, i, k, t, t + d, d, a) for i, (k, t, d, a) in enumerate(kinds)], "subject int, event_id int, type string, start_time double, end_time double, duration double, amplitude double")
    trials = spark.createDataFrame([(1, 3, 10.0, 14.0, 77)], "subject int, trial int, onset double, offset double, scene int")
    log = spark.createDataFrame([(1, 3, 2, 5), (1, 3, 9, 9)], "subject int, trial int, block int, trial_per_block int")
    got = {r["event_id"]: r for r in enrich.enrich(events, trials, log, ["subject"], ["event_id"]).collect()}
    assert sorted(got) == [0, 1, 3, 4, 5] and got[0]["scene"] == 77 and got[0]["block"] == 2 and round(got[0]["time_in_trial"], 6) == 0.52
    assert got[1]["multi"] == "first" and round(got[1]["duration"], 6) == 0.2
    assert [got[i]["fix_sequence"] for i in (0, 1, 3, 4, 5)] == [0, None, 1, None, 2] and [got[i]["fix_sequence_from_last"] for i in (0, 3, 5)] == [-2, -1, 0]
    assert got[0]["amplitude_post"] == 5.0 and got[0]["amplitude_pre"] is None and got[3]["amplitude_pre"] == 5.0 and got[3]["amplitude_post"] is None


def test_cleaning(spark):
    df = spark.createDataFrame([("a", "fixation", 0.2, 1024.0), ("b", "fixation", 0.2, 1024.1), ("c", "fixation", 0.2, None), ("d", "fixation", 0.01, 5.0), ("e", "blink", 0.2, 5.0), ("f", "saccade", 0.5, 5.0)], "k string, type string, duration double, mean_gx double")
    assert rows(enrich.clean(df), "k") == [("a",)]
    s = [("A", "saccade", 0.98, 1.0, 0.02, 3.0), ("B", "saccade", 1.01, 1.03, 0.02, 5.0), ("C", "saccade", 1.04, 1.06, 0.02, 4.0), ("N", "fixation", 2.0, 2.1, None, None), ("M", "saccade", 9.0, 9.1, 0.1, None)]
    close = spark.createDataFrame([(1, *x) for x in s], "u int, k string, type string, start_time double, end_time double, duration double, amplitude double")
    assert rows(enrich.without_artifacts(close, ["u"], ["start_time"]), "k") == [("B",), ("M",), ("N",)]
    last = spark.createDataFrame([(1, 0), (2, -1), (3, None)], "k int, fix_sequence_from_last int")
    assert rows(enrich.without_last(last), "k") == [(2,), (3,)]


def test_messages(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    d = value(messages.drift(F.lit("DRIFTCORRECT L LEFT  at 512,384  OFFSET 0.13 deg.  4.0,0.7 pix.")))
    assert tuple(d)[:5] == (512, 384, 0.13, 4.0, 0.7) and abs(d["offset_pix"] - 16.49**0.5) < 1e-12
    assert value(messages.drift(F.lit("nothing"))) is None and value(messages.drift(F.lit(None).cast("string"))) is None
    caps = lambda v: value(messages.captions(F.lit(v).cast("string")))
    assert caps("['a ', '', 'b']") == ["a", "b"] and caps(None) == [] and caps("'x'") == ["x"] and caps("""["it's", 'a, b']""") == ["it's", "a, b"]
    v = value(messages.validation(F.lit("[['VALIDATION', 'HV9', 'L', 'LEFT', '', 'GOOD', 'ERROR', '0.35', 'avg.', '0.52', 'max', ['OFFSET', '0.2', 'deg.', '1.5,-2.5', 'pix.']]]")))
    assert tuple(v) == ("HV9", "LEFT", "GOOD", 0.35, 0.52, 0.2, 1.5, -2.5)
    assert value(messages.validation(F.lit("['CAL']"))) is None
    assert tuple(value(messages.validation(F.lit("['VALIDATION']")))) == ("UNKNOWN", "UNKNOWN", "UNKNOWN", None, None, None, None, None)
    assert value(messages.point_errors(F.lit("[['L', 'POINT', '0', '', 'LEFT', '', 'at', '512,384', '', 'OFFSET', '0.24', 'deg.'], ['POINT', '1', 'OFFSET', '0.5'], ['POINT', '1', 'OFFSET', '0.6']]"))) == {0: 0.24, 1: 0.6}
    assert value(messages.point_errors(F.lit("[]"))) is None
    assert value(messages.vector(F.lit("[0.5 -1e-3 2]"))) == [0.5, -0.001, 2.0] and value(messages.least_number(F.lit("[7.5, 3]"))) == 3.0 and value(messages.first_number(F.lit("12"))) == 12.0
    assert value(messages.kind_of(F.lit("[3, 1]"))) == "microphone" and value(messages.trial_number(F.lit("TRIALID 31"))) == 31
    assert value(messages.style(F.lit(None).cast("boolean"), F.lit(True))) == "other" and value(messages.readable_size(F.lit(2_500_000))) == "2.5 MB"


def test_regions(spark):
    """Overlapping masks, margins of 10 and beyond, points outside, a scene without regions, and masks by run lengths."""
    boxes = spark.createDataFrame([(1, 1, "big", 0, 0, 10, 10), (1, 2, "small", 2, 2, 8, 5)], "scene int, region int, label string, x int, y int, w int, h int")
    runs = regions.runs_of_box(boxes, "x", "y", "w", "h")
    points = spark.createDataFrame([("in", 1, 3, 3), ("big", 1, 0, 0), ("ten", 1, 19, 5), ("far", 1, 20, 5), ("left", 1, -1, 5), ("none", 2, 5, 5), ("null", 1, None, 5)], "k string, scene int, x int, y int")
    got = dict(rows(regions.locate(points, runs, ["k"], "x", "y", 100, 100), "k", "label"))
    assert got == {"in": "small", "big": "big", "ten": "small", "far": "None", "left": "outside", "none": "None", "null": None}
    mask = spark.range(1).select(regions.runs_of_mask(F.array(*map(F.lit, (3, 2, 4, 1, 0, 5))), F.lit(5)).alias("r")).first()["r"]
    assert [tuple(r) for r in mask] == [(3, 2), (9, 1), (10, 5)]
    assert rows(regions.areas(regions.union_of_runs(runs, ["scene"]).withColumn("region", F.lit(0))), "area", "width", "height") == [(100, 10, 10)]


def test_many_regions_over_each_other(spark):
    """Equal to looking at every region, with lines cut over batches; and no side of a join is broadcast, as estimates of
    sizes don't know how many lines a region has."""
    import numpy as np

    rng = np.random.default_rng(4)
    size = rng.integers(1, 15, (300, 2))
    boxes = [(f"s{k % 3}", k, f"l{k % 7}", int(rng.integers(-5, 60)), int(rng.integers(-5, 40)), int(w), int(h)) for k, (w, h) in enumerate(size)] + [("s3", 900, "a", 0, 0, 1, 1), ("s3", 901, "b", 1, 7, 1, 1)]
    asked = [(n // 2, f"s{rng.integers(0, 5)}", int(rng.integers(-2, 90)), int(rng.integers(-2, 70))) for n in range(800)] + [(900, "s3", 8, 8), (901, "s3", 4, 4), (902, None, 4, 4), (903, "s0", None, 4)]
    runs = regions.runs_of_box(spark.createDataFrame(boxes, "scene string, region int, label string, x int, y int, w int, h int"), "x", "y", "w", "h")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = regions.locate(spark.createDataFrame(asked, "k int, scene string, x int, y int"), runs, ["k"], "x", "y", 85, 65)
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        got = rows(found.na.fill(-9), "k", "scene", "x", "y", "region", "label")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)

    def told(scene, x, y):
        if x is None:
            return -9, None
        if not (0 <= x < 85 and 0 <= y < 65):
            return -2, "outside"
        near = [(max(u - x, x - (u + w - 1), 0) ** 2 + max(v - y, y - (v + h - 1), 0) ** 2, w * h, r, name) for s, r, name, u, v, w, h in boxes if s == scene]
        best = min((n for n in near if n[0] <= 100), default=(0, 0, -1, "None"))
        return best[2:]

    want = [(k, s, -9 if x is None else x, y, *told(s, x, y)) for k, s, x, y in asked]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_grids_and_spectra(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    t, v = np.sort(rng.uniform(0, 50, 40)).round(4), rng.normal(size=40)
    df = spark.createDataFrame([(1, float(a), float(b), -1.0, 52.0) for a, b in zip(t, v)], "u int, t double, v double, lo double, hi double")
    for bucket in (3.0, 1000.0):
        got = arrays.on_grid(df, ["u"], "t", "v", "lo", "hi", 0.5, bucket).orderBy("k").collect()
        grid = -1 + 0.5 * np.arange(107)
        want = np.interp(grid, t, v, np.nan, np.nan)
        assert len(got) == 107 and np.allclose([np.nan if r["value"] is None else r["value"] for r in got], want, equal_nan=True)
    x = rng.normal(size=96)
    got = arrays.spectra(spark.createDataFrame([(1, x.tolist()), (2, [1.0])], "k int, x array<double>"), ["k"], "x", 100.0, 32, 16, "median").orderBy("frequency").collect()
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(32) / 32)
    p = [np.abs(np.fft.rfft((x[b : b + 32] - x[b : b + 32].mean()) * w)) ** 2 / (100 * (w * w).sum()) * np.array([1] + [2] * 15 + [1]) for b in range(0, 65, 16)]
    assert len(got) == 17 and np.allclose([r["density"] for r in got], np.median(p, 0))


def test_intervals_of_means(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.exponential(size=300)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("b", i, 2.0) for i in range(5)] + [("c", 0, None)], "g string, i int, v double")
    out = {r["g"]: r for r in stats.bootstrap_mean(df, ["g"], "v", ["i"], 400).collect()}
    half = 1.96 * x.std() / 300**0.5
    assert abs(out["a"]["low"] - (x.mean() - half)) < 0.25 * half and abs(out["a"]["high"] - (x.mean() + half)) < 0.25 * half
    assert out["b"]["low"] == out["b"]["high"] == 2.0 and out["c"]["low"] is None
    means = np.sort([r["mean"] for r in stats.resampled_means(df.where("g = 'a'"), ["g"], "v", ["i"], 400).collect()])
    from statistics import NormalDist

    n = NormalDist()
    z0, a = n.inv_cdf((means < x.mean()).mean()), ((x - x.mean()) ** 3).sum() / (6 * ((x - x.mean()) ** 2).sum() ** 1.5)
    want = [np.percentile(means, 100 * n.cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))) for z in (n.inv_cdf(0.025), n.inv_cdf(0.975))]
    bca = {r["g"]: r for r in stats.bootstrap_bca(df, ["g"], "v", ["i"], 400).collect()}
    assert np.allclose([bca["a"]["low"], bca["a"]["high"]], want) and bca["b"]["low"] == 2.0 and bca["c"]["mean"] is None
    assert abs(stats.chi_square_tail(3.841458820694124, 1) - 0.05) < 1e-9 and abs(stats.chi_square_tail(18.307038053275146, 10) - 0.05) < 1e-9 and stats.chi_square_tail(0, 3) == 1.0


def test_regressions_with_clusters(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    n = 400
    g, a, b = rng.integers(0, 25, n), rng.normal(size=n), rng.normal(size=n)
    y = 1 + 2 * a - b + rng.normal(size=25)[g] + rng.normal(size=n)
    df = spark.createDataFrame([(int(i), float(p), float(q), float(r)) for i, p, q, r in zip(g, a, b, y)], "g int, a double, b double, y double")
    x = np.stack([np.ones(n), a, b], 1)
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    u = np.stack([(x[g == k] * (y - x @ beta)[g == k, None]).sum(0) for k in np.unique(g)])
    k = len(u)
    se = np.sqrt(np.diag(inv @ u.T @ u @ inv) * k / (k - 1) * (n - 1) / (n - 3))
    got = stats.clustered_regression(df, "y", ["a", "b"], "g").collect()
    assert np.allclose([r["coef"] for r in got], beta) and np.allclose([r["se"] for r in got], se)


def test_encoding_and_axes(spark):
    """Coefficients, correlations and axes from summed products equal those on all rows."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)) * [1, 5, 0.1, 2]
    y = x @ rng.normal(size=(4, 2)) + rng.normal(size=(300, 2))
    fold = np.arange(300) % 5
    df = spark.createDataFrame([(int(f), a.tolist(), b.tolist()) for f, a, b in zip(fold, x, y)], "fold int, x array<double>, y array<double>").repartition(3)
    got = models.encode(df, "x", "y", "fold", 0, (1.0, 100.0)).collect()
    train = fold > 0
    mu, sd = x[train].mean(0), x[train].std(0)
    z = (x - mu) / sd
    for r in got:
        w = np.linalg.solve(z[train].T @ z[train] + r["alpha"] * np.eye(4), z[train].T @ (y[train, r["target"]] - y[train, r["target"]].mean()))
        p = z[~train] @ w + y[train, r["target"]].mean()
        assert abs(np.corrcoef(p, y[~train, r["target"]])[0, 1] - r["r"]) < 1e-9 and abs(1 - ((p - y[~train, r["target"]]) ** 2).sum() / ((y[~train, r["target"]] - y[~train, r["target"]].mean()) ** 2).sum() - r["r2"]) < 1e-9
    mean, axes = models.principal_axes(df, "x", 0.9)
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.allclose(mean, x.mean(0)) and len(axes) == np.searchsorted(np.cumsum(values) / values.sum(), 0.9) + 1
    assert np.allclose(np.var((x - mean) @ axes.T, axis=0), values[: len(axes)])
    first = df.select(models.projected(F.col("x"), mean, axes).alias("p"), "x").first()
    assert np.allclose(first["p"], axes @ (np.array(first["x"]) - mean))


def test_decoding_and_clusters(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    centres = np.array([[0, 0], [8, 0], [0, 8]])
    data = [(i, int(i % 3), int(i % 4), (centres[i % 3] + rng.normal(size=2)).tolist()) for i in range(120)]
    df = spark.createDataFrame(data, "id int, label int, fold int, x array<double>")
    got = models.decode(df, "x", "label", "fold", ["id"], 30)
    assert got.count() == 120 and models.macro_accuracy(got, "label").first()[0] > 0.95
    assert all(r["balanced_accuracy"] > 0.95 and r["n"] == 40 for r in models.balanced_accuracy(got, "label").collect())
    best = models.select_clusters(df.withColumn("split", F.col("id") % 2), "x", "split", ["id"], [2, 3, 5]).where("best").collect()
    assert [r["k"] for r in best] == [3]
    curve = models.learning_curve(df, "x", "label", "fold", ["id"], [8, 30])
    assert [r["size"] for r in curve.orderBy("size").collect()] == [8, 30]


def test_matrices(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(6, 3))
    rows_ = spark.createDataFrame([(f"c{k}", v.tolist()) for k, v in enumerate(x)], "c string, v array<double>")
    white = vectors.whitened(rows_, rows_, "v", 0.0)
    inv = np.linalg.inv(np.cov(x.T))
    for r in vectors.dissimilarity(white, "c", "v", metric="euclidean").collect():
        d = x[int(r["i"][1])] - x[int(r["j"][1])]
        assert abs(r["d"] - (d @ inv @ d) ** 0.5) < 1e-9
    square = vectors.dissimilarity(rows_, "c", "v", metric="euclidean")
    at = {}
    for r in vectors.classical_scaling(square, 3).collect():
        at.setdefault(r["key"], [0] * 3)[r["axis"]] = r["value"]
    assert all(abs(np.linalg.norm(np.array(at[r["i"]]) - at[r["j"]]) - r["d"]) < 1e-9 for r in square.collect())
    domain = spark.createDataFrame([("c0", "c1"), ("c0", "c9")], "i string, j string")
    assert sorted((r["j"], r["d"] is None) for r in vectors.dissimilarity(rows_, "c", "v", domain=domain).collect()) == [("c1", False), ("c9", True)]


def test_global_ranks_and_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.integers(0, 20, 300), rng.normal(size=500).round(3) * 9, [7.0] * 200])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(-1, None)], "k int, x double").repartition(5)
    for parts in (3, 50):
        got = {r["k"]: r["rank"] for r in vectors.global_rank(df, "x", parts=parts).collect()}
        assert got.pop(-1) is None and all(got[i] == (x < v).sum() + ((x == v).sum() + 1) / 2 for i, v in enumerate(x))
    ps = [0.0, 0.013, 0.25, 0.5, 0.997, 1.0]
    assert np.allclose(aggregates.exact_quantiles(df, "x", ps).first()[0], np.percentile(x, [100 * p for p in ps]))
    assert aggregates.exact_quantiles(df.limit(0), "x", [0.5]).first()[0] in (None, [None])
    splits = sampling.group_splits(spark.range(1003).withColumnRenamed("id", "g"), "g", 4).groupBy("split").count()
    assert rows(splits, "split", "count") == [(1, 251), (2, 251), (3, 251), (4, 250)]
    folds = sampling.group_folds(df.where("k >= 0").withColumn("g", F.col("k") % 17), "g", 5).groupBy("fold").agg(F.count("*").alias("n"))
    assert len(folds.collect()) == 5 and max(r["n"] for r in folds.collect()) <= 4 * 59
    with pytest.raises(Exception, match="two values"):
        aggregates.pivoted(spark.createDataFrame([(1, "a", 2), (1, "a", 3)], "r int, c string, v int"), "r", "c", "v", ["a"]).collect()
    with pytest.raises(ValueError):
        aggregates.dense_counts(spark.range(10_005).select("id", F.col("id").alias("l")), ["id", "l"])


def test_clusters_of_a_matrix(spark):
    from tidewater.operators import composed

    points = {"a": 0.0, "b": 1.0, "c": 10.0, "d": 11.0, "e": 30.0}
    m = spark.createDataFrame([(i, j, abs(points[i] - points[j])) for i in points for j in points if i < j], "i string, j string, d double")
    assert rows(composed.agglomerate(m, 3), "condition", "cluster") == sorted([("a", 1), ("b", 1), ("c", 2), ("d", 2), ("e", 3)], key=repr)
    with pytest.raises(ValueError):
        composed.samples_in_trials(m, m, ["i"], "d")


@pytest.mark.parametrize("width", [0.3, 2.0, 1000.0])
def test_spread_keys_give_equal_results(spark, width):
    """Inside time buckets or inside the key: the same positions, neighbours, carried values and sessions."""
    import random

    rng = random.Random(9)
    data = [(rng.randrange(3), i, round(rng.uniform(0, 9), 2), rng.choice("abc"), rng.choice([None, 1.0, 2.0])) for i in range(120)]
    df = spark.createDataFrame(data, "u int, i int, t double, k string, v double")
    by, order, is_a, spread = ["u"], ["t", "i"], F.col("k") == "a", ("t", width)
    for f in (
        lambda **s: sequence.positions(df, by, order, "n", is_a, **s),
        lambda **s: sequence.neighbours(df, by, order, ["v", "k"], where=is_a, **s),
        lambda **s: sequence.neighbours(df, by, order, ["v"], **s),
        lambda **s: sequence.carry_forward(df, by, order, "v", is_a, "c", 7.0, **s),
        lambda **s: sequence.sessions(df, by, order, is_a, **s),
    ):
        one, other = f(), f(spread=spread)
        assert sorted(one.columns) == sorted(other.columns)
        assert rows(one, *one.columns) == rows(other, *one.columns)

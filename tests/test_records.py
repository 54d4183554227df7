"""Stored items and annotation files."""

import json

import pytest
from pyspark.sql import functions as F

from tidewater.sources import records


def test_items_and_parameters(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 0, [1.0], [2.0, 3.0]), (1, 2, 0, [4.0], [5.0]), (2, 1, 0, [6.0], [7.0])], "subject int, session int, place int, grad array<double>, mag array<double>")
    a = records.save_items(df, str(tmp_path), "epochs", {"tmin": -0.2, "pick": "grad", "none": None}, "2024-01-01")
    b = records.save_items(df.where("subject = 1"), str(tmp_path), "epochs", {"tmin": -0.5, "pick": "grad"}, "2024-02-01")
    assert a != b and a == records.signature("epochs", {"pick": "grad", "tmin": -0.2}) and a.startswith("epochs_")
    assert [r["name"] for r in records.parameter_sets(spark, str(tmp_path), "epochs").collect()] == [b, a]
    assert [r["name"] for r in records.parameter_sets(spark, str(tmp_path), tmin=-0.2).collect()] == [a]
    assert records.load_items(spark, str(tmp_path), "epochs", pick="grad").count() == 2
    got = records.load_items(spark, str(tmp_path), "epochs", [2], None, tmin=-0.2)
    meta = spark.createDataFrame([(2, 1, 0, "dog"), (9, 9, 9, "cat")], "subject int, session int, place int, label string")
    assert [(r["x"], r["label"]) for r in records.with_metadata(got, meta, ["subject", "session", "place"], ["grad", "mag"]).collect()] == [([6.0, 7.0], "dog")]
    with pytest.raises(FileNotFoundError):
        records.load_items(spark, str(tmp_path), "epochs", tmin=9)
    m = spark.range(1).select(records.merged_parameters(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")), F.lit("now")).alias("m")).first()["m"]
    assert m == {"a": "1", "b": "3", "last_updated": "now"}


def test_logs_and_annotations(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, 1, "113", None), (1, 1, 1, "2021", "heated"), (1, 1, 2, "9", None)], "subject int, session int, run int, channel string, note string")
    assert sorted(r["channel"] for r in records.bad_channels(log, 1, 1, 1).collect()) == ["MEG0113", "MEG2021"]
    assert [r["channel"] for r in records.bad_channels(log, 1, 1, 1, heated=False).collect()] == ["MEG0113"]
    for s in (3, 12):
        (tmp_path / f"sub{s}_events.csv").write_text("type;t\nfix;1.5\n")
    got = records.read_subject_files(spark, f"{tmp_path}/sub*_events.csv", "type string, t double", r"sub(\d+)_", sep=";")
    assert sorted((r["subject"], r["t"]) for r in got.collect()) == [(3, 1.5), (12, 1.5)]
    (tmp_path / "a.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "x", "license": 4, "width": 5, "height": 6, "flickr_url": "u"}, {"id": 2, "license": 1}], "licenses": [{"id": 4, "name": "free"}], "annotations": [{"image_id": 1, "id": 1, "caption": " one "}, {"image_id": 1, "id": 0, "caption": "two"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"annotations": [{"image_id": 1, "id": 9, "caption": "no"}, {"image_id": 2, "id": 8, "caption": "three"}]}))
    assert [(r["id"], r["license_name"], r["split"]) for r in records.annotated_images(spark, f"{tmp_path}/a.json", "val", [4]).collect()] == [(1, "free", "val")]
    scenes = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert {r["id"]: r["captions"] for r in records.captions_of(spark, [f"{tmp_path}/a.json", f"{tmp_path}/b.json"], scenes).collect()} == {1: ["one", "two"], 2: ["three"], 3: []}
    facts = spark.createDataFrame([(1,), (3,)], "id long")
    for dim, text in ((spark.createDataFrame([(1, "a")], "id long, v string"), "no entry for 3"), (spark.createDataFrame([(1, "a"), (3, " ")], "id long, v string"), "an empty entry for 3")):
        with pytest.raises(Exception, match=text):
            records.strict_lookup(facts, dim, "id", "v").collect()

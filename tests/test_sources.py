"""Predicates, scans and sinks, and the content query."""

import pytest
from pyspark.sql import functions as F

from tidewater.sources import predicates, tables


@pytest.fixture(scope="module")
def frame(spark):
    data = [(1, "dog", 1.0, "a@b.c"), (2, None, None, "x in [1]"), (3, "cat", float("nan"), "a != b"), (4, "it's", 4.0, "o'clock"), (5, "dog", 5.0, 'say "no"')]
    return spark.createDataFrame(data, "id int, label string, x double, `odd name` string")


@pytest.mark.parametrize(
    "text, bound, want",
    [
        ("label == 'dog'", {}, [1, 5]),
        ("label != 'dog'", {}, [2, 3, 4]),
        ("x != 4", {}, [1, 2, 3, 5]),
        ("not (x > 1)", {}, [1, 2, 3]),
        ("x >= 4 or id == 2", {}, [2, 4, 5]),
        ("(x > 1) & (id < 5) | label == 'cat'", {}, [3, 4]),
        ("~(label == 'dog') & id > 2", {}, [3, 4]),
        ("1 < id <= 3", {}, [2, 3]),
        ("label in ['dog', 'cat']", {}, [1, 3, 5]),
        ("label not in ['dog', 'cat']", {}, [2, 4]),
        ("label in @some", {"some": ["cat"]}, [3]),
        ("label in @some", {"some": []}, []),
        ("label not in @some", {"some": ()}, [1, 2, 3, 4, 5]),
        ("label in ['dog', None]", {}, [1, 2, 5]),
        ("label == ['dog', 'cat']", {}, [1, 3, 5]),
        ("label == @one", {"one": "it's"}, [4]),
        ("`odd name` == 'x in [1]'", {}, [2]),
        ("`odd name` == 'a != b'", {}, [3]),
        ("`odd name` == 'a@b.c'", {}, [1]),
        ("label == 'it\\'s'", {}, [4]),
        ('`odd name` == "o\'clock"', {}, [4]),
        ("`odd name` == 'say \"no\"'", {}, [5]),
        ("x.isnull()", {}, [2, 3]),
        ("label.notnull() and x.notnull()", {}, [1, 4, 5]),
        ("id % 2 == 1 and abs(id - 3) >= 2", {}, [1, 5]),
        ("id * 2 + 1 > 7 and -id < -3", {}, [4, 5]),
        ("id // 2 == 1", {}, [2, 3]),
        ("label == None", {}, []),
        ("label != None", {}, [1, 2, 3, 4, 5]),
        ("id >= @low and\n id <= @high", {"low": 2, "high": 3}, [2, 3]),
    ],
)
def test_predicates(frame, text, bound, want):
    assert sorted(r[0] for r in frame.where(predicates.predicate(frame, text, **bound)).select("id").collect()) == want


def test_predicates_that_are_not_understood(frame):
    for text in ("label ==", "__import__('os')", "label.upper() == 'DOG'", "id = 3", "lambda: 1", "id in 3", "id + 1", "[i for i in id]"):
        with pytest.raises(ValueError):
            predicates.predicate(frame, text)
    for text in ("nothing == 1", "id == @nothing"):
        with pytest.raises(KeyError):
            predicates.predicate(frame, text)


def test_content_query(spark):
    """Narrowed step by step; only the items that match are joined, in any order; a missing item is an error that names it."""
    catalog = spark.createDataFrame([(f, p, ["dog", "cat"][p % 2], f * 10 + p) for f in range(3) for p in range(4)], "file int, place int, label string, size int")
    items = spark.createDataFrame([(f, p, [float(f), float(p)], "x") for f in range(3) for p in range(4)], "file int, place int, grad array<double>, mag string")
    q = tables.CatalogQuery(catalog, items=items)
    dogs = q.where("label == 'dog'")
    assert len(q) == 12 and len(dogs) == 6 and dogs.files() == 3 and len(dogs.where("size > 10").only(file=1, label=None)) == 1
    got = dogs.where("file == 2").load(picks=["grad"])
    assert got.columns == ["file", "place", "label", "size", "grad"] and sorted(r["grad"] for r in got.collect()) == [[2.0, 0.0], [2.0, 2.0]]
    assert q.load().count() == 12 and dogs.metadata().count() == 6
    lost = tables.CatalogQuery(catalog, items=items.where("not (file = 1 and place = 2)"))
    assert lost.where("file == 0").load().count() == 4
    with pytest.raises(Exception, match="file=1 place=2"):
        lost.load().collect()
    with pytest.raises(ValueError):
        q.where("label == 'bird'").load(must_match=True)


def test_sinks_and_scans(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "a", 1.0), (1, 2, "b", 2.0), (2, 1, "a", 3.0)], "subject int, session int, type string, v double")
    tables.write_rows(df, f"{tmp_path}/e.parquet", ("subject", "session"))
    with pytest.raises(ValueError):
        tables.write_rows(df.limit(0), f"{tmp_path}/none.parquet")
    got = tables.scan_sessions(spark, f"{tmp_path}/e.parquet", [1], None, type=["a", "b"])
    assert sorted(r["v"] for r in got.collect()) == [1.0, 2.0]
    assert [r["v"] for r in tables.scan_sessions(spark, f"{tmp_path}/e.parquet", [2], [1]).collect()] == [3.0]
    for where in ((f"{tmp_path}/e.parquet", [9]), (f"{tmp_path}/nowhere.parquet", [1])):
        with pytest.raises(FileNotFoundError):
            tables.scan_sessions(spark, *where)
    df.toPandas().to_csv(f"{tmp_path}/t.csv")
    assert tables.read_index(spark, f"{tmp_path}/t.csv", "row").columns == ["row", "subject", "session", "type", "v"]
    assert tables.read_table(spark, f"{tmp_path}/t.csv").columns == ["subject", "session", "type", "v"]
    for n in ("00012_x.txt", "7_y.txt", "other.txt"):
        (tmp_path / "files").mkdir(exist_ok=True)
        (tmp_path / "files" / n).write_text("hello")
    assert sorted(tuple(r) for r in tables.scan_files(spark, f"{tmp_path}/files", r"^(\d+)_").select("id", "length").collect()) == [(7, 5), (12, 5)]
    assert tables.read_or_empty(spark, f"{tmp_path}/nowhere.parquet", "a int, b string").columns == ["a", "b"]

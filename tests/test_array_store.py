"""The array store: round trips, what is planned and read, and what is refused."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.sources import array_store, shared
from tidewater.sources.tables import CatalogQuery


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("arrays") / "store")
    i = F.col("id")
    df = spark.range(900).select((i % 3).alias("subject"), F.concat(F.lit("s "), (i % 2).cast("string")).alias("session"), i.alias("place"), F.concat(F.lit("é"), i).alias("name"), (i % 5 == 0).alias("odd"), F.array(i + 0.5, i * 2.0).alias("x"), F.array(F.array(i, i + 1), F.array(i + 2, i + 3), F.array(i, i)).alias("grid"))
    array_store.write_arrays(df.repartition(2), path, ["subject", "session"], chunk=60)
    return path, df


def test_round_trip(spark, stored):
    path, df = stored
    got = array_store.read_arrays(spark, path)
    assert sorted(map(str, got.select(df.columns).collect())) == sorted(map(str, df.collect()))
    assert dict(got.dtypes) == dict(df.dtypes)
    assert array_store.read_arrays(spark, path, rows=7).count() == 900
    array_store.write_arrays(df.where("place < 90"), path + "2", ["subject"])
    array_store.write_arrays(df.where("place < 30"), path + "2", ["subject"])  # replaces
    array_store.write_arrays(df.where("place >= 880"), path + "2", ["subject"], mode="append")
    assert array_store.read_arrays(spark, path + "2", ["place"]).count() == 50


def test_filters_prune_files(spark, stored):
    path, _ = stored
    files = sum(f.endswith(".npz") for _, _, names in os.walk(path) for f in names)
    whole = array_store.read_arrays(spark, path, ["place", "x"])
    assert whole.rdd.getNumPartitions() == files > 12
    some = whole.where("subject = 1 and session = 's 1' and place > 100")
    assert some.rdd.getNumPartitions() == files // 6
    assert sorted(r["place"] for r in some.collect()) == [i for i in range(101, 900) if i % 3 == 1 and i % 2 == 1]
    assert whole.where("subject in (0, 2) and subject >= 2").rdd.getNumPartitions() == files // 3
    assert whole.where("subject = 7").collect() == []
    at = os.path.join(path, "subject=0", "session=s%200")
    stretches = sum(-(-len(np.load(os.path.join(at, f))["place"]) // 10) for f in os.listdir(at) if f.endswith(".npz"))
    assert array_store.read_arrays(spark, path, ["place"], rows=10).where("subject = 0 and session = 's 0'").rdd.getNumPartitions() == stretches >= 15
    assert whole.columns == ["subject", "session", "place", "x"]


def test_catalog_query_through_the_store(spark, stored):
    path, _ = stored
    catalog = spark.range(900).select((F.col("id") % 3).alias("subject"), F.col("id").alias("place"), (F.col("id") % 7).alias("size"))
    q = CatalogQuery(catalog, items=array_store.read_arrays(spark, path, ["place", "x"]).drop("session"), keys=("subject", "place"))
    got = q.where("size == 3 and subject == 2").load(picks=["x"])
    assert {r["place"]: r["x"] for r in got.collect()} == {i: [i + 0.5, i * 2.0] for i in range(900) if i % 7 == 3 and i % 3 == 2}


def test_other_files(spark, tmp_path):
    os.makedirs(tmp_path / "k=1")
    np.savez_compressed(tmp_path / "k=1" / "a.npz", v=np.asfortranarray(np.arange(12).reshape(4, 3)), w=np.arange(4, dtype=np.float32))
    assert [r["v"] for r in array_store.read_arrays(spark, str(tmp_path), rows=3).orderBy("w").collect()] == np.arange(12).reshape(4, 3).tolist()
    np.save(tmp_path / "b.npy", np.arange(6).reshape(3, 2))
    os.remove(tmp_path / "k=1" / "a.npz")
    assert [r["value"] for r in array_store.read_arrays(spark, f"file://{tmp_path}").collect()] == [[0, 1], [2, 3], [4, 5]]
    with pytest.raises(Exception, match="FileNotFound"):
        array_store.read_arrays(spark, str(tmp_path / "none"))
    for bad in ("array(1, null)", "if(id = 0, array(1), array(1, 2))"):
        with pytest.raises(Exception, match="nulls|unequal"):
            array_store.write_arrays(spark.range(2).coalesce(1).select(F.lit(1).alias("k"), F.expr(bad).alias("v")), str(tmp_path / "bad"), ["k"])
    assert not any(f.endswith(".npz") for _, _, names in os.walk(tmp_path / "bad") for f in names)


def test_shared_folders(spark):
    path = shared.folder(spark, "test")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    shared.clear(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)

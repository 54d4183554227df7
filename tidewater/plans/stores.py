"""Queries that store a table in the shared folder and read a part of it back: partitions, arrays, text, sets of items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import array_store, records, shared, tables
from .registry import query, table


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select((i % 4).cast("long").alias("subject"), (i % 3).cast("long").alias("session"), i.cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("x"))


@query("select vec_id % 4 as subject, vec_id % 3 as session, vec_id, label::varchar as label, round(list_sum([v::double for v in embedding]), 5) as total from embeddings where vec_id % 4 = 2 and vec_id % 3 in (0, 1) and vec_id > 10")
def array_store_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as an array store by subject and session; files of other keys are not opened."""
    path = shared.folder(spark, "arrays")
    array_store.write_arrays(_vectors(spark, sf_dir), path, ["subject", "session"])
    some = array_store.read_arrays(spark, path, ["vec_id", "label", "x"], rows=1000).where("subject = 2 and session in (0, 1) and vec_id > 10")
    return some.select("subject", "session", "vec_id", "label", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


@query("select vec_id, round(embedding[1]::double, 5) as first from embeddings where vec_id % 7 = 3 and vec_id % 4 = 1")
def content_query_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog's predicate, then the payload of the matching items out of an array store."""
    path = shared.folder(spark, "arrays")
    rows = _vectors(spark, sf_dir)
    array_store.write_arrays(rows.select("subject", "vec_id", "x"), path, ["subject"])
    catalog = rows.select("subject", "vec_id", (F.col("vec_id") % 7).alias("size"))
    items = array_store.read_arrays(spark, path, ["vec_id", "x"]).where("subject = 1")
    found = tables.CatalogQuery(catalog, items=items, keys=("subject", "vec_id")).where("size == 3 and subject == 1").load(picks=["x"])
    return found.select("vec_id", F.round(F.col("x")[0], 5).alias("first"))


@query("select user_id % 5 as subject, (event_id % 2)::bigint as session, event_type, count(*)::bigint as n, round(sum(value), 4) as total from events where user_id % 5 in (1, 3) and event_id % 2 = 1 group by all")
def stored_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written by subject and session, of which two subjects' one session is scanned."""
    path = f"{shared.folder(spark, 'sessions')}.parquet"
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("subject"), (F.col("event_id") % 2).alias("session"), "event_type", "value")
    tables.write_rows(rows, path, ("subject", "session"))
    some = tables.scan_sessions(spark, path, [1, 3], [1])
    return some.groupBy(F.col("subject").cast("long").alias("subject"), F.col("session").cast("long").alias("session"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("select s_suppkey, s_name, round(s_acctbal, 2) as s_acctbal from supplier")
def stored_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as text with its row index and read again without it."""
    path = f"{shared.folder(spark, 'text')}.csv"
    tables.write_table(table(spark, sf_dir, "supplier").select(F.monotonically_increasing_id().alias("index"), "s_suppkey", "s_name", "s_acctbal"), path)
    got = tables.read_table(spark, path, index_col="index", schema="index long, s_suppkey long, s_name string, s_acctbal double")
    return got.select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal"))


@query("select vec_id % 4 as subject, count(*)::bigint as n, round(sum(embedding[2]::double), 4) as total from embeddings where vec_id % 4 in (0, 3) group by 1")
def stored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of items under their parameters; the newest one that matches is read, for two subjects."""
    path = shared.folder(spark, "items")
    rows = _vectors(spark, sf_dir)
    records.save_items(rows.select("subject", "session", F.col("vec_id").alias("place"), F.lit(0.0).alias("x")), path, "epochs", {"low": 1, "high": 40}, "2024-01-01")
    records.save_items(rows.select("subject", "session", F.col("vec_id").alias("place"), F.col("x")[1].alias("x")), path, "epochs", {"low": 2, "high": 40}, "2024-01-02")
    got = records.load_items(spark, path, "epochs", subjects=[0, 3], high=40)
    return got.groupBy(F.col("subject").cast("long").alias("subject")).agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("total"))

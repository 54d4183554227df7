"""Stored items with their parameters: sets of arrays by session, JSON parameter files, annotation files, CSV logs."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import messages
from . import tables


def signature(kind: str, parameters: Mapping[str, object]) -> str:
    """kind and a digest of the parameters that are not None, in the order of their names: the name of a stored set."""
    import hashlib

    body = json.dumps({k: v for k, v in sorted(parameters.items()) if v is not None}, sort_keys=True)
    return f"{kind}_{hashlib.sha256(body.encode()).hexdigest()[:16]}"


def save_items(items: DataFrame, folder: str, kind: str, parameters: Mapping[str, object], created: str) -> str:
    """Items (subject, session, place, payload columns) as a set of its own under ``folder``, one row an item, by subject and
    session; its parameters go to a JSON table beside it. A set that is there is replaced, its newest parameters win."""
    name = signature(kind, parameters)
    tables.write_rows(items, f"{folder}/items/{name}.parquet", ("subject", "session"))
    row = items.sparkSession.createDataFrame([(name, kind, created, json.dumps(dict(parameters), sort_keys=True, default=str))], "name string, kind string, created string, parameters string")
    row.coalesce(1).write.mode("append").json(f"{folder}/parameters")
    return name


def parameter_sets(spark: SparkSession, folder: str, kind: str | None = None, **equal: object) -> DataFrame:
    """name, kind, created, parameters (a map of texts) of the sets that have the given values, newest first; of several
    entries of one name the newest counts."""
    df = spark.read.schema("name string, kind string, created string, parameters string").json(f"{folder}/parameters")
    df = df.groupBy("name").agg(F.max(F.struct("created", "kind", "parameters")).alias("r")).select("name", "r.kind", "r.created", F.from_json("r.parameters", "map<string,string>").alias("parameters"))
    if kind is not None:
        df = df.where(F.col("kind") == kind)
    for k, v in equal.items():
        df = df.where(F.try_element_at("parameters", F.lit(k)).eqNullSafe(None if v is None else json.dumps(v) if not isinstance(v, str) else v))
    return df.orderBy(F.desc("created"), "name")


def load_items(spark: SparkSession, folder: str, kind: str, subjects: list[int] | None = None, sessions: list[int] | None = None, **equal: object) -> DataFrame:
    """The items of the newest set that matches; FileNotFoundError without one."""
    found = parameter_sets(spark, folder, kind, **equal).limit(1).collect()
    if not found:
        raise FileNotFoundError(f"{folder}: no set of {kind} with {equal}")
    return tables.scan_sessions(spark, f"{folder}/items/{found[0]['name']}.parquet", subjects, sessions)


def with_metadata(items: DataFrame, metadata: DataFrame, keys: list[str], arrays: list[str], name: str = "x") -> DataFrame:
    """Items with their metadata, the named arrays one after the other as one; metadata without an item is left out, items
    without metadata have nulls."""
    joined = items.join(metadata, keys, "left")
    return joined.withColumn(name, F.concat(*[F.col(a) for a in arrays])).drop(*[a for a in arrays if a != name])


def merged_parameters(old: Column, new: Column, at: Column) -> Column:
    """Two maps of texts as one, the new one's entries winning, with the time of the change."""
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k) & (k != "last_updated"))
    return F.map_concat(kept, F.map_filter(new, lambda k, _: k != "last_updated"), F.create_map(F.lit("last_updated"), at))


def bad_channels(log: DataFrame, subject: int, session: int, run: int, heated: bool = True) -> DataFrame:
    """channel ('MEG' and four digits), note of one run's log entries; without those that are only heated, if so asked."""
    some = log.where((F.col("subject") == subject) & (F.col("session") == session) & (F.col("run") == run))
    some = some if heated else some.where(~F.coalesce(F.col("note") == "heated", F.lit(False)))
    return some.select(messages.padded(F.col("channel").cast("long"), 4, "MEG").alias("channel"), "note").distinct()


def read_subject_files(spark: SparkSession, pattern: str, schema: str, key: str, header: bool = True, sep: str = ",") -> DataFrame:
    """All files of a pattern as one table, with subject: the number that ``key`` finds in the file's name."""
    df = spark.read.schema(schema).option("header", header).option("sep", sep).csv(pattern)
    return df.withColumn("subject", F.regexp_extract(F.element_at(F.split(F.input_file_name(), "/"), -1), key, 1).try_cast("long"))


def annotated_images(spark: SparkSession, path: str, split: str, licenses: list[int] | None = None) -> DataFrame:
    """id, file_name, width, height, license_id, license_name, url, split of an annotation file's images; only those under
    the given licences, if any are given."""
    raw = spark.read.option("multiLine", True).schema("images array<struct<id:long,file_name:string,width:long,height:long,license:long,flickr_url:string>>, licenses array<struct<id:long,name:string,url:string>>").json(path)
    images = raw.select(F.explode("images").alias("i")).select("i.id", "i.file_name", "i.width", "i.height", F.col("i.license").alias("license_id"), F.col("i.flickr_url").alias("url"))
    kinds = raw.select(F.explode("licenses").alias("l")).select(F.col("l.id").alias("license_id"), F.col("l.name").alias("license_name"))
    images = images if licenses is None else images.where(F.col("license_id").isin(licenses))
    return images.join(kinds, "license_id", "left").withColumn("split", F.lit(split))


def captions_of(spark: SparkSession, paths: list[str], scenes: DataFrame) -> DataFrame:
    """id, captions: of each scene those of the first file that has any, in the file's order; none for scenes in no file.
    ``scenes``: id."""
    schema, out = "annotations array<struct<image_id:long,id:long,caption:string>>", None
    for k, path in enumerate(paths):
        rows = spark.read.option("multiLine", True).schema(schema).json(path).select(F.posexplode("annotations").alias("p", "a")).select(F.col("a.image_id").alias("id"), F.lit(k).alias("file"), "p", F.trim("a.caption").alias("caption"))
        out = rows if out is None else out.unionByName(rows)
    of = out.join(scenes.select("id").distinct(), "id").groupBy("id", "file").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "caption"))), lambda s: s["caption"]).alias("captions"))  # the captions of one scene
    first = of.groupBy("id").agg(F.min_by("captions", "file").alias("captions"))
    return scenes.select("id").distinct().join(first, "id", "left").withColumn("captions", F.coalesce("captions", F.array().cast("array<string>")))


def strict_lookup(df: DataFrame, dim: DataFrame, key: str, value: str) -> DataFrame:
    """``df`` with the dimension's value; a key without one, or with an empty one, is an error that names it."""
    joined = df.join(dim.select(key, F.col(value).alias("__v"), F.lit(True).alias("__there")), key, "left")
    named = lambda text: F.raise_error(F.concat(F.lit(text), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    v = F.when(F.col("__there").isNull(), named("no entry for ")).when(F.coalesce(F.trim(F.col("__v").cast("string")) == "", F.lit(True)), named("an empty entry for ")).otherwise(F.col("__v"))
    return joined.withColumn(value, v).drop("__v", "__there")


def enriched_once(df: DataFrame, key: str, fetch) -> DataFrame:
    """``df`` with what ``fetch`` (a function of a frame of distinct keys to one with more columns) gives; keys that it does
    not return stay, with nulls."""
    return df.join(fetch(df.where(F.col(key).isNotNull()).select(key).distinct()), key, "left")

"""Look-ups and classifications against a small label dimension (class_id, name, kind, group, place), 183 rows by default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as fixed

SCHEMA = "class_id long, name string, kind string, group string, place int"


def dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.rows(), SCHEMA)


def with_names(df: DataFrame, class_id: str, name: str = "name") -> DataFrame:
    """The class name of each id; 'unknown' for ids that no class has (null ids too)."""
    dim = dimension(df.sparkSession).select(F.col("class_id").alias(class_id), F.col("name").alias(name))
    return df.join(F.broadcast(dim), class_id, "left").fillna({name: "unknown"})


def with_ids(df: DataFrame, name: str, class_id: str = "class_id") -> DataFrame:
    """The id of each class name; null for names that no class has."""
    dim = dimension(df.sparkSession).select(F.col("name").alias(name), F.col("class_id").alias(class_id))
    return df.join(F.broadcast(dim), name, "left")


def kind(class_id: Column) -> Column:
    """thing, stuff, unlabeled or unknown, as an expression: no join."""
    known = class_id.between(1, fixed.LAST_THING) & ~class_id.isin(*fixed.MISSING)
    return F.when(class_id == 0, "unlabeled").when(known, "thing").when(class_id.between(fixed.LAST_THING + 1, fixed.LAST_STUFF), "stuff").otherwise("unknown")


def with_groups(df: DataFrame, name: str, group: str = "group", place: str = "place") -> DataFrame:
    """Group of each label and its place in the order of display; labels without a group are 'unknown', placed last."""
    dim = dimension(df.sparkSession).select(F.col("name").alias(name), F.col("group").alias(group), F.col("place").alias(place))
    return df.join(F.broadcast(dim), name, "left").fillna({group: "unknown", place: len(fixed.groups())})


def sorted_by_group(df: DataFrame, by: list[str], name: str, order: list[str]) -> DataFrame:
    """position (from 1) of each row within ``by``: by group, rows of one group in the order they had."""
    ranked = with_groups(df, name)
    return ranked.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy("group", *order)))


def summary(spark: SparkSession) -> DataFrame:
    """One row: number of classes, things, stuff and missing ids, and the first and last id of things and of stuff."""
    is_kind = lambda k: F.col("kind") == k
    edge = lambda f, k: f(F.when(is_kind(k), F.col("class_id")))
    return dimension(spark).agg(
        F.count("*").alias("classes"), F.count_if(is_kind("thing")).alias("things"), F.count_if(is_kind("stuff")).alias("stuff"), F.count_if(is_kind("unknown")).alias("missing"),
        edge(F.min, "thing").alias("first_thing"), edge(F.max, "thing").alias("last_thing"), edge(F.min, "stuff").alias("first_stuff"), edge(F.max, "stuff").alias("last_stuff"),
    )

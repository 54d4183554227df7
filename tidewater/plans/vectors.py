"""Queries over array payloads: medians by label, similarities, dissimilarity matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, vectors
from ..sources.tables import CatalogQuery
from .registry import query, table

PARTS = "parts as (select vec_id, label, unnest(embedding)::double as x, unnest(range(len(embedding)))::int as pos from embeddings)"
MEANS = f"{PARTS}, means as (select label, list(m order by pos) as v from (select label, pos, avg(x) as m from parts group by all) group by 1)"
DISTANCES = f"{MEANS}, d as (select a.label as i, b.label as j, round(1 - (select corr(x, y) from (select unnest(a.v) as x, unnest(b.v) as y)), 6) as d from means a join means b on a.label < b.label)"


def means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label."""
    out = aggregates.elementwise_mean(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return out.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("v"))


@query(f"with {PARTS} select label, pos, round(median(x), 6) as m from parts where label in (1, 2, 3) group by all")
def catalog_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metadata predicate, then the payload's elementwise median by label."""
    rows = CatalogQuery(table(spark, sf_dir, "embeddings"), "embedding").where("label in [1, 2, 3]").load()
    return aggregates.elementwise_median(rows, ["label"], "embedding").select("label", F.posexplode("embedding").alias("pos", "m")).withColumn("m", F.round("m", 6))


@query(f"with {PARTS} select label, pos, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as sd, round(stddev_pop(x) / sqrt(count(*)), 6) as sem, count(*)::bigint as n from parts group by all")
def grand_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.elementwise_mean(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return out.select("label", "pos", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round("sem", 6).alias("sem"), "n")


@query(f"with {MEANS} select vec_id, round(list_cosine_similarity(embedding::double[], v), 6) as cosine from embeddings join means using (label)")
def cosine_to_label_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").join(means(spark, sf_dir), "label").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("v")), 6).alias("cosine"))


@query(f"with {DISTANCES} select * from d")
def dissimilarity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.dissimilarity(means(spark, sf_dir), "label", "v").withColumn("d", F.round("d", 6))


@query(f"with {DISTANCES}, r as (select i, j, rank() over (order by d) + (count(*) over (partition by d) - 1) / 2.0 as r from d) select i, j, r::double as r from r union all select j, i, r::double from r")
def rank_transformed_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.rank_transform(vectors.dissimilarity(means(spark, sf_dir), "label", "v").withColumn("d", F.round("d", 6)))


@query("select vec_id, round(list_max(embedding) - list_min(embedding), 6)::double as peak_to_peak, round(sqrt(list_sum([x::double * x::double for x in embedding[11:30]]) / 20), 6) as rms from embeddings where list_max(embedding) - list_min(embedding) <= 0.8")
def window_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean square over a window of the payload; rows beyond a peak-to-peak bound are rejected."""
    x = F.slice(F.col("embedding").cast("array<double>"), 11, 20)
    peak = F.array_max("embedding") - F.array_min("embedding")
    power = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / F.size(x))
    return table(spark, sf_dir, "embeddings").where(peak <= F.lit(0.8).cast("float")).select("vec_id", F.round(peak, 6).cast("double").alias("peak_to_peak"), F.round(power, 6).alias("rms"))

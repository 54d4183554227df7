"""Queries of items matched to embeddings, encoding by scenes, corrected tests and errors over subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, encoding, stats, vectors
from .analysis import LONG, X, R, vec
from .registry import query, table


@query("""with items as (select event_id, user_id % 7 as subject, event_id % 30 as trial, event_id % 12 as fix_sequence, value / 7 as start_time, event_id % 50 as scene from events),
files as (select event_id as place, user_id % 7 as subject, event_id % 30 as trial, event_id % 12 as fix_sequence, trunc(value / 7 * 1000)::bigint + case when event_id % 9 = 0 then 1 else 0 end as start_ms, event_id % 50 as scene from events),
f as (select subject, trial, fix_sequence, start_ms, scene, min(place) as place from files group by all)
select event_id, place from items i join f on i.subject = f.subject and i.trial = f.trial and i.fix_sequence = f.fix_sequence and trunc(start_time * 1000)::bigint = f.start_ms and i.scene = f.scene""")
def items_matched_to_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and files of embeddings with the same five keys, of which the start is in seconds there and in a name here."""
    i, ms = F.col("event_id"), (F.col("value") / 7 * 1000).cast("long")
    e = table(spark, sf_dir, "events")
    items = e.select("event_id", (F.col("user_id") % 7).alias("subject"), (i % 30).alias("trial"), (i % 12).alias("fix_sequence"), (F.col("value") / 7).alias("start_time"), (i % 50).alias("scene"))
    part = F.concat_ws("_", (F.col("user_id") % 7).cast("string"), (i % 30).cast("string"), (i % 12).cast("string"), (ms + F.when(i % 9 == 0, 1).otherwise(0)).cast("string"), (i % 50).cast("string"))
    files = e.select(F.concat(F.lit("crops/"), part, F.lit(".png")).alias("file"), i.alias("place"))
    return encoding.matched_items(items, files).select("event_id", "place")


@query(f"""with {X}, d as (select vec_id, vec_id % 37 as scene, x[1] as a, x[2] as b, x[5] + 0.5 * x[1] as y from x), o as (select scene, row_number() over (order by md5('4:' || scene), scene) - 1 as r, count(*) over () as n from (select distinct scene from d)),
s as (select d.*, r < ceil(n * 0.2) as held from d join o using (scene)), q as (select quantile_cont(a, [0.25, 0.5, 0.75]) as qa, quantile_cont(b, [0.25, 0.5, 0.75]) as qb, quantile_cont(y, [0.25, 0.5, 0.75]) as qy from s where not held),
z as (select held, (a - qa[2]) / (qa[3] - qa[1]) as a, (b - qb[2]) / (qb[3] - qb[1]) as b, (y - qy[2]) / (qy[3] - qy[1]) as y from s, q),
m as (select count(*) as n, avg(a) as ma, avg(b) as mb, avg(y) as my, regr_sxx(a, a) + 10 as aa, regr_sxx(b, b) + 10 as bb, regr_sxy(a, b) as ab, regr_sxy(y, a) as ay, regr_sxy(y, b) as byy from z where not held),
w as (select *, (bb * ay - ab * byy) / (aa * bb - ab * ab) as wa, (aa * byy - ab * ay) / (aa * bb - ab * ab) as wb from m),
p as (select y, my + wa * (a - ma) + wb * (b - mb) as p from z, w where held)
select 0::int as target, 10.0::double as alpha, round(corr(y, p), 6) as r, round(1 - sum((y - p) ** 2) / (select regr_sxx(y, y) from p), 6) as r2 from p""")
def encoding_by_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One target on two features, scaled robustly and fitted by ridge without the scenes that it is scored on."""
    x = F.col("x")
    df = vec(spark, sf_dir).select("vec_id", (F.col("vec_id") % 37).alias("scene"), F.slice("x", 1, 2).alias("f"), F.array(x[4] + 0.5 * x[0]).alias("y"))
    out = encoding.encode_scenes(df, ["vec_id"], "scene", "f", "y", share=None, alphas=(10.0,), seed=4)
    return out.select("target", "alpha", R(F.col("r"), "r"), R(F.col("r2"), "r2"))


@query("""with t as (select s_suppkey as test, s_nationkey as family, (s_suppkey * 37 % 1000 + 1) / 1001.0::double * abs(s_acctbal) / 10000 as p from supplier), r as (select *, p * count(*) over (partition by family) / row_number() over (partition by family order by p, test) as raw from t)
select test, round(least(1, min(raw) over (partition by family order by p desc, test desc rows unbounded preceding)), 9) as q from r""")
def false_discovery_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted p of tests in families."""
    k = F.col("s_suppkey")
    df = table(spark, sf_dir, "supplier").select(k.alias("test"), F.col("s_nationkey").alias("family"), ((k * 37 % 1000 + 1) / 1001.0 * F.abs("s_acctbal") / 10000).alias("p"))
    return stats.false_discovery(df, "p", ["test"], ["family"]).select("test", F.round("q", 9).alias("q"))


@query(f"with {LONG}, s as (select label, subject, pos, avg(v) as m from parts group by all) select label, pos::int as pos, round(avg(m), 6) as mean, round(stddev_pop(m) / sqrt(count(*)), 6) as sem, count(*)::bigint as subjects from s group by all")
def average_over_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over subjects of their own means, with its standard error."""
    own = aggregates.elementwise_mean(vec(spark, sf_dir), ["label", "subject"], "x")
    each = own.groupBy("label", "subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("m"))
    out = aggregates.elementwise_mean(each, ["label"], "m")
    return out.select("label", "pos", R(F.col("mean"), "mean"), R(F.col("sem"), "sem"), F.col("n").alias("subjects"))


@query("with k as (select event_id, user_id, value from events where value is not null and event_type is not null and user_id is not null), q as (select quantile_cont(value, 0.98) as q from k) select event_id, value from k, q where value <= q")
def complete_below_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that have all three columns, up to the 98th percentile of what is left."""
    some = table(spark, sf_dir, "events").dropna(subset=["value", "event_type", "user_id"])
    return aggregates.percentile_filter(some, [], "value", 0.98).select("event_id", "value")


@query(f"with {X}, m as (select label, avg(x[1]) as a, avg(x[2]) as b from x group by 1), c as (select var_samp(x[1]) as v, var_samp(x[2]) as w, covar_samp(x[1], x[2]) as u, 1e-6 * (var_samp(x[1]) + var_samp(x[2])) / 2 as r from x) select p.label as i, q.label as j, round(sqrt(((w + r) * (p.a - q.a) ** 2 - 2 * u * (p.a - q.a) * (p.b - q.b) + (v + r) * (p.b - q.b) ** 2) / ((v + r) * (w + r) - u * u)), 6) as d from m p join m q on p.label < q.label, c")
def mahalanobis_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of labels' means under the covariance of all rows, of two dimensions."""
    rows = vec(spark, sf_dir).select("label", F.slice("x", 1, 2).alias("x"))
    means = rows.groupBy("label").agg(F.array(F.avg(F.col("x")[0]), F.avg(F.col("x")[1])).alias("x"))
    return vectors.dissimilarity(vectors.whitened(means, rows, "x"), "label", "x", metric="euclidean").withColumn("d", F.round("d", 6))

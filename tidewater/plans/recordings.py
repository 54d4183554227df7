"""Queries of recordings: assembled from events, filtered and resampled, and densities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import recordings
from .registry import query, table

SAMPLES = "samples as (select user_id % 4 as rec, event_id / 100.0 as t, value as gx, case when event_id % 5 <> 0 and event_id > 60 then value * 2 end as gy from events)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("rec"), (i / 100.0).alias("t"), F.col("value").alias("gx"), F.when((i % 5 != 0) & (i > 60), F.col("value") * 2).alias("gy"))


@query(f"""with {SAMPLES}, ends as (select rec, min(t)::double as t0, max(t)::double as t1 from samples group by 1), d as (select rec, t - lag(t) over (partition by rec order by t) as d from samples),
grid as (select rec, t0, rate, ceil(round((t1 - t0) * rate, 6))::bigint as n from ends join (select rec, round(1 / quantile_cont(d::double, 0.5)) as rate from d group by 1) using (rec)),
long as (select rec, 'gx' as channel, t, gx as v from samples where gx is not null union all select rec, 'gy', t, gy from samples where gy is not null),
p as (select rec, channel, round((t::double - t0) * rate, 6) as p, v, n from long join grid using (rec)), l as (select *, lead(p) over w as q, lead(v) over w as u from p window w as (partition by rec, channel order by p)),
c as (select rec, channel, k, v + case when q is null then 0 else (u - v) / (q - p) * (k - p) end as y from l, unnest(range(ceil(p)::bigint, least(n, coalesce(ceil(q)::bigint, floor(p)::bigint + 1)))) r(k))
select rec, channel, max(rate) as rate, max(n)::bigint as n, round(sum(y), 3) as total, round(sum(y * (k % 7)), 3) as mixed from c join grid using (rec) group by all""")
def assembled_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels of unequal beginnings on one grid at the median rate, in chunks of 1,000 samples."""
    out = recordings.assembled(samples(spark, sf_dir), ["rec"], "t", ["gx", "gy"], chunk=1000, spread=("t", 20.0))
    cells = out.select("rec", "channel", "rate", "start", F.posexplode("x").alias("k", "y")).withColumn("k", F.col("k") + F.col("start"))
    return cells.groupBy("rec", "channel").agg(F.max("rate").alias("rate"), F.count("*").alias("n"), F.round(F.sum("y"), 3).alias("total"), F.round(F.sum(F.col("y") * (F.col("k") % 7)), 3).alias("mixed"))


@query(f"with {SAMPLES}, d as (select *, t - lag(t) over (partition by rec order by t) as d from samples), m as (select rec, quantile_cont(d::double, 0.5) as m from d group by 1) select rec, round((t - d)::double, 4) as onset, round(d::double, 4) as duration from d join m using (rec) where d::double > 4.5 * m")
def recording_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches without samples, of four and a half usual steps or more."""
    out = recordings.gaps(samples(spark, sf_dir), ["rec"], "t", 4.5, spread=("t", 20.0))
    return out.select("rec", F.round("onset", 4).alias("onset"), F.round("duration", 4).alias("duration"))


KERNEL = [0.05, -0.1, 0.2, 0.1, 0.5, 0.15, 0.2, -0.2, 0.1, 0.02, -0.03]
RUNS = "s as (select vec_id % 2 as rec, (vec_id // 2) * 64 + unnest(range(64)) as k, unnest(embedding)::double as v from embeddings), h as (select unnest(range({n})) as i, unnest([{taps}]) as w)"
_runs = RUNS.format(n=len(KERNEL), taps=", ".join(map(str, KERNEL)))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select((i % 2).alias("rec"), (F.expr("vec_id div 2") * 64).alias("start"), F.col("embedding").cast("array<double>").alias("x"))


def _long(df: DataFrame) -> DataFrame:
    return df.select("rec", "start", F.posexplode("x").alias("k", "y")).select("rec", (F.col("k") + F.col("start")).cast("long").alias("k"), F.round("y", 6).alias("y"))


@query(f"with {_runs} select a.rec, a.k, round(coalesce(sum(b.v * w), 0), 6) as y from s a left join h on true left join s b on a.rec = b.rec and b.k = a.k - (i - 5) group by a.rec, a.k")
def filtered_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kernel over recordings in chunks of 64 samples, in stretches of 1,000 results."""
    return _long(recordings.resampled(_chunks(spark, sf_dir), ["rec"], "start", "x", KERNEL, width=1000))


@query(f"with {_runs}, e as (select rec, min(k) as a, max(k) as z from s group by 1), m as (select rec, m from e, unnest(range(-(-a * 2 // 3), z * 2 // 3 + 1)) r(m)) select m.rec, m as k, round(coalesce(sum(v * w), 0), 6) as y from m cross join h left join s on s.rec = m.rec and s.k = (m * 3 - i + 5) // 2 and (m * 3 - i + 5) % 2 = 0 group by all")
def resampled_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two samples for three, by the kernel's phases."""
    return _long(recordings.resampled(_chunks(spark, sf_dir), ["rec"], "start", "x", KERNEL, 2, 3, 700))


@query("""with r as (select l_quantity::double as x, l_extendedprice::double as y, l_linenumber::double as w from lineitem), a as (select sum(w) as w, sum(w * w) as w2, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, sum(w * x) / sum(w) as mx, sum(w * y) / sum(w) as my from r),
b as (select a.*, sqrt(vx / (a.w - w2 / a.w)) * pow(a.w * a.w / w2, -1.0 / 6) * 0.5 as hx, sqrt(vy / (a.w - w2 / a.w)) * pow(a.w * a.w / w2, -1.0 / 6) * 0.5 as hy from a, (select sum(r.w * (x - mx) ** 2) as vx, sum(r.w * (y - my) ** 2) as vy from r, a)),
g as (select *, x0 - 3 * hx as xa, (x1 - x0 + 6 * hx) / 24 as dx, y0 - 3 * hy as ya, (y1 - y0 + 6 * hy) / 24 as dy from b),
c as (select least(greatest(floor((x - xa) / dx), 0), 23) as bx, least(greatest(floor((y - ya) / dy), 0), 23) as yb, sum(r.w) as v from r, g group by all)
select i::int as bx, j::int as by, round(sum(v * exp(-0.5 * ((i - bx) * dx / hx) ** 2 - 0.5 * ((j - yb) * dy / hy) ** 2)) / (max(w) * max(hx) * max(hy) * 2 * pi()) * 1e6, 6) as density from c, g, range(24) a(i), range(24) b(j) group by all""")
def density_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted density on a grid, at half the rule's bandwidth (in millionths)."""
    out = recordings.density(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_linenumber", 24, 0.5)
    return out.select("bx", "by", F.round(F.col("density") * 1e6, 6).alias("density"))

"""Queries of regions, traces, matrices, statistics and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, arrays, matrices, models, regions, sampling, sequence, stats, vectors
from .registry import query, table

R = lambda c, name: F.round(c, 6).alias(name)

# Boxes of a scene, and points in it.
BOXES = "boxes as (select p_partkey as region, p_partkey % 40 as scene, p_brand as label, (p_partkey * 37 % 200)::int as x, (p_partkey * 53 % 150)::int as y, (5 + p_size)::int as w, (3 + p_size % 20)::int as h from part)"
POINTS = "points as (select event_id, event_id % 45 as scene, case when event_id % 13 = 0 then null else event_id * 7 % 260 - 10 end as px, event_id * 11 % 180 - 5 as py from events)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(k.alias("region"), (k % 40).alias("scene"), F.col("p_brand").alias("label"), (k * 37 % 200).cast("int").alias("x"), (k * 53 % 150).cast("int").alias("y"), (5 + s).cast("int").alias("w"), (3 + s % 20).cast("int").alias("h"))


@query(f"""with {BOXES}, {POINTS}, near as (select event_id, region, label, w * h as area, sqrt(greatest(x - px, px - (x + w - 1), 0) ** 2 + greatest(y - py, py - (y + h - 1), 0) ** 2) as d from points join boxes using (scene) where px between 0 and 239 and py between 0 and 169),
best as (select event_id, arg_min(struct_pack(r := region, l := label), (d, area, region)) as b from near where d <= 10 group by 1)
select event_id, case when px is null then null when px < 0 or py < 0 or px >= 240 or py >= 170 then -2 else coalesce(b.r, -1) end::bigint as region, case when px is null then null when px < 0 or py < 0 or px >= 240 or py >= 170 then 'outside' else coalesce(b.l, 'None') end as label from points left join best using (event_id)""")
def points_in_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region of each point: a hit, the smallest of several, the nearest within a margin, nothing, or outside."""
    i = F.col("event_id")
    points = table(spark, sf_dir, "events").select("event_id", (i % 45).alias("scene"), F.when(i % 13 != 0, i * 7 % 260 - 10).alias("px"), (i * 11 % 180 - 5).alias("py"))
    out = regions.locate(points, regions.runs_of_box(boxes(spark, sf_dir), "x", "y", "w", "h"), ["event_id"], "px", "py", 240, 170)
    return out.select("event_id", F.col("region").cast("long").alias("region"), "label")


@query(f"""with {BOXES}, cells as (select distinct scene, label, x + i as cx, y + j as cy from boxes, unnest(range(w)) a(i), unnest(range(h)) b(j))
select scene, label, count(*)::bigint as area, min(cx)::int as x, min(cy)::int as y, (max(cx) - min(cx) + 1)::int as width, (max(cy) - min(cy) + 1)::int as height from cells group by all""")
def region_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All regions of one label as one mask: area and bounding box."""
    runs = regions.union_of_runs(regions.runs_of_box(boxes(spark, sf_dir), "x", "y", "w", "h"), ["scene", "label"])
    return regions.areas(runs, "scene", "label").select("scene", "label", "area", "x", "y", "width", "height")


_place = lambda c, most: f"greatest(0, least({most} - 50, round_even({c} - 25, 0)))::int"


@query(f"""with p as (select event_id, value * 3 as x, value * 2 as y from events) select event_id, {_place('x', 240)} as "left", {_place('y', 170)} as top, round_even(x - 25, 0) >= 0 and round_even(y - 25, 0) >= 0 and round_even(x - 25, 0) + 50 <= 240 and round_even(y - 25, 0) + 50 <= 170 as inside from p""")
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares around points: moved into the image, and whether they lay in it."""
    x, y = F.col("value") * 3, F.col("value") * 2
    box, strict = regions.crop_box(x, y, 50, 240, 170), regions.crop_box(x, y, 50, 240, 170, clamp=False)
    return table(spark, sf_dir, "events").select("event_id", box["left"].alias("left"), box["top"].alias("top"), strict.isNotNull().alias("inside"))


X = "x as (select vec_id, label, vec_id % 4 as subject, [v::double for v in embedding] as x from embeddings)"
LONG = f"{X}, parts as (select vec_id, label, subject, unnest(x) as v, unnest(range(64)) as pos from x)"


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 4).alias("subject"), F.col("embedding").cast("array<double>").alias("x"))


@query(f"with {X}, p as (select vec_id, list_avg([abs(v) for v in x[11:30]]) as m, list_max([abs(v) for v in x[11:30]]) as top, sqrt(list_avg([v * v for v in x[11:30]])) as r, sqrt(list_avg([v * v for v in x[1:10]])) as base from x) select vec_id, round(m, 6) as mean, round(top, 6) as most, round((r - base) / base, 6) as change from p")
def source_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and greatest size over a window, and the relative change of its root mean square."""
    df = arrays.window_power(vec(spark, sf_dir), "x", 10, 30, "rms", (0, 10), "change")
    w = arrays.window(F.col("x"), 10, 30)
    return df.select("vec_id", R(arrays.power(w), "mean"), R(arrays.power(w, "max"), "most"), R(F.col("change"), "change"))


@query(f"with {X}, c as (select label, subject, avg(list_avg(x[11:30]) - list_avg(x[1:10])) as code from x group by all), s as (select label, avg(code) as m, stddev_pop(code) as s from c group by 1) select label, subject, round(case when s > 0 then (code - m) / s else 0 end, 6) as code from c join s using (label)")
def population_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = arrays.population_codes(vec(spark, sf_dir), "label", "subject", "x", 10, 30, (0, 10), standardise=True)
    return out.withColumn("code", F.round("code", 6))


@query(f"with {LONG}, r as (select vec_id, max(abs(v)) as p from parts group by 1), b as (select label, arg_max(vec_id, (p, -vec_id)) as vec_id from r join (select distinct vec_id, label from parts) using (vec_id) group by 1) select p.label, pos::int as pos, round(avg(p.v), 6) as mean, round(any_value(s.v), 6) as strongest from parts p join (select label, pos, v from parts semi join b using (vec_id)) s using (label, pos) group by all")
def region_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region's mean trace beside that of its strongest vertex."""
    a = arrays.region_traces(vec(spark, sf_dir), [], "label", "vec_id", "x").select("label", F.posexplode("x").alias("pos", "mean"))
    b = arrays.region_traces(vec(spark, sf_dir), [], "label", "vec_id", "x", "strongest").select("label", F.posexplode("x").alias("pos", "strongest"))
    return a.join(b, ["label", "pos"]).select("label", "pos", R(F.col("mean"), "mean"), R(F.col("strongest"), "strongest"))


@query(f"with {LONG}, d as (select doc_id % 700 as g from documents), m as (select vec_id, pos, v from parts), a as (select g, pos, avg(v) as mean, max(v) as most from (select distinct g from d) join m on vec_id % 700 = g group by all) select g, round(coalesce(min(mean) filter (pos = 3), 0), 6) as mean3, round(coalesce(min(most) filter (pos = 5), 0), 6) as most5, 64::int as size from (select distinct g from d) left join a using (g) group by 1")
def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a group as one; groups without any get zeros."""
    groups = table(spark, sf_dir, "documents").select((F.col("doc_id") % 700).alias("g")).distinct()
    df = groups.join(vec(spark, sf_dir).select((F.col("vec_id") % 700).alias("g"), "x"), "g", "left")
    a, b = arrays.pooled(df, ["g"], "x", 64), arrays.pooled(df, ["g"], "x", 64, "max").withColumnRenamed("x", "y")
    return a.join(b, "g").select("g", R(F.col("x")[3], "mean3"), R(F.col("y")[5], "most5"), F.size("x").alias("size"))


@query(f"with {LONG}, s as (select vec_id, vec_id % 7 / 10.0 as stop from x) select label, pos::int as pos, count(case when pos * 0.01 <= stop then v end)::bigint as n, round(avg(case when pos * 0.01 <= stop then v end), 6) as mean from parts join s using (vec_id) group by all")
def masked_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = arrays.masked_after(vec(spark, sf_dir).withColumn("stop", F.col("vec_id") % 7 / 10), "x", "stop", 0.01)
    return df.select("label", F.posexplode("x").alias("pos", "v")).groupBy("label", "pos").agg(F.count("v").alias("n"), R(F.avg("v"), "mean"))


@query(f"with {LONG}, m as (select label, pos, avg(v) as m from parts where pos between 10 and 50 group by all) select label, arg_max(pos, (m, -pos))::int as pos, round(max(m), 6) as v from m group by 1")
def peak_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vec(spark, sf_dir).select("label", "subject", F.posexplode("x").alias("pos", "v"))
    return arrays.peak(df, ["label"], "pos", "v", (10, 50)).withColumn("v", F.round("v", 6))


@query("select user_id, arg_min(epoch_us(ts), (abs(epoch_us(ts) / 1e6 - 1706000000), epoch_us(ts), event_id))::bigint as us, arg_min(event_id, (abs(epoch_us(ts) / 1e6 - 1706000000), epoch_us(ts), event_id)) as event_id from events group by 1")
def nearest_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")
    return arrays.nearest_time(df.withColumn("t", F.col("us") / 1e6), ["user_id"], "t", 1706000000.0).select("user_id", "us", "event_id")


@query(f"with {LONG}, m as (select label, pos // 16 as layer, avg(v) as m from parts group by all), w as (select label, arg_max(layer, (m, -layer)) as layer, max(m) as best from m group by 1) select label, case when best < 0.01 then -1 else layer end::int as winner, round(best, 6) as best from w")
def layer_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layer of the greatest mean; -1 where that is too small."""
    df = vec(spark, sf_dir).select("label", F.posexplode("x").alias("pos", "v")).select("label", F.floor(F.col("pos") / 16).alias("layer"), "v")
    return arrays.winners(df, ["label"], "layer", "v", 0.01).withColumn("best", F.round("best", 6))


GRID = """s as (select user_id, epoch_us(ts) / 1e6 as t, max(value) as v from events group by all), g as (select user_id, min(t) - 3600 as lo, max(t) + 1800 as hi from s group by 1),
k as (select user_id, lo, unnest(range(0, floor(round((hi - lo) / 86400, 9))::bigint + 1)) as k from g), c as (select user_id, k, lo + k * 86400 as t from k),
b as (select c.user_id, c.k, c.t, s.t as t0, s.v as v0 from c asof left join s on c.user_id = s.user_id and c.t >= s.t), e as (select b.*, s.t as t1, s.v as v1 from b asof left join s on b.user_id = s.user_id and b.t <= s.t)"""


@query(f"with {GRID} select user_id, k::bigint as k, round(t, 3) as t, round(case when t0 is null or t1 is null then null when t1 = t0 then v0 else v0 + (v1 - v0) * (t - t0) / (t1 - t0) end, 4) as value from e")
def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values on a grid of days, by straight lines; null before the first and after the last event."""
    df = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value")
    ends = df.groupBy("user_id").agg((F.min("t") - 3600).alias("lo"), (F.max("t") + 1800).alias("hi"))
    out = arrays.on_grid(df.join(ends, "user_id"), ["user_id"], "t", "value", "lo", "hi", 86400.0, 604800.0)
    return out.select("user_id", "k", F.round("t", 3).alias("t"), F.round("value", 4).alias("value"))


@query("with s as (select user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) over (partition by user_id order by ts) as d from events) select user_id, round(86400 / median(d), 0)::bigint as rate from s group by 1")
def sampling_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 86400).alias("t"))
    return arrays.sampling_rate(df, ["user_id"], "t")


@query(f"""with {X}, seg as (select vec_id, b, x[b + 1 : b + 32] as s from x, (values (0), (16), (32)) t(b)), c as (select vec_id, b, [v - list_avg(s) for v in s] as s from seg),
w as (select vec_id, b, k, sum(v * (0.5 - 0.5 * cos(2 * pi() * i / 32)) * cos(2 * pi() * k * i / 32)) as re, sum(v * (0.5 - 0.5 * cos(2 * pi() * i / 32)) * sin(2 * pi() * k * i / 32)) as im from (select vec_id, b, unnest(s) as v, unnest(range(32)) as i from c), range(0, 17) r(k) group by all)
select vec_id, (k * 100.0 / 32)::double as frequency, round(avg((re * re + im * im) / (100 * 12) * case when k in (0, 16) then 1 else 2 end), 9) as density from w group by vec_id, k""")
def power_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Welch's estimate of the power of each trace."""
    return arrays.spectra(vec(spark, sf_dir), ["vec_id"], "x", 100.0, 32, 16).withColumn("density", F.round("density", 9))


@query(f"with {LONG}, c as (select label, pos, avg(v) as v from parts group by all), s as (select pos, avg(v) as gx, max(v) as gy from parts group by 1) select label, count(*)::bigint as n, round(corr(v, gx), 6) as r_gx, round(corr(v, gy), 6) as r_gy from c join s using (pos) group by 1")
def component_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of components with two signals."""
    parts = vec(spark, sf_dir).select("label", F.posexplode("x").alias("pos", "v"))
    comp = parts.groupBy("label", "pos").agg(F.avg("v").alias("v"))
    out = arrays.component_scores(comp, parts.groupBy("pos").agg(F.avg("v").alias("gx"), F.max("v").alias("gy")), "label", "pos", "v", ["gx", "gy"])
    return out.select("label", "n", R(F.col("r_gx"), "r_gx"), R(F.col("r_gy"), "r_gy"))


@query("with a as (select o_orderstatus as i, o_orderpriority as j, sum(o_totalprice) as c from orders group by all), b as (select o_orderstatus as i, o_orderpriority as j, sum(o_totalprice) as c from orders where o_orderkey % 2 = 0 group by all) select round(sqrt(sum((coalesce(a.c, 0) - coalesce(b.c, 0)) ** 2)) / sqrt(sum(coalesce(a.c, 0) ** 2)), 6) as distance from a full join b using (i, j)")
def covariance_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("i"), F.col("o_orderpriority").alias("j"), F.col("o_totalprice").alias("c"), "o_orderkey")
    cells = lambda d: d.groupBy("i", "j").agg(F.sum("c").alias("c"))
    return arrays.covariance_distance(cells(df), cells(df.where("o_orderkey % 2 = 0"))).withColumn("distance", F.round("distance", 6))


SERIES = f"{LONG}, means as (select subject, pos // 16 as t, label, pos % 16 as e, avg(v) as m from parts group by all), series as (select a.subject, a.t, a.label as i, b.label as j, round(1 - corr(a.m, b.m), 9) as d from means a join means b using (subject, t, e) where a.label < b.label group by all), gm as (select label, pos, avg(v) as m from parts group by all), model as (select a.label as i, b.label as j, round(1 - corr(a.m, b.m), 9) as d from gm a join gm b using (pos) where a.label < b.label group by all)"


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix of labels for each subject and quarter of the vector."""
    parts = vec(spark, sf_dir).select("subject", "label", F.posexplode("x").alias("pos", "v")).groupBy("subject", F.floor(F.col("pos") / 16).alias("t"), "label", (F.col("pos") % 16).alias("e")).agg(F.avg("v").alias("m"))
    rows = parts.groupBy("subject", "t", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("e", "m"))), lambda s: s["m"]).alias("v"))
    return vectors.dissimilarity(rows, "label", "v", ["subject", "t"]).withColumn("d", F.round("d", 9))


def _model(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = aggregates.elementwise_mean(vec(spark, sf_dir), ["label"], "x").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("v"))
    return vectors.dissimilarity(means, "label", "v").withColumn("d", F.round("d", 9))


@query(f"with {SERIES} select subject, t::bigint as t, i, j, round(d, 6) as d from series")
def dissimilarity_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir).withColumn("d", F.round("d", 6))


_rank = lambda c, by: f"rank() over (partition by {by} order by {c}) + (count(*) over (partition by {by}, {c}) - 1) / 2.0"


@query(f"with {SERIES}, b as (select subject, t, s.d as x, m.d as y from series s join model m using (i, j)), r as (select subject, t, {_rank('x', 'subject, t')} as x, {_rank('y', 'subject, t')} as y from b) select subject, t::bigint as t, round(corr(x, y), 6) as rho, count(*)::bigint as n from r group by all")
def model_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of each matrix of the series with the model's."""
    return vectors.matrix_correlation(_series(spark, sf_dir), _model(spark, sf_dir), ["subject", "t"]).withColumn("rho", F.round("rho", 6))


@query(f"""with {SERIES}, names as (select distinct i as c from model union select distinct j from model), o as (select draw, c, row_number() over (partition by draw order by c) as k, row_number() over (partition by draw order by md5('3:' || draw || ':' || c), c) as h from names, range(0, 5) t(draw)),
p as (select a.draw, a.c, b.c as new from o a join o b on a.draw = b.draw and a.k = b.h), m as (select p.draw, least(p.new, q.new) as i, greatest(p.new, q.new) as j, d from model join p on i = p.c join p q on j = q.c and p.draw = q.draw),
b as (select subject, t, draw, s.d as x, m.d as y from series s join m using (i, j)), r as (select subject, t, draw, {_rank('x', 'subject, t, draw')} as x, {_rank('y', 'subject, t, draw')} as y from b) select subject, t::bigint as t, draw::int as draw, round(corr(x, y), 6) as rho from r group by all""")
def permutation_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with models whose conditions are exchanged by seeded permutations."""
    out = matrices.permutation_null(_series(spark, sf_dir), _model(spark, sf_dir), ["subject", "t"], 5, 3)
    return out.select("subject", "t", "draw", R(F.col("rho"), "rho"))


@query(f"with {SERIES}, c as (select a.t, a.subject as p, b.subject as q, corr(a.d, b.d) as r from series a join series b using (t, i, j) where a.subject < b.subject group by all), s as (select t, avg(r) as m, stddev_pop(r) as s from c group by 1) select t::bigint as t, round(greatest(0, m - s), 6) as lower, round(least(1, m + s), 6) as upper from s")
def noise_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.noise_ceiling(_series(spark, sf_dir), "subject", ["t"])
    return out.select("t", R(F.col("lower"), "lower"), R(F.col("upper"), "upper"))


@query(f"with {X}, c as (select a.vec_id // 9 as g, list_cosine_similarity(a.x, b.x) as c from x a join x b on a.vec_id // 9 = b.vec_id // 9 and a.vec_id < b.vec_id) select g, count(*)::bigint as n, round(avg(c), 6) as mean, round(max(c), 6) as most, round(min(c), 6) as least, round(stddev_pop(c), 6) as sd from c group by 1")
def similarity_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of all pairs inside small groups."""
    df = vec(spark, sf_dir).withColumn("g", F.expr("vec_id div 9"))
    out = vectors.similarity_summary(df, ["g"], "vec_id", "x")
    return out.select("g", "n", *[R(F.col(c), c) for c in ("mean", "most", "least", "sd")])


_weights = f"({' + '.join(f'(z >= {c})::int' for c in stats.POISSON)})"


@query(f"""with {SERIES}, own as (select subject, t, i, j, {_rank('d', 'subject, t')} as r from series), sums as (select t, i, j, sum(r) as s, count(*) as n from own group by all),
m as (select o.*, (s - r) / (n - 1) as others, s / n as al from own o join sums using (t, i, j)), k as (select subject, t, r, {_rank('others', 'subject, t')} as others, {_rank('al', 'subject, t')} as al from m),
e as (select subject, t, corr(r, others) as lo, corr(r, al) as up from k group by all), z as (select e.*, draw, ('0x' || substr(md5('1:' || draw || ':' || subject), 1, 8))::bigint / 4294967296.0::double as z from e, range(0, 40) d(draw)),
b as (select t, draw, sum(lo * {_weights}) / sum({_weights}) as lo, sum(up * {_weights}) / sum({_weights}) as up from z group by all having sum({_weights}) > 0),
q as (select t, quantile_cont(lo, 0.025) as a, quantile_cont(lo, 0.975) as b, quantile_cont(up, 0.025) as c, quantile_cont(up, 0.975) as d from b group by 1)
select t::bigint as t, round(avg(lo), 6) as lower, round(avg(up), 6) as upper, round(any_value(a), 6) as lower_low, round(any_value(b), 6) as lower_high, round(any_value(c), 6) as upper_low, round(any_value(d), 6) as upper_high from e join q using (t) group by t""")
def noise_ceiling_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds from each subject's matrix against the mean of the others and of all, with intervals over subjects."""
    out = matrices.noise_ceiling(_series(spark, sf_dir), "subject", ["t"], 40, 1)
    return out.select("t", *[R(F.col(c), c) for c in out.columns[1:]])


@query(f"""with {X}, c as (select label, avg(x[1]) as a, avg(x[2]) as b from x group by 1), n as (select vec_id, vec_id % 8 as part, x, list([(x[1] - c.a) ** 2 + (x[2] - c.b) ** 2, c.rank] order by c.rank) as d from x, (select *, row_number() over (order by label) - 1 as rank from c) c group by all),
k as (select vec_id, part, x, (list_min(d)[2])::int as cluster from n), p as (select a.vec_id, a.part, a.cluster, b.cluster as other, sum(list_distance(a.x, b.x)) as s, count(*) as n from k a join k b using (part) group by all),
m as (select vec_id, part, cluster, max(case when other = cluster then n end) as n, max(case when other = cluster and n > 1 then s / (n - 1) end) as a, min(case when other <> cluster then s / n end) as b from p group by all)
select vec_id, cluster, round(case when b is null then null when n = 1 then 0 when greatest(a, b) > 0 then (b - a) / greatest(a, b) else 0 end, 5) as silhouette from m""")
def silhouettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silhouette of each vector among those of its part, in the clusters of given centres."""
    rows = vec(spark, sf_dir)
    centres = [[r["a"], r["b"]] for r in rows.groupBy("label").agg(F.avg(F.col("x")[0]).alias("a"), F.avg(F.col("x")[1]).alias("b")).orderBy("label").collect()]  # one for each label
    told = rows.select("vec_id", (F.col("vec_id") % 8).alias("part"), "x", models.nearest_centre(F.slice("x", 1, 2), centres).alias("cluster"))
    return matrices.silhouettes(told, ["vec_id"], "x", "cluster", ["part"]).select("vec_id", "cluster", F.round("silhouette", 5).alias("silhouette"))


@query(f"""with {X}, c as (select vec_id % 20 as subject, vec_id % 3 as layer, avg(x[1] + 0.4 * x[2]) + vec_id % 20 * 0.05 + vec_id % 3 * 0.1 as y from x group by subject, layer, vec_id % 20, vec_id % 3),
m as (select *, avg(y) over (partition by subject) as s, avg(y) over (partition by layer) as l, avg(y) over () as g from c), v as (select sum((y - s - l + g) ** 2) / (19 * 2) as e, greatest(0, (sum((s - g) ** 2) / 19 - sum((y - s - l + g) ** 2) / (19 * 2)) / 3) as u from m),
r as (select e, u, case when u > 0 then e else (select sum((y - l) ** 2) / (60 - 3) from m) end as e1 from v), l as (select layer, avg(y) as l from c group by 1)
select 'intercept' as term, round(l, 5) as coef, round(sqrt((e1 + u) / 20), 5) as se from l, r where layer = 0 union all select 'layer ' || layer, round(l - (select l from l where layer = 0), 5), round(sqrt(2 * e1 / 20), 5) from l, r where layer > 0
union all select 'group variance', round(u, 5), null from r union all select 'residual variance', round(e1, 5), null from r""")
def mixed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of layers with a random intercept for each subject. For a full table the estimates have a closed form."""
    subject, layer = F.col("vec_id") % 20, F.col("vec_id") % 3
    cells = vec(spark, sf_dir).groupBy(subject.alias("subject"), layer.alias("layer")).agg(F.avg(F.col("x")[0] + 0.4 * F.col("x")[1]).alias("m"))
    y = cells.withColumn("y", F.col("m") + F.col("subject") * 0.05 + F.col("layer") * 0.1)
    out = matrices.mixed_model(y, "y", {f"layer {k}": F.col("layer") == k for k in (1, 2)}, "subject")
    return out.select("term", F.round("coef", 5).alias("coef"), F.round("se", 5).alias("se"))


_draws = ", ".join(f"({c})" for c in stats.POISSON)
BOOT = f"""u as (select user_id, event_type, avg(value) as v from events group by all), r as (select u.*, draw, ('0x' || substr(md5('0:' || draw || ':' || user_id), 1, 8))::bigint / 4294967296.0::double as z from u, range(0, 50) t(draw)),
w as (select event_type, draw, v, {" + ".join(f"(z >= {c})::int" for c in stats.POISSON)} as w from r), m as (select event_type, draw, sum(v * w) / sum(w) as m from w group by all having sum(w) > 0)"""


@query(f"with {BOOT} select u.event_type, count(v)::bigint as n, round(avg(v), 6) as mean, round(any_value(q.a), 6) as low, round(any_value(q.b), 6) as high from u join (select event_type, quantile_cont(m, 0.025) as a, quantile_cont(m, 0.975) as b from m group by 1) q using (event_type) group by 1")
def event_means_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap interval over users of the mean value by event type, by seeded weights."""
    users = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    out = stats.bootstrap_mean(users, ["event_type"], "v", ["user_id"], 50)
    return out.select("event_type", "n", *[R(F.col(c), c) for c in ("mean", "low", "high")])


@query(f"with {BOOT}, q as (select event_type, quantile_cont(m, 0.025) as a, quantile_cont(m, 0.975) as b from m group by 1), s as (select event_type from u group by 1 having count(distinct user_id) >= 4) select u.event_type, user_id, round(v, 6) as v from u semi join (select * from q where a > 10 or b < 10) k using (event_type) semi join s using (event_type)")
def significant_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the types whose interval leaves out a value of chance."""
    users = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    return stats.significant(users, "event_type", "user_id", "v", 10.0, 4, 50).select("event_type", "user_id", F.round("v", 6).alias("v"))


@query()
def event_means_bca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bias-corrected intervals; the tests compare with NumPy."""
    users = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    return stats.bootstrap_bca(users, ["event_type"], "v", ["user_id"], 400)


@query("""with n as (select o_orderstatus as a, o_orderpriority as b, count(*) as n from orders group by all), e as (select a, b, n, sum(n) over (partition by a) * sum(n) over (partition by b) / sum(n) over () as e from n), c as (select sum((n - e) ** 2 / e) as chi2, (count(distinct a) - 1) * (count(distinct b) - 1) as df from e)
select round(chi2, 6) as chi2, df::bigint as df, round(exp(-chi2 / 2) * list_sum([(chi2 / 2) ** i / factorial(i::int) for i in range(0, df // 2)]), 6) as p from c""")
def chi_square_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With its probability; for an even number of degrees of freedom that is a finite sum."""
    out = stats.chi_square_test(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")
    return out.select(R(F.col("chi2"), "chi2"), "df", R(F.col("p"), "p"))


@query("""with d as (select l_extendedprice as y, l_quantity as x, l_suppkey as g from lineitem), b as (select regr_slope(y, x) as s, regr_intercept(y, x) as i, avg(x) as m, regr_sxx(y, x) as sxx, count(*) as n, count(distinct g) as k from d),
c as (select g, sum((x - m) * (y - i - s * x)) as u from d, b group by 1) select round(any_value(s), 4) as coef, round(sqrt(sum(u * u)) / any_value(sxx) * sqrt(any_value(k / (k - 1.0) * ((n - 1.0) / (n - 2)))), 4) as se from c, b""")
def clustered_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slope with errors clustered by supplier."""
    out = stats.clustered_regression(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"], "l_suppkey")
    return out.where("term = 'l_quantity'").select(F.round("coef", 4).alias("coef"), F.round("se", 4).alias("se"))


@query(f"""with {LONG}, a as (select vec_id, max(abs(v)) as amp from parts group by 1), k as (select vec_id from a where amp < (select quantile_cont(amp, 0.99) from a)), m as (select pos, median(v) as m from parts semi join k using (vec_id) group by 1),
c as (select vec_id, corr(v, m) as r from parts semi join k using (vec_id) join m using (pos) group by 1) select vec_id from c where r > (select quantile_cont(r, 0.01) from c)""")
def typical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without rows of great amplitude, then without those unlike the median pattern."""
    return stats.typical(vec(spark, sf_dir), "vec_id", "x").select("vec_id")


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vec(spark, sf_dir).withColumn("fold", (F.col("vec_id") % 5).cast("int"))
    return df.withColumns({"a": F.slice("x", 1, 12), "b": F.slice("x", 41, 6)})


@query()
def encoding_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge regressions of six targets; the tests compare with closed forms on all rows."""
    return models.encode(_folds(spark, sf_dir), "a", "b", "fold", 0)


@query()
def decoding_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from vectors, each fold by the others, with balanced accuracies."""
    got = models.decode(_folds(spark, sf_dir), "x", "label", "fold", ["vec_id"], 20)
    return models.balanced_accuracy(got, "label")


@query()
def cluster_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of clusters by held-out silhouettes."""
    return models.select_clusters(vec(spark, sf_dir).withColumn("split", F.col("vec_id") % 2), "x", "split", ["vec_id"], [2, 4, 8])


@query("with t as (select event_type from events where event_type <> 'error' group by 1 order by count(*) desc, 1 limit 3), u as (select distinct user_id from events) select user_id, event_type, count(e.event_id)::bigint as n from u cross join t left join events e using (user_id, event_type) group by all")
def top_dense_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.top_dense_counts(table(spark, sf_dir, "events"), "user_id", "event_type", 3, ["error"])


@query("with e as (select user_id, case event_type when 'error' then 'None' when 'signup' then 'outside' else event_type end as label from events) select user_id, count(*)::bigint as n, count(*) filter (label not in ('None', 'outside'))::bigint as labelled, count(*) filter (label = 'None')::bigint as nothing, count(*) filter (label = 'outside')::bigint as outside, round(100.0 * count(*) filter (label not in ('None', 'outside')) / count(*), 6) as labelled_percent, round(100.0 * count(*) filter (label = 'None') / count(*), 6) as nothing_percent, round(100.0 * count(*) filter (label = 'outside') / count(*), 6) as outside_percent, count(distinct case when label not in ('None', 'outside') then label end)::bigint as labels from e group by 1")
def label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("label", F.when(F.col("event_type") == "error", "None").when(F.col("event_type") == "signup", "outside").otherwise(F.col("event_type")))
    out = aggregates.label_report(df, ["user_id"], "label")
    return out.select(*[F.round(c, 6).alias(c) if c.endswith("percent") else F.col(c) for c in out.columns])


@query("with p as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as pos from events), a as (select event_type from p where pos = 0 group by 1 order by count(*) desc, 1 limit 2), b as (select event_type from p where pos > 0 group by 1 order by count(*) desc, 1 limit 2), k as (select * from a union select * from b) select event_type, round(100.0 * count(*) filter (pos = 0) / (select count(*) from p where pos = 0), 6) as first, round(100.0 * count(*) filter (pos > 0) / (select count(*) from p where pos > 0), 6) as later from p semi join k using (event_type) group by 1")
def first_and_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sequence.positions(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "pos")
    out = aggregates.first_and_later(df, "pos", "event_type", 2)
    return out.select("event_type", R(F.col("first"), "first"), R(F.col("later"), "later"))


@query("with v as (select *, case when event_id % 3 > 0 then value end as w from events) select user_id, first(w order by ts, event_id) filter (w is not null) as w, first(event_type order by ts, event_id) as event_type from v group by 1")
def first_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value that is not null, column by column."""
    df = table(spark, sf_dir, "events").withColumn("w", F.when(F.col("event_id") % 3 > 0, F.col("value")))
    return aggregates.first_known(df, ["user_id"], ["ts", "event_id"], ["w", "event_type"])


@query("select user_id, count(*)::bigint as n, round(avg((event_type = 'view')::int), 6) as view, round(avg((event_type = 'click')::int), 6) as click, case when count(*) filter (event_type = 'error') > 3 and max(value) > 90 then 'errors,high' when count(*) filter (event_type = 'error') > 3 then 'errors' when max(value) > 90 then 'high' else 'none' end as flags from events group by 1")
def fractions_and_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    part = aggregates.fractions(df, ["user_id"], "event_type", ["view", "click"])
    more = df.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("e"), F.max("value").alias("m"))
    out = aggregates.flags(part.join(more, "user_id"), {"errors": F.col("e") > 3, "high": F.col("m") > 90})
    return out.select("user_id", "n", R(F.col("view"), "view"), R(F.col("click"), "click"), "flags")


@query("select p::double as point, round((select count(*) filter (o_totalprice <= p) / count(o_totalprice) from orders), 6) as share from (values (1000), (50000), (200000), (1e9)) t(p)")
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.distribution(table(spark, sf_dir, "orders"), "o_totalprice", [1000.0, 50000.0, 200000.0, 1e9])
    return out.withColumn("share", F.round("share", 6))


@query(f"with {LONG}, e as (select quantile_cont(vec_id, [0.25, 0.5, 0.75]) as e from x), b as (select vec_id, len([q for q in e if q <= vec_id]) as bin from x, e) select bin::int as bin, pos::int as pos, round(median(v), 6) as m, any_value(n)::bigint as rows, any_value(md) as median from parts join b using (vec_id) join (select bin, count(*) as n, median(vec_id) as md from b group by 1) using (bin) group by bin, pos")
def quantile_bin_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.quantile_bin_arrays(vec(spark, sf_dir), "vec_id", "x", 4)
    return out.select("bin", F.posexplode("x").alias("pos", "m"), "rows", "median").withColumn("m", F.round("m", 6))


@query("""with h as (select least(floor((l_quantity - 1) / 49 * 10), 9)::bigint as bx, least(floor(l_discount / 0.1 * 10), 9)::bigint as by, count(*) as n from lineitem where l_quantity between 1 and 50 and l_discount between 0 and 0.1 group by all), k as (select d, exp(-0.5 * d * d) / sum(exp(-0.5 * d * d)) over () as w from range(-3, 4) t(d))
select bx + a.d as bx, h."by" + b.d as "by", round(sum(n * a.w * b.w), 6) as density from h, k a, k b group by all""")
def smoothed_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = aggregates.histogram2d(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", (1.0, 50.0), (0.0, 0.1), 10)
    return aggregates.smoothed(h, 1.0).withColumn("density", F.round("density", 6))


@query("select s_nationkey, max(s_acctbal) filter (s_suppkey % 2 = 0) as even, max(s_acctbal) filter (s_suppkey % 2 = 1) as odd from (select *, row_number() over (partition by s_nationkey, s_suppkey % 2 order by s_suppkey) as n from supplier) where n = 1 group by 1")
def pivoted_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "supplier").withColumn("side", F.when(F.col("s_suppkey") % 2 == 0, "even").otherwise("odd"))
    one = df.groupBy("s_nationkey", "side").agg(F.min_by("s_acctbal", "s_suppkey").alias("v"))
    return aggregates.pivoted(one, "s_nationkey", "side", "v", ["even", "odd"])


@query("with r as (select p_partkey, row_number() over (order by p_retailprice, p_partkey) - 1 as r, count(*) over () as n from part) select p_partkey from r where r in (select floor(i * (n - 1) / 9.0 + 0.5) from range(0, 10) t(i))")
def evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.evenly_spaced(table(spark, sf_dir, "part"), "p_retailprice", "p_partkey", 10).select("p_partkey")


@query("with n as (select l_suppkey, count(*) as n from lineitem group by 1), t as (select l_suppkey from n order by n desc, l_suppkey limit 3), r as (select l_suppkey from n order by md5('7:' || l_suppkey), l_suppkey limit 3) select 'top' as how, l_suppkey, count(*)::bigint as n from lineitem semi join t using (l_suppkey) group by all union all select 'random', l_suppkey, count(*) from lineitem semi join r using (l_suppkey) group by all union all select 'specific', l_suppkey, count(*) from lineitem where l_suppkey in (1, 2) group by all")
def chosen_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, out = table(spark, sf_dir, "lineitem").select("l_suppkey"), None
    for how in ("top", "random", "specific"):
        got = sampling.choose(df, "l_suppkey", how, 3, [1, 2], 7).groupBy("l_suppkey").agg(F.count("*").alias("n")).select(F.lit(how).alias("how"), "l_suppkey", "n")
        out = got if out is None else out.unionByName(got)
    return out


@query("with n as (select user_id, count(*) as n from events group by 1), r as (select user_id, (row_number() over (order by n desc, user_id) - 1) % 10 as p from n) select event_id, case when p < 5 then p else 9 - p end::int as fold from events join r using (user_id)")
def balanced_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.group_folds(table(spark, sf_dir, "events"), "user_id", 5).select("event_id", "fold")


@query("with f as (select *, first_value(value) over w as a, first_value(event_id) over w as b from events window w as (partition by user_id order by ts, event_id)) select event_id, round(sqrt((value - a) ** 2 + (event_id - b) ** 2), 6) as d from f")
def displacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.displacement(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["value", "event_id"], "d").select("event_id", F.round("d", 6).alias("d"))


@query(f"with {X}, q as (select vec_id, x[1] as a, x[2] as b, x[3] as c, sqrt(greatest(1 - x[1] ** 2 - x[2] ** 2 - x[3] ** 2, 0)) as w from x) select vec_id, round(degrees(atan2(2 * (w * a + b * c), 1 - 2 * (a * a + b * b))), 5) as roll, round(degrees(asin(greatest(least(2 * (w * b - c * a), 1), -1))), 5) as pitch, round(degrees(atan2(2 * (w * c + a * b), 1 - 2 * (b * b + c * c))), 5) as yaw from q")
def euler_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vec(spark, sf_dir).select("vec_id", *[F.col("x")[k].alias(n) for k, n in enumerate("abc")])
    return sequence.euler_angles(df, "a", "b", "c").select("vec_id", *[F.round(c, 5).alias(c) for c in ("roll", "pitch", "yaw")])


@query("with h as (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events), m as (select user_id, event_type, median(value) as v from h where n <= 3 group by all) select user_id, count(*)::bigint as runs, round(stddev_pop(v), 6) as value_sd from m group by 1")
def repositionings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequence.repositioning(table(spark, sf_dir, "events"), ["user_id"], ["event_type"], ["ts", "event_id"], ["value"], 3)
    return out.select("user_id", "runs", R(F.col("value_sd"), "value_sd"))


@query("select user_id, count(*)::bigint as n, round(stddev_pop(value), 6) as value_sd from events where event_id % 100 / 100.0 >= 0.3 group by 1 having count(*) >= 10")
def stable_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("fit", F.col("event_id") % 100 / 100)
    out = sequence.stability(df, ["user_id"], ["value"], "fit", 0.3)
    return out.select("user_id", "n", R(F.col("value_sd"), "value_sd"))


@query("with d as (select user_id, epoch_us(ts) // 86400000000 as d from events), g as (select user_id, d, d - lag(d) over (partition by user_id order by d) as g from d) select user_id, count(*)::bigint as n, (max(d) - min(d))::bigint as span, median(g) as median, quantile_cont(g, 0.25) as q1, quantile_cont(g, 0.75) as q3, min(g)::bigint as least, max(g)::bigint as most from g group by 1")
def timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.timeline(table(spark, sf_dir, "events"), ["user_id"], "ts")


@query("with c as (select event_id, user_id, ts, event_id % 3 as code from events), p as (select *, coalesce(lag(code) over (partition by user_id order by ts, event_id), 0) as previous from c) select event_id, code, previous from p where code <> previous and code <> 0")
def stimulus_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("code", F.col("event_id") % 3)
    return sequence.edges(df, ["user_id"], ["ts", "event_id"], "code").select("event_id", "code", F.col("previous").cast("long").alias("previous"))

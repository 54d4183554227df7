"""Queries of composed loaders and preparations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import composed
from .analysis import LONG, X, _model, _rank, vec
from .eye import EYE, MARKS, eye, marks
from .registry import query, table

R = lambda c, name: F.round(c, 6).alias(name)


@query(f"""with {EYE}, {MARKS}, h as (select e.event_id, arg_max(struct_pack(t := m.trial, s := m.trial % 3), (m.onset, m."offset", m.trial)) as b from eye e join marks m on e.subject = m.subject and m."offset" is not null and e.start_time between m.onset and m."offset" group by 1) select event_id, b.t::bigint as trial, b.s::bigint as scene from eye left join h using (event_id)""")
def samples_in_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = marks(spark, sf_dir).where("offset is not null").withColumn("scene", F.col("trial") % 3)
    return composed.samples_in_trials(eye(spark, sf_dir), trials, ["subject"], "start_time", 86400.0)[0].select("event_id", "trial", "scene")


@query(f"with {EYE} select event_id, round(sqrt((end_gx - mean_gx) ** 2 + (end_gy - mean_gy) ** 2), 6) as amplitude from eye where type = 'saccade'")
def saccade_amplitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composed.of_kind(eye(spark, sf_dir), "saccade", amplitude=("mean_gx", "mean_gy", "end_gx", "end_gy")).select("event_id", R(F.col("amplitude"), "amplitude"))


@query(f"""with {LONG}, m as (select vec_id, label, pos, case when pos * 0.01 <= (vec_id % 7 + 1) / 10.0 then v end as v from parts), r as (select vec_id, any_value(label) as label, min(v) as lo, max(v) as hi from m group by 1), b as (select label, quantile_cont(lo, 0.02) as a, quantile_cont(hi, 0.98) as b from r group by 1),
k as (select m.* from m join r using (vec_id) join b on b.label = r.label where lo >= a and hi <= b), q as (select label, quantile_cont(v, 0.25) as q1, median(v) as q2, quantile_cont(v, 0.75) as q3 from k group by 1)
select vec_id, round(avg((v - q2) / case when q3 > q1 then q3 - q1 else 1 end), 6) as mean, count(v)::bigint as n from k join q using (label) group by 1""")
def pupil_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vec(spark, sf_dir).withColumn("stop", (F.col("vec_id") % 7 + 1) / 10)
    out = composed.pupil_traces(df, ["label"], "x", "stop", 0.01)
    return out.select("vec_id", F.explode("x").alias("v")).groupBy("vec_id").agg(R(F.avg("v"), "mean"), F.count("v").alias("n"))


@query("with s as (select event_type, avg(value) as m, stddev_pop(value) as s, median(value) as q from events group by 1) select event_id, round((value - m) / s, 6) as standard, round(value - q, 6) as middle from events join s using (event_type)")
def scaled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = composed.scaled(composed.scaled(table(spark, sf_dir, "events"), ["event_type"], "value", "standard", "a"), ["event_type"], "value", "median", "b")
    return out.select("event_id", R(F.col("a"), "standard"), R(F.col("b"), "middle"))


@query("with j as (select c_custkey, c_mktsegment, s_name from customer left join supplier on c_custkey = s_suppkey), r as (select *, row_number() over (partition by c_mktsegment order by md5('4:' || c_custkey), c_custkey) as p from j where s_name is not null and c_custkey % 3 > 0) select c_custkey, c_mktsegment from r where p <= 4")
def complete_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few rows of each group, of those that are complete and allowed."""
    dim = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_name")
    out = composed.examples(table(spark, sf_dir, "customer"), dim, "c_custkey", ["s_name", "not_there"], F.col("c_custkey") % 3 > 0, "c_mktsegment", ["c_custkey"], 4, 4)
    return out.select("c_custkey", "c_mktsegment")


@query("select conv_id, turn, case when trim(t) = '' or t is null then [0.0::double, 0.0::double] else [len(t)::double, 1.0::double] end as embedding from (select conv_id, turn, case turn % 3 when 0 then ' ' when 1 then null else text end as t from conversations)")
def encoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's encoder (here one that gives lengths); blank texts get zeros."""
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, " ").when(F.col("turn") % 3 == 2, F.col("text")).alias("t"))
    return composed.encode_texts(df, "t", lambda c: F.array(F.char_length(c).cast("double"), F.lit(1.0)), 2).select("conv_id", "turn", "embedding")


@query("select event_id, json_extract_string(o, '$.a.b') as b, json_extract_string(o, '$.list[1]') as second, json_extract_string(o, '$.none') as none from (select event_id, '{\"a\": {\"b\": ' || event_id || '}, \"list\": [1, \"' || event_type || '\"]}' as o from events)")
def flat_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string('{"a": {"b": %d}, "list": [1, "%s"]}', "event_id", "event_type")
    df = table(spark, sf_dir, "events").select("event_id", text.alias("o"))
    return composed.flat_json(df, "o", {"b": "$.a.b", "second": "$.list[1]", "none": "$.none"}).drop("o")


@query("select s_suppkey, s_nationkey, round(coalesce(a, 0), 6) as bal from supplier left join (select c_custkey, avg(c_acctbal) as a from customer group by 1) on s_suppkey = c_custkey")
def averaged_on_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_acctbal").alias("bal"))
    return composed.averaged_on(table(spark, sf_dir, "supplier"), df, "s_suppkey", "bal", "s_nationkey").withColumn("bal", F.round("bal", 6))


@query("with d as (select s_nationkey::bigint as subject, s_suppkey % 4 as session, max(case when s_suppkey % 7 = 0 then s_name end) as error from supplier group by all) select subject, session, case when d.session is null then 'pending' when error is not null then 'failed' else 'done' end as status, error from (select s::bigint as subject, t::bigint as session from range(0, 5) a(s), range(0, 4) b(t)) g left join d using (subject, session)".replace("d.session is null", "d.subject is null"))
def status_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("subject"), (F.col("s_suppkey") % 4).alias("session"), F.when(F.col("s_suppkey") % 7 == 0, F.col("s_name")).alias("error"))
    return composed.status_grid(list(range(5)), list(range(4)), done)


NEAR = f"{LONG}, pat as (select pos as place, label, avg(v) as v from parts group by all), nb as (select a.p as place, b.p as other from range(0, 64) a(p), range(0, 64) b(p) where abs(a.p - b.p) <= 4), px as (select nb.place, label, other, v from nb join pat on nb.other = pat.place), sl as (select a.place, a.label as i, b.label as j, 1 - corr(a.v, b.v) as d from px a join px b using (place, other) where a.label < b.label group by all), gm as (select label, pos, avg(v) as m from parts group by all), model as (select a.label as i, b.label as j, round(1 - corr(a.m, b.m), 9) as d from gm a join gm b using (pos) where a.label < b.label group by all)"


def _patches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    patterns = vec(spark, sf_dir).select("label", F.posexplode("x").alias("place", "v")).groupBy("place", "label").agg(F.avg("v").alias("v"))
    a = spark.range(64).select(F.col("id").cast("int").alias("place"))
    near = a.withColumn("other", F.explode(F.sequence(F.greatest(F.col("place") - 4, F.lit(0)), F.least(F.col("place") + 4, F.lit(63)))))
    return patterns, near, _model(spark, sf_dir)


@query(f"with {NEAR}, b as (select place, s.d as x, m.d as y from sl s join model m using (i, j)), r as (select place, {_rank('round(x, 9)', 'place')} as x, {_rank('y', 'place')} as y from b) select place::int as place, round(corr(x, y), 4) as rho, count(*)::bigint as n from r group by 1")
def searchlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's correlation with the patterns in each place's patch."""
    return composed.searchlight(*_patches(spark, sf_dir), "place", "label", "v").withColumn("rho", F.round("rho", 4))


@query(f"""with {NEAR}, names as (select distinct i as c from model union select distinct j from model), o as (select draw, c, row_number() over (partition by draw order by c) as k, row_number() over (partition by draw order by md5('0:' || draw || ':' || c), c) as h from names, range(0, 2) t(draw)),
p as (select a.draw, a.c, b.c as new from o a join o b on a.draw = b.draw and a.k = b.h), m as (select p.draw, least(p.new, q.new) as i, greatest(p.new, q.new) as j, d from model join p on i = p.c join p q on j = q.c and p.draw = q.draw),
b as (select place, draw, s.d as x, m.d as y from sl s join m using (i, j)), r as (select place, draw, {_rank('round(x, 9)', 'place, draw')} as x, {_rank('y', 'place, draw')} as y from b) select place::int as place, draw::int as draw, round(corr(x, y), 4) as rho from r group by all""")
def searchlight_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with permuted models."""
    return composed.searchlight_null(*_patches(spark, sf_dir), "place", "label", "v", 2).withColumn("rho", F.round("rho", 4))


@query(f"with {LONG}, gm as (select label, pos, avg(v) as m from parts group by all), model as (select a.label as i, b.label as j, round(1 - corr(a.m, b.m), 9) as d from gm a join gm b using (pos) where a.label < b.label group by all), o as (select label, row_number() over (order by label * 7 % 5, label) - 1 as k from (select distinct label from x)), bo as (select * from model union all select j, i, d from model) select a.k::int as i_place, b.k::int as j_place, round(d, 6) as d from bo join o a on i = a.label join o b on j = b.label")
def ordered_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = vec(spark, sf_dir).select("label").distinct().withColumn("place", F.col("label") * 7 % 5)
    return composed.ordered_matrix(_model(spark, sf_dir), places, "label", "place").withColumn("d", F.round("d", 6))


@query(f"with {X} select vec_id, round(x[1] + 2 * x[2], 6) as a, round(x[3] - x[64], 6) as b from x")
def unmixed_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [[1.0, 2.0, *[0.0] * 62], [0.0, 0.0, 1.0, *[0.0] * 60, -1.0]]
    return composed.unmixed(vec(spark, sf_dir), [], "x", rows).select("vec_id", R(F.col("x")[0], "a"), R(F.col("x")[1], "b"))


@query(f"with {LONG} select a.vec_id, a.pos::int as pos, round(0.25 * coalesce(max(c.v), 0) + 0.5 * max(a.v) + coalesce(max(b.v), 0), 6) as v from parts a left join parts b on a.vec_id = b.vec_id and b.pos = a.pos - 1 left join parts c on a.vec_id = c.vec_id and c.pos = a.pos + 1 group by a.vec_id, a.pos")
def filtered_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kernel of three taps over each trace."""
    return composed.filtered(vec(spark, sf_dir), "x", [0.25, 0.5, 1.0]).select("vec_id", F.posexplode("x").alias("pos", "v")).withColumn("v", F.round("v", 6))


@query("with l as (select user_id, event_type, sum(value) as s from events group by all), b as (select user_id, event_type, coalesce(sum(s) over (partition by user_id order by event_type rows between unbounded preceding and 1 preceding), 0) as b from l) select event_id, round(value + b, 6) as value from events join b using (user_id, event_type)")
def joined_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    length = df.groupBy("user_id", "event_type").agg(F.sum("value").alias("seconds"))
    return composed.joined_runs(df, ["user_id"], "event_type", "value", length).select("event_id", R(F.col("value"), "value"))

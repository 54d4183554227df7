"""Queries of composed analyses and of lookups that fail loudly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import messages
from ..operators import reports, vectors
from ..sources import records
from . import analysis
from .analysis import LONG, _rank, vec
from .labels_triggers import stream
from .registry import ORACLES, query, table

R = lambda c, name: F.round(c, 6).alias(name)


@query("with v as (select s_suppkey % 10 as subject, s_suppkey * 10.0 as t, s_suppkey % 3 > 0 as valid, s_nationkey / 20.0 as e, ['GOOD', 'FAIR', 'POOR'][s_suppkey % 3 + 1] as q from supplier), r as (select distinct c_nationkey % 10 as subject, (c_custkey % 120 + 0.0) as t, c_custkey % 120 as trial from customer), x as (select v.*, r.trial from v asof left join r on v.subject = r.subject and v.t < r.t) select subject::bigint as subject, t::double as t, case when valid then 'validation' else 'drift' end as event_type, case when valid then q end as quality, round(e, 2)::double as error_deg, trial::bigint as trial, ((trial - 1) // 14 + 1)::bigint as block from x")
def calibration_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages parsed, told apart, and put before the trial that follows."""
    return _calibration(spark, sf_dir).select("subject", "t", "event_type", "quality", "error_deg", "trial", "block")


def _calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, e = F.col("s_suppkey"), F.col("s_nationkey") / 20
    quality = F.element_at(F.array(*map(F.lit, messages.QUALITIES)), (k % 3 + 1).cast("int"))
    text = F.when(k % 3 > 0, F.format_string("['VALIDATION', 'HV9', 'LEFT', '%s', 'ERROR', '%.2f', 'avg.', '9.9', 'max']", quality, e)).otherwise(F.format_string("DRIFTCORRECT L LEFT at 5,5 OFFSET %.2f deg. 3.0,4.0 pix.", e))
    rows = table(spark, sf_dir, "supplier").select((k % 10).alias("subject"), (k * 10.0).alias("t"), text.alias("m"))
    trial = F.col("c_custkey") % 120
    trials = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 10).cast("long").alias("subject"), trial.cast("double").alias("t"), trial.alias("trial")).distinct()
    return reports.calibration_events(rows, trials, ["subject"], "t", "m", 200.0)


@query("""with v as (select s_suppkey % 10 as subject, s_suppkey % 3 > 0 as valid, round(s_nationkey / 20.0, 2)::double as e, ['GOOD', 'FAIR', 'POOR'][s_suppkey % 3 + 1] as q from supplier),
s as (select subject, count(*) filter (valid) as validations, count(*) filter (not valid) as drifts, avg(e) as mean_error, max(e) as most_error, count(*) filter (e > 1) as beyond, count(*) filter (valid and q = 'GOOD') as good, count(*) filter (valid and q = 'FAIR') as fair, count(*) filter (valid and q = 'POOR') as poor from v group by 1),
f as (select *, concat_ws(',', case when validations = 0 then 'no_validation' end, case when poor > 0 then 'poor_validation' end, case when beyond > 0 then 'large_error' end) as f from s)
select subject::bigint as subject, validations::bigint as validations, drifts::bigint as drifts, round(mean_error, 6) as mean_error, most_error, beyond::bigint as beyond, good::bigint as good, fair::bigint as fair, poor::bigint as poor, case when f = '' then 'none' else f end as flags from f""")
def calibration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.calibration_summary(_calibration(spark, sf_dir), ["subject"]).withColumn("mean_error", F.round("mean_error", 6))


@query("with e as (select user_id % 6 as rater, event_type as label from events), n as (select rater, count(*) as n, count(*) filter (label = 'view') as view, count(*) filter (label = 'never') as never from e group by 1), l as (select 'view' as label, view as c, 100.0 * view / n as p from n union all select 'never', never, 100.0 * never / n from n) select label, count(*)::bigint as raters, round(avg(c), 6) as mean_count, round(stddev_samp(c), 6) as sd_count, round(avg(p), 6) as mean_percent, round(stddev_samp(p), 6) as sd_percent from l group by 1")
def rating_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select((F.col("user_id") % 6).alias("rater"), F.col("event_type").alias("label"))
    out = reports.rating_report(df, "rater", "label", ["view", "never"])
    return out.select("label", "raters", *[R(F.col(c), c) for c in out.columns[2:]])


@query("with s as (select case when event_id % 5 > 0 then event_id % 37 end as scene, user_id as trial from events), p as (select avg(c) as m, min(c) as a, max(c) as b from (select trial, count(*) as c from s where scene is not null group by 1)) select count(*)::bigint as samples, count(scene)::bigint as assigned, round(100.0 * count(scene) / count(*), 6) as percent, count(distinct scene)::bigint as scenes, round(any_value(m), 6) as mean_trial, any_value(a)::bigint as least_trial, any_value(b)::bigint as most_trial from s, p")
def assignment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 37).alias("scene"), F.col("user_id").alias("trial"))
    out = reports.assignment_report(df, "scene", "trial")
    return out.withColumns({"percent": F.round("percent", 6), "mean_trial": F.round("mean_trial", 6)})


@query("with k as (select p_brand, p_retailprice as a, case when i = 0 then 'unlabeled' when i between 1 and 91 and i not in (12, 26, 29, 30, 45, 66, 68, 69, 71, 83, 91) then 'thing' when i between 92 and 182 then 'stuff' else 'unknown' end as kind from (select *, p_partkey % 190 as i from part)), g as (select p_brand, kind, count(*) as n, sum(a) as a from k group by all) select p_brand, kind, n::bigint as n, round(100.0 * n / sum(n) over (partition by p_brand), 6) as percent, round(100.0 * a / sum(a) over (partition by p_brand), 6) as area_percent from g")
def kind_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.kind_coverage(table(spark, sf_dir, "part").withColumn("i", F.col("p_partkey") % 190), ["p_brand"], "i", "p_retailprice")
    return out.select("p_brand", "kind", "n", R(F.col("percent"), "percent"), R(F.col("area_percent"), "area_percent"))


@query("with x as (select vec_id, vec_id // 8 as scene, vec_id % 5 = 0 as own, [v::double for v in embedding] as x from embeddings), p as (select a.scene, a.own as o, b.own as q, list_cosine_similarity(a.x, b.x) as c from x a join x b on a.scene = b.scene and a.vec_id < b.vec_id) select scene, round(avg(c) filter (o <> q), 6) as own_mean, round(avg(c) filter (not o and not q), 6) as rest_mean from p group by 1")
def caption_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vec(spark, sf_dir).withColumn("scene", F.expr("vec_id div 8"))
    out = reports.caption_agreement(df, "scene", F.col("vec_id") % 5 == 0, "vec_id", "x")
    return out.select("scene", R(F.col("own_mean"), "own_mean"), R(F.col("rest_mean"), "rest_mean"))


@query(f"""with {LONG}, med as (select label, pos, median(v) as m from parts group by all), s as (select a.pos // 8 as t, a.label as i, b.label as j, round(1 - corr(a.m, b.m), 9) as d from med a join med b using (pos) where a.label < b.label group by all), gm as (select label, pos, avg(v) as m from parts group by all), model as (select a.label as i, b.label as j, round(1 - corr(a.m, b.m), 9) as d from gm a join gm b using (pos) where a.label < b.label group by all),
b as (select t, s.d as x, m.d as y from s join model m using (i, j)), r as (select t, {_rank('x', 't')} as x, {_rank('y', 't')} as y from b) select t::bigint as t, round(corr(x, y), 4) as rho, count(*)::bigint as n from r group by 1""")
def similarity_course(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From traces to the course of a model's rank correlation, in one analysis."""
    out = reports.similarity_course(vec(spark, sf_dir), [], "label", "x", analysis._model(spark, sf_dir), 8)
    return out.withColumn("rho", F.round("rho", 4))


@query("with f as (select *, first_value(value) over w as a from events window w as (partition by user_id, event_type order by ts, event_id)), d as (select user_id, event_type, count(*) as n, avg(abs(value - a)) as m, max(abs(value - a)) as x from f group by all), s as (select user_id, event_type, stddev_pop(value) as s from events where event_id % 100 / 100.0 >= 0.95 group by all having count(*) >= 10) select user_id, event_type, n::bigint as rows, round(m, 6) as mean_distance, round(x, 6) as most_distance, round(s, 6) as value_sd from d left join s using (user_id, event_type)")
def head_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("fit", F.col("event_id") % 100 / 100)
    out = reports.head_movement(df, ["user_id"], ["event_type"], ["ts", "event_id"], ["value"], "fit")
    return out.select("user_id", "event_type", "rows", *[R(F.col(c), c) for c in ("mean_distance", "most_distance", "value_sd")])


@query("with a as (select p_brand, avg(p_size) as a, count(*) as n from part group by 1), r as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as x, rank() over (order by n) + (count(*) over (partition by n) - 1) / 2.0 as y from a) select round(corr(x, y), 6) as rho, count(*)::bigint as n from r")
def accuracy_by_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part")
    acc, n = df.groupBy("p_brand").agg(F.avg("p_size").alias("a")), df.groupBy("p_brand").agg(F.count("*").alias("n"))
    return reports.accuracy_by_frequency(acc, n, "p_brand", "a", "n").select(R(F.col("rho"), "rho"), "n")


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def strict_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup where a missing or empty entry would be an error."""
    dim = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return records.strict_lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), dim, "o_custkey", "c_name").select("o_orderkey", "c_name")


@query("select l_orderkey, l_linenumber, case when l_suppkey % 3 > 0 then s_name end as name from lineitem left join supplier on l_suppkey = s_suppkey")
def enriched_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys are looked up once; those without an answer stay."""
    facts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    known = table(spark, sf_dir, "supplier").where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("name"))
    return records.enriched_once(facts, "l_suppkey", lambda keys: keys.join(known, "l_suppkey")).select("l_orderkey", "l_linenumber", "name")


@query(f"""select session, trials, wrong, collisions from (select session, count(*)::bigint as trials, count(*) filter (not ok)::bigint as wrong from ({ORACLES["trigger_check"]}) group by 1)
join (select session, count(*) filter (collision)::bigint as collisions from ({ORACLES["trigger_audit"]}) group by 1) using (session)""")
def session_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials and codes of each session that are not as expected."""
    codes, checks = reports.audit_session(stream(spark, sf_dir), "session", ["sample"])
    wrong = checks.groupBy("session").agg(F.count("*").alias("trials"), F.count_if(~F.col("ok")).alias("wrong"))
    return wrong.join(codes.groupBy("session").agg(F.count_if("collision").alias("collisions")), "session")


@query()
def encoding_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outliers out, features on their principal axes, ridge regressions; the tests compare its steps with NumPy."""
    df = vec(spark, sf_dir).withColumn("fold", (F.col("vec_id") % 5).cast("int"))
    return reports.encoding(reports.features(df, "x", 0, 24, 2).withColumn("y", F.slice("x", 33, 8)), "vec_id", "features", "y", "fold", 0)


@query("with x as (select vec_id, [v::double for v in embedding] as x from embeddings) select a.vec_id // 20 as scene, a.vec_id, b.vec_id as other, round(sqrt(list_sum([(p[1] - p[2]) ** 2 for p in list_zip(a.x, b.x)])), 6) as d from x a join x b on a.vec_id // 20 = b.vec_id // 20 and a.vec_id < b.vec_id")
def euclidean_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.dissimilarity(vec(spark, sf_dir).withColumn("scene", F.expr("vec_id div 20")), "vec_id", "x", ["scene"], "euclidean")
    return out.select("scene", F.col("i").alias("vec_id"), F.col("j").alias("other"), F.round("d", 6).alias("d"))

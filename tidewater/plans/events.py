"""Queries over the event stream: a user is a subject, an event a gaze event, a signup the begin of a trial."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, intervals, sampling, sequence, stats, triggers
from .registry import query, table

ORDER = ["ts", "event_id"]
#: A key's rows are dealt by weeks, so that a user of very many events is not one task's work.
WEEK = ("ts", 604800.0)
R = lambda c, name: F.round(c, 6).alias(name)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def timed(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Events with t, seconds since 1970."""
    return events(spark, sf_dir).select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), *columns)


def trials(df: DataFrame) -> DataFrame:
    return sequence.spans(df, ["user_id"], ["t", "event_id"], "t", F.col("event_type") == "signup").where("offset is not null")


T = "epoch_us(ts) / 1e6"
TIMED = f"timed as (select *, {T} as t from events)"
TRIALS = f"{TIMED}, trials as (select * from (select user_id, row_number() over w as trial, t as onset, lead(t) over w as \"offset\" from timed where event_type = 'signup' window w as (partition by user_id order by t, event_id)) where \"offset\" is not null)"


@query("""
with p as (select *, row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as pos, lag(value) over (partition by user_id order by ts, event_id) as value_pre from events),
c as (select user_id, event_type, count(*) as n, max(pos) as deepest, avg(value - value_pre) as rise from p group by all)
select event_type, count(*)::bigint as users, round(avg(n), 6) as mean_n, round(stddev_samp(n), 6) as sd_n, max(deepest)::bigint as deepest, round(avg(rise), 6) as mean_rise from c group by event_type""")
def event_sequence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions, neighbours and two-level statistics of ordered event streams."""
    df = events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts", "value")
    df = sequence.neighbours(sequence.positions(df, ["user_id", "event_type"], ORDER, "pos"), ["user_id"], ORDER, ["value"])
    users = df.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("pos").alias("deepest"), F.avg(F.col("value") - F.col("value_pre")).alias("rise"))
    return users.groupBy("event_type").agg(F.count("*").alias("users"), R(F.avg("n"), "mean_n"), R(F.stddev_samp("n"), "sd_n"), F.max("deepest").cast("long").alias("deepest"), R(F.avg("rise"), "mean_rise"))


@query("""
select event_id, case when event_type in ('view', 'click') then row_number() over w - 1 end::bigint as fix, case when event_type in ('view', 'click') then row_number() over w - count(*) over (partition by user_id, event_type in ('view', 'click')) end::bigint as fix_from_last
from events window w as (partition by user_id, event_type in ('view', 'click') order by ts, event_id)""")
def sequence_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequence.positions(events(spark, sf_dir), ["user_id"], ORDER, "fix", F.col("event_type").isin("view", "click"), WEEK)
    return out.select("event_id", F.col("fix").cast("long").alias("fix"), F.col("fix_from_last").cast("long").alias("fix_from_last"))


@query("""
select event_id, lag(case when event_type = 'click' then value end) over w as value_pre, lead(case when event_type = 'click' then value end) over w as value_post from events window w as (partition by user_id order by ts, event_id)""")
def neighbour_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.neighbours(events(spark, sf_dir), ["user_id"], ORDER, ["value"], where=F.col("event_type") == "click", spread=WEEK).select("event_id", "value_pre", "value_post")


@query(f"""
with {TIMED}, m as (select *, case when event_type = 'view' and lag(event_type) over (partition by user_id order by t, event_id) = 'view' then 0 else 1 end as fresh from timed),
r as (select *, sum(fresh) over (partition by user_id order by t, event_id rows unbounded preceding) as run from m),
s as (select *, count(*) over (partition by user_id, run) as run_length from r)
select event_id, user_id, event_type, run_length::bigint as run_length, round(lead(t) over (partition by user_id order by t, event_id) - t, 3) as span from s where fresh = 1""")
def run_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of views become their first row; its span goes to the next row that is kept."""
    out = sequence.merge_runs(timed(spark, sf_dir), ["user_id"], ["t", "event_id"], "event_type", "view", "t")
    return out.select("event_id", "user_id", "event_type", "run_length", F.round("span", 3).alias("span"))


@query("""
select event_id, coalesce(last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 4.0) as carried from events""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.carry_forward(events(spark, sf_dir), ["user_id"], ORDER, "value", F.col("event_type") == "purchase", "carried", 4.0, WEEK).select("event_id", "carried")


@query(f"""
with {TIMED}, w as (select *, lag(t) over k as t0, lead(t) over k as t1, lag(value) over k as v0, lead(value) over k as v1 from timed window k as (partition by user_id order by t, event_id))
select event_id from w where not (coalesce(t - t0 < 3600 and value <= v0, false) or coalesce(t1 - t < 3600 and value < v1, false))""")
def drop_close_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.drop_close(timed(spark, sf_dir, "value"), ["user_id"], ["t", "event_id"], "t", 3600.0, "value").select("event_id")


@query(f"""
with {TRIALS} select e.event_id, e.user_id, i.trial::bigint as trial, round(e.t - i.onset, 3) as time_in_trial from timed e join trials i on e.user_id = i.user_id and e.t > i.onset and e.t < i."offset" """)
def interval_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events strictly inside a trial of their user."""
    df = timed(spark, sf_dir)
    out = intervals.assign(df, trials(df), ["user_id"], ["event_id"], "t", "t", "onset", "offset", bucket=86400.0)
    return out.select("event_id", "user_id", "trial", F.round(F.col("t") - F.col("onset"), 3).alias("time_in_trial"))


@query(f"""
with {TRIALS} select e.event_id, i.trial::bigint as trial from timed e join trials i on e.user_id = i.user_id and e.t >= i.onset and e.t <= i."offset" """)
def interval_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in closed intervals: a border point is in both neighbours."""
    df = timed(spark, sf_dir)
    return intervals.contained(df, trials(df), ["user_id"], "t", "t", "onset", "offset", "closed", 86400.0).select("event_id", "trial")


@query(f"""
with {TRIALS} select i.user_id, i.trial::bigint as trial, count(e.value)::bigint as n, round(avg(e.value), 6) as mean, round(stddev_samp(e.value), 6) as sd from trials i left join timed e on e.user_id = i.user_id and e.t between i.onset and i."offset" group by all""")
def range_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = timed(spark, sf_dir, "value")
    out = intervals.range_aggregate(trials(df), df, ["user_id"], ["user_id", "trial"], "onset", "offset", "t", "value", 86400.0)
    return out.select("user_id", "trial", "n", R(F.col("mean"), "mean"), R(F.col("sd"), "sd"))


@query(f"""
with {TIMED} select e.event_id, coalesce(m.event_id, -1) as marker_id from (select * from timed where event_type <> 'error') e asof left join (select * from timed where event_type = 'error') m on e.user_id = m.user_id and e.t >= m.t""")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = timed(spark, sf_dir)
    marks = df.where("event_type = 'error'").select("user_id", "t", F.col("event_id").alias("marker_id"))
    return intervals.asof(df.where("event_type <> 'error'"), marks, ["user_id"], "t", ["marker_id"]).fillna({"marker_id": -1}).select("event_id", "marker_id")


@query(f"""
with {TIMED} select e.event_id, coalesce(m.event_id, -1) as marker_id from timed e asof left join (select * from timed where event_type = 'error') m on e.user_id = m.user_id and e.t < m.t""")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = timed(spark, sf_dir)
    marks = df.where("event_type = 'error'").select("user_id", "t", F.col("event_id").alias("marker_id"))
    return intervals.asof(df, marks, ["user_id"], "t", ["marker_id"], forward=True, strict=True).fillna({"marker_id": -1}).select("event_id", "marker_id")


@query(f"""
with {TIMED}, s as (select s.event_id, round_even((e.t - (s.t - 86400)) / 43200, 0)::int as i, e.t, e.value from timed s join timed e on s.user_id = e.user_id and e.t >= s.t - 86400 and e.t < s.t + 172800 where s.event_type = 'signup')
select event_id, i::int as place, arg_max(value, t) as v from s where i between 0 and 5 group by all""")
def event_locked_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 6 half days around each signup, as long rows without the empty places."""
    df = timed(spark, sf_dir, "value")
    onsets = df.where("event_type = 'signup'").select("event_id", "user_id", F.col("t").alias("onset"))
    out = intervals.windows(onsets, df, ["user_id"], ["event_id"], "onset", "t", "value", 2, 6, 43200.0, 259200.0)
    return out.select("event_id", F.posexplode("window").alias("place", "v")).where("v is not null")


@query("""
select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 2 preceding and 2 following), 6) as smooth from events""")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.moving_average(events(spark, sf_dir), ["user_id"], ORDER, "value").select("event_id", R(F.col("smooth"), "smooth"))


@query("""
select event_id, row_number() over (partition by user_id order by value, event_id)::bigint as rank, row_number() over (partition by user_id order by value, event_id) > count(*) over (partition by user_id) * 0.9 as rejected from events""")
def ranked_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.ranks(events(spark, sf_dir), ["user_id"], "value", ["event_id"], 0.1).select("event_id", F.col("rank").cast("long").alias("rank"), "rejected")


@query("""
select event_id, ((epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) // 86400000000)::bigint as days from events""")
def days_from_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.days_from_first(events(spark, sf_dir), ["user_id"], "ts").select("event_id", "days")


@query("""
with q as (select event_type, quantile_cont(value, 0.25) as a, quantile_cont(value, 0.5) as m, quantile_cont(value, 0.75) as b from events group by 1)
select event_id, round((value - m) / case when b - a > 0 then b - a else 1 end, 6) as scaled from events join q using (event_type)""")
def robust_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.robust_scale(events(spark, sf_dir), ["event_type"], "value").select("event_id", R(F.col("scaled"), "scaled"))


@query("""
select u.user_id, t.event_type, count(e.event_id)::bigint as n from (select distinct user_id from events) u cross join (select distinct event_type from events) t left join events e using (user_id, event_type) group by all""")
def dense_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.dense_counts(events(spark, sf_dir), ["user_id", "event_type"])


@query("""
with c as (select event_type, user_id, count(*) as c from events group by all)
select event_type, count(*)::bigint as groups, round(avg(c), 6) as mean, round(stddev_samp(c), 6) as sd, round(stddev_samp(c) / sqrt(count(*)), 6) as sem, min(c)::bigint as least, max(c)::bigint as most from c group by 1""")
def two_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.two_level(events(spark, sf_dir), ["event_type"], "user_id")
    return out.select("event_type", "groups", *[R(F.col(c), c) for c in ("mean", "sd", "sem")], "least", "most")


@query("""
with n as (select user_id, event_type, count(*) as n from events group by all) select user_id, event_type, n::bigint as n, round(100.0 * n / sum(n) over (partition by user_id), 6) as percent from n""")
def label_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.shares(events(spark, sf_dir), ["user_id"], "event_type").withColumn("percent", F.round("percent", 6))


@query("""
select count(*) filter (event_type = 'click')::bigint as n_click, round(count(*) filter (event_type = 'click') / 720.0, 6) as click_rate, round(avg(value) filter (event_type = 'view'), 6) as view_mean, round(median(value) filter (event_type = 'view'), 6) as view_median, round(stddev_samp(value) filter (event_type = 'view'), 6) as view_sd from events""")
def conditional_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    view, clicks = F.when(F.col("event_type") == "view", F.col("value")), F.count_if(F.col("event_type") == "click")
    df = events(spark, sf_dir)
    middle = aggregates.exact_quantiles(df.where("event_type = 'view'"), "value", [0.5]).select(R(F.col("__q")[0], "view_median"))
    return df.agg(clicks.alias("n_click"), R(clicks / 720.0, "click_rate"), R(F.avg(view), "view_mean"), R(F.stddev_samp(view), "view_sd")).crossJoin(F.broadcast(middle))  # one row


@query("""
with q as (select event_type, quantile_cont(value, 0.98) as q from events group by 1) select event_id from events join q using (event_type) where value <= q""")
def percentile_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.percentile_filter(events(spark, sf_dir), ["event_type"], "value", 0.98).select("event_id")


@query("""
with q as (select quantile_cont(value, 0.05) as lo, quantile_cont(value, 0.995) as hi from events) select event_id, greatest(least(value, hi), lo) as value from events, q""")
def percentile_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir)
    q = aggregates.exact_quantiles(df, "value", [0.05, 0.995]).select(F.col("__q").alias("q"))
    return df.crossJoin(F.broadcast(q)).select("event_id", F.greatest(F.least("value", F.col("q")[1]), F.col("q")[0]).alias("value"))


@query("""
select user_id, list(event_type order by ts, event_id) as event_type_list, first(event_type order by ts, event_id) as event_type_first from events group by 1""")
def ordered_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.ordered_lists(events(spark, sf_dir), ["user_id"], ORDER, ["event_type"])


@query("""
with s as (select *, count(*) filter (event_type = 'signup') over (partition by user_id order by ts, event_id rows unbounded preceding) as session from events)
select user_id, session::bigint as session, count(*)::bigint as n from s group by all""")
def anchored_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.sessions(events(spark, sf_dir), ["user_id"], ORDER, F.col("event_type") == "signup", WEEK).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("""
with r as (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events), n as (select case when event_type = 'click' and before = 'error' then 'click_repaired' else event_type end as code from r),
a as (select event_type as code, count(*) as n from events group by 1), b as (select code, count(*) as n from n group by 1)
select coalesce(a.code, b.code) as event_type, coalesce(a.n, 0)::bigint as n_raw, coalesce(b.n, 0)::bigint as n_repaired, (coalesce(b.n, 0) - coalesce(a.n, 0))::bigint as delta from a full join b on a.code = b.code""")
def trigger_repair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes relabelled by the code before them, and the counts of either stream."""
    df = events(spark, sf_dir)
    rule = (F.col("event_type") == "click") & (F.col("previous") == "error")
    return triggers.code_counts(df, triggers.relabel(df, ["user_id"], ORDER, "event_type", rule, F.lit("click_repaired")), "event_type")


@query("""
with s as (select *, count(*) filter (event_type = 'signup') over (partition by user_id order by ts, event_id rows unbounded preceding) as session from events), w as (select ['signup', 'view', 'click', 'purchase'] as want),
l as (select user_id, session, list(event_type order by ts, event_id) as seen from s group by all), k as (select *, [list_position(want, x) for x in seen if list_contains(want, x)] as places from l, w)
select user_id, session::bigint as session, array_to_string([x for x in want if not list_contains(seen, x)], ',') as missing, array_to_string(list_sort([x for x in list_distinct(seen) if not list_contains(want, x)]), ',') as extra, places = list_sort(places) as ordered,
  list_has_all(seen, want) and list_has_all(want, seen) and places = list_sort(places) as ok from k""")
def trigger_sequence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sequence.sessions(events(spark, sf_dir), ["user_id"], ORDER, F.col("event_type") == "signup")
    return triggers.check_sequences(df, ["user_id", "session"], ORDER, "event_type", ["signup", "view", "click", "purchase"])


@query("""
select event_id from (select *, row_number() over (partition by user_id order by md5('3:' || event_id), event_id) as p from events) where p <= 5""")
def sample_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.per_group(events(spark, sf_dir), ["user_id"], ["event_id"], 5, 3).select("event_id")


@query("""
with g as (select user_id, ntile(4) over (order by md5('1:' || user_id), user_id) as split from (select distinct user_id from events)) select event_id, split::int as split from events join g using (user_id)""")
def group_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.group_splits(events(spark, sf_dir), "user_id", 4, 1).select("event_id", "split")


@query("""
select event_id, (('0x' || substr(md5('0:' || user_id), 1, 8))::bigint % 5)::bigint as fold from events""")
def hash_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hash_folds(events(spark, sf_dir), "user_id").select("event_id", "fold")


@query("""
with s as (select user_id, event_type, count(*) as c from events group by all), t as (select event_type, avg(c) as m, stddev_samp(c) as s, count(*) as n from s group by 1)
select event_type, n::bigint as n, round((m - 10) / (s / sqrt(n)), 6) as t from t""")
def one_sample_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("c"))
    return stats.t_test(counts, ["event_type"], "c", 10).select("event_type", "n", R(F.col("t"), "t"))


@query("""
select json_extract_string(props, '$.' || k) as v, k, count(*)::bigint as n from events, (select unnest(json_keys(props)) as k, event_id as i from events) where i = event_id group by all""")
def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each key and value of the nested properties."""
    pairs = events(spark, sf_dir).select(F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return pairs.groupBy("k", "v").agg(F.count("*").alias("n"))


@query("""
select 'null_value' as "check", count(*) filter (value is null)::bigint as n from events union all select 'null_ts', count(*) filter (ts is null) from events union all select 'unknown_event_type', count(*) filter (event_type not in ('view', 'click')) from events union all select 'duplicate_key', (count(*) - count(distinct event_id)) from events""")
def data_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.quality_report(events(spark, sf_dir), ["value", "ts"], {"event_type": ["view", "click"]}, ["event_id"])

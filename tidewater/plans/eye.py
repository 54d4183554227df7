"""Queries of gaze-like events: a view is a fixation, clicks and purchases are saccades, an error is a blink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import messages
from ..operators import enrich, intervals, sequence
from ..sources.tables import CatalogQuery, concat_tables, missing_keys, newest
from .registry import query, table

_KIND = "case event_type when 'view' then 'fixation' when 'click' then 'saccade' when 'purchase' then 'saccade' when 'error' then 'blink' else 'other' end"
EYE = f"eye as (select event_id, user_id as subject, {_KIND} as type, epoch_us(ts) / 1e6 as start_time, epoch_us(ts) / 1e6 + value * 60 as end_time, value as amplitude, value * 60 as duration, value * 20 as mean_gx, value * 7.5 as mean_gy, case when event_id % 11 = 0 then null else value * 11 end as end_gx, value * 4 as end_gy from events)"
MARKS = "marks as (select user_id as subject, row_number() over w as trial, epoch_us(ts) / 1e6 as onset, lead(epoch_us(ts) / 1e6) over w as \"offset\" from events where event_type = 'signup' window w as (partition by user_id order by ts, event_id))"


def eye(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, v = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("subject"), F.expr(_KIND).alias("type"), t.alias("start_time"), (t + v * 60).alias("end_time"), v.alias("amplitude"), (v * 60).alias("duration"),
        (v * 20).alias("mean_gx"), (v * 7.5).alias("mean_gy"), F.when(F.col("event_id") % 11 != 0, v * 11).alias("end_gx"), (v * 4).alias("end_gy"),
    )


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject"), "event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return sequence.spans(df, ["subject"], ["t", "event_id"], "t", F.col("event_type") == "signup")


@query(f"with {EYE} select event_id from eye where type <> 'blink' and (type <> 'fixation' or duration >= 600) and (type <> 'saccade' or duration <= 3000) and mean_gx between 0 and 1024 and mean_gy between 0 and 768 and end_gx between 0 and 1024 and end_gy between 0 and 768")
def eye_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.clean(eye(spark, sf_dir), least_fixation=600.0, most_saccade=3000.0).select("event_id")


@query(f"""with {EYE}, k as (select * from eye where not (type = 'fixation' and duration > 4000) and not (type = 'saccade' and amplitude > 90)),
s as (select *, start_time - lag(end_time) over w as gap, lead(start_time) over w - end_time as nxt, lag(amplitude) over w as a0, lead(amplitude) over w as a1 from k where type = 'saccade' window w as (partition by subject order by start_time, event_id))
select event_id from k where type <> 'saccade' union all select event_id from s where not (coalesce(gap < 7200, false) and not coalesce(a0 < amplitude, false) or coalesce(nxt < 7200, false) and coalesce(amplitude < a1, false))""")
def eye_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.without_artifacts(eye(spark, sf_dir), ["subject"], ["start_time", "event_id"], most_fixation=4000.0, most_amplitude=90.0, least_gap=7200.0).select("event_id")


def _in_trials(mode: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = marks(spark, sf_dir).where("offset is not null")
    out = enrich.place_in_trials(eye(spark, sf_dir), trials, ["subject"], ["event_id"], mode, 86400.0)
    return out.select("event_id", "trial", F.round("time_in_trial", 3).alias("time_in_trial"))


def _trial_sql(condition: str) -> str:
    return f"""with {EYE}, {MARKS}, hit as (select e.event_id, m.trial, e.start_time - m.onset + 0.02 as time_in_trial, row_number() over (partition by e.event_id order by m.onset desc, m."offset" desc) as n from eye e join marks m on e.subject = m.subject and m."offset" is not null and {condition})
select eye.event_id, trial::bigint as trial, round(time_in_trial, 3) as time_in_trial from eye left join (select * from hit where n = 1) h using (event_id)"""


@query(_trial_sql('e.start_time > m.onset and e.end_time < m."offset"'))
def eye_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trial that holds each whole event, and the time in it with the fixed delay; null outside."""
    return _in_trials("strict", spark, sf_dir)


@query(_trial_sql('e.start_time > m.onset - 1 and e.end_time > m.onset + 0.05 and e.start_time < m."offset"'))
def eye_trials_early(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with events that begin up to a second before their trial."""
    return _in_trials("early", spark, sf_dir)


@query(f"""with {EYE}, {MARKS} select m.subject, m.trial::bigint as trial, e.event_id from marks m join eye e on e.subject = m.subject and e.start_time >= m.onset and e.start_time <= coalesce(m."offset", m.onset + 1e7)""")
def interval_mixed_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed containment where some intervals (the open last ones) are far longer than others."""
    trials = marks(spark, sf_dir).withColumn("offset", F.coalesce("offset", F.col("onset") + 1e7))
    return intervals.contained(eye(spark, sf_dir), trials, ["subject"], "start_time", "start_time", "onset", "offset", "closed", 3600.0).select("subject", "trial", "event_id")


@query(f"""with {EYE}, s as (select *, last_value(case when type = 'fixation' then duration end ignore nulls) over w as sc, last_value(case when type = 'saccade' then duration end ignore nulls) over w as mi from eye window w as (partition by subject order by start_time, event_id rows between unbounded preceding and 1 preceding))
select event_id, round(amplitude + case type when 'blink' then coalesce(sc, 4.0) + coalesce(mi, 1.0) when 'saccade' then coalesce(sc, 4.0) else 0 end, 6) as clock from s""")
def trial_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes (fixations here), microphone phases (saccades) and captions (blinks) on one clock."""
    kinds = {"fixation": "scene", "saccade": "microphone", "blink": "caption"}
    df = eye(spark, sf_dir)
    for a, b in kinds.items():
        df = df.withColumn("type", F.when(F.col("type") == a, b).otherwise(F.col("type")))
    return enrich.trial_clock(df, ["subject"], ["start_time", "event_id"], "type", "amplitude", "duration").select("event_id", F.round("clock", 6).alias("clock"))


MERGED = f"""{EYE}, m as (select *, case when type = 'saccade' and lag(type) over (partition by subject order by start_time, event_id) = 'saccade' then 0 else 1 end as fresh from eye),
r as (select *, sum(fresh) over (partition by subject order by start_time, event_id rows unbounded preceding) as run from m), n as (select *, count(*) over (partition by subject, run) as size from r),
merged as (select event_id, subject, type, start_time, amplitude, case when size > 1 then 'first' else 'no' end as multi, case when size > 1 then coalesce(lead(start_time) over (partition by subject order by start_time, event_id) - start_time, duration) else duration end as duration from n where fresh = 1)"""
SEQUENCED = f"""{MERGED}, seq as (select *, case when type = 'fixation' then row_number() over p - 1 end as fix, case when type = 'fixation' then row_number() over p - count(*) over (partition by subject, type) end as fix_last, case when type = 'saccade' then row_number() over p - 1 end as sac, case when type = 'saccade' then row_number() over p - count(*) over (partition by subject, type) end as sac_last from merged window p as (partition by subject, type order by start_time, event_id))"""


def _sequenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = enrich.merge_saccades(eye(spark, sf_dir), ["subject"], ["start_time", "event_id"], "type", "start_time", "duration")
    return enrich.sequences(merged, ["subject"], ["start_time", "event_id"], "type")


@query(f"with {SEQUENCED} select event_id, multi, round(duration, 3) as duration, fix::bigint as fix, fix_last::bigint as fix_last, sac::bigint as sac, sac_last::bigint as sac_last from seq")
def eye_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged runs of saccades, and positions; rows that have none are null."""
    out = _sequenced(spark, sf_dir)
    return out.select("event_id", "multi", F.round("duration", 3).alias("duration"), *[F.col(a).cast("long").alias(b) for a, b in (("fix_sequence", "fix"), ("fix_sequence_from_last", "fix_last"), ("sac_sequence", "sac"), ("sac_sequence_from_last", "sac_last"))])


@query(f"""with {SEQUENCED}, w as (select *, lag(type) over o as t0, lead(type) over o as t1, lag(amplitude) over o as a0, lead(amplitude) over o as a1, lag(sac_last) over o as l0, lead(sac) over o as s1, lag(event_id) over o as e0, lead(event_id) over o as e1 from seq window o as (partition by subject order by start_time, event_id))
select event_id, case when type = 'fixation' and t0 = 'saccade' and (coalesce(fix > 0, false) or coalesce(l0 < 0, false)) then a0 end as amplitude_pre, case when type = 'fixation' and t1 = 'saccade' and (coalesce(fix_last < 0, false) or coalesce(s1 > 0, false)) then a1 end as amplitude_post,
case when type = 'saccade' and t0 = 'fixation' and sac > 0 then e0 end as label_pre, case when type = 'saccade' and t1 = 'fixation' and sac_last < 0 then e1 end as label_post from w""")
def eye_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What saccades pass on to the fixations beside them, and fixations to saccades, with the guards at the ends."""
    df = _sequenced(spark, sf_dir).withColumn("label", F.col("event_id"))
    return enrich.neighbours_by_kind(df, ["subject"], ["start_time", "event_id"], "type", ["amplitude"], ["label"]).select("event_id", "amplitude_pre", "amplitude_post", "label_pre", "label_post")


@query(f"with {SEQUENCED} select event_id, round(start_time + duration, 3) as time from seq where fix_last is distinct from 0")
def eye_without_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but the last fixations (rows without a position stay), at their ends."""
    return enrich.at_offset(enrich.without_last(_sequenced(spark, sf_dir)), "start_time").select("event_id", F.round("start_time", 3).alias("time"))


_of = lambda k: f"count(*) filter (type = '{k}')::bigint as n_{k}, round(count(*) filter (type = '{k}') / 3600.0, 6) as {k}_rate, round(avg(duration) filter (type = '{k}'), 6) as {k}_mean, round(median(duration) filter (type = '{k}'), 6) as {k}_median, round(stddev_samp(duration) filter (type = '{k}'), 6) as {k}_sd"


@query(f"with {EYE} select subject, {_of('fixation')}, {_of('saccade')}, {_of('blink')}, round(sum(duration) / 3600, 6) as coverage from eye group by 1")
def eye_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, rates and durations of each kind by subject, and coverage."""
    out = enrich.quality(eye(spark, sf_dir), ["subject"], 3600.0)
    return out.select("subject", *[F.round(c, 6).alias(c) if not c.startswith("n_") else F.col(c) for c in out.columns[1:]])


@query("with l as (select event_id, user_id, event_id % 7 as t from events where event_type = 'click'), r as (select user_id, event_id % 5 as t, value, event_id as e from events where event_type = 'view') select l.event_id, arg_min(value, (value, e)) as duration from l join r using (user_id, t) group by 1")
def adjacent_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that touch exactly; of several the smallest."""
    df = table(spark, sf_dir, "events")
    left = df.where("event_type = 'click'").select("event_id", "user_id", (F.col("event_id") % 7).alias("t"))
    right = df.where("event_type = 'view'").select("user_id", (F.col("event_id") % 5).alias("s"), "value", F.col("event_id").alias("e"))
    return intervals.adjacent(left, right, ["user_id"], "t", "s", {"value": "duration", "e": "other"}).select("event_id", "duration")


@query(f"with {EYE} select event_id, mean_gx - 512 as x, 384 - mean_gy as y, (mean_gx - 512) / 512 as sx, (384 - mean_gy) / 384 as sy from eye")
def screen_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = enrich.on_screen(eye(spark, sf_dir), "mean_gx", "mean_gy", 1024, 768)
    return out.select("event_id", *[F.col(a).alias(b) for a, b in (("mean_gx_centred", "x"), ("mean_gy_centred", "y"), ("mean_gx_scaled", "sx"), ("mean_gy_scaled", "sy"))])


@query("with v as (select event_id, event_type, case when event_type in ('view', 'click') then value / 1000 else value end as v from events), m as (select event_type, median(v) as m from v group by 1) select event_id, round(case when m < 1 then v * 1000 else v end, 6) as v from v join m using (event_type)")
def adaptive_milliseconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_type").isin("view", "click"), F.col("value") / 1000).otherwise(F.col("value")).alias("v"))
    return enrich.in_milliseconds(df, ["event_type"], "v").select("event_id", F.round("v", 6).alias("v"))


@query("select s_suppkey, s_suppkey * 7 as check_x, s_suppkey + 1 as check_y, s_nationkey / 100.0 as offset_deg, round(-s_acctbal / 1000, 2) as offset_x, round(s_nationkey / 10.0, 1)::double as offset_y, round(sqrt(round(-s_acctbal / 1000, 2) ** 2 + round(s_nationkey / 10.0, 1)::double ** 2), 6) as offset_pix from supplier where s_suppkey % 5 <> 0 union all select s_suppkey, null, null, null, null, null, null from supplier where s_suppkey % 5 = 0")
def drift_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of messages, and nulls out of what is none."""
    n = F.col("s_nationkey")
    text = F.format_string("DRIFTCORRECT L LEFT  at %d,%d  OFFSET %.2f deg.  %.2f,%.1f pix.", F.col("s_suppkey") * 7, F.col("s_suppkey") + 1, n / 100.0, -F.col("s_acctbal") / 1000, n / 10.0)
    df = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 5 != 0, text).otherwise("DRIFTCORRECT ABORTED").alias("m"))
    d = messages.drift(F.col("m"))
    return df.select("s_suppkey", d["check_x"].alias("check_x"), d["check_y"].alias("check_y"), d["offset_deg"].alias("offset_deg"), d["offset_x"].alias("offset_x"), d["offset_y"].alias("offset_y"), F.round(d["offset_pix"], 6).alias("offset_pix"))


@query("""select s_suppkey, 'HV9' as validation_type, case when s_suppkey % 2 = 0 then 'LEFT' else 'RIGHT' end as eye, ['GOOD', 'FAIR', 'POOR'][s_suppkey % 3 + 1] as quality, s_nationkey / 100.0 as avg_error, (s_nationkey + 1) / 100.0 as max_error, map([1::bigint, 2::bigint], [s_nationkey / 10.0, s_nationkey / 5.0])[2::bigint] as second_point from supplier""")
def validation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested printed lists: values by the words before them, and a map of points."""
    n = F.col("s_nationkey")
    text = F.format_string("[['VALIDATION', 'HV9', '', [['L', '%s', '%s']], 'ERROR', '%.2f', 'avg.', '%.2f', 'max']]", F.when(F.col("s_suppkey") % 2 == 0, "LEFT").otherwise("RIGHT"), F.element_at(F.array(*map(F.lit, messages.QUALITIES)), (F.col("s_suppkey") % 3 + 1).cast("int")), n / 100.0, (n + 1) / 100.0)
    points = F.format_string("[['L', 'POINT', '1', '', 'LEFT', 'at', '5,5', 'OFFSET', '%.1f', 'deg.'], ['L', 'POINT', '2', 'OFFSET', '%.1f', 'deg.']]", n / 10.0, n / 5.0)
    df = table(spark, sf_dir, "supplier").select("s_suppkey", messages.validation(text).alias("v"), messages.point_errors(points).alias("p"))
    return df.select("s_suppkey", *[F.col(f"v.{c}").alias(c) for c in ("validation_type", "eye", "quality", "avg_error", "max_error")], F.col("p")[F.lit(2).cast("long")].alias("second_point"))


@query("select p_partkey, p_name as first_caption, 2::int as captions, p_size::double as least, (p_retailprice + 0.5)::double as first_of_vector, p_size::bigint as trial, case p_size % 4 when 0 then 'scene' when 1 then 'caption' when 3 then 'microphone' else 'unknown' end as kind from part")
def printed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists, vectors and message words that were printed as text."""
    size = F.col("p_size")
    df = table(spark, sf_dir, "part").select("p_partkey", F.format_string("['%s ', '', \"it\\'s %d\"]", "p_name", size).alias("c"), F.format_string("[%d, %d]", size + 3, size).alias("l"), F.format_string("[%.2f 0.25 1e-3]", F.col("p_retailprice") + 0.5).alias("v"), F.format_string("TRIALID %d", size).alias("t"), F.format_string("[%d, 'x']", size % 4).alias("k"))
    c = messages.captions(F.col("c"))
    return df.select("p_partkey", F.get(c, F.lit(0)).alias("first_caption"), F.size(c).alias("captions"), messages.least_number(F.col("l")).alias("least"), F.get(messages.vector(F.col("v")), F.lit(0)).alias("first_of_vector"), messages.trial_number(F.col("t")).alias("trial"), messages.kind_of(F.col("k")).alias("kind"))


@query("""select p_partkey, p_brand || '_' || substr(sha256('{' || case when p_size > 25 then '' else '"a":' || p_size || ',' end || '"b":"' || p_type || '"}'), 1, 16) as signature from part""")
def parameter_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("p_size") <= 25, F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", messages.signature({"b": F.col("p_type"), "a": size}, F.col("p_brand")).alias("signature"))


@query("""with m(k, v) as (values ('sub1', 1)), f as (select page_id, 'a/' || lpad(page_id::varchar, 5, '0') || '_' || page_id % 7 || '_x.jpg' as name, 'http://farm.example/99/' || page_id || '_0a1b.JPG' as url from pages)
select page_id, page_id as trial, page_id % 7 as part, case when page_id % 3 > 0 then page_id end as photo, 'S' || case when len((page_id * 50)::varchar) >= 4 then (page_id * 50)::varchar else lpad((page_id * 50)::varchar, 4, '0') end as padded from f""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    name = F.concat(messages.padded(i, 5, "a/"), F.lit("_"), i % 7, F.lit("_x.jpg"))  # lpad alone would cut numbers of six digits
    url = F.concat(F.lit("http://farm.example/99/"), F.when(i % 3 > 0, i.cast("string")).otherwise("none"), F.lit("_0a1b.JPG"))
    return table(spark, sf_dir, "pages").select("page_id", *messages.name_parts(name, ["trial", "part"]), messages.photo_id(url).alias("photo"), messages.padded(i * 50, 4, "S").alias("padded"))


@query("select vec_id, vec_id % 5 as file, vec_id // 5 as place, embedding[1]::double as first from embeddings where label in (1, 2, 4) and not (vec_id % 5 = 3 or vec_id // 5 < 4) and vec_id % 5 <> 1")
def content_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate over a catalog; only the matching items of the payload table are joined, one of its columns read."""
    df = table(spark, sf_dir, "embeddings").withColumns({"file": F.col("vec_id") % 5, "place": F.expr("vec_id div 5")})
    q = CatalogQuery(df.select("vec_id", "label", "file", "place"), items=df.select("file", "place", "embedding", F.col("label").alias("other")))
    found = q.where("label in @wanted and ~(file == 3 | place < 4)", wanted=[1, 2, 4]).where("file != 1").load(picks=["embedding"])
    return found.select("vec_id", "file", "place", F.col("embedding")[0].cast("double").alias("first"))


@query("with s as (select p_brand, p_size, p_partkey, row_number() over (order by p_retailprice desc, p_partkey desc) as n from part where p_size = 7) select p_partkey, p_brand from s where n = 1")
def newest_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest(table(spark, sf_dir, "part"), "p_retailprice", ["p_partkey"], p_size=7).select("p_partkey", "p_brand")


@query("with w as (select distinct user_id, d from events, range(0, 7) t(d)), h as (select distinct user_id, event_id % 7 as d from events where event_type in ('view', 'error')) select w.user_id, count(*)::bigint as expected, count(h.d)::bigint as present, (count(*) - count(h.d))::bigint as missing, round(count(h.d) / count(*), 6) as rate, list_sort(list(w.d) filter (h.d is null)) as missing_keys from w left join h on w.user_id = h.user_id and w.d = h.d group by 1")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the expected keys of each user are there."""
    df = table(spark, sf_dir, "events")
    want = df.select("user_id").distinct().withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))))
    there = df.where(F.col("event_type").isin("view", "error")).select("user_id", (F.col("event_id") % 7).alias("d"))
    out = missing_keys(want, there, ["user_id", "d"], ["user_id"]).withColumn("rate", F.round("rate", 6))
    return out.withColumn("missing_keys", F.when(F.size("missing_keys") > 0, F.col("missing_keys")))


@query("select s_suppkey as k, s_name as name, null::bigint as custkey, s_acctbal as bal from supplier union all select c_custkey, null, c_custkey, c_acctbal from customer")
def widened_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("bal"))
    return concat_tables([a, b])

"""Queries of the label dimension and of trigger streams. The stream is derived from events: sessions of users, codes by number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as fixed
from ..operators import labels, triggers
from ..operators.scans import scan
from .registry import query, table

#: (class_id, name, kind, grp, place) as SQL.
_quote = lambda v: "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
DIM = "dim(class_id, name, kind, grp, place) as (values " + ", ".join("(" + ", ".join(map(_quote, r)) + ")" for r in fixed.rows()) + ")"


@query(f"with {DIM} select event_id, coalesce(name, 'unknown') as name, case when kind is null then 'unknown' else kind end as kind, event_id % 190 = class_id and class_id is not null as known from events left join dim on event_id % 190 = class_id")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and kinds of class ids, some of which no class has."""
    df = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 190).alias("class_id"))
    return labels.with_names(df, "class_id").select("event_id", "name", labels.kind(F.col("class_id")).alias("kind"), (F.col("class_id") < 183).alias("known"))


@query(f"with {DIM}, n as (select event_id, case when event_id % 4 = 0 then 'no such label' else (select name from dim where class_id = event_id % 183) end as label from events) select event_id, class_id::bigint as class_id from n left join dim on label = name")
def label_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of class names; null for what is no class."""
    df = labels.with_names(table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 183).alias("i")), "i", "label").drop("i")
    df = df.withColumn("label", F.when(F.col("event_id") % 4 == 0, "no such label").otherwise(F.col("label")))
    return labels.with_ids(df, "label").select("event_id", "class_id")


@query(f"with {DIM}, l as (select vec_id, label, coalesce(grp, 'unknown') as grp, vec_id % 183 as c from embeddings join dim on vec_id % 183 = class_id) select vec_id, grp as \"group\", row_number() over (partition by label order by grp, vec_id)::int as position from l")
def label_group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each cell in the order of their label's group, stable."""
    df = labels.with_names(table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 183).alias("c")), "c")
    return labels.sorted_by_group(df, ["label"], "name", ["vec_id"]).select("vec_id", "group", "position")


@query(f"with {DIM} select count(*)::bigint as classes, count(*) filter (kind = 'thing')::bigint as things, count(*) filter (kind = 'stuff')::bigint as stuff, count(*) filter (kind = 'unknown')::bigint as missing, min(class_id) filter (kind = 'thing')::bigint as first_thing, max(class_id) filter (kind = 'thing')::bigint as last_thing, min(class_id) filter (kind = 'stuff')::bigint as first_stuff, max(class_id) filter (kind = 'stuff')::bigint as last_stuff, (select count(distinct class_id) from dim join events on event_id % 190 = class_id)::bigint as seen, (select count(*) from events anti join dim on event_id % 190 = class_id)::bigint as rows_without from dim")
def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension's classes by kind; how many of them occur in the events, and events of no class."""
    ids = table(spark, sf_dir, "events").select((F.col("event_id") % 190).alias("class_id"))
    found = labels.with_names(ids, "class_id").agg(F.count_distinct(F.when(F.col("name") != "unknown", F.col("class_id"))).alias("seen"), F.count_if(F.col("class_id") > 182).alias("rows_without"))
    return labels.summary(spark).crossJoin(F.broadcast(found))  # one row


#: A stream of codes: of ten rows one is a fixation cross, a scene, a block and a trial each; some are left out or other.
STREAM = """select user_id % 9 + 1 as session, event_id * 10 as sample, event_id,
  case when event_id % 97 = 5 then 98 else case seq % 10 when 0 then 90 when 1 then 91 when 2 then 100 when 3 then (seq * 7 + event_id) % 128 when 4 then seq / 10 % 30 + 1 when 5 then 101 when 6 then 112 when 7 then 113 when 8 then 110 else 111 end end as code
  from (select event_id, user_id, cast(row_number() over (partition by user_id % 9 order by event_id) - 1 as bigint) as seq from events)"""
#: The other spelling of whole division.
STREAM_DUCK = STREAM.replace("seq / 10 % 30", "seq // 10 % 30")
STREAM_SPARK = STREAM.replace("seq / 10 % 30", "(seq div 10) % 30")
RAW = f"raw as (select *, coalesce(lag(code) over (partition by session order by sample), 0) as previous from ({STREAM_DUCK}))"
_first = "case when session = 1 then 1 else 11 + (session - 2) * 14 end"
_last = "case when session = 1 then 10 else 24 + (session - 2) * 14 end"
_block = f"case when code < 128 and code - 50 between {_first} and {_last} then code - 50 when code + 78 between {_first} and {_last} and code + 128 >= 128 then code + 78 end"
FIXED = f"""{RAW}, judged as (select *, {_block} as b, case when code <= 30 or code = 110 then previous = 100 when code in (100, 101, 90, 91, 112, 113, 111, 120, 121, 98, 99) then previous <> 0 else true end as fits from raw),
marked as (select session, sample, event_id, b is not null and fits as repaired, case when b is not null and fits then b + 1000 else code end as code, previous as old from judged),
fixed as (select *, case when lag(repaired) over w then lag(code) over w else old end as previous from marked window w as (partition by session order by sample))"""


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.sql(STREAM_SPARK.replace("from events", "from {events}"), events=table(spark, sf_dir, "events"))
    return scan(df, ["session"], ["sample"], SPREAD, before={"previous": F.col("code")}).withColumn("previous", F.coalesce("previous", F.lit(0)))


#: Sessions are dealt over stretches of so many samples.
SPREAD = ("sample", 1_000_000.0)


def mended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.repair(stream(spark, sf_dir), "session", ["sample"], spread=SPREAD)


@query(f"with {FIXED} select event_id, session::bigint as session, code::bigint as code, previous::bigint as previous, repaired from fixed")
def trigger_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block codes told from trial numbers and event codes, with the wrap at 128."""
    return mended(spark, sf_dir).select("event_id", F.col("session").cast("long").alias("session"), F.col("code").cast("long").alias("code"), F.col("previous").cast("long").alias("previous"), "repaired")


@query(f"""with {FIXED}, a as (select session, code, count(*) as n from raw group by all), b as (select session, code, count(*) as n from fixed group by all), c as (select coalesce(a.session, b.session) as session, coalesce(a.code, b.code) as code, coalesce(a.n, 0) as n_raw, coalesce(b.n, 0) as n_repaired from a full join b on a.session = b.session and a.code = b.code),
l(code, label) as (values {", ".join(f"({v}, '{k}')" for k, v in triggers.CODES.items())})
select session::bigint as session, c.code::bigint as code, n_raw::bigint as n_raw, n_repaired::bigint as n_repaired, (n_repaired - n_raw)::bigint as delta, coalesce(label, '') as label, label is not null as is_event, {_block.replace("code", "c.code")} is not null as is_block_alias, c.code >= 1000 as is_repaired_block, label is not null and {_block.replace("code", "c.code")} is not null as collision from c left join l on c.code = l.code""")
def trigger_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each code before and after the repair, with flags."""
    out = triggers.audit(triggers.code_counts(stream(spark, sf_dir), mended(spark, sf_dir), "code", ["session"]), "session")
    return out.withColumns({"session": F.col("session").cast("long"), "code": F.col("code").cast("long")})


@query(f"""with {FIXED}, n as (select *, row_number() over (partition by session order by sample) as r from fixed), v as (select * from n where code between 1 and 30 and previous - 1000 between {_first} and {_last}), t as (select * from n where code = 112)
select t.event_id, (v.previous - 1000)::bigint as block, v.code::bigint as trial from t asof join v on t.session = v.session and t.r > v.r where t.r - v.r <= 199""")
def trigger_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block and trial of each mic_on: as-of backwards with a condition on what is matched and on how far."""
    return triggers.trial_of(mended(spark, sf_dir), "session", ["sample"], triggers.CODES["mic_on"], spread=SPREAD).select("event_id", "block", "trial")


ONSETS = f"""{FIXED}, n as (select *, (lag(sample) over (partition by session order by sample) + sample) / 2.0 as onset from fixed), m as (select *, row_number() over (partition by session, code order by sample) as k, count(*) over (partition by session, code) as of from n where code between 1 and 30),
told as (select session, previous - 1000 as block, code as trial, arg_min(onset, sample) as onset from m where previous - 1000 between 1 and 999 group by all),
lone as (select session, b as block, code as trial, onset from m, (values (50), (78)) x(b) where k = 12 and of = 14 and b between {_first} and {_last}), onsets as (select * from told union all select l.* from lone l anti join told t on l.session = t.session and l.block = t.block and l.trial = t.trial)"""


@query(f"with {ONSETS} select session::bigint as session, block::bigint as block, trial::bigint as trial, onset::double as onset from onsets")
def trigger_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The onset of each trial: half-way between its block's code and its number."""
    return triggers.onsets(mended(spark, sf_dir), "session", ["sample"], spread=SPREAD).withColumn("session", F.col("session").cast("long"))


SHOWN = "select distinct user_id % 9 + 1 as session, 1 + event_id % 120 as block, 1 + event_id % 30 as trial, event_id % 50 as scene from events where event_type = 'view'"
INSIDE = "select user_id % 9 + 1 as session, event_id % 50 as scene, event_type as kind, value / 100 as time_in_trial, 0.25 as duration from events where event_type <> 'view' and event_id % 3 = 0"


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    onset = triggers.onsets(mended(spark, sf_dir), "session", ["sample"], spread=SPREAD)
    trials = spark.sql(SHOWN.replace("from events", "from {events}"), events=table(spark, sf_dir, "events")).groupBy("session", "block", "trial").agg(F.min("scene").alias("scene"))
    events = spark.sql(INSIDE.replace("from events", "from {events}"), events=table(spark, sf_dir, "events")).withColumn("duration", F.col("duration").cast("double"))
    return triggers.placed_events(onset, trials, events, "session", "scene", 1000.0)


PLACED = f"{ONSETS}, shown as (select session, block, trial, min(scene) as scene from ({SHOWN}) group by all), seen as (select s.*, onset / 1000 as t from shown s left join onsets using (session, block, trial)), inside as ({INSIDE})"


@query(f"""with {PLACED} select block::bigint as block, trial::bigint as trial, kind, round(t + time_in_trial, 6)::double as time, duration::double as duration from seen join inside i on seen.session = i.session and seen.scene = i.scene where t is not null
union all select block, trial, 'scene', round(t, 6)::double, 4.0::double from seen where t is not null""")
def trigger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at their times in the recording, by the scene that their trial shows, and the scenes themselves."""
    return _placed(spark, sf_dir)[0].select("block", "trial", "kind", F.round("time", 6).alias("time"), "duration")


@query(f"with {PLACED} select session::bigint as session, block::bigint as block, trial::bigint as trial from seen where t is null")
def trigger_missing_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir)[1].withColumn("session", F.col("session").cast("long"))


@query(f"""with {RAW}, g as (select *, lag(sample) over w as s, lag(code) over w as c from raw window w as (partition by session order by sample)),
f as (select session, code as trial, arg_min(case when c = 100 then s + (sample - s) // 2 else s end, sample) as spot from g where s is not null group by all), d as (select session, min(sample) as opening from raw where code = 100 group by 1),
e as (select event_id, user_id % 9 + 1 as session, event_id % 33 as trial, value / 50 as time from events where event_type = 'click'),
p as (select event_id, coalesce(spot, opening) + trunc((time + 0.02) * 1000)::bigint as event_at from e left join f using (session, trial) left join d using (session) where coalesce(spot, opening) is not null)
select event_id, event_at::bigint as event_at from p where event_at - 200 >= 0 and event_at + 500 < 90000""")
def trigger_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recording's sample of each click, from its trial's scene."""
    df = table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", (F.col("user_id") % 9 + 1).alias("session"), (F.col("event_id") % 33).alias("trial"), (F.col("value") / 50).alias("time"))
    return triggers.anchored(df, stream(spark, sf_dir), "session", ["sample"], "trial", "time", 1000.0, -0.2, 0.5, 90000).select("event_id", "event_at")


SEGMENTS = f"""{FIXED}, n as (select *, row_number() over (partition by session order by sample) as r from fixed),
w as (select *, lead(code) over x as next, max(case when code = 90 then r end) over (partition by session order by sample rows between 19 preceding and 1 preceding) as cross_at, min(case when code = 90 or code >= 1000 then r end) over (partition by session order by sample rows between 2 following and unbounded following) as stop, max(r) over (partition by session) as last from n window x as (partition by session order by sample)),
a as (select session, r as segment, code - 1000 as block, next as trial, coalesce(cross_at, r) as low, coalesce(stop - 1, last) as high from w where code - 1000 between {_first} and {_last} and next between 1 and 30),
rows as (select a.*, n.code, n.sample, n.event_id from a join n on a.session = n.session and n.r between a.low and a.high)"""


@query(f"with {SEGMENTS} select session::bigint as session, segment::bigint as segment, block::bigint as block, trial::bigint as trial, event_id from rows")
def trigger_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of each trial, from the fixation cross before it to the next one."""
    return triggers.segments(mended(spark, sf_dir), "session", ["sample"], spread=SPREAD).select(F.col("session").cast("long").alias("session"), "segment", "block", "trial", "event_id")


@query(f"""with {SEGMENTS}, l as (select session, segment, block, trial, list(code order by sample) as seq, min(sample) as start_sample, list_has_any(list(code), [112, 113, 110, 111]) as has_caption from rows group by all),
x as (select *, list_concat([90, 91, 100, block + 1000, trial, 101], case when has_caption then [112, 113, 110, 111] else [] end) as want from l),
y as (select *, [c for c in want if not list_contains(seq, c)] as gone, [c for c in seq if not list_contains(want, c)] as more, [c for c in want if list_contains(seq, c)] <> [c for c in seq if list_contains(want, c)] as disorder from x),
z as (select *, case when seq = want then '' else concat_ws('; ', case when len(gone) > 0 then 'missing codes: [' || array_to_string(gone, ', ') || ']' end, case when len(more) > 0 then 'unexpected codes: [' || array_to_string(more, ', ') || ']' end, case when disorder then 'wrong order' end) end as issues from y)
select session::bigint as session, segment::bigint as segment, block::bigint as block, trial::bigint as trial, start_sample, len(seq)::int as n_events, has_caption, issues, issues = '' as ok from z""")
def trigger_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trial's codes against the expected ones, with what is wrong in words."""
    out = triggers.check_trials(triggers.segments(mended(spark, sf_dir), "session", ["sample"], spread=SPREAD), "session", ["sample"])
    return out.withColumn("session", F.col("session").cast("long"))

"""Queries of composed loaders: sessions and what they lack, captions with overrides, results, annotation files, pilots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checked, composed, enrich, intervals, reports, triggers
from ..sources import array_store, records, sessions, shared, tables
from .analysis import LONG, R, vec
from .registry import query, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("subject"), (F.col("event_id") % 3).alias("session"), "event_id", "event_type", "value")


def _stored(spark: SparkSession, sf_dir: str) -> str:
    """Events of all sessions, and logs that subject 3 and session 2 lack."""
    path = shared.folder(spark, "session-tables")
    tables.write_rows(_events(spark, sf_dir), f"{path}/events.parquet", ("subject", "session"))
    log = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 5).alias("subject"), (F.col("c_custkey") % 3).alias("session"), "c_custkey", "c_acctbal")
    tables.write_rows(log.where("subject <> 3 and session <> 2"), f"{path}/log.parquet", ("subject", "session"))
    return path


@query("""with e as (select user_id % 5 as subject, event_id % 3 as session, count(*) as n from events group by all), w as (select distinct subject, session from e), l as (select distinct c_custkey % 5 as subject, c_custkey % 3 as session from customer where c_custkey % 5 <> 3 and c_custkey % 3 <> 2)
select w.subject, w.session, name, case name when 'events' then true when 'log' then l.subject is not null else false end as present from w cross join (values ('events'), ('log'), ('samples')) v(name) left join l on w.subject = l.subject and w.session = l.session""")
def session_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sessions have which tables; one table does not exist at all."""
    wanted = _events(spark, sf_dir).select("subject", "session").distinct()
    marks = sessions.load_sessions(spark, _stored(spark, sf_dir), wanted, ["events", "log", "samples"])[1]
    return marks.select(F.col("subject").cast("long").alias("subject"), F.col("session").cast("long").alias("session"), "name", "present")


@query("select event_type, count(*)::bigint as n, round(avg(value), 6) as mean, (select round(sum(c_acctbal), 4) from customer where c_custkey % 5 = 1 and c_custkey % 3 = 0) as balance from events where user_id % 5 = 1 and event_id % 3 = 0 group by 1")
def session_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session's tables, of which one is missing, and a summary of those that are there."""
    s = sessions.load_session(spark, _stored(spark, sf_dir), 1, 0, ["events", "log", "samples"], required=("events",))
    if s.missing != ["samples"] or s.get("samples") is not None:
        raise ValueError(f"missing are {s.missing}")
    total = s["log"].agg(F.round(F.sum("c_acctbal"), 4).alias("balance"))
    return s["events"].groupBy("event_type").agg(F.count("*").alias("n"), R(F.avg("value"), "mean")).crossJoin(F.broadcast(total))  # one row


@query("select user_id % 5 as subject, event_type, count(*)::bigint as n from events where event_type in ('click', 'view') and event_id % 3 = 1 group by all")
def session_events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of two kinds of events of one session of all subjects."""
    some = tables.scan_sessions(spark, f"{_stored(spark, sf_dir)}/events.parquet", sessions=[1], event_type=["click", "view"])
    return some.groupBy(F.col("subject").cast("long").alias("subject"), "event_type").agg(F.count("*").alias("n"))


@query("""with s as (select p_partkey as id, case when p_partkey % 4 = 0 then null when p_partkey % 4 = 1 then '  ' when p_partkey % 4 = 2 then '[''' || p_name || ''', ''second'']' else p_name end as said from part where p_partkey % 2 = 0 union all select p_partkey, case when p_partkey % 5 = 0 then ' ' else p_name end from part where p_partkey % 2 = 1)
select id, case when id % 9 = 0 then ['replaced'] when said[1] = '[' then [said[3:length(said) - 12], 'second'] else [said] end as captions from s where trim(coalesce(said, '')) <> ''""")
def session_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions of two logs: blank ones left out, printed lists read, some replaced."""
    k, name = F.col("p_partkey"), F.col("p_name")
    part = table(spark, sf_dir, "part")
    listed = F.concat(F.lit("['"), name, F.lit("', 'second']"))
    one = part.where(k % 2 == 0).select(k.alias("id"), F.when(k % 4 == 0, None).when(k % 4 == 1, "  ").when(k % 4 == 2, listed).otherwise(name).alias("said"))
    two = part.where(k % 2 == 1).select(k.alias("id"), F.when(k % 5 == 0, " ").otherwise(name).alias("said"))
    instead = part.where(k % 9 == 0).select(k.alias("id"), F.array(F.lit("replaced")).alias("captions"))
    return sessions.load_captions([one, two], "id", "said", instead).select("id", "captions")


@query("select s_suppkey as id, case when s_suppkey % 3 = 0 then [s_name, 'x'] else [] end as captions from supplier")
def overridden_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with an override have it, the others an empty list."""
    ids = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_name")
    given = ids.where("id % 3 = 0").select("id", F.array("s_name", F.lit("x")).alias("captions"))
    return sessions.with_overrides(ids.select("id"), given, "id", "captions")


@query("""with c as (select user_id, ts, event_id as block from events where event_type = 'signup'), f as (select user_id, min(ts) as t0, arg_min(block, (ts, block)) as b0 from c group by 1), e as (select event_id, user_id, ts from events where event_type = 'click'),
a as (select e.event_id, e.user_id, e.ts, max(c.ts) as at from e left join c on e.user_id = c.user_id and c.ts <= e.ts group by all)
select a.event_id, coalesce((select max(block) from c where c.user_id = a.user_id and c.ts = a.at), b0) as block from a left join f using (user_id)""")
def asof_or_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block begun last before each click; clicks before the first block get that one."""
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")
    e = table(spark, sf_dir, "events")
    clicks, blocks = e.where("event_type = 'click'").select("event_id", "user_id", seconds), e.where("event_type = 'signup'").select("user_id", seconds, F.col("event_id").alias("block"))
    return intervals.asof_or_first(clicks, blocks, ["user_id"], "t", ["block"]).select("event_id", "block")


@query("select vec_id % 3 as layer, vec_id, place::int as place, round(embedding[place + 1]::double, 5) as r, case when place < 4 then round(2 * embedding[place + 1]::double, 5) end as p from embeddings, range(0, 8) t(place)")
def collected_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of layers in an array store as one long table; one array is shorter."""
    path = shared.folder(spark, "results")
    x = F.col("embedding").cast("array<double>")
    array_store.write_arrays(table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 3).alias("layer"), "vec_id", F.slice(x, 1, 8).alias("r"), F.transform(F.slice(x, 1, 4), lambda v: 2 * v).alias("p")), path, ["layer"])
    out = sessions.collected(array_store.read_arrays(spark, path), ["layer", "vec_id"], {"r": F.col("r"), "p": F.col("p")})
    return out.select("layer", "vec_id", "place", F.round("r", 5).alias("r"), F.round("p", 5).alias("p"))


@query("select 'layer' || (vec_id % 2) as layer, count(*)::bigint as n, round(sum(embedding[1]::double), 4) as total from embeddings where vec_id < (select count(*) // 2 * 2 from embeddings) group by 1")
def consistent_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of equal times and shapes as one table; that they are equal is seen in the pass that writes them."""
    rows = table(spark, sf_dir, "embeddings").withColumn("time", F.expr("vec_id div 2"))
    even = rows.where(F.col("vec_id") < F.lit(rows.count() // 2 * 2))
    layers = checked.Layers({f"layer{k}": even.where(F.col("vec_id") % 2 == k) for k in (0, 1)}, ["time"], "embedding")
    path = shared.folder(spark, "layers")
    layers.df.write.parquet(path)
    layers.verify()
    return spark.read.parquet(path).groupBy("layer").agg(F.count("*").alias("n"), F.round(F.sum(F.col("embedding")[0].cast("double")), 4).alias("total"))


@query("select p_partkey as id, p_partkey || '.jpg' as file_name, (100 + p_size)::bigint as width, (80 + p_size)::bigint as height, p_partkey % 4 as license_id, case when p_partkey % 4 < 3 then 'license ' || (p_partkey % 4) end as license_name from part where p_partkey % 4 in (1, 3)")
def licensed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of an annotation file under some licences, one of which has no name."""
    k = F.col("p_partkey")
    image = F.struct(k.alias("id"), F.concat(k.cast("string"), F.lit(".jpg")).alias("file_name"), (100 + F.col("p_size")).alias("width"), (80 + F.col("p_size")).alias("height"), (k % 4).alias("license"), F.lit("http://x/1_a.jpg").alias("flickr_url"))
    kinds = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(f"license {i}").alias("name"), F.lit("u").alias("url")) for i in range(3)])
    path = shared.folder(spark, "annotations")
    table(spark, sf_dir, "part").agg(F.to_json(F.struct(F.collect_list(image).alias("images"), kinds.alias("licenses")))).coalesce(1).write.text(path)  # the format is one document
    return records.annotated_images(spark, path, "val", [1, 3]).select("id", "file_name", "width", "height", "license_id", "license_name")


@query("""select s_suppkey as id, case when s_suppkey % 3 = 0 then ['first of ' || s_suppkey, 'more'] when s_suppkey % 3 = 1 then ['second of ' || s_suppkey] else [] end as captions from supplier""")
def scene_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions of scenes out of two files: those of the first that has any, trimmed, in its order."""
    k, folder = F.col("s_suppkey"), shared.folder(spark, "captions")
    ids = table(spark, sf_dir, "supplier")
    said = lambda i, text: F.struct(k.alias("image_id"), (k * 10 + i).alias("id"), text.alias("caption"))
    first = ids.where(k % 3 == 0).select(F.explode(F.array(said(0, F.concat(F.lit(" first of "), k.cast("string"))), said(1, F.lit("more ")))).alias("a"))
    second = ids.where(k % 3 < 2).select(said(2, F.concat(F.lit("second of "), k.cast("string"))).alias("a"))
    for n, rows in enumerate((first, second)):
        rows.agg(F.to_json(F.struct(F.sort_array(F.collect_list("a")).alias("annotations")))).coalesce(1).write.text(f"{folder}/{n}")
    return records.captions_of(spark, [f"{folder}/0", f"{folder}/1"], ids.select(k.alias("id")))


@query("select user_id % 9 + 1 as session, case when user_id % 9 = 0 then 1 else 11 + (user_id % 9 - 1) * 14 end + b as block from (select distinct user_id % 9 as user_id from events), range(0, 14) t(b) where user_id % 9 > 0 or b < 10")
def blocks_of_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 9 + 1).alias("session")).distinct()
    return triggers.session_blocks(rows).select("session", "block")


@query("select event_id, round(value - 50, 6) as x_centred, round((value - 50) / 50, 6) as x_scaled, round(40 - value / 2, 6) as y_centred from events where value is not null")
def display_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions from the middle of the screen, y upwards, and in halves of its width."""
    out = enrich.on_screen(table(spark, sf_dir, "events").where("value is not null").select("event_id", F.col("value").alias("x"), (F.col("value") / 2).alias("y")), "x", "y", 100, 80)
    return out.select("event_id", R(F.col("x_centred"), "x_centred"), R(F.col("x_scaled"), "x_scaled"), R(F.col("y_centred"), "y_centred"))


@query("""with e as (select event_id, user_id, value as b, value + 3 as e from events), t as (select user_id, event_id as trial, value - 1 as low, value + 1 as high from events where event_type = 'signup')
select e.event_id, trial from e join t using (user_id) where e.b > low and e.b < high""")
def pilot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of two files in the trials that they begin in, wherever they end."""
    e = table(spark, sf_dir, "events")
    files = [e.where(F.col("event_id") % 2 == k).select("event_id", "user_id", F.col("value").alias("b"), (F.col("value") + 3).alias("e")) for k in (0, 1)]
    trials = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("trial"), (F.col("value") - 1).alias("low"), (F.col("value") + 1).alias("high"))
    return sessions.pilot_events(files, trials, ["user_id"], "b", "e", "low", "high").select("event_id", "trial")


@query("""with x as (select vec_id, vec_id // 8 as scene, vec_id % 5 = 0 as own, vec_id % 4 as subject, [v::double for v in embedding] as x from embeddings), p as (select a.scene, a.own as o, b.own as q, list_cosine_similarity(a.x, b.x) as c from x a join x b on a.scene = b.scene and a.vec_id < b.vec_id),
s as (select scene, avg(c) filter (o <> q) as m, avg(c) filter (not o and not q) as r from p group by 1) select subject, count(*)::bigint as scenes, round(avg(m), 6) as own_mean, round(avg(r), 6) as rest_mean, round(avg(m - r), 6) as difference from (select distinct subject, scene from x where own) join s using (scene) group by 1""")
def agreement_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vec(spark, sf_dir).withColumn("scene", F.expr("vec_id div 8"))
    out = reports.agreement_by_subject(df, "subject", "scene", F.col("vec_id") % 5 == 0, "vec_id", "x")
    return out.select("subject", "scenes", *[R(F.col(c), c) for c in ("own_mean", "rest_mean", "difference")])


@query(f"with {LONG}, m as (select subject, pos, median(v) as m from parts group by all) select vec_id, pos::int as pos, round(v - m, 6) as v from parts join m using (subject, pos)")
def median_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces less the median of their subject."""
    return reports.median_centred(vec(spark, sf_dir), ["subject"], "x").select("vec_id", F.posexplode("x").alias("pos", "v")).withColumn("v", F.round("v", 6))


@query("select s_suppkey, s_name from supplier where s_suppkey in (select c_custkey from customer where c_custkey % 3 = 0) union all select -s_suppkey, null from supplier where s_suppkey not in (select c_custkey from customer where c_custkey % 3 = 0)")
def existing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose file is listed, and (with a minus) the keys that are not."""
    listing = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("s_suppkey"))
    there, gone = sessions.with_existing(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), listing, "s_suppkey")
    return there.unionByName(gone.select((-F.col("s_suppkey")).alias("s_suppkey"), F.lit(None).cast("string").alias("s_name")))


@query("with e as (select user_id, event_type, count(*) as n from events group by all), m as (select user_id, event_id % 3 as run, event_id, value as a, row_number() over (partition by user_id, event_id % 3 order by event_id) as k from events), b as (select user_id, run, median(a) as a from m where k <= 10 group by all) select user_id, coalesce(max(n) filter (event_type = 'click'), 0)::bigint as clicks, (select count(*) from b where b.user_id = e.user_id)::bigint as runs, round((select stddev_pop(a) from b where b.user_id = e.user_id), 6) as a_sd from e group by 1")
def recording_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by kind and how far apart a user's runs begin."""
    e = table(spark, sf_dir, "events")
    out = reports.recording_statistics(e, e.select("user_id", (F.col("event_id") % 3).alias("run"), "event_id", F.col("value").alias("a")), ["user_id"], "event_type", ["run"], ["event_id"], ["a"], 10)
    return out.select("user_id", F.coalesce(F.try_element_at("events", F.lit("click")), F.lit(0)).cast("long").alias("clicks"), F.col("runs").cast("long").alias("runs"), R(F.col("a_sd"), "a_sd"))


@query("select 'MEG' || lpad((s_suppkey * 7 % 9999)::varchar, 4, '0') as channel, case when s_suppkey % 2 = 0 then 'noisy' else 'flat' end as note from supplier where s_nationkey % 4 = 1 and s_suppkey % 3 <> 0 group by all")
def bad_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels that one run's log calls bad, without those that are only heated."""
    k = F.col("s_suppkey")
    log = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 4).alias("subject"), F.lit(2).alias("session"), F.lit(1).alias("run"), (k * 7 % 9999).alias("channel"), F.when(k % 3 == 0, "heated").when(k % 2 == 0, "noisy").otherwise("flat").alias("note"))
    return records.bad_channels(log, 1, 2, 1, heated=False)


@query("select vec_id, round(embedding[1]::double, 5) as first, size from (select vec_id, vec_id % 11 as size, embedding from embeddings) where size in (2, 5)")
def epochs_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs of an array store with their metadata table, then a predicate on that."""
    path = shared.folder(spark, "epochs")
    v = table(spark, sf_dir, "embeddings")
    array_store.write_arrays(v.select((F.col("vec_id") % 2).alias("subject"), "vec_id", F.col("embedding").cast("array<double>").alias("data")), path, ["subject"])
    tables.write_rows(v.select("vec_id", (F.col("vec_id") % 11).alias("size")), f"{path}-metadata.parquet")
    both = records.with_metadata(array_store.read_arrays(spark, path), tables.read_table(spark, f"{path}-metadata.parquet"), ["vec_id"], ["data"])
    return composed.complete(both.where("size in (2, 5)"), ["x"]).select("vec_id", F.round(F.col("x")[0], 5).alias("first"), "size")

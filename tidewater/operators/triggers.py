"""Trigger streams: repair of block codes, the trial of each trigger, onsets, segments and checks of expected sequences.

A stream has a session (``by``), a total order (``order``), a time (``sample``) and a code; the code before it is part of
the stream (``previous``) or follows from the order. ``spread`` = (time, width) deals a session over time buckets, as in
:mod:`tidewater.operators.sequence`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import Spread, scan

# The codes of the experiment's events.
CODES = {
    "scene_on": 100, "scene_off": 101, "fixcross_on": 90, "fixcross_off": 91, "mic_on": 112, "mic_off": 113, "caption_on": 110, "caption_off": 111,
    "calibration_start": 120, "calibration_end": 121, "start_exp": 98, "end_exp": 99,
}
#: Added to a block's number in raw codes (which wrap at 128), and in repaired ones.
RAW_OFFSET, BLOCK_OFFSET, WRAP = 50, 1000, 128
LAST_TRIAL = 30
SCENE = ("fixcross_on", "fixcross_off", "scene_on", "block", "trial", "scene_off")
CAPTION = (*SCENE, "mic_on", "mic_off", "caption_on", "caption_off")


def first_block(session: Column) -> Column:
    return F.when(session == 1, 1).otherwise(11 + (session - 2) * 14).cast("long")


def last_block(session: Column) -> Column:
    return F.when(session == 1, 10).otherwise(first_block(session) + 13).cast("long")


def session_blocks(sessions: DataFrame, session: str = "session") -> DataFrame:
    """The blocks of each session: the first has 10, every later one 14."""
    s = F.col(session)
    return sessions.withColumn("block", F.explode(F.sequence(first_block(s), last_block(s))))


def block_of_raw(code: Column, session: Column) -> Column:
    """The block of this session whose raw code this is, or null: number + 50, less 128 if over 127."""
    inside = lambda b: b.between(first_block(session), last_block(session))
    plain, wrapped = code - RAW_OFFSET, code - RAW_OFFSET + WRAP
    return F.when(inside(plain) & (code < WRAP), plain).when(inside(wrapped) & (wrapped + RAW_OFFSET >= WRAP), wrapped)


def repair(events: DataFrame, session: str, order: list[str], code: str = "code", previous: str = "previous", spread: Spread = None) -> DataFrame:
    """Block codes become 1000 + block. A code that can be a block's is one unless something else has that code too: a trial
    number (up to 30) and caption_on are blocks only right after scene_on, the other event codes only if not after 0.
    ``previous`` of the row after a repaired one follows it. Adds repaired."""
    c, p = F.col(code), F.col(previous)
    after_scene = p == CODES["scene_on"]
    others = [v for k, v in CODES.items() if k != "caption_on"]
    is_block = F.when((c <= LAST_TRIAL) | (c == CODES["caption_on"]), after_scene).when(c.isin(others), p != 0).otherwise(True)
    block = block_of_raw(c, F.col(session))
    marked = events.withColumn("repaired", block.isNotNull() & F.coalesce(is_block, F.lit(False))).withColumn(code, F.when(F.col("repaired"), block + BLOCK_OFFSET).otherwise(c))
    rows = scan(marked, [session], order, spread, before={"__pre": F.struct("repaired", F.col(code).alias("c"))})
    return rows.withColumn(previous, F.when(F.col("__pre.repaired"), F.col("__pre.c")).otherwise(p)).drop("__pre")


def code_counts(raw: DataFrame, repaired: DataFrame, code: str, by: list[str] | None = None) -> DataFrame:
    """n_raw, n_repaired and delta of the codes of either stream, 0 where a code is absent."""
    keys = [*(by or []), code]
    a = raw.groupBy(*keys).agg(F.count("*").alias("n_raw"))
    b = repaired.groupBy(*keys).agg(F.count("*").alias("n_repaired"))
    return a.join(b, keys, "full_outer").fillna({"n_raw": 0, "n_repaired": 0}).withColumn("delta", F.col("n_repaired") - F.col("n_raw"))


def audit(counts: DataFrame, session: str, code: str = "code") -> DataFrame:
    """:func:`code_counts` by session and code with the code's label ('' without) and four flags: whether an event has
    this code, a block's raw code is this, it is a repaired block, and an event and a block share it."""
    c = F.col(code)
    label = F.coalesce(*[F.when(c == v, k) for k, v in CODES.items()], F.lit(""))
    alias = block_of_raw(c, F.col(session)).isNotNull()
    return counts.withColumns({"label": label, "is_event": label != "", "is_block_alias": alias, "is_repaired_block": c >= BLOCK_OFFSET, "collision": (label != "") & alias})


def relabel(events: DataFrame, by: list[str], order: list[str], code: str, rule: Column, new: Column, spread: Spread = None) -> DataFrame:
    """Codes replaced where ``rule`` holds (it may use the column previous, the code before); previous follows them."""
    out = scan(events, by, order, spread, before={"previous": F.col(code)}).withColumn("repaired", F.coalesce(rule, F.lit(False)))
    out = out.withColumn(code, F.when(F.col("repaired"), new).otherwise(F.col(code)))
    return scan(out, by, order, spread, before={"previous": F.col(code)})


def trial_of(events: DataFrame, session: str, order: list[str], target: int, code: str = "code", previous: str = "previous", reach: int = 199, spread: Spread = None) -> DataFrame:
    """For each row of code ``target`` block and trial: of the nearest of the ``reach`` rows before it that has a trial's
    number right after a block's code of this session. Rows without one are left out."""
    c, p = F.col(code), F.col(previous) - BLOCK_OFFSET
    valid = c.between(1, LAST_TRIAL) & p.between(first_block(F.col(session)), last_block(F.col(session)))
    numbered = scan(events, [session], order, spread, sums={"__row": F.lit(1)})
    named = F.struct(F.col("__row").alias("r"), p.cast("long").alias("block"), c.cast("long").alias("trial"))
    found = scan(numbered, [session], order, spread, lasts={"__at": F.when(valid, named)}).where((F.col(code) == target) & (F.col("__row") - F.col("__at.r") <= reach))
    return found.select(*events.columns, F.col("__at.block").alias("block"), F.col("__at.trial").alias("trial"))


def onsets(events: DataFrame, session: str, order: list[str], sample: str = "sample", code: str = "code", previous: str = "previous", timing: str = "between", spread: Spread = None) -> DataFrame:
    """session, block, trial, onset of each trial number that follows its block's code, the first of each (block, trial).
    ``timing``: between (half-way from the row before), block (that row) or trial (the number's own row). Blocks 50 and 78
    have no code of their own: where a trial's number occurs 14 times in all, they take the twelfth (of ``session``)."""
    before, own = F.col("__before"), F.col(sample)
    at = {"between": (before + own) / 2, "block": before.cast("double"), "trial": own.cast("double")}[timing]
    numbers = scan(events, [session], order, spread, before={"__before": own}).withColumn("onset", at).where(F.col(code).between(1, LAST_TRIAL))
    block = F.col(previous) - BLOCK_OFFSET
    told = numbers.where(block.between(1, 999)).groupBy(session, block.cast("long").alias("block"), F.col(code).cast("long").alias("trial")).agg(F.min_by("onset", F.struct(*order)).alias("onset"))
    s = F.col(session)
    often = numbers.groupBy(session, code).agg(F.count("*").alias("__of")).where("__of = 14")  # few rows are left, so the twelfth is found among 14
    some = numbers.join(often, [session, code]).withColumn("__n", F.row_number().over(Window.partitionBy(session, code).orderBy(*order)))
    lone = some.where("__n = 12").select(session, F.explode(F.array(F.lit(50).cast("long"), F.lit(78).cast("long"))).alias("block"), F.col(code).cast("long").alias("trial"), "onset")
    lone = lone.where(F.col("block").between(first_block(s), last_block(s))).join(told, [session, "block", "trial"], "left_anti")
    return told.unionByName(lone)


def placed_events(onset: DataFrame, trials: DataFrame, events: DataFrame, session: str, scene: str, rate: float, scene_seconds: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """Events at their time in the recording, and the trials without an onset. ``trials``: session, block, trial, scene;
    ``events``: session, scene, kind, time_in_trial, duration. An event goes to every trial of its session that shows its
    scene (they are matched by scene); each trial adds a row of kind scene."""
    keys = [session, "block", "trial"]
    shown = trials.select(*keys, scene).dropDuplicates(keys).join(onset, keys, "left")
    there = shown.where("onset is not null").withColumn("__t", F.col("onset") / rate)
    inside = there.join(events, [session, scene]).select(*keys, "kind", (F.col("__t") + F.col("time_in_trial")).alias("time"), "duration")
    scenes = there.select(*keys, F.lit("scene").alias("kind"), F.col("__t").alias("time"), F.lit(scene_seconds).alias("duration"))
    return inside.unionByName(scenes), shown.where("onset is null").select(*keys)


def anchored(events: DataFrame, triggers: DataFrame, session: str, order: list[str], trial: str, time: str, rate: float, low: float, high: float, n_samples: int, delay: float = 0.02, sample: str = "sample", code: str = "code") -> DataFrame:
    """Sample of each event: that of its trial's scene, plus its time in the trial and a fixed ``delay``, as whole samples.
    The scene's sample belongs to the first trigger of the trial's number: half-way from a scene_on right before it, else
    the row before; without one (or where it is the first row) the session's first scene_on. Events whose window from
    ``low`` to ``high`` seconds leaves the recording of ``n_samples`` are left out."""
    w = Window.partitionBy(session).orderBy(*order)
    rows = triggers.withColumns({"__s": F.lag(sample).over(w), "__c": F.lag(code).over(w)})
    between = F.col("__s") + F.floor((F.col(sample) - F.col("__s")) / 2)
    scene = rows.withColumn("scene_at", F.when(F.col("__c") == CODES["scene_on"], between).otherwise(F.col("__s"))).where("scene_at is not null")
    first = scene.groupBy(session, F.col(code).alias(trial)).agg(F.min_by("scene_at", F.struct(*order)).alias("scene_at"))
    default = triggers.where(F.col(code) == CODES["scene_on"]).groupBy(session).agg(F.min_by(sample, F.struct(*order)).alias("__default"))
    out = events.join(first, [session, trial], "left").join(default, session, "left").withColumn("scene_at", F.coalesce("scene_at", "__default"))
    out = out.where("scene_at is not null").withColumn("event_at", (F.col("scene_at") + ((F.col(time) + delay) * rate).cast("long")).cast("long"))
    return out.where((F.col("event_at") + int(low * rate) >= 0) & (F.col("event_at") + int(high * rate) < n_samples)).drop("__default", "scene_at")


def segments(events: DataFrame, session: str, order: list[str], code: str = "code", reach: int = 19, spread: Spread = None) -> DataFrame:
    """The rows of each trial: session, block, trial, segment (number of its anchor) and the stream's columns.

    An anchor is a block's code of this session right before a trial's number. Its segment begins at the nearest
    fixcross_on of the ``reach`` rows before it (else at the anchor) and ends before the next fixcross_on or block code
    after the number. A row can belong to two segments, as their beginnings reach back. All frames are linear: the next
    stop is looked for from the end, and what stops a row after the next one is what stops that.
    """
    s, c = F.col(session), F.col(code)
    is_block = (c - BLOCK_OFFSET).between(first_block(s), last_block(s))
    rows = scan(events, [session], order, spread, sums={"__row": F.lit(1)}, totals={"__all": F.lit(1)})
    cross, stop = c == CODES["fixcross_on"], (c == CODES["fixcross_on"]) | (c >= BLOCK_OFFSET)
    near = scan(rows, [session], order, spread, lasts={"__cross": F.when(cross, F.col("__row"))}, nexts={"__stop": F.when(stop, F.col("__row"))}, after={"__next": c})
    marked = scan(near, [session], order, spread, after={"__stop": F.col("__stop")})
    begin = F.when(F.col("__row") - F.col("__cross") <= reach, F.col("__cross")).otherwise(F.col("__row"))
    anchors = marked.where(is_block & F.col("__next").between(1, LAST_TRIAL)).select(
        session, F.col("__row").cast("long").alias("segment"), (c - BLOCK_OFFSET).cast("long").alias("block"), F.col("__next").cast("long").alias("trial"), F.explode(F.sequence(begin, F.coalesce(F.col("__stop") - 1, F.col("__all")))).alias("__row")
    )
    return anchors.join(rows.drop("__all"), [session, "__row"]).drop("__row")


def check_trials(segments: DataFrame, session: str, order: list[str], sample: str = "sample", code: str = "code") -> DataFrame:
    """One row for each segment: start sample, number of codes, whether it has caption codes, issues ('' without) and ok.
    Expected are the codes of a scene (with captions: and those of a caption) in order."""
    keys = [session, "segment", "block", "trial"]
    listed = segments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(code).cast("long").alias("__c"), F.col(sample).alias("__s")))).alias("__r"))  # the codes of one trial
    named = {"block": F.col("block") + BLOCK_OFFSET, "trial": F.col("trial")} | {k: F.lit(v).cast("long") for k, v in CODES.items()}
    plain, spoken = (F.array(*[named[k] for k in which]) for which in (SCENE, CAPTION))
    out = listed.withColumn("__seq", F.col("__r.__c")).withColumn("has_caption", F.arrays_overlap("__seq", F.array(*[F.lit(CODES[k]).cast("long") for k in CAPTION[6:]])))
    out = out.withColumn("__want", F.when(F.col("has_caption"), spoken).otherwise(plain))
    keep = lambda a, b: F.filter(a, lambda x: F.array_contains(b, x))
    drop = lambda a, b: F.filter(a, lambda x: ~F.array_contains(b, x))
    text = lambda a: F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ", "), F.lit("]"))
    missing, extra = drop(F.col("__want"), F.col("__seq")), drop(F.col("__seq"), F.col("__want"))
    disorder = keep(F.col("__want"), F.col("__seq")) != keep(F.col("__seq"), F.col("__want"))
    issues = F.concat_ws(
        "; ", F.when(F.size(missing) > 0, F.concat(F.lit("missing codes: "), text(missing))), F.when(F.size(extra) > 0, F.concat(F.lit("unexpected codes: "), text(extra))), F.when(disorder, F.lit("wrong order"))
    )
    out = out.withColumn("issues", F.when(F.col("__seq") == F.col("__want"), "").otherwise(issues))
    return out.select(*keys, F.col("__r")[0]["__s"].alias("start_sample"), F.size("__seq").alias("n_events"), "has_caption", "issues", (F.col("issues") == "").alias("ok"))


def check_sequences(segments: DataFrame, by: list[str], order: list[str], code: str, expected: list[str]) -> DataFrame:
    """One row for each segment: missing and extra codes, whether the expected ones come in order, and ok."""
    want = F.array(*map(F.lit, expected))
    seen = F.transform(F.array_sort(F.collect_list(F.struct(*order, code))), lambda s: s[code])
    out = segments.groupBy(*by).agg(seen.alias("__seen"))
    known = F.filter("__seen", lambda c: F.array_contains(want, c))
    places = F.transform(known, lambda c: F.array_position(want, c))
    ordered = places == F.array_sort(places)
    out = out.withColumns({"missing": F.array_join(F.array_except(want, F.col("__seen")), ","), "extra": F.array_join(F.array_sort(F.array_except(F.col("__seen"), want)), ","), "ordered": ordered})
    return out.withColumn("ok", (F.col("missing") == "") & (F.col("extra") == "") & F.col("ordered")).drop("__seen")

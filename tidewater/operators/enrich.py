"""Raw events into analysed ones: the trial that contains them, what its log says, clocks, sequences and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals, sequence
from .quantiles import exact_quantiles
from .scans import Spread, scan

#: Seconds between a trigger and what is on the screen.
DELAY = 0.02
SCENE_SECONDS, MIC_SECONDS = 4.0, 1.0
POSITIONS = ("mean_gx", "mean_gy", "start_gx", "start_gy", "end_gx", "end_gy")


def place_in_trials(events: DataFrame, trials: DataFrame, by: list[str], key: list[str], mode: str = "strict", bucket: float = 3600.0) -> DataFrame:
    """All events with the trial's columns and time_in_trial (from its onset, plus the fixed delay); null outside of trials.
    ``trials``: by, trial, onset, offset and what else it has."""
    own = [c for c in trials.columns if c not in (*by, "onset", "offset")]
    inside = intervals.assign(events.select(*by, *key, "start_time", "end_time"), trials, by, key, "start_time", "end_time", "onset", "offset", mode=mode, bucket=bucket)
    inside = inside.select(*by, *key, *own, (F.col("start_time") - F.col("onset") + DELAY).alias("time_in_trial"))
    return events.join(inside, [*by, *key], "left")


def session_trial(trial: Column, session: Column, practice: int = 30) -> Column:
    """Trials are counted on from the first session's practice ones in later sessions."""
    return F.when(session > 1, trial - practice).otherwise(trial)


def trial_clock(rows: DataFrame, by: list[str], order: list[str], kind: str, time: str, duration: str, name: str = "clock") -> DataFrame:
    """Time in the whole trial: captions begin after the last scene and the last microphone phase before them, microphone
    phases after the last scene; without one it counts as 4 s and 1 s."""
    past = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda k, default: F.coalesce(F.last(F.when(F.col(kind) == k, F.col(duration)), ignorenulls=True).over(past), F.lit(default))
    scene, mic = last("scene", SCENE_SECONDS), last("microphone", MIC_SECONDS)
    return rows.withColumn(name, F.col(time) + F.when(F.col(kind) == "caption", scene + mic).when(F.col(kind) == "microphone", scene).otherwise(0.0))


def merge_saccades(events: DataFrame, by: list[str], order: list[str], kind: str, time: str, duration: str, merged: str = "saccade", spread: Spread = None) -> DataFrame:
    """Runs of ``merged`` rows become their first (multi: first, else no), which lasts to the next row that is kept; at the
    end of a trial its duration stays."""
    out = sequence.merge_runs(events, by, order, kind, merged, time, spread)
    many = F.col("run_length") > 1
    return out.withColumn("multi", F.when(many, "first").otherwise("no")).withColumn(duration, F.when(many, F.coalesce("span", duration)).otherwise(F.col(duration))).drop("run_length", "span")


def sequences(events: DataFrame, by: list[str], order: list[str], kind: str, spread: Spread = None) -> DataFrame:
    """fix_sequence, sac_sequence and both from the last (0, -1, ...) within ``by``; null on rows of other kinds."""
    out = sequence.positions(events, by, order, "fix_sequence", F.col(kind) == "fixation", spread)
    return sequence.positions(out, by, order, "sac_sequence", F.col(kind) == "saccade", spread)


def neighbours_by_kind(events: DataFrame, by: list[str], order: list[str], kind: str, values: list[str], labels: list[str], spread: Spread = None) -> DataFrame:
    """``values`` of the saccades right before and after a fixation, and ``labels`` of the fixations beside a saccade, as
    _pre and _post. The first fixation of a trial takes none from before it unless that saccade is not its trial's last,
    and so on for the last one; saccades look at their own position."""
    seen = F.struct(*dict.fromkeys([kind, "sac_sequence", "sac_sequence_from_last", *values, *labels]))
    rows = scan(events, by, order, spread, before={"__lag": seen}, after={"__lead": seen})
    k, of = F.col(kind), lambda c, step: F.col(f"__lag.{c}" if step < 0 else f"__lead.{c}")
    from_sac = {
        "pre": (k == "fixation") & (of(kind, -1) == "saccade") & (F.coalesce(F.col("fix_sequence") > 0, F.lit(False)) | F.coalesce(of("sac_sequence_from_last", -1) < 0, F.lit(False))),
        "post": (k == "fixation") & (of(kind, 1) == "saccade") & (F.coalesce(F.col("fix_sequence_from_last") < 0, F.lit(False)) | F.coalesce(of("sac_sequence", 1) > 0, F.lit(False))),
    }
    from_fix = {"pre": (k == "saccade") & (of(kind, -1) == "fixation") & (F.col("sac_sequence") > 0), "post": (k == "saccade") & (of(kind, 1) == "fixation") & (F.col("sac_sequence_from_last") < 0)}
    step = {"pre": -1, "post": 1}
    out = {f"{c}_{side}": F.when(cond, of(c, step[side])) for side, cond in from_sac.items() for c in values}
    out |= {f"{c}_{side}": F.when(cond, of(c, step[side])) for side, cond in from_fix.items() for c in labels}
    return rows.withColumns(out).drop("__lag", "__lead")


def enrich(events: DataFrame, trials: DataFrame, log: DataFrame, by: list[str], key: list[str], mode: str = "strict", bucket: float = 3600.0) -> DataFrame:
    """Events (by, key, type, start_time, end_time, duration, amplitude) in their trials, with the first row that the log has
    for the trial, runs of saccades merged, sequence positions and neighbours."""
    order = ["time_in_trial", *key]
    placed = place_in_trials(events, trials, by, key, mode, bucket).where("trial is not null")
    placed = intervals.bucketed_lookup(placed, log, [*by, "trial"], [F.col(c) for c in log.columns if c not in (*by, "trial")])
    merged = merge_saccades(placed, [*by, "trial"], order, "type", "time_in_trial", "duration")
    return neighbours_by_kind(sequences(merged, [*by, "trial"], order, "type"), by, ["trial", *order], "type", ["amplitude", "duration"], [])


def clean(events: DataFrame, kind: str = "type", duration: str = "duration", drop_blinks: bool = True, least_fixation: float = 0.05, most_saccade: float = 0.1, width: float = 1024, height: float = 768, positions: tuple[str, ...] = POSITIONS) -> DataFrame:
    """Staged filter: blinks go, short fixations and long saccades go, and rows with any gaze position off the screen or
    missing (of those columns that there are)."""
    k, d = F.col(kind), F.col(duration)
    keep = F.lit(True) if not drop_blinks else ~F.coalesce(k == "blink", F.lit(False))
    keep &= (k != "fixation") | (d >= least_fixation)
    keep &= (k != "saccade") | (d <= most_saccade)
    for c in positions:
        if c in events.columns:
            keep &= F.col(c).between(0, width if c.endswith("x") else height)
    return events.where(keep)


def without_artifacts(events: DataFrame, by: list[str], order: list[str], kind: str = "type", most_fixation: float = 5.0, most_amplitude: float = 500.0, least_gap: float = 0.02, spread: Spread = None) -> DataFrame:
    """Fixations that last too long and saccades that go too far are left out (null durations and amplitudes stay), then of
    two saccades too close to each other the smaller one."""
    is_long = F.coalesce((F.col(kind) == "fixation") & (F.col("duration") > most_fixation), F.lit(False))
    is_far = F.coalesce((F.col(kind) == "saccade") & (F.col("amplitude") > most_amplitude), F.lit(False))
    some = events.where(~is_long & ~is_far)
    saccade = F.coalesce(F.col(kind) == "saccade", F.lit(False))
    beside = scan(some.where(saccade), by, order, spread, before={"__pre": F.struct("end_time", "amplitude")}, after={"__post": F.struct("start_time", "amplitude")})
    marked = beside.withColumns({"__gap": F.col("start_time") - F.col("__pre.end_time"), "__next": F.col("__post.start_time") - F.col("end_time"), "__a0": F.col("__pre.amplitude"), "__a1": F.col("__post.amplitude")})
    smaller = lambda a, b: F.coalesce(a < b, F.lit(False))
    goes = F.coalesce(F.col("__gap") < least_gap, F.lit(False)) & ~smaller(F.col("__a0"), F.col("amplitude")) | F.coalesce(F.col("__next") < least_gap, F.lit(False)) & smaller(F.col("amplitude"), F.col("__a1"))
    return marked.where(~goes).select(some.columns).unionByName(some.where(~saccade))


def without_last(events: DataFrame, from_last: str = "fix_sequence_from_last") -> DataFrame:
    """Without the last fixations; rows that have no position stay."""
    return events.where(~F.col(from_last).eqNullSafe(0))


def at_offset(events: DataFrame, time: str = "time_in_trial", duration: str = "duration") -> DataFrame:
    """Times of the end instead of the begin of each event."""
    return events.withColumn(time, F.col(time) + F.col(duration))


def quality(events: DataFrame, by: list[str], seconds: float, kind: str = "type", duration: str = "duration") -> DataFrame:
    """By group: n, rate, mean, median and standard deviation of the duration for each kind of event, and the share of
    ``seconds`` that events cover."""
    out, names = [], []
    kinds = ("fixation", "saccade", "blink")
    for k in kinds:
        d, n = F.when(F.col(kind) == k, F.col(duration)), F.count_if(F.col(kind) == k)
        out += [n.alias(f"n_{k}"), (n / seconds).alias(f"{k}_rate"), F.avg(d).alias(f"{k}_mean"), F.stddev_samp(d).alias(f"{k}_sd")]
        names += [f"n_{k}", f"{k}_rate", f"{k}_mean", f"{k}_median", f"{k}_sd"]
    middle = exact_quantiles(events.where(F.col(kind).isin(*kinds)), duration, [0.5], [*by, kind])
    medians = middle.groupBy(*by).agg(*[F.max(F.when(F.col(kind) == k, F.col("__q")[0])).alias(f"{k}_median") for k in kinds])
    totals = events.groupBy(*by).agg(*out, (F.sum(duration) / seconds).alias("coverage"))
    return totals.join(medians, by, "left").select(*by, *names, "coverage")


def on_screen(df: DataFrame, x: str, y: str, width: float, height: float, flip: bool = True) -> DataFrame:
    """Coordinates from the middle of the screen, y upwards if ``flip``, and as shares of half its size (-1 to 1)."""
    cx, cy = F.col(x) - width / 2, (height / 2 - F.col(y)) if flip else F.col(y) - height / 2
    return df.withColumns({f"{x}_centred": cx, f"{y}_centred": cy, f"{x}_scaled": cx / (width / 2), f"{y}_scaled": cy / (height / 2)})


def degrees_per_pixel(pixels: float, size_cm: float, distance_cm: float) -> float:
    """Visual angle of one pixel of a screen."""
    import math

    return math.degrees(2 * math.atan(size_cm / pixels / 2 / distance_cm))


def in_milliseconds(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Groups whose median is below 1 are in seconds: these become milliseconds."""
    medians = exact_quantiles(df, value, [0.5], by)
    joined = df.join(medians, by, "left") if by else df.crossJoin(F.broadcast(medians))  # one row
    return joined.withColumn(value, F.when(F.col("__q")[0] < 1, F.col(value) * 1000).otherwise(F.col(value))).drop("__q")

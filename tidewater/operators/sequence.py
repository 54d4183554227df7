"""Order-dependent features of event streams. ``order`` must be total: rows that tie make results undefined.

With ``spread`` = (time, width), a time that never falls along the order and a width in its unit, the operators work inside
(key, time bucket) and hand on one row for each bucket (:mod:`tidewater.operators.scans`), so that a key with a third of all
rows is not one task's work. Without it they work inside the key, in one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles, with_quantiles
from .scans import scan


def _cut(events: DataFrame, spread: tuple[str, float]) -> DataFrame:
    time, width = spread
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6 if "timestamp" in events.schema[time].dataType.typeName() else F.col(time)
    return events.withColumn("__b", F.floor(seconds / width))


def positions(events: DataFrame, by: list[str], order: list[str], name: str = "sequence", where: Column | None = None, spread: tuple[str, float] | None = None) -> DataFrame:
    """``name`` from 0 and ``name``_from_last up to 0 within ``by``; null on rows that ``where`` leaves out."""
    chosen = (F.lit(True) if where is None else F.coalesce(where, F.lit(False))).cast("long")
    if spread:
        rows = _cut(events, spread).withColumn("__chosen", chosen)
        inside = F.sum("__chosen").over(Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        sums = rows.groupBy(*by, "__b").agg(F.sum("__chosen").alias("__s"))
        whole = Window.partitionBy(*by)
        before = sums.select(*by, "__b", (F.sum("__s").over(whole.orderBy("__b")) - F.col("__s")).alias("__before"), F.sum("__s").over(whole).alias("__all"))
        n = F.col("__inside") + F.col("__before") - 1
        out = rows.withColumn("__inside", inside).join(before, [*by, "__b"])
        out = out.withColumns({name: F.when(F.col("__chosen") == 1, n), f"{name}_from_last": F.when(F.col("__chosen") == 1, n - F.col("__all") + 1)})
        return out.drop("__b", "__chosen", "__inside", "__before", "__all")
    part = Window.partitionBy(*by)  # that of the other operators here, so that one shuffle serves all
    n = F.sum(chosen).over(part.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - 1
    last = n - F.sum(chosen).over(part) + 1
    return events.withColumns({name: F.when(chosen == 1, n), f"{name}_from_last": F.when(chosen == 1, last)})


def neighbours(events: DataFrame, by: list[str], order: list[str], columns: list[str], before: str = "pre", after: str = "post", where: Column | None = None, spread: tuple[str, float] | None = None) -> DataFrame:
    """Each column's value on the row before and after; with ``where`` only if that row fulfils it."""
    value = lambda c: F.col(c) if where is None else F.when(where, F.col(c))
    if spread:
        rows = _cut(events, spread).withColumn("__v", F.struct(*[value(c).alias(c) for c in columns]))
        w = Window.partitionBy(*by, "__b").orderBy(*order)
        at = F.struct(*order, "__v")
        ends = rows.groupBy(*by, "__b").agg(F.min(at)["__v"].alias("__first"), F.max(at)["__v"].alias("__last"))
        over = Window.partitionBy(*by).orderBy("__b")
        sides = ends.select(*by, "__b", F.lag("__last").over(over).alias("__left"), F.lead("__first").over(over).alias("__right"))
        joined = rows.withColumns({"__lag": F.lag("__v").over(w), "__lead": F.lead("__v").over(w)}).join(sides, [*by, "__b"])
        pre, post = F.coalesce("__lag", "__left"), F.coalesce("__lead", "__right")
        return joined.withColumns({f"{c}_{before}": pre[c] for c in columns} | {f"{c}_{after}": post[c] for c in columns}).drop("__b", "__v", "__lag", "__lead", "__left", "__right")
    w = Window.partitionBy(*by).orderBy(*order)
    return events.withColumns({f"{c}_{before}": F.lag(value(c)).over(w) for c in columns} | {f"{c}_{after}": F.lead(value(c)).over(w) for c in columns})


def merge_runs(events: DataFrame, by: list[str], order: list[str], kind: str, merged: str, time: str, spread: tuple[str, float] | None = None) -> DataFrame:
    """Keeps the first row of each run of consecutive rows whose ``kind`` is ``merged``: run_length is the run's size and
    span the time from it to the next row that is kept (null at the end). Other rows are runs of their own."""
    numbered = scan(events, by, order, spread, sums={"__row": F.lit(1)}, totals={"__rows": F.lit(1)}, before={"__kind": F.col(kind)})
    first = numbered.where(~F.coalesce((F.col(kind) == merged) & (F.col("__kind") == merged), F.lit(False)))
    found = scan(first, by, order, spread, after={"__next": F.struct("__row", F.col(time).alias("t"))})
    length = F.coalesce(F.col("__next.__row"), F.col("__rows") + 1) - F.col("__row")
    return found.withColumns({"run_length": length, "span": F.col("__next.t") - F.col(time)}).drop("__row", "__rows", "__kind", "__next")


def carry_forward(events: DataFrame, by: list[str], order: list[str], value: str, where: Column, name: str, default: float, spread: tuple[str, float] | None = None) -> DataFrame:
    """The value of the last row before this one that fulfils ``where`` and has one, or the default."""
    held = F.when(where, F.col(value))
    if spread:
        rows = _cut(events, spread).withColumn("__v", held)
        inside = F.last("__v", ignorenulls=True).over(Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        ends = rows.groupBy(*by, "__b").agg(F.max(F.when(F.col("__v").isNotNull(), F.struct(*order, "__v")))["__v"].alias("__last"))
        past = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        handed = ends.select(*by, "__b", F.last("__last", ignorenulls=True).over(past).alias("__before"))
        return rows.withColumn("__inside", inside).join(handed, [*by, "__b"]).withColumn(name, F.coalesce("__inside", "__before", F.lit(default))).drop("__b", "__v", "__inside", "__before")
    past = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn(name, F.coalesce(F.last(held, ignorenulls=True).over(past), F.lit(default)))


def drop_close(events: DataFrame, by: list[str], order: list[str], time: str, least: float, size: str, spread: tuple[str, float] | None = None) -> DataFrame:
    """Of two consecutive rows closer than ``least`` the one of smaller ``size`` goes (ties: the later). Pairs are judged
    on the input, so a drop does not bring other rows together."""
    both = F.struct(F.col(time).alias("t"), F.col(size).alias("s"))
    rows = scan(events, by, order, spread, before={"__pre": both}, after={"__post": both})
    close_before, close_after = F.col(time) - F.col("__pre.t") < least, F.col("__post.t") - F.col(time) < least
    goes = (close_before & (F.col(size) <= F.col("__pre.s"))) | (close_after & (F.col(size) < F.col("__post.s")))
    return rows.where(~F.coalesce(goes, F.lit(False))).drop("__pre", "__post")


def sessions(events: DataFrame, by: list[str], order: list[str], anchor: Column, spread: tuple[str, float] | None = None) -> DataFrame:
    """session: how many anchor rows there are up to this one (0 before the first)."""
    if spread:
        rows = _cut(events, spread).withColumn("__a", F.coalesce(anchor, F.lit(False)).cast("long"))
        inside = F.sum("__a").over(Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        sums = rows.groupBy(*by, "__b").agg(F.sum("__a").alias("__s"))
        before = sums.select(*by, "__b", (F.sum("__s").over(Window.partitionBy(*by).orderBy("__b")) - F.col("__s")).alias("__before"))
        return rows.withColumn("__inside", inside).join(before, [*by, "__b"]).withColumn("session", F.col("__inside") + F.col("__before")).drop("__b", "__a", "__inside", "__before")
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("session", F.sum(F.coalesce(anchor, F.lit(False)).cast("long")).over(w))


def spans(events: DataFrame, by: list[str], order: list[str], time: str, anchor: Column, spread: tuple[str, float] | None = None) -> DataFrame:
    """One row from each anchor row to the next: by, trial (from 1), onset, offset (null at the end)."""
    found = scan(events.where(anchor), by, order, spread, sums={"__n": F.lit(1)}, after={"__to": F.col(time)})
    return found.select(*by, F.col("__n").cast("long").alias("trial"), F.col(time).alias("onset"), F.col("__to").alias("offset"))


def moving_average(events: DataFrame, by: list[str], order: list[str], value: str, reach: int = 2, name: str = "smooth", spread: tuple[str, float] | None = None) -> DataFrame:
    """Mean of the values of the ``reach`` rows before, the row, and those after; rows that are not there and nulls don't count."""
    if not spread:
        return events.withColumn(name, F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-reach, reach)))
    rows = events
    for k in range(1, reach + 1):  # each step takes the neighbours' neighbours
        rows = scan(rows, by, order, spread, before={f"__b{k}": F.col(f"__b{k - 1}" if k > 1 else value)}, after={f"__a{k}": F.col(f"__a{k - 1}" if k > 1 else value)})
    seen = F.array_compact(F.array(*[F.col(f"__b{k}") for k in range(reach, 0, -1)], F.col(value), *[F.col(f"__a{k}") for k in range(1, reach + 1)]))
    mean = F.aggregate(seen, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(seen), F.lit(0))
    return rows.withColumn(name, mean).select(*[c for c in events.columns if c != name], name)


def ranks(events: DataFrame, by: list[str], value: str, ties: list[str], reject: float = 0.02, spread: float | None = None) -> DataFrame:
    """rank from 1 (ties by ``ties``), and rejected: beyond the share 1 - reject of its group. ``spread``: a width of ``value``,
    over whose stretches a group is dealt."""
    ranked = scan(events, by, [value, *ties], (value, spread) if spread else None, sums={"rank": F.lit(1)}, totals={"__n": F.lit(1)})
    return ranked.withColumn("rank", F.col("rank").cast("int")).withColumn("rejected", F.col("rank") > F.col("__n") * (1 - reject)).drop("__n")


def days_from_first(events: DataFrame, by: list[str], time: str) -> DataFrame:
    """Whole days since the group's first row. The first is aggregated with partial sums and joined."""
    first = events.groupBy(*by).agg(F.min(time).alias("__first"))
    days = F.floor((F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("__first").cast("timestamp"))) / F.lit(86_400_000_000)).cast("long")
    return events.join(first, by).withColumn("days", days).drop("__first")


def robust_scale(df: DataFrame, by: list[str], value: str, name: str = "scaled") -> DataFrame:
    """(x - median) / IQR by group; an IQR of 0 counts as 1."""
    iqr = F.col("__q")[2] - F.col("__q")[0]
    return with_quantiles(df, value, [0.25, 0.5, 0.75], by).withColumn(name, (F.col(value) - F.col("__q")[1]) / F.when(iqr > 0, iqr).otherwise(1.0)).drop("__q")


def displacement(df: DataFrame, by: list[str], order: list[str], axes: list[str], name: str = "displacement") -> DataFrame:
    """Distance of each row from its group's first row. The first is aggregated with partial sums and joined."""
    first = df.groupBy(*by).agg(F.min(F.struct(*order, *[F.col(a).alias(f"__{a}") for a in axes])).alias("__first"))
    square = sum(((F.col(a) - F.col(f"__first.__{a}")) ** 2 for a in axes), F.lit(0.0))
    return df.join(first, by).withColumn(name, F.sqrt(square)).drop("__first")


def euler_angles(df: DataFrame, q1: str, q2: str, q3: str) -> DataFrame:
    """roll, pitch and yaw in degrees of unit quaternions that are given by their last three parts."""
    x, y, z = F.col(q1), F.col(q2), F.col(q3)
    w = F.sqrt(F.greatest(1 - x * x - y * y - z * z, F.lit(0.0)))
    pitch = F.asin(F.least(F.greatest(2 * (w * y - z * x), F.lit(-1.0)), F.lit(1.0)))
    return df.withColumns({"roll": F.degrees(F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))), "pitch": F.degrees(pitch), "yaw": F.degrees(F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)))})


def repositioning(df: DataFrame, by: list[str], run: list[str], order: list[str], axes: list[str], first: int = 100) -> DataFrame:
    """By group the standard deviation, over runs, of where each run begins: the medians of its first ``first`` rows."""
    w = Window.partitionBy(*by, *run).orderBy(*order)
    head = df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= first)
    begins = head.groupBy(*by, *run).agg(*[F.median(a).alias(a) for a in axes])  # of ``first`` rows
    return begins.groupBy(*by).agg(F.count("*").alias("runs"), *[F.stddev_pop(a).alias(f"{a}_sd") for a in axes])


def stability(df: DataFrame, by: list[str], axes: list[str], fit: str, least_fit: float = 0.95, least: int = 10) -> DataFrame:
    """By group the standard deviation of each axis over well-fitted rows; groups of fewer than ``least`` are left out."""
    return df.where(F.col(fit) >= least_fit).groupBy(*by).agg(F.count("*").alias("n"), *[F.stddev_pop(a).alias(f"{a}_sd") for a in axes]).where(F.col("n") >= least)


def timeline(df: DataFrame, by: list[str], time: str) -> DataFrame:
    """By group: rows, days from first to last, and median, quartiles, least and most of the whole days between rows."""
    day = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / F.lit(86_400_000_000))
    w = Window.partitionBy(*by).orderBy("__day")
    gaps = df.select(*by, day.alias("__day")).withColumn("__gap", F.col("__day") - F.lag("__day").over(w))
    out = gaps.groupBy(*by).agg(F.count("*").alias("n"), (F.max("__day") - F.min("__day")).alias("span"), F.min("__gap").alias("least"), F.max("__gap").alias("most"))
    return out.join(exact_quantiles(gaps, "__gap", [0.25, 0.5, 0.75], by), by, "left").select(*by, "n", "span", F.col("__q")[1].alias("median"), F.col("__q")[0].alias("q1"), F.col("__q")[2].alias("q3"), "least", "most")


def edges(samples: DataFrame, by: list[str], order: list[str], value: str, spread: tuple[str, float] | None = None) -> DataFrame:
    """Rows at which the value changes to another one than 0, with the value before: events of a stimulus channel."""
    rows = scan(samples, by, order, spread, before={"previous": F.col(value)}).withColumn("previous", F.coalesce("previous", F.lit(0)))
    return rows.where((F.col(value) != F.col("previous")) & (F.col(value) != 0))

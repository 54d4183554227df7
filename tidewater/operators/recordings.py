"""Long recordings in chunks: assembled from irregular samples, filtered, and brought to another rate.

A recording is a table of chunks (by, start, x): x holds the values from sample number ``start`` on. Chunks of one recording
follow each other; what is missing counts as zeros. Work is dealt over stretches of ``width`` results, each of which gets the
samples within the kernel's reach from the chunks around it (overlap-save), so no recording is ever in one task and results do not depend
on how it was cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles
from .scans import Spread, scan

#: Results of one stretch; products of one step inside it.
WIDTH, CELLS = 1 << 16, 1 << 22


def low_pass(up: int, down: int, lobes: int = 10) -> list[float]:
    """A windowed sinc that passes what both rates can hold, of odd length, for :func:`resampled` (times ``up``, for the zeros between)."""
    wide = max(up, down)
    n = np.arange(-lobes * wide, lobes * wide + 1)
    h = np.sinc(n / wide) * np.hamming(len(n))
    return (h / h.sum() * up).tolist()


def resampled(chunks: DataFrame, by: list[str], start: str, x: str, kernel: list[float], up: int = 1, down: int = 1, width: int = WIDTH) -> DataFrame:
    """by, start, x: result m is the sum of sample k times the kernel at m * down - k * up (the kernel's middle is 0; its
    length is odd), for all m within the recording: ``up`` samples for ``down``, by the kernel's phases. With ``up`` = ``down`` = 1 the recording filtered,
    as long as it was."""
    half = len(kernel) // 2
    if len(kernel) % 2 == 0 or up < 1 or down < 1:
        raise ValueError("a kernel of odd length and positive rates")
    keys = [f"__g{i}" for i in range(len(by))]
    rows = chunks.where(F.size(x) > 0).select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(start).cast("long").alias("s"), F.col(x).cast("array<double>").alias("x"))
    ends = rows.groupBy(*keys).agg(F.min("s").alias("first"), (F.max(F.col("s") + F.size("x")) - 1).alias("last"))
    bucket = lambda m: F.floor(m / width)
    low = bucket(F.ceil((F.col("s") * up - half) / down))
    high = bucket(F.floor(((F.col("s") + F.size("x") - 1) * up + half) / down))
    dealt = rows.withColumn("b", F.explode(F.sequence(low, high)))
    # samples that the results of a stretch reach
    k0 = F.ceil((F.col("b") * width * down - half) / up)
    k1 = F.floor((((F.col("b") + 1) * width - 1) * down + half) / up)
    a, z = F.greatest("s", k0), F.least(F.col("s") + F.size("x") - 1, k1)
    cut = dealt.withColumns({"a": a, "z": z}).where("a <= z").select(*keys, "b", "a", F.slice("x", (F.col("a") - F.col("s") + 1).cast("int"), (F.col("z") - F.col("a") + 1).cast("int")).alias("x"))
    named = ends.select(*[F.col(k).alias(f"{k}_") for k in keys], "first", "last")
    joined = cut.join(named, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys] or F.lit(True)).drop(*[f"{k}_" for k in keys])
    h = np.asarray(kernel, float)
    reach = 2 * half // up + 1
    schema = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys), "start long", "x array<double>"])

    def run(group: pa.Table) -> pa.Table:
        first, last, b = (group[c][0].as_py() for c in ("first", "last", "b"))
        m = np.arange(max(b * width, -(-first * up // down)), min((b + 1) * width - 1, last * up // down) + 1)
        lows = group["a"].to_numpy()
        base = int(lows.min())
        held = [v.as_py() for v in group["x"]]
        x = np.zeros(max(int(a) - base + len(v) for a, v in zip(lows, held, strict=True)))
        for a, v in zip(lows, held, strict=True):
            x[int(a) - base : int(a) - base + len(v)] = v
        out, step = np.zeros(len(m)), max(1, CELLS // reach)
        for at in range(0, len(m), step):
            some = m[at : at + step] * down
            k = -((half - some) // up)[:, None] + np.arange(reach)  # from the first sample in reach on
            tap = half + some[:, None] - k * up
            use = (tap >= 0) & (tap < len(h)) & (k >= base) & (k < base + len(x))
            out[at : at + step] = (np.where(use, x[np.clip(k - base, 0, len(x) - 1)], 0) * h[np.clip(tap, 0, len(h) - 1)]).sum(1)
        names = {c: group[c].slice(0, 1) for c in keys}
        done = pa.table({**names, "start": [int(m[0]) if len(m) else 0], "x": pa.array([out.tolist()], pa.list_(pa.float64()))})
        return done if len(m) else done.slice(0, 0)

    made = joined.groupBy(*keys, "b").applyInArrow(run, schema)  # one stretch, whatever the recording's length
    return made.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], F.col("start").alias(start), F.col("x").alias(x))


def steps(samples: DataFrame, by: list[str], time: str, spread: Spread = None) -> DataFrame:
    """Samples with __step, the time from the one before (null for the first)."""
    return scan(samples, by, [time], spread, before={"__before": F.col(time)}).withColumn("__step", F.col(time) - F.col("__before")).drop("__before")


def gaps(samples: DataFrame, by: list[str], time: str, factor: float = 1.5, spread: Spread = None) -> DataFrame:
    """by, onset, duration of the stretches without samples: steps of more than ``factor`` times the recording's median step."""
    each = steps(samples, by, time, spread)
    usual = exact_quantiles(each, "__step", [0.5], by).select(*by, F.col("__q")[0].alias("__usual"))
    wide = each.join(usual, by).where(F.col("__step") > factor * F.col("__usual"))
    return wide.select(*by, (F.col(time) - F.col("__step")).alias("onset"), F.col("__step").alias("duration"))


def assembled(samples: DataFrame, by: list[str], time: str, channels: list[str], rate: float | None = None, chunk: int = WIDTH, spread: Spread = None) -> DataFrame:
    """by, channel, rate, start, x: the channels of irregular samples on one grid for each recording, in chunks.

    The grid begins at the recording's first sample and ends before its last one; its rate is given, or one over the
    median step in whole samples. Values lie on straight lines between a channel's samples (nulls are none), across gaps too, and are 0 before
    its first and after its last one. Recordings of fewer than two times are left out."""
    if missing := [c for c in [*by, time, *channels] if c not in samples.columns]:
        raise KeyError(f"samples lack {missing}")
    rows = samples.where(F.col(time).isNotNull()).select(*by, F.col(time).cast("double").alias("__t"), *[F.col(c).cast("double").alias(c) for c in channels])
    within = (("__t", spread[1]) if spread else None)
    ends = rows.groupBy(*by).agg(F.min("__t").alias("__t0"), F.max("__t").alias("__t1")).where("__t0 < __t1")
    usual = exact_quantiles(steps(rows, by, "__t", within), "__step", [0.5], by).select(*by, F.round(1 / F.col("__q")[0]).alias("rate")) if rate is None else ends.select(*by, F.lit(float(rate)).alias("rate"))
    place = lambda t: F.round((t - F.col("__t0")) * F.col("rate"), 6)  # in samples from the first
    grid = ends.join(usual, by).where("rate > 0").withColumn("__n", F.ceil(place(F.col("__t1"))))
    long = rows.unpivot([*by, "__t"], channels, "channel", "__v").where("__v is not null").join(grid, by).withColumn("__p", place(F.col("__t")))
    keys = [*by, "channel"]
    pairs = scan(long, keys, ["__t"], within, after={"__to": F.struct(F.col("__p").alias("p"), F.col("__v").alias("v"))})
    last = F.coalesce(F.ceil("__to.p") - 1, F.floor("__p"))
    cells = pairs.withColumns({"__a": F.ceil("__p"), "__z": F.least(last, F.col("__n") - 1)}).where("__a <= __z")
    # a segment of grid points between two samples, cut at chunks
    stretch = cells.withColumn("__k", F.explode(F.sequence(F.floor(F.col("__a") / chunk), F.floor(F.col("__z") / chunk))))
    begin = F.col("__k") * chunk
    line = stretch.select(*keys, "__k", F.greatest("__a", begin).alias("__a"), F.least("__z", begin + (chunk - 1)).alias("__z"), "__p", "__v", F.coalesce((F.col("__to.v") - F.col("__v")) / (F.col("__to.p") - F.col("__p")), F.lit(0.0)).alias("__slope"))
    schema = ", ".join([*(f"`{k}` {line.schema[k].dataType.simpleString()}" for k in keys), "__k long", "__x array<double>"])

    def lay(group: pa.Table) -> pa.Table:
        a, z, p, v, slope = (group[k].to_numpy() for k in ("__a", "__z", "__p", "__v", "__slope"))
        base = group["__k"][0].as_py() * chunk
        x = np.zeros(chunk)
        n = z - a + 1
        row = np.repeat(np.arange(len(a)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + a[row]
        x[at - base] = v[row] + (at - p[row]) * slope[row]
        return pa.table({**{k: group[k].slice(0, 1) for k in keys}, "__k": group["__k"].slice(0, 1).cast(pa.int64()), "__x": pa.array([x.tolist()], pa.list_(pa.float64()))})

    laid = line.groupBy(*keys, "__k").applyInArrow(lay, schema)
    every = grid.select(*by, "rate", "__n", F.explode(F.array(*map(F.lit, channels))).alias("channel")).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / chunk))))
    size = F.least(F.lit(chunk), F.col("__n") - begin).cast("int")
    return every.join(laid, [*keys, "__k"], "left").select(*keys, "rate", begin.alias("start"), F.coalesce(F.slice("__x", F.lit(1), size), F.array_repeat(F.lit(0.0), size)).alias("x"))


def density(df: DataFrame, x: str, y: str, weight: str | None = None, cells: int = 64, adjust: float = 1.0, cut: float = 3.0, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """bx, by, x, y, density on a grid of ``cells`` by ``cells``: a Gaussian estimate with a bandwidth for each axis.

    The bandwidth is the (weighted) standard deviation times n^(-1/6), n the effective number of rows, times ``adjust``.
    The grid covers the data and ``cut`` bandwidths around them, or ``bounds`` (x from, to, y from, to: rows outside are left out).
    Rows are counted by cell and the counts convolved along one axis, then the other: after one aggregation the work is that of the grid."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), w.alias("__w")).where("__x is not null and __y is not null and __w > 0")
    if bounds:
        rows = rows.where(F.col("__x").between(*bounds[:2]) & F.col("__y").between(*bounds[2:]))
    sums = rows.agg(F.sum("__w").alias("w"), F.sum(F.col("__w") ** 2).alias("w2"), *[F.min(f"__{a}").alias(f"{a}0") for a in "xy"], *[F.max(f"__{a}").alias(f"{a}1") for a in "xy"], *[(F.sum(F.col("__w") * F.col(f"__{a}")) / F.sum("__w")).alias(f"m{a}") for a in "xy"])
    centred = rows.crossJoin(F.broadcast(sums))  # one row
    spread = centred.agg(F.first("w").alias("w"), F.first("w2").alias("w2"), *[F.first(c).alias(c) for c in ("x0", "x1", "y0", "y1")], *[F.sum(F.col("__w") * (F.col(f"__{a}") - F.col(f"m{a}")) ** 2).alias(f"v{a}") for a in "xy"])
    n = F.col("w") ** 2 / F.col("w2")
    width = {a: F.sqrt(F.col(f"v{a}") / (F.col("w") - F.col("w2") / F.col("w"))) * F.pow(n, F.lit(-1 / 6)) * adjust for a in "xy"}
    scale = spread.withColumns({f"h{a}": width[a] for a in "xy"})
    given = dict(zip(("x0", "x1", "y0", "y1"), bounds, strict=True)) if bounds else {}
    edge = {f"{a}{s}": F.lit(float(given[f"{a}{s}"])) if bounds else F.col(f"{a}{s}") + (1 if s else -1) * cut * F.col(f"h{a}") for a in "xy" for s in (0, 1)}
    scale = scale.select("w", "hx", "hy", *[edge[f"{a}0"].alias(f"{a}a") for a in "xy"], *[((edge[f"{a}1"] - edge[f"{a}0"]) / cells).alias(f"d{a}") for a in "xy"])
    cell = lambda a: F.least(F.greatest(F.floor((F.col(f"__{a}") - F.col(f"{a}a")) / F.col(f"d{a}")), F.lit(0)), F.lit(cells - 1))
    out = rows.crossJoin(F.broadcast(scale)).groupBy(cell("x").alias("bx"), cell("y").alias("by")).agg(F.sum("__w").alias("v"))
    each = F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))
    for b, a in (("bx", "x"), ("by", "y")):
        z = (F.col("__to") - F.col(b)) * F.col(f"d{a}") / F.col(f"h{a}")
        other = "by" if b == "bx" else "bx"
        moved = out.crossJoin(F.broadcast(scale)).withColumn("__to", each).withColumn("v", F.col("v") * F.exp(-0.5 * z * z) / (F.col(f"h{a}") * F.lit(float(np.sqrt(2 * np.pi)))))
        out = moved.groupBy(F.col("__to").alias(b), other).agg(F.sum("v").alias("v"))
    middle = lambda a, b: F.col(f"{a}a") + (F.col(b) + 0.5) * F.col(f"d{a}")
    return out.crossJoin(F.broadcast(scale)).select(F.col("bx").cast("int").alias("bx"), F.col("by").cast("int").alias("by"), middle("x", "bx").alias("x"), middle("y", "by").alias("y"), (F.col("v") / F.col("w")).alias("density"))


def joined_in_order(recordings: DataFrame, by: list[str], run: str, start: str, x: str) -> DataFrame:
    """Runs that follow each other as one recording: each run's chunks begin after the lengths of those before it."""
    length = recordings.groupBy(*by, run).agg(F.max(F.col(start) + F.size(x)).alias("__n"))
    w = Window.partitionBy(*by).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)  # one row a run
    moved = length.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    return recordings.join(moved, [*by, run]).withColumn(start, F.col(start) + F.col("__off")).drop("__off")

"""Points in annotated regions: direct hits, the smallest region of several, the nearest one within a margin; boxes of crops.

Regions are rows of pixels: a mask is a table of (scene, region, y, x0, x1) runs, x1 exclusive, so that hits are a join on
(scene, y) and no mask is unpacked in a task. Margins look at the runs of the rows y - margin to y + margin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTSIDE, NOTHING = (-2, "outside"), (-1, "None")


def runs_of_box(boxes: DataFrame, x: str, y: str, width: str, height: str) -> DataFrame:
    """Runs of rectangular regions: one row for each line of pixels."""
    lines = boxes.where((F.col(width) > 0) & (F.col(height) > 0)).withColumn("__y", F.explode(F.sequence(F.col(y), F.col(y) + F.col(height) - 1)))
    return lines.select(*[c for c in boxes.columns if c not in (x, y, width, height)], F.col("__y").cast("int").alias("y"), F.col(x).cast("int").alias("x0"), (F.col(x) + F.col(width)).cast("int").alias("x1"))


def runs_of_mask(counts: Column, height: Column) -> Column:
    """Column-wise run lengths (off, on, off, ...) as the array of set pixels' runs (place, n), place = x * height + y."""
    ends = F.aggregate(counts, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<place:long,n:long>>").alias("out"), F.lit(False).alias("on")), lambda s, n: F.struct(
        (s["at"] + n).alias("at"), F.when(s["on"] & (n > 0), F.concat(s["out"], F.array(F.struct(s["at"].alias("place"), n.cast("long").alias("n"))))).otherwise(s["out"]).alias("out"), (~s["on"]).alias("on")))["out"]
    return ends


def areas(runs: DataFrame, scene: str = "scene", region: str = "region") -> DataFrame:
    """Area and bounding box (x, y, width, height) of each region."""
    lo_x, lo_y = F.min("x0"), F.min("y")
    return runs.groupBy(scene, region).agg(F.sum(F.col("x1") - F.col("x0")).alias("area"), lo_x.alias("x"), lo_y.alias("y"), (F.max("x1") - lo_x).alias("width"), (F.max("y") - lo_y + 1).alias("height"))


def union_of_runs(runs: DataFrame, by: list[str]) -> DataFrame:
    """Overlapping and touching runs of one line of ``by`` as one: the union of the masks."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by, "y").orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.select(*by, "y", "x0", "x1").withColumn("__new", F.coalesce((F.col("x0") > reach).cast("int"), F.lit(1)))
    part = marked.withColumn("__part", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy(*by, "y", "__part").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("__part")


def _painted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What shows of runs (scene, y, x0, x1, ...) that lie over each other. They come line by line, the ones on top first, so that
    what shows of a line so far lies over all that is still to come: a batch and one line's pieces are held, whatever a line has."""
    left = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
        if not (n := rows.num_rows):
            continue
        rows = rows.combine_chunks()
        new = pc.or_(*[pc.not_equal(rows[c].slice(1), rows[c].slice(0, n - 1)) for c in rows.column_names[:2]]).to_numpy()
        line = np.concatenate([[0], np.cumsum(new)]).astype(np.int64)
        x0, x1 = (rows[c].to_numpy().astype(np.int64) for c in ("x0", "x1"))
        least, span = x0.min(), x1.max() - x0.min() + 1
        edges = np.unique(np.concatenate([line * span + x0 - least, line * span + x1 - least]))  # cells lie between edges
        c0, c1 = (np.searchsorted(edges, line * span + x - least) for x in (x0, x1))
        level = np.frexp(c1 - c0)[1] - 1  # a run is two stretches of 2^level cells, which may overlap
        top = np.full(len(edges), n)
        for k in range(level.max(), -1, -1):
            if k < level.max():  # a stretch as two of half its length
                half = top.copy()
                np.minimum(half[1 << k :], top[: -(1 << k)], out=half[1 << k :])
                top = half
            some = np.flatnonzero(level == k)
            np.minimum.at(top, c0[some], some)
            np.minimum.at(top, c1[some] - (1 << k), some)
        start = np.flatnonzero(np.diff(top, prepend=-1))
        end = np.append(start[1:], len(edges) - 1)
        start, end = start[top[start] < n], end[top[start] < n]
        of = top[start]
        out = rows.take(pa.array(of))
        for c, at in (("x0", start), ("x1", end)):
            k = out.schema.get_field_index(c)
            out = out.set_column(k, out.schema.field(k), pa.array(edges[at] - line[of] * span + least).cast(out.schema.field(k).type))
        done = int(np.searchsorted(line[of], line[-1]))
        left = out.slice(done)
        yield from out.slice(0, done).to_batches()
    if left is not None:
        yield from left.to_batches()


def locate(points: DataFrame, runs: DataFrame, key: list[str], x: str, y: str, width: int, height: int, margin: int = 10, scene: str = "scene", region: str = "region", label: str = "label") -> DataFrame:
    """region and label of each point. Outside of the scene: (-2, 'outside'). In a region: that one, of several the one of
    the smallest area (ties: the smallest id). Else the region of the nearest pixel within ``margin`` (ties: the smallest
    area, then id). Else, and where a scene has no regions: (-1, 'None'). Null coordinates: null.

    ``runs`` carry the region's ``label``. Regions are laid over each other, the smallest on top: what shows of them are pieces
    that don't overlap, as many as a line has pixels at most, whatever the number of regions. Each pixel that points ask for is looked up once:
    in the pieces of its line, and only those without a hit in the lines around, each joined by (scene, y). ``key`` is not needed
    for that. No side of these joins is broadcast: an estimate of their sizes doesn't know of lines.
    """
    px, py = F.col(x).cast("int"), F.col(y).cast("int")
    there = F.col(x).isNotNull() & F.col(y).isNotNull()
    inside = (F.col(x) >= 0) & (F.col(y) >= 0) & (px < width) & (py < height)
    order = [F.col(c) for c in (scene, "y", "__area", region, label)]
    sized = runs.where((F.col("x0") < F.col("x1")) & F.col("y").isNotNull()).join(areas(runs, scene, region).select(scene, region, F.col("area").alias("__area")).hint("merge"), [scene, region]).select(scene, "y", "x0", "x1", "__area", region, label)
    shown = sized.repartition(scene, "y").sortWithinPartitions(*order).mapInArrow(_painted, sized.schema).hint("merge")
    pixel = [scene, "__x", "__y"]
    placed = points.withColumns({"__x": F.when(there & inside, px), "__y": F.when(there & inside, py)})
    asked = placed.where(F.col("__x").isNotNull()).select(*pixel).distinct().withColumn("y", F.col("__y"))
    own = asked.join(shown, (asked[scene] == shown[scene]) & (asked["y"] == shown["y"]) & (F.col("__x") >= F.col("x0")) & (F.col("__x") < F.col("x1")), "left")
    around = F.when(F.col("__area").isNull(), F.sequence(F.col("__y") - margin, F.col("__y") + margin)).otherwise(F.array("__y"))
    lines = own.select(*[asked[c] for c in pixel], F.explode(around).alias("y"))
    dx, dy = F.greatest(F.col("x0") - F.col("__x"), F.col("__x") - (F.col("x1") - 1), F.lit(0)).cast("long"), (F.col("y") - F.col("__y")).cast("long")
    near = lines.join(shown, [scene, "y"]).withColumn("__d", dx * dx + dy * dy).where(F.col("__d") <= margin * margin)
    best = F.struct("__d", "__area", F.col(region).alias("region"), F.col(label).alias("label"))
    joined = placed.join(near.groupBy(*pixel).agg(F.min(best).alias("__best")), pixel, "left")
    pick = lambda field, k: F.when(~there, None).when(~inside, F.lit(OUTSIDE[k])).otherwise(F.coalesce(F.col(f"__best.{field}"), F.lit(NOTHING[k])))
    return joined.select(*points.columns, "__best").withColumns({"region": pick("region", 0), "label": pick("label", 1)}).drop("__best")


def gaze_point(events: DataFrame, kind: str = "type") -> DataFrame:
    """x and y to look up: fixations by their mean, saccades by their end, other events none."""
    of = lambda axis: F.when(F.col(kind) == "fixation", F.col(f"mean_g{axis}")).when(F.col(kind) == "saccade", F.col(f"end_g{axis}"))
    return events.withColumns({"x": of("x"), "y": of("y")})


def crop_box(x: Column, y: Column, size: int, width: int, height: int, clamp: bool = True) -> Column:
    """left, top, right, bottom of a square around a point: moved into the image (``clamp``), or null if it leaves it."""
    left, top = F.bround(x - size / 2).cast("int"), F.bround(y - size / 2).cast("int")
    if clamp:
        left, top = (F.least(F.greatest(v, F.lit(0)), F.lit(most - size)) for v, most in ((left, width), (top, height)))
    box = F.struct(left.alias("left"), top.alias("top"), (left + size).alias("right"), (top + size).alias("bottom"))
    return box if clamp else F.when((left >= 0) & (top >= 0) & (left + size <= width) & (top + size <= height), box)


def fitted(width: Column, height: Column, to_width: int, to_height: int) -> Column:
    """How an image is cut to the wanted shape around its middle and then resized: left, top, cut_width, cut_height, scale."""
    wide = width / height > to_width / to_height
    cut_w = F.when(wide, F.bround(height * to_width / to_height)).otherwise(width).cast("int")
    cut_h = F.when(wide, height).otherwise(F.bround(width * to_height / to_width)).cast("int")
    return F.struct(F.floor((width - cut_w) / 2).cast("int").alias("left"), F.floor((height - cut_h) / 2).cast("int").alias("top"), cut_w.alias("cut_width"), cut_h.alias("cut_height"), (F.lit(to_width) / cut_w).alias("scale"))

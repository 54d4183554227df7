"""Masks of annotations as rows of runs: from polygons and from compressed run lengths, cut and resized, united.

A mask is a table of (keys, y, x0, x1) runs of set pixels, x1 exclusive, as in :mod:`tidewater.operators.regions`. No step
lays out a bitmap: polygons give their crossings with each line, run lengths (which run down columns) are turned into
lines by the places where a column differs from the one before, and cutting and resizing move the ends of runs.

A pixel belongs to a polygon if its centre lies in it (a crossing at the centre itself counts as before it). The
annotation library draws outlines a little wider, by half a pixel, so areas can differ by a part of the outline.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import regions


def runs_of_rings(df: DataFrame, keys: list[str], rings: str, width: Column, height: Column) -> DataFrame:
    """keys, y, x0, x1: the pixels of polygons. ``rings``: an array of rings, each a flat array x, y, x, y, ... of three
    corners or more; rings of one row are filled by the even-odd rule (a ring in another is a hole). Pixels outside of the
    image are left out. Each edge gives one crossing for each line that it meets; lines are groups of their own."""
    numbered = df.select(*keys, F.monotonically_increasing_id().alias("__row"), width.alias("__w"), height.alias("__h"), F.col(rings).alias("__rings"))
    ring = numbered.select(*keys, "__row", "__w", "__h", F.explode("__rings").alias("__r")).withColumn("__n", F.expr("cast(size(__r) div 2 as int)")).where("__n > 2")
    corner = lambda k: F.struct(F.get("__r", 2 * k).cast("double").alias("x"), F.get("__r", 2 * k + 1).cast("double").alias("y"))
    edge = F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda k: F.struct(corner(k).alias("a"), corner((k + 1) % F.col("__n")).alias("b")))
    edges = ring.select(*keys, "__row", "__w", "__h", F.explode(edge).alias("e")).where("e.a.y <> e.b.y")
    first = lambda v: F.ceil(v - 0.5)  # the first line whose centre is not above v
    low = F.greatest(first(F.least("e.a.y", "e.b.y")), F.lit(0))
    high = F.least(first(F.greatest("e.a.y", "e.b.y")), F.col("__h").cast("long")) - 1
    lines = edges.withColumns({"__lo": low, "__hi": high}).where("__lo <= __hi").withColumn("y", F.explode(F.sequence("__lo", "__hi")))
    at = F.col("e.a.x") + (F.col("y") + 0.5 - F.col("e.a.y")) * (F.col("e.b.x") - F.col("e.a.x")) / (F.col("e.b.y") - F.col("e.a.y"))
    crossed = lines.groupBy(*keys, "__row", "__w", "y").agg(F.array_sort(F.collect_list(at)).alias("__at"))  # the crossings of one polygon with one line
    pair = F.transform(F.sequence(F.lit(0), F.expr("cast(size(__at) div 2 as int)") - 1), lambda k: F.struct(F.greatest(first(F.get("__at", 2 * k)), F.lit(0)).alias("x0"), F.least(first(F.get("__at", 2 * k + 1)), F.col("__w").cast("long")).alias("x1")))
    return crossed.select(*keys, F.col("y").cast("int").alias("y"), F.inline(pair)).where("x0 < x1").withColumns({"x0": F.col("x0").cast("int"), "x1": F.col("x1").cast("int")})


def counts_of_text(text: str) -> np.ndarray:
    """Run lengths (off, on, off, ...) of their compressed text. A number is written in groups of five bits, lowest first, each
    as a character from code 48 on, with 32 added if more follow; the fifth bit of the last group is the sign. From the
    fourth number on it is the difference to the number two before."""
    x = np.frombuffer(text.encode(), np.uint8).astype(np.int64) - 48
    if not len(x):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(x & 32 == 0)
    begin = np.concatenate([[0], last[:-1] + 1])
    digit = np.arange(len(x)) - np.repeat(begin, last - begin + 1)
    counts = np.add.reduceat((x & 31) << (5 * digit), begin)
    counts -= np.where(x[last] & 16, np.int64(1) << (5 * (last - begin + 1)), 0)
    counts[1::2] = np.cumsum(counts[1::2])
    counts[2::2] = np.cumsum(counts[2::2])
    return counts


def text_of_counts(counts: np.ndarray) -> str:
    """The compressed text of run lengths; the way back of :func:`counts_of_text`."""
    out = []
    for k, n in enumerate(counts.tolist()):
        v = n - counts[k - 2].item() if k > 2 else n
        while True:
            five, v = v & 31, v >> 5
            more = v != (-1 if five & 16 else 0)
            out.append(48 + five + 32 * more)
            if not more:
                break
    return bytes(out).decode()


def rle_counts(text: Column) -> Column:
    """Run lengths of compressed texts; null for null."""

    @F.pandas_udf("array<long>")
    def decode(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else counts_of_text(t) for t in texts], dtype=object)

    return decode(text)


def rle_text(counts: Column) -> Column:
    """Compressed texts of run lengths; null for null."""

    @F.pandas_udf("string")
    def encode(lists: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else text_of_counts(np.asarray(c, np.int64)) for c in lists], dtype=object)

    return encode(counts)


def lines_of_counts(counts: np.ndarray, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y, x0, x1 of a mask given by run lengths down its columns. A line's run begins where a pixel is set and its left
    neighbour is not, and ends where that is the other way round; both are differences of the set places and the set
    places moved by a column, and the k-th beginning of a line belongs to its k-th end."""
    ends = np.cumsum(counts)
    a, b = ends[0 : len(ends) - 1 : 2], ends[1::2]
    a, b = a[b > a], b[b > a]
    if not len(a):
        return (np.zeros(0, np.int64),) * 3
    at = np.concatenate([a, b, a + height, b + height])
    mine = np.repeat([1, -1, 0, 0], len(a))
    moved = np.repeat([0, 0, 1, -1], len(a))
    order = np.argsort(at, kind="stable")
    at, mine, moved = at[order], np.cumsum(mine[order]) > 0, np.cumsum(moved[order]) > 0

    def places(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.where(which[:-1], np.diff(at), 0)
        place = np.repeat(at[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        x, y = place // height, place % height
        by = np.lexsort((x, y))
        return y[by], x[by]

    y, x0 = places(mine & ~moved)
    return y, x0, places(moved & ~mine)[1]


def runs_of_counts(df: DataFrame, keys: list[str], counts: str, height: str) -> DataFrame:
    """keys, y, x0, x1: the pixels of masks given by run lengths (off, on, off, ...) down their columns. A null has none."""
    given = df.where(F.col(counts).isNotNull()).select(*keys, F.col(counts).cast("array<long>").alias("__c"), F.col(height).cast("long").alias("__h"))
    schema = ", ".join([*(f"`{k}` {given.schema[k].dataType.simpleString()}" for k in keys), "y int", "x0 int", "x1 int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, heights = batch.column(len(keys)), batch.column(len(keys) + 1).to_pylist()
            for at in range(0, batch.num_rows, 64):
                found = [lines_of_counts(np.asarray(lists[i].as_py(), np.int64), heights[i]) for i in range(at, min(at + 64, batch.num_rows))]
                row = pa.array(np.repeat(np.arange(at, at + len(found)), [len(f[0]) for f in found]))
                named = [batch.column(k).take(row) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*named, *(pa.array(np.concatenate([f[k] for f in found]), pa.int32()) for k in range(3))], names=[*keys, "y", "x0", "x1"])

    return given.mapInArrow(run, schema)


def centre_cut(width: Column, height: Column, to_width: int, to_height: int) -> Column:
    """left and top of the cut around the middle that gives the target's shape; as much goes on the other side. Whole
    pixels, rounded down, in whole numbers throughout."""
    wide = width * to_height > height * to_width
    left = F.when(wide, F.floor((width * to_height - height * to_width) / (2 * to_height))).otherwise(0)
    top = F.when(wide, 0).otherwise(F.floor((height * to_width - width * to_height) / (2 * to_width)))
    return F.struct(left.cast("long").alias("left"), top.cast("long").alias("top"))


def resized_runs(runs: DataFrame, keys: list[str], width: str, height: str, to_width: int, to_height: int) -> DataFrame:
    """Masks cut around the middle to the target's shape and resized by the nearest pixel: keys, y, x0, x1. The new pixel i
    takes the old one at floor((i + 0.5) * old / new), so a run's ends move by whole-number arithmetic, and an old line
    gives each of the new lines that take it (none, where lines are left out)."""
    w, h = F.col(width).cast("long"), F.col(height).cast("long")
    cut = runs.withColumn("__cut", centre_cut(w, h, to_width, to_height)).withColumns({"__w": w - 2 * F.col("__cut.left"), "__h": h - 2 * F.col("__cut.top")})
    x = lambda c: F.least(F.greatest(F.col(c) - F.col("__cut.left"), F.lit(0)), F.col("__w"))
    # the first new pixel at or after an old one's begin: ceil((2 * old * new_size - old_size) / (2 * old_size))
    to = lambda v, size, new: F.ceil((2 * v * new - size) / (2 * size)).cast("long")
    y = F.col("y") - F.col("__cut.top")
    inside = cut.where((y >= 0) & (y < F.col("__h")))
    moved = inside.select(*keys, to(x("x0"), F.col("__w"), to_width).alias("x0"), to(x("x1"), F.col("__w"), to_width).alias("x1"), to(y, F.col("__h"), to_height).alias("__a"), (to(y + 1, F.col("__h"), to_height) - 1).alias("__b"))
    lines = moved.where("x0 < x1 and __a <= __b").withColumn("y", F.explode(F.sequence("__a", "__b")))
    return lines.select(*keys, *[F.col(c).cast("int").alias(c) for c in ("y", "x0", "x1")])


def scene_masks(annotations: DataFrame, images: DataFrame, to_width: int, to_height: int, scene: str = "scene", label: str = "label") -> DataFrame:
    """scene, label, y, x0, x1: all annotations of a label in a scene as one mask, in the shape that scenes are shown in.

    ``annotations``: scene, label, and rings, counts (run lengths) or text (compressed ones), the others null or absent;
    ``images``: scene, width, height. Annotations of scenes that are no image go; nothing set, no rows."""
    known = annotations.join(images.select(scene, F.col("width").alias("__iw"), F.col("height").alias("__ih")), scene)
    keys, parts = [scene, label, "__iw", "__ih"], []
    if "rings" in known.columns:
        parts.append(runs_of_rings(known.where(F.col("rings").isNotNull()), keys, "rings", F.col("__iw"), F.col("__ih")))
    lists = [c for c in ("counts", "text") if c in known.columns]
    if lists:
        counts = F.coalesce(*[F.col("counts").cast("array<long>") if c == "counts" else rle_counts(F.col("text")) for c in lists])
        parts.append(runs_of_counts(known.withColumn("__counts", counts), keys, "__counts", "__ih"))
    runs = parts[0]
    for p in parts[1:]:
        runs = runs.unionByName(p)
    return regions.union_of_runs(resized_runs(runs, keys, "__iw", "__ih", to_width, to_height).drop("__iw", "__ih"), [scene, label])


def by_category(annotations: DataFrame, names: DataFrame, category: str, name: str, fallback: str = "category_") -> DataFrame:
    """``annotations`` with the name of their category; one that has none is called by its number."""
    return annotations.join(F.broadcast(names.select(category, name)), category, "left").withColumn(name, F.coalesce(name, F.concat(F.lit(fallback), F.col(category).cast("string"))))

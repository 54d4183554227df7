"""Queries of annotation masks: polygons and compressed run lengths derived from parts, in images of several shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import masks, regions
from .registry import query, table

#: Shape that scenes are shown in.
SHOWN = (40, 30)
#: An image of each scene, two polygons of each part in quarters of pixels (a kite, and a triangle that may cut it), one row each.
IMAGES = "images as (select distinct p_partkey % 40 as scene, 50 + p_partkey % 40 % 7 * 4 as w, 40 + p_partkey % 40 % 5 * 6 as h from part)"
RINGS = """rings as (select p_partkey as part, p_partkey % 40 as scene, p_brand as label, ring, xs, ys from (
  select *, 0 as ring, [cx - a, cx, cx + a, cx] as xs, [cy, cy - b, cy + 0.5, cy + b] as ys from base union all
  select *, 1 as ring, [cx - b, cx + a, cx + 0.75] as xs, [cy + 1.25, cy - 2.5, cy + a] as ys from base))"""
BASE = "base as (select *, (p_partkey * 37 % 260) / 4.0 as cx, (p_partkey * 53 % 200) / 4.0 as cy, 2.0 + p_size / 4.0 as a, 1.5 + p_size % 11 / 2.0 as b from part)"
_cut = f"case when w * {SHOWN[1]} > h * {SHOWN[0]} then (w * {SHOWN[1]} - h * {SHOWN[0]}) // {2 * SHOWN[1]} else 0 end as l, case when w * {SHOWN[1]} > h * {SHOWN[0]} then 0 else (h * {SHOWN[0]} - w * {SHOWN[1]}) // {2 * SHOWN[0]} end as t"


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    cx, cy, a, b = (k * 37 % 260) / 4.0, (k * 53 % 200) / 4.0, 2.0 + s / 4.0, 1.5 + s % 11 / 2.0
    flat = lambda *corners: F.array(*[v.cast("double") for v in corners])
    rings = F.array(flat(cx - a, cy, cx, cy - b, cx + a, cy + 0.5, cx, cy + b), flat(cx - b, cy + 1.25, cx + a, cy - 2.5, cx + 0.75, cy + a))
    return table(spark, sf_dir, "part").select((k % 40).alias("scene"), F.col("p_brand").alias("label"), rings.alias("rings"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    scene = F.col("scene")
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("scene")).distinct().withColumns({"width": 50 + scene % 7 * 4, "height": 40 + scene % 5 * 6})


@query(f"""with {BASE}, {RINGS}, {IMAGES}, shape as (select scene, w, h, w - 2 * l as cw, h - 2 * t as ch, l, t from (select *, {_cut} from images)),
shown as (select scene, i, j, l + (2 * i + 1) * cw // {2 * SHOWN[0]} as x, t + (2 * j + 1) * ch // {2 * SHOWN[1]} as y from shape, range({SHOWN[0]}) a(i), range({SHOWN[1]}) b(j)),
edges as (select part, scene, label, xs[k] as ax, ys[k] as y1, xs[k % len(xs) + 1] as bx, ys[k % len(xs) + 1] as y2 from (select *, unnest(range(1, len(xs) + 1)) as k from rings)),
inside as (select part, e.scene, label, i, j from edges e join shown s on e.scene = s.scene and ((y1 <= y + 0.5) <> (y2 <= y + 0.5)) and ax + (y + 0.5 - y1) * (bx - ax) / (y2 - y1) <= x + 0.5 group by all having count(*) % 2 = 1),
pixels as (select distinct scene, label, i, j from inside)
select scene, label, count(*)::bigint as area, min(i)::int as x, min(j)::int as y, (max(i) - min(i) + 1)::int as width, (max(j) - min(j) + 1)::int as height from pixels group by all""")
def annotation_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and box of each label's mask in a scene: polygons filled, cut to the shown shape, resized, and united."""
    runs = masks.scene_masks(annotations(spark, sf_dir), images(spark, sf_dir), *SHOWN)
    return regions.areas(runs, "scene", "label").select("scene", "label", "area", "x", "y", "width", "height")


TALL = 64


@query(f"""with boxes as (select p_partkey as part, (p_partkey * 37 % 90)::int as x, (p_partkey * 53 % {TALL - 24})::int as y, (2 + p_size)::int as w, (3 + p_size % 20)::int as h from part),
lines as (select part, y + unnest(range(h)) as line, x, w from boxes)
select part, line::int as y, x as x0, (x + w)::int as x1 from lines""")
def compressed_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run lengths down columns, written as compressed text, read again and turned into lines."""
    k, s = F.col("p_partkey"), F.col("p_size")
    box = table(spark, sf_dir, "part").select(k.alias("part"), (k * 37 % 90).cast("int").alias("x"), (k * 53 % (TALL - 24)).cast("int").alias("y"), (2 + s).cast("int").alias("w"), (3 + s % 20).cast("int").alias("h"))
    middle = F.flatten(F.array_repeat(F.array(F.col("h"), F.lit(TALL) - F.col("h")), F.col("w") - 1))
    counts = F.concat(F.array(F.col("x") * TALL + F.col("y")), middle, F.array(F.col("h"), F.lit(TALL) - F.col("h") - F.col("y")))
    text = box.select("part", F.lit(TALL).alias("tall"), masks.rle_text(counts).alias("text"))
    return masks.runs_of_counts(text.select("part", "tall", masks.rle_counts(F.col("text")).alias("counts")), ["part"], "counts", "tall")

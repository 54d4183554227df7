"""Masks as runs against bitmaps."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import masks, regions


def polygon_bitmap(rings, width, height):
    """Even-odd by the centre of each pixel."""
    out = np.zeros((height, width), bool)
    for y in range(height):
        for x in range(width):
            n = 0
            for r in rings:
                p = [(r[k], r[k + 1]) for k in range(0, len(r), 2)]
                for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1], strict=True):
                    if (ay <= y + 0.5) != (by <= y + 0.5) and ax + (y + 0.5 - ay) * (bx - ax) / (by - ay) <= x + 0.5:
                        n += 1
            out[y, x] = n % 2
    return out


def counts_of(bitmap):
    flat = bitmap.T.ravel()
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flat.astype(int), [0]])))
    ends = np.concatenate([edges, [len(flat)]])
    return np.diff(np.concatenate([[0], ends]))


def resized(bitmap, to_width, to_height):
    h, w = bitmap.shape
    x, y = ((w * to_height - h * to_width) // (2 * to_height), 0) if w * to_height > h * to_width else (0, (h * to_width - w * to_height) // (2 * to_width))
    cut = bitmap[y : h - y, x : w - x]
    ys, xs = ((2 * np.arange(n) + 1) * size // (2 * n) for n, size in ((to_height, cut.shape[0]), (to_width, cut.shape[1])))
    return cut[np.ix_(ys, xs)]


def bitmap_of(rows, width, height):
    out = np.zeros((height, width), bool)
    for y, a, b in rows:
        assert not out[y, a:b].any()
        out[y, a:b] = True
    return out


@pytest.fixture(scope="module")
def shapes():
    rng = random.Random(20)
    out = []
    for i in range(24):
        w, h = rng.randint(8, 40), rng.randint(8, 40)
        ring = lambda n, w=w, h=h: [v for _ in range(n) for v in (rng.randint(-8, 4 * w + 8) / 4, rng.randint(-8, 4 * h + 8) / 4)]
        out.append((i, w, h, [ring(rng.randint(3, 8)) for _ in range(rng.randint(1, 3))]))
    return [*out, (98, 10, 9, [[1.0, 1.0, 5.0, 5.0]]), (99, 10, 9, [[0.0, 0.0, 10.0, 0.0, 10.0, 9.0, 0.0, 9.0], [3.0, 3.0, 6.0, 3.0, 6.0, 6.0, 3.0, 6.0]])]


def test_polygons_and_counts(spark, shapes):
    df = spark.createDataFrame(shapes, "i int, w int, h int, rings array<array<double>>")
    bitmaps = {i: polygon_bitmap(rings, w, h) for i, w, h, rings in shapes}
    got = {}
    for r in masks.runs_of_rings(df, ["i"], "rings", F.col("w"), F.col("h")).collect():
        got.setdefault(r["i"], []).append((r["y"], r["x0"], r["x1"]))
    for i, w, h, _ in shapes:
        assert (bitmap_of(got.get(i, []), w, h) == bitmaps[i]).all(), i
    # the same masks as run lengths down columns, compressed and back
    lists = spark.createDataFrame([(i, h, counts_of(bitmaps[i]).tolist()) for i, _, h, _ in shapes] + [(500, 4, None), (501, 4, [12])], "i int, h int, counts array<long>")
    text = lists.withColumn("text", masks.rle_text(F.col("counts")))
    back = text.withColumn("counts", masks.rle_counts(F.col("text")))
    assert {r["i"]: r["counts"] for r in back.collect()} == {r["i"]: r["counts"] for r in lists.collect()}
    lines = {}
    for r in masks.runs_of_counts(back, ["i"], "counts", "h").collect():
        lines.setdefault(r["i"], []).append((r["y"], r["x0"], r["x1"]))
    assert lines.keys() == {i for i, b in bitmaps.items() if b.any()}
    for i, w, h, _ in shapes:
        assert (bitmap_of(lines.get(i, []), w, h) == bitmaps[i]).all(), i


def test_compressed_text_is_the_published_form():
    """A number below 16 is one character; larger and negative ones take more; the fourth is a difference."""
    assert masks.text_of_counts(np.array([6, 1, 40, 4, 5])) == "61X13" + "mN"
    assert masks.counts_of_text("61X13mN").tolist() == [6, 1, 40, 4, 5]
    rng = np.random.default_rng(3)
    for _ in range(200):
        counts = rng.integers(0, 10 ** int(rng.integers(1, 7)), int(rng.integers(0, 30)))
        assert masks.counts_of_text(masks.text_of_counts(counts)).tolist() == counts.tolist()


@pytest.mark.parametrize("size", [(16, 12), (64, 48), (7, 40)])
def test_scene_masks(spark, shapes, size):
    """Cut, resized and united masks of scenes with both kinds of annotations."""
    bitmaps = {i: polygon_bitmap(rings, w, h) for i, w, h, rings in shapes}
    annotations = [(i, "ab"[i % 2], rings, None) for i, w, h, rings in shapes] + [(i, "a", None, masks.text_of_counts(counts_of(np.roll(bitmaps[i], 2, 1)))) for i, *_ in shapes[:6]] + [(777, "a", [[0.0, 0.0, 1.0, 0.0, 1.0, 1.0]], None)]
    df = spark.createDataFrame(annotations, "scene int, label string, rings array<array<double>>, text string")
    images = spark.createDataFrame([(i, w, h) for i, w, h, _ in shapes], "scene int, width int, height int")
    want = {}
    for i, label, rings, text in annotations:
        if i in bitmaps:
            m = resized(bitmaps[i] if rings else np.roll(bitmaps[i], 2, 1), *size)
            want[i, label] = want.get((i, label), False) | m
    got = {}
    runs = masks.scene_masks(df, images, *size)
    for r in runs.collect():
        got.setdefault((r["scene"], r["label"]), []).append((r["y"], r["x0"], r["x1"]))
    assert got.keys() == {k for k, m in want.items() if m.any()}
    for k, rows in got.items():
        assert (bitmap_of(rows, *size) == want[k]).all(), k
    sizes = {(r["scene"], r["label"]): (r["area"], r["x"], r["y"], r["width"], r["height"]) for r in regions.areas(runs, "scene", "label").collect()}
    for k, m in want.items():
        if m.any():
            ys, xs = np.nonzero(m)
            assert sizes[k] == (m.sum(), xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1)

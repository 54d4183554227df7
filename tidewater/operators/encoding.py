"""Encoding models as they are fitted to events: items matched to embeddings, scenes kept apart, robust scaling, axes, ridge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import messages
from . import models, sampling
from .quantiles import exact_quantiles

#: The parts of an embedding's file name, in order.
NAME = ("subject", "trial", "fix_sequence", "start_ms", "scene")


def matched_items(items: DataFrame, files: DataFrame, name: str = "file", place: str = "place", start: str = "start_time") -> DataFrame:
    """Items with the place of their embedding, by five keys: subject, trial, fix_sequence, the start in whole milliseconds (cut, not
    rounded), and scene. Of several files of the same keys the first place counts; items and files without a partner are left out, as are
    names of other forms. ``items`` have the keys and ``start`` in seconds; ``files`` a name and a place."""
    parts = messages.name_parts(F.col(name), list(NAME))
    known = files.select(*parts, F.col(place).alias("__place")).dropna()
    first = known.groupBy(*NAME).agg(F.min("__place").alias(place))
    keyed = items.withColumn("start_ms", (F.col(start) * 1000).cast("long"))
    return keyed.join(first, list(NAME)).drop("start_ms")


def scene_split(df: DataFrame, scene: str, share: float = 0.2, seed: int = 0, name: str = "held") -> DataFrame:
    """``df`` with a boolean: the scenes that come first by a seeded hash are held out, ``share`` of them (rounded up). All rows
    of a scene are on one side."""
    numbered = sampling._numbered(df.select(scene).distinct(), sampling.seeded(seed, scene), "__r")
    return df.join(numbered.select(scene, (F.col("__r") < F.ceil(F.col("__all") * F.lit(share))).alias(name)), scene)


def robust_scaled(df: DataFrame, x: str, fitted: Column, name: str | None = None) -> DataFrame:
    """Each element of an array as (value - median) / (third - first quartile) of the rows that are ``fitted``; a range of 0
    counts as 1. The quantiles (three for each element) are the only thing that leaves the executors."""
    parts = df.where(fitted).select(F.posexplode(F.col(x).cast("array<double>")).alias("pos", "v"))
    rows = sorted((r["pos"], r["__q"]) for r in exact_quantiles(parts, "v", [0.25, 0.5, 0.75], ["pos"]).collect())
    middle, width = [q[1] for _, q in rows], [q[2] - q[0] if q[2] > q[0] else 1.0 for _, q in rows]
    given = F.arrays_zip(F.col(x).cast("array<double>").alias("v"), F.array(*map(F.lit, middle)).alias("m"), F.array(*map(F.lit, width)).alias("w"))
    return df.withColumn(name or x, F.transform(given, lambda s: (s["v"] - s["m"]) / s["w"]))


def encode_scenes(
    df: DataFrame, key: list[str], scene: str, x: str, y: str, *, held: float = 0.2, folds: int = 3, share: float | None = 0.7, target_share: float | None = None,
    alphas: tuple[float, ...] = models.ALPHAS, seed: int = 0,
) -> DataFrame:
    """target, alpha, r, r2 of ridge regressions of each element of y on x, scored on scenes that were held out.

    x and y are scaled robustly, x goes on the axes that hold ``share`` of its variance (None: as it is), y on those of
    ``target_share`` (None: its elements); all of that is fitted without the held-out scenes. alpha is chosen for each target in ``folds`` folds of rows by a
    seeded hash of ``key``. Features are not brought to unit variance again."""
    rows = scene_split(df, scene, held, seed, "__held")
    taught = ~F.col("__held")
    rows = robust_scaled(robust_scaled(rows, x, taught, "__x"), y, taught, "__y")
    for column, part in (("__x", share), ("__y", target_share)):
        if part is not None:
            mean, axes = models.principal_axes(rows.where(taught), column, part)
            rows = rows.withColumn(column, models.projected(F.col(column), mean, axes))
    fold = F.conv(F.substring(sampling.seeded(seed, *key), 1, 8), 16, 10).cast("long") % folds
    rows = rows.withColumn("__fold", F.when(F.col("__held"), -1).otherwise(fold).cast("int"))
    return models.encode(rows, "__x", "__y", "__fold", -1, alphas, standardise=False)

"""Seeded sampling, splits and allocation, repeatable at any partitioning: the order is a hash of seed and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def per_group(df: DataFrame, by: list[str], key: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows of each group (all, if fewer)."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(seeded(seed, *key), *key))
    return df.withColumn("__p", place).where(F.col("__p") <= n).drop("__p")


#: Ranges that keys in seeded order are cut into: by the first hex digits of their hash.
DIGITS = 3


def _numbered(keys: DataFrame, order: Column, name: str) -> DataFrame:
    """Number from 0 in the order of a hash (then of the keys), and __all, without one task for all: ranges of hashes are
    numbered each, and moved by the sizes of the ranges before (16 ** ``DIGITS`` rows)."""
    hashed = keys.withColumn("__h", order).withColumn("__range", F.substring("__h", 1, DIGITS))
    sizes = hashed.groupBy("__range").agg(F.count("*").alias("__t"))
    everything = Window.partitionBy(F.lit(0))
    before = sizes.select("__range", (F.sum("__t").over(everything.orderBy("__range")) - F.col("__t")).alias("__before"), F.sum("__t").over(everything).alias("__all"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy("__h", *keys.columns)) - 1
    return hashed.join(F.broadcast(before), "__range").withColumn(name, inside + F.col("__before")).drop("__h", "__range", "__before")


def group_splits(df: DataFrame, group: str, n: int = 4, seed: int = 0) -> DataFrame:
    """split 1..n: rows of a group share one, and splits have as many groups as each other (to one, the first ones more)."""
    numbered = _numbered(df.select(group).distinct(), seeded(seed, group), "__r")
    size, more = F.floor(F.col("__all") / n), F.col("__all") % n
    big = more * (size + 1)
    split = F.when(F.col("__r") < big, F.floor(F.col("__r") / (size + 1))).otherwise(more + F.floor((F.col("__r") - big) / F.greatest(size, F.lit(1)))) + 1
    return df.join(numbered.select(group, split.cast("int").alias("split")), group)


def hash_folds(df: DataFrame, group: str, n: int = 5, seed: int = 0) -> DataFrame:
    """fold 0..n-1 by hash: no shuffle, about equal sizes."""
    return df.withColumn("fold", (F.conv(F.substring(seeded(seed, group), 1, 8), 16, 10).cast("long") % n).cast("long"))


def spread(df: DataFrame, by: str, key: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows dealt over the categories as evenly as their sizes allow (a category that is used up gives way)."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(seeded(seed, *key), *key))
    return df.withColumn("place", place).where(F.col("place") <= n).orderBy("place", by).limit(n)  # no category gives more than n: tasks cut theirs before the shuffle


def water_fill(caps: DataFrame, key: str, cap: str, n: int) -> DataFrame:
    """take: n dealt evenly under caps; with r rounds dealt in full, the rest goes to the first keys with room."""
    room = F.greatest(F.coalesce(F.col(cap).cast("long"), F.lit(0)), F.lit(0))
    sizes = caps.groupBy(F.least(room, F.lit(n).cast("long")).alias("__c")).agg(F.count("*").alias("__k")).where("__c > 0")
    w = Window.partitionBy(F.lit(0))  # one row for each different cap
    up_to = w.orderBy("__c").rowsBetween(Window.unboundedPreceding, 0)
    # with caps up to c filled and c seats for each of the others, ``spent`` are gone
    filled = sizes.withColumns({"__above": F.sum("__k").over(w) - F.sum("__k").over(up_to), "__full": F.sum(F.col("__c") * F.col("__k")).over(up_to)})
    spent = filled.withColumn("__spent", F.col("__full") + F.col("__c") * F.col("__above")).where(F.col("__spent") <= n)
    at = spent.agg(F.max("__c").alias("c"), F.max_by("__spent", "__c").alias("s"), F.max_by("__above", "__c").alias("a")).first()
    c, s = at["c"] or 0, at["s"] or 0
    above = at["a"] if at["c"] is not None else caps.where(room > 0).count()
    rounds = c + ((n - s) // above if above else 0)
    left = n - s - (rounds - c) * above if above else 0
    more = caps.where(room > rounds).select(key).orderBy(key).limit(int(left)).withColumn("__more", F.lit(1))
    return caps.join(more, key, "left").withColumn("take", F.least(room, F.lit(rounds).cast("long")) + F.coalesce("__more", F.lit(0))).drop("__more")


def evenly_spaced(df: DataFrame, order: str, key: str, n: int) -> DataFrame:
    """n rows at evenly spaced ranks of ``order`` (ties by ``key``), the first and the last among them."""
    from .vectors import global_rank

    ranked = global_rank(df, order, "__mid")
    ties = Window.partitionBy(order)
    ranked = ranked.withColumn("__r", F.col("__mid") - (F.count("*").over(ties) + 1) / 2 + F.row_number().over(ties.orderBy(key)) - 1)
    total = df.where(F.col(order).isNotNull()).agg(F.count("*").alias("__n"))
    slot = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("__n") - 1) / F.lit(max(n - 1, 1)) + 0.5))
    return ranked.crossJoin(F.broadcast(total)).where(F.array_contains(slot, F.col("__r").cast("long"))).select(df.columns)


def choose(df: DataFrame, scene: str, how: str, n: int = 0, ids: list | None = None, seed: int = 0) -> DataFrame:
    """Rows of the scenes that are chosen: all, specific (``ids``), top (the n with most rows, ties: the smallest) or random
    (n by a seed)."""
    if how == "all":
        return df
    if how == "specific":
        return df.where(F.col(scene).isin(ids or []))
    counts = df.groupBy(scene).agg(F.count("*").alias("__n"))
    picked = counts.orderBy(F.desc("__n"), scene).limit(n) if how == "top" else counts.orderBy(seeded(seed, scene), scene).limit(n)
    return df.join(F.broadcast(picked.select(scene)), scene, "left_semi")


def group_folds(df: DataFrame, group: str, n: int = 5) -> DataFrame:
    """fold 0..n-1: rows of a group share one. Groups in the order of their size go round the folds and back (0..n-1, n-1..0),
    so folds are about equally large without a pass over all groups on the driver."""
    from .vectors import global_rank

    sizes = df.groupBy(group).agg(F.count("*").alias("__n"))
    ranked = global_rank(sizes.withColumn("__neg", -F.col("__n")), "__neg", "__mid")
    ties = Window.partitionBy("__neg")
    place = (F.col("__mid") - (F.count("*").over(ties) + 1) / 2 + F.row_number().over(ties.orderBy(group)) - 1).cast("long")
    turn = place % (2 * n)
    return df.join(ranked.select(group, F.when(turn < n, turn).otherwise(2 * n - 1 - turn).cast("int").alias("fold")), group)

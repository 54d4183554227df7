"""Exact quantiles of whole columns and of many groups at once, without a buffer that grows with a group.

A sketch of bounded size for each group brackets every wanted rank. Then rows are counted: those between brackets by the
zone they lie in, those inside one by their value. Running counts of these few sums give the values at the ranks. Both
passes add up in the tasks that read, so a group of any share of the rows is spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Of a group's sketch: ranks are off by a share of one in so many. Groups of so many rows at most are counted as they are.
OF_GROUPS, OF_TABLE = 10_000, 100_000


def exact_quantiles(df: DataFrame, value: str, ps: list[float], by: list[str] | None = None, accuracy: int | None = None, count: str | None = None) -> DataFrame:
    """``by`` and __q: the exact quantiles (straight lines between ranks) of each group, in the order of ``ps``. Nulls don't
    count, and groups without a value have no row; a null in ``by`` is a group of its own. Without ``by`` one row for the whole column, of
    nulls where there is no value. ``count``: a column for the number of values.

    Of a group of n rows, all but n * 8 * len(ps) / accuracy distinct values are summed before they are ordered."""
    groups, accuracy = [f"__g{i}" for i in range(len(by or []))], accuracy or (OF_GROUPS if by else OF_TABLE)
    rows = df.select(*[F.col(f"`{b}`").alias(g) for b, g in zip(by or [], groups, strict=True)], F.col(f"`{value}`").cast("double").alias("__v")).where("__v is not null")
    order, slack = sorted(set(ps)), 4 / accuracy
    least, most = F.lit(float("-inf")), F.lit(float("nan"))  # not a number is beyond all numbers
    asked = [max(p - slack, 0.0) for p in order] + [min(p + slack, 1.0) for p in order]
    sketch = rows.groupBy(*groups).agg(F.count("*").alias("__n"), F.percentile_approx("__v", F.array(*map(F.lit, asked)), accuracy).alias("__e"))
    open_ = lambda k, end, inner: F.when((F.col("__n") <= accuracy) | F.lit(not inner), end).otherwise(F.col("__e")[k])
    lows = [open_(k, least, p > slack).alias(f"__l{k}") for k, p in enumerate(order)]
    highs = [open_(k + len(order), most, p < 1 - slack).alias(f"__h{k}") for k, p in enumerate(order)]
    brackets = sketch.select(*[F.col(g).alias(f"{g}_") for g in groups], "__n", *lows, *highs)
    if groups:
        matches = [F.col(g).eqNullSafe(F.col(f"{g}_")) for g in groups]
        placed = rows.join(brackets, matches)
    else:
        placed = rows.crossJoin(F.broadcast(brackets))  # one row
    zone = sum((F.when(F.col("__v") >= F.col(f"__l{k}"), 1).otherwise(0) for k in range(len(order))), F.lit(0))
    inside = F.lit(False)
    for k in range(len(order)):
        inside = inside | F.col("__v").between(F.col(f"__l{k}"), F.col(f"__h{k}"))
    # in a zone, what lies in no bracket is beyond all that do
    sums = placed.groupBy(*groups, zone.alias("__zone"), F.when(inside, F.col("__v")).alias("__at")).agg(F.count("*").alias("__c"), F.max("__n").alias("__n"))
    so_far = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("__zone", F.col("__at").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = sums.withColumn("__end", F.sum("__c").over(so_far)).where("__at is not null")
    rank = lambda p: F.lit(p) * (F.col("__n") - 1)
    at = lambda r: F.min(F.when((r >= F.col("__end") - F.col("__c")) & (r < F.col("__end")), F.col("__at")))
    picks = [at(f(rank(p))).alias(f"__{side}{k}") for k, p in enumerate(order) for side, f in (("a", F.floor), ("b", F.ceil))]
    got = ranked.groupBy(*groups).agg(F.max("__n").alias("__n"), *picks)
    missed = F.raise_error(F.lit("a rank lies outside of its bracket")).cast("double")
    lines = {}
    for k, p in enumerate(order):
        a, b, r = F.col(f"__a{k}"), F.col(f"__b{k}"), rank(p)
        between = F.when(F.floor(r) == r, a).otherwise((F.ceil(r) - r) * a + (r - F.floor(r)) * b)
        lines[p] = F.when(F.col("__n").isNotNull() & (a.isNull() | b.isNull()), missed).otherwise(between)
    out = got.select(*[F.col(g).alias(b) for g, b in zip(groups, by or [], strict=True)], F.array(*[lines[p] for p in ps]).alias("__q"), F.col("__n"))
    return out.withColumnRenamed("__n", count) if count else out.drop("__n")


def with_quantiles(df: DataFrame, value: str, ps: list[float], by: list[str] | None = None, name: str = "__q") -> DataFrame:
    """``df`` with its group's quantiles as an array; rows of a null group or of one without values go, as in a join."""
    q = exact_quantiles(df, value, ps, by).withColumnRenamed("__q", name)
    return df.join(q, by) if by else df.crossJoin(F.broadcast(q))  # one row

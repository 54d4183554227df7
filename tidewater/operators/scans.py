"""Running values along an order, inside a key or dealt over its time buckets.

Sums, last and next values are monoids: a bucket hands on one row (its sum, the last and the first value it has), these
are combined over the buckets of a key, and rows inside a bucket start from what came before and end with what comes after.
So a key with a third of all rows costs its buckets, and every frame is linear in its rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Spread = tuple[str, float] | None


def bucket(events: DataFrame, spread: tuple[str, float]) -> Column:
    """The time bucket of a row: ``spread`` is a column that never falls along the order, and a width in its unit (seconds, of timestamps)."""
    time, width = spread
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6 if "timestamp" in events.schema[time].dataType.typeName() else F.col(time)
    return F.floor(seconds / width)


def scan(
    events: DataFrame, by: list[str], order: list[str], spread: Spread = None, *, sums: Mapping[str, Column] | None = None, totals: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None, nexts: Mapping[str, Column] | None = None, before: Mapping[str, Column] | None = None, after: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``events`` with named columns: running sums up to and with the row, totals of the key, the last value before the row
    and the next one after it that are not null, and the values of the row before and after, null or not. ``order`` must be total. With ``spread`` keys
    are dealt over time buckets; results are the same."""
    sums, totals, lasts, nexts = dict(sums or {}), dict(totals or {}), dict(lasts or {}), dict(nexts or {})
    wrapped = {**dict(before or {}), **dict(after or {})}
    lasts |= {k: F.struct(v.alias("v")) for k, v in (before or {}).items()}
    nexts |= {k: F.struct(v.alias("v")) for k, v in (after or {}).items()}
    given = {**sums, **totals, **lasts, **nexts}
    key = [*by, "__bucket"] if spread else by
    rows = events.withColumns({**({"__bucket": bucket(events, spread)} if spread else {}), **{f"__in_{k}": v for k, v in given.items()}})
    value = lambda k: F.col(f"__in_{k}")
    part = Window.partitionBy(*key)
    forth, back = part.orderBy(*order), part.orderBy(*[F.desc(c) for c in order])
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = {k: F.sum(value(k)).over(forth.rowsBetween(Window.unboundedPreceding, 0)) for k in sums}
    inside |= {k: F.last(value(k), ignorenulls=True).over(past(forth)) for k in lasts}
    inside |= {k: F.last(value(k), ignorenulls=True).over(past(back)) for k in nexts}  # a frame that ends at the last row would be evaluated anew for each row
    if not spread:
        inside |= {k: F.sum(value(k)).over(part) for k in totals}
        out = rows.withColumns(inside)
    else:
        place = F.struct(*order)
        ends = [F.sum(value(k)).alias(f"__of_{k}") for k in (*sums, *totals)]
        ends += [F.max_by(value(k), F.when(value(k).isNotNull(), place)).alias(f"__of_{k}") for k in lasts] + [F.min_by(value(k), F.when(value(k).isNotNull(), place)).alias(f"__of_{k}") for k in nexts]
        each = rows.groupBy(*key).agg(*ends)
        whole = Window.partitionBy(*by)
        of = lambda k: F.col(f"__of_{k}")
        handed = [F.coalesce(F.sum(of(k)).over(past(whole.orderBy("__bucket"))), F.lit(0)).alias(f"__to_{k}") for k in sums]
        handed += [F.sum(of(k)).over(whole).alias(f"__to_{k}") for k in totals]
        handed += [F.last(of(k), ignorenulls=True).over(past(whole.orderBy("__bucket"))).alias(f"__to_{k}") for k in lasts]
        handed += [F.last(of(k), ignorenulls=True).over(past(whole.orderBy(F.desc("__bucket")))).alias(f"__to_{k}") for k in nexts]
        tidy = each.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(key)], *handed)
        joined = rows.withColumns({f"__at_{k}": v for k, v in inside.items()}).join(tidy, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(key)])
        out = joined.withColumns({k: F.col(f"__at_{k}") + F.col(f"__to_{k}") for k in sums} | {k: F.col(f"__to_{k}") for k in totals} | {k: F.coalesce(F.col(f"__at_{k}"), F.col(f"__to_{k}")) for k in (*lasts, *nexts)})
    out = out.withColumns({k: F.col(k)["v"] for k in wrapped})
    return out.select(*[c for c in events.columns if c not in given], *given)

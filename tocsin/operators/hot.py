"""Running aggregates that stay exact when one key holds a large part of the rows.

A window function sends all rows of a key to one task. Here a hot key is cut
into consecutive time slots, each slot is scanned on its own, and what the
earlier slots add up to is carried in from a table with one row per slot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.session import materialize

# Slots of a hot key are cut at these quantiles of its times.
QUANTILES = 1_000


@dataclass(frozen=True)
class Limits:
    """When a key counts as hot and how finely it is cut."""

    hot_rows: int = 1_000_000
    slot_rows: int = 50_000


ORDER = ("received_at", "seq")


def position() -> Column:
    """The place of a row in the total order of the log."""
    return F.struct(*ORDER)


def limits_for(births: DataFrame, limits: Limits) -> Limits | None:
    """`limits`, or None if the whole log has too few rows for any key to be hot."""
    total = births.agg(F.sum("rows")).first()[0] or 0
    return limits if total > limits.hot_rows else None


def hot_keys(stats: DataFrame, key: list[str], limits: Limits | None) -> DataFrame | None:
    """Keys to split, from rows (key..., rows, first_at, last_at); None when there are none.

    The list is stored before it is asked whether it is empty, so `stats` is
    evaluated once; an empty list keeps the carry branches out of the plan.
    """
    if limits is None:
        return None
    hot = (
        stats.filter(F.col("rows") > limits.hot_rows)
        .select(
            *key,
            "first_at",
            (F.timestamp_diff("MICROSECOND", F.col("first_at"), F.col("last_at")) + 1).alias("span"),
            F.least(F.ceil(F.col("rows") / limits.slot_rows), F.lit(QUANTILES)).cast("int").alias("slots"),
        )
    )
    hot = materialize(hot, "hot")
    return None if hot.isEmpty() else hot


def cuts_below(cuts: str, value: Column) -> Column:
    """How many of an ascending array of at most QUANTILES cuts are below `value`, by halving."""
    steps = [1 << i for i in reversed(range(QUANTILES.bit_length()))]
    further = lambda at, step: F.get(cuts, at + step - 1) < value  # noqa: E731  (null beyond the end)
    halve = lambda at, step: F.when(further(at, step), at + step).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), halve)


def with_slot(df: DataFrame, key: list[str], hot: DataFrame | None) -> DataFrame:
    """Add `slots` (1 if the key is not split) and `slot`, which grows with received_at.

    Slots hold about as many rows each, whatever the times are like: they are cut
    at quantiles of the key's own rows. Rows of one instant stay together.
    """
    if hot is None:
        return df.selectExpr("*", "1 AS slots", "0 AS slot")
    since = F.timestamp_diff("MICROSECOND", F.col("first_at"), F.col("received_at"))
    shares = [i / QUANTILES for i in range(1, QUANTILES)]
    of_keys = df.select(*key, "received_at").join(hot, key)
    cuts = of_keys.groupBy(*key, "slots", "first_at").agg(F.percentile_approx(since, shares, 10 * QUANTILES).alias("q"))
    # of the quantiles those that cut the key into its number of slots
    nth = lambda i: F.element_at("q", F.floor(i * QUANTILES / F.col("slots")).cast("int"))
    wanted = F.when(F.col("slots") > 1, F.transform(F.sequence(F.lit(1), F.col("slots") - 1), nth))
    cuts = materialize(cuts.select(*key, "slots", "first_at", wanted.alias("cuts")), "cuts")
    slot = cuts_below("cuts", since)
    return (
        df.join(cuts, key, "left")
        .withColumn("slot", F.when(F.col("cuts").isNull(), 0).otherwise(slot))
        .withColumn("slots", F.coalesce("slots", F.lit(1)))
        .drop("first_at", "cuts")
    )


def running(
    df: DataFrame,
    key: list[str],
    split: bool,
    sums: dict[str, Column] | None = None,
    latest: dict[str, Column] | None = None,
    order: tuple[str, ...] = ORDER,
    backwards: bool = False,
) -> DataFrame:
    """Add running values per key, in order.

    `sums`: total of the expression up to and including the row.
    `latest`: last non-null value of the expression strictly before the row.
    `backwards` runs from the last row to the first, so `latest` looks ahead.
    `df` needs the columns `slot` and `slots`; `split` says whether any key has
    more than one slot.
    """
    sums, latest = sums or {}, latest or {}
    part = [*key, "slot"]
    towards = F.desc if backwards else F.asc
    rows = Window.partitionBy(*part).orderBy(*[towards(c) for c in order])
    upto = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = rows.rowsBetween(Window.unboundedPreceding, -1)
    local = {n: F.sum(e).over(upto) for n, e in sums.items()}
    local |= {n: F.last(e, ignorenulls=True).over(before) for n, e in latest.items()}
    out = df.select("*", *[c.alias(n) for n, c in local.items()])
    if not split:
        return out

    where = F.struct(*order)
    newest = F.min_by if backwards else F.max_by
    per_slot = (
        df.filter(F.col("slots") > 1)
        .groupBy(*part)
        .agg(
            *[F.sum(e).alias(n) for n, e in sums.items()],
            *[newest(e, F.when(e.isNotNull(), where)).alias(n) for n, e in latest.items()],
        )
    )
    earlier = (
        Window.partitionBy(*key).orderBy(towards("slot")).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = per_slot.select(
        *part,
        *[F.sum(n).over(earlier).alias(f"carry_{n}") for n in sums],
        *[F.last(n, ignorenulls=True).over(earlier).alias(f"carry_{n}") for n in latest],
    )
    out = out.join(materialize(carry, "carry"), part, "left")
    for n in sums:
        out = out.withColumn(n, F.col(n) + F.coalesce(f"carry_{n}", F.lit(0)))
    for n in latest:
        out = out.withColumn(n, F.coalesce(n, f"carry_{n}"))
    return out.drop(*[f"carry_{n}" for n in [*sums, *latest]])

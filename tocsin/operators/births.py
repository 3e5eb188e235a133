"""One alert per dedup key: its first trigger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.operators.hot import position

BIRTH_FIELDS = [
    "event_manager_id",
    "summary",
    "severity",
    "class",
    "grouping_key",
    "grouping_value",
    "time_window_minutes",
]


def summaries(routed: DataFrame, *more: F.Column) -> DataFrame:
    """(dedup_key, first, rows, last_at, more...): of every key its first trigger (null if none) and how many events it has."""
    is_trigger = F.col("action") == "trigger"
    first = F.min(F.when(is_trigger, F.struct("received_at", "seq", *BIRTH_FIELDS)))
    return routed.groupBy("dedup_key").agg(
        first.alias("first"), F.count("*").alias("rows"), F.max("received_at").alias("last_at"), *more
    )


def of_summaries(found: DataFrame) -> DataFrame:
    """Births from `summaries`."""
    return found.filter(F.col("first").isNotNull()).select(
        "dedup_key",
        F.col("first.received_at").alias("born_at"),
        F.col("first.seq").alias("born_seq"),
        *[f"first.{name}" for name in BIRTH_FIELDS],
        *[c for c in found.columns if c not in ("dedup_key", "first")],
    )


def births(routed: DataFrame) -> DataFrame:
    """(dedup_key, born_at, born_seq, fields of the first trigger, rows, last_at).

    An aggregate, not a window: each task keeps one row per key before the
    shuffle, so the size of a key does not matter. `rows` and `last_at` cover
    all events of the key and serve to find hot keys later.
    """
    return of_summaries(summaries(routed))


def with_birth(routed: DataFrame, born: DataFrame) -> DataFrame:
    """Events with the place of their alert's birth (null when there is none)."""
    return routed.join(born.select("dedup_key", "born_at", "born_seq"), "dedup_key", "left")


def after_birth() -> F.Column:
    """The event is its alert's birth or comes after it."""
    # a struct of nulls is not null and sorts first, so test for the birth itself
    return F.col("born_at").isNotNull() & (position() >= F.struct("born_at", "born_seq"))


def unknown_resolves(routed: DataFrame, born: DataFrame) -> DataFrame:
    """Resolves that come before, or without, a birth."""
    return (
        with_birth(routed.filter(F.col("action") == "resolve"), born)
        .filter(~after_birth())
        .select("seq", "received_at", "event_manager_id", "dedup_key")
    )

"""Interval history of alerts: what every alert said, and from when to when.

Each row of the timeline that changes an alert gives one version; it holds until the next one of the same
alert. The table answers questions about any number of times at once: `state_at` is a filter on it,
`state_probes` an as-of join of (key, time) pairs, and neither runs the log again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.operators.asof import asof_join
from tocsin.operators.hot import Limits, hot_keys, running, with_slot

STATE = ("event_manager_id", "type", "status", "parent_dedup_key", "resolve_requested")


def _changes(timeline: DataFrame) -> DataFrame:
    """What a row of the timeline makes of its child, and what it makes of the family's parent."""
    is_child = ~F.col("is_parent")
    place = ["received_at", "seq"]
    children = timeline.filter(is_child).select(
        "dedup_key",
        *place,
        F.lit("child").alias("type"),
        F.when(F.col("action") == "trigger", "active").otherwise("resolved").alias("status"),
        F.col("family").alias("parent_dedup_key"),
        F.lit(False).alias("resolve_requested"),
    )
    done = F.col("effect").isin("resolved", "cascaded")
    parents = timeline.filter(~F.col("effect").isin("none", "resolve_noop")).select(
        F.col("family").alias("dedup_key"),
        *place,
        F.lit("parent").alias("type"),
        F.when(done, "resolved").otherwise("active").alias("status"),
        F.lit(None).cast("string").alias("parent_dedup_key"),
        (F.col("effect") == "deferred").alias("resolve_requested"),
    )
    return children.unionByName(parents)


def alert_versions(timeline: DataFrame, births: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(dedup_key, state columns, seq, valid_from, valid_to) of every version; the last has no valid_to.

    A version that is replaced within its own instant has valid_from = valid_to: it is in no state as of a time.
    """
    changes = _changes(timeline).join(births.select("dedup_key", "event_manager_id"), "dedup_key")
    stats = changes.groupBy("dedup_key").agg(
        F.count("*").alias("rows"),
        F.min("received_at").alias("first_at"),
        F.max("received_at").alias("last_at"),
    )
    hot = hot_keys(stats, ["dedup_key"], limits)
    following = {"valid_to": F.col("received_at")}
    rows = running(
        with_slot(changes, ["dedup_key"], hot), ["dedup_key"], hot is not None, latest=following, backwards=True
    )
    return rows.select("dedup_key", *STATE, "seq", F.col("received_at").alias("valid_from"), "valid_to")


def state_at(versions: DataFrame, at: str) -> DataFrame:
    """The state of every alert after the last event received at or before `at`."""
    at = F.lit(at).cast("timestamp_ntz")
    holds = (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))
    return versions.filter(holds).select("dedup_key", *STATE)


def state_probes(probes: DataFrame, versions: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Probes (dedup_key, received_at, ...) with the alert's state at that time; nulls before its birth.

    Both sides are merged in one ordered pass per key, keys with very many rows in slots.
    """
    newest = versions.select("dedup_key", F.col("valid_from").alias("received_at"), "seq", *STATE)
    found = asof_join(probes, newest, ["dedup_key"], "version", limits=limits)
    return found.select(*probes.columns, *[F.col(f"version.{c}").alias(c) for c in STATE])

"""State views: who is whose child, which windows are open, what is pending."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.functions.alerts import is_active, is_child
from tocsin.operators.anchors import GROUP
from tocsin.operators.asof import asof_join
from tocsin.operators.hot import Limits


def alert_state(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        "dedup_key", "event_manager_id", "type", "status", "parent_dedup_key", "resolve_requested"
    )


def active_child_counts(alerts: DataFrame) -> DataFrame:
    """Active children per parent; a parent without any has 0."""
    parent = F.coalesce("parent_dedup_key", "dedup_key")
    return alerts.groupBy(parent.alias("parent_dedup_key")).agg(
        F.count_if(is_child() & is_active()).alias("active_children")
    )


def child_counts(links: DataFrame) -> DataFrame:
    """Children ever born per parent; a parent without any has 0."""
    return links.groupBy(F.col("family").alias("parent_dedup_key")).agg(
        F.count_if(F.col("dedup_key") != F.col("family")).alias("child_count")
    )


def children(links: DataFrame) -> DataFrame:
    """(parent_dedup_key, dedup_key): every child with its parent, one row each at any size."""
    return links.filter(F.col("dedup_key") != F.col("family")).select(
        F.col("family").alias("parent_dedup_key"), "dedup_key"
    )


def children_sets(links: DataFrame) -> DataFrame:
    """(parent_dedup_key, children): the sorted children of every parent that has any, as one array.

    For parents whose children fit an array; `children` serves all.
    """
    return (
        children(links)
        .groupBy("parent_dedup_key")
        .agg(F.sort_array(F.collect_set("dedup_key")).alias("children"))
    )


def children_set_sizes(links: DataFrame) -> DataFrame:
    """Distinct children per parent that has any. A dedup key is born once, so a count is exact."""
    return (
        links.filter(F.col("dedup_key") != F.col("family"))
        .groupBy(F.col("family").alias("parent_dedup_key"))
        .agg(F.count("*").alias("children"))
    )


def open_parents(links: DataFrame, at: str) -> DataFrame:
    """The parent whose window is open at `at`, per group. Windows of a group do not overlap."""
    at = F.lit(at).cast("timestamp_ntz")
    return links.filter(
        (F.col("dedup_key") == F.col("family"))
        & (F.col("born_at") <= at)
        & (F.col("expires_at") >= at)
    ).select(*GROUP, "dedup_key", F.col("born_at").alias("created_at"), "expires_at")


def live_parent(probes: DataFrame, links: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Probes (group columns, received_at, ...) with the parent live at that time, or null."""
    parents = links.filter(F.col("dedup_key") == F.col("family")).select(
        *GROUP,
        F.col("born_at").alias("received_at"),
        F.col("born_seq").alias("seq"),
        "dedup_key",
        "expires_at",
    )
    found = asof_join(probes, parents, GROUP, "parent", limits=limits)
    live = F.col("received_at") <= F.col("parent.expires_at")
    return found.select(
        *probes.columns,
        F.when(live, F.col("parent.dedup_key")).alias("parent_dedup_key"),
        F.when(live, F.col("parent.received_at")).alias("parent_created_at"),
    )


def pending_resolves(parents: DataFrame) -> DataFrame:
    return parents.filter("resolve_requested").select(
        F.col("dedup_key").alias("parent_dedup_key"), "requested_at", "remaining_children"
    )

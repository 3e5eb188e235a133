"""One batch run over a log: routed events to alerts, outcomes and notifications."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.functions.events import alert_id
from tocsin.operators import anchors, births, lifecycle
from tocsin.operators.hot import Limits, limits_for
from tocsin.operators.notifications import notifications
from tocsin.operators.versions import alert_versions
from tocsin.schemas import ALERT_COLUMNS
from tocsin.session import materialize


class AlertRun:
    """Tables derived from one routed log, each computed when first asked for.

    Three are written to the shared folder because several others read them:
    births (one row per alert), links (its parent), timeline (parent events and
    child changes, with what they do to the parent).
    """

    def __init__(self, routed: DataFrame, limits: Limits = Limits()):
        self.routed = routed
        self.limits = limits

    @cached_property
    def births(self) -> DataFrame:
        return materialize(births.births(self.routed), "births")

    @cached_property
    def split_limits(self) -> Limits | None:
        return limits_for(self.births, self.limits)

    @cached_property
    def links(self) -> DataFrame:
        return materialize(anchors.links(self.births, self.split_limits), "links")

    @cached_property
    def hot_dedup_keys(self) -> DataFrame | None:
        return lifecycle.hot_dedup_keys(self.links, self.split_limits)

    @cached_property
    def hot_families(self) -> DataFrame | None:
        return lifecycle.hot_families(self.links, self.split_limits)

    @cached_property
    def history(self) -> DataFrame:
        return lifecycle.alert_history(self.routed, self.links, self.hot_dedup_keys)

    @cached_property
    def timeline(self) -> DataFrame:
        rows = lifecycle.build_timeline(self.history, self.hot_families, self.limits)
        return materialize(rows, "timeline")

    @cached_property
    def versions(self) -> DataFrame:
        """Every version of every alert with the time it holds, for questions about many times."""
        return materialize(alert_versions(self.timeline, self.births, self.limits), "versions")

    @cached_property
    def parents(self) -> DataFrame:
        return lifecycle.parent_final(self.timeline)

    @cached_property
    def outcomes(self) -> DataFrame:
        return lifecycle.event_outcomes(
            self.routed, self.links, self.hot_dedup_keys, self.timeline
        )

    @property
    def grouped(self) -> DataFrame:
        """New alerts as they are born: type and parent, before any lifecycle."""
        is_child = F.col("family") != F.col("dedup_key")
        return self.links.select("dedup_key", "family", "expires_at").join(
            self.births, "dedup_key"
        ).select(
            alert_id(F.col("dedup_key")).alias("id"),
            "dedup_key",
            "event_manager_id",
            "summary",
            "severity",
            "class",
            F.when(is_child, "child").otherwise("parent").alias("type"),
            F.when(is_child, F.col("family")).alias("parent_dedup_key"),
            F.col("born_at").alias("created_at"),
            F.when(~is_child, F.col("expires_at")).alias("expires_at"),
        )

    @cached_property
    def alerts(self) -> DataFrame:
        """The alerts table after the last event."""
        children = lifecycle.child_final(self.timeline)
        status = children.unionByName(self.parents, allowMissingColumns=True)
        is_child = F.col("family") != F.col("dedup_key")
        return (
            self.births.join(status, "dedup_key")
            .select(
                alert_id(F.col("dedup_key")).alias("id"),
                "dedup_key",
                "event_manager_id",
                "summary",
                "severity",
                "class",
                F.when(is_child, "child").otherwise("parent").alias("type"),
                "status",
                F.when(is_child, F.col("family")).alias("parent_dedup_key"),
                F.coalesce("child_count", F.lit(0)).alias("child_count"),
                F.coalesce("resolve_requested", F.lit(False)).alias("resolve_requested"),
                F.col("born_at").alias("created_at"),
                "updated_at",
                "resolved_at",
            )
            .select(*ALERT_COLUMNS)
        )

    def until(self, at: str) -> AlertRun:
        """The run as it stood after the last event received at or before `at`."""
        return AlertRun(self.routed.filter(F.col("received_at") <= F.lit(at)), self.limits)

    @cached_property
    def stored_alerts(self) -> DataFrame:
        """The alerts table written once, for read queries that use it more than once."""
        return materialize(self.alerts, "alerts")

    def notifications(self, managers: DataFrame) -> DataFrame:
        return notifications(self.timeline, self.births, managers)

"""Notifications as an append-only table: new parents and resolved parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.functions.events import alert_id


def notifications(timeline: DataFrame, births: DataFrame, managers: DataFrame) -> DataFrame:
    """One row per parent birth and per parent resolution, at once or by its last child.

    A resolution whose manager is gone sends nothing; it stands all the same.
    """
    managers = managers.select(
        F.col("id").alias("event_manager_id"),
        F.col("notification_config.webhook_url").alias("webhook_url"),
        F.lit(True).alias("known"),
    )
    sent = timeline.filter(F.col("effect").isin("born", "resolved", "cascaded")).select(
        F.col("family").alias("dedup_key"),
        "received_at",
        "seq",
        F.when(F.col("effect") == "born", "active").otherwise("resolved").alias("status"),
        F.col("children").cast("int").alias("child_count"),
    )
    alerts = births.select("dedup_key", "event_manager_id", "summary", "severity")
    return (
        sent.join(alerts, "dedup_key")
        .join(managers, "event_manager_id", "left")
        .filter((F.col("status") == "active") | F.col("known"))
        .select(
            alert_id(F.col("dedup_key")).alias("alert_id"),
            "dedup_key",
            "event_manager_id",
            "summary",
            "severity",
            "status",
            F.lit("parent").alias("type"),
            "child_count",
            F.col("received_at").alias("timestamp"),
            F.coalesce("webhook_url", F.lit("")).alias("webhook_url"),
        )
    )

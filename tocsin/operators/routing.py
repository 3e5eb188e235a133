"""Validate events, look up their manager and rule, and enrich them.

Config tables are joined without a broadcast hint: Catalyst broadcasts them
while their known size is below `spark.sql.autoBroadcastJoinThreshold` and
otherwise uses a sort-merge join, whose hot managers AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.functions.events import (
    event_reject_reason,
    grouping_value,
    partition_key,
    reject_code,
    reject_message,
)

EVENT_COLUMNS = [
    "seq",
    "received_at",
    "event_manager_id",
    "summary",
    "severity",
    "action",
    "class",
    "dedup_key",
]


def _enrich(accepted: DataFrame) -> DataFrame:
    value = grouping_value(F.col("grouping_key"))
    return accepted.select(
        *EVENT_COLUMNS,
        "grouping_key",
        value.alias("grouping_value"),
        "time_window_minutes",
        partition_key(F.col("event_manager_id"), value).alias("partition_key"),
    )


def _refuse(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNotNull()).select(
        *EVENT_COLUMNS,
        "reject_reason",
        reject_code(F.col("reject_reason")).alias("reject_code"),
        reject_message(F.col("reject_reason")).alias("reject_message"),
    )


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(enriched events, rejects) of events with `reject_reason`."""
    return _enrich(checked.filter(F.col("reject_reason").isNull())), _refuse(checked)


def reject_reason() -> F.Column:
    return F.coalesce(
        F.col("invalid"),
        F.when(F.col("manager_id").isNull(), F.lit("event_manager_not_found")),
        F.when(F.col("rule_id").isNull(), F.lit("grouping_rule_not_found")),
    )


def route_events(
    events: DataFrame, managers: DataFrame, rules: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(routed events, rejected events with reason, code and message).

    Two plans over the same events: accepted ones are filtered before they are
    joined, so an invalid or empty manager id never becomes a large join key.
    """
    managers = managers.select(
        F.col("id").alias("manager_id"), F.col("grouping_rule_id").alias("manager_rule_id")
    )
    rules = rules.select(F.col("id").alias("rule_id"), "grouping_key", "time_window_minutes")
    to_manager = F.col("event_manager_id") == F.col("manager_id")
    to_rule = F.col("manager_rule_id") == F.col("rule_id")
    valid = events.select(*EVENT_COLUMNS).filter(event_reject_reason().isNull())
    routed = _enrich(valid.join(managers, to_manager).join(rules, to_rule))
    checked = (
        events.select(*EVENT_COLUMNS, event_reject_reason().alias("invalid"))
        .join(managers, to_manager, "left")
        .join(rules, to_rule, "left")
        .withColumn("reject_reason", reject_reason())
    )
    return routed, _refuse(checked)


def reject_counts(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("reject_reason", "reject_code").agg(F.count("*").alias("events"))

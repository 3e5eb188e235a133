"""Rules and managers kept by a change feed: current rows, history and rejects.

A change is (seq, changed_at, op, id, fields...) with op create, update or
delete. A well-formed create leaves the id existing and a delete leaves it
absent, accepted or not, so one look at the latest earlier create or delete
settles every change without replaying them one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.functions.events import (
    event_reject_reason,
    manager_reject_reason,
    reject_message,
    rule_reject_reason,
)
from tocsin.operators.asof import asof_join
from tocsin.operators.hot import Limits, hot_keys, running, with_slot
from tocsin.operators.routing import EVENT_COLUMNS, reject_reason, split_checked
from tocsin.session import materialize

RULE_FIELDS = ["name", "grouping_key", "time_window_minutes"]
MANAGER_FIELDS = ["name", "description", "grouping_rule_id", "webhook_url"]


def apply_config_changes(
    changes: DataFrame, fields: list[str], invalid: Column, limits: Limits = Limits()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(current, history, rejects) of a change feed.

    `invalid` is the reject reason of the fields of a create or update. History
    has one row per accepted create or update, valid in [valid_from, valid_to).
    """
    op = F.col("op")
    feed = changes.select("seq", F.col("changed_at").alias("received_at"), "op", "id", *fields)
    feed = feed.withColumn("invalid", F.when(op != "delete", invalid))
    stats = feed.groupBy("id").agg(
        F.count("*").alias("rows"),
        F.min("received_at").alias("first_at"),
        F.max("received_at").alias("last_at"),
    )
    hot = hot_keys(stats, ["id"], limits)
    split = hot is not None
    settles = F.when((op != "update") & F.col("invalid").isNull(), op == "create")
    # a split feed is read again for every running value and every result: each step is stored once
    stored = materialize if split else lambda df, _: df
    feed = stored(with_slot(feed, ["id"], hot), "feed")
    feed = running(feed, ["id"], split, latest={"existed": settles})
    existed = F.coalesce("existed", F.lit(False))
    reason = F.coalesce(
        "invalid",
        F.when((op == "create") & existed, "already_exists"),
        F.when((op != "create") & ~existed, "not_found"),
    )
    feed = stored(feed.withColumn("reject_reason", reason), "judged")
    rejects = feed.filter("reject_reason IS NOT NULL").select(
        "seq",
        F.col("received_at").alias("changed_at"),
        "op",
        "id",
        "reject_reason",
        reject_message(F.col("reject_reason")).alias("reject_message"),
    )
    accepted = feed.filter("reject_reason IS NULL").drop("existed", "invalid", "reject_reason")
    accepted = running(
        accepted, ["id"], split, latest={"created": F.when(op == "create", F.col("received_at"))}
    )
    accepted = running(accepted, ["id"], split, latest={"next": F.col("received_at")}, backwards=True)
    history = accepted.filter(op != "delete").select(
        "seq",
        "id",
        *fields,
        F.when(op == "create", F.col("received_at")).otherwise(F.col("created")).alias("created_at"),
        F.col("received_at").alias("updated_at"),
        F.col("received_at").alias("valid_from"),
        F.col("next").alias("valid_to"),
    )
    history = stored(history, "config-history")
    current = history.filter("valid_to IS NULL").select("id", *fields, "created_at", "updated_at")
    return current, history, rejects


def apply_rule_changes(changes: DataFrame, limits: Limits = Limits()):
    return apply_config_changes(changes, RULE_FIELDS, rule_reject_reason(), limits)


def apply_manager_changes(changes: DataFrame, limits: Limits = Limits()):
    return apply_config_changes(changes, MANAGER_FIELDS, manager_reject_reason(), limits)


def _valid(version: str) -> Column:
    end = F.col(f"{version}.valid_to")
    return F.col(version).isNotNull() & (end.isNull() | (F.col("received_at") < end))


def route_events_asof(
    events: DataFrame,
    manager_history: DataFrame,
    rule_history: DataFrame,
    limits: Limits = Limits(),
) -> tuple[DataFrame, DataFrame]:
    """(routed, rejects) under the config that was valid when each event came in."""
    managers = manager_history.select(
        F.col("id").alias("event_manager_id"),
        F.col("valid_from").alias("received_at"),
        "seq",
        "grouping_rule_id",
        "valid_to",
    )
    rules = rule_history.select(
        F.col("id").alias("manager_rule_id"),
        F.col("valid_from").alias("received_at"),
        "seq",
        "grouping_key",
        "time_window_minutes",
        "valid_to",
    )
    checked = events.select(*EVENT_COLUMNS, event_reject_reason().alias("invalid"))
    checked = asof_join(checked, managers, ["event_manager_id"], "manager", limits=limits)
    checked = checked.withColumn(
        "manager_id", F.when(_valid("manager"), F.col("event_manager_id"))
    ).withColumn("manager_rule_id", F.when(_valid("manager"), F.col("manager.grouping_rule_id")))
    # read for the keys' sizes, for their cuts and for the join itself
    checked = materialize(checked.drop("manager"), "managed")
    checked = asof_join(checked, rules, ["manager_rule_id"], "rule", limits=limits)
    checked = checked.select(
        *EVENT_COLUMNS,
        "invalid",
        "manager_id",
        F.when(_valid("rule"), F.col("manager_rule_id")).alias("rule_id"),
        "rule.grouping_key",
        "rule.time_window_minutes",
    )
    return split_checked(checked.withColumn("reject_reason", reject_reason()))

"""Column expressions over events, rules and managers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted domains, reject codes and messages.
SEVERITIES = ("high", "medium", "low")
ACTIONS = ("trigger", "resolve")
MALFORMED = "malformed"
MESSAGES = {
    "malformed": "invalid request body",
    "empty_event_manager_id": "event_manager_id is required",
    "empty_summary": "summary is required",
    "invalid_severity": "severity must be 'high', 'medium', or 'low'",
    "invalid_action": "action must be 'trigger' or 'resolve'",
    "empty_dedup_key": "dedupKey is required",
    "event_manager_not_found": "event manager not found",
    "grouping_rule_not_found": "grouping rule not found",
    "empty_name": "name is required",
    "empty_grouping_key": "grouping_key is required",
    "invalid_time_window": "time_window_minutes must be positive",
    "empty_grouping_rule_id": "grouping_rule_id is required",
    "already_exists": "already exists",
    "not_found": "not found",
}
BAD_REQUEST = "BAD_REQUEST"
VALIDATION_FAILED = "VALIDATION_FAILED"
INTERNAL_ERROR = "INTERNAL_ERROR"


def text(name: str) -> Column:
    """A text column in which a missing value is the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def is_severity(c: Column) -> Column:
    return F.coalesce(c.isin(*SEVERITIES), F.lit(False))


def is_action(c: Column) -> Column:
    return F.coalesce(c.isin(*ACTIONS), F.lit(False))


def _first_failure(*checks: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(bad, F.lit(reason)) for bad, reason in checks])


def event_reject_reason() -> Column:
    """The first rule an event breaks, or null."""
    return _first_failure(
        (text("event_manager_id") == "", "empty_event_manager_id"),
        (text("summary") == "", "empty_summary"),
        (~is_severity(F.col("severity")), "invalid_severity"),
        (~is_action(F.col("action")), "invalid_action"),
        (text("dedup_key") == "", "empty_dedup_key"),
    )


def rule_reject_reason() -> Column:
    return _first_failure(
        (text("name") == "", "empty_name"),
        (text("grouping_key") == "", "empty_grouping_key"),
        (F.coalesce(F.col("time_window_minutes"), F.lit(0)) <= 0, "invalid_time_window"),
    )


def manager_reject_reason() -> Column:
    return _first_failure(
        (text("name") == "", "empty_name"),
        (text("grouping_rule_id") == "", "empty_grouping_rule_id"),
    )


def reject_message(reason: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    return lookup[reason]


def reject_code(reason: Column) -> Column:
    """Error code an ingest reject is answered with."""
    return (
        F.when(reason == MALFORMED, F.lit(BAD_REQUEST))
        .when(reason.endswith("_not_found"), F.lit(INTERNAL_ERROR))
        .otherwise(F.lit(VALIDATION_FAILED))
    )


def grouping_value(key: Column) -> Column:
    """Value of the event field a rule groups by; '' for a field that is not supported."""
    supported = ("class", "severity", "event_manager_id")
    return F.coalesce(*[F.when(key == name, text(name)) for name in supported], F.lit(""))


def partition_key(manager: Column, value: Column) -> Column:
    """First 16 hex digits of sha256('manager:value')."""
    return F.substring(F.sha2(F.concat_ws(":", manager, value), 256), 1, 16)


def expires_at(start: Column, minutes: Column) -> Column:
    """Last instant of the window a parent opens; the end belongs to the window."""
    return F.timestamp_add("MINUTE", minutes, start)


def alert_id(dedup_key: Column) -> Column:
    """Derived from the key, so a replay gives the same id."""
    return F.md5(dedup_key)

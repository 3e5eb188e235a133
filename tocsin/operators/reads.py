"""Read queries over the alerts and config tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.functions.alerts import is_parent
from tocsin.schemas import ALERT_COLUMNS

DEFAULT_LIMIT = 100


LARGEST = 2**31 - 1  # rows that a page can name


def _whole_number(text: str | int | None, least: int, default: int) -> int:
    """A decimal number with an optional sign that a 64-bit integer holds; else `default`."""
    if not re.fullmatch(r"[+-]?[0-9]+", str(text)):
        return default
    number = int(text)
    return number if least <= number < 2**63 else default


def page_bounds(limit: str | int | None, offset: str | int | None) -> tuple[int, int]:
    """Rows to skip and rows wanted; what is no fitting number stands for 0 and DEFAULT_LIMIT."""
    return _whole_number(offset, 0, 0), _whole_number(limit, 1, DEFAULT_LIMIT)


def list_alerts(
    alerts: DataFrame,
    event_manager_id: str = "",
    status: str = "",
    type: str = "",
    limit: str | int | None = None,
    offset: str | int | None = None,
) -> DataFrame:
    """A page of alerts, newest first. An empty filter value does not filter.

    The filters reach the scan; order and page become one top-k per task.
    """
    wanted = {"event_manager_id": event_manager_id, "status": status, "type": type}
    for name, value in wanted.items():
        if value:
            alerts = alerts.filter(F.col(name) == value)
    skipped, wanted_rows = page_bounds(limit, offset)
    page = alerts.select(*ALERT_COLUMNS).orderBy(F.desc("created_at"), "dedup_key")
    if skipped > LARGEST:
        return page.limit(0)
    page = page.offset(skipped) if skipped else page
    return page.limit(wanted_rows) if wanted_rows <= LARGEST else page


def lookup(table: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Each distinct key with its row and `found`; the key stays when there is none."""
    keys = keys.select(F.col(column).alias("requested")).distinct()
    return keys.join(
        table.withColumn("found", F.lit(True)), F.col("requested") == F.col(column), "left"
    ).withColumn("found", F.coalesce("found", F.lit(False)))


def alerts_by_key(alerts: DataFrame, keys: DataFrame) -> DataFrame:
    return lookup(alerts, keys, "dedup_key")


def alerts_by_id(alerts: DataFrame, ids: DataFrame) -> DataFrame:
    return lookup(alerts, ids, "id")


def config_by_id(config: DataFrame, ids: DataFrame) -> DataFrame:
    return lookup(config, ids, "id")


def children_of(alerts: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(children of the requested parents, requested keys that are not a parent's).

    Children come newest first within their parent.
    """
    asked = alerts_by_key(alerts.select("dedup_key", "type"), keys)
    # fixed values: the two messages
    errors = asked.filter(~F.col("found") | ~is_parent()).select(
        F.col("requested").alias("dedup_key"),
        F.when(F.col("found"), "not_a_parent").otherwise("not_found").alias("error"),
        F.when(F.col("found"), "alert is not a parent alert").otherwise("alert not found").alias("message"),
    )
    parents = asked.filter(F.col("found") & is_parent()).select(
        F.col("requested").alias("parent_dedup_key")
    )
    children = (
        alerts.join(parents, "parent_dedup_key")
        .select(*ALERT_COLUMNS)
        .orderBy("parent_dedup_key", F.desc("created_at"), "dedup_key")
    )
    return children, errors


def list_config(config: DataFrame) -> DataFrame:
    return config.orderBy(F.desc("created_at"), "id")

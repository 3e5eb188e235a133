"""Alerts kept up to date slice by slice, each slice of the log folded onto what is stored.

The store holds what later events need, and no events: a row per alert (its birth, family and last action), per
parent (its state and counts) and per group (the window that is open). A slice goes through the same steps as a
whole log, begun from the stored rows of the keys, families and groups that it touches; what comes out replaces
those rows. Slices follow each other in the order of the log.

A fold writes the touched rows as one part. A version of the store is a manifest: the parts it consists of, oldest
first, and the slices folded so far. Parts are written before their manifest, and a reader goes by the newest
manifest alone, so a fold that is cut off leaves no trace in it. A slice that a manifest names is not folded
again. `compact` replaces all parts by one with the newest row of each key, as a version of its own.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.functions.events import alert_id
from tocsin.operators import anchors, births, lifecycle
from tocsin.operators.anchors import GROUP
from tocsin.operators.hot import Limits, hot_keys
from tocsin.operators.parts import newest
from tocsin.schemas import ALERT_COLUMNS
from tocsin.session import materialize, passing

PAYLOAD = ["event_manager_id", "summary", "severity", "class"]
TABLES = {
    "alerts": (
        ["dedup_key"],
        "dedup_key string, family string, born_at timestamp_ntz, born_seq long, "
        + ", ".join(f"{c} string" for c in PAYLOAD)
        + ", acted string, changed_at timestamp_ntz",
    ),
    "families": (
        ["family"],
        "family string, state string, active long, children long, updated_at timestamp_ntz, "
        "resolved_at timestamp_ntz, requested_at timestamp_ntz, remaining int, born_at timestamp_ntz, "
        + ", ".join(f"{c} string" for c in PAYLOAD),
    ),
    "groups": (GROUP, ", ".join(f"{c} string" for c in GROUP) + ", open_parent string, open_until timestamp_ntz"),
}
MANIFEST = "version int, number int, part string, slice string"


@dataclass(frozen=True)
class Manifest:
    version: int
    parts: tuple[str, ...]
    slices: tuple[str, ...]


def seeds_of(families: DataFrame) -> DataFrame:
    """Stored families as what `build_timeline` begins with."""
    pending = F.col("state") == "pending"
    return families.select(
        "family",
        F.col("active").alias("had_active"),
        F.col("children").alias("had_children"),
        (F.col("state") != "resolved").alias("was_active"),
        pending.alias("was_pending"),
        F.when(pending, F.col("requested_at")).alias("was_requested_at"),
        F.when(pending, F.col("remaining")).alias("was_remaining"),
    )


def fold(
    routed: DataFrame, stored: dict[str, DataFrame], limits: Limits = Limits()
) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the rows of alerts, families and groups that the events change, the timeline of the events).

    `stored`: the rows from before.
    """
    place = F.struct("received_at", "seq")
    touched = materialize(births.summaries(routed, F.max_by("action", place).alias("last_action")), "touched")
    total = touched.agg(F.sum("rows")).first()[0] or 0
    split = limits if total > limits.hot_rows else None
    known = materialize(stored["alerts"].join(touched.drop("first"), "dedup_key"), "known")

    born = births.of_summaries(touched).join(known.select("dedup_key"), "dedup_key", "left_anti")
    if split is not None:
        born = materialize(born, "births")
    also = (*[c for c in PAYLOAD if c not in GROUP], "last_action")
    new = materialize(anchors.links(born, split, stored["groups"], also), "links")
    columns = ["dedup_key", "family", "born_at", "born_seq", "rows", "last_at"]
    links = new.select(*columns, F.lit(None).cast("string").alias("acted")).union(known.select(*columns, "acted"))

    hot_alerts = hot_keys(
        links.select("dedup_key", "rows", F.col("born_at").alias("first_at"), "last_at"), ["dedup_key"], split
    )
    history = lifecycle.alert_history(routed, links, hot_alerts)
    before = materialize(stored["families"].join(links.select("family"), "family", "left_semi"), "before")
    timeline = lifecycle.build_timeline(history, lifecycle.hot_families(links, split), limits, seeds_of(before))
    timeline = materialize(timeline, "timeline")
    tables = {
        "alerts": _alerts(new, known, timeline),
        "families": _families(before, new, timeline),
        "groups": _groups(new),
    }
    return {name: df.select(*columns_of(name)) for name, df in tables.items()}, timeline


def columns_of(table: str) -> list[str]:
    return [c.split()[0] for c in TABLES[table][1].split(", ")]


def _alerts(new: DataFrame, known: DataFrame, timeline: DataFrame) -> DataFrame:
    changed = lifecycle.child_final(timeline).select("dedup_key", F.col("updated_at").alias("changed_now"))
    columns = ["dedup_key", "family", "born_at", "born_seq", *PAYLOAD, "last_action"]
    fresh = new.select(*columns, F.lit(None).cast("timestamp_ntz").alias("changed_at"))
    rows = fresh.union(known.select(*columns, "changed_at")).join(changed, "dedup_key", "left")
    return rows.select(*columns[:-1], F.col("last_action").alias("acted"), F.coalesce("changed_now", "changed_at").alias("changed_at"))


def _families(before: DataFrame, new: DataFrame, timeline: DataFrame) -> DataFrame:
    steps = timeline.groupBy("family").agg(F.sum("step").alias("steps"))
    found = lifecycle.parent_final(timeline).drop("dedup_key").withColumnRenamed("requested_at", "asked_at").join(steps, "family")
    opened = new.where("dedup_key = family").select("family", "born_at", *PAYLOAD)
    before = before.unionByName(opened, allowMissingColumns=True)
    old = before.select("family", *[F.col(c).alias(f"old_{c}") for c in before.columns if c != "family"])
    found = found.join(old, "family", "left")
    # null if no stretch of these events decides it (a split family without parent events): then it is as it was
    state = F.when(F.col("resolve_requested"), "pending").when(F.col("resolve_requested").isNotNull(), F.col("status"))
    found = found.withColumn("state", F.coalesce(state, "old_state"))
    resolved, pending = F.col("state") == "resolved", F.col("state") == "pending"
    return found.select(
        "family",
        "state",
        (F.col("steps") + F.coalesce("old_active", F.lit(0))).cast("long").alias("active"),
        F.greatest(F.col("child_count").cast("long"), F.coalesce("old_children", F.lit(0))).alias("children"),
        F.coalesce("updated_at", "old_updated_at").alias("updated_at"),
        F.when(resolved, F.coalesce("resolved_at", "old_resolved_at")).alias("resolved_at"),
        F.when(pending, F.coalesce("asked_at", "old_requested_at")).alias("requested_at"),
        F.when(pending, F.coalesce("remaining_children", "old_remaining")).alias("remaining"),
        *[F.col(f"old_{c}").alias(c) for c in ("born_at", *PAYLOAD)],
    )


def _groups(new: DataFrame) -> DataFrame:
    """The last window opened in each group that has a new parent."""
    last = F.max_by(F.struct("dedup_key", "expires_at"), F.struct("born_at", "born_seq"))
    opened = new.where("dedup_key = family").groupBy(*GROUP).agg(last.alias("last"))
    return opened.select(*GROUP, F.col("last.dedup_key").alias("open_parent"), F.col("last.expires_at").alias("open_until"))


def alert_rows(alerts: DataFrame, families: DataFrame) -> DataFrame:
    """Rows of the alerts table: children from `alerts`, parents from `families`."""
    resolved, nothing = F.col("acted") == "resolve", F.lit(None).cast("string")
    children = alerts.where("family <> dedup_key").select(
        alert_id(F.col("dedup_key")).alias("id"),
        "dedup_key",
        *PAYLOAD,
        F.lit("child").alias("type"),
        F.when(resolved, "resolved").otherwise("active").alias("status"),
        F.col("family").alias("parent_dedup_key"),
        F.lit(0).alias("child_count"),
        F.lit(False).alias("resolve_requested"),
        F.col("born_at").alias("created_at"),
        F.col("changed_at").alias("updated_at"),
        F.when(resolved, F.col("changed_at")).alias("resolved_at"),
    )
    parents = families.select(
        alert_id(F.col("family")).alias("id"),
        F.col("family").alias("dedup_key"),
        *PAYLOAD,
        F.lit("parent").alias("type"),
        F.when(F.col("state") == "resolved", "resolved").otherwise("active").alias("status"),
        nothing.alias("parent_dedup_key"),
        F.col("children").cast("int").alias("child_count"),
        (F.col("state") == "pending").alias("resolve_requested"),
        F.col("born_at").alias("created_at"),
        "updated_at",
        "resolved_at",
    )
    return children.unionByName(parents).select(*ALERT_COLUMNS)


class AlertStore:
    """The stored state under a path; see the module's text."""

    def __init__(self, spark: SparkSession, path: str, limits: Limits = Limits()):
        self.spark, self.path, self.limits = spark, path, limits

    @classmethod
    def create(cls, spark: SparkSession, path: str, limits: Limits = Limits()) -> AlertStore:
        store = cls(spark, path, limits)
        store._publish(Manifest(0, (), ()))
        return store

    def _publish(self, made: Manifest) -> Manifest:
        """Write a manifest; fails if that version is there already, as when two folds race for it."""
        rows = [(made.version, i, x, None) for i, x in enumerate(made.parts)]
        rows += [(made.version, i, None, x) for i, x in enumerate(made.slices)]
        rows = rows or [(made.version, -1, None, None)]
        frame = self.spark.createDataFrame(rows, MANIFEST).coalesce(1)
        frame.write.mode("errorifexists").parquet(f"{self.path}/manifest/at={made.version}")
        return made

    def manifest(self) -> Manifest:
        """The newest version; it has a row per part and slice, so compaction keeps it short."""
        rows = self.spark.read.schema(f"{MANIFEST}, at int").parquet(f"{self.path}/manifest")
        newest = rows.join(rows.agg(F.max("at").alias("at")), "at").orderBy("number").collect()
        parts = tuple(r["part"] for r in newest if r["part"] is not None)
        return Manifest(newest[0]["version"], parts, tuple(r["slice"] for r in newest if r["slice"] is not None))

    def tables(self, made: Manifest | None = None) -> dict[str, DataFrame]:
        """Newest rows of all tables of a version."""
        made = made or self.manifest()
        return {name: self._newest(name, made.parts) for name in TABLES}

    def _newest(self, name: str, parts: tuple[str, ...]) -> DataFrame:
        key, schema = TABLES[name]
        read = self.spark.read.schema(schema)
        if not parts:
            return self.spark.createDataFrame([], schema)
        return newest([read.parquet(f"{self.path}/{part}/{name}") for part in parts], key)

    def _write(self, tables: dict[str, DataFrame]) -> str:
        part = f"part-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{part}/{name}")
        return part

    def fold(self, name: str, routed: DataFrame) -> Manifest:
        """Fold the slice `name` of routed events, unless it has been folded before."""
        made = self.manifest()
        if name in made.slices:
            return made
        with passing(self.spark):
            part = self._write(fold(routed, self.tables(made), self.limits)[0])
        return self._publish(Manifest(made.version + 1, (*made.parts, part), (*made.slices, name)))

    def compact(self) -> Manifest:
        """One part with the newest row of each key."""
        made = self.manifest()
        if len(made.parts) < 2:
            return made
        return self._publish(Manifest(made.version + 1, (self._write(self.tables(made)),), made.slices))

    def alerts(self) -> DataFrame:
        """The alerts table after all slices folded so far."""
        tables = self.tables()
        return alert_rows(tables["alerts"], tables["families"])

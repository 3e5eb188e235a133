"""Status of alerts over time: child changes, and the parent states built on them.

A child is active after a trigger and resolved after a resolve, so its changes
are a `lag` over its events. A parent is active, pending or resolved, and a
resolve request waits while children are active. Stretches of a family's log in
which at least one child is active ("busy") alternate with idle ones, and what
a whole stretch does to the parent follows from a few minima and maxima over
its parent events:

    idle        its last event decides: trigger -> active, resolve -> resolved
    busy, from active     the first resolve makes it pending
    busy, from resolved   the first trigger makes it active again, the first
                          resolve after that makes it pending
    end of busy           pending -> resolved

So between stretches the parent is active or resolved, and a stretch keeps,
sets or swaps these two. A running count of swaps since the last "set" gives
the state at the start of every stretch without stepping through the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.operators.births import after_birth
from tocsin.operators.hot import Limits, hot_keys, position, running, with_slot
from tocsin.session import materialize

C = F.col


def hot_dedup_keys(links: DataFrame, limits: Limits | None) -> DataFrame | None:
    stats = links.select("dedup_key", "rows", C("born_at").alias("first_at"), "last_at")
    return hot_keys(stats, ["dedup_key"], limits)


def hot_families(links: DataFrame, limits: Limits | None) -> DataFrame | None:
    stats = links.groupBy("family").agg(
        F.sum("rows").alias("rows"),
        F.min("born_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
    )
    return hot_keys(stats, ["family"], limits)


def attach(routed: DataFrame, links: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Events with the family and birth of their alert (null if there is none).

    `acted`: the alert's last action before these events, if `links` has it. Joined on (dedup_key, slot): a hot key's alert row is repeated once per
    slot, so the events of the key spread over its slots.
    """
    events = with_slot(
        routed.select("dedup_key", "received_at", "seq", "action"), ["dedup_key"], hot
    )
    acted = F.col("acted") if "acted" in links.columns else F.lit(None).cast("string").alias("acted")
    alerts = links.select("dedup_key", "family", "born_at", "born_seq", acted)
    if hot is None:
        return events.join(alerts, "dedup_key", "left")
    alerts = (
        alerts.join(hot.select("dedup_key", "slots"), "dedup_key", "left")
        .withColumn("slot", F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1)))
        .drop("slots")
    )
    return events.join(alerts, ["dedup_key", "slot"], "left")


def _is_parent() -> Column:
    return C("dedup_key") == C("family")


def alert_history(
    routed: DataFrame, links: DataFrame, hot: DataFrame | None, unborn: bool = False
) -> DataFrame:
    """Events from their alert's birth on, with the action before of the same alert (`was`).

    All events of an alert that has acted before these events count, whatever their time.
    `unborn` keeps the other events too; `known` tells them apart.
    """
    rows = attach(routed, links, hot)
    counts = after_birth() | C("acted").isNotNull()
    if not unborn:
        rows = rows.filter(counts)
    else:
        # events before a birth, or without any, carry nothing: spread them, however many a key has
        alone = 1_000_000 + F.pmod(F.xxhash64("received_at", "seq"), F.lit(1024)).cast("int")
        rows = rows.withColumn("slot", F.when(F.coalesce(counts, F.lit(False)), C("slot")).otherwise(alone))
    was = F.when(counts, C("action"))
    rows = running(rows, ["dedup_key"], hot is not None, latest={"was": was})
    return rows.select(
        "family",
        "dedup_key",
        "received_at",
        "seq",
        "action",
        _is_parent().alias("is_parent"),
        # places may repeat: only the first event at the birth's place is the birth
        ((position() == F.struct("born_at", "born_seq")) & F.coalesce("was", "acted").isNull()).alias("is_birth"),
        F.coalesce("was", "acted").alias("was"),
        counts.alias("known"),
    )


def changes_child() -> Column:
    """A child's event that changes its status: its birth, or an action unlike the last."""
    return ~C("is_parent") & (C("is_birth") | (C("was") != C("action")))


def child_transitions(history: DataFrame) -> DataFrame:
    """(family, dedup_key, received_at, seq, action, is_birth) of every child change."""
    return history.filter(changes_child()).select(
        "family", "dedup_key", "received_at", "seq", "action", "is_birth"
    )


def child_final(timeline: DataFrame) -> DataFrame:
    """Status of every child after its last change."""
    last = F.max(F.struct("received_at", "seq", "action"))
    return (
        timeline.filter(~C("is_parent"))
        .groupBy("family", "dedup_key")
        .agg(last.alias("last"))
        .select(
            "family",
            "dedup_key",
            F.when(C("last.action") == "trigger", "active").otherwise("resolved").alias("status"),
            C("last.received_at").alias("updated_at"),
            F.when(C("last.action") == "resolve", C("last.received_at")).alias("resolved_at"),
        )
    )


# What a family has come to before the rows of a timeline, and what that is for one that begins with them.
SEEDS = {
    "had_active": "0L",
    "had_children": "0L",
    "was_active": "FALSE",
    "was_pending": "FALSE",
    "was_requested_at": "CAST(NULL AS timestamp_ntz)",
    "was_remaining": "CAST(NULL AS int)",
}


def with_seeds(rows: DataFrame, hot: DataFrame | None, seeds: DataFrame | None) -> DataFrame:
    """Add what each row's family has come to before, from (family, the columns of SEEDS)."""
    if seeds is None:
        return rows.selectExpr("*", *[f"{default} AS {name}" for name, default in SEEDS.items()])
    keys = ["family"]
    if hot is not None:  # a hot family's seed is repeated for each of its slots
        seeds = seeds.join(hot.select("family", "slots"), "family", "left")
        seeds = seeds.withColumn("slot", F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1))).drop("slots")
        keys = ["family", "slot"]
    seeded = rows.join(seeds.select(*keys, *SEEDS), keys, "left")
    return seeded.withColumns({name: F.coalesce(name, F.expr(default)) for name, default in SEEDS.items()})


def build_timeline(
    history: DataFrame, hot: DataFrame | None, limits: Limits = Limits(), seeds: DataFrame | None = None
) -> DataFrame:
    """All parent events and child changes of every family, with what each does to the parent.

    `place`: position in the family's log, counted from 1.
    `active_children`, `children`: active children and children ever born, after
    the row. `stretch`: number of its stretch, odd = busy; `ends`: it ends a busy
    one. `state`: the parent's state before the row. `effect`: born, none,
    reactivated, resolve_noop, deferred, resolved, cascaded. `end_state`,
    `requested_at`, `remaining_children`: state at the end of the stretch, last
    resolve request in it, and active children at the last request or child resolve.

    One shuffle by family does all of it; hot families go through their slots. `seeds`: what families
    have come to before `history`, as for `with_seeds`; other families begin with it.
    """
    split = hot is not None
    rows = history.filter(C("is_parent") | changes_child()).drop("was", "known")
    step = F.expr("CASE WHEN is_parent THEN 0 WHEN action = 'trigger' THEN 1 ELSE -1 END")
    rows = with_slot(rows.withColumn("step", step), ["family"], hot)
    rows = with_seeds(rows, hot, seeds)
    if split:
        # the carry of each running value reads these rows once more
        rows = materialize(rows, "moves")
    rows = running(
        rows,
        ["family"],
        split,
        sums={
            "active_children": C("step"),
            "children": F.expr("CAST(is_birth AND NOT is_parent AS INT)"),
            "place": F.lit(1),
        },
    )
    rows = rows.withColumns({
        "active_children": C("active_children") + C("had_active"),
        "children": C("children") + C("had_children"),
    })
    starts = "step = 1 AND active_children = 1"
    ends = "step = -1 AND active_children = 0"
    rows = running(
        rows,
        ["family"],
        split,
        sums={"crossings": F.expr(f"CAST(({starts}) OR ({ends}) AS INT)")},
        latest={
            "since": F.expr(f"CASE WHEN ({starts}) OR ({ends}) THEN place END"),
            "prev_place": F.expr("CASE WHEN is_parent THEN place END"),
            "prev_action": F.expr("CASE WHEN is_parent THEN action END"),
        },
    )
    # the row that ends a busy stretch still belongs to it
    stretch = f"crossings + CAST(had_active > 0 AS INT) - CAST({ends} AS INT)"
    rows = rows.selectExpr(
        "*", f"{ends} AS ends", f"{stretch} AS stretch", f"({stretch}) % 2 = 1 AS busy"
    )
    if not split:
        return _effects(_whole_families(rows))
    rows = materialize(rows, "stretched")
    whole = _effects(_whole_families(rows.filter("slots = 1")))
    return whole.unionByName(_effects(_split_families(rows.filter("slots > 1"), limits)))


def active_children_timeline(timeline: DataFrame) -> DataFrame:
    """Active children of a parent after every change of a child."""
    return timeline.filter(~C("is_parent")).select(
        C("family").alias("parent_dedup_key"), "dedup_key", "received_at", "seq", "active_children"
    )


def _facts() -> dict[str, Column]:
    """What the events of a stretch say, as aggregates."""
    trigger = "is_parent AND action = 'trigger'"
    resolve = "is_parent AND action = 'resolve'"
    facts = {
        "first_trigger": f"min(CASE WHEN {trigger} THEN place END)",
        "last_trigger": f"max(CASE WHEN {trigger} THEN place END)",
        "first_resolve": f"min(CASE WHEN {resolve} THEN place END)",
        "last_resolve": f"max(CASE WHEN {resolve} THEN place END)",
        # the first resolve after the first trigger is the first one whose
        # previous parent event is a trigger of the same stretch
        "first_answered": f"""min(CASE WHEN {resolve} AND prev_action = 'trigger'
            AND prev_place > coalesce(since, 0) THEN place END)""",
        "closed": "max(ends)",
        "requested_at": f"max(CASE WHEN {resolve} THEN received_at END)",
        "last_count": f"""max(CASE WHEN ({resolve}) OR step = -1
            THEN struct(place, active_children) END)""",
    }
    return {name: F.expr(sql) for name, sql in facts.items()}


_ENDS_ON_TRIGGER = "last_trigger > coalesce(last_resolve, 0)"


# A family that was pending before these rows: as if its request were at place 0 of the stretch it waits in.
_WAITING = "was_pending AND stretch = 1"
_LATER = {"requested_at": "was_requested_at", "last_count": "struct(0L AS place, CAST(was_remaining AS long) AS active_children)"}


def _sets_and_swaps(df: DataFrame) -> DataFrame:
    """`sets_active`: the state a stretch always ends in, if it does; `swaps`: it swaps the two."""
    asked = {n: F.expr(f"CASE WHEN {_WAITING} THEN 0L ELSE {n} END") for n in ("first_resolve", "first_answered")}
    since = {n: F.expr(f"CASE WHEN {_WAITING} AND {n} IS NULL THEN {old} ELSE {n} END") for n, old in _LATER.items()}
    df = df.withColumns(asked | since)
    return df.selectExpr(
        "*",
        f"""CASE WHEN NOT busy THEN coalesce({_ENDS_ON_TRIGGER}, FALSE)
            WHEN first_resolve IS NULL THEN (CASE WHEN first_trigger IS NOT NULL THEN TRUE END)
            WHEN first_trigger IS NULL OR first_answered IS NOT NULL THEN FALSE END AS sets_active""",
        """CAST(busy AND first_trigger IS NOT NULL AND first_resolve IS NOT NULL
            AND first_answered IS NULL AS INT) AS swaps""",
    )


def _start_states(df: DataFrame, split: bool, order: tuple[str, ...], once: str) -> DataFrame:
    """Add `from_active`: the parent is active, not resolved, when the stretch starts.

    `once` is true on the last row of each stretch in `order`.
    """
    own = f"CASE WHEN {once} THEN swaps ELSE 0 END"
    df = running(df, ["family"], split, sums={"swapped": F.expr(own)}, order=order)
    setting = f"""CASE WHEN {once} AND sets_active IS NOT NULL
        THEN struct(sets_active AS active, swapped) END"""
    df = running(df, ["family"], split, latest={"base": F.expr(setting)}, order=order)
    odd = f"(swapped - {own} - coalesce(base.swapped, 0)) % 2 = 1"
    return df.selectExpr("*", f"coalesce(base.active, was_active) <> ({odd}) AS from_active")


def _whole_families(rows: DataFrame) -> DataFrame:
    """Facts and start state of each row's stretch, all within the family's partition."""
    order = ("stretch", "place")
    family = Window.partitionBy("family", "slot").orderBy(*order)
    stretch = Window.partitionBy("family", "slot", "stretch")
    rows = rows.withColumn("next", F.lead("stretch").over(family))
    rows = rows.select("*", *[f.over(stretch).alias(n) for n, f in _facts().items()])
    last = "(next IS NULL OR next <> stretch)"
    return _start_states(_sets_and_swaps(rows), False, order, last)


def _split_families(rows: DataFrame, limits: Limits) -> DataFrame:
    """The same for hot families, whose stretches may be as large as they are.

    Facts are aggregated map-side, and stretches, numbered without gaps, are cut
    into ranges of equal length for the start states.
    """
    one = (
        rows.filter(C("is_parent") | (C("step") == -1))
        .groupBy("family", "stretch", "busy")
        .agg(*[f.alias(n) for n, f in _facts().items()], *[F.max(n).alias(n) for n in SEEDS])
        .withColumn("slot", F.floor(C("stretch") / limits.slot_rows).cast("int"))
        .withColumn("slots", F.lit(2))
    )
    one = _start_states(_sets_and_swaps(materialize(one, "stretches")), True, ("stretch",), "TRUE")
    return rows.join(one.drop("busy", "slot", "slots", *SEEDS), ["family", "stretch"], "left")


def _effects(rows: DataFrame) -> DataFrame:
    rows = rows.selectExpr(
        "*",
        "CASE WHEN busy AND NOT from_active THEN first_trigger END AS revived",
        """CASE WHEN busy AND from_active THEN first_resolve
            WHEN busy THEN first_answered END AS pending""",
    )
    rows = rows.selectExpr(
        "*",
        """CASE
            WHEN busy AND pending < place THEN 'pending'
            WHEN busy AND (from_active OR revived < place) THEN 'active'
            WHEN busy THEN 'resolved'
            WHEN prev_place > coalesce(since, 0)
                THEN (CASE prev_action WHEN 'trigger' THEN 'active' ELSE 'resolved' END)
            WHEN from_active THEN 'active' ELSE 'resolved' END AS state""",
        f"""CASE
            WHEN closed IS NULL THEN NULL
            WHEN NOT busy AND {_ENDS_ON_TRIGGER} THEN 'active'
            WHEN NOT busy THEN 'resolved'
            WHEN pending IS NOT NULL AND closed THEN 'resolved'
            WHEN pending IS NOT NULL THEN 'pending'
            WHEN from_active OR revived IS NOT NULL THEN 'active'
            ELSE 'resolved' END AS end_state""",
    )
    return rows.selectExpr(
        "family",
        "dedup_key",
        "received_at",
        "seq",
        "action",
        "is_parent",
        "is_birth",
        "step",
        "active_children",
        "children",
        "stretch",
        "ends",
        "state",
        """CASE
            WHEN NOT is_parent AND ends AND state = 'pending' THEN 'cascaded'
            WHEN NOT is_parent THEN 'none'
            WHEN is_birth THEN 'born'
            WHEN action = 'trigger' AND state = 'resolved' THEN 'reactivated'
            WHEN action = 'trigger' THEN 'none'
            WHEN state = 'resolved' THEN 'resolve_noop'
            WHEN active_children > 0 THEN 'deferred'
            ELSE 'resolved' END AS effect""",
        "end_state",
        "requested_at",
        "last_count.active_children AS remaining_children",
    )


def parent_final(timeline: DataFrame) -> DataFrame:
    """Status of every parent after the last row of its family."""
    child_birth = ~C("is_parent") & C("is_birth")
    changed = child_birth | ~C("effect").isin("none", "resolve_noop")
    # a last stretch without parent events and without an end changes nothing
    # and, in a split family, has no facts: the one before it decides
    end = F.struct("stretch", "end_state", "requested_at", "remaining_children")
    state = C("end.end_state")
    pending = state == "pending"
    return (
        timeline.groupBy("family")
        .agg(
            F.max(F.when(C("end_state").isNotNull(), end)).alias("end"),
            F.max(F.when(changed, C("received_at"))).alias("updated_at"),
            F.max(F.when(C("effect").isin("resolved", "cascaded"), C("received_at"))).alias("done_at"),
            F.max("children").cast("int").alias("child_count"),
        )
        .select(
            "family",
            C("family").alias("dedup_key"),
            F.when(state == "resolved", "resolved").otherwise("active").alias("status"),
            "updated_at",
            F.when(state == "resolved", C("done_at")).alias("resolved_at"),
            "child_count",
            pending.alias("resolve_requested"),
            F.when(pending, C("end.requested_at")).alias("requested_at"),
            F.when(pending, C("end.remaining_children")).cast("int").alias("remaining_children"),
        )
    )


def event_outcomes(
    routed: DataFrame, links: DataFrame, hot: DataFrame | None, timeline: DataFrame
) -> DataFrame:
    """Which branch every routed event took, and whether it also resolved the parent."""
    columns = ["seq", "received_at", "dedup_key", "action"]
    history = alert_history(routed, links, hot, unborn=True)
    unchanged = (
        F.when(~C("known"), "resolve_unknown")
        .when(C("action") == "trigger", "duplicate")
        .otherwise("resolve_noop")
    )
    # the timeline has the rest: parent events and child changes
    kept = history.filter(~C("known") | (~C("is_parent") & ~changes_child())).select(
        *columns, unchanged.alias("outcome"), F.lit(False).alias("cascaded")
    )
    child = (
        F.when(C("is_birth"), "new_child")
        .when(C("action") == "trigger", "reactivated")
        .otherwise("child_resolved")
    )
    parent = (
        F.when(C("effect") == "born", "new_parent")
        .when(C("effect") == "none", "duplicate")
        .when(C("effect") == "deferred", "resolve_deferred")
        .when(C("effect") == "resolved", "parent_resolved")
        .otherwise(C("effect"))
    )
    changed = timeline.select(
        *columns,
        F.when(C("is_parent"), parent).otherwise(child).alias("outcome"),
        (C("effect") == "cascaded").alias("cascaded"),
    )
    return kept.unionByName(changed)

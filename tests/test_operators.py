"""Validation, routing, config feed, as-of join, state views and read queries."""

from datetime import timedelta

import pytest
from helpers import T0, TINY, config, event, frame, random_log, routed
from pyspark.sql import functions as F

from tocsin.functions.events import (
    event_reject_reason,
    grouping_value,
    is_action,
    is_severity,
    manager_reject_reason,
    partition_key,
    rule_reject_reason,
)
from tocsin.operators import config_feed, reads, state
from tocsin.operators.asof import asof_join
from tocsin.operators.hot import Limits
from tocsin.operators.routing import route_events
from tocsin.plans.run import AlertRun


def test_event_validation_order(spark):
    good = event(0, 0, "k")
    bad = [
        ({"event_manager_id": "", "summary": ""}, "empty_event_manager_id"),
        ({"summary": None, "severity": "x"}, "empty_summary"),
        ({"severity": "critical", "action": "x"}, "invalid_severity"),
        ({"severity": None}, "invalid_severity"),
        ({"severity": "High"}, "invalid_severity"),
        ({"action": "unknown", "dedup_key": ""}, "invalid_action"),
        ({"dedup_key": ""}, "empty_dedup_key"),
        ({"class": ""}, None),
        ({}, None),
    ]
    log = [{**good, **change, "seq": i} for i, (change, _) in enumerate(bad)]
    got = frame(spark, log).select("seq", event_reject_reason().alias("r")).orderBy("seq")
    assert [r.r for r in got.collect()] == [reason for _, reason in bad]


def test_domains(spark):
    values = spark.createDataFrame([(v,) for v in ("high", "low", "", None, "trigger")], "v string")
    got = values.select("v", is_severity(F.col("v")).alias("s"), is_action(F.col("v")).alias("a"))
    assert [(r.s, r.a) for r in got.collect()] == [
        (True, False), (True, False), (False, False), (False, False), (False, True),
    ]


def test_config_validation(spark):
    rules = spark.createDataFrame(
        [("", "class", 5), ("n", None, 5), ("n", "class", 0), ("n", "class", -1), ("n", "class", 1)],
        "name string, grouping_key string, time_window_minutes int",
    ).select(rule_reject_reason().alias("r"))
    assert [r.r for r in rules.collect()] == [
        "empty_name", "empty_grouping_key", "invalid_time_window", "invalid_time_window", None,
    ]
    managers = spark.createDataFrame(
        [("", "r"), ("n", ""), ("n", "r")], "name string, grouping_rule_id string"
    ).select(manager_reject_reason().alias("r"))
    assert [r.r for r in managers.collect()] == ["empty_name", "empty_grouping_rule_id", None]


def test_grouping_value_and_partition_key(spark):
    log = frame(spark, [event(0, 0, "k", cls="database", severity="low")])
    keys = ["class", "severity", "event_manager_id", "region"]
    got = log.select(*[grouping_value(F.lit(k)).alias(k) for k in keys]).first()
    assert list(got) == ["database", "low", "em-1", ""]
    digest = log.select(
        partition_key(F.lit("em-1"), F.lit("database")).alias("a"),
        partition_key(F.lit("em-2"), F.lit("database")).alias("b"),
        partition_key(F.lit("em-1"), F.lit("network")).alias("c"),
    ).first()
    assert digest.a == "0f11bc7eba7b6243" and len(set(digest)) == 3


def test_unknown_manager_and_rule(spark):
    managers, rules = config(spark, managers={"em-1": "rule-1", "em-2": "gone"})
    log = frame(spark, [event(0, 0, "a"), event(1, 0, "b", manager="em-2"), event(2, 0, "c", manager="x")])
    ok, rejects = route_events(log, managers, rules)
    assert [r.seq for r in ok.collect()] == [0]
    assert {r.seq: r.reject_message for r in rejects.collect()} == {
        1: "grouping rule not found",
        2: "event manager not found",
    }


CHANGES = "seq long, changed_at timestamp_ntz, op string, id string, name string, grouping_key string, time_window_minutes int"


def changes(spark, rows):
    data = [
        (i, T0 + timedelta(minutes=minute), op, rule, name, "class", window)
        for i, (minute, op, rule, name, window) in enumerate(rows)
    ]
    return spark.createDataFrame(data, CHANGES)


FEED = [
    (0, "update", "r", "a", 5),
    (1, "create", "r", "a", 5),
    (2, "create", "r", "b", 5),
    (3, "update", "r", "", 5),
    (4, "update", "r", "c", 7),
    (5, "delete", "r", None, None),
    (6, "delete", "r", None, None),
    (7, "create", "r", "d", 0),
    (8, "update", "r", "e", 5),
    (9, "create", "r", "f", 9),
    (10, "create", "s", "g", 1),
]


@pytest.mark.parametrize("limits", [Limits(), Limits(hot_rows=2, slot_rows=1)])
def test_config_feed(spark, limits):
    current, history, rejects = config_feed.apply_rule_changes(changes(spark, FEED), limits)
    assert {r.seq: r.reject_reason for r in rejects.collect()} == {
        0: "not_found", 2: "already_exists", 3: "empty_name", 6: "not_found",
        7: "invalid_time_window", 8: "not_found",
    }
    versions = {
        r.seq: (r.created_at.minute, r.valid_from.minute, r.valid_to and r.valid_to.minute)
        for r in history.collect()
    }
    assert versions == {1: (1, 1, 4), 4: (1, 4, 5), 9: (9, 9, None), 10: (10, 10, None)}
    assert {r.id: (r.name, r.time_window_minutes) for r in current.collect()} == {
        "r": ("f", 9),
        "s": ("g", 1),
    }


def test_events_see_the_config_of_their_time(spark):
    managers = spark.createDataFrame(
        [("em-1", T0, None, 0, "r")],
        "id string, valid_from timestamp_ntz, valid_to timestamp_ntz, seq long, grouping_rule_id string",
    )
    _, history, _ = config_feed.apply_rule_changes(changes(spark, FEED))
    log = [event(i, minute, f"k{i}") for i, minute in enumerate([-1, 0, 1, 4, 5, 9])]
    ok, rejects = config_feed.route_events_asof(frame(spark, log), managers, history)
    assert {r.seq: r.time_window_minutes for r in ok.collect()} == {2: 5, 3: 7, 5: 9}
    assert {r.seq: r.reject_reason for r in rejects.collect()} == {
        0: "event_manager_not_found", 1: "grouping_rule_not_found", 4: "grouping_rule_not_found",
    }


@pytest.mark.parametrize("limits", [Limits(), Limits(hot_rows=5, slot_rows=2)])
def test_asof_join_against_brute_force(spark, limits):
    log = random_log(3, 120, keys=3)
    left = frame(spark, [e for e in log if e["seq"] % 3]).select("seq", "received_at", "class")
    right = frame(spark, [e for e in log if not e["seq"] % 3]).select(
        "seq", "received_at", "class", "summary"
    )
    got = {
        r.seq: r.found and r.found.summary
        for r in asof_join(left, right, ["class"], "found", limits=limits).collect()
    }
    want = {}
    for e in (e for e in log if e["seq"] % 3):
        earlier = [
            (r["received_at"], r["seq"], r["summary"])
            for r in log
            if not r["seq"] % 3 and r["class"] == e["class"] and r["received_at"] <= e["received_at"]
        ]
        want[e["seq"]] = max(earlier)[2] if earlier else None
    assert got == want


@pytest.fixture(scope="module")
def run(spark):
    return AlertRun(routed(spark, random_log(21, 200, keys=30)))


def test_live_parent_matches_scan(spark, run):
    probes = run.routed.select(
        "seq", "received_at", "event_manager_id", "grouping_key", "grouping_value"
    )
    links = [r.asDict() for r in run.links.filter("dedup_key = family").collect()]
    group = ["event_manager_id", "grouping_key", "grouping_value"]
    for limits in (Limits(), TINY):
        for r in state.live_parent(probes, run.links, limits).collect():
            live = [
                p["dedup_key"]
                for p in links
                if all(p[c] == r[c] for c in group) and p["born_at"] <= r.received_at <= p["expires_at"]
            ]
            assert [r.parent_dedup_key] == (live or [None])


def test_children_views_agree(spark, run):
    sizes = {r.parent_dedup_key: r.children for r in state.children_set_sizes(run.links).collect()}
    sets = {r.parent_dedup_key: r.children for r in state.children_sets(run.links).collect()}
    assert {k: len(set(v)) for k, v in sets.items()} == sizes
    pairs = state.children(run.links).collect()
    assert {(r.parent_dedup_key, r.dedup_key) for r in pairs} == {(k, c) for k, v in sets.items() for c in v}
    assert len(pairs) == sum(sizes.values())
    counts = {r.parent_dedup_key: r.child_count for r in state.child_counts(run.links).collect()}
    assert {k: n for k, n in counts.items() if n} == sizes
    active = {r.parent_dedup_key: r.active_children for r in state.active_child_counts(run.alerts).collect()}
    assert active.keys() == counts.keys() and all(active[k] <= counts[k] for k in active)


def test_list_alerts_pages(spark, run):
    alerts = run.stored_alerts
    rows = sorted(alerts.collect(), key=lambda r: r.dedup_key)
    rows.sort(key=lambda r: r.created_at, reverse=True)
    names = [r.dedup_key for r in rows]

    def page(**args):
        return [r.dedup_key for r in reads.list_alerts(alerts, **args).collect()]

    assert page() == names[:100]
    assert page(limit="3", offset="2") == names[2:5]
    assert page(limit=0, offset=-4) == names[:100]
    # numbers as the original parser reads them: a sign and digits, up to 64 bits
    assert page(limit="+3", offset="1_0") == names[:3]
    assert page(limit=" 7 ") == page(limit="9" * 30) == names[:100]
    assert page(limit="99999999999") == names
    assert page(offset="99999999999") == []
    assert page(limit="ten", offset="two") == names[:100]
    assert page(offset=10_000) == []
    assert page(status="nothing") == []
    parents = [r.dedup_key for r in rows if r.type == "parent" and r.status == "active"]
    assert page(type="parent", status="active") == parents[:100]


def test_list_alerts_plan_is_a_top_k_with_pushed_filters(spark, run):
    plan = reads.list_alerts(run.stored_alerts, status="active", limit=5, offset=2)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in text and "EqualTo(status,active)" in text


def test_children_of(spark, run):
    alerts = {r.dedup_key: r for r in run.stored_alerts.collect()}
    keys = spark.createDataFrame([(k,) for k in [*alerts, "nobody"]], "dedup_key string")
    children, errors = reads.children_of(run.stored_alerts, keys)
    assert {r.dedup_key for r in children.collect()} == {
        k for k, r in alerts.items() if r.type == "child"
    }
    assert {r.dedup_key: r.error for r in errors.collect()} == {
        "nobody": "not_found",
        **{k: "not_a_parent" for k, r in alerts.items() if r.type == "child"},
    }

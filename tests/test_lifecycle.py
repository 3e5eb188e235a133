"""Batch lifecycle against the sequential model, with and without split hot keys."""

import pytest
from helpers import MANAGERS, RULES, TINY, event, random_log, routed
from pyspark.sql import functions as F
from replay import replay

from tocsin.operators import anchors
from tocsin.operators.hot import Limits, hot_keys, with_slot
from tocsin.plans.run import AlertRun


def expect(events):
    return replay(events, MANAGERS, {k: RULES[k] for k in RULES})


def alerts_of(run):
    return {
        r.dedup_key: (
            r.parent_dedup_key, r.status, r.child_count, r.resolve_requested,
            r.created_at, r.updated_at, r.resolved_at, r.summary,
        )
        for r in run.alerts.collect()
    }


def check(spark, events, limits):
    run = AlertRun(routed(spark, events), limits)
    alerts, outcome, _ = expect(events)
    assert alerts_of(run) == {
        k: (
            a["parent"], a["status"], a["child_count"], a["pending"],
            a["created_at"], a["updated_at"], a["resolved_at"], a["summary"],
        )
        for k, a in alerts.items()
    }
    got = {r.seq: r.outcome + ("+cascade" if r.cascaded else "") for r in run.outcomes.collect()}
    assert got == outcome
    pending = {
        r.dedup_key: (r.requested_at, r.remaining_children)
        for r in run.parents.filter("resolve_requested").collect()
    }
    assert pending == {
        k: (a["requested_at"], a["remaining"]) for k, a in alerts.items() if a["pending"]
    }
    return run


@pytest.mark.parametrize("seed", [1, 3])
def test_random_logs_whole(spark, seed):
    check(spark, random_log(seed, 300, keys=5 + 10 * seed), Limits())


@pytest.mark.parametrize("seed", range(10, 13))
def test_random_logs_split(spark, seed):
    run = check(spark, random_log(seed, 300, keys=4 + 10 * (seed % 3)), TINY)
    assert run.hot_dedup_keys is not None and run.hot_families is not None


def test_random_logs_split_many_births(spark):
    log = random_log(99, 400, keys=400, hot=0.1, step=0.2)
    check(spark, log, TINY)


def test_hot_group_with_many_windows(spark):
    # births every 7 seconds and, in bursts, at one instant
    log = [event(i, (i - i % 9 // 6) * 7 / 60, f"k{i}") for i in range(1200)]
    log += [event(2000 + i, i * 9 / 60, f"s{i}", manager="em-3") for i in range(400)]
    run = AlertRun(routed(spark, log), Limits(hot_rows=100, slot_rows=10))
    alerts, _, _ = expect(log)
    got = {r.dedup_key: r.family for r in run.links.collect()}
    assert got == {k: a["parent"] or k for k, a in alerts.items()}


def test_hot_group_within_one_window_is_spread(spark):
    log = [event(i, i * 4 / 1000, f"k{i}") for i in range(1000)]
    limits = Limits(hot_rows=100, slot_rows=10)
    births = AlertRun(routed(spark, log), limits).births
    got = {r.dedup_key: r.family for r in anchors.links(births, limits).collect()}
    alerts, _, _ = expect(log)
    assert got == {k: a["parent"] or k for k, a in alerts.items()}
    stats = births.groupBy(*anchors.GROUP).agg(
        F.count("*").alias("rows"), F.min("born_at").alias("first_at"), F.max("born_at").alias("last_at")
    )
    hot = hot_keys(stats, anchors.GROUP, limits)
    slots = with_slot(anchors._timed(births, "born_at", "born_seq"), anchors.GROUP, hot).groupBy("slot").count().collect()
    assert len(slots) >= 50 and max(r["count"] for r in slots) <= 40


@pytest.mark.parametrize("size", [0, 1, 2, 3, 50, 129])
def test_pointer_doubling_reaches_a_whole_path(spark, size):
    # node i leads to i + 3; from 0 on that is every third node, whatever else leads where
    pointers = spark.createDataFrame([(f"n{i}", f"n{i + 3}") for i in range(size)], "node string, to string")
    found = anchors.reached(pointers, spark.createDataFrame([("n0",)], "node string"))
    assert sorted(r["node"] for r in found.collect()) == sorted(f"n{i}" for i in range(0, size + 3, 3))


def test_window_end_is_inclusive(spark):
    log = [event(0, 0, "p"), event(1, 5, "in"), event(2, 5, "out", micros=1)]
    run = check(spark, log, Limits())
    got = {r.dedup_key: r.family for r in run.links.collect()}
    assert got == {"p": "p", "in": "p", "out": "out"}


CASES = {
    "first event": [("p", 0, "trigger")],
    "same class": [("p", 0, "trigger"), ("c", 1, "trigger")],
    "child resolve": [("p", 0, "trigger"), ("c", 1, "trigger"), ("c", 2, "resolve")],
    "deferred": [("p", 0, "trigger"), ("c", 1, "trigger"), ("p", 2, "resolve")],
    "cascade": [("p", 0, "trigger"), ("c", 1, "trigger"), ("p", 2, "resolve"), ("c", 3, "resolve")],
    "duplicate": [("p", 0, "trigger"), ("p", 1, "trigger")],
    "reactivated": [("p", 0, "trigger"), ("p", 1, "resolve"), ("p", 2, "trigger")],
    "trigger on pending": [
        ("p", 0, "trigger"), ("c", 1, "trigger"), ("p", 2, "resolve"), ("p", 3, "trigger"),
        ("c", 4, "resolve"), ("p", 5, "trigger"),
    ],
    "requested twice": [
        ("p", 0, "trigger"), ("c", 1, "trigger"), ("d", 1, "trigger"), ("p", 2, "resolve"),
        ("c", 3, "resolve"), ("p", 4, "resolve"),
    ],
    "child of pending": [
        ("p", 0, "trigger"), ("c", 1, "trigger"), ("p", 2, "resolve"), ("d", 3, "trigger"),
        ("c", 4, "resolve"),
    ],
    "child of resolved": [
        ("p", 0, "trigger"), ("p", 1, "resolve"), ("c", 2, "trigger"), ("p", 3, "resolve"),
        ("p", 4, "trigger"), ("c", 4, "resolve"),
    ],
    "resolve first": [("p", 0, "resolve"), ("p", 1, "trigger")],
    "swap": [
        ("p", 0, "trigger"), ("p", 1, "resolve"), ("c", 2, "trigger"), ("p", 3, "resolve"),
        ("p", 3, "trigger"), ("c", 4, "resolve"), ("c", 4, "trigger"), ("p", 4, "resolve"),
        ("p", 4, "trigger"), ("c", 5, "resolve"), ("p", 5, "trigger"),
    ],
}


def test_small_cases(spark):
    # one log: every case has its own class, so its own group
    log = []
    for name, steps in CASES.items():
        for key, minute, action in steps:
            log.append(event(len(log), minute, f"{name}/{key}", action, cls=name))
    check(spark, log, Limits())
    check(spark, log, Limits(hot_rows=2, slot_rows=1))


def test_same_key_from_two_managers(spark):
    log = [
        event(0, 0, "k", manager="em-1"),
        event(1, 1, "k", "resolve", manager="em-2"),
        event(2, 1, "k", manager="em-3"),
        event(3, 2, "j", manager="em-3"),
    ]
    check(spark, log, Limits())


def test_keys_of_a_group_are_seen_by_one_task(spark):
    log = random_log(5, 300, keys=200, hot=0)
    run = AlertRun(routed(spark, log))
    groups = ["event_manager_id", "grouping_key", "grouping_value"]
    spread = (
        run.births.repartition(*groups)
        .withColumn("task", F.spark_partition_id())
        .groupBy(*groups)
        .agg(F.count_distinct("task").alias("n"))
    )
    assert spread.filter("n > 1").count() == 0

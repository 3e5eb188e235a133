"""Interval history of alerts and the rank index, against a replay and a plain sort."""

import pytest
from helpers import MANAGERS, RULES, TINY, event, random_log, routed
from pyspark.sql import functions as F
from replay import replay

from tocsin.operators.hot import Limits
from tocsin.operators.pages import RankedAlerts
from tocsin.operators.versions import state_at, state_probes
from tocsin.plans.run import AlertRun


def state(row):
    return row.event_manager_id, row.type, row.status, row.parent_dedup_key, row.resolve_requested


def expected(log, at):
    past = [e for e in log if e["received_at"] <= at]
    first = {}
    alerts = replay(past, MANAGERS, RULES)[0]
    for e in sorted(past, key=lambda e: (e["received_at"], e["seq"])):
        if e["action"] == "trigger":
            first.setdefault(e["dedup_key"], e["event_manager_id"])
    return {
        k: (first[k], "child" if a["parent"] else "parent", a["status"], a["parent"], a["pending"])
        for k, a in alerts.items()
    }


@pytest.mark.parametrize("limits", [Limits(), TINY])
def test_history_gives_the_state_at_any_time(spark, limits):
    log = random_log(11, 70, keys=7)
    run = AlertRun(routed(spark, log), limits)
    times = sorted({e["received_at"] for e in log})
    keys = sorted({e["dedup_key"] for e in log} | {"nobody"})
    want = {(k, t): expected(log, t).get(k) for t in times for k in keys}
    probes = spark.createDataFrame([(k, t) for k, t in want], "dedup_key string, received_at timestamp_ntz")
    got = {(r.dedup_key, r.received_at): state(r) for r in state_probes(probes, run.versions, limits).collect()}
    assert got == {at: found or (None,) * 5 for at, found in want.items()}
    for t in (times[0], times[len(times) // 2], times[-1]):
        now = {r.dedup_key: state(r) for r in state_at(run.versions, str(t)).collect()}
        assert now == expected(log, t)


def test_history_has_one_open_version_per_alert(spark):
    log = random_log(12, 90, keys=9)
    run = AlertRun(routed(spark, log))
    versions = run.versions.collect()
    assert sorted(r.dedup_key for r in versions if r.valid_to is None) == sorted(
        r.dedup_key for r in run.alerts.collect()
    )
    assert all(r.valid_to is None or r.valid_from <= r.valid_to for r in versions)


def test_probes_without_key_or_time(spark):
    run = AlertRun(routed(spark, [event(0, 0, "a")]))
    probes = spark.createDataFrame([(None, None), ("a", None), ("b", None)], "dedup_key string, received_at timestamp_ntz")
    assert [state(r) for r in state_probes(probes, run.versions).collect()] == [(None,) * 5] * 3
    assert state_probes(probes.limit(0), run.versions).count() == 0


@pytest.fixture(scope="module")
def listing(spark):
    """Alerts of which many were created at one time, with their order."""
    log = [event(i, i // 9, f"k{i:03}", manager=f"em-{i % 2 + 1}") for i in range(120)]
    log += [event(200 + i, 20 + i // 4, f"k{i * 3:03}", "resolve", manager=f"em-{i * 3 % 2 + 1}") for i in range(40)]
    alerts = AlertRun(routed(spark, log)).stored_alerts
    rows = sorted(alerts.collect(), key=lambda r: r.dedup_key)
    return alerts, sorted(rows, key=lambda r: r.created_at, reverse=True)


def keys(df):
    return [r.dedup_key for r in df.collect()]


def test_pages_at_any_offset(spark, listing, tmp_path):
    alerts, rows = listing
    ranked = RankedAlerts.write(alerts, f"{tmp_path}/ranked", range_rows=10)
    names = [r.dedup_key for r in rows]
    assert ranked.counts.select("range").distinct().count() > 5
    for offset in (0, 1, 9, 10, 11, 60, 119, 120, 2**40):
        assert keys(ranked.page(limit=13, offset=offset)) == names[offset : offset + 13]
    assert keys(ranked.page(limit=2**40)) == names
    assert keys(ranked.page(limit="x", offset="-1")) == names[:100]
    for status in ("active", "resolved", "none"):
        for manager in ("", "em-1", "em-9"):
            some = [r.dedup_key for r in rows if r.status == status and manager in ("", r.event_manager_id)]
            assert keys(ranked.page(manager, status, limit=7, offset=8)) == some[8:15]


def test_a_page_opens_its_ranges_only(spark, listing, tmp_path):
    ranked = RankedAlerts.write(listing[0], f"{tmp_path}/ranked", range_rows=10)
    page = ranked.page(limit=5, offset=70)
    text = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(range" in text and "TakeOrderedAndProject" in text
    assert page.count() == 5
    bounds = ranked.counts.groupBy("range").agg(F.sum("rows").alias("n")).orderBy("range").collect()
    assert sum(r.n for r in bounds) == 120 and max(r.n for r in bounds) < 60


def test_pages_of_no_alerts(spark, listing, tmp_path):
    ranked = RankedAlerts.write(listing[0].limit(0), f"{tmp_path}/ranked")
    assert keys(ranked.page()) == [] and keys(ranked.page(status="active", offset=5)) == []
    assert ranked.page().columns == listing[0].columns

"""The stream's alerts table: repeated and torn micro-batches, compaction at any point, racing writers."""

import random

import pytest
from helpers import config, random_log, routed
from test_streaming import rows, write_files

from tocsin.operators.routing import route_events
from tocsin.plans.run import AlertRun
from tocsin.streaming.pipeline import alert_table, start_lifecycle
from tocsin.streaming.table import GROWTH, AlertTable

SCHEMA = "dedup_key string, n int"


def frame_of(spark, found):
    return spark.createDataFrame(sorted(found.items()), SCHEMA)


def content(table):
    found = [tuple(r) for r in table.rows().collect()]
    assert len(found) == len({k for k, _ in found})
    return dict(found)


@pytest.fixture
def table(spark, tmp_path):
    return AlertTable(spark, f"{tmp_path}/table", SCHEMA)


def test_the_newest_row_of_each_key_stays_through_compactions(spark, table):
    rng, expected = random.Random(3), {}
    assert content(table) == {}
    for batch in range(6):
        found = {f"k{rng.randrange(30)}": batch for _ in range(rng.choice([0, 1, 4, 12]))}
        expected |= found
        for _ in range(rng.choice([1, 2])):  # a repeated micro-batch changes nothing
            made = table.publish(frame_of(spark, found), batch)
        assert made.batch == batch
        if batch % 3 == 2:
            table.compact()
        assert content(table) == expected
    table.compact(growth=10**9)
    assert content(table) == expected and len(table.manifest().parts) == 1


def test_parts_merge_as_they_grow(spark, table):
    table.publish(frame_of(spark, {f"k{i}": 0 for i in range(100)}), 0)
    large = table.manifest().parts[0]
    for batch in range(1, 7):
        table.publish(frame_of(spark, {f"k{batch}": batch}), batch)
        table.compact()
    parts = table.manifest().parts
    assert parts[0] == large  # not written again for a few rows
    later = [sum(p.rows for p in parts[i + 1 :]) for i in range(len(parts))]
    assert all(p.rows > GROWTH * n for p, n in zip(parts[:-1], later))
    assert content(table) == {f"k{i}": i if 1 <= i < 7 else 0 for i in range(100)}


def test_a_torn_write_is_not_seen(spark, table):
    table.publish(frame_of(spark, {"a": 1}), 0)
    table._write(frame_of(spark, {"a": 2, "b": 2}))  # the part is there, its manifest never came
    assert content(table) == {"a": 1}
    table.publish(frame_of(spark, {"a": 3}), 1)
    table._write(table._merged(table.manifest().parts))  # a compaction cut off half-way
    assert content(table) == {"a": 3}


def test_writers_that_race_lose_nothing(spark, table, monkeypatch):
    for batch, found in enumerate([{"a": 0, "b": 0}, {"a": 1}]):
        table.publish(frame_of(spark, found), batch)
    other = AlertTable(spark, table.path, SCHEMA)
    write = table._write

    def overtaken(found):
        part = write(found)
        monkeypatch.setattr(table, "_write", write)
        other.publish(frame_of(spark, {"b": 2, "c": 2}), 2)
        return part

    monkeypatch.setattr(table, "_write", overtaken)
    table.compact(growth=10**9)  # a micro-batch is published while parts are merged
    assert content(table) == {"a": 1, "b": 2, "c": 2} and len(table.manifest().parts) == 2
    stale = table.manifest()
    other.publish(frame_of(spark, {"a": 3}), 3)
    assert not table._commit(type(stale)(stale.version + 1, 3, ()))  # the version is taken
    assert content(table) == {"a": 3, "b": 2, "c": 2}


def test_expired_versions_leave_the_newest_whole(spark, table, tmp_path):
    for batch in range(5):
        table.publish(frame_of(spark, {"a": batch, f"k{batch}": batch}), batch)
        table.compact()
    before = content(table)
    table.expire(keep=1)
    assert content(table) == before
    folders = {p.name for p in (tmp_path / "table").glob("part-*")}
    assert folders == {p.name for p in table.manifest().parts}
    table.publish(frame_of(spark, {"a": 9}), 5)
    assert content(table) == before | {"a": 9}


def test_the_stream_keeps_a_compacted_table(spark, tmp_path):
    log = sorted(random_log(11, 120, keys=12), key=lambda e: (e["received_at"], e["seq"]))
    managers, rules = config(spark)
    out = route_events(write_files(spark, log, f"{tmp_path}/in", 4), managers, rules)[0]
    places = f"{tmp_path}/alerts", f"{tmp_path}/notes", f"{tmp_path}/checkpoint"
    start_lifecycle(out, *places, managers, compact_every=2).awaitTermination()
    assert rows(alert_table(spark, places[0]).rows()) == rows(AlertRun(routed(spark, log)).alerts)

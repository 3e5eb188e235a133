"""The stream gives the batch result, whatever files the log comes in."""

import pytest
from helpers import EVENT, config, event, frame, random_log, routed
from pyspark.sql import functions as F

from tocsin.operators.routing import route_events
from tocsin.plans.run import AlertRun
from tocsin.sources.events import decode_log, parse_events, read_events, stamp_arrival
from tocsin.sources.log import write_log
from tocsin.streaming.pipeline import (
    live_parents,
    live_windows,
    read_alerts,
    read_state,
    release_tail,
    start_ingest,
    start_lifecycle,
    start_sequencer,
)


def write_files(spark, events, folder, files):
    """The events in their order, cut into `files` files, oldest file first."""
    size = -(-len(events) // files)
    for i in range(files):
        part = events[i * size : (i + 1) * size]
        frame(spark, part).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_stream_equals_batch(spark, tmp_path):
    log = sorted(random_log(7, 240, keys=25), key=lambda e: (e["received_at"], e["seq"]))
    run = AlertRun(routed(spark, log))
    managers, rules = config(spark)
    for files in (1, 4):
        base = f"{tmp_path}/{files}"
        stream = write_files(spark, log, f"{base}/in", files)
        out = route_events(stream, managers, rules)[0]
        start_lifecycle(
            out, f"{base}/alerts", f"{base}/notes", f"{base}/checkpoint", managers
        ).awaitTermination()
        assert rows(read_alerts(spark, f"{base}/alerts")) == rows(run.alerts)
        notes = spark.read.parquet(f"{base}/notes").drop("batch")
        assert rows(notes) == rows(run.notifications(managers).select(*notes.columns))


def test_sequencer_orders_late_events(spark, tmp_path):
    log = random_log(8, 60, keys=8)  # shuffled: files are out of order
    closing = event(1000, 1e5, "zz", manager="em-2")  # moves the watermark past the rest
    managers, rules = config(spark)
    stream = write_files(spark, [*log, closing], f"{tmp_path}/in", 2)
    out = route_events(stream, managers, rules)[0]
    # the delay covers the whole log, so no event is too late
    start_sequencer(out, "1 day", f"{tmp_path}/log", f"{tmp_path}/c1").awaitTermination()
    held = spark.read.parquet(f"{tmp_path}/log").drop("batch")
    assert held.count() == routed(spark, log).count()
    assert spark.read.parquet(f"{tmp_path}/log-late").count() == 0
    ordered = spark.readStream.schema(held.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/log")
    start_lifecycle(
        ordered, f"{tmp_path}/alerts", f"{tmp_path}/notes", f"{tmp_path}/c2", managers
    ).awaitTermination()
    run = AlertRun(routed(spark, log))
    assert rows(read_alerts(spark, f"{tmp_path}/alerts")) == rows(run.alerts)


def test_what_a_sequencer_holds_is_released_at_the_end(spark, tmp_path):
    log = random_log(9, 40, keys=6)
    managers, rules = config(spark)
    out = route_events(write_files(spark, log, f"{tmp_path}/in", 2), managers, rules)[0]
    start_sequencer(out, "1 day", f"{tmp_path}/log", f"{tmp_path}/c").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/log").count() == 0  # the watermark is behind all events
    for _ in range(2):  # repeated, it overwrites its own folder
        release_tail(spark, f"{tmp_path}/c", f"{tmp_path}/log")
        held = spark.read.parquet(f"{tmp_path}/log").drop("batch")
        whole = routed(spark, log).select(*held.columns)
        assert rows(held) == rows(whole)


def test_events_behind_the_watermark_are_kept_apart(spark, tmp_path):
    log = [event(i, i, f"k{i}") for i in range(5)]
    newer = [event(10, 300, "new")]
    late = [event(20, 110, "late"), event(21, 301, "fine")]
    managers, rules = config(spark)
    stream = write_files(spark, [*log, *newer, *late, event(30, 1e5, "zz")], f"{tmp_path}/in", 9)
    out = route_events(stream, managers, rules)[0]
    start_sequencer(out, "1 minute", f"{tmp_path}/log", f"{tmp_path}/c").awaitTermination()
    kept = {r.dedup_key for r in spark.read.parquet(f"{tmp_path}/log").collect()}
    aside = {r.dedup_key: r.late_by for r in spark.read.parquet(f"{tmp_path}/log-late").collect()}
    assert kept == {"new", "fine", *(f"k{i}" for i in range(5))}
    assert aside == {"late": 189 * 60_000_000}


def test_a_place_may_repeat_within_a_key(spark, tmp_path):
    # offsets of another partition: the sequence number of a birth comes again
    log = [
        event(5, 0, "p"),
        event(7, 1, "c"),
        event(8, 2, "c", action="resolve"),
        event(7, 3, "c"),
        event(5, 4, "p", action="resolve"),
    ]
    run = AlertRun(routed(spark, log))
    managers, rules = config(spark)
    stream = write_files(spark, log, f"{tmp_path}/in", 1)
    out = route_events(stream, managers, rules)[0]
    start_lifecycle(out, f"{tmp_path}/alerts", f"{tmp_path}/notes", f"{tmp_path}/c", managers).awaitTermination()
    assert rows(read_alerts(spark, f"{tmp_path}/alerts")) == rows(run.alerts)
    assert spark.read.parquet(f"{tmp_path}/notes").count() == run.notifications(managers).count() == 1


def test_a_repeated_micro_batch_changes_nothing(spark, tmp_path):
    batch = frame(spark, [event(0, 0, "a")]).selectExpr("dedup_key", "summary")
    for _ in range(2):
        write_log(batch, f"{tmp_path}/log/batch=3")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 1


def test_kafka_messages_have_a_total_order(spark):
    t = frame(spark, [event(0, 0, "a")]).first()["received_at"]
    messages = [(0, 7, t), (1, 7, t), (0, 8, t)]
    got = stamp_arrival(spark.createDataFrame(messages, "partition int, offset long, timestamp timestamp")).collect()
    assert len({r.seq for r in got}) == 3 and got[0].seq < got[2].seq < got[1].seq


def test_ingest_log_round_trip(spark, tmp_path):
    log = [
        event(0, 0, "a"),
        event(1, 1, "b", manager="nobody"),
        event(2, 2, ""),
        event(3, 3, "c", micros=7),
    ]
    managers, rules = config(spark)
    stream = write_files(spark, log, f"{tmp_path}/in", 2)
    start_ingest(
        stream, (managers, rules), f"{tmp_path}/log", f"{tmp_path}/rejects", f"{tmp_path}/c"
    ).awaitTermination()
    messages = read_events(spark, f"{tmp_path}/log", "parquet")
    decoded, skipped = decode_log(messages)
    want = routed(spark, log)
    got = decoded.withColumn("received_at", F.col("received_at").cast("timestamp_ntz"))
    assert rows(got.select(*want.columns)) == rows(want)
    assert skipped.count() == 0
    reasons = {
        r.seq: (r.reject_reason, r.reject_code)
        for r in spark.read.parquet(f"{tmp_path}/rejects").collect()
    }
    assert reasons == {
        1: ("event_manager_not_found", "INTERNAL_ERROR"),
        2: ("empty_dedup_key", "VALIDATION_FAILED"),
    }


def test_malformed_bodies(spark):
    bodies = [
        (0, '{"event_manager_id":"em-1","summary":"s","severity":"low","action":"trigger",'
            '"class":"c","dedupKey":"k"}'),
        (1, '{"event_manager_id":"em-1"'),
        (2, "not json"),
        (3, '{"summary":"only"}'),
    ]
    raw = spark.createDataFrame(bodies, "seq long, value string")
    events, malformed = parse_events(raw)
    assert {r.seq: r.dedup_key for r in events.collect()} == {0: "k", 3: ""}
    assert {r.seq for r in malformed.collect()} == {1, 2}


def test_bodies_are_read_as_strictly_as_by_a_typed_decoder(spark):
    good = {
        1: '{"summary": "x", "DEDUPKEY": "k", "other": {"a": 1}}',
        2: ' {"summary": null, "dedupKey": "k"} ',
        3: '{"summary": "a", "SUMMARY": "x", "summary": null, "dedupKey": "k"}',
    }
    bad = {
        11: '{"summary": 5, "dedupKey": "k"}',
        12: '{"dedupKey": {"a": 1}}',
        13: '{"summary": "x"} trailing',
        14: '{"summary": "x"}{"summary": "y"}',
        15: '{"summary": "x"}, {"summary": "y"}',
        16: "{'summary': 'x'}",
        17: '["x"]',
        18: "5",
        19: "",
        20: None,
        21: '{"summary": 5, "summary": "x"}',
    }
    raw = spark.createDataFrame(list((good | bad).items()), "seq long, value string")
    events, malformed = parse_events(raw)
    got = {r.seq: (r.summary, r.dedup_key) for r in events.collect()}
    assert got == {1: ("x", "k"), 2: ("", "k"), 3: ("x", "k")}
    assert {r.seq for r in malformed.collect()} == set(bad)


def test_raw_ingest_keeps_what_does_not_parse(spark, tmp_path):
    body = '{"event_manager_id":"em-1","summary":"s","severity":"high","action":"trigger","class":"a","dedupKey":"k"}'
    at = event(0, 0, "a")["received_at"]
    rows_in = [(1, at, body), (2, at, body[:-1]), (3, at, body.replace("em-1", "nobody"))]
    raw = spark.createDataFrame(rows_in, "seq long, received_at timestamp_ntz, value string")
    raw.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/in")
    calls = []

    def load(session):
        calls.append(1)
        return config(session)

    start_ingest(stream, load, f"{tmp_path}/log", f"{tmp_path}/rejects", f"{tmp_path}/c").awaitTermination()
    refused = {r.seq: (r.reject_reason, r.value) for r in spark.read.parquet(f"{tmp_path}/rejects").collect()}
    assert refused == {2: ("malformed", body[:-1]), 3: ("event_manager_not_found", None)}
    decoded, skipped = decode_log(read_events(spark, f"{tmp_path}/log", "parquet"))
    assert [r.seq for r in decoded.collect()] == [1] and skipped.count() == 0 and calls


def test_live_state_equals_batch(spark, tmp_path):
    log = sorted(random_log(23, 200, keys=15), key=lambda e: (e["received_at"], e["seq"]))
    run = AlertRun(routed(spark, log))
    managers, rules = config(spark)
    out = route_events(write_files(spark, log, f"{tmp_path}/in", 3), managers, rules)[0]
    checkpoint = f"{tmp_path}/checkpoint"
    start_lifecycle(out, f"{tmp_path}/alerts", f"{tmp_path}/notes", checkpoint, managers).awaitTermination()

    names = ["parent_dedup_key", "status", "resolve_requested", "child_count", "requested_at", "remaining_children"]
    parents = live_parents(spark, checkpoint)
    assert rows(parents.select(*names)) == rows(run.parents.withColumnRenamed("dedup_key", "parent_dedup_key").select(*names))
    assert parents.filter("resolve_requested").count() == run.parents.filter("resolve_requested").count() > 0
    # the newest window of each group
    newest = F.max_by(F.struct("dedup_key", "expires_at"), F.struct("born_at", "born_seq")).alias("w")
    opened = run.links.filter("dedup_key = family").groupBy("event_manager_id", "grouping_key", "grouping_value")
    want = opened.agg(newest).select("event_manager_id", "grouping_key", "grouping_value", "w.*")
    assert rows(live_windows(spark, checkpoint)) == rows(want)
    with pytest.raises(ValueError):
        read_state(spark, checkpoint, "nothing")

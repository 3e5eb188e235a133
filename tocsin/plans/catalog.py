"""Registered queries: name -> function of (session, folder of tables)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.functions.events import alert_id
from tocsin.operators import births as birth_ops
from tocsin.operators import config_feed, lifecycle, reads, state, versions
from tocsin.operators.hot import Limits
from tocsin.operators.pages import RankedAlerts
from tocsin.operators.routing import reject_counts, route_events
from tocsin.plans.incremental import AlertStore
from tocsin.plans.oracle import AT, MANAGER_CHANGES_SQL, RULE_CHANGES_SQL
from tocsin.plans.run import AlertRun
from tocsin.schemas import EVENT_FIELDS
from tocsin.session import materialize, shared_folder
from tocsin.sources.config import load_config
from tocsin.sources.events import (
    ALERT_EVENTS_SQL,
    alert_events,
    decode_log,
    parse_events,
    read_events,
)
from tocsin.sources.log import to_log_messages, write_log
from tocsin.sources.sample_config import sample_config
from tocsin.streaming.pipeline import (
    alert_table,
    live_parents,
    live_windows,
    read_alerts,
    release_tail,
    start_decode,
    start_ingest,
    start_lifecycle,
    start_sequencer,
)

_RUNS: dict[tuple, AlertRun] = {}


def forget_runs() -> None:
    """Drop the shared runs, so the next query computes everything again."""
    _RUNS.clear()


def _routed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return route_events(alert_events(spark, sf_dir), *sample_config(spark))


# every key with a few rows counts as hot: the plans that 100 TB would run, on any size
SPLIT = Limits(hot_rows=4, slot_rows=3)


def _run(spark: SparkSession, sf_dir: str, until: str = "", limits: Limits = Limits()) -> AlertRun:
    """The run over a folder's events, shared by the queries of one session."""
    key = (spark.sparkContext.applicationId, sf_dir, until, limits)
    if key not in _RUNS:
        run = AlertRun(_routed(spark, sf_dir)[0], limits)
        _RUNS[key] = run.until(until) if until else run
    return _RUNS[key]


def _k() -> F.Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("int")


def _with_k(df: DataFrame, sf_dir: str) -> DataFrame:
    events = df.sparkSession.read.parquet(f"{sf_dir}/events.parquet")
    return df.join(events.select(F.col("event_id").alias("seq"), _k().alias("k")), "seq")


def _raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, received_at and JSON bodies: cut short, no JSON, a field missing, of another type, case or with more."""
    events = spark.sql(
        ALERT_EVENTS_SQL.replace("SELECT event_id", "SELECT k, event_id", 1).format(events="{events}"),
        events=spark.read.parquet(f"{sf_dir}/events.parquet"),
    ).withColumnRenamed("dedup_key", "dedupKey")
    body = F.to_json(F.struct(*EVENT_FIELDS))
    short = F.to_json(F.struct(*[f for f in EVENT_FIELDS if f != "class"]))
    named = lambda old, new: F.replace(F.col("body"), F.lit(f'"{old}":'), F.lit(f'"{new}":'))
    value = (
        F.when(F.col("k") == 7, F.expr("substring(body, 1, length(body) - 1)"))
        .when(F.col("k") == 11, "not json")
        .when(F.col("k") == 13, short)
        .when(F.col("k") == 14, F.concat(F.lit('{"summary":5,'), F.expr("substring(body, 2)")))
        .when(F.col("k") == 15, F.regexp_replace("body", '"class":"[^"]*"', '"class":{"a":1}'))
        .when(F.col("k") == 17, F.concat("body", F.lit(" trailing")))
        .when(F.col("k") == 18, named("dedupKey", "DEDUPKEY"))
        .when(F.col("k") == 19, F.regexp_replace("body", '"class":"[^"]*"', '"class":null'))
        .when(F.col("k") == 20, F.regexp_replace("body", '"class":"[^"]*"', '"class":7'))
        .otherwise(F.col("body"))
    )
    return events.withColumn("body", body).select("seq", "received_at", value.alias("value"))


def event_rejects(spark, sf_dir):
    return _routed(spark, sf_dir)[1]


def event_reject_counts(spark, sf_dir):
    return reject_counts(_routed(spark, sf_dir)[1])


def routed_events(spark, sf_dir):
    return _routed(spark, sf_dir)[0]


def partition_keys(spark, sf_dir):
    keys = ["event_manager_id", "grouping_value", "partition_key"]
    return _routed(spark, sf_dir)[0].groupBy(*keys).agg(F.count("*").alias("events"))


def malformed_json(spark, sf_dir):
    """Events as JSON bodies, some of which the decoder refuses."""
    parsed, malformed = parse_events(_raw_events(spark, sf_dir).drop("received_at"))
    return (
        parsed.select("seq", "event_manager_id", "dedup_key", "class")
        .unionByName(malformed.select("seq", "reject_reason"), allowMissingColumns=True)
    )


def log_messages(spark, sf_dir):
    messages = to_log_messages(_routed(spark, sf_dir)[0])
    body = F.from_json(F.col("value").cast("string"), "seq long, grouping_value string")
    header = F.map_from_entries(F.col("headers"))
    return messages.select(
        body["seq"].alias("seq"),
        F.col("key").cast("string").alias("message_key"),
        header["event_manager_id"].cast("string").alias("header_manager"),
        header["action"].cast("string").alias("header_action"),
        header["dedupKey"].cast("string").alias("header_dedup_key"),
        body["grouping_value"].alias("grouping_value"),
    )


def decoded_log(spark, sf_dir):
    """The log written and read back, with some messages broken on the way."""
    routed = _with_k(_routed(spark, sf_dir)[0], sf_dir)
    broken = routed.filter("k = 21")
    good = to_log_messages(routed.filter("k <> 21"))
    bad = to_log_messages(broken).withColumn("value", F.expr("substring(value, 3)"))
    folder = _stream_folder(spark, "log")
    write_log(good.unionByName(bad), folder)
    events, _ = decode_log(read_events(spark, folder, "parquet"))
    return events.withColumn("received_at", F.col("received_at").cast("timestamp_ntz"))


def births(spark, sf_dir):
    return _run(spark, sf_dir).births.drop("time_window_minutes", "rows", "last_at")


def duplicate_triggers(spark, sf_dir):
    outcomes = _run(spark, sf_dir).outcomes
    return outcomes.filter("outcome = 'duplicate'").select("seq", "received_at", "dedup_key")


def unknown_resolves(spark, sf_dir):
    run = _run(spark, sf_dir)
    return birth_ops.unknown_resolves(run.routed, run.births)


def grouped_alerts(spark, sf_dir):
    return _run(spark, sf_dir).grouped


def child_transitions(spark, sf_dir):
    return lifecycle.child_transitions(_run(spark, sf_dir).history)


def child_final_status(spark, sf_dir):
    return lifecycle.child_final(_run(spark, sf_dir).timeline)


def active_children_timeline(spark, sf_dir):
    return lifecycle.active_children_timeline(_run(spark, sf_dir).timeline)


def event_outcomes(spark, sf_dir):
    return _run(spark, sf_dir).outcomes


def event_outcome_counts(spark, sf_dir):
    outcomes = _run(spark, sf_dir).outcomes
    return outcomes.groupBy("outcome", "cascaded").agg(F.count("*").alias("events"))


def alerts_final(spark, sf_dir):
    return _run(spark, sf_dir).alerts


def active_child_count(spark, sf_dir):
    return state.active_child_counts(_run(spark, sf_dir).stored_alerts)


def child_count(spark, sf_dir):
    return state.child_counts(_run(spark, sf_dir).links)


def children_sets(spark, sf_dir):
    sets = state.children_sets(_run(spark, sf_dir).links)
    return sets.withColumn("children", F.concat_ws(",", "children"))


def children(spark, sf_dir):
    return state.children(_run(spark, sf_dir).links)


def children_set_sizes(spark, sf_dir):
    return state.children_set_sizes(_run(spark, sf_dir).links)


def pending_resolves(spark, sf_dir):
    return state.pending_resolves(_run(spark, sf_dir).parents)


def pending_resolves_asof(spark, sf_dir):
    return state.pending_resolves(_run(spark, sf_dir, AT).parents)


def open_parents(spark, sf_dir):
    return state.open_parents(_run(spark, sf_dir).links, AT)


def live_parent_probe(spark, sf_dir):
    run = _run(spark, sf_dir)
    group = ["event_manager_id", "grouping_key", "grouping_value"]
    return state.live_parent(run.routed.select("seq", "received_at", *group), run.links)


def grouped_alerts_split(spark, sf_dir):
    return _run(spark, sf_dir, limits=SPLIT).grouped


def event_outcomes_split(spark, sf_dir):
    return _run(spark, sf_dir, limits=SPLIT).outcomes


def alerts_final_split(spark, sf_dir):
    return _run(spark, sf_dir, limits=SPLIT).alerts


def live_parent_probe_split(spark, sf_dir):
    run = _run(spark, sf_dir, limits=SPLIT)
    group = ["event_manager_id", "grouping_key", "grouping_value"]
    return state.live_parent(run.routed.select("seq", "received_at", *group), run.links, SPLIT)


def alert_state_asof(spark, sf_dir):
    return state.alert_state(_run(spark, sf_dir, AT).alerts)


def alert_versions(spark, sf_dir):
    return _run(spark, sf_dir).versions


def alert_versions_split(spark, sf_dir):
    return _run(spark, sf_dir, limits=SPLIT).versions


def alert_state_at(spark, sf_dir):
    """As alert_state_asof, from the interval history instead of a run that ends there."""
    return versions.state_at(_run(spark, sf_dir).versions, AT)


def _probes(spark, sf_dir):
    """Every event's alert six hours after the event, refused events among them."""
    later = F.col("received_at") + F.expr("INTERVAL 6 HOURS")
    return alert_events(spark, sf_dir).select("seq", "dedup_key", later.alias("received_at"))


def alert_state_probes(spark, sf_dir):
    return versions.state_probes(_probes(spark, sf_dir), _run(spark, sf_dir).versions)


def alert_state_probes_split(spark, sf_dir):
    return versions.state_probes(_probes(spark, sf_dir), _run(spark, sf_dir).versions, SPLIT)


def notifications(spark, sf_dir):
    return _run(spark, sf_dir).notifications(sample_config(spark)[0])


def list_alerts_active(spark, sf_dir):
    return reads.list_alerts(_run(spark, sf_dir).stored_alerts, status="active")


def list_alerts_manager_parents(spark, sf_dir):
    alerts = _run(spark, sf_dir).stored_alerts
    return reads.list_alerts(alerts, "em-1", "resolved", "parent", limit="-1", offset="x")


def list_alerts_unknown_status(spark, sf_dir):
    return reads.list_alerts(_run(spark, sf_dir).stored_alerts, status="open")


def alerts_page(spark, sf_dir):
    return reads.list_alerts(_run(spark, sf_dir).stored_alerts, limit=25, offset=50)


def _ranked(spark, sf_dir):
    return RankedAlerts.write(_run(spark, sf_dir).stored_alerts, _stream_folder(spark, "ranked"), range_rows=50)


def alerts_deep_page(spark, sf_dir):
    return _ranked(spark, sf_dir).page(limit=70, offset=333)


def alerts_deep_page_filtered(spark, sf_dir):
    return _ranked(spark, sf_dir).page(status="resolved", type="child", limit=70, offset="90")


def _asked(spark, sf_dir):
    """Dedup keys to look up: all that events name, and some that no alert has."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    other = F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit(":0"))
    return (
        alert_events(spark, sf_dir)
        .select("dedup_key")
        .unionByName(customers.select(other.alias("dedup_key")))
    )


_LOOKUP = ["requested", "dedup_key", "type", "status", "child_count", "created_at", "found"]


def alerts_by_key(spark, sf_dir):
    found = reads.alerts_by_key(_run(spark, sf_dir).stored_alerts, _asked(spark, sf_dir))
    return found.select(*_LOOKUP)


def alerts_by_id(spark, sf_dir):
    ids = _asked(spark, sf_dir).select(alert_id(F.col("dedup_key")).alias("id"))
    return reads.alerts_by_id(_run(spark, sf_dir).stored_alerts, ids).select(*_LOOKUP)


def children_of(spark, sf_dir):
    return reads.children_of(_run(spark, sf_dir).stored_alerts, _asked(spark, sf_dir))[0]


def children_of_errors(spark, sf_dir):
    return reads.children_of(_run(spark, sf_dir).stored_alerts, _asked(spark, sf_dir))[1]


def _changes(spark, sf_dir, sql):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(sql.format(events="{events}"), events=events)


def _rules(spark, sf_dir):
    return config_feed.apply_rule_changes(_changes(spark, sf_dir, RULE_CHANGES_SQL))


def _managers(spark, sf_dir):
    return config_feed.apply_manager_changes(_changes(spark, sf_dir, MANAGER_CHANGES_SQL))


def config_rules(spark, sf_dir):
    return reads.list_config(_rules(spark, sf_dir)[0])


def config_rule_history(spark, sf_dir):
    return _rules(spark, sf_dir)[1]


def config_rule_rejects(spark, sf_dir):
    return _rules(spark, sf_dir)[2]


def config_managers(spark, sf_dir):
    return reads.list_config(_managers(spark, sf_dir)[0])


def config_manager_history(spark, sf_dir):
    return _managers(spark, sf_dir)[1]


def config_manager_rejects(spark, sf_dir):
    return _managers(spark, sf_dir)[2]


def rules_by_id(spark, sf_dir):
    """Every rule there has been, deleted ones among them, and ids that no rule has."""
    current, history, _ = _rules(spark, sf_dir)
    other = alert_events(spark, sf_dir).select(F.concat(F.lit("rule-"), "class").alias("id"))
    found = reads.config_by_id(current, history.select("id").unionByName(other))
    return found.select("requested", "found", "name", "grouping_key")


def config_by_id(spark, sf_dir):
    ids = alert_events(spark, sf_dir).select(F.col("event_manager_id").alias("id"))
    found = reads.config_by_id(_managers(spark, sf_dir)[0], ids)
    return found.select("requested", "found", "name", "grouping_rule_id")


def _routed_asof(spark, sf_dir):
    return config_feed.route_events_asof(
        alert_events(spark, sf_dir), _managers(spark, sf_dir)[1], _rules(spark, sf_dir)[1]
    )


def routed_asof(spark, sf_dir):
    return _routed_asof(spark, sf_dir)[0]


def rejects_asof(spark, sf_dir):
    return _routed_asof(spark, sf_dir)[1].select("seq", "reject_reason")


def alerts_asof_config(spark, sf_dir):
    """Alerts when rules and managers change while events come in."""
    return AlertRun(materialize(_routed_asof(spark, sf_dir)[0], "routed")).alerts


SLICES = 5


def _sliced(df):
    """`df`, stored, with the number of its slice: SLICES slices of equal time, rows without a time in the first."""
    first, last = df.agg(F.min("received_at"), F.max("received_at")).first()
    since = F.timestamp_diff("MICROSECOND", F.lit(first), F.col("received_at"))
    whole = F.timestamp_diff("MICROSECOND", F.lit(first), F.lit(last)) + 1
    return materialize(df.withColumn("slice", F.coalesce(F.floor(since * SLICES / whole), F.lit(0)).cast("int")), "sliced")


def _slices(df):
    """The slices of `df` in order."""
    numbered = _sliced(df)
    return [numbered.where(F.col("slice") == i).drop("slice") for i in range(SLICES)]


def alerts_incremental(spark, sf_dir):
    """The alerts table, folded from one slice of the log after the other."""
    store = AlertStore.create(spark, _stream_folder(spark, "store"))
    for number, routed in enumerate(_slices(_routed(spark, sf_dir)[0])):
        store.fold(f"slice-{number}", routed)
    return store.alerts()


def alerts_compacted(spark, sf_dir):
    """As alerts_incremental, with a compaction after every second slice and each slice folded twice."""
    store = AlertStore.create(spark, _stream_folder(spark, "store"))
    for number, routed in enumerate(_slices(_routed(spark, sf_dir)[0])):
        store.fold(f"slice-{number}", routed)
        if number % 2:
            store.compact()
        store.fold(f"slice-{number}", routed)
    return store.alerts()


def _stream_folder(spark, name):
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


FILES = 4


def _in_files(spark, slices):
    """A stream of the slices in turn, one micro-batch each, of FILES files or of one if a slice has few rows."""
    folder = _stream_folder(spark, "arrivals")
    counts = [part.count() for part in slices]
    files = FILES if min(counts) >= 100 * FILES else 1  # so that no file is missing because it has no row
    for part in slices:
        part.repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(slices[0].schema).option("maxFilesPerTrigger", files).parquet(folder)


def _stored_config(spark):
    """The sample config written to files; gives a function that loads them."""
    folder = _stream_folder(spark, "config")
    managers, rules = sample_config(spark)
    managers.write.parquet(f"{folder}/managers")
    rules.write.parquet(f"{folder}/rules")
    return lambda session: load_config(session, f"{folder}/managers", f"{folder}/rules")


def _ingested(spark, events):
    folder, config = _stream_folder(spark, "ingest"), _stored_config(spark)
    log, rejects = f"{folder}/log", f"{folder}/rejects"
    stream = _in_files(spark, _slices(events))
    start_ingest(stream, config, log, rejects, f"{folder}/checkpoint").awaitTermination()
    return log, rejects


def stream_ingest(spark, sf_dir):
    """Events streamed through ingest into the log, and the log decoded again."""
    log, _ = _ingested(spark, alert_events(spark, sf_dir))
    decoded, _ = decode_log(read_events(spark, log, "parquet").drop("batch"))
    return decoded.withColumn("received_at", F.col("received_at").cast("timestamp_ntz"))


def stream_raw_ingest(spark, sf_dir):
    """JSON bodies streamed through ingest into the log, and the log decoded by another stream."""
    log, _ = _ingested(spark, _raw_events(spark, sf_dir))
    folder = _stream_folder(spark, "decoded")
    messages = spark.readStream.schema("key binary, value binary, headers array<struct<key:string,value:binary>>")
    messages = messages.option("recursiveFileLookup", "true").parquet(log)
    start_decode(messages, f"{folder}/events", f"{folder}/skipped", f"{folder}/checkpoint").awaitTermination()
    decoded = spark.read.parquet(f"{folder}/events").drop("batch")
    return decoded.withColumn("received_at", F.col("received_at").cast("timestamp_ntz")).select(
        "seq", "received_at", "dedup_key", "class", "partition_key"
    )


def stream_malformed(spark, sf_dir):
    """What ingest puts aside of JSON bodies: refused events and bodies that don't parse."""
    _, rejects = _ingested(spark, _raw_events(spark, sf_dir))
    return spark.read.parquet(rejects).select("seq", "reject_reason")


def _lifecycle(spark, sf_dir, **options):
    folder = _stream_folder(spark, "stream")
    managers, rules = sample_config(spark)
    alerts, notes = f"{folder}/alerts", f"{folder}/notifications"
    routed, _ = route_events(_in_files(spark, _slices(alert_events(spark, sf_dir))), managers, rules)
    checkpoint = f"{folder}/checkpoint"
    start_lifecycle(routed, alerts, notes, checkpoint, managers, **options).awaitTermination()
    return alerts, notes, checkpoint


def stream_alerts(spark, sf_dir):
    """The alerts table kept by the stateful stream."""
    return read_alerts(spark, _lifecycle(spark, sf_dir)[0])


def stream_alerts_compacted(spark, sf_dir):
    """The alerts table kept by the stream as merged parts, compacted after every second micro-batch."""
    return alert_table(spark, _lifecycle(spark, sf_dir, compact_every=2)[0]).rows()


def stream_notifications(spark, sf_dir):
    """The notification log of the stateful stream."""
    return spark.read.parquet(_lifecycle(spark, sf_dir)[1]).drop("batch")


def stream_open_parents(spark, sf_dir):
    """Windows still open at the last event, read from the stream's state."""
    windows = live_windows(spark, _lifecycle(spark, sf_dir)[2])
    newest = _routed(spark, sf_dir)[0].agg(F.max("received_at").alias("newest"))
    return windows.join(newest, F.col("expires_at") >= F.col("newest")).drop("newest")


def stream_parent_states(spark, sf_dir):
    """Every parent with its status and counts, read from the stream's state."""
    return live_parents(spark, _lifecycle(spark, sf_dir)[2]).drop("requested_at", "remaining_children")


def stream_pending(spark, sf_dir):
    """Parents that wait for their children, read from the stream's state."""
    return state.pending_resolves(live_parents(spark, _lifecycle(spark, sf_dir)[2]).withColumnRenamed("parent_dedup_key", "dedup_key"))


def _disordered(routed):
    """The slices of a log as they arrive: every seventh event comes with the slice after its own."""
    numbered = _sliced(routed)
    arrival = F.least(F.col("slice") + (F.col("seq") % 7 == 3).cast("int"), F.lit(SLICES - 1))
    return [numbered.where(arrival == i).drop("slice") for i in range(SLICES)]


def stream_event_time(spark, sf_dir):
    """The alerts table of a log that comes out of order, by way of the sequencer: as if it had come in order."""
    folder = _stream_folder(spark, "event-time")
    routed = materialize(_routed(spark, sf_dir)[0], "routed")
    managers, _ = sample_config(spark)
    first, last = routed.agg(F.min("received_at"), F.max("received_at")).first()
    delay = "1 second" if first is None else f"{(last - first) // timedelta(milliseconds=1) // SLICES + 1} milliseconds"
    log, alerts, checkpoint = f"{folder}/log", f"{folder}/alerts", f"{folder}/sequencer"

    def lifecycle():
        ordered = spark.readStream.schema(routed.schema).option("recursiveFileLookup", "true").parquet(log)
        start_lifecycle(ordered, alerts, f"{folder}/notes", f"{folder}/lifecycle", managers).awaitTermination()

    start_sequencer(_in_files(spark, _disordered(routed)), delay, log, checkpoint).awaitTermination()
    lifecycle()
    release_tail(spark, checkpoint, log)
    lifecycle()
    return read_alerts(spark, alerts)


def stream_late(spark, sf_dir):
    """Events that come after the watermark, two days behind the newest event, has passed their bucket."""
    folder = _stream_folder(spark, "late")
    routed = _routed(spark, sf_dir)[0]
    late = f"{folder}/late"
    arrivals = _in_files(spark, _disordered(routed))
    start_sequencer(arrivals, "2 days", f"{folder}/log", f"{folder}/checkpoint", late).awaitTermination()
    return spark.read.parquet(late).select("seq", "dedup_key", "received_at", "late_by")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        event_rejects,
        event_reject_counts,
        routed_events,
        partition_keys,
        malformed_json,
        log_messages,
        decoded_log,
        births,
        duplicate_triggers,
        unknown_resolves,
        grouped_alerts,
        child_transitions,
        child_final_status,
        active_children_timeline,
        event_outcomes,
        event_outcome_counts,
        alerts_final,
        active_child_count,
        child_count,
        children_sets,
        children,
        children_set_sizes,
        pending_resolves,
        pending_resolves_asof,
        open_parents,
        live_parent_probe,
        grouped_alerts_split,
        event_outcomes_split,
        alerts_final_split,
        alerts_incremental,
        alerts_compacted,
        live_parent_probe_split,
        alert_state_asof,
        alert_state_at,
        alert_versions,
        alert_versions_split,
        alert_state_probes,
        alert_state_probes_split,
        notifications,
        list_alerts_active,
        list_alerts_manager_parents,
        list_alerts_unknown_status,
        alerts_page,
        alerts_deep_page,
        alerts_deep_page_filtered,
        alerts_by_key,
        alerts_by_id,
        children_of,
        children_of_errors,
        config_rules,
        config_rule_history,
        config_rule_rejects,
        config_managers,
        config_manager_history,
        config_manager_rejects,
        config_by_id,
        rules_by_id,
        routed_asof,
        rejects_asof,
        alerts_asof_config,
        stream_ingest,
        stream_raw_ingest,
        stream_malformed,
        stream_alerts,
        stream_alerts_compacted,
        stream_notifications,
        stream_open_parents,
        stream_parent_states,
        stream_pending,
        stream_event_time,
        stream_late,
    )
}

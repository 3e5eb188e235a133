"""The engine as Structured Streaming queries: ingest, sequencing, lifecycle, sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tocsin.functions.events import reject_code, reject_message
from tocsin.operators.notifications import notifications as notifications_of
from tocsin.operators.routing import EVENT_COLUMNS, route_events
from tocsin.plans.incremental import TABLES, alert_rows, fold
from tocsin.schemas import ALERT_COLUMNS
from tocsin.session import materialize, passing
from tocsin.sources.events import read_bodies, read_messages, split_bodies, split_messages
from tocsin.sources.log import to_log_messages, write_log
from tocsin.streaming.table import AlertTable

ROUTED_SCHEMA = (
    "dedup_key string, at long, seq long, action string, event_manager_id string, summary string, severity string, "
    "class string, grouping_key string, grouping_value string, window long, partition_key string"
)
MARK_SCHEMA = "batch long, watermark long"  # of a sequencer


LOG_COLUMNS = [*EVENT_COLUMNS, "grouping_key", "grouping_value", "time_window_minutes"]

Config = tuple[DataFrame, DataFrame]


def start_ingest(
    events: DataFrame,
    config: Config | Callable[[SparkSession], Config],
    log: str,
    rejects: str,
    checkpoint: str,
    fmt: str = "parquet",
    options: dict[str, str] | None = None,
    **trigger,
) -> StreamingQuery:
    """Validate, route and enrich a stream of events into the log; refused events go to `rejects`.

    `events` has event columns, or `value` with raw JSON beside `received_at` and `seq`: then bodies that
    don't parse go to `rejects` as well, with their text. `config` is (managers, rules), or a function that
    loads them; it is called for every micro-batch, so that changed tables are seen.

    Stateless: no shuffle but what a config table too large to broadcast needs. A file sink overwrites the
    folder of its micro-batch. With fmt='kafka' messages go to the topic `log` with `options` (its
    bootstrap servers at least); a micro-batch that is repeated after a failure is then sent again, and
    readers drop the copies by (received_at, seq).
    """
    raw = "value" in events.columns

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = (read_bodies(batch) if raw else batch).persist()
        managers, rules = config(batch.sparkSession) if callable(config) else config
        parsed, malformed = split_bodies(batch) if raw else (batch, None)
        routed, refused = route_events(parsed, managers, rules)
        if malformed is not None:
            reason = F.col("reject_reason")
            malformed = malformed.withColumn("reject_code", reject_code(reason))
            malformed = malformed.withColumn("reject_message", reject_message(reason))
            refused = refused.unionByName(malformed, allowMissingColumns=True)
        write_log(to_log_messages(routed), log if fmt == "kafka" else f"{log}/batch={batch_id}", fmt, **(options or {}))
        refused.write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        batch.unpersist()

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_decode(raw: DataFrame, events: str, skipped: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Decode a stream of log messages; those that don't decode are kept in `skipped`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = read_messages(batch).persist()
        decoded, broken = split_messages(batch)
        decoded.write.mode("overwrite").parquet(f"{events}/batch={batch_id}")
        broken.write.mode("overwrite").parquet(f"{skipped}/batch={batch_id}")
        batch.unpersist()

    return (
        raw.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def compact_rows(routed: DataFrame) -> DataFrame:
    """Routed events in the form the sequencer keeps."""
    at = F.unix_micros(F.col("received_at").cast("timestamp"))
    window = F.col("time_window_minutes").cast("long") * 60_000_000
    return routed.withColumn("at", at).withColumn("window", window)


def alert_table(spark: SparkSession, path: str) -> AlertTable:
    """The alerts table that a lifecycle stream with `compact_every` keeps under `path`."""
    empty = [spark.createDataFrame([], TABLES[name][1]) for name in ("alerts", "families")]
    return AlertTable(spark, path, alert_rows(*empty).schema)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The alerts table: the newest version of every alert."""
    newest = F.max_by(F.struct(*ALERT_COLUMNS), "batch")
    return spark.read.parquet(path).groupBy("dedup_key").agg(newest.alias("row")).select("row.*")


def _state(spark: SparkSession, checkpoint: str, name: str) -> AlertTable:
    """A table of what a lifecycle stream has come to, beside the query's checkpoint."""
    key, schema = TABLES[name]
    return AlertTable(spark, f"{checkpoint}/kept/{name}", schema, tuple(key))


def start_lifecycle(
    routed: DataFrame,
    alerts: str,
    notifications: str,
    checkpoint: str,
    managers: DataFrame,
    compact_every: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Keep the alerts table and the notification log up to date with a stream of routed events.

    Rows of one micro-batch are taken in log order, micro-batches as they come. `alerts` holds a folder for every
    micro-batch with the alerts it changes (`read_alerts`). With `compact_every` it is a table of merged parts
    instead (`alert_table`), compacted after every so many micro-batches.

    A micro-batch is folded onto the rows of alerts, families and groups that the ones before it left (`fold`): joins,
    aggregates and windows over all its keys at once, no state per key. These rows are tables beside the query's
    checkpoint, read as they were before the micro-batch, so one that is repeated gives the same and adds nothing.
    """
    spark = routed.sparkSession
    state = {name: _state(spark, checkpoint, name) for name in TABLES}

    def write(batch: DataFrame, batch_id: int) -> None:
        with passing(spark):
            # read by the session itself: the micro-batch's own has no adaptive execution
            arrived = materialize(batch, "arrived", spark)
            made, timeline = fold(arrived, {name: table.rows(batch_id) for name, table in state.items()})
            made = {name: materialize(df, name) for name, df in made.items()}
            changed = alert_rows(made["alerts"], made["families"])
            if compact_every is None:
                changed.write.mode("overwrite").parquet(f"{alerts}/batch={batch_id}")
            else:
                table = alert_table(spark, alerts)
                table.publish(changed, batch_id)
                if batch_id % compact_every == compact_every - 1:
                    table.compact()
                    table.expire()
            parents = made["families"].withColumnRenamed("family", "dedup_key")
            sent = notifications_of(timeline, parents, managers)
            sent.write.mode("overwrite").parquet(f"{notifications}/batch={batch_id}")
            for name, table in state.items():
                table.publish(made[name], batch_id)
                table.compact()
                table.expire()

    return (
        routed.select(*[c for c in LOG_COLUMNS if c != "received_at"], F.col("received_at").cast("timestamp_ntz"))
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """The rows of one of the TABLES of a lifecycle stream as of its last micro-batch, running or not."""
    if name not in TABLES:
        raise ValueError(f"no table {name} in {checkpoint}")
    return _state(spark, checkpoint, name).rows()


def live_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The window that was opened last in each group of a lifecycle stream: parent and end."""
    return read_state(spark, checkpoint, "groups").select(
        *TABLES["groups"][0], F.col("open_parent").alias("dedup_key"), F.col("open_until").alias("expires_at")
    )


def live_parents(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Every parent of a lifecycle stream: status, active children and children, and what it waits for."""
    return read_state(spark, checkpoint, "families").select(
        F.col("family").alias("parent_dedup_key"),
        F.when(F.col("state") == "resolved", "resolved").otherwise("active").alias("status"),
        (F.col("state") == "pending").alias("resolve_requested"),
        F.col("active").alias("active_children"),
        F.col("children").cast("int").alias("child_count"),
        "requested_at",
        F.col("remaining").alias("remaining_children"),
    )


def _held(checkpoint: str, batch_id: int) -> str:
    """Where a sequencer keeps what it holds after a micro-batch: two places in turn, so that a micro-batch that is
    repeated finds what was held before it."""
    return f"{checkpoint}/held/{batch_id % 2}"


def _mark(spark: SparkSession, checkpoint: str, batch_id: int) -> int:
    """The watermark, in milliseconds, after a micro-batch that is finished."""
    mark = spark.read.schema(MARK_SCHEMA).parquet(f"{_held(checkpoint, batch_id)}/mark").first()
    if mark is None or mark["batch"] != batch_id:
        raise ValueError(f"{checkpoint} does not hold micro-batch {batch_id}")
    return mark["watermark"]


def _log_rows(rows: DataFrame) -> DataFrame:
    """Rows of the stateful steps' form as the log has them."""
    return (
        rows.withColumn("received_at", F.timestamp_micros("at").cast("timestamp_ntz"))
        .withColumn("time_window_minutes", (F.col("window") / 60_000_000).cast("int"))
        .drop("at", "window")
    )


def start_sequencer(
    routed: DataFrame, delay: str, log: str, checkpoint: str, late: str | None = None, bucket_ms: int = 1000, **trigger
) -> StreamingQuery:
    """Event-time mode: pass a stream on in event-time order, `delay` behind its newest event.

    Each micro-batch of the output is later than those before it, so `start_lifecycle` over it (whole
    batches at a time) gives the batch result even if events come in late by up to `delay`. Events that
    are later still go to the folder `late` (by default `log` with "-late") with `late_by`, by how many
    microseconds the watermark had passed them (null if they have no time). Events are let go in buckets of
    `bucket_ms`, whole buckets at once. Those of the last `delay` are held until newer ones come; `release_tail`
    lets them out when a log has ended.

    Rows that wait are a table beside the query's checkpoint, which each micro-batch reads and writes anew with its
    own: all keys at once, no state per key or bucket. The watermark is written after them and names the micro-batch,
    so one that is cut off leaves what was held before it in place.
    """
    spark = routed.sparkSession
    rows = compact_rows(routed).select(*[c.split()[0] for c in ROUTED_SCHEMA.split(", ")])
    width = bucket_ms * 1000
    due = F.expr(f"(at - pmod(at, {width})) div 1000 + {bucket_ms}")  # the first millisecond after the row's bucket
    behind = spark.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL '{delay}') div 1000").first()[0]

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        batch = batch.persist()
        held, passed = session.createDataFrame([], ROUTED_SCHEMA), 0
        if batch_id > 0:
            passed = _mark(session, checkpoint, batch_id - 1)
            held = session.read.schema(ROUTED_SCHEMA).parquet(f"{_held(checkpoint, batch_id - 1)}/rows")
        newest = batch.agg(F.max(F.expr("(at - pmod(at, 1000)) div 1000"))).first()[0]
        watermark = passed if newest is None else max(passed, newest - behind)
        too_late = F.coalesce(due <= passed, F.lit(True))
        late_by = F.when(F.col("at").isNotNull(), F.greatest(F.lit(passed * 1000) - F.col("at"), F.lit(0))).cast("long")
        aside = _log_rows(batch.filter(too_late).withColumn("late_by", late_by))
        aside.write.mode("overwrite").parquet(f"{late or log + '-late'}/batch={batch_id}")
        waiting = held.unionByName(batch.filter(~too_late))
        _log_rows(waiting.filter(due <= watermark)).write.mode("overwrite").parquet(f"{log}/batch={batch_id}")
        here = _held(checkpoint, batch_id)
        waiting.filter(due > watermark).write.mode("overwrite").parquet(f"{here}/rows")
        mark = session.range(1).select(F.lit(batch_id).cast("long").alias("batch"), F.lit(watermark).cast("long").alias("watermark"))
        mark.write.mode("overwrite").parquet(f"{here}/mark")
        batch.unpersist()

    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def release_tail(spark: SparkSession, checkpoint: str, log: str) -> None:
    """Write the events that a stopped sequencer still holds as the last folder of its log.

    Reads what the sequencer keeps beside its checkpoint. The folder is overwritten if this is repeated.
    """
    last = spark.read.schema(MARK_SCHEMA).parquet(f"{checkpoint}/held/*/mark").agg(F.max("batch")).first()[0]
    rows = spark.read.schema(ROUTED_SCHEMA).parquet(f"{_held(checkpoint, last)}/rows")
    _log_rows(rows).write.mode("overwrite").parquet(f"{log}/batch={2**31 - 1}")

"""Reading events: raw JSON, the enriched log, and the sample `events` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tocsin.functions.events import MALFORMED, text
from tocsin.schemas import EVENT_JSON, LOG_JSON

# Runs unchanged in Spark SQL and DuckDB, see FIXTURES.md section 3.
ALERT_EVENTS_SQL = """
SELECT event_id AS seq, ts AS received_at,
  CASE WHEN k = 96 THEN '' ELSE 'em-' || CAST(user_id % 7 AS VARCHAR(10)) END AS event_manager_id,
  CASE WHEN k = 95 THEN '' ELSE event_type || ' from user ' || CAST(user_id AS VARCHAR(20)) END AS summary,
  CASE WHEN k = 99 THEN 'critical' WHEN value >= 70 THEN 'high'
       WHEN value >= 35 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN k = 98 THEN 'ack' WHEN event_type IN ('purchase','signup') THEN 'resolve' ELSE 'trigger' END AS action,
  'c' || CAST(k % 4 AS VARCHAR(2)) AS class,
  CASE WHEN k = 97 THEN '' ELSE 'u' || CAST(user_id AS VARCHAR(20)) || ':' || CAST(k % 4 AS VARCHAR(2)) END AS dedup_key
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) e
"""


def alert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample `events` table seen as alert events."""
    return spark.sql(
        ALERT_EVENTS_SQL.format(events="{events}"),
        events=spark.read.parquet(f"{sf_dir}/events.parquet"),
    )


def read_events(
    spark: SparkSession, path: str, fmt: str = "text", stream: bool = False, **options: str
) -> DataFrame:
    """Raw records with a string column `value` from files, Kafka or any other source."""
    reader = spark.readStream if stream else spark.read
    df = reader.format(fmt).options(**options)
    df = df.load(path) if path else df.load()
    return df.withColumn("value", F.col("value").cast("string"))


def stamp_arrival(messages: DataFrame) -> DataFrame:
    """Kafka messages with `received_at` and `seq`: the broker's time, then partition and offset.

    (received_at, seq) is a total order: an offset occurs once in a partition.
    """
    place = F.shiftleft(F.col("partition").cast("long"), 48).bitwiseOR(F.col("offset").cast("long"))
    return messages.withColumn("received_at", F.col("timestamp").cast("timestamp_ntz")).withColumn("seq", place)


def _parsed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Add `body`, the fields of `schema`, and `sound`: whether the record is one object that fits.

    As in the original decoder, a text field must be a string or null, names match without regard to case,
    the last of several strings wins, and nothing may follow the object. Other fields (times and numbers, which
    this engine writes itself) are read by their exact names.
    """
    value = F.col("value").cast("string")
    strict = {"allowSingleQuotes": "false"}
    entries = F.map_entries(F.from_json(value, "map<string,variant>", strict))
    texts = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]

    def named(name: str) -> F.Column:
        return F.filter("entries", lambda e: F.lower(e["key"]) == name.lower())

    def field(name: str) -> F.Column:
        strings = F.filter(named(name), lambda e: F.schema_of_variant(e["value"]) == "STRING")
        return F.get(F.reverse(strings), F.lit(0))["value"]

    # one look at the entries: a filter on `sound` repeats all that it is made of
    other = lambda e: ~F.lower(e["key"]).isin(*[name.lower() for name in texts])
    fits = F.forall("entries", lambda e: other(e) | F.schema_of_variant(e["value"]).isin("STRING", "VOID"))
    others = [F.col(f"typed.{f.name}").alias(f.name) for f in schema.fields if f.name not in texts]
    columns = [F.try_variant_get(field(name), "$", "string").alias(name) for name in texts]
    one = F.json_array_length(F.concat(F.lit("["), value, F.lit("]"))) == 1
    return (
        raw.withColumn("entries", entries)
        .withColumn("typed", F.from_json(value, schema, strict))
        .withColumn("sound", F.coalesce(one & fits, F.lit(False)))
        .withColumn("body", F.struct(*columns, *others))
        .drop("entries", "typed")
    )


def read_bodies(raw: DataFrame) -> DataFrame:
    """Raw JSON bodies with `body` and `sound`, for `split_bodies`; persisted, each is parsed once for both sides."""
    return _parsed(raw, EVENT_JSON)


def parse_events(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw JSON bodies to (events, malformed bodies). Other columns pass through."""
    return split_bodies(read_bodies(raw))


def split_bodies(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, malformed bodies) of `read_bodies`."""
    keep = [c for c in parsed.columns if c not in ("value", "sound", "body")]
    fields = [text(f"body.{f.name}").alias(f.name) for f in EVENT_JSON.fields]
    events = (
        parsed.filter("sound")
        .select(*keep, *fields)
        .withColumnRenamed("dedupKey", "dedup_key")
    )
    malformed = parsed.filter("NOT sound").select(
        *keep, "value", F.lit(MALFORMED).alias("reject_reason")
    )
    return events, malformed


def read_messages(raw: DataFrame) -> DataFrame:
    """Messages of the enriched log with `body` and `sound`, for `split_messages`; worth persisting, as `read_bodies`."""
    return _parsed(raw, LOG_JSON)


def decode_log(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages of the enriched log to (routed events, skipped messages)."""
    return split_messages(read_messages(raw))


def split_messages(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(routed events, skipped messages) of `read_messages`."""
    # a record without its log position cannot be ordered
    broken = ~F.col("sound") | F.col("body.received_at").isNull() | F.col("body.seq").isNull()
    texts = [
        text(f"body.{f.name}").alias(f.name)
        for f in LOG_JSON.fields
        if isinstance(f.dataType, T.StringType)
    ]
    others = [
        F.col(f"body.{f.name}").alias(f.name)
        for f in LOG_JSON.fields
        if not isinstance(f.dataType, T.StringType)
    ]
    events = (
        parsed.filter(~broken).select(*texts, *others).withColumnRenamed("dedupKey", "dedup_key")
    )
    skipped = parsed.filter(broken).select("value", F.lit(MALFORMED).alias("reject_reason"))
    return events, skipped

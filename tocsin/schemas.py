"""Fixed schemas of the records the engine reads and writes."""

from pyspark.sql import types as T

EVENT_FIELDS = ["event_manager_id", "summary", "severity", "action", "class", "dedupKey"]

EVENT_JSON = T.StructType([T.StructField(name, T.StringType()) for name in EVENT_FIELDS])

# one record of the enriched log, as JSON in the message value
LOG_JSON = T.StructType(
    EVENT_JSON.fields
    + [
        T.StructField("partition_key", T.StringType()),
        T.StructField("grouping_value", T.StringType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("grouping_key", T.StringType()),
        T.StructField("time_window_minutes", T.IntegerType()),
    ]
)

RULE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("grouping_key", T.StringType()),
        T.StructField("time_window_minutes", T.IntegerType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)

MANAGER = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("grouping_rule_id", T.StringType()),
        T.StructField(
            "notification_config", T.StructType([T.StructField("webhook_url", T.StringType())])
        ),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)

ALERT_COLUMNS = [
    "id",
    "dedup_key",
    "event_manager_id",
    "summary",
    "severity",
    "class",
    "type",
    "status",
    "parent_dedup_key",
    "child_count",
    "resolve_requested",
    "created_at",
    "updated_at",
    "resolved_at",
]

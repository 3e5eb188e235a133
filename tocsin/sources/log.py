"""The enriched event log as key/value messages, and its sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.schemas import LOG_JSON

# the default format of to_json stops at milliseconds
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def to_log_messages(routed: DataFrame) -> DataFrame:
    """(key, value, headers): the columns a Kafka sink takes."""
    body = routed.withColumnRenamed("dedup_key", "dedupKey").withColumn(
        "received_at", F.col("received_at").cast("timestamp")
    )
    names = ("event_manager_id", "action", "dedupKey")
    header = [
        F.struct(F.lit(n).alias("key"), F.col(n).cast("binary").alias("value")) for n in names
    ]
    return body.select(
        F.col("partition_key").cast("binary").alias("key"),
        F.to_json(F.struct(*LOG_JSON.names), {"timestampFormat": TIME_FORMAT})
        .cast("binary")
        .alias("value"),
        F.array(*header).alias("headers"),
    )


def write_log(messages: DataFrame, target: str, fmt: str = "parquet", **options: str) -> None:
    """Write messages: a folder of files, which is replaced, or a topic with fmt='kafka', which grows."""
    writer = messages.write.format(fmt).options(**options)
    if fmt == "kafka":
        writer.option("topic", target).save()
    else:
        writer.mode("overwrite").save(target)

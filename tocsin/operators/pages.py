"""Deep pages of the alerts listing from a rank index.

The table is stored once in ranges of its order (newest first), and an index counts the rows of each range by
manager, status and type. A page at any offset, with any filters, sums the index to find its ranges and opens
those only, where OFFSET alone would sort everything before the page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tocsin.operators.reads import page_bounds
from tocsin.schemas import ALERT_COLUMNS

RANGE_ROWS = 100_000
RUN_ROWS = 10_000
FILTERS = ("event_manager_id", "status", "type")
NEWEST_FIRST = (F.desc, "created_at"), (F.asc, "dedup_key")


def _order() -> list:
    return [towards(name) for towards, name in NEWEST_FIRST]


class RankedAlerts:
    """Alerts in ranges of their listing order, with counts per range, under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        # kept apart, since a table without rows has no file that tells its columns
        columns = spark.read.parquet(f"{folder}/columns").schema
        self.alerts = spark.read.schema(columns).parquet(f"{folder}/alerts")
        self.counts = spark.read.parquet(f"{folder}/counts")

    @classmethod
    def write(cls, alerts: DataFrame, folder: str, range_rows: int = RANGE_ROWS) -> RankedAlerts:
        """Store `alerts` in ranges of about `range_rows` rows; the folder must be new.

        Runs of ranges come from a sample of the order, so they differ in size; counts are exact.
        """
        spark = alerts.sparkSession
        rows = alerts.count()
        ranges = max(1, -(-rows // range_rows))
        # a task writes a run of ranges, so that small ranges don't make a task each
        runs = min(ranges, -(-rows // RUN_ROWS))
        ordered = alerts.select(*ALERT_COLUMNS).repartitionByRange(max(1, runs), *_order())
        ordered = ordered.withColumn("run", F.spark_partition_id())
        place = F.row_number().over(Window.partitionBy("run").orderBy(*_order())) - 1
        within = F.floor(place / range_rows).cast("long")
        numbered = ordered.withColumn("range", F.shiftleft(F.col("run").cast("long"), 32) + within).drop("run")
        numbered.write.partitionBy("range").parquet(f"{folder}/alerts")
        spark.createDataFrame([], numbered.schema).write.parquet(f"{folder}/columns")
        stored = spark.read.schema(numbered.schema).parquet(f"{folder}/alerts")
        counts = stored.groupBy("range", *FILTERS).agg(F.count("*").alias("rows"))
        counts.write.parquet(f"{folder}/counts")
        return cls(spark, folder)

    def page(
        self,
        event_manager_id: str = "",
        status: str = "",
        type: str = "",
        limit: str | int | None = None,
        offset: str | int | None = None,
    ) -> DataFrame:
        """As `reads.list_alerts`, at any offset. The counts are one row per range here, whatever the table holds."""
        skipped, wanted = page_bounds(limit, offset)
        asked = dict(zip(FILTERS, (event_manager_id, status, type), strict=True))
        alerts, counts = self.alerts, self.counts
        for name, value in asked.items():
            if value:
                alerts, counts = alerts.filter(F.col(name) == value), counts.filter(F.col(name) == value)
        upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = counts.groupBy("range").agg(F.sum("rows").alias("rows")).withColumn("upto", F.sum("rows").over(upto))
        ranked = ranked.withColumn("before", F.col("upto") - F.col("rows"))
        overlaps = (F.col("upto") > skipped) & (F.col("before") < min(skipped + wanted, 2**63 - 1))
        first = ranked.filter(overlaps).agg(
            F.min("range").alias("low"), F.max("range").alias("high"), F.min("before").alias("before")
        ).first()
        page = alerts.select(*ALERT_COLUMNS)
        if first["low"] is None:
            return page.limit(0)
        # a filter on the partition column: only these ranges' files are opened
        page = alerts.filter(F.col("range").between(first["low"], first["high"])).select(*ALERT_COLUMNS)
        page = page.orderBy(*_order()).offset(skipped - first["before"])
        return page.limit(wanted) if wanted < 2**31 else page

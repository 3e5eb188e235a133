"""Rule and manager tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tocsin.schemas import MANAGER, RULE


def load_config(
    spark: SparkSession, managers: str, rules: str, fmt: str = "parquet", **options: str
) -> tuple[DataFrame, DataFrame]:
    """(managers, rules) from files, or from any source Spark has a reader for."""

    def load(schema, location):
        reader = spark.read.format(fmt).options(**options)
        if fmt == "jdbc":
            return reader.option("dbtable", location).load()
        return reader.schema(schema).load(location)

    return load(MANAGER, managers), load(RULE, rules)

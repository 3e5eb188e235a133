"""The rules and managers that go with the sample events (FIXTURES.md section 3)."""

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the fixture. Runs unchanged in Spark SQL and DuckDB.
RULES_SQL = """
SELECT id, name, grouping_key, time_window_minutes,
  CAST(created AS TIMESTAMP{ntz}) AS created_at, CAST(created AS TIMESTAMP{ntz}) AS updated_at
FROM (VALUES
  ('rule-0', 'by class', 'class', 720, '2023-12-01 00:00:00'),
  ('rule-1', 'by severity', 'severity', 360, '2023-12-02 00:00:00'),
  ('rule-2', 'by manager', 'event_manager_id', 60, '2023-12-03 00:00:00'),
  ('rule-3', 'by region', 'region', 1440, '2023-12-03 00:00:00')
) AS r(id, name, grouping_key, time_window_minutes, created)
"""
MANAGERS_SQL = """
SELECT id, name, description, grouping_rule_id, webhook_url,
  CAST(created AS TIMESTAMP{ntz}) AS created_at, CAST(created AS TIMESTAMP{ntz}) AS updated_at
FROM (VALUES
  ('em-0', 'team 0', 'first team', 'rule-0', 'https://hooks.example/0', '2023-12-05 00:00:00'),
  ('em-1', 'team 1', '', 'rule-1', 'https://hooks.example/1', '2023-12-06 00:00:00'),
  ('em-2', 'team 2', '', 'rule-2', '', '2023-12-07 00:00:00'),
  ('em-3', 'team 3', '', 'rule-3', 'https://hooks.example/3', '2023-12-07 00:00:00'),
  ('em-4', 'team 4', '', 'rule-0', 'https://hooks.example/4', '2023-12-08 00:00:00'),
  ('em-5', 'team 5', '', 'rule-missing', 'https://hooks.example/5', '2023-12-09 00:00:00')
) AS m(id, name, description, grouping_rule_id, webhook_url, created)
"""


def sample_config(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    managers = spark.sql(MANAGERS_SQL.format(ntz="_NTZ")).selectExpr(
        "id",
        "name",
        "description",
        "grouping_rule_id",
        "named_struct('webhook_url', webhook_url) AS notification_config",
        "created_at",
        "updated_at",
    )
    return managers, spark.sql(RULES_SQL.format(ntz="_NTZ"))

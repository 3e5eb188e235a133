import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("ROWS", entry.entry(spark).count())
print("STREAM", entry.queries()["stream_alerts"](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_find_the_package_from_any_folder(tmp_path):
    repo = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=repo)],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300,
    )
    assert "ROWS 44" in done.stdout, done.stderr[-2000:]
    assert "STREAM 44" in done.stdout, done.stderr[-2000:]

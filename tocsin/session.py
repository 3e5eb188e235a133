"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "tocsin", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # windows cost much CPU per byte: spread small shuffles over the cores as well
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        # do not record the Python call site of every column expression
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    if not (master or "").startswith("local"):
        # where AQE starts to merge shuffle partitions from; 100 TB need far more than the default 200
        settings.setdefault("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "20000")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: `spark.checkpoint.dir`.

    Only a local session may fall back to a temporary folder; on a cluster the
    executors would not see each other's files there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tocsin-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_passing = threading.local()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread materializes meanwhile are deleted at the end."""
    outer, _passing.paths = getattr(_passing, "paths", None), []
    try:
        yield
    finally:
        paths, _passing.paths = _passing.paths, outer
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame, name: str, reader: SparkSession | None = None) -> DataFrame:
    """Write `df` once as a parquet table in the shared folder and read it back, by the session `reader` if given.

    Cuts the lineage (a lost executor re-reads files instead of re-running the
    stages before), and later readers prune columns and see real sizes.
    """
    spark = reader or df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/{app}/{name}-{uuid.uuid4().hex}"
    if getattr(_passing, "paths", None) is not None:
        _passing.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Spark hand this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tocsin-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as target:
        for source in sorted(package.rglob("*.py")):
            target.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)

"""The stream's alerts as a table: parts named by manifests, merged as they grow.

A part holds rows of alerts, one per dedup key; a newer part's row replaces an older one's. A version of the table
is a manifest: its parts, oldest first, and the last micro-batch they hold. Parts are written first, then the
manifest is put in place by a rename that fails if that version is there (atomic on HDFS and the like), and
readers go by the newest manifest alone. So a write that is cut off is not seen, a micro-batch that is repeated
finds its number published and changes nothing, and of two writers that race for a version one starts again from
the other's.

`compact` merges the newest parts with all before them that aren't much larger, so a row is rewritten about as
often as the table doubles, not with every micro-batch. A reader merges what is newer than the oldest part and
leaves that part's other rows where they are, without a shuffle if the newer parts are small.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tocsin.operators.parts import newest

GROWTH = 2  # a part is merged with newer ones if it has at most this many times their rows


@dataclass(frozen=True)
class Part:
    name: str
    rows: int


@dataclass(frozen=True)
class Manifest:
    version: int
    batch: int  # the last micro-batch, -1 before the first
    parts: tuple[Part, ...]


class AlertTable:
    """The table under `path`, whose rows have the columns of `schema`; see the module's text."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: tuple[str, ...] = ("dedup_key",)):
        self.spark, self.path, self.schema, self.key = spark, path, schema, list(key)
        jvm = spark._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        uri = self._Path(path).getFileSystem(conf).makeQualified(self._Path(path)).toUri()
        self._fs = self._Path(path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, conf)
        self._rename = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def _versions(self) -> list[int]:
        folder = self._Path(f"{self.path}/manifest")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _read(self, version: int) -> Manifest:
        schema = "version long, batch long, parts array<struct<name:string,rows:long>>"
        row = self.spark.read.schema(schema).json(f"{self.path}/manifest/v{version}.json").first()
        return Manifest(row["version"], row["batch"], tuple(Part(p["name"], p["rows"]) for p in row["parts"]))

    def manifest(self, before: int | None = None) -> Manifest:
        """The newest one, or the newest from before the micro-batch `before`."""
        for version in reversed(self._versions()):
            made = self._read(version)
            if before is None or made.batch < before:
                return made
        return Manifest(0, -1, ())

    def _commit(self, made: Manifest) -> bool:
        """Put a manifest in place; false if another writer took its version."""
        parts = [{"name": p.name, "rows": p.rows} for p in made.parts]
        text = json.dumps({"version": made.version, "batch": made.batch, "parts": parts})
        written = self._Path(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(written)
        out.write(bytearray(text.encode()))
        out.close()
        if made.version in self._versions():
            self._fs.delete(written, False)
            return False
        try:
            self._context.rename(written, self._Path(f"{self.path}/manifest/v{made.version}.json"), self._rename)
        except Py4JJavaError as error:
            self._fs.delete(written, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True

    def _update(self, change: Callable[[Manifest], Manifest | None]) -> Manifest:
        """The newest manifest with `change`, which gives None where nothing is left to change."""
        while True:
            now = self.manifest()
            changed = change(now)
            if changed is None:
                return now
            made = replace(changed, version=now.version + 1)
            if self._commit(made):
                return made

    def _write(self, rows: DataFrame) -> Part:
        name = f"part-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return Part(name, self._open(name).count())

    def _open(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}")

    def _merged(self, parts: tuple[Part, ...]) -> DataFrame:
        """The newest row of each key."""
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return newest([self._open(p.name) for p in parts], self.key)

    def rows(self, before: int | None = None) -> DataFrame:
        """The table as of its newest manifest, or as it was before the micro-batch `before`."""
        return self._merged(self.manifest(before).parts)

    def publish(self, rows: DataFrame, batch: int) -> Manifest:
        """Add the rows of a micro-batch, one per key at most, unless that micro-batch is in the table already."""
        made = self.manifest()
        if batch <= made.batch:
            return made
        part = self._write(rows)

        def add(now: Manifest) -> Manifest | None:
            if batch <= now.batch:
                return None
            return replace(now, batch=batch, parts=(*now.parts, part) if part.rows else now.parts)

        return self._update(add)

    def compact(self, growth: int = GROWTH) -> Manifest:
        """Merge the newest parts with those before them that have at most `growth` times their rows."""
        made = self.manifest()
        first, rows = len(made.parts), 0
        while first and (first == len(made.parts) or made.parts[first - 1].rows <= growth * rows):
            first -= 1
            rows += made.parts[first].rows
        old = made.parts[first:]
        if len(old) < 2:
            return made
        merged = self._write(self._merged(old))

        def swap(now: Manifest) -> Manifest | None:
            # micro-batches may have come meanwhile; another compaction of these parts makes this one void
            at = next((i for i in range(len(now.parts)) if now.parts[i : i + len(old)] == old), None)
            if at is None:
                return None
            return replace(now, parts=(*now.parts[:at], merged, *now.parts[at + len(old) :]))

        return self._update(swap)

    def expire(self, keep: int = 10) -> None:
        """Delete manifests but for the newest `keep`, and the parts that only deleted ones name.

        Parts that no manifest names may belong to a write that goes on, so they stay.
        """
        versions = self._versions()
        gone, kept = versions[:-keep], versions[-keep:]
        if not gone:
            return
        used = {p.name for v in kept for p in self._read(v).parts}
        unused = {p.name for v in gone for p in self._read(v).parts} - used
        for name in sorted(unused):
            self._fs.delete(self._Path(f"{self.path}/{name}"), True)
        for version in gone:
            self._fs.delete(self._Path(f"{self.path}/manifest/v{version}.json"), False)

"""Stages of a run that are either whole or not there.

A stage's tables are staged under a path of their own. Only when all are written is a manifest published, by renaming one small
file, which names them and the settings they were made with. Readers go by the manifest: a write that fails half-way leaves nothing that
is read, and a rerun with the same settings takes up finished stages and makes the others anew.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "_MANIFEST.json"


def digest(settings: dict) -> str:
    """Of settings whatever their order."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:32]


class Files:
    """Small files and renames, by the file system that a path belongs to."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm

    def _at(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self, path: str) -> str | None:
        at, fs = self._at(path)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, path: str, content: str) -> None:
        """The whole file or, if this fails, the one before."""
        at, fs = self._at(path)
        fresh = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        stream = fs.create(fresh, True)
        try:
            stream.write(content.encode())
        finally:
            stream.close()
        contexts = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        contexts.rename(fresh, at, options)

    def names(self, path: str) -> list[str]:
        at, fs = self._at(path)
        return [f.getPath().getName() for f in fs.listStatus(at)]

    def remove(self, path: str) -> None:
        at, fs = self._at(path)
        fs.delete(at, True)


def manifest(spark: SparkSession, path: str) -> dict | None:
    text = Files(spark).read(f"{path.rstrip('/')}/{MANIFEST}")
    return json.loads(text) if text else None


def finished(spark: SparkSession, path: str, settings: dict) -> bool:
    """Whether the stage at a path is whole and made with these settings."""
    held = manifest(spark, path)
    return held is not None and held["settings"] == digest(settings)


def run_stage(spark: SparkSession, path: str, settings: dict, make: Callable[[], dict[str, DataFrame]], again: bool = False) -> dict[str, DataFrame]:
    """The tables of a stage by name: those that are there, if it is finished with these settings, else what make() returns, written in two
    phases. What an earlier version or a killed driver left is
    removed once the new version is published; a stage has one writer at a time."""
    files, base = Files(spark), path.rstrip("/")
    if not again and finished(spark, base, settings):
        return read_stage(spark, base)
    version = f"v-{uuid.uuid4().hex}"
    try:
        tables = make()
        for name, df in tables.items():
            df.write.parquet(f"{base}/{version}/{name}")
    except BaseException:
        files.remove(f"{base}/{version}")
        raise
    held = {"settings": digest(settings), "version": version, "tables": {name: df.schema.json() for name, df in tables.items()}}
    files.replace(f"{base}/{MANIFEST}", json.dumps(held))
    for name in files.names(base):
        if name.startswith("v-") and name != version:
            files.remove(f"{base}/{name}")
    return read_stage(spark, base)


def read_stage(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    from pyspark.sql.types import StructType

    held, base = manifest(spark, path), path.rstrip("/")
    if held is None:
        raise FileNotFoundError(f"no finished stage at {path}")
    return {name: spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{base}/{held['version']}/{name}") for name, schema in held["tables"].items()}


def publish(df: DataFrame, path: str) -> None:
    """One table in place of what is at a path."""
    run_stage(df.sparkSession, path, {}, lambda: {"rows": df}, again=True)


def published(spark: SparkSession, path: str) -> DataFrame:
    """The table that publish() put there, or a plain Parquet table."""
    if manifest(spark, path) is None:
        return spark.read.parquet(path)
    return read_stage(spark, path)["rows"]

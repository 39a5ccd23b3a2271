"""The folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; where it is unset a temporary one, only in local mode, where one
    machine does all."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="varlake-")
    return root.rstrip("/")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path below it."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


class Tables:
    """Tables of one piece of work in the shared folder. save() cuts the lineage; all of them go when the work is done."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base, self.count = spark, shared_folder(spark, label), 0

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        self._remove(self.base)

    def _remove(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.base}/{name}")


def kept(spark: SparkSession, label: str, make: Callable[[Tables], DataFrame]) -> DataFrame:
    """What make() returns, written; the tables that it needed on the way are gone."""
    path = shared_folder(spark, label)
    with Tables(spark, f"{label}-work") as tables:
        out = make(tables)
        out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)

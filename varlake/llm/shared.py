"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in local mode, where one machine does all."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="varlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Intermediate tables of one query. save() cuts the lineage: what it returns is read from Parquet files in the
    shared folder, so a lost executor costs no recomputation beyond them. drop() removes a table that no later step
    reads; what is left goes when the interpreter ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base = spark, f"{shared_folder(spark)}/varlake-{label}-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.path(name))

    def _end(self) -> None:
        if SparkSession.getActiveSession() is not None and self.spark.sparkContext._jsc is not None:
            remove(self.spark, self.base)


COPIES_AT_ONCE = 1000


def copied(units: DataFrame, times: str, first: str) -> DataFrame:
    """Each unit as `times` rows, `first` counted up from its value. Units of many copies are cut into pieces that are dealt out before they become
    rows, so that no task makes all copies of one."""
    upto = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("long")))
    few = units.filter(F.col(times) <= COPIES_AT_ONCE).withColumn("copy_", upto(F.col(times)))
    many = units.filter(F.col(times) > COPIES_AT_ONCE).withColumn("piece_", upto(F.ceil(F.col(times) / COPIES_AT_ONCE)))
    many = many.repartition(first, "piece_").withColumn("copy_", F.explode(F.sequence(F.col("piece_") * COPIES_AT_ONCE, F.least((F.col("piece_") + 1) * COPIES_AT_ONCE, F.col(times)) - 1))).drop("piece_")
    return few.unionByName(many).withColumn(first, F.col(first) + F.col("copy_")).drop("copy_")

"""The pileup over a stream of reads: counts per cell and site that grow with every micro-batch.

Read counts are sums. Distinct UMIs need state: (cell, site, allele, UMI) is de-duplicated by the stream itself, in the
shared checkpoint folder, before it is counted. Without a watermark the state holds every UMI seen; give one when reads of
a run arrive within a known time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reads as rd
from ..sources.folder import shared_folder

BY = ["sample", "barcode", *rd.SITE]


def streamed_counts(reads: DataFrame) -> DataFrame:
    """A streaming aggregate in update or complete mode. reads: a streaming DataFrame of aligned reads."""
    kept = rd.tagged(rd.kept_by_quality(reads)).filter("base = alt or base = ref")
    alt = F.col("base") == F.col("alt")
    first = kept.groupBy(*BY, alt.alias("is_alt"), "umi").agg(F.count("*").alias("reads"))
    return first


def counts_of_stream(spark: SparkSession, reads: DataFrame, files: int = 4, batches: int | None = None) -> DataFrame:
    """Deal reads to files, read them as a stream in so many batches (by default file by file), and return the final counts. A micro-batch writes only the
    counts that it changed, below its own number, so that a repeated one replaces itself; counts only grow, so the largest
    of a key is its last."""
    base = shared_folder(spark, "stream")
    reads.repartition(files).write.parquet(f"{base}/in")
    source = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", -(-files // (batches or files))).parquet(f"{base}/in")

    def replace(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    running = streamed_counts(source).writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").foreachBatch(replace).trigger(availableNow=True).start()
    running.awaitTermination()
    out = spark.read.parquet(f"{base}/out").groupBy(*BY, "is_alt", "umi").agg(F.max("reads").alias("reads"))
    one = lambda a, what: F.coalesce(F.sum(F.when(F.col("is_alt") == a, what)), F.lit(0)).alias
    n, u = F.col("reads"), F.when(F.col("umi").isNotNull(), 1).otherwise(0)
    return out.groupBy(*BY).agg(one(True, n)("alt_reads"), one(False, n)("ref_reads"), one(True, u)("alt_umis"), one(False, u)("ref_umis"))

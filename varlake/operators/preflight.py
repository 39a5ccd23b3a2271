"""Checks of a table of samples before a run: every problem is a row, however many samples and files there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.settings import required_path

REQUIRED = ("bam", "vcf", "cb")


def files_below(spark: SparkSession, folder: str) -> DataFrame:
    """path of every file below a folder, on any store; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))


def missing_inputs(samples: DataFrame, files: DataFrame, required: tuple[str, ...] = REQUIRED, annotated: bool = False) -> DataFrame:
    """sample, input, problem: an input whose path is not given, or of which there is no file. samples: (sample, a column of text for each
    input); files: (path). With the frequency filter an annotated VCF is required, too."""
    wanted = [*required, *(["annotated_vcf"] if annotated else [])]
    each = samples.select("sample", F.explode(F.array(*(F.struct(F.lit(c).alias("input"), required_path(F.col(c)).alias("path")) for c in wanted))).alias("i")).select("sample", "i.input", "i.path")
    none = each.filter("path is null").select("sample", "input", F.lit("not given").alias("problem"))
    gone = each.filter("path is not null").join(files.select("path").distinct(), "path", "left_anti").select("sample", "input", F.concat(F.lit("no file "), "path").alias("problem"))
    return none.union(gone)


def repeated_prefixes(samples: DataFrame, column: str = "bam") -> DataFrame:
    """prefix, samples: file names without folder and extensions that several samples have; their outputs would replace each other."""
    name = F.regexp_extract(required_path(F.col(column)), r"([^/]+)$", 1)
    prefix = F.regexp_replace(name, r"\.[^.]*$", "")
    named = samples.select(prefix.alias("prefix"), "sample").filter("prefix <> ''")
    return named.groupBy("prefix").agg(F.countDistinct("sample").alias("samples")).filter("samples > 1")


def checked(samples: DataFrame, files: DataFrame, annotated: bool = False) -> DataFrame:
    """samples as they are, or one error that counts all problems and names the first ten."""
    found = missing_inputs(samples, files, annotated=annotated).select(F.concat_ws(" ", F.concat("sample", F.lit(":")), "input", "problem").alias("p"))
    found = found.union(repeated_prefixes(samples).select(F.concat(F.lit("several samples write "), "prefix").alias("p")))
    n, first = found.count(), [r["p"] for r in found.orderBy("p").limit(10).collect()]
    if n:
        raise FileNotFoundError(f"{n} problems with the inputs: " + "; ".join(first))
    return samples

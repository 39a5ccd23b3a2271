"""The cell x variant call matrix in long form, and estimates over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import statistics as st
from ..functions import variants as vt
from . import reads as rd
from .quantiles import lower_medians, quantiles


def call_matrix(counts: DataFrame, prior: Column | float = 0.001, p_alt: Column | float = 0.5, error: float = 0.001, threshold: float | None = None) -> DataFrame:
    """sample, cell, snv, alt_count, ref_count, posterior, call; a pair that has no row is 0. counts: as in_unit() gives
    them. Counts and posterior of unsure cells are kept."""
    prior = prior if isinstance(prior, Column) else F.lit(float(prior))
    post = F.when((F.col("alt_count") == 0) & (F.col("ref_count") > 0), st.reference_posterior(prior, F.col("ref_count"), p_alt, error))
    out = counts.withColumn("posterior", post)
    return out.select(
        "sample", F.concat("sample", F.lit("_"), "barcode").alias("cell"), vt.snv_key(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")).alias("snv"),
        "alt_count", "ref_count", "posterior", st.ternary_call(F.col("alt_count"), F.col("ref_count"), F.col("posterior"), threshold).alias("call"))


def weighted_median(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Lower weighted median per group."""
    return lower_medians(rows, by, value, weight, "weighted_median")


def variant_read_share(counts: DataFrame, default: float = 0.5, least_alt: int = 2, least_total: int = 2, least_observations: int = 25, least_snvs: int = 5) -> DataFrame:
    """Per sample: the share of variant reads in cells that carry it, a weighted median over variants; the default where
    too little was seen."""
    total = F.col("alt_count") + F.col("ref_count")
    kept = counts.filter((F.col("alt_count") >= least_alt) & (total >= least_total))
    per = kept.groupBy("sample", *rd.SITE).agg(F.sum("alt_count").alias("a"), F.sum(total).alias("w"), F.count("*").alias("n"))
    median = weighted_median(per.withColumn("ratio", F.col("a") / F.col("w")), ["sample"], "ratio", "w")
    seen = per.groupBy("sample").agg(F.sum("n").alias("observations"), F.count("*").alias("snvs"))
    enough = (F.col("observations") >= least_observations) & (F.col("snvs") >= least_snvs)
    out = counts.select("sample").distinct().join(seen, "sample", "left").join(median, "sample", "left")
    p = F.when(enough, F.col("weighted_median")).otherwise(F.lit(default))
    return out.select("sample", F.coalesce("observations", F.lit(0)).alias("observations"), F.coalesce("snvs", F.lit(0)).alias("snvs"), st.clamped(F.coalesce(p, F.lit(default))).alias("p_alt"))


QUANTILES = {"q01": 0.01, "q05": 0.05, "q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95, "q99": 0.99}


def posterior_summary(matrix: DataFrame, by: list[str]) -> DataFrame:
    """Over the posteriors of -1 calls that are positive: count, mean, population deviation, extremes, exact quantiles."""
    p = F.col("posterior")
    rows = matrix.filter((F.col("call") == -1) & p.isNotNull() & (p > 0))
    out = rows.groupBy(F.struct(*by).alias("g")).agg(F.count("*").alias("n"), F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"), F.min(p).alias("min"), F.max(p).alias("max"))
    ranks = quantiles(rows, by, "posterior", QUANTILES).select(F.struct(*by).alias("g"), *QUANTILES)
    return out.join(ranks, "g").select(*(F.col("g")[c].alias(c) for c in by), "n", "mean", "std", "min", *QUANTILES, "max")


def histogram(matrix: DataFrame, by: list[str], bins: int = 60) -> DataFrame:
    """Counts in equal bins of [0, 1], at least five; the last bin is closed."""
    bins = max(5, bins)
    rows = matrix.filter("call = -1 and posterior > 0 and posterior <= 1")
    return rows.groupBy(*by, F.least(F.floor(F.col("posterior") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def histogram_table(matrix: DataFrame, by: str, bins: int = 60) -> DataFrame:
    """by, bin, low, high, n: what a plot of each group draws, with empty bins, in order."""
    bins = max(5, bins)
    every = matrix.select(by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    rows = every.join(histogram(matrix, [by], bins), [by, "bin"], "left")
    return rows.select(by, "bin", (F.col("bin") / bins).alias("low"), ((F.col("bin") + 1) / bins).alias("high"), F.coalesce("n", F.lit(0)).alias("n")).orderBy(by, "bin")


def merged(matrices: list[DataFrame]) -> DataFrame:
    """Samples below each other; cells are prefixed with their sample already, and what a sample lacks stays 0."""
    out = matrices[0]
    for m in matrices[1:]:
        out = out.unionByName(m)
    return out

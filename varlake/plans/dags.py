"""The stages end to end. Each stage's table is written under the digest of its settings and reused only under the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CallSettings
from ..functions import statistics as st
from ..functions import variants as vt
from ..operators import calls, graph, reads as rd, scoring, vcf
from ..sources import bam, tables, text


def called_sites(reads: DataFrame, editing: DataFrame) -> DataFrame:
    """Filtered reads to variant records outside known editing intervals."""
    return vcf.outside_intervals(vcf.called_variants(rd.kept_by_quality(rd.kept_by_flag(reads))), editing)


def call_matrices(reads: DataFrame, vcfs: DataFrame, cells: DataFrame, settings: CallSettings, lookup: DataFrame | None = None, deepest: int = 50_000) -> DataFrame:
    """Reads, variant records and listed cells of all samples to one call matrix in long form. Samples are a column, so
    that all of them are one job; priors and read shares stay per sample."""
    kept = vcf.kept_by_frequency(vcfs, settings.percentage)
    sites = vcf.union_of_sites(kept)
    # depth counts every read at a site, also those that the next filters leave out
    shallow = rd.without_deep_sites(rd.at_sites(reads, sites), deepest)
    good = rd.kept_by_quality(rd.tagged(shallow), settings.pileup_base_quality_min, settings.pileup_mapping_quality_min)
    counts = rd.in_unit(rd.pileup(rd.listed(good, cells)), settings.count_unit)
    counts = counts.withColumn("snv", vt.snv_key(*(F.col(c) for c in rd.SITE)))
    counts = counts.join(vcf.frequencies(kept), ["snv", "sample"], "left")
    p_alt = F.lit(settings.p_alt_if_variant)
    if settings.estimate_p_per_sample:
        shares = calls.variant_read_share(counts, settings.p_alt_if_variant, settings.p_estimation_min_alt_count, settings.p_estimation_min_total_count, settings.p_estimation_min_observations, settings.p_estimation_min_snvs)
        counts, p_alt = counts.join(shares.select("sample", "p_alt"), "sample"), F.col("p_alt")
    prior = st.variant_prior(F.col("freq"), settings.default_prior, settings.prior_scale, settings.prior_cap)
    matrix = calls.call_matrix(counts, prior, p_alt, settings.alt_error_rate, settings.neg1_prob_threshold)
    if settings.af_filter_enabled and lookup is not None:
        matrix = matrix.join(vcf.kept_by_population(matrix.select("snv").distinct(), lookup, settings.af_max), "snv", "left_semi")
    return matrix


def run_calls(spark: SparkSession, settings: CallSettings) -> DataFrame:
    """From the files of a configuration to the written matrix."""
    reads = cells = None
    vcfs = text.read_vcf(spark, {s: p["vcf"] for s, p in settings.samples.items()})
    sites = vcf.union_of_sites(vcf.kept_by_frequency(vcfs, settings.percentage))
    for sample, paths in settings.samples.items():
        source = bam.read_bam if str(paths["bam"]).endswith(".bam") else text.read_sam
        own = rd.bases_at_sites(rd.kept_by_flag(source(spark, paths["bam"]), 1804, 0), sites).withColumn("sample", F.lit(sample))
        listed = text.read_barcodes(spark, paths["cb"], settings.data_type).select("barcode").withColumn("sample", F.lit(sample))
        reads = own if reads is None else reads.unionByName(own)
        cells = listed if cells is None else cells.unionByName(listed)
    lookup = None
    if settings.af_filter_enabled:
        lookup = vcf.frequency_lookup(text.read_vcf(spark, {s: p["annotated_vcf"] for s, p in settings.samples.items()}, 8), settings.af_field)
    path = f"{settings.output_dir.rstrip('/')}/matrix-{settings.digest()}"
    matrix = call_matrices(reads.select("sample", "barcode", "umi", "chrom", "pos", "base", "base_q", "map_q"), vcfs, cells, settings, lookup)
    tables.write_matrix(matrix, cells, matrix.select("snv").distinct(), path)
    return spark.read.schema(matrix.schema).parquet(f"{path}/x")  # also when no pair is left


def cell_scores(matrix: DataFrame, cells: DataFrame, scores: DataFrame, score: str = "score_euclidean", **limits) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores per cell type and variant to (kept scores, audit of the removed, cells with perturbation and z)."""
    best = scoring.best_per_snv(scores, score)
    carriers = matrix.filter("call = 1").join(cells.select("cell", "celltype"), "cell").select("celltype", "sample", "cell", "snv")
    edges = graph.cooccurrence(carriers, **limits)
    states = graph.thinned(edges, best, score)
    kept = scoring.min_max(graph.without(best, states), score, f"{score}_norm")
    return kept, graph.audit(edges, states, best, score), scoring.within_celltype_z(scoring.cell_perturbation(matrix, cells, kept, score))

"""Operators on variant records and their allele frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import variants as vt
from ..functions.statistics import exact_test

SITE = ["chrom", "pos", "ref", "alt"]


def with_frequency(vcf: DataFrame) -> DataFrame:
    return vcf.withColumn("freq", vt.variant_frequency(F.col("format"), F.col("sample_text")))


def kept_by_frequency(vcf: DataFrame, percentage: float | None) -> DataFrame:
    """Records whose frequency in per cent is below the limit; without a limit all of them. The frequency is divided by
    100 and multiplied again, which floating point does not undo for every value."""
    if percentage is None or percentage <= 0:
        return vcf
    return with_frequency(vcf).filter(F.col("freq") * 100 < percentage).drop("freq")


def union_of_sites(vcfs: DataFrame) -> DataFrame:
    """Distinct sites as text over all samples, with the place of their first record: (sample_ix, line)."""
    return vcfs.groupBy(*SITE).agg(F.min(F.struct("sample_ix", "line")).alias("first")).select(*SITE, F.col("first.sample_ix").alias("sample_ix"), F.col("first.line").alias("line"))


def frequencies(vcfs: DataFrame) -> DataFrame:
    """sample, snv, freq: the last record of a sample that has a frequency."""
    rows = with_frequency(vcfs).filter("freq is not null").withColumn("snv", vt.snv_key(*(F.col(c) for c in SITE)))
    return rows.groupBy("snv", "sample").agg(F.max_by("freq", "line").alias("freq"))


def four_places(x):
    """Text of a share, 0 or more, with four decimals: the binary number itself is rounded, not its shortest decimal form, and exact halves go to
    the even digit. x is split into two parts whose products with 20000 are exact, so that the comparison with the middle between two
    ten-thousandths is."""
    low = F.floor(x * 10_000)
    high_part = x * 134217729.0 - (x * 134217729.0 - x)
    above = (high_part * 20_000.0 - (2 * low + 1)) + (x - high_part) * 20_000.0
    units = low + F.when((above > 0) | ((above == 0) & (low % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(units / 10_000).cast("string"), F.lit("."), F.lpad((units % 10_000).cast("string"), 4, "0"))


def frequency_text(freqs: DataFrame) -> DataFrame:
    """snv, freqs: sample:0.1234 joined by ';' in the order of samples."""
    one = F.concat("sample", F.lit(":"), four_places(F.col("freq")))
    return freqs.groupBy("snv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample", one.alias("t")))), lambda e: e["t"]), ";").alias("freqs"))


def frequency_lookup(vcf: DataFrame, field: str) -> DataFrame:
    """key, af: the largest frequency of a key's records, null when none is a number."""
    raw = vt.info_map(F.col("info"))[field]
    rows = vcf.select(vt.snv_key(*(F.col(c) for c in SITE)).alias("key"), raw.alias("raw"))
    return rows.groupBy("key").agg(F.max(vt.allele_frequency(F.col("raw"))).alias("af"), F.count("*").alias("records"), F.count_if(F.col("raw").isNull()).alias("without_field"))


def lookup_statistics(vcf: DataFrame, lookup: DataFrame, most: float) -> DataFrame:
    """Records, keys, keys above the limit, keys without a number, keys given more than once."""
    return lookup.agg(F.sum("records").alias("total"), F.count("*").alias("keys"), F.count_if(F.col("af") > most).alias("above"), F.count_if(F.col("af").isNull()).alias("missing"), F.count_if(F.col("records") > 1).alias("repeated"))


def with_population_frequency(snvs: DataFrame, lookup: DataFrame) -> DataFrame:
    """snv, matched_key, af: by the key, or else with the chr prefix toggled. The second key is used only where the first
    is absent, not where it merely has no number."""
    first, second = lookup.select(F.col("key").alias("k1"), F.col("af").alias("a1")), lookup.select(F.col("key").alias("k2"), F.col("af").alias("a2"))
    rows = snvs.withColumn("other", vt.toggled_chromosome(F.col("snv")))
    rows = rows.join(first, rows["snv"] == first["k1"], "left").join(second, rows["other"] == second["k2"], "left")
    hit = F.col("k1").isNotNull()
    return rows.withColumns({"matched_key": F.when(hit, F.col("k1")).otherwise(F.col("k2")), "af": F.when(hit, F.col("a1")).otherwise(F.col("a2"))}).drop("k1", "a1", "k2", "a2", "other")


def population_details(snvs: DataFrame, lookup: DataFrame, most: float = 0.001) -> DataFrame:
    rows = with_population_frequency(snvs, lookup)
    numeric = F.col("af").isNotNull() & (F.abs("af") != float("inf"))
    return rows.withColumns({"found": F.col("matched_key").isNotNull(), "numeric": numeric, "removed": F.coalesce(numeric & (F.col("af") > most), F.lit(False))})


def kept_by_population(snvs: DataFrame, lookup: DataFrame, most: float = 0.001) -> DataFrame:
    return population_details(snvs, lookup, most).filter("not removed").select(snvs.columns)


def population_summary(details: DataFrame) -> DataFrame:
    return details.agg(F.count("*").alias("before"), F.count_if("found").alias("matched"), F.count_if(~F.col("found")).alias("unmatched"), F.count_if("numeric").alias("numeric"), F.count_if("removed").alias("removed"), F.count_if(~F.col("removed")).alias("kept"))


def outside_intervals(vcf: DataFrame, bed: DataFrame, width: int = 1 << 14) -> DataFrame:
    """Interval anti-join: records that overlap no half-open, 0-based interval of their chromosome. Both sides are dealt to
    bins of the genome, so that the join has an equality on (chrom, bin), and records meet only intervals nearby."""
    start, end = F.col("pos") - 1, F.col("pos") - 1 + F.length("ref")
    bins = lambda a, b: F.sequence(F.floor(a / width), F.floor(F.greatest(b - 1, a) / width))
    spans = bed.select(F.col("chrom").alias("bed_chrom"), F.col("start").alias("bed_start"), F.col("end").alias("bed_end")).distinct()
    spans = spans.withColumn("bed_bin", F.explode(bins(F.col("bed_start"), F.col("bed_end"))))
    keyed = vcf.select("chrom", "pos", F.length("ref").alias("n"), "ref").distinct().withColumn("bin", F.explode(bins(start, end)))
    hit = (F.col("chrom") == F.col("bed_chrom")) & (F.col("bin") == F.col("bed_bin")) & (F.col("bed_start") < F.col("pos") - 1 + F.col("n")) & (F.col("bed_end") > F.col("pos") - 1)
    struck = keyed.join(spans, hit, "left_semi").select("chrom", "pos", "ref").distinct()
    return vcf.join(struck, ["chrom", "pos", "ref"], "left_anti")


def called_variants(reads: DataFrame, least_coverage: int = 8, least_share: float = 0.01, least_reads: int = 3, error: float = 0.001, most_p: float = 0.99, one_strand: float | None = 0.9) -> DataFrame:
    """Variants over (sample, chrom, pos, ref, base, flag): depth, variant reads, their share, p_value and forward, the variant's reads on the
    forward strand. Coverage, share and reads are least values.

    p_value is of Fisher's exact test, one-sided: as many variant reads or more, against as many reads of which `error` are variants. Variants with a
    p-value above most_p go, and, by the strand filter, those with more than one_strand of their reads on one strand (flag 16) though no more
    than that share of the reference's reads are. The limits of the test and of the strand filter are this library's own choice."""
    by = ["sample", "chrom", "pos", "ref"]
    forward = F.count_if(F.col("flag").bitwiseAND(16) == 0)
    bases = reads.groupBy(*by, "base").agg(F.count("*").alias("n"), forward.alias("forward"))
    site, is_ref = Window.partitionBy(*by), F.col("base") == F.col("ref")
    total = lambda c, name: F.sum(F.when(is_ref, F.col(c)).otherwise(0)).over(site).alias(name)
    rows = bases.select(*by, "base", "n", "forward", F.sum("n").over(site).alias("depth"), total("n", "ref_n"), total("forward", "ref_forward"))
    rows = rows.filter(~is_ref & F.col("base").isin("A", "C", "G", "T"))
    share, most = F.col("n") / F.col("depth"), lambda a, n: F.greatest(a, n - a) / n
    rows = rows.filter((F.col("depth") >= least_coverage) & (F.col("n") >= least_reads) & (share >= least_share))
    expected = F.floor(F.col("ref_n") * error + F.col("n") * error).cast("long")
    rows = rows.withColumn("p_value", exact_test(F.col("n"), F.col("ref_n"), expected, F.col("ref_n") + F.col("n") - expected)).filter(F.col("p_value") <= most_p)
    if one_strand is not None:
        skewed = most(F.col("forward"), F.col("n")) > one_strand
        whole = (F.col("ref_n") > 0) & (most(F.col("ref_forward"), F.col("ref_n")) > one_strand)
        rows = rows.filter(~skewed | whole)
    return rows.select(*by, F.col("base").alias("alt"), "depth", F.col("n").alias("alt_reads"), share.alias("share"), "p_value", "forward")


def chromosome_styles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether each side writes chr, and whether they agree."""
    with_chr = lambda d, n: d.agg(F.coalesce(F.bool_or(F.col("chrom").startswith("chr")), F.lit(False)).alias(n))
    return with_chr(a, "a_chr").join(with_chr(b, "b_chr")).withColumn("agree", F.col("a_chr") == F.col("b_chr"))

"""Operators on aligned reads: one row per read and covered site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SITE = ["chrom", "pos", "ref", "alt"]


def kept_by_flag(reads: DataFrame, mask: int = 1804, least_map_q: int = 20) -> DataFrame:
    return reads.filter((F.col("flag").bitwiseAND(F.lit(mask)) == 0) & (F.col("map_q") >= least_map_q))


def kept_by_quality(reads: DataFrame, least_base_q: int = 20, least_map_q: int = 20) -> DataFrame:
    """Both limits are inclusive; a missing base quality is an error in the input."""
    base_q = F.when(F.col("base_q").isNull(), F.raise_error(F.lit("a read has no base quality")).cast("int")).otherwise(F.col("base_q"))
    return reads.filter((base_q >= least_base_q) & (F.col("map_q") >= least_map_q))


def without_deep_sites(reads: DataFrame, most: int = 50_000) -> DataFrame:
    """Sites of a sample with more reads are left out. Deep sites are few: they are counted with partial aggregation and
    anti-joined, so that no task gathers a deep site's reads."""
    by = ["sample", *SITE]
    deep = reads.groupBy(*by).agg(F.count("*").alias("depth")).filter(F.col("depth") > most).select(*by)
    return reads.join(deep, by, "left_anti")


def tagged(reads: DataFrame) -> DataFrame:
    """Reads with a barcode and a base at the site."""
    return reads.filter("barcode is not null and base is not null")


def listed(reads: DataFrame, cells: DataFrame) -> DataFrame:
    """Reads of whitelisted barcodes."""
    return reads.join(cells.select("sample", "barcode").distinct(), ["sample", "barcode"], "left_semi")


def at_sites(reads: DataFrame, sites: DataFrame) -> DataFrame:
    """Reads that cover a site, with the site's alleles."""
    return reads.drop("ref", "alt").join(sites.select(*SITE).distinct(), ["chrom", "pos"])


def pileup(reads: DataFrame) -> DataFrame:
    """Per cell and site: reads and distinct UMIs of either allele; other bases are ignored. Groups without either go."""
    alt, ref = F.col("base") == F.col("alt"), F.col("base") == F.col("ref")
    counts = reads.groupBy("sample", "barcode", *SITE).agg(
        F.count_if(alt).alias("alt_reads"), F.count_if(ref).alias("ref_reads"),
        F.count_distinct(F.when(alt, F.col("umi"))).alias("alt_umis"), F.count_distinct(F.when(ref, F.col("umi"))).alias("ref_umis"))
    return counts.filter("alt_reads > 0 or ref_reads > 0")


def in_unit(counts: DataFrame, unit: str = "reads") -> DataFrame:
    """alt_count and ref_count: reads, or distinct UMIs with reads where a cell has no UMI."""
    if unit not in ("reads", "umis"):
        raise ValueError(f"unknown unit {unit!r}")
    one = lambda a: F.col(f"{a}_reads") if unit == "reads" else F.when(F.col(f"{a}_umis") > 0, F.col(f"{a}_umis")).otherwise(F.col(f"{a}_reads"))
    return counts.withColumns({"alt_count": one("alt"), "ref_count": one("ref")})


def reference_only(counts: DataFrame) -> DataFrame:
    """Cells of a site with reference reads and none of the variant: the anti-join of both barcode sets, as one filter."""
    return counts.filter("ref_reads > 0 and alt_reads = 0")


def variants_per_cell(cells: DataFrame, counts: DataFrame) -> DataFrame:
    """For every listed barcode, also those without any: how many variants it supports, and which, in order."""
    seen = counts.filter("alt_reads > 0").select("sample", "barcode", F.concat("chrom", F.lit(":"), F.col("pos").cast("string"), F.lit("("), "ref", F.lit("->"), "alt", F.lit(")")).alias("v"))
    listed_cells = cells.select("sample", "barcode").distinct()
    return listed_cells.join(seen, ["sample", "barcode"], "left").groupBy("sample", "barcode").agg(F.count("v").alias("n"), F.array_join(F.array_sort(F.collect_list("v")), ",").alias("variants"))


def sidecar(counts: DataFrame, allele: str, payload: str = "barcodes") -> DataFrame:
    """Per sample and site the barcodes of an allele, sorted, or their bc:n counts."""
    n = F.col(f"{allele}_reads")
    rows = counts.filter(n > 0).groupBy("sample", *SITE)
    if payload == "barcodes":
        return rows.agg(F.array_join(F.array_sort(F.collect_list("barcode")), ",").alias("payload"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("barcode", n.alias("n")))), lambda e: F.concat(e["barcode"], F.lit(":"), e["n"].cast("string"))), ",").alias("payload"))


BIN = 4096  # places of the genome that share a key


def aligned_blocks(alignments: DataFrame) -> DataFrame:
    """(…, chrom, start 1-based, cigar, seq, qual) to a row per run of aligned bases: block.r is its first place, block.q the
    first of its bases in the read, block.n its length. Inserted and clipped bases have no place; deletions and skips no base."""
    ops = F.regexp_extract_all("cigar", F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1))
    steps = F.transform(ops, lambda o: F.struct(F.regexp_extract(o, "^[0-9]+", 0).cast("int").alias("n"), F.substring(o, -1, 1).alias("op")))
    begin = F.struct(F.col("start").cast("int").alias("r"), F.lit(1).alias("q"), F.array().cast("array<struct<r:int,q:int,n:int>>").alias("out"))

    def step(s, o):
        on_ref, on_read = o["op"].isin("M", "D", "N", "=", "X"), o["op"].isin("M", "I", "S", "=", "X")
        block = F.when(o["op"].isin("M", "=", "X"), F.array(F.struct(s["r"].alias("r"), s["q"].alias("q"), o["n"].alias("n")))).otherwise(F.array().cast("array<struct<r:int,q:int,n:int>>"))
        return F.struct((s["r"] + F.when(on_ref, o["n"]).otherwise(0)).alias("r"), (s["q"] + F.when(on_read, o["n"]).otherwise(0)).alias("q"), F.concat(s["out"], block).alias("out"))

    return alignments.withColumn("block", F.explode(F.aggregate(steps, begin, step)["out"]))


def _base_at(rows: DataFrame, offset: Column) -> DataFrame:
    """base and base_q (Phred+33) at an offset in the block."""
    at = F.col("block.q") + offset
    return rows.withColumn("base", F.substring("seq", at, F.lit(1))).withColumn("base_q", F.ascii(F.substring("qual", at, F.lit(1))) - 33).drop("block")


def exploded_alignments(alignments: DataFrame) -> DataFrame:
    """A row per aligned base: columns pos, base, base_q."""
    rows = aligned_blocks(alignments).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("block.n") - 1)))
    return _base_at(rows.withColumn("pos", F.col("block.r") + F.col("k")), F.col("k")).drop("k")


def bases_at_sites(alignments: DataFrame, sites: DataFrame) -> DataFrame:
    """A row per aligned base at one of the sites, as exploded_alignments gives it, without making the others: blocks meet
    the sites of the bins of the genome that they touch."""
    places = sites.select("chrom", F.col("pos").cast("int").alias("pos")).distinct().withColumn("bin", F.floor(F.col("pos") / BIN))
    blocks = aligned_blocks(alignments).withColumn("bin", F.explode(F.sequence(F.floor(F.col("block.r") / BIN), F.floor((F.col("block.r") + F.col("block.n") - 1) / BIN))))
    met = blocks.join(places, ["chrom", "bin"]).filter((F.col("pos") >= F.col("block.r")) & (F.col("pos") < F.col("block.r") + F.col("block.n"))).drop("bin")
    return _base_at(met, F.col("pos") - F.col("block.r"))

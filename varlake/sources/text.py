"""Readers and writers of the text formats: sites, VCF, BED, barcodes, annotation, FASTA, SAM and count sidecars. Lines are
parsed with built-in functions, so that readers split files and push columns like any other scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VCF_FIELDS = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "sample_text"]


def _stripped(column: str):
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def sites_from_lines(lines: DataFrame) -> DataFrame:
    """value -> chrom, pos, ref, alt: five or more fields are VCF's, four are a plain site, fewer are skipped."""
    rows = lines.select(_stripped("value").alias("v")).filter("v <> '' and not startswith(v, '#')")
    rows = rows.select(F.split("v", r"\s+").alias("t")).filter(F.size("t") >= 4)
    vcf = F.size("t") >= 5
    at = lambda i: F.get("t", F.lit(i))
    return rows.select(at(0).alias("chrom"), at(1).try_cast("int").alias("pos"), F.when(vcf, at(3)).otherwise(at(2)).alias("ref"), F.when(vcf, at(4)).otherwise(at(3)).alias("alt"))


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    return sites_from_lines(spark.read.text(path))


def write_sites(sites: DataFrame, path: str) -> None:
    """chrom, pos, ref, alt, tab-separated and without a header, in the order of (sample_ix, line)."""
    rows = sites.orderBy("sample_ix", "line").select("chrom", F.col("pos").cast("string"), "ref", "alt")
    rows.select(F.concat_ws("\t", *rows.columns).alias("value")).write.mode("overwrite").text(path)


def vcf_from_lines(lines: DataFrame, least: int = 10) -> DataFrame:
    """Records of at least `least` tab-separated fields; missing ones are null. Other columns of `lines` stay."""
    rows = lines.filter("value <> '' and not startswith(value, '#')").withColumn("t", F.split("value", "\t")).filter(F.size("t") >= least)
    fields = [F.get("t", F.lit(i)).alias(n) if n != "pos" else F.get("t", F.lit(i)).try_cast("int").alias(n) for i, n in enumerate(VCF_FIELDS)]
    return rows.select(*(c for c in lines.columns if c != "value"), *fields)


def read_vcf(spark: SparkSession, paths: dict[str, str], least: int = 10) -> DataFrame:
    """Files by sample, with the sample, its place among the files, and the record's place in its file."""
    out = None
    for ix, (sample, path) in enumerate(paths.items()):
        lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
        one = vcf_from_lines(lines, least).withColumns({"sample": F.lit(sample), "sample_ix": F.lit(ix)})
        out = one if out is None else out.unionByName(one)
    return out


def write_vcf(records: DataFrame, path: str, header: list[str] = ()) -> None:
    """Records in their order of `line` where they have one, below the header, as text."""
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit(".")) if c in records.columns else F.lit(".") for c in VCF_FIELDS))
    order = F.col("line") if "line" in records.columns else F.lit(0)
    rows = records.select(order.cast("long").alias("line"), line.alias("value"))
    head = records.sparkSession.createDataFrame([(-len(header) + i, h) for i, h in enumerate(header)], "line long, value string")
    head.union(rows).sortWithinPartitions("line").orderBy("line").select("value").write.text(path)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).filter("value <> '' and not startswith(value, '#') and not startswith(value, 'track')").select(F.split("value", "\t").alias("t"))
    return rows.select(F.get("t", F.lit(0)).alias("chrom"), F.get("t", F.lit(1)).try_cast("int").alias("start"), F.get("t", F.lit(2)).try_cast("int").alias("end")).filter("start is not null and end is not null")


def read_barcodes(spark: SparkSession, path: str, kind: str = "sc") -> DataFrame:
    """sc: one barcode a line; spatial: barcode,in_tissue,x,y,px,py of which those in tissue stay."""
    if kind == "sc":
        return spark.read.schema("barcode string").csv(path)
    if kind != "spatial":
        raise ValueError(f"unknown barcode file kind {kind!r}")
    return spark.read.schema("barcode string, in_tissue int, x int, y int, px double, py double").csv(path).filter("in_tissue = 1")


def read_sidecar(spark: SparkSession, path: str, cells: DataFrame | None = None) -> DataFrame:
    """chrom, pos, ref, alt, barcode, n of a barcode or bc:n sidecar; lines without five fields are skipped."""
    rows = spark.read.text(path).select(F.split(_stripped("value"), "\t").alias("t")).filter(F.size("t") == 5)
    rows = rows.select(*(F.get("t", F.lit(i)).alias(n) for i, n in enumerate(["chrom", "pos", "ref", "alt"])), F.explode(F.split(F.get("t", F.lit(4)), ",")).alias("e"))
    counted = F.regexp_like("e", F.lit("^(.*):([0-9]+)$"))
    out = rows.select("chrom", F.col("pos").try_cast("int").alias("pos"), "ref", "alt", F.when(counted, F.regexp_extract("e", "^(.*):([0-9]+)$", 1)).otherwise(F.col("e")).alias("barcode"), F.when(counted, F.regexp_extract("e", "^(.*):([0-9]+)$", 2).cast("int")).otherwise(1).alias("n"))
    return out if cells is None else out.join(cells.select("barcode").distinct(), "barcode", "left_semi")


def write_sidecar(payloads: DataFrame, path: str) -> None:
    payloads.select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "ref", "alt", "payload").alias("value")).write.text(path)


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """A table with a header: .tsv and .txt are tab-separated, others comma-separated; if that gives one column, the other
    separators are tried."""
    first = "\t" if path.rstrip("/").endswith((".tsv", ".txt")) else ","
    for sep in dict.fromkeys([first, "\t", ",", ";", " "]):
        rows = spark.read.option("header", True).option("sep", sep).option("inferSchema", True).csv(path)
        if len(rows.columns) > 1:
            return rows
    raise ValueError(f"no separator splits the header of {path}")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """contig, sequence. Records are split at '>', so a file is read in parts of whole records."""
    rows = spark.read.option("lineSep", ">").text(path).filter("trim(value) <> ''")
    return rows.select(F.regexp_extract("value", r"^(\S*)", 1).alias("contig"), F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s+", "")).alias("sequence"))


def reference_bases(fasta: DataFrame, width: int = 1000) -> DataFrame:
    """chrom, chunk, bases: the reference in chunks, to be joined by (chrom, (pos - 1) div width)."""
    chunks = F.sequence(F.lit(0), F.floor((F.length("sequence") - 1) / width))
    rows = fasta.filter("sequence <> ''").select(F.col("contig").alias("chrom"), "sequence", F.explode(chunks).alias("chunk"))
    return rows.select("chrom", "chunk", F.substring("sequence", (F.col("chunk") * width + 1).cast("int"), F.lit(width)).alias("bases"))


def with_reference(bases: DataFrame, fasta: DataFrame, width: int = 1000) -> DataFrame:
    """bases (chrom, pos) with ref, the reference base; positions beyond the reference go."""
    rows = bases.withColumn("chunk", F.floor((F.col("pos") - 1) / width))
    rows = rows.join(reference_bases(fasta, width), ["chrom", "chunk"])
    return rows.withColumn("ref", F.substring("bases", (F.col("pos") - F.col("chunk") * width).cast("int"), F.lit(1))).filter("ref <> ''").drop("chunk", "bases")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text: name, flag, chrom, start, map_q, cigar, seq, qual, barcode (CB) and umi (UB)."""
    rows = spark.read.text(path).filter("not startswith(value, '@')").select("value", F.split("value", "\t").alias("t")).filter(F.size("t") >= 11)
    at = lambda i: F.get("t", F.lit(i))
    tag = lambda n: F.nullif(F.regexp_extract("value", f"\t{n}:Z:([^\t]*)", 1), F.lit(""))
    return rows.select(at(0).alias("name"), at(1).try_cast("int").alias("flag"), at(2).alias("chrom"), at(3).try_cast("int").alias("start"), at(4).try_cast("int").alias("map_q"), at(5).alias("cigar"), at(9).alias("seq"), at(10).alias("qual"), tag("CB").alias("barcode"), tag("UB").alias("umi"))

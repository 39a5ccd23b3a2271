"""Column expressions on variant keys, VCF fields and barcode-count text. All are built-in functions, so they stay in
code generation; what a row cannot give is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STANDARD = [f"chr{c}" for c in [*range(1, 23), "X", "Y"]]


def snv_key(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """chrom:pos_REF>ALT with upper-case alleles."""
    return F.concat(chrom, F.lit(":"), pos.cast("int").cast("string"), F.lit("_"), F.upper(ref), F.lit(">"), F.upper(alt))


def _parsed(text: Column, pattern: str, chrom=lambda c: c) -> Column:
    part = lambda i: F.regexp_extract(text, pattern, i)
    found = F.struct(chrom(part(1)).alias("chrom"), part(2).try_cast("int").alias("pos"), F.upper(part(3)).alias("ref"), F.upper(part(4)).alias("alt"))
    return F.when(F.regexp_like(text, F.lit(pattern)), found)


def parse_key(text: Column) -> Column:
    """Strict form; null where the text has none."""
    return _parsed(text, r"(?i)^([^:]+):([0-9]+)_([^>]+)>([^>]+)$")


def parse_key_chr(text: Column) -> Column:
    """Needs a chr prefix; the chromosome comes out lower-case."""
    return _parsed(text, r"(?i)^(chr[^:]+):([0-9]+)_([^>]+)>([^>]+)$", F.lower)


def parse_key_loose(text: Column) -> Column:
    """By splitting at ':', '_' and '>'; each must give exactly two parts."""
    a = F.split(text, ":")
    b = F.split(F.get(a, F.lit(1)), "_")
    c = F.split(F.get(b, F.lit(1)), ">")
    two = (F.size(a) == 2) & (F.size(b) == 2) & (F.size(c) == 2)
    return F.when(two, F.struct(F.get(a, F.lit(0)).alias("chrom"), F.get(b, F.lit(0)).alias("pos"), F.get(c, F.lit(0)).alias("ref"), F.get(c, F.lit(1)).alias("alt")))


def normal_chromosome(chrom: Column) -> Column:
    bare = F.lower(F.regexp_replace(F.trim(chrom), "(?i)^chr", ""))
    return F.when(F.coalesce(bare, F.lit("")) == "", "").otherwise(F.concat(F.lit("chr"), bare))


def toggled_chromosome(chrom: Column) -> Column:
    return F.when(chrom.startswith("chr"), F.substring(chrom, 4, 1 << 30)).otherwise(F.concat(F.lit("chr"), chrom))


def info_map(info: Column) -> Column:
    """INFO as a map: flags are empty, the first '=' splits, of repeated keys the last wins."""
    pairs = F.transform(F.filter(F.transform(F.split(info, ";"), lambda x: F.trim(x)), lambda x: x != ""),
                        lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.when(x.contains("="), F.trim(F.regexp_replace(x, "^[^=]*=", ""))).otherwise("").alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda e: e["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda e: e["k"] == k), -1)["v"]))


def allele_frequency(raw: Column) -> Column:
    """Largest number of a comma list; '.' and blanks are null, nan counts as missing."""
    numbers = F.transform(F.split(raw, ","), lambda x: F.trim(x).try_cast("double"))
    return F.array_max(F.filter(numbers, lambda x: x.isNotNull() & ~F.isnan(x)))


def variant_frequency(fmt: Column, sample: Column) -> Column:
    """FREQ in per cent divided by 100; else alternative depth over DP, AD lists counted without their first element."""
    names, values = F.split(fmt, ":"), F.split(sample, ":")
    field = lambda n: F.get(values, F.array_position(names, n) - 1)
    has = lambda n: F.array_contains(names, n)
    percent = F.when(field("FREQ").endswith("%"), F.regexp_replace(field("FREQ"), "%$", "").try_cast("double") / 100.0)
    depths = F.transform(F.split(field("AD"), ","), lambda x: x.try_cast("double"))
    alt = F.when(F.size(depths) > 1, F.aggregate(F.slice(depths, 2, 1 << 20), F.lit(0.0), lambda s, x: s + x)).otherwise(F.get(depths, F.lit(0)))
    depth = field("DP").try_cast("double")
    from_depth = F.when(has("AD") & has("DP") & (depth > 0), alt / depth)
    freq = F.coalesce(percent, from_depth)
    return F.when(F.isnan(freq) | (F.abs(freq) == float("inf")), None).otherwise(freq)


def counts_text(barcodes_and_counts: Column) -> Column:
    """array<struct<bc, n>> as 'bc:n,...', sorted by barcode, positive counts only."""
    kept = F.array_sort(F.filter(barcodes_and_counts, lambda e: e["n"] > 0))
    return F.array_join(F.transform(kept, lambda e: F.concat(e["bc"], F.lit(":"), e["n"].cast("string"))), ",")


def counts_entries(text: Column) -> Column:
    """The reverse: split at the last ':'; parts that are no count are left out."""
    parts = F.transform(F.split(text, ","), lambda x: F.struct(F.regexp_extract(x, "^(.*):([^:]*)$", 1).alias("bc"), F.regexp_extract(x, "^(.*):([^:]*)$", 2).try_cast("int").alias("n")))
    return F.filter(parts, lambda e: (e["bc"] != "") & e["n"].isNotNull())


def after_last_underscore(cell: Column) -> Column:
    return F.substring_index(cell, "_", -1)


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9._-]", "_")

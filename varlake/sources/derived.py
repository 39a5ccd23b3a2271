"""Inputs derived from the provided tables, the same in Spark (functions) and in DuckDB (SQL below)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import variants as vt
from ..operators import calls, reads as rd

# Parameters that leave rows on small synthetic tables; the operators' own defaults differ.
PRIOR, ERROR, P_ALT, THRESHOLD = 0.02, 0.001, 0.5, 0.9925
SAMPLES = ["S0", "S1", "S2", "S3"]  # all that the reads have
JOINED_READS = 250_000  # about as many reads, and their lines, meet in a task
FILE_READS = 1_000_000  # about as many reads go into a file, so that no task's share grows with the tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_reads(spark: SparkSession, sf_dir: str, grown: bool = False) -> DataFrame:
    """Reads at sites, before any filter; flags mark duplicates and secondary ones. Barcodes are 50 a sample, or, grown, one for each customer
    with orders, so that cells grow with the tables."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    c = F.col
    part = c("l_partkey") % 24
    return rows.select(
        (c("l_orderkey") * 8 + c("l_linenumber")).alias("read_id"), F.concat(F.lit("S"), (c("c_nationkey") % 4).cast("string")).alias("sample"),
        F.concat(F.lit("CB"), F.lpad((c("o_custkey") if grown else c("o_custkey") % 50).cast("string"), 12 if grown else 4, "0")).alias("barcode"), F.concat(F.lit("U"), (c("l_suppkey") % 7).cast("string")).alias("umi"),
        F.when(part < 22, F.concat(F.lit("chr"), (part + 1).cast("string"))).when(part == 22, "chrX").otherwise("chrM").alias("chrom"),
        (F.lit(1000) + c("l_partkey") % 5).cast("int").alias("pos"), F.lit("A").alias("ref"), F.lit("G").alias("alt"),
        F.when(c("l_returnflag") == "R", "G").when(c("l_returnflag") == "N", "A").when(c("l_linestatus") == "O", "A").otherwise("T").alias("base"),
        c("l_quantity").cast("int").alias("base_q"), F.round(c("l_discount") * 600).cast("int").alias("map_q"),
        F.when(c("l_linenumber") == 7, 1024).when(c("l_linenumber") == 6, 256).when(c("l_linenumber") == 5, 16).otherwise(0).alias("flag"))


def read_files(spark: SparkSession, sf_dir: str, least: int) -> int:
    """How many files the reads are dealt to."""
    return max(least, -(-table(spark, sf_dir, "lineitem").count() // FILE_READS))


READS = """reads as (select l_orderkey*8+l_linenumber as read_id, concat('S', cast(c_nationkey%4 as varchar)) as sample,
  concat('CB', lpad(cast(o_custkey%50 as varchar),4,'0')) as barcode, concat('U', cast(l_suppkey%7 as varchar)) as umi,
  case when l_partkey%24<22 then concat('chr',cast(l_partkey%24+1 as varchar)) when l_partkey%24=22 then 'chrX' else 'chrM' end as chrom,
  cast(1000+l_partkey%5 as int) as pos, 'A' as ref, 'G' as alt,
  case when l_returnflag='R' then 'G' when l_returnflag='N' then 'A' when l_linestatus='O' then 'A' else 'T' end as base,
  cast(l_quantity as int) as base_q, cast(round(l_discount*600) as int) as map_q,
  case l_linenumber when 7 then 1024 when 6 then 256 when 5 then 16 else 0 end as flag
  from lineitem join orders on o_orderkey=l_orderkey join customer on c_custkey=o_custkey)"""
GROWN = READS.replace("lpad(cast(o_custkey%50 as varchar),4,'0')", "lpad(cast(o_custkey as varchar),12,'0')")
COUNTS = READS + """, counts as (select * from (select sample,barcode,chrom,pos,ref,alt,
  count(case when base=alt then 1 end) alt_reads, count(case when base=ref then 1 end) ref_reads,
  count(distinct case when base=alt then umi end) alt_umis, count(distinct case when base=ref then umi end) ref_umis
  from reads where base_q>=20 and map_q>=20 group by all) where alt_reads>0 or ref_reads>0)"""
OBS = COUNTS + f""", post as (select *, case when alt_reads=0 and ref_reads>0 then
  (1-{PRIOR})*pow(1-{ERROR}::double,ref_reads)/((1-{PRIOR})*pow(1-{ERROR}::double,ref_reads)+{PRIOR}*pow(1-{P_ALT}::double,ref_reads)) end p from counts),
obs as (select sample, barcode, concat(sample,'_',barcode) cell, concat(chrom,':',cast(pos as varchar),'_',ref,'>',alt) snv,
  alt_reads alt_count, ref_reads ref_count, p posterior,
  cast(case when alt_reads>0 then 1 when ref_reads>0 and (p is null or p>={THRESHOLD}) then -1 else 0 end as int) call from post)"""
CELLS = """cells as (select distinct sample, barcode, concat(sample,'_',barcode) cell, concat('T', cast(cast(substr(barcode,3,4) as int)%3 as varchar)) celltype from reads)"""
LISTED = CELLS + """, listed as (select sample, barcode from cells union select sample, concat('NONE', cast(g as varchar)) from cells, range(2) t(g))"""
SCORES = """scores as (select celltype, snv, round(avg(cast(alt_count as double)/(alt_count+ref_count)),9) score_euclidean,
  round(avg(cast(ref_count as double)/(alt_count+ref_count)),9) score_cosine_distance,
  row_number() over (order by celltype, snv) ord from obs join cells using (cell) group by celltype, snv)"""
ALL = OBS + ", " + CELLS + ", " + SCORES
VCF = READS + """, vn as (select sample,chrom,pos,ref,alt,count(*) n,count(case when base=alt then 1 end) a from reads group by all),
vcf as (select sample, cast(substr(sample,2) as int) sample_ix, row_number() over (partition by sample order by chrom,pos) line, chrom,pos,ref,alt,n,a,
  concat('DP=',cast(n as varchar),';SOMATIC;gnomad_AF=',case pos%5 when 0 then '.' when 1 then '0.0005,0.02' else concat('0.000',cast(pos%5 as varchar)) end) info,
  'GT:DP:AD:FREQ' format,
  concat('0/1:',cast(n as varchar),':',cast(a as varchar),':',case when (n+pos)%7=0 then '.' else concat(cast(cast(floor(100.0*a/n) as int) as varchar),'%') end) sample_text from vn),
freqs as (select *, case when (n+pos)%7=0 then case when n>0 then cast(a as double)/n end else cast(cast(floor(100.0*a/n) as int) as double)/100.0 end freq from vcf)"""
BED = """bed as (select distinct chrom, pos-2 as "start", pos as "end" from reads where pos=1002 or (pos=1004 and chrom='chr3'))"""
AF = VCF + """, lookup as (select concat(chrom,':',cast(pos as varchar),'_',ref,'>',alt) key, max(case pos%5 when 0 then null when 1 then 0.02::double else cast(concat('0.000',cast(pos%5 as varchar)) as double) end) af,
  count(*) records from vcf where sample_ix<3 and chrom<>'chr5' group by 1),
snvs as (select distinct concat(chrom,':',cast(pos as varchar),'_',ref,'>',alt) snv from reads union select distinct concat(substr(chrom,4),':',cast(pos as varchar),'_',ref,'>',alt) from reads where pos=1003),
tog as (select snv, case when starts_with(snv,'chr') then substr(snv,4) else concat('chr',snv) end other from snvs),
hits as (select snv, case when a.key is not null then a.key else b.key end matched_key, case when a.key is not null then a.af else b.af end af
  from tog left join lookup a on a.key=snv left join lookup b on b.key=other),
details as (select *, matched_key is not null found, af is not null as "numeric", coalesce(af>0.001,false) removed from hits)"""
_RNA = """, rna as (select concat(sample,'_',barcode) cell, sample batch, concat(case when l_partkey%97<3 then 'MT-G' else 'G' end, cast(l_partkey%97 as varchar)) gene, cast(sum(l_linenumber) as double) cnt
  from reads join lineitem on read_id=l_orderkey*8+l_linenumber group by all),
totals as (select cell, batch, sum(cnt) total, sum(case when gene like 'MT-%' then cnt else 0.0 end) mt, count(case when cnt>0 then 1 end) genes from rna group by all)"""
RNA, GROWN_RNA = READS + _RNA, GROWN + _RNA


def counts(spark: SparkSession, sf_dir: str, grown: bool = False) -> DataFrame:
    return rd.in_unit(rd.pileup(rd.kept_by_quality(all_reads(spark, sf_dir, grown))))


def matrix(spark: SparkSession, sf_dir: str, grown: bool = False) -> DataFrame:
    return calls.call_matrix(counts(spark, sf_dir, grown), PRIOR, P_ALT, ERROR, THRESHOLD)


def cells(spark: SparkSession, sf_dir: str, grown: bool = False) -> DataFrame:
    rows = all_reads(spark, sf_dir, grown).select("sample", "barcode").distinct()
    return rows.select("sample", "barcode", F.concat("sample", F.lit("_"), "barcode").alias("cell"), F.concat(F.lit("T"), (F.substring("barcode", 3, 12).cast("int") % 3).cast("string")).alias("celltype"))


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All barcodes of the reads, and in every sample two that no read has."""
    rows = all_reads(spark, sf_dir).select("sample", "barcode").distinct()
    extra = rows.select("sample").distinct().select("sample", F.explode(F.array(F.lit("NONE0"), F.lit("NONE1"))).alias("barcode"))
    return rows.union(extra)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    total = F.col("alt_count") + F.col("ref_count")
    rows = matrix(spark, sf_dir).join(cells(spark, sf_dir).select("cell", "celltype"), "cell")
    out = rows.groupBy("celltype", "snv").agg(F.round(F.avg(F.col("alt_count") / total), 9).alias("score_euclidean"), F.round(F.avg(F.col("ref_count") / total), 9).alias("score_cosine_distance"))
    return out.withColumn("ord", F.row_number().over(Window.orderBy("celltype", "snv")))


def vcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four single-sample files below each other, with their lines numbered."""
    from pyspark.sql import Window

    sites = all_reads(spark, sf_dir).groupBy("sample", *rd.SITE).agg(F.count("*").alias("n"), F.count_if(F.col("base") == F.col("alt")).alias("a"))
    text = lambda c: F.col(c).cast("string")
    mod = F.col("pos") % 5
    af = F.when(mod == 0, ".").when(mod == 1, "0.0005,0.02").otherwise(F.concat(F.lit("0.000"), mod.cast("string")))
    freq = F.when((F.col("n") + F.col("pos")) % 7 == 0, ".").otherwise(F.concat(F.floor(100.0 * F.col("a") / F.col("n")).cast("int").cast("string"), F.lit("%")))
    return sites.select(
        "sample", F.substring("sample", 2, 9).cast("int").alias("sample_ix"), F.row_number().over(Window.partitionBy("sample").orderBy("chrom", "pos")).alias("line"), *rd.SITE,
        F.concat(F.lit("DP="), text("n"), F.lit(";SOMATIC;gnomad_AF="), af).alias("info"), F.lit("GT:DP:AD:FREQ").alias("format"),
        F.concat(F.lit("0/1:"), text("n"), F.lit(":"), text("a"), F.lit(":"), freq).alias("sample_text"))


def bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = all_reads(spark, sf_dir).filter("pos = 1002 or (pos = 1004 and chrom = 'chr3')")
    return rows.select("chrom", (F.col("pos") - 2).alias("start"), F.col("pos").alias("end")).distinct()


def snvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant names, some of them also without chr."""
    rows = all_reads(spark, sf_dir).select(*rd.SITE).distinct()
    key = vt.snv_key(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt"))
    bare = rows.filter("pos = 1003").select(F.substring(key, 4, 99).alias("snv"))
    return rows.select(key.alias("snv")).union(bare).distinct()


def rna(spark: SparkSession, sf_dir: str, grown: bool = False) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("read_id"), "l_partkey", "l_linenumber")
    g = F.col("l_partkey") % 97
    rows = all_reads(spark, sf_dir, grown)
    if grown:
        parts = -(-table(spark, sf_dir, "lineitem").count() // JOINED_READS)
        if parts > spark.sparkContext.defaultParallelism:  # few partitions, or such that are merged by their compressed size, grow with the tables
            rows, lines = rows.select("read_id", "sample", "barcode").repartition(parts, "read_id"), lines.repartition(parts, "read_id")
    rows = rows.join(lines, "read_id")
    return rows.groupBy(F.concat("sample", F.lit("_"), "barcode").alias("cell"), F.col("sample").alias("batch"), F.concat(F.when(g < 3, "MT-G").otherwise("G"), g.cast("string")).alias("gene")).agg(F.sum("l_linenumber").cast("double").alias("cnt"))


def carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir).filter("call = 1").join(cells(spark, sf_dir).select("cell", "celltype"), "cell").select("celltype", "sample", "cell", "snv")

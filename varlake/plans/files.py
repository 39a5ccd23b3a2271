"""Queries that write a format and read it back."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import calls, reads as rd
from ..operators.quantiles import running
from ..sources import derived as d
from ..sources import bam, stages, tables, text
from ..sources.folder import Tables, shared_folder
from .register import query

SITE = "chrom, pos, ref, alt"


@query("snk_vcf", f"with {d.VCF} select sample, {SITE}, info, sample_text from vcf")
def snk_vcf(spark, sf_dir):
    """A file for every sample."""
    paths = {s: shared_folder(spark, "vcf") for s in d.SAMPLES}
    with Tables(spark, "vcf-work") as held:
        lines = held.save(d.vcf(spark, sf_dir), "lines")  # once for all samples
        for s, path in paths.items():
            text.write_vcf(lines.filter(F.col("sample") == s), path, ["##fileformat=VCFv4.2", "#CHROM"])
    return text.read_vcf(spark, paths).select("sample", "chrom", "pos", "ref", "alt", "info", "sample_text")


@query("snk_cbcount", f"with {d.COUNTS}, {d.LISTED}, s as (select sample,barcode,concat(chrom,':',cast(pos as varchar),'(',ref,'->',alt,')') v from counts where alt_reads>0) select c.sample, c.barcode, cast(count(v) as int) n, coalesce(string_agg(v,',' order by v),'') variants from listed c left join s using (sample,barcode) group by c.sample, c.barcode")
def snk_cbcount(spark, sf_dir):
    """A folder of lines for every sample."""
    path = shared_folder(spark, "cb")
    tables.write_cell_counts(rd.variants_per_cell(d.listed(spark, sf_dir), d.counts(spark, sf_dir)), path, by="sample")
    t = F.split("value", "\t")
    return spark.read.text(path).select("sample", t[0].alias("barcode"), t[1].cast("int").alias("n"), t[2].alias("variants"))


@query("snk_h5ad", f"with {d.OBS} select sample, cell, snv, call from obs")
def snk_h5ad(spark, sf_dir):
    """The matrix with its cells and variants as tables."""
    path = shared_folder(spark, "matrix")
    m = d.matrix(spark, sf_dir)
    tables.write_matrix(m, d.cells(spark, sf_dir), m.select("snv").distinct(), path)
    return tables.read_matrix(spark, path)[0].select("sample", "cell", "snv", "call")


@query("src_h5ad", f"with {d.OBS}, {d.CELLS} select (select count(*) from obs) x, (select count(*) from cells) obs_, (select count(distinct snv) from obs) var_")
def src_h5ad(spark, sf_dir):
    path = shared_folder(spark, "matrix")
    m = d.matrix(spark, sf_dir)
    tables.write_matrix(m, d.cells(spark, sf_dir), m.select("snv").distinct(), path)
    x, obs, var = tables.read_matrix(spark, path)
    return x.agg(F.count("*").alias("x")).join(obs.agg(F.count("*").alias("obs_"))).join(var.agg(F.count("*").alias("var_")))


@query("mx_sparse", f"with {d.OBS} select cell, count(*) stored, cast(sum(call) as bigint) total from obs group by cell")
def mx_sparse(spark, sf_dir):
    """The long form is the sparse matrix: absent pairs are zeros of a row sum."""
    return d.matrix(spark, sf_dir).groupBy("cell").agg(F.count("*").alias("stored"), F.sum("call").alias("total"))


@query("snk_csv", f"with {d.ALL} select celltype, snv, score_euclidean from scores")
def snk_csv(spark, sf_dir):
    path = shared_folder(spark, "csv")
    tables.write_text_table(d.scores(spark, sf_dir).select("celltype", "snv", "score_euclidean"), path, by="celltype")
    return spark.read.schema("snv string, score_euclidean double, celltype string").option("header", True).csv(path).select("celltype", "snv", "score_euclidean")


@query("snk_tsv", f"with {d.OBS} select sample, count(*) n, round(min(posterior),9) min, round(max(posterior),9) max from obs where call=-1 and posterior>0 group by sample")
def snk_tsv(spark, sf_dir):
    path = shared_folder(spark, "tsv")
    tables.write_text_table(calls.posterior_summary(d.matrix(spark, sf_dir), ["sample"]).select("sample", "n", F.round("min", 9).alias("min"), F.round("max", 9).alias("max")), path, "\t")
    return tables.read_text_table(spark, path, "sample string, n long, min double, max double", "\t")


@query("snk_plot", f"with {d.OBS}, h as (select sample, cast(least(floor(posterior*60),59) as int) bin, count(*) n from obs where call=-1 and posterior>0 group by all) select s.sample, cast(b as int) bin, coalesce(n,0) n, b/60.0 low, (b+1)/60.0 high from (select distinct sample from obs) s cross join range(60) t(b) left join h on h.bin=b and h.sample=s.sample")
def snk_plot(spark, sf_dir):
    """The table behind the histogram of each sample, written as text: every bin with its bounds, empty ones too."""
    path = shared_folder(spark, "plot")
    m = d.matrix(spark, sf_dir)
    tables.write_text_table(calls.histogram_table(m, "sample"), path, "\t")
    return tables.read_text_table(spark, path, "sample string, bin int, low double, high double, n long", "\t")


@query("src_bam", f"""with {d.READS} select cast(read_id as varchar) as name, cast(flag as int) flag, chrom, pos as start, cast(map_q as int) map_q, '1M' cigar, base as seq, chr(cast(base_q+33 as int)) qual, concat(sample,'_',barcode) barcode, umi from reads""")
def src_bam(spark, sf_dir):
    """BAM files that are written from all reads: each is read by as many tasks as it has splits."""
    path = shared_folder(spark, "bam")
    reads = d.all_reads(spark, sf_dir).select(
        F.col("read_id").cast("string").alias("name"), F.col("flag").cast("int").alias("flag"), "chrom", F.col("pos").alias("start"), F.col("map_q").cast("int").alias("map_q"), F.lit("1M").alias("cigar"),
        F.col("base").alias("seq"), F.char(F.col("base_q") + 33).alias("qual"), F.concat_ws("_", "sample", "barcode").alias("barcode"), "umi")
    contigs = [(f"chr{c}", 10_000) for c in [*range(1, 23), "X", "M"]]
    # by name, too: reads of one site may be more than a file's
    bam.write_bam(reads.repartitionByRange(d.read_files(spark, sf_dir, 2), "chrom", "start", "name").sortWithinPartitions("chrom", "start"), path, contigs)
    return bam.read_bam(spark, path)


@query("snk_npy", f"with {d.OBS} select snv, cast(row_number() over (order by snv)-1 as int) ix from (select distinct snv from obs)")
def snk_npy(spark, sf_dir):
    """A name list is a table with its order."""
    path = shared_folder(spark, "names")
    d.matrix(spark, sf_dir).select("snv").distinct().withColumn("ix", F.row_number().over(Window.orderBy("snv")) - 1).write.parquet(path)
    return spark.read.parquet(path)


@query("src_npy", f"with {d.OBS} select sample as list, cast(row_number() over (partition by sample order by snv)-1 as int) ix, snv as name from (select distinct sample, snv from obs)")
def src_npy(spark, sf_dir):
    """The variants of each sample as an array file, read as names with their places."""
    path = shared_folder(spark, "lists")
    names = d.matrix(spark, sf_dir).select(F.col("sample").alias("list"), F.col("snv").alias("name")).distinct()
    tables.write_name_lists(names.withColumn("ix", F.row_number().over(Window.partitionBy("list").orderBy("name"))), path)
    return tables.read_name_lists(spark, path)


@query("snk_atomic", """select 'failed' step, 0 n from customer having count(*) > 0 union all select 'rerun', count(*) from customer union all select 'same settings', count(*) from customer
 union all select 'failed with other settings', count(*) from customer union all select 'other settings', count(*) from customer where c_custkey % 2 = 0""")
def snk_atomic(spark, sf_dir):
    """What can be read after each step: a write that fails half-way leaves what was there, and a rerun completes it."""
    path, rows, seen = shared_folder(spark, "stage"), d.table(spark, sf_dir, "customer").select("c_custkey"), []

    def step(name, settings, make):
        try:
            stages.run_stage(spark, path, settings, make)
        except PySparkException:
            pass
        held = stages.read_stage(spark, path)["second"] if stages.manifest(spark, path) else rows.limit(0)
        # written, for the next step may replace what can be read now
        held.agg(F.count("*").alias("n")).select(F.lit(name).alias("step"), "n").write.parquet(f"{path}-seen/{len(seen)}")
        seen.append(name)

    half = {"first": rows, "second": rows.select(F.when(F.col("c_custkey") % 5 == 3, F.raise_error(F.lit("half-way"))).otherwise(F.col("c_custkey")).cast("long").alias("c_custkey"))}
    step("failed", {"least": 1}, lambda: half)
    step("rerun", {"least": 1}, lambda: {"first": rows, "second": rows})
    step("same settings", {"least": 1}, lambda: {"first": rows.limit(1), "second": rows.limit(1)})
    step("failed with other settings", {"least": 2}, lambda: half)
    step("other settings", {"least": 2}, lambda: {"first": rows, "second": rows.filter("c_custkey % 2 = 0")})
    return spark.read.parquet(*(f"{path}-seen/{i}" for i in range(len(seen))))


@query("src_cb_sc", "select distinct concat('CB',cast(c_custkey%300 as varchar)) barcode from customer")
def src_cb_sc(spark, sf_dir):
    path = shared_folder(spark, "cb")
    d.table(spark, sf_dir, "customer").select(F.concat(F.lit("CB"), (F.col("c_custkey") % 300).cast("string"))).distinct().write.csv(path)
    return text.read_barcodes(spark, path)


@query("src_cb_spatial", "select concat('CB',cast(c_custkey as varchar)) barcode, cast(c_custkey%17 as int) x, cast(c_nationkey as int) y from customer where c_custkey%3<>0")
def src_cb_spatial(spark, sf_dir):
    path = shared_folder(spark, "spatial")
    k = F.col("c_custkey")
    d.table(spark, sf_dir, "customer").select(F.concat(F.lit("CB"), k.cast("string")), F.when(k % 3 != 0, 1).otherwise(0), k % 17, "c_nationkey", k * 1.5, k * 2.5).write.csv(path)
    return text.read_barcodes(spark, path, "spatial").select("barcode", "x", "y")


@query("src_ann", "select cast(p_partkey as int) as row, p_brand gene, cast(1000+p_partkey%5 as int) as start from part")
def src_ann(spark, sf_dir):
    """A file whose extension says comma but which is tab-separated."""
    path = shared_folder(spark, "ann") + ".csv"
    k = F.col("p_partkey")
    d.table(spark, sf_dir, "part").select(k.alias("row"), F.col("p_brand").alias("gene"), (1000 + k % 5).alias("start")).write.option("header", True).option("sep", "\t").csv(path)
    return text.read_annotation(spark, path).select(F.col("row").cast("int").alias("row"), "gene", F.col("start").cast("int").alias("start"))


@query("src_fasta", "select concat('c',cast(n_nationkey as varchar)) contig, upper(concat(repeat('acgt',3),substr('acgtacgtacgtacgtacgtacgtacgtacgt',1,cast(n_nationkey as int)))) as sequence from nation")
def src_fasta(spark, sf_dir):
    path = shared_folder(spark, "fasta")
    k = F.col("n_nationkey")
    record = F.concat(F.lit(">c"), k.cast("string"), F.lit(" x\nacgtacgt\nacgt\n"), F.substring(F.lit("acgtacgtacgtacgtacgtacgtacgtacgt"), F.lit(1), k.cast("int")))
    d.table(spark, sf_dir, "nation").select(record).coalesce(1).write.text(path)
    return text.read_fasta(spark, path)


@query("win_cumw", f"with {d.COUNTS}, r as (select sample, {SITE}, sum(alt_reads) a, sum(alt_reads+ref_reads) w from counts where alt_reads>=2 group by all) select sample, {SITE}, cast(sum(w) over (partition by sample order by cast(a as double)/w, {SITE} rows unbounded preceding) as bigint) running from r")
def win_cumw(spark, sf_dir):
    """The weight up to each variant's share of reads, the step before a weighted median."""
    c = d.counts(spark, sf_dir).filter("alt_reads >= 2")
    per = c.groupBy("sample", *rd.SITE).agg(F.sum("alt_reads").alias("a"), F.sum(F.col("alt_reads") + F.col("ref_reads")).alias("w"))
    rows = per.select("sample", (F.col("a") / F.col("w")).alias("share"), *rd.SITE, "w")
    return running(rows, ["sample"], ["share"], "w").select("sample", *rd.SITE, F.col("running").cast("long").alias("running"))

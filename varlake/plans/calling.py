"""Queries from reads to the call matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import statistics as st
from ..operators import calls, reads as rd
from ..sources import derived as d
from ..sources.folder import shared_folder
from .register import query

SITE = "chrom, pos, ref, alt"


@query("call_matrix", f"with {d.OBS} select sample, cell, snv, alt_count, ref_count, round(posterior,9) posterior, call from obs")
def call_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.matrix(spark, sf_dir).withColumn("posterior", F.round("posterior", 9))


@query("flt_reads", f"with {d.READS} select read_id, sample, barcode, flag, map_q from reads where (flag & 1804)=0 and map_q>=20")
def flt_reads(spark, sf_dir):
    return rd.kept_by_flag(d.all_reads(spark, sf_dir)).select("read_id", "sample", "barcode", "flag", "map_q")


@query("flt_baseq", f"with {d.READS} select read_id, base_q, map_q from reads where base_q>=20 and map_q>=20")
def flt_baseq(spark, sf_dir):
    return rd.kept_by_quality(d.all_reads(spark, sf_dir)).select("read_id", "base_q", "map_q")


@query("flt_depth", f"with {d.READS}, deep as (select sample,{SITE} from reads group by all having count(*)>130) select read_id, sample, chrom, pos from reads anti join deep using (sample,{SITE})")
def flt_depth(spark, sf_dir):
    return rd.without_deep_sites(d.all_reads(spark, sf_dir), 130).select("read_id", "sample", "chrom", "pos")


@query("flt_tagged", f"with {d.READS}, t as (select *, case when barcode='CB0007' then null else barcode end b, case when base='T' then null else base end x from reads) select read_id, b barcode, x base from t where b is not null and x is not null")
def flt_tagged(spark, sf_dir):
    rows = d.all_reads(spark, sf_dir).withColumns({"barcode": F.when(F.col("barcode") != "CB0007", F.col("barcode")), "base": F.when(F.col("base") != "T", F.col("base"))})
    return rd.tagged(rows).select("read_id", "barcode", "base")


@query("jn_whitelist", f"with {d.READS}, {d.CELLS} select read_id, sample, barcode from reads semi join (select * from cells where celltype='T1') c using (sample,barcode)")
def jn_whitelist(spark, sf_dir):
    return rd.listed(d.all_reads(spark, sf_dir), d.cells(spark, sf_dir).filter("celltype = 'T1'")).select("read_id", "sample", "barcode")


@query("jn_pileup", f"with {d.READS}, s as (select distinct {SITE} from reads where pos>1001) select read_id, reads.chrom, reads.pos, s.ref, s.alt, base from reads join s on reads.chrom=s.chrom and reads.pos=s.pos")
def jn_pileup(spark, sf_dir):
    reads = d.all_reads(spark, sf_dir)
    return rd.at_sites(reads, reads.filter("pos > 1001")).select("read_id", "chrom", "pos", "ref", "alt", "base")


@query("agg_pileup", f"with {d.COUNTS} select * from counts")
def agg_pileup(spark, sf_dir):
    return d.counts(spark, sf_dir).drop("alt_count", "ref_count")


@query("agg_countunit", f"with {d.COUNTS} select sample,barcode,{SITE}, case when alt_umis>0 then alt_umis else alt_reads end alt_count, case when ref_umis>0 then ref_umis else ref_reads end ref_count from counts")
def agg_countunit(spark, sf_dir):
    return rd.in_unit(d.counts(spark, sf_dir), "umis").select("sample", "barcode", *rd.SITE, "alt_count", "ref_count")


@query("jn_novar", f"with {d.COUNTS}, a as (select distinct sample,barcode,{SITE} from counts where alt_reads>0) select sample,barcode,{SITE},ref_reads from (select * from counts where ref_reads>0) r anti join a using (sample,barcode,{SITE})")
def jn_novar(spark, sf_dir):
    return rd.reference_only(d.counts(spark, sf_dir)).select("sample", "barcode", *rd.SITE, "ref_reads")


@query("jn_altref", f"with {d.COUNTS} select a.sample,a.barcode,a.chrom,a.pos,a.alt_reads,coalesce(r.ref_reads,0) ref_reads from counts a left join (select * from counts where ref_reads>0) r using (sample,barcode,{SITE}) where a.alt_reads>0")
def jn_altref(spark, sf_dir):
    return d.counts(spark, sf_dir).filter("alt_reads > 0").select("sample", "barcode", "chrom", "pos", "alt_reads", "ref_reads")


@query("agg_cbcount", f"with {d.COUNTS}, {d.LISTED}, s as (select sample,barcode,concat(chrom,':',cast(pos as varchar),'(',ref,'->',alt,')') v from counts where alt_reads>0) select c.sample,c.barcode,count(v) n, coalesce(string_agg(v,',' order by v),'') variants from listed c left join s using (sample,barcode) group by all")
def agg_cbcount(spark, sf_dir):
    return rd.variants_per_cell(d.listed(spark, sf_dir), d.counts(spark, sf_dir))


@query("snk_sidecar", f"with {d.COUNTS} select sample,{SITE}, string_agg(concat(barcode,':',cast(alt_reads as varchar)),',' order by barcode) payload from counts where alt_reads>0 group by all")
def snk_sidecar(spark, sf_dir):
    return rd.sidecar(d.counts(spark, sf_dir), "alt", "counts")


@query("src_sidecar", f"with {d.COUNTS} select sample, {SITE}, barcode bc, cast(ref_reads as int) n from counts where ref_reads>0 and cast(substr(barcode,3) as int)%3=1")
def src_sidecar(spark, sf_dir):
    """Written as text payloads and read again, with the whitelist applied."""
    from ..functions.variants import counts_entries

    text = rd.sidecar(d.counts(spark, sf_dir), "ref", "counts").withColumn("e", F.explode(counts_entries(F.col("payload"))))
    listed = d.cells(spark, sf_dir).filter("celltype = 'T1'").select(F.col("sample"), F.col("barcode").alias("bc"))
    return text.select("sample", *rd.SITE, "e.bc", "e.n").join(listed, ["sample", "bc"], "left_semi")


@query("fn_posterior", f"with {d.OBS} select sample, cell, snv, round(posterior,9) posterior from obs where posterior is not null")
def fn_posterior(spark, sf_dir):
    return d.matrix(spark, sf_dir).filter("posterior is not null").select("sample", "cell", "snv", F.round("posterior", 9).alias("posterior"))


@query("fn_call", f"with {d.OBS} select call, count(*) n, cast(sum(alt_count) as bigint) alts, cast(sum(ref_count) as bigint) refs from obs group by call")
def fn_call(spark, sf_dir):
    return d.matrix(spark, sf_dir).groupBy("call").agg(F.count("*").alias("n"), F.sum("alt_count").alias("alts"), F.sum("ref_count").alias("refs"))


@query("fn_prior", f"with {d.VCF} select sample, chrom, pos, round(greatest(1e-9,least(1-1e-9,case when freq is null then 0.001 else least(0.95,greatest(0.001,2.0*freq)) end)),9) prior from freqs")
def fn_prior(spark, sf_dir):
    from ..operators.vcf import with_frequency

    return with_frequency(d.vcf(spark, sf_dir)).select("sample", "chrom", "pos", F.round(st.variant_prior(F.col("freq")), 9).alias("prior"))


@query("jn_prior", f"with {d.VCF}, k as (select *, concat(chrom,':',cast(pos as varchar),'_',ref,'>',alt) snv from freqs), o as ({'with ' + d.OBS} select sample,cell,snv,ref_count from obs where posterior is not null) select o.sample, cell, o.snv, round(case when k.freq is null then 0.001 else least(0.95,greatest(0.001,2.0*k.freq)) end,9) prior from o left join (select * from k where sample_ix<3) k on k.sample=o.sample and k.snv=o.snv")
def jn_prior(spark, sf_dir):
    from ..operators.vcf import frequencies

    freqs = frequencies(d.vcf(spark, sf_dir).filter("sample_ix < 3"))
    rows = d.matrix(spark, sf_dir).filter("posterior is not null").join(freqs, ["sample", "snv"], "left")
    return rows.select("sample", "cell", "snv", F.round(st.variant_prior(F.col("freq")), 9).alias("prior"))


@query("agg_wmedian", f"with {d.COUNTS}, v as (select sample, cast(alt_reads as double)/(alt_reads+ref_reads) v, alt_reads+ref_reads w from counts), s as (select sample, v, sum(w) w from v group by all), r as (select *, sum(w) over (partition by sample order by v) run, sum(w) over (partition by sample)/2.0 half from s) select sample, min(v) weighted_median from r where run>=half group by sample")
def agg_wmedian(spark, sf_dir):
    rows = d.counts(spark, sf_dir).select("sample", (F.col("alt_reads") / (F.col("alt_reads") + F.col("ref_reads"))).alias("v"), (F.col("alt_reads") + F.col("ref_reads")).alias("w"))
    return calls.weighted_median(rows, ["sample"], "v", "w")


_PEST = f"""with {d.COUNTS}, k as (select * from counts where alt_reads>=2 and alt_reads+ref_reads>=2),
per as (select sample,{SITE},sum(alt_reads) a,sum(alt_reads+ref_reads) w,count(*) n from k group by all),
s as (select sample, cast(a as double)/w v, sum(w) w from per group by all), r as (select *, sum(w) over (partition by sample order by v) run, sum(w) over (partition by sample)/2.0 half from s),
m as (select sample, min(v) med from r where run>=half group by sample), o as (select sample, cast(sum(n) as bigint) observations, count(*) snvs from per group by sample)
select c.sample, coalesce(observations,0) observations, coalesce(snvs,0) snvs, round(greatest(1e-9,least(1-1e-9,case when observations>=25 and snvs>=5 then med else 0.5 end)),9) p_alt
from (select distinct sample from counts) c left join o using (sample) left join m using (sample)"""


@query("agg_pest", _PEST)
def agg_pest(spark, sf_dir):
    return calls.variant_read_share(d.counts(spark, sf_dir)).withColumn("p_alt", F.round("p_alt", 9))


_Q = ", ".join(f"round(quantile_cont(posterior,{q}),9) {n}" for n, q in calls.QUANTILES.items())


@query("agg_negsum", f"with {d.OBS} select sample, count(*) n, round(avg(posterior),9) mean, round(stddev_pop(posterior),9) std, round(min(posterior),9) min, {_Q}, round(max(posterior),9) max from obs where call=-1 and posterior>0 group by sample")
def agg_negsum(spark, sf_dir):
    out = calls.posterior_summary(d.matrix(spark, sf_dir), ["sample"])
    return out.select("sample", "n", *(F.round(c, 9).alias(c) for c in out.columns[2:]))


@query("agg_hist", f"with {d.OBS} select sample, cast(least(floor(posterior*60),59) as int) bin, count(*) n from obs where call=-1 and posterior>0 group by all")
def agg_hist(spark, sf_dir):
    return calls.histogram(d.matrix(spark, sf_dir), ["sample"])


@query("jn_merge", f"with {d.OBS} select sample, cell, snv, call from obs")
def jn_merge(spark, sf_dir):
    """The matrices of all samples, each from its own files."""
    path = shared_folder(spark, "merge")
    d.matrix(spark, sf_dir).select("sample", "cell", "snv", "call").write.partitionBy("sample").parquet(path)
    per = spark.read.parquet(path)
    return calls.merged([per.filter(F.col("sample") == s).select("sample", "cell", "snv", "call") for s in d.SAMPLES])


@query("set_snvs", f"with {d.OBS} select distinct snv from obs order by snv")
def set_snvs(spark, sf_dir):
    m = d.matrix(spark, sf_dir)
    return m.filter("alt_count > 0").select("snv").union(m.filter("ref_count > 0").select("snv")).distinct().orderBy("snv")


# variant reads and more against the same number with the error's share of variants, summed over the hypergeometric terms
_CALL = f"""with {d.READS}, b as (select sample,chrom,pos,ref,base,count(*) n, sum(case when (flag & 16) = 0 then 1 else 0 end) fw from reads group by all),
t as (select *, sum(n) over (partition by sample,chrom,pos,ref) depth, sum(case when base=ref then n else 0 end) over (partition by sample,chrom,pos,ref) rn, sum(case when base=ref then fw else 0 end) over (partition by sample,chrom,pos,ref) rf from b),
c as (select *, cast(floor(rn*0.001+n*0.001) as bigint) e from t where base<>ref and base in ('A','C','G','T') and depth>=8 and n>=3 and cast(n as double)/depth>=0.01),
k as (select *, unnest(range(cast(n as bigint), cast(n+least(rn,e)+1 as bigint))) x from c),
h as (select sample,chrom,pos,ref,base,n,fw,depth,rn,rf, least(1.0, sum(exp(lgamma(n+e+1.0)-lgamma(x+1.0)-lgamma(n+e-x+1.0) + lgamma(2.0*(n+rn)-n-e+1.0)-lgamma(n+rn-x+1.0)-lgamma((n+rn)*2.0-n-e-(n+rn-x)+1.0) - lgamma(2.0*(n+rn)+1.0)+2*lgamma(n+rn+1.0)))) p from k group by all)
select sample,chrom,pos,ref,base alt,cast(depth as bigint) depth,cast(n as bigint) alt_reads,round(cast(n as double)/depth,9) as share,round(p,9) p_value,cast(fw as bigint) forward from h
where p<=0.99 and (greatest(fw,n-fw)/cast(n as double)<=0.9 or (rn>0 and greatest(rf,rn-rf)/cast(rn as double)>0.9))"""


@query("vc_call", _CALL)
def vc_call(spark, sf_dir):
    from ..operators.vcf import called_variants

    return called_variants(d.all_reads(spark, sf_dir)).withColumn("share", F.round("share", 9)).withColumn("p_value", F.round("p_value", 9))


_CIGARS = """r as (select l_orderkey*8+l_linenumber id, cast(l_partkey as int) st, cast(l_linenumber as int) k from lineitem),
ops as (select * from (values (1,0,4,0,0),(1,1,3,5,6), (2,0,8,0,0), (3,0,5,2,0),(3,1,1,7,1009), (4,0,2,3,0),(4,1,3,5,2),(4,2,3,8,105), (5,0,4,0,0),(5,1,4,4,4), (6,0,1,1,0),(6,1,3,2,4),(6,2,3,5,7)) t(k, piece, len, q, r))"""


@query("vc_mpileup", f"""with {_CIGARS}, b as (select id, st, ops.r, q, len, unnest(range(len)) o from r join ops on ops.k=r.k)
select id read_id, 'chr1' chrom, cast(st+r+o as int) pos, substr('ACGTTGCAACG', cast(q+o+1 as int), 1) base, cast(ascii(substr('IIII5IJKFGH', cast(q+o+1 as int), 1))-33 as int) base_q from b""")
def vc_mpileup(spark, sf_dir):
    """Alignments of several kinds along their CIGARs, one row per aligned base: insertion, deletion, skip, clips, matches and mismatches apart, and none."""
    cigars = ["4M1I2D3M", "8M", "2S5M1004N1M3H", "3S2M3=100N3X", "4=4X", "1S1M3D3M3M", "*"]
    k = F.col("l_linenumber")
    cigar = F.element_at(F.array(*map(F.lit, cigars)), k)
    rows = d.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + k).alias("read_id"), F.lit("chr1").alias("chrom"), F.col("l_partkey").cast("int").alias("start"), cigar.alias("cigar"), F.lit("ACGTTGCAACG").alias("seq"), F.lit("IIII5IJKFGH").alias("qual"))
    return rd.exploded_alignments(rows).select("read_id", "chrom", "pos", "base", "base_q")

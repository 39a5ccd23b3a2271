"""Queries on variant records, unions, allele frequencies and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vcf as v
from ..sources import derived as d
from ..sources import text
from ..sources.folder import shared_folder
from .register import query

SITE = "chrom, pos, ref, alt"


@query("fn_freq", f"with {d.VCF} select sample, chrom, pos, round(freq,9) freq from freqs")
def fn_freq(spark, sf_dir):
    return v.with_frequency(d.vcf(spark, sf_dir)).select("sample", "chrom", "pos", F.round("freq", 9).alias("freq"))


@query("flt_vcf_freq", f"with {d.VCF} select sample, {SITE}, sample_text from freqs where freq is not null and freq*100<50")
def flt_vcf_freq(spark, sf_dir):
    return v.kept_by_frequency(d.vcf(spark, sf_dir), 50).select("sample", *v.SITE, "sample_text")


@query("src_vcf", f"with {d.VCF} select sample, chrom, pos, info, cast(n as varchar) dp, case when pos%5=0 then '.' when pos%5=1 then '0.0005,0.02' else concat('0.000',cast(pos%5 as varchar)) end af from vcf")
def src_vcf(spark, sf_dir):
    from ..functions.variants import info_map

    rows = d.vcf(spark, sf_dir).withColumn("m", info_map(F.col("info")))
    return rows.select("sample", "chrom", "pos", "info", F.col("m")["DP"].alias("dp"), F.col("m")["gnomad_AF"].alias("af"))


@query("set_union", f"with {d.VCF}, f as (select * from freqs where freq is not null and freq*100<50), r as (select *, row_number() over (partition by {SITE} order by sample_ix, line) k from f) select {SITE}, sample_ix, line from r where k=1")
def set_union(spark, sf_dir):
    return v.union_of_sites(v.kept_by_frequency(d.vcf(spark, sf_dir), 50))


@query("snk_union", f"with {d.VCF} select distinct {SITE} from vcf")
def snk_union(spark, sf_dir):
    """Four columns without a header, in the order in which sites are first seen; read as a list of sites."""
    path = shared_folder(spark, "union")
    text.write_sites(v.union_of_sites(d.vcf(spark, sf_dir)), path)
    return text.read_sites(spark, path)


@query("agg_freqmap", f"with {d.VCF} select concat(chrom,':',cast(pos as varchar),'_',ref,'>',alt) snv, sample, round(max_by(freq,line),9) freq from freqs where freq is not null group by all")
def agg_freqmap(spark, sf_dir):
    return v.frequencies(d.vcf(spark, sf_dir)).withColumn("freq", F.round("freq", 9))


@query("agg_mergedfreq", f"with {d.VCF} select concat(chrom,':',cast(pos as varchar),'_',ref,'>',alt) snv, string_agg(concat(sample,':',printf('%.4f',freq)),';' order by sample) freqs from freqs where freq is not null group by 1")
def agg_mergedfreq(spark, sf_dir):
    rows = v.with_frequency(d.vcf(spark, sf_dir)).filter("freq is not null").withColumn("snv", F.concat("chrom", F.lit(":"), F.col("pos").cast("string"), F.lit("_"), "ref", F.lit(">"), "alt"))
    return v.frequency_text(rows.select("snv", "sample", "freq"))


def _lookup(spark, sf_dir):
    return v.frequency_lookup(d.vcf(spark, sf_dir).filter("sample_ix < 3 and chrom <> 'chr5'"), "gnomad_AF")


@query("agg_aflookup", f"with {d.AF} select key, af, records from lookup")
def agg_aflookup(spark, sf_dir):
    return _lookup(spark, sf_dir).select("key", "af", "records")


@query("agg_afmerge", f"with {d.AF} select cast(sum(records) as bigint) total, count(*) keys, count(case when af>0.001 then 1 end) above, count(case when af is null then 1 end) missing, count(case when records>1 then 1 end) repeated from lookup")
def agg_afmerge(spark, sf_dir):
    return v.lookup_statistics(d.vcf(spark, sf_dir), _lookup(spark, sf_dir), 0.001)


@query("jn_af", f"with {d.AF} select snv, matched_key, af from hits")
def jn_af(spark, sf_dir):
    return v.with_population_frequency(d.snvs(spark, sf_dir), _lookup(spark, sf_dir))


@query("flt_af", f"with {d.AF} select snv from details where not removed")
def flt_af(spark, sf_dir):
    return v.kept_by_population(d.snvs(spark, sf_dir), _lookup(spark, sf_dir))


@query("agg_afsummary", f'with {d.AF} select count(*) before, count(case when found then 1 end) matched, count(case when not found then 1 end) unmatched, count(case when "numeric" then 1 end) as "numeric", count(case when removed then 1 end) removed, count(case when not removed then 1 end) kept from details')
def agg_afsummary(spark, sf_dir):
    return v.population_summary(v.population_details(d.snvs(spark, sf_dir), _lookup(spark, sf_dir)))


@query("jn_rnaedit", f'with {d.VCF}, {d.BED} select sample, {SITE} from vcf where not exists (select 1 from bed where bed.chrom=vcf.chrom and bed."start"<vcf.pos-1+length(vcf.ref) and bed."end">vcf.pos-1)')
def jn_rnaedit(spark, sf_dir):
    return v.outside_intervals(d.vcf(spark, sf_dir), d.bed(spark, sf_dir)).select("sample", *v.SITE)


@query("jn_rnaedit_events", """with e as (select event_id, cast(floor(value*37) as int) pos, user_id%11 c from events), b as (select distinct user_id%11 c, cast(floor(value*37) as int) st, cast(floor(value*37) as int)+1+cast(event_id%23 as int) en from events where event_id%17=0)
select event_id, cast(pos as int) pos, concat('c',cast(c as varchar)) chrom from e where not exists (select 1 from b where b.c=e.c and b.st<e.pos-1+2 and b.en>e.pos-1)""")
def jn_rnaedit_events(spark, sf_dir):
    """The interval anti-join over many positions, and intervals of several lengths."""
    e = d.table(spark, sf_dir, "events")
    pos, chrom = F.floor(F.col("value") * 37).cast("int"), F.concat(F.lit("c"), (F.col("user_id") % 11).cast("string"))
    rows = e.select("event_id", pos.alias("pos"), chrom.alias("chrom"), F.lit("AC").alias("ref"))
    spans = e.filter("event_id % 17 = 0").select(chrom.alias("chrom"), pos.alias("start"), (pos + 1 + (F.col("event_id") % 23).cast("int")).alias("end"))
    return v.outside_intervals(rows, spans, 64).select("event_id", "pos", "chrom")


@query("fn_chrcompat", f"""with {d.AF}, sides as (select cast(substr(snv, length(snv)-4, 1) as varchar) as side, bool_or(starts_with(snv,'chr')) a, bool_or(not starts_with(snv,'chr')) bare from snvs group by 1),
 n as (select bool_or(starts_with(chrom,'chr')) r from reads) select side, r a_chr, not bare as b_chr, r = (not bare) as agree from sides, n""")
def fn_chrcompat(spark, sf_dir):
    """The reads' contigs against lists of variants by position; one of the lists is taken without chr, the others with it."""
    reads, out = d.all_reads(spark, sf_dir).select("chrom"), None
    names = d.snvs(spark, sf_dir).withColumn("side", F.expr("substr(snv, length(snv) - 4, 1)"))
    for side in "01234":
        own = names.filter(F.col("side") == side)
        listed = own.filter("not startswith(snv, 'chr')") if side == "3" else own
        one = v.chromosome_styles(reads, listed.select(F.substring_index("snv", ":", 1).alias("chrom"))).withColumn("side", F.lit(side))
        out = one if out is None else out.unionByName(one)
    return out.select("side", "a_chr", "b_chr", "agree")


@query("src_bed", f"""with {d.READS}, {d.BED} select chrom, cast("start" as int) as "start", cast("end" as int) as "end" from bed union all
 select concat('e', cast(event_id as varchar)), cast(event_id%1000 as int), cast(event_id%1000+50 as int) from events where event_id%4<>3""")
def src_bed(spark, sf_dir):
    """Lines with three and with more columns, comments, track lines, blank lines, and lines whose places are no numbers, as other tools leave them."""
    path = shared_folder(spark, "bed")
    three = d.bed(spark, sf_dir).select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string")).alias("value"))
    e = F.col("event_id")
    text_of = lambda c: c.cast("string")
    more = d.table(spark, sf_dir, "events").select(
        F.when(e % 4 != 3, F.concat_ws("\t", F.concat(F.lit("e"), text_of(e)), text_of(e % 1000), text_of(e % 1000 + 50), F.lit("name"), F.lit("0"), F.lit("+")))
        .when(e % 16 == 3, F.concat(F.lit("#e"), text_of(e))).when(e % 16 == 7, F.concat(F.lit("track name="), text_of(e))).when(e % 16 == 11, F.lit("")).otherwise(F.concat_ws("\t", F.lit("e"), F.lit("start"), F.lit("end"))).alias("value"))
    three.union(more).write.text(path)
    return text.read_bed(spark, path)


@query("src_sites", f"with {d.READS}, s as (select distinct {SITE} from reads) select {SITE} from s where pos<1003")
def src_sites(spark, sf_dir):
    """Lines of both layouts, comments and short lines, parsed."""
    from ..sources.text import sites_from_lines

    s = d.all_reads(spark, sf_dir).select(*v.SITE).distinct().filter("pos < 1004")
    four = F.concat_ws(" ", "chrom", F.col("pos").cast("string"), "ref", "alt")
    five = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("60"))
    lines = s.select(F.when(F.col("pos") == 1003, F.concat_ws("\t", "chrom", F.col("pos").cast("string"))).when(F.col("pos") == 1001, four).otherwise(five).alias("value"))
    return sites_from_lines(lines.union(lines.sparkSession.createDataFrame([("#CHROM\tPOS",), ("",), ("   ",)], "value string")))

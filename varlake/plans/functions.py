"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import settings
from ..functions import statistics as st
from ..functions import variants as vt
from ..operators import preflight
from ..sources import derived as d
from .register import query

_KEYS = """keys as (select p_partkey, concat(case p_partkey%4 when 0 then 'chr' when 1 then '' when 2 then 'CHR' else 'HLA:' end, cast(p_partkey%25 as varchar), ':', cast(p_partkey as varchar),
 case when p_partkey%7=0 then '-' else '_' end, 'a>', case when p_partkey%5=0 then 'G,T' else 'g' end) t from part)"""


def _keys(spark, sf_dir):
    p = F.col("p_partkey")
    head = F.when(p % 4 == 0, "chr").when(p % 4 == 1, "").when(p % 4 == 2, "CHR").otherwise("HLA:")
    return d.table(spark, sf_dir, "part").select("p_partkey", F.concat(head, (p % 25).cast("string"), F.lit(":"), p.cast("string"), F.when(p % 7 == 0, "-").otherwise("_"), F.lit("a>"), F.when(p % 5 == 0, "G,T").otherwise("g")).alias("t"))


def _parts(rows, parsed):
    rows = rows.withColumn("k", parsed)
    return rows.select("p_partkey", *(F.col("k")[c].alias(c) for c in ("chrom", "pos", "ref", "alt")))


@query("fn_snvkey", "select p_partkey, concat('chr',cast(p_size as varchar),':',cast(p_partkey as varchar),'_',upper(substr(p_name,1,1)),'>',upper(substr(p_name,2,1))) snv from part")
def fn_snvkey(spark, sf_dir):
    rows = d.table(spark, sf_dir, "part")
    return rows.select("p_partkey", vt.snv_key(F.concat(F.lit("chr"), F.col("p_size").cast("string")), F.col("p_partkey"), F.substring("p_name", 1, 1), F.substring("p_name", 2, 1)).alias("snv"))


def _parse_sql(pattern: str, chrom: str = "{}") -> str:
    part = lambda i: f"regexp_extract(t,'{pattern}',{i})"
    ok = f"regexp_matches(t,'{pattern}')"
    return f"with {_KEYS} select p_partkey, case when {ok} then {chrom.format(part(1))} end chrom, case when {ok} then cast({part(2)} as int) end pos, case when {ok} then upper({part(3)}) end as ref, case when {ok} then upper({part(4)}) end alt from keys"


@query("fn_parsekey_strict", _parse_sql("(?i)^([^:]+):([0-9]+)_([^>]+)>([^>]+)$"))
def fn_parsekey_strict(spark, sf_dir):
    return _parts(_keys(spark, sf_dir), vt.parse_key(F.col("t")))


@query("fn_parsekey_chr", _parse_sql("(?i)^(chr[^:]+):([0-9]+)_([^>]+)>([^>]+)$", "lower({})"))
def fn_parsekey_chr(spark, sf_dir):
    return _parts(_keys(spark, sf_dir), vt.parse_key_chr(F.col("t")))


@query("fn_parsekey_loose", f"with {_KEYS}, a as (select p_partkey, string_split(t,':') a from keys), b as (select p_partkey, a, string_split(a[2],'_') b from a), c as (select p_partkey, a, b, string_split(b[2],'>') c from b), k as (select *, coalesce(len(a)=2 and len(b)=2 and len(c)=2,false) ok from c) select p_partkey, case when ok then a[1] end chrom, case when ok then b[1] end pos, case when ok then c[1] end as ref, case when ok then c[2] end alt from k")
def fn_parsekey_loose(spark, sf_dir):
    return _parts(_keys(spark, sf_dir), vt.parse_key_loose(F.col("t")))


@query("fn_chrnorm", f"with {_KEYS}, s as (select p_partkey, concat(' ',split_part(t,':',1),' ') c from keys) select p_partkey, case when regexp_replace(trim(c),'(?i)^chr','')='' then '' else concat('chr',lower(regexp_replace(trim(c),'(?i)^chr',''))) end chrom from s")
def fn_chrnorm(spark, sf_dir):
    return _keys(spark, sf_dir).select("p_partkey", vt.normal_chromosome(F.concat(F.lit(" "), F.substring_index("t", ":", 1), F.lit(" "))).alias("chrom"))


@query("fn_chrtoggle", f"with {_KEYS} select p_partkey, case when starts_with(t,'chr') then substr(t,4) else concat('chr',t) end other from keys")
def fn_chrtoggle(spark, sf_dir):
    return _keys(spark, sf_dir).select("p_partkey", vt.toggled_chromosome(F.col("t")).alias("other"))


@query("fn_info", "select o_orderkey, cast(o_custkey%7 as varchar) dp, concat('x=',cast(o_orderkey%3 as varchar)) q, '' flag, 3 size from orders")
def fn_info(spark, sf_dir):
    """Repeated keys, flags, blanks and a value with '='."""
    text = F.concat(F.lit("DP=1; Q = x="), (F.col("o_orderkey") % 3).cast("string"), F.lit(";;SOMATIC;DP="), (F.col("o_custkey") % 7).cast("string"))
    rows = d.table(spark, sf_dir, "orders").select("o_orderkey", vt.info_map(text).alias("m"))
    return rows.select("o_orderkey", F.col("m")["DP"].alias("dp"), F.col("m")["Q"].alias("q"), F.col("m")["SOMATIC"].alias("flag"), F.size("m").alias("size"))


@query("fn_afvalue", "select o_orderkey, case o_orderkey%5 when 0 then null when 1 then greatest(0.5,o_custkey/1000.0::double) when 2 then null when 3 then cast(o_custkey as double) else 0.25 end af from orders")
def fn_afvalue(spark, sf_dir):
    k, c = F.col("o_orderkey") % 5, F.col("o_custkey")
    text = F.when(k == 0, ".").when(k == 1, F.concat(F.lit("0.5,"), (c / 1000.0).cast("string"))).when(k == 2, " ").when(k == 3, F.concat(c.cast("string"), F.lit(",x"))).otherwise("nan,0.25")
    return d.table(spark, sf_dir, "orders").select("o_orderkey", vt.allele_frequency(text).alias("af"))


@query("fn_bccodec", "with e as (select o_custkey, concat('b:',cast(o_orderkey as varchar)) bc, cast(o_orderkey%4 as int) n from orders) select o_custkey, bc, n from e where n>0")
def fn_bccodec(spark, sf_dir):
    """Encoded per customer and decoded again: counts of 0 go, colons in barcodes stay."""
    rows = d.table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("b:"), F.col("o_orderkey").cast("string")).alias("bc"), (F.col("o_orderkey") % 4).cast("int").alias("n"))
    text = rows.groupBy("o_custkey").agg(vt.counts_text(F.collect_list(F.struct("bc", "n"))).alias("t"))
    return text.withColumn("e", F.explode(vt.counts_entries(F.col("t")))).select("o_custkey", "e.bc", "e.n")


@query("fn_cellstrip", "select c_custkey, regexp_extract(c_name,'[^ #]*$') cell from customer")
def fn_cellstrip(spark, sf_dir):
    return d.table(spark, sf_dir, "customer").select("c_custkey", vt.after_last_underscore(F.regexp_replace("c_name", "[ #]", "_")).alias("cell"))


@query("fn_safename", "select c_custkey, regexp_replace(concat(c_name,'/x y'),'[^A-Za-z0-9._-]','_','g') name from customer")
def fn_safename(spark, sf_dir):
    return d.table(spark, sf_dir, "customer").select("c_custkey", vt.safe_name(F.concat("c_name", F.lit("/x y"))).alias("name"))


_LOG = "select l_orderkey, l_linenumber, l_quantity c, l_discount*40 mu, l_tax*100+0.5 th from lineitem"


def _nb_rows(spark, sf_dir):
    return d.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("c"), (F.col("l_discount") * 40).alias("mu"), (F.col("l_tax") * 100 + 0.5).alias("th"))


@query("fn_lgamma", f"select l_orderkey, l_linenumber, round(lgamma(th),7) v, round(lgamma(c+1),7) w from ({_LOG})")
def fn_lgamma(spark, sf_dir):
    return _nb_rows(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(st.lgamma(F.col("th")), 7).alias("v"), F.round(st.lgamma(F.col("c") + 1), 7).alias("w"))


@query("fn_nbnll", f"with b as (select l_orderkey, l_linenumber, c, greatest(mu,1e-6) mu, th from ({_LOG})) select l_orderkey, l_linenumber, round(-(lgamma(c+th)-lgamma(th)-lgamma(c+1)+th*(ln(th+1e-6)-ln(th+mu+1e-6))+c*(ln(mu+1e-6)-ln(th+mu+1e-6))),6) nll from b")
def fn_nbnll(spark, sf_dir):
    return _nb_rows(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(st.negative_binomial_nll(F.col("c"), F.col("mu"), F.col("th")), 6).alias("nll"))


@query("fn_nbnll_effect", f"with b as (select l_orderkey, l_linenumber, c, greatest(mu,1e-5) mu, th from ({_LOG})) select l_orderkey, l_linenumber, round(-(lgamma(c+th)-lgamma(th)-lgamma(c+1)+th*(ln(th)-ln(th+mu))+c*(ln(mu)-ln(th+mu))),6) nll from b")
def fn_nbnll_effect(spark, sf_dir):
    return _nb_rows(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(st.negative_binomial_nll(F.col("c"), F.col("mu"), F.col("th"), 1e-5, 1e6), 6).alias("nll"))


@query("fn_kl", f"select l_orderkey, l_linenumber, round(greatest(0.5,0.5*(mu*mu+exp(th/10)-th/10-1)),9) kl from ({_LOG})")
def fn_kl(spark, sf_dir):
    return _nb_rows(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(st.gaussian_kl(F.col("mu"), F.col("th") / 10), 9).alias("kl"))


@query("fn_muact", f"select l_orderkey, l_linenumber, round(ln(exp(least(c-25,20))),9) umi, round(greatest(mu-2,0)+ln(1+exp(-abs(mu-2))),9) softplus, mu as identity from ({_LOG})")
def fn_muact(spark, sf_dir):
    c, mu = F.col("c") - 25, F.col("mu")
    return _nb_rows(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(F.ln(st.mean_activation(c)), 9).alias("umi"), F.round(st.mean_activation(mu - 2, "softplus"), 9).alias("softplus"), st.mean_activation(mu, "identity").alias("identity"))


@query("fn_lr", "select p_partkey, round(case when p_size<10 then 0.001*(p_size+1)/10 else 1e-8+(0.001-1e-8)*0.5*(1+cos(pi()*(p_size-10)/50.0)) end,12) lr from part")
def fn_lr(spark, sf_dir):
    return d.table(spark, sf_dir, "part").select("p_partkey", F.round(st.warm_cosine(F.col("p_size"), 10, 60, 0.001), 12).alias("lr"))


@query("fn_ramp", "select p_partkey, round(3.0*least(1.0,p_size/20.0),9)::double ramp from part")
def fn_ramp(spark, sf_dir):
    return d.table(spark, sf_dir, "part").select("p_partkey", F.round(st.ramp(F.col("p_size"), 20, 3.0), 9).alias("ramp"))


_VEC = "v as (select a.vec_id a, b.vec_id b, list_transform(a.embedding, lambda x: cast(x as double)) x, list_transform(b.embedding, lambda x: cast(x as double)) y from embeddings a join embeddings b on b.vec_id=a.vec_id+1)"


def _pairs(spark, sf_dir):
    e = d.table(spark, sf_dir, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, "a")


@query("fn_cosine", f"with {_VEC} select a, b, round(1-list_dot_product(x,y)/(greatest(sqrt(list_dot_product(x,x)),1e-6)*greatest(sqrt(list_dot_product(y,y)),1e-6)),9) d from v")
def fn_cosine(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", F.round(st.cosine_distance(F.col("x"), F.col("y")), 9).alias("d"))


@query("fn_euclid", f"with {_VEC} select a, b, round(list_distance(x,y),9) d from v")
def fn_euclid(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", F.round(st.euclidean(F.col("x"), F.col("y")), 9).alias("d"))


# Texts of settings by turns: words of all kinds around numbers of the table.
_WORDS = ("true", " YES ", "On", "1", "FALSE", "no", "\toff", "0", "", "  ", "maybe", "yes!", "2")
_WORD_SQL = "case o_orderkey%14 " + " ".join(f"when {i} then '{w}'" for i, w in enumerate(_WORDS)) + " end"


def _words(spark, sf_dir):
    word = F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("o_orderkey") % 14 + 1).cast("int"))
    return d.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 14 < len(_WORDS), word).alias("word"))


@query("fn_bool", f"with w as (select o_orderkey, lower(regexp_replace({_WORD_SQL}, '^\\s+|\\s+$', '', 'g')) w from orders) select o_orderkey, case when w in ('1','true','yes','on') then true when w in ('0','false','no','off','') then false end as value from w")
def fn_bool(spark, sf_dir):
    return _words(spark, sf_dir).select("o_orderkey", settings.boolean(F.col("word")).alias("value"))


_NUMBER_SQL = "case l_linenumber when 1 then cast(l_partkey as varchar) when 2 then concat(' ',cast(l_partkey as varchar),' ') when 3 then concat('0',cast(l_partkey as varchar)) when 4 then concat('-',cast(l_partkey as varchar)) when 5 then concat(cast(l_partkey as varchar),'.0') when 6 then '' end"


@query("fn_posint", f"with n as (select l_orderkey, l_linenumber, trim({_NUMBER_SQL}) t from lineitem) select l_orderkey, l_linenumber, case when regexp_full_match(t, '[1-9][0-9]*') then cast(t as bigint) end as value from n")
def fn_posint(spark, sf_dir):
    k = F.col("l_partkey").cast("string")
    text = F.element_at(F.array(k, F.concat(F.lit(" "), k, F.lit(" ")), F.concat(F.lit("0"), k), F.concat(F.lit("-"), k), F.concat(k, F.lit(".0")), F.lit("")), F.col("l_linenumber"))
    return d.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", settings.positive_integer(F.when(F.col("l_linenumber") <= 6, text)).alias("value"))


@query("fn_alias", """select p_partkey, case p_partkey%4 when 0 then 'euclidean' when 1 then 'cosine' else lower(regexp_replace(regexp_replace(concat(p_brand,' (',p_type,')'),'[^0-9A-Za-z_]+','_','g'),'^_+|_+$','','g')) end as alias from part""")
def fn_alias(spark, sf_dir):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "score_euclidean").when(k == 1, "score_cosine_distance").otherwise(F.concat("p_brand", F.lit(" ("), "p_type", F.lit(")")))
    return d.table(spark, sf_dir, "part").select("p_partkey", settings.score_alias(name).alias("alias"))


# Samples are customers, files are those of every order; some paths are missing, blank, or of no file.
_SAMPLES = """samples as (select concat('C',cast(c_custkey as varchar)) sample, concat('/d/',cast(c_custkey%97 as varchar),'/o',cast(c_custkey as varchar),'.bam') bam,
  case c_custkey%5 when 0 then null when 1 then '  ' else concat('/d/o',cast(c_custkey*3 as varchar),'.vcf') end vcf, concat('/d/o',cast(c_custkey as varchar),'.csv') cb, case when c_custkey%2=0 then concat('/d/o',cast(c_custkey as varchar),'.csv') end annotated_vcf from customer),
 files as (select concat('/d/',cast(o_custkey%97 as varchar),'/o',cast(o_custkey as varchar),'.bam') path from orders union select concat('/d/o',cast(o_orderkey as varchar),'.vcf') from orders union select concat('/d/o',cast(o_custkey as varchar),'.csv') from orders),
 inputs as (select sample, 'bam' as input, bam path from samples union all select sample, 'vcf', vcf from samples union all select sample, 'cb', cb from samples union all select sample, 'annotated_vcf', annotated_vcf from samples)"""


def _samples(spark, sf_dir):
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    c, o = F.col("c_custkey"), d.table(spark, sf_dir, "orders")
    samples = d.table(spark, sf_dir, "customer").select(
        text("C", c).alias("sample"), text("/d/", c % 97, "/o", c, ".bam").alias("bam"), F.when(c % 5 == 0, None).when(c % 5 == 1, "  ").otherwise(text("/d/o", c * 3, ".vcf")).alias("vcf"),
        text("/d/o", c, ".csv").alias("cb"), F.when(c % 2 == 0, text("/d/o", c, ".csv")).alias("annotated_vcf"))
    k = F.col("o_custkey")
    files = o.select(text("/d/", k % 97, "/o", k, ".bam").alias("path")).union(o.select(text("/d/o", F.col("o_orderkey"), ".vcf"))).union(o.select(text("/d/o", k, ".csv")))
    return samples, files


@query("cfg_validate", f"with {_SAMPLES} select sample, input, case when path is null or trim(path)='' then 'not given' else concat('no file ',path) end problem from inputs where path is null or path not in (select path from files)")
def cfg_validate(spark, sf_dir):
    samples, files = _samples(spark, sf_dir)
    return preflight.missing_inputs(samples, files, annotated=True)


@query("fn_path", f"with {_SAMPLES} select sample, case when trim(vcf)<>'' then vcf end as path from samples")
def fn_path(spark, sf_dir):
    return _samples(spark, sf_dir)[0].select("sample", settings.required_path(F.col("vcf")).alias("path"))


@query("vc_preflight", "with p as (select concat('c', cast(c_custkey%(select greatest(2, count(*)//2) from customer) as varchar)) prefix, c_custkey from customer) select prefix, count(*) samples from p group by prefix having count(*)>1")
def vc_preflight(spark, sf_dir):
    """Half as many file names as samples, in folders that differ."""
    customers = d.table(spark, sf_dir, "customer")
    half = customers.agg(F.greatest(F.lit(2), F.floor(F.count("*") / 2)).alias("half"))
    named = customers.join(half).select(F.col("c_custkey").cast("string").alias("sample"), F.concat(F.lit("/in/"), F.col("c_nationkey").cast("string"), F.lit("/c"), (F.col("c_custkey") % F.col("half")).cast("string"), F.lit(".bam")).alias("bam"))
    return preflight.repeated_prefixes(named)

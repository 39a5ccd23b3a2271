"""Queries on scores, ranks, the co-occurrence graph and per-cell aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import communities as cm
from ..operators import graph as g
from ..operators import layout as lo
from ..operators import neighbours as nb
from ..operators import scoring as s
from ..sources import derived as d
from ..sources.folder import kept
from .register import query

LIMITS = dict(least_carriers=4, least_shared=4, jaccard=0.5, overlap=0.6)


@query("agg_snvcount", f"with {d.OBS} select snv, count(case when call=1 then 1 end) n_pos, count(case when call=-1 then 1 end) n_neg from obs group by snv")
def agg_snvcount(spark, sf_dir):
    return s.call_counts(d.matrix(spark, sf_dir))


@query("flt_snvcount", f"with {d.OBS}, k as (select snv from obs group by snv having count(case when call=1 then 1 end)>=50 and count(case when call=-1 then 1 end)>=15) select cell, snv, call from obs semi join k using (snv)")
def flt_snvcount(spark, sf_dir):
    return s.frequent_snvs(d.matrix(spark, sf_dir), 50, 15).select("cell", "snv", "call")


_VALID = "valid as (select celltype, snv, count(case when call=1 then 1 end) n_pos, count(case when call=-1 then 1 end) n_neg from obs join cells using (cell) group by all having count(case when call=1 then 1 end)>4 and count(case when call=-1 then 1 end)>4)"


def _valid(spark, sf_dir):
    return s.valid_in_celltype(d.matrix(spark, sf_dir), d.cells(spark, sf_dir), 4)


@query("flt_ct_valid", f"with {d.OBS}, {d.CELLS}, {_VALID} select * from valid")
def flt_ct_valid(spark, sf_dir):
    return _valid(spark, sf_dir)


@query("flt_stdchr", f"with {d.AF} select snv from snvs where regexp_replace(split_part(snv,':',1),'^chr','') in ('1','2','3','4','5','6','7','8','9','10','11','12','13','14','15','16','17','18','19','20','21','22','X','Y')")
def flt_stdchr(spark, sf_dir):
    return s.on_standard_chromosomes(d.snvs(spark, sf_dir))


_LOGIT = "pairs as (select cell, snv, call, cast((alt_count*3+ref_count)%7 as double)/2 logit from obs where call<>0)"
_SOFT = _LOGIT + ", m as (select *, max(logit) over (partition by cell) mx from pairs), soft as (select cell, snv, exp(logit-mx)/(sum(exp(logit-mx)) over (partition by cell)+1e-12) attention from m)"


def _pairs(spark, sf_dir):
    return d.matrix(spark, sf_dir).filter("call <> 0").select("cell", "snv", "call", (((F.col("alt_count") * 3 + F.col("ref_count")) % 7).cast("double") / 2).alias("logit"))


@query("win_softmax", f"with {d.OBS}, {_SOFT} select cell, snv, round(attention,9) attention from soft")
def win_softmax(spark, sf_dir):
    return s.segment_softmax(_pairs(spark, sf_dir)).select("cell", "snv", F.round("attention", 9).alias("attention"))


@query("win_softmax_ranking", f"with {d.OBS}, {_LOGIT} select cell, snv, round(exp(least(logit,50))/(sum(exp(least(logit,50))) over (partition by cell)+1e-12),9) attention from pairs")
def win_softmax_ranking(spark, sf_dir):
    return s.clamped_softmax(_pairs(spark, sf_dir)).select("cell", "snv", F.round("attention", 9).alias("attention"))


def _attention(spark, sf_dir):
    matrix = d.matrix(spark, sf_dir)
    return s.mean_attention(s.segment_softmax(_pairs(spark, sf_dir)), matrix).withColumn("attention", F.round("attention", 9))


_MEAN = _SOFT + ", att as (select snv, round(coalesce((select avg(attention) from soft where soft.snv=o.snv),0),9) attention from (select distinct snv from obs) o)"


@query("agg_attnmean", f"with {d.OBS}, {_MEAN} select * from att")
def agg_attnmean(spark, sf_dir):
    return _attention(spark, sf_dir)


@query("top_attn", f"with {d.OBS}, {_MEAN} select * from att order by attention desc, snv limit 25")
def top_attn(spark, sf_dir):
    return s.top_by_attention(_attention(spark, sf_dir), 25)


_CTATT = _SOFT + ", ct as (select celltype, snv, round(avg(attention),9) attention from soft join cells using (cell) group by all)"


@query("top_ct_attn", f"with {d.OBS}, {d.CELLS}, {_CTATT}, {_VALID}, r as (select *, row_number() over (partition by celltype order by attention desc, snv) place from ct) select celltype, snv, attention, cast(place as int) place from r semi join valid using (celltype,snv) where place<=60")
def top_ct_attn(spark, sf_dir):
    soft = s.segment_softmax(_pairs(spark, sf_dir)).join(d.cells(spark, sf_dir).select("cell", "celltype"), "cell")
    ct = soft.groupBy("celltype", "snv").agg(F.round(F.avg("attention"), 9).alias("attention"))
    return s.top_then_valid(ct, _valid(spark, sf_dir), 60).select("celltype", "snv", "attention", "place")


@query("top_snvbar", f"with {d.OBS}, c as (select snv, count(case when call=1 then 1 end) n_pos, count(case when call=-1 then 1 end) n_neg from obs group by snv) select *, n_pos+n_neg total from c order by total desc, snv limit 50")
def top_snvbar(spark, sf_dir):
    return s.top_by_calls(s.call_counts(d.matrix(spark, sf_dir)))


@query("win_topngroup", f"with {d.ALL}, r as (select *, row_number() over (partition by celltype order by ord) place from scores) select celltype, snv, score_euclidean, cast(place as int) place from r where place<=5")
def win_topngroup(spark, sf_dir):
    return s.top_in_group(d.scores(spark, sf_dir), "celltype", ["ord"], 5).select("celltype", "snv", "score_euclidean", "place")


@query("srt_scores", f"with {d.ALL} select celltype, snv, score_cosine_distance from scores order by score_cosine_distance desc, celltype, snv")
def srt_scores(spark, sf_dir):
    return d.scores(spark, sf_dir).select("celltype", "snv", "score_cosine_distance").orderBy(F.desc("score_cosine_distance"), "celltype", "snv")


@query("srt_keys", f"with {d.OBS} select distinct sample, snv from obs order by sample, snv")
def srt_keys(spark, sf_dir):
    return d.matrix(spark, sf_dir).select("sample", "snv").distinct().orderBy("sample", "snv")


_MESSY = "messy as (select celltype, snv, case when ord%5=0 then null else score_euclidean end score_euclidean, ord from scores union all select celltype, snv, score_euclidean/2, ord+100000 from scores where ord%3=0)"


@query("win_dedup", f"with {d.ALL}, {_MESSY}, r as (select *, row_number() over (partition by celltype,snv order by score_euclidean desc nulls last, ord) k from messy) select celltype, snv, score_euclidean, cast(ord as int) ord from r where k=1")
def win_dedup(spark, sf_dir):
    """NaN scores rank as missing."""
    rows = d.scores(spark, sf_dir)
    a = rows.select("celltype", "snv", F.when(F.col("ord") % 5 == 0, float("nan")).otherwise(F.col("score_euclidean")).alias("score_euclidean"), "ord")
    b = rows.filter("ord % 3 = 0").select("celltype", "snv", F.col("score_euclidean") / 2, F.col("ord") + 100000)
    return s.best_per_snv(a.union(b)).select("celltype", "snv", F.nanvl("score_euclidean", F.lit(None).cast("double")).alias("score_euclidean"), F.col("ord").cast("int").alias("ord"))


_CARRY = "carry as (select celltype, obs.sample, cell, snv from obs join cells using (cell) where call=1)"
_EDGES = _CARRY + """, sz as (select celltype,sample,snv,count(*) n from carry group by all having count(*)>=4),
ck as (select carry.*, n from carry join sz using (celltype,sample,snv)),
e0 as (select a.celltype,a.sample,a.snv a,b.snv b,a.n na,b.n nb,count(*) shared from ck a join ck b on a.celltype=b.celltype and a.sample=b.sample and a.cell=b.cell and a.snv<b.snv group by all),
edges as (select *, cast(shared as double)/(na+nb-shared) jaccard, cast(shared as double)/least(na,nb) overlap from e0 where shared>=4 and cast(shared as double)/(na+nb-shared)>=0.5 and cast(shared as double)/least(na,nb)>=0.6)"""


def _edges(spark, sf_dir):
    return g.cooccurrence(d.carriers(spark, sf_dir), **LIMITS)


@query("gr_coocc", f"with {d.OBS}, {d.CELLS}, {_EDGES} select celltype, sample, a, b, shared, round(jaccard,9) jaccard, round(overlap,9) overlap from edges")
def gr_coocc(spark, sf_dir):
    return _edges(spark, sf_dir).select("celltype", "sample", "a", "b", "shared", F.round("jaccard", 9).alias("jaccard"), F.round("overlap", 9).alias("overlap"))


@query("jn_coocc", f"with {d.OBS}, {d.CELLS}, {_CARRY} select a.celltype, a.sample, a.snv a, b.snv b, count(*) shared from carry a join carry b on a.celltype=b.celltype and a.sample=b.sample and a.cell=b.cell and a.snv<b.snv group by all having count(*)>=6")
def jn_coocc(spark, sf_dir):
    return g.cooccurrence(d.carriers(spark, sf_dir), 1, 6, 0.0, 0.0).select("celltype", "sample", "a", "b", "shared")


@query("set_overlap", f"with {d.OBS}, {d.CELLS}, {_EDGES} select celltype, sample, a, b, shared inter, na+nb-shared as un from edges")
def set_overlap(spark, sf_dir):
    return _edges(spark, sf_dir).select("celltype", "sample", "a", "b", F.col("shared").alias("inter"), (F.col("na") + F.col("nb") - F.col("shared")).alias("un"))


@query("flt_minpres", f"with {d.OBS}, {d.CELLS}, {_CARRY} select celltype, sample, snv, count(*) n from carry group by all having count(*)>=4")
def flt_minpres(spark, sf_dir):
    return d.carriers(spark, sf_dir).distinct().groupBy("celltype", "sample", "snv").agg(F.count("*").alias("n")).filter("n >= 4")


def _rounds(n: int) -> str:
    """The same independent set in DuckDB: n rounds written out; what is still open after them shows as 'open'."""
    out = [_EDGES, "nb as (select celltype,a u,b v from edges union select celltype,b,a from edges)",
           "pr as (select nb.celltype,u,v,s.score_euclidean su,s.ord ou,t.score_euclidean sv,t.ord ov from nb join scores s on s.celltype=nb.celltype and s.snv=u join scores t on t.celltype=nb.celltype and t.snv=v)",
           "o0 as (select * from pr)"]
    for i in range(n):
        out += [f"k{i} as (select celltype,u from o{i} group by all having bool_and(su>sv or (su=sv and ou<ov)))",
                f"r{i} as (select distinct celltype,v u from o{i} semi join k{i} using (celltype,u))",
                f"d{i} as (select * from k{i} union select * from r{i})",
                f"l{i} as (select distinct celltype,u from o{i} anti join d{i} using (celltype,u))",
                f"o{i + 1} as (select o.* from o{i} o anti join d{i} using (celltype,u) anti join (select celltype,u v from d{i}) x using (celltype,v))",
                f"f{i} as (select * from l{i} anti join o{i + 1} using (celltype,u))"]
    state = " union all ".join(f"select celltype,u snv,'kept' state from k{i} union all select celltype,u,'kept' from f{i} union all select celltype,u,'removed' from r{i}" for i in range(n))
    return ", ".join(out) + f", states as ({state} union all select distinct celltype,u,'open' from o{n})"


_STATES = _rounds(8)


def _states(spark, sf_dir):
    return g.thinned(_edges(spark, sf_dir), d.scores(spark, sf_dir))


@query("gr_dedup", f"with {d.ALL}, {_STATES} select celltype, snv, state from states")
def gr_dedup(spark, sf_dir):
    return _states(spark, sf_dir)


_AUDIT = f"""with {d.ALL}, {_STATES}, both_ as (select celltype,sample,a x,b y,jaccard,overlap,shared from edges union all select celltype,sample,b,a,jaccard,overlap,shared from edges),
t as (select b.*, k.state='kept' kept, s.score_euclidean sy, s.ord oy from both_ b join states r on r.celltype=b.celltype and r.snv=x and r.state='removed' join states k on k.celltype=b.celltype and k.snv=y join scores s on s.celltype=b.celltype and s.snv=y),
kp as (select celltype,x,y keeper from (select *, row_number() over (partition by celltype,x order by sy desc, oy) k from t where kept) where k=1),
best as (select *, row_number() over (partition by celltype,x order by y=keeper desc, jaccard desc, overlap desc, shared desc, sample, y) k from t join kp using (celltype,x))
select celltype, sample, x removed_snv, keeper kept_snv, y edge_partner_snv, rs.score_euclidean removed_score, ks.score_euclidean kept_score, round(jaccard,9) jaccard_index, round(overlap,9) overlap_coefficient, shared cooccurrence_count
from best join scores rs using (celltype) join scores ks using (celltype) where k=1 and rs.snv=x and ks.snv=keeper"""


@query("gr_audit", _AUDIT)
def gr_audit(spark, sf_dir):
    out = g.audit(_edges(spark, sf_dir), _states(spark, sf_dir), d.scores(spark, sf_dir))
    return out.withColumns({"jaccard_index": F.round("jaccard_index", 9), "overlap_coefficient": F.round("overlap_coefficient", 9)})


@query("jn_remove", f"with {d.ALL}, {_STATES} select celltype, snv, score_euclidean from scores anti join (select celltype, snv from states where state='removed') r using (celltype,snv)")
def jn_remove(spark, sf_dir):
    return g.without(d.scores(spark, sf_dir), _states(spark, sf_dir)).select("celltype", "snv", "score_euclidean")


@query("agg_minmax", f"with {d.ALL}, {_MESSY} select celltype, snv, cast(ord as int) ord, round((score_euclidean-min(score_euclidean) over ())/(max(score_euclidean) over ()-min(score_euclidean) over ()),9) norm from messy")
def agg_minmax(spark, sf_dir):
    rows = d.scores(spark, sf_dir)
    a = rows.select("celltype", "snv", F.when(F.col("ord") % 5 == 0, float("nan")).otherwise(F.col("score_euclidean")).alias("score_euclidean"), "ord")
    b = rows.filter("ord % 3 = 0").select("celltype", "snv", F.col("score_euclidean") / 2, F.col("ord") + 100000)
    return s.min_max(a.union(b), "score_euclidean", "norm").select("celltype", "snv", F.col("ord").cast("int").alias("ord"), F.round("norm", 9).alias("norm"))


_PERT = """pert as (select c.cell, c.celltype, ln(1+coalesce(avg(score_euclidean),0)) perturbation from cells c left join (select cell, snv from obs where call=1) o using (cell) left join scores s on s.celltype=c.celltype and s.snv=o.snv group by all),
zs as (select *, case when stddev_pop(perturbation) over (partition by celltype)>0 then (perturbation-avg(perturbation) over (partition by celltype))/stddev_pop(perturbation) over (partition by celltype) else 0.0 end z from pert)"""


def _perturbation(spark, sf_dir):
    return s.cell_perturbation(d.matrix(spark, sf_dir), d.cells(spark, sf_dir), d.scores(spark, sf_dir))


@query("agg_perturb", f"with {d.ALL}, {_PERT} select cell, celltype, round(perturbation,9) perturbation from pert")
def agg_perturb(spark, sf_dir):
    return _perturbation(spark, sf_dir).withColumn("perturbation", F.round("perturbation", 9))


@query("jn_scores", f"with {d.ALL} select cell, o.snv, s.celltype, score_euclidean from obs o join cells using (cell) join scores s on s.celltype=cells.celltype and s.snv=o.snv where call=1")
def jn_scores(spark, sf_dir):
    rows = d.carriers(spark, sf_dir).join(d.scores(spark, sf_dir), ["celltype", "snv"])
    return rows.select("cell", "snv", "celltype", "score_euclidean")


@query("mx_matvec", f"with {d.ALL} select cell, round(sum(score_euclidean),9) total, count(*) n from (select cell, snv from obs where call=1) o join cells using (cell) join scores s using (celltype, snv) group by cell")
def mx_matvec(spark, sf_dir):
    return jn_scores(spark, sf_dir).groupBy("cell").agg(F.round(F.sum("score_euclidean"), 9).alias("total"), F.count("*").alias("n"))


@query("win_zscore", f"with {d.ALL}, {_PERT} select cell, celltype, round(z,6) z from zs")
def win_zscore(spark, sf_dir):
    return s.within_celltype_z(_perturbation(spark, sf_dir)).select("cell", "celltype", F.round("z", 6).alias("z"))


@query("flt_zsel", f"with {d.ALL}, {_PERT} select cell, celltype, round(z,6) z, z>=1 high_perturbation from zs where abs(z)>=1")
def flt_zsel(spark, sf_dir):
    return s.strongly_perturbed(s.within_celltype_z(_perturbation(spark, sf_dir))).select("cell", "celltype", F.round("z", 6).alias("z"), "high_perturbation")


@query("win_cap", f"with {d.ALL}, {_PERT} select cell, celltype, round(least(perturbation, quantile_cont(perturbation,0.9) over (partition by celltype)),9) capped from pert")
def win_cap(spark, sf_dir):
    return s.capped(_perturbation(spark, sf_dir)).select("cell", "celltype", F.round("capped", 9).alias("capped"))


@query("agg_score", f"with {d.ALL} select snv, round(avg(score_cosine_distance),9) score_cosine_distance, round(avg(score_euclidean),9) score_euclidean from scores group by snv")
def agg_score(spark, sf_dir):
    out = s.aggregated(d.scores(spark, sf_dir), d.scores(spark, sf_dir))
    return out.select("snv", F.round("score_cosine_distance", 9).alias("score_cosine_distance"), F.round("score_euclidean", 9).alias("score_euclidean"))


@query("agg_score_median", f"with {d.ALL} select snv, quantile_disc(score_cosine_distance,0.5) score_cosine_distance, quantile_disc(score_euclidean,0.5) score_euclidean from scores group by snv")
def agg_score_median(spark, sf_dir):
    return s.aggregated(d.scores(spark, sf_dir), d.scores(spark, sf_dir), use_mean=False)


_TOT = f"with {d.RNA}, {d.OBS[len(d.READS) + 2:]} select t.cell, round(ln(1+t.total),9) log_umi, round(ln(1+coalesce(n,0)),9) log_snv from totals t left join (select cell, count(*) n from obs where call<>0 group by cell) o using (cell)"


@query("agg_celltot", _TOT)
def agg_celltot(spark, sf_dir):
    return s.cell_totals(d.rna(spark, sf_dir), d.matrix(spark, sf_dir)).select("cell", F.round("log_umi", 9).alias("log_umi"), F.round("log_snv", 9).alias("log_snv"))


@query("jn_plotcells", f"with {d.RNA}, {d.CELLS}, {d.OBS[len(d.READS) + 2:]}, {d.SCORES}, {_PERT} select t.cell, round(perturbation,9) perturbation, coalesce(n,0) snvs from totals t join pert using (cell) left join (select cell, count(*) n from obs where call<>0 group by cell) o on o.cell=t.cell where total>250")
def jn_plotcells(spark, sf_dir):
    from ..operators.expression import cell_totals

    cells = cell_totals(d.rna(spark, sf_dir)).filter("total > 250").select("cell")
    n = d.matrix(spark, sf_dir).filter("call <> 0").groupBy("cell").agg(F.count("*").alias("n"))
    return cells.join(_perturbation(spark, sf_dir), "cell").join(n, "cell", "left").select("cell", F.round("perturbation", 9).alias("perturbation"), F.coalesce("n", F.lit(0)).alias("snvs"))


@query("jn_ctalign", f"with {d.RNA}, {d.CELLS}, {d.OBS[len(d.READS) + 2:]} select distinct obs.cell, celltype from obs join cells using (cell) join totals using (cell) where celltype<>'T2'")
def jn_ctalign(spark, sf_dir):
    labels = d.cells(spark, sf_dir).filter("celltype <> 'T2'").select("cell", "celltype")
    return d.matrix(spark, sf_dir).select("cell").distinct().join(d.rna(spark, sf_dir).select("cell").distinct(), "cell", "left_semi").join(labels, "cell")


@query("set_intersect", f"with {d.RNA}, {d.OBS[len(d.READS) + 2:]} select cell from totals intersect select cell from obs")
def set_intersect(spark, sf_dir):
    return d.rna(spark, sf_dir).select("cell").intersect(d.matrix(spark, sf_dir).select("cell"))


@query("set_except", f"with {d.ALL} select snv from obs where call<>0 except select snv from scores where celltype='T1' and ord%2=0")
def set_except(spark, sf_dir):
    scored = d.scores(spark, sf_dir).filter("celltype = 'T1' and ord % 2 = 0").select("snv")
    return d.matrix(spark, sf_dir).filter("call <> 0").select("snv").distinct().join(scored, "snv", "left_anti")


def _annotation(spark, sf_dir):
    """Two name columns that contradict each other and the place, and fields in both spellings."""
    p = d.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    chrom = F.when(k % 24 < 22, (k % 24 + 1).cast("string")).when(k % 24 == 22, "x").otherwise("chrM")
    name = F.when(k % 10 == 0, F.concat(F.lit("chr"), (k % 22 + 1).cast("string"), F.lit(":1001_A>G")))
    variant = F.when(k % 7 == 0, F.concat(F.lit("chr"), (k * 3 % 22 + 1).cast("string"), F.lit(":100"), (k % 2 + 1).cast("string"), F.lit("_A>G")))
    return p.select(
        k.alias("row"), name.alias("Name"), variant.alias("Variant"), chrom.alias("Chr"), (1000 + k % 5 + 0.2).cast("string").alias("Start"), F.lit("a").alias("Ref"), F.lit("G").alias("Alt"), F.col("p_brand").alias("Gene.refGene"),
        F.when(k % 2 == 0, F.col("p_type")).alias("Func.refGene"), F.col("p_name").alias("CLNDN"), F.when(k % 3 == 0, F.col("p_brand")).alias("GeneDetail.refGeneWithVer"), F.when(k % 2 == 0, F.col("p_name")).alias("GeneDetail.refGene"),
        F.col("p_type").alias("ExonicFunc.refGeneWithVer"), F.col("p_name").alias("ExonicFunc.refGene"), F.when(k % 4 != 0, k.cast("string")).alias("CLNALLELEID"), F.when(k % 5 != 0, F.col("p_type")).alias("CLNSIG"))


_ANN_ROWS = """ann as (select p_partkey k, case when p_partkey%10=0 then concat('chr',cast(p_partkey%22+1 as varchar),':1001_A>G') end nm,
 case when p_partkey%7=0 then concat('chr',cast(p_partkey*3%22+1 as varchar),':100',cast(p_partkey%2+1 as varchar),'_A>G') end va,
 case when p_partkey%24<22 then concat('chr',cast(p_partkey%24+1 as varchar)) when p_partkey%24=22 then 'chrx' else 'chrm' end c, 1000+p_partkey%5 pos, p_brand gene, case when p_partkey%2=0 then p_type end func, p_name dn,
 coalesce(case when p_partkey%3=0 then p_brand end, case when p_partkey%2=0 then p_name end) detail, p_type exonic, case when p_partkey%4<>0 then cast(p_partkey as varchar) end allele, case when p_partkey%5<>0 then p_type end sig from part)"""
_ANN = f"""with {d.AF}, {_ANN_ROWS},
b1 as (select nm, min(k) k from ann group by nm), b2 as (select va, min(k) k from ann group by va), b3 as (select c, pos, min(k) k from ann group by all),
m as (select snv, coalesce(b1.k,b2.k,b3.k) k from snvs left join b1 on b1.nm=snv left join b2 on b2.va=snv left join b3 on b3.c=concat('chr',lower(regexp_replace(split_part(snv,':',1),'^chr',''))) and b3.pos=cast(regexp_extract(snv,':([0-9]+)_',1) as int))
select snv, """


@query("jn_annot", _ANN + """coalesce(func,'') "Func", coalesce(gene,'') "Gene", coalesce(dn,'') "CLNDN" from m left join ann using (k)""")
def jn_annot(spark, sf_dir):
    return s.annotated(d.snvs(spark, sf_dir), _annotation(spark, sf_dir), "row").select("snv", "Func", "Gene", "CLNDN")


@query("fn_annfields", _ANN + """coalesce(detail,'') "GeneDetail", coalesce(exonic,'') "ExonicFunc", coalesce(sig,'') "CLNSIG", coalesce(allele,'') "CLNALLELEID" from m left join ann using (k)""")
def fn_annfields(spark, sf_dir):
    return s.annotated(d.snvs(spark, sf_dir), _annotation(spark, sf_dir), "row").select("snv", "GeneDetail", "ExonicFunc", "CLNSIG", "CLNALLELEID")


@query("fn_annprep", f"with {_ANN_ROWS} select k as row, c ann_chrom, cast(pos as int) ann_pos, coalesce(nm, concat(c,':',cast(pos as varchar),'_A>G')) ann_name from ann")
def fn_annprep(spark, sf_dir):
    return s.prepared_annotation(_annotation(spark, sf_dir)).select("row", "ann_chrom", "ann_pos", "ann_name")


@query("gr_knn", """with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) z from embeddings), p as (select a.vec_id a, b.vec_id b, list_distance(a.z,b.z) dist from e a join e b on a.vec_id<>b.vec_id),
r as (select *, row_number() over (partition by a order by round(dist,9), cast(b as varchar)) place from p) select cast(a as varchar) cell, cast(b as varchar) neighbour, round(dist,6) distance, cast(place as int) place from r where place<=15""")
def gr_knn(spark, sf_dir):
    return g.nearest_cells(_latents(spark, sf_dir)).select("cell", "neighbour", F.round("distance", 6).alias("distance"), "place")


def _latents(spark, sf_dir):
    return d.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("cell"), F.col("embedding").alias("z"))


@query("gr_knn_descent")
def gr_knn_descent(spark, sf_dir):
    """About the same, without comparing all cells with each other."""
    return kept(spark, "descent", lambda tables: nb.approximate_neighbours(_latents(spark, sf_dir), tables))


def _fuzzy(spark, sf_dir, tables):
    return tables.save(lo.fuzzy_graph(nb.approximate_neighbours(_latents(spark, sf_dir), tables)), "fuzzy")


@query("gr_leiden")
def gr_leiden(spark, sf_dir):
    return kept(spark, "leiden", lambda tables: cm.communities(_fuzzy(spark, sf_dir, tables), tables))


@query("gr_umap")
def gr_umap(spark, sf_dir):
    return kept(spark, "umap", lambda tables: lo.layout(_fuzzy(spark, sf_dir, tables), g.principal_plane(_latents(spark, sf_dir)), tables, epochs=30))


_LINKS = """l as (select l_orderkey, cast(l_suppkey as varchar) s, l_linenumber from lineitem), e as (select a.s a, b.s b from l a join l b on a.l_orderkey=b.l_orderkey and b.l_linenumber=a.l_linenumber+1 and a.s<>b.s),
 w as (select a, b, cast(count(*) as double) w from (select a, b from e union all select b, a from e) group by a, b), n as (select a, cast(s_nationkey as int) c, sum(w) k from w join supplier on cast(s_suppkey as varchar)=a group by all)"""


@query("gr_modularity", f"""with {_LINKS} select cast(count(*) as bigint) nodes, round(coalesce((select sum(w) from w join n x on x.a=w.a join n y on y.a=w.b where x.c=y.c),0)/sum(k)
 - 0.4*(select sum(t*t) from (select sum(k) t from n group by c))/(sum(k)*sum(k)), 9) modularity from n""")
def gr_modularity(spark, sf_dir):
    """Of suppliers by nation, where those of neighbouring lines of an order are linked."""
    lines = d.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("string").alias("cell"), "l_linenumber")
    after = lines.select(F.col("l_orderkey").alias("o"), F.col("cell").alias("neighbour"), (F.col("l_linenumber") - 1).alias("before"))
    pairs = lines.join(after, (F.col("l_orderkey") == F.col("o")) & (F.col("l_linenumber") == F.col("before"))).filter("cell <> neighbour")
    linked = pairs.groupBy(F.least("cell", "neighbour").alias("cell"), F.greatest("cell", "neighbour").alias("neighbour")).agg(F.count("*").alias("weight"))
    labels = d.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("cell"), F.col("s_nationkey").alias("cluster"))

    def valued(tables):
        edges = tables.save(cm.undirected(tables.save(linked, "linked")), "edges")  # read by every sum below
        value = cm.modularity(edges, labels, 0.4)
        return edges.agg(F.countDistinct("a").alias("nodes")).withColumn("modularity", F.round(F.lit(value), 9))

    return kept(spark, "modularity", valued)

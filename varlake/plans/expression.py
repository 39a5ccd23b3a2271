"""Queries on expression counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import expression as x
from ..sources import derived as d
from ..sources.folder import kept
from .register import query


@query("flt_mingenes", f"with {d.RNA}, k as (select cell from rna where cnt>0 group by cell having count(*)>=90) select cell, gene, cnt from rna semi join k using (cell)")
def flt_mingenes(spark, sf_dir):
    return x.cells_with_genes(d.rna(spark, sf_dir), 90).select("cell", "gene", "cnt")


@query("flt_mincells", f"with {d.RNA}, k as (select gene from rna where cnt>0 group by gene having count(*)>=186) select cell, gene, cnt from rna semi join k using (gene)")
def flt_mincells(spark, sf_dir):
    return x.genes_with_cells(d.rna(spark, sf_dir), 186).select("cell", "gene", "cnt")


@query("agg_totals", f"with {d.RNA} select cell, batch, total, mt, genes, round(mt/total*100,9) mt_percent from totals")
def agg_totals(spark, sf_dir):
    return x.cell_totals(d.rna(spark, sf_dir)).withColumn("mt_percent", F.round("mt_percent", 9))


@query("flt_totalp", f"with {d.RNA}, l as (select batch, quantile_cont(total,0.9) lim from totals group by batch) select cell, batch, total from totals join l using (batch) where total<=lim")
def flt_totalp(spark, sf_dir):
    return x.cells_below_percentile(x.cell_totals(d.rna(spark, sf_dir)), 90).select("cell", "batch", "total")


@query("flt_mt", f"with {d.RNA} select cell, round(mt/total*100,9) mt_percent from totals where mt/total*100<=3.2")
def flt_mt(spark, sf_dir):
    return x.cells_below_mt(x.cell_totals(d.rna(spark, sf_dir)), 3.2).select("cell", F.round("mt_percent", 9).alias("mt_percent"))


_NORM = d.RNA + ", tgt as (select quantile_cont(total,0.5) target from totals where total>0), norm as (select rna.cell, gene, ln(1+cnt/total*target) as value from rna join totals using (cell), tgt)"


@query("agg_norm", f"with {_NORM} select cell, gene, round(value,8) as value from norm")
def agg_norm(spark, sf_dir):
    return x.normalised(d.rna(spark, sf_dir)).select("cell", "gene", F.round("value", 8).alias("value"))


_HVG = f"""with {_NORM}, n as (select count(*) n from totals), s as (select gene, sum(exp(value)-1)/max(n) mean, sum(pow(exp(value)-1,2))/max(n) square, max(n) n from norm, n group by gene),
t as (select gene, mean, (square-mean*mean)*n/(n-1.0) variance, ln(1+mean) lm from s), u as (select *, case when variance>0 then ln(variance/mean) end disp from t),
e as (select min(lm) lo, max(lm) hi from u), b as (select *, least(floor((lm-lo)/(hi-lo)*20),19) bin from u, e),
z as (select *, case when disp is null then null when stddev_samp(disp) over (partition by bin)>0 then (disp-avg(disp) over (partition by bin))/stddev_samp(disp) over (partition by bin) else 1.0 end z from b),
r as (select *, row_number() over (order by round(z,9) desc nulls last, gene) as rank from z)
select gene, round(mean,6) mean, round(disp,6) dispersion, round(z,6) z, cast(rank as int) as rank from r where rank<=30"""


@query("agg_hvg", _HVG)
def agg_hvg(spark, sf_dir):
    rna = d.rna(spark, sf_dir)
    cells = rna.select("cell").distinct().count()
    out = x.variable_genes(x.normalised(rna), cells, 30)
    return out.select("gene", F.round("mean", 6).alias("mean"), F.round("dispersion", 6).alias("dispersion"), F.round("z", 6).alias("z"), F.col("rank").cast("int").alias("rank"))


@query("flt_hvg", f"select gene from ({_HVG})")
def flt_hvg(spark, sf_dir):
    return agg_hvg(spark, sf_dir).select("gene")


def _tail_sql(z):
    """The upper tail of the normal distribution, as a series below 2 and a continued fraction above."""
    series, fraction = "0.0", z
    for k in range(40, 0, -1):
        series = f"(({series}+1)*{z}*{z}/{2 * k + 1})"
    for k in range(60, 0, -1):
        fraction = f"({z}+{float(k)}/{fraction})"
    density = f"(exp(-{z}*{z}/2)/sqrt(2*pi()))"
    return f"(case when {z}<2 then 0.5-{density}*{z}*(1+{series}) else {density}/{fraction} end)"


_TAIL = _tail_sql("abs(z)")
_MARK = f"""with {_NORM}, {d.CELLS}, lab as (select cell, celltype grp from cells), c as (select * from lab cross join (select distinct gene from norm)),
v as (select c.gene, c.grp, c.cell, round(coalesce(value,0),9) v from c left join norm using (cell,gene)), r as (select *, rank() over (partition by gene order by v)+(count(*) over (partition by gene, v)-1)/2.0 rk from v),
n as (select count(*) n from lab), g as (select grp, count(*) ng from lab group by grp), t as (select gene, sum(pow(k,3)-k) ties from (select gene, v, cast(count(*) as double) k from v group by all) group by gene),
s as (select gene, grp, sum(rk) rs from r group by all), z as (select gene, grp, (rs-ng*(n+1)/2.0)/sqrt(ng*(n-ng)/12.0*((n+1)-ties/(n*(n-1.0)))) z from s join g using (grp) join t using (gene), n),
f as (select gene, grp, avg(exp(v)-1) m from v group by all), w as (select gene, a.grp, a.m, (select sum(b.m*g.ng) from f b join g on g.grp=b.grp where b.gene=a.gene and b.grp<>a.grp)/(select sum(ng) from g where g.grp<>a.grp) other from f a),
p as (select z.gene, z.grp, z, least(1.0, 2*{_TAIL}) p, ln((m+1e-9)/(other+1e-9))/ln(2.0) change from z join w on w.gene=z.gene and w.grp=z.grp),
a as (select *, least(1.0, p*count(*) over (partition by grp)/row_number() over (partition by grp order by round(p,12), gene)) step from p),
o as (select *, min(step) over (partition by grp order by round(p,12) desc, gene desc rows unbounded preceding) adjusted, row_number() over (partition by grp order by round(z,9) desc, gene) place from a)
select grp, gene, round(z,6) z, round(p,9) p_value, round(adjusted,9) p_adjusted, round(change,6) log2_change, cast(place as int) place from o where place<=20"""


@query("agg_markers", _MARK)
def agg_markers(spark, sf_dir):
    values = x.normalised(d.rna(spark, sf_dir)).withColumn("value", F.round("value", 9))
    labels = d.cells(spark, sf_dir).select("cell", F.col("celltype").alias("grp"))
    six = lambda c, k=6: F.round(c, k).alias(c)
    return x.markers(values, labels).select("grp", "gene", six("z"), six("p_value", 9), six("p_adjusted", 9), six("log2_change"), "place")


@query("jn_genes", f"with {d.RNA} select gene, max(case when batch in ('S0','S2') and gene<>'G7' then 1 else 0 end)=1 in_a, max(case when batch in ('S1','S3') and gene<>'G8' then 1 else 0 end)=1 in_b from rna group by gene")
def jn_genes(spark, sf_dir):
    rna = d.rna(spark, sf_dir)
    return x.gene_union(rna.filter("batch in ('S0', 'S2') and gene <> 'G7'"), rna.filter("batch in ('S1', 'S3') and gene <> 'G8'"))


@query("set_genes", f"with {d.RNA} select distinct gene from rna order by gene")
def set_genes(spark, sf_dir):
    rna = d.rna(spark, sf_dir)
    return x.gene_union(rna.filter("batch in ('S0', 'S2')"), rna.filter("batch in ('S1', 'S3')")).select("gene").orderBy("gene")


@query("prj_layout", f"with {d.RNA}, g as (select gene, cast(row_number() over (order by gene)-1 as int) ix from (select distinct gene from rna where gene like 'G1%')) select cell, gene, cnt, ix from rna join g using (gene)")
def prj_layout(spark, sf_dir):
    from pyspark.sql import Window

    rna = d.rna(spark, sf_dir)
    genes = rna.filter("gene like 'G1%'").select("gene").distinct().withColumn("ix", F.row_number().over(Window.orderBy("gene")) - 1)
    return x.in_layout(rna, genes).select("cell", "gene", "cnt", "ix")


@query("prj_dtype", "select n_nationkey, coalesce(case when n_regionkey=1 then null else n_name end,'') n_name from nation")
def prj_dtype(spark, sf_dir):
    rows = d.table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_regionkey") != 1, F.col("n_name")).alias("n_name"))
    return x.plain_types(rows)


@query("win_catcode", f"with {d.RNA}, b as (select distinct cell, case when batch='S3' then null else batch end batch from rna) select cell, batch, cast(coalesce((select count(distinct o.batch) from b o where o.batch<b.batch),0) as int) code from b")
def win_catcode(spark, sf_dir):
    rows = d.rna(spark, sf_dir).select("cell", F.when(F.col("batch") != "S3", F.col("batch")).alias("batch")).distinct()
    return x.category_codes(rows, "batch").select("cell", "batch", "code")


@query("jn_cells", f"with {d.RNA}, {d.CELLS}, {d.COUNTS[len(d.READS) + 2:]} select distinct rna.cell, batch from rna join (select distinct concat(sample,'_',barcode) cell from counts) c on c.cell=rna.cell")
def jn_cells(spark, sf_dir):
    """Names that no row shares at first; batch_barcode then matches."""
    from ..operators.scoring import aligned_cells

    def aligned(tables):
        """The names are written once: several steps read them."""
        rna_cells = tables.save(d.rna(spark, sf_dir).select("cell", "batch").distinct(), "rna")
        snv_cells = d.matrix(spark, sf_dir).select(F.regexp_replace("cell", "^.*_", "").alias("cell"), F.col("sample").alias("batch"), F.regexp_replace("cell", "^.*_", "").alias("barcode")).distinct()
        return aligned_cells(rna_cells, tables.save(snv_cells, "snv")).select("cell", "batch")

    return kept(spark, "aligned", aligned)


@query("flt_doublet")
def flt_doublet(spark, sf_dir):
    """Cells that are not doublets, with their counts; cells grow with the tables."""

    def left(tables):
        rna = tables.save(d.rna(spark, sf_dir, grown=True), "rna")  # read by several steps
        scores = x.doublet_scores(rna, tables, components=10)
        return x.without_doublets(rna, scores).groupBy("cell", "batch").agg(F.sum("cnt").alias("total"))

    return kept(spark, "doublets", left)

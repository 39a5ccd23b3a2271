"""Queries of the models, with seeded weights, and of the streaming pileup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.statistics import negative_binomial_nll
from ..operators import model as m
from ..operators import scoring as s
from ..operators import training as t
from ..sources import derived as d
from ..sources.folder import kept, shared_folder
from .register import query

GENES = 97


def _code():
    """The place of a variant among those of the model."""
    chrom = F.when(F.col("snv").startswith("chrX"), 22).when(F.col("snv").startswith("chrM"), 23).otherwise(F.regexp_extract("snv", "^chr([0-9]+)", 1).try_cast("int") - 1)
    return (chrom * 5 + F.regexp_extract("snv", ":100([0-9])", 1).cast("int")).cast("int")


def _cells(spark, sf_dir, grown=False):
    """Cells with all genes in order and their non-zero calls."""
    rna = d.rna(spark, sf_dir, grown).select("cell", "batch", F.regexp_extract("gene", "([0-9]+)$", 1).cast("int").alias("g"), "cnt")
    dense = rna.groupBy("cell", "batch").agg(F.map_from_entries(F.collect_list(F.struct("g", "cnt"))).alias("m"))
    # in an array of one, so that the map is made once a cell and not for every gene
    x = F.transform(F.array("m"), lambda m: F.transform(F.sequence(F.lit(0), F.lit(GENES - 1)), lambda i: F.coalesce(m[i], F.lit(0.0))))[0]
    calls = d.matrix(spark, sf_dir, grown).filter("call <> 0").groupBy("cell").agg(F.array_sort(F.collect_list(F.struct(_code().alias("snv"), "call"))).alias("c"))
    rows = dense.join(calls, "cell", "left").select("cell", F.substring("batch", 2, 9).cast("int").alias("batch"), x.alias("x"), F.coalesce("c", F.array().cast("array<struct<snv:int,call:int>>")).alias("c"))
    return rows.select("cell", "batch", "x", F.col("c.snv").alias("snvs"), F.col("c.call").alias("signs"))


def _weights():
    return m.seeded_weights(GENES, 120, batches=4)


@query("ml_encode")
def ml_encode(spark, sf_dir):
    return m.encoded(_cells(spark, sf_dir), _weights())


@query("ml_cond_attn")
def ml_cond_attn(spark, sf_dir):
    return m.attention(_cells(spark, sf_dir), _weights())


@query("ml_delta")
def ml_delta(spark, sf_dir):
    return m.reconstructed(_cells(spark, sf_dir), _weights()).select("cell", "shift")


@query("ml_decode")
def ml_decode(spark, sf_dir):
    return m.reconstructed(_cells(spark, sf_dir), _weights()).select("cell", "mean")


@query("ml_scorecell")
def ml_scorecell(spark, sf_dir):
    return m.counterfactuals(_cells(spark, sf_dir), _weights())


QUERY_TOP = 40


@query("ml_counterfact")
def ml_counterfact(spark, sf_dir):
    """Only for the variants with the most attention."""
    cells, w = _cells(spark, sf_dir), _weights()
    pairs = m.attention(cells, w).withColumn("snv", F.col("snv"))
    top = s.top_by_attention(s.mean_attention(pairs, pairs), QUERY_TOP)
    return m.counterfactuals(cells, w, top)


@query("ml_scoreall")
def ml_scoreall(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    return s.aggregated(m.counterfactuals(cells, _weights()), cells.select(F.explode("snvs").alias("snv")))


@query("ml_bycelltype")
def ml_bycelltype(spark, sf_dir):
    """In every cell type at once: the variants with the most attention there, of these the ones with enough calls of both
    kinds, and only their scores."""
    cells, types = _cells(spark, sf_dir, grown=True), d.cells(spark, sf_dir, grown=True)
    return kept(spark, "bycelltype", lambda tables: m.by_celltype(cells, _weights(), types, tables, QUERY_TOP, 1))


@query("ml_pretrain")
def ml_pretrain(spark, sf_dir):
    """The losses of a few epochs over all cells, with every part of the objective."""
    _, history = t.train_backbone(_cells(spark, sf_dir, grown=True), _weights(), epochs=5, likelihood=True, warm=2, reverse=0.1, reverse_warm=2)
    return spark.createDataFrame([(r["epoch"], r["split"], r["part"], r["value"]) for r in history], "epoch int, split string, part string, value double")


@query("ml_train")
def ml_train(spark, sf_dir):
    """The losses of a few epochs over all cells; the rank term from the third on."""
    _, history = t.train_effect(_cells(spark, sf_dir, grown=True), _weights(), epochs=5, rank=t.Rank(first=3, warm=2))
    return spark.createDataFrame([(r["epoch"], r["part"], r["value"]) for r in history], "epoch int, part string, value double")


_NULL_LOSS = f"""with {d.GROWN_RNA}, genes as (select distinct gene from rna), n as (select count(*) n from totals), means as (select gene, sum(cnt)/max(n.n) mean from rna, n group by gene),
 full_rows as (select c.cell, c.batch, g.gene, g.mean, coalesce(r.cnt,0.0) x from totals c cross join means g left join rna r on r.cell=c.cell and r.gene=g.gene),
 nll as (select cell, batch, -sum(lgamma(1.0+x)-lgamma(1.0)-lgamma(x+1.0)+ln(1.0+0.000001)-ln(1.0+mean+0.000001)+x*(ln(mean+0.000001)-ln(1.0+mean+0.000001))) nll from full_rows group by all)
select 'recon' part, round(avg(nll),6) value, count(*) cells from nll"""


@query("agg_loss", _NULL_LOSS)
def agg_loss(spark, sf_dir):
    """The reconstruction loss of a model that gives every cell the genes' means, from losses per batch as steps report them."""
    rna = d.rna(spark, sf_dir, grown=True)
    n = rna.agg(F.countDistinct("cell").alias("n"))
    means = rna.groupBy("gene").agg(F.sum("cnt").alias("s")).join(n).select("gene", (F.col("s") / F.col("n")).alias("mean"))
    loss = lambda x: negative_binomial_nll(x, F.col("mean"), F.lit(1.0))
    # a count that is not there is 0: what it costs is added for all genes, and taken away where there is one
    zero = means.agg(F.sum(loss(F.lit(0.0))).alias("zero"))
    cells = rna.join(means, "gene").groupBy("cell", "batch").agg(F.sum(loss(F.col("cnt")) - loss(F.lit(0.0))).alias("more")).join(zero)
    steps = cells.groupBy("batch").agg(F.avg(F.col("zero") + F.col("more")).alias("value"), F.count("*").alias("cells")).withColumn("part", F.lit("recon"))
    return t.weighted_losses(steps, ["part"]).select("part", F.round("value", 6).alias("value"), "cells")


_BLOCK = 64
_NAMES = ("batch", "enc1.w", "ln1.g", "mu.b", "dec1.w", "theta", "snv", "cond1.w")


def _tensors(spark, sf_dir):
    """A table of weights: blocks of embeddings, each a tensor, with the names of a model's parts in turn."""
    rows = d.table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / _BLOCK).cast("int").alias("block"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    blocks = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("rows"))
    name = F.concat(F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("block") % len(_NAMES) + 1).cast("int")), F.when(F.col("block") > 0, F.concat(F.lit("."), F.col("block").cast("string"))).otherwise(""))
    return blocks.select(name.alias("name"), F.array(F.size("rows"), F.size(F.col("rows")[0]["v"])).alias("shape"), F.flatten(F.col("rows.v")).alias("data"))


_TENSORS = f"""e as (select cast(vec_id // {_BLOCK} as int) block, vec_id, len(embedding) width, list_sum(list_transform(embedding, lambda x: cast(x as double))) total from embeddings),
 tensors as (select concat(case block % {len(_NAMES)} {' '.join(f"when {i} then '{n}'" for i, n in enumerate(_NAMES))} end, case when block > 0 then concat('.', cast(block as varchar)) else '' end) name,
  block, cast(count(*) as int) height, max(width) width, sum(total) total from e group by block)"""


def _total():
    return F.round(F.aggregate("data", F.lit(0.0), lambda a, x: a + x), 6).alias("total")


@query("jn_weights", f"with {_TENSORS} select name, case when name <> 'batch' and block % 3 <> 0 then 'backbone' else 'model' end origin, case when name <> 'batch' and block % 3 <> 0 then round(total, 6) else 0.0 end total from tensors")
def jn_weights(spark, sf_dir):
    """Names and shapes that agree are taken; a batch embedding never, another shape neither: every third tensor of the model has a row
    more. The model's own values are zeros."""
    backbone = _tensors(spark, sf_dir).withColumn("name", F.concat(F.lit("module."), "name"))
    other = F.regexp_extract("name", "([0-9]*)$", 1)
    more = F.coalesce(F.nullif(other, F.lit("")).cast("int"), F.lit(0)) % 3 == 0
    model = _tensors(spark, sf_dir).select("name", F.when(more & (F.col("name") != "batch"), F.array(F.col("shape")[0] + 1, F.col("shape")[1])).otherwise(F.col("shape")).alias("shape"), F.transform("data", lambda _: F.lit(0.0)).alias("data"))
    out = m.transferred(backbone, model)
    return out.select("name", F.when(F.exists("data", lambda x: x != 0), "backbone").otherwise("model").alias("origin"), _total())


@query("ml_freeze", f"with {_TENSORS} select name, block % {len(_NAMES)} in (0, 4, 5, 6, 7) trained, block % {len(_NAMES)} >= 6 heads_alone from tensors")
def ml_freeze(spark, sf_dir):
    """With the encoder frozen, and with the whole backbone frozen."""
    tensors = _tensors(spark, sf_dir)
    return m.trainable(tensors).join(m.trainable(tensors, "backbone").withColumnRenamed("trained", "heads_alone"), "name")


@query("src_ckpt", f"with {_TENSORS} select name, height, width, round(total, 6) total from tensors")
def src_ckpt(spark, sf_dir):
    """Weights that were written with a prefix, and read as arrays."""
    path = shared_folder(spark, "weights")
    _tensors(spark, sf_dir).withColumn("name", F.concat(F.lit("module."), "name")).write.parquet(path)
    read = m.checkpoint(spark, path)
    return read.select("name", F.col("shape")[0].alias("height"), F.col("shape")[1].alias("width"), _total())


@query("snk_ckpt", f"with {_TENSORS} select name, height * width size, round(total, 6) total from tensors")
def snk_ckpt(spark, sf_dir):
    """Written twice: the second replaces the first as a whole."""
    path = shared_folder(spark, "weights")
    tensors = _tensors(spark, sf_dir)
    m.save_checkpoint(tensors.limit(1), path)
    m.save_checkpoint(tensors, path)
    return m.checkpoint(spark, path).select("name", F.size("data").alias("size"), _total())


@query("stream_pileup", f"with {d.COUNTS} select sample, barcode, chrom, pos, alt_reads, ref_reads, alt_umis, ref_umis from counts")
def stream_pileup(spark, sf_dir):
    """Over reads that arrive in files, the same counts as in one batch."""
    from ..streaming.pileup import counts_of_stream

    return counts_of_stream(spark, d.all_reads(spark, sf_dir), d.read_files(spark, sf_dir, 4), 4).select("sample", "barcode", "chrom", "pos", "alt_reads", "ref_reads", "alt_umis", "ref_umis")

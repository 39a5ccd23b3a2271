"""Selection, ranking, normalisation and aggregation of variant scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import variants as vt
from .quantiles import lower_medians, quantiles


def call_counts(matrix: DataFrame, by: list[str] = ["snv"]) -> DataFrame:
    return matrix.groupBy(*by).agg(F.count_if(F.col("call") == 1).alias("n_pos"), F.count_if(F.col("call") == -1).alias("n_neg"))


def frequent_snvs(matrix: DataFrame, least_pos: int = 100, least_neg: int | None = None) -> DataFrame:
    """Rows of variants with enough cells of both calls; the limits are inclusive."""
    least_neg = least_pos if least_neg is None else least_neg
    kept = call_counts(matrix).filter((F.col("n_pos") >= least_pos) & (F.col("n_neg") >= least_neg)).select("snv")
    return matrix.join(kept, "snv", "left_semi")


def valid_in_celltype(matrix: DataFrame, cells: DataFrame, more_than: int = 20, least_cells: int = 20) -> DataFrame:
    """celltype, snv, n_pos, n_neg with more than the limit of both calls, in cell types of enough cells. A matrix with celltype is not joined."""
    large = cells.groupBy("celltype").agg(F.count("*").alias("cells")).filter(F.col("cells") >= least_cells).select("celltype")
    rows = matrix if "celltype" in matrix.columns else matrix.join(cells.select("cell", "celltype"), "cell")
    counts = call_counts(rows, ["celltype", "snv"]).filter((F.col("n_pos") > more_than) & (F.col("n_neg") > more_than))
    return counts.join(large, "celltype", "left_semi")


def on_standard_chromosomes(snvs: DataFrame) -> DataFrame:
    chrom = F.coalesce(vt.parse_key(F.col("snv"))["chrom"], F.substring_index("snv", ":", 1))
    name = vt.normal_chromosome(chrom)
    return snvs.filter(name.isin([c.lower() for c in vt.STANDARD]))


def segment_softmax(pairs: DataFrame, out: str = "attention", epsilon: float = 1e-12) -> DataFrame:
    """Softmax of logit within each cell, shifted by the cell's largest."""
    w = Window.partitionBy("cell")
    rows = pairs.withColumn("soft_e", F.exp(F.col("logit") - F.max("logit").over(w)))
    return rows.withColumn(out, F.col("soft_e") / (F.sum("soft_e").over(w) + epsilon)).drop("soft_e")


def clamped_softmax(pairs: DataFrame, out: str = "attention", most: float = 50.0, epsilon: float = 1e-12) -> DataFrame:
    """The ranking form: no shift, logits clamped."""
    rows = pairs.withColumn("soft_e", F.exp(F.least(F.col("logit"), F.lit(most))))
    return rows.withColumn(out, F.col("soft_e") / (F.sum("soft_e").over(Window.partitionBy("cell")) + epsilon)).drop("soft_e")


def mean_attention(pairs: DataFrame, snvs: DataFrame) -> DataFrame:
    """snv, attention: mean over carriers, 0 without any, never below 0."""
    sums = pairs.groupBy("snv").agg(F.sum("attention").alias("s"), F.count("*").alias("n"))
    return snvs.select("snv").distinct().join(sums, "snv", "left").select("snv", F.greatest(F.lit(0.0), F.coalesce(F.col("s") / F.greatest(F.lit(1), F.col("n")), F.lit(0.0))).alias("attention"))


def top_by_attention(scores: DataFrame, k: int = 2000) -> DataFrame:
    """The k best, ties by name; -1 keeps all."""
    ordered = scores.orderBy(F.desc("attention"), "snv")
    return ordered if k < 0 else ordered.limit(k)


def top_then_valid(scores: DataFrame, valid: DataFrame, k: int = 2000) -> DataFrame:
    """In each cell type the k best first and the valid ones of them second: the order matters."""
    place = F.row_number().over(Window.partitionBy("celltype").orderBy(F.desc("attention"), "snv"))
    rows = scores.withColumn("place", place)
    return (rows if k < 0 else rows.filter(F.col("place") <= k)).join(valid.select("celltype", "snv"), ["celltype", "snv"], "left_semi")


def top_by_calls(counts: DataFrame, n: int = 50) -> DataFrame:
    return counts.withColumn("total", F.col("n_pos") + F.col("n_neg")).orderBy(F.desc("total"), "snv").limit(n)


def top_in_group(rows: DataFrame, group: str, order: list, k: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("place") <= k)


def best_per_snv(scores: DataFrame, score: str = "score_euclidean") -> DataFrame:
    """One row per cell type and variant: the highest score, missing ones last, then the first in the original order."""
    best = F.row_number().over(Window.partitionBy("celltype", "snv").orderBy(F.desc_nulls_last(F.nanvl(score, F.lit(None).cast("double"))), "ord"))
    return scores.withColumn("best", best).filter("best = 1").drop("best")


def min_max(rows: DataFrame, score: str, out: str) -> DataFrame:
    """Scaled to 0..1 over the whole table; 0 when all values are one; missing stays missing."""
    value = F.nanvl(F.col(score).try_cast("double"), F.lit(None).cast("double"))
    ends = rows.agg(F.min(value).alias("mm_low"), F.max(value).alias("mm_high"))
    span = F.col("mm_high") - F.col("mm_low")
    scaled = F.when(value.isNull(), None).when(span <= 0, 0.0).otherwise((value - F.col("mm_low")) / span)
    return rows.join(ends).withColumn(out, scaled).drop("mm_low", "mm_high")


def cell_perturbation(matrix: DataFrame, cells: DataFrame, scores: DataFrame, score: str = "score_euclidean") -> DataFrame:
    """cell, celltype, perturbation: mean score of the variants a cell carries, 0 without any; log1p for distances."""
    carried = matrix.filter("call = 1").select("cell", "snv").join(cells.select("cell", "celltype"), "cell")
    means = carried.join(scores.select("celltype", "snv", score), ["celltype", "snv"]).groupBy("cell").agg(F.avg(score).alias("m"))
    value = F.coalesce("m", F.lit(0.0))
    if "euclidean" in score:
        value = F.log1p(value)
    return cells.select("cell", "celltype").join(means, "cell", "left").select("cell", "celltype", value.alias("perturbation"))


ROUNDING = 1e-12  # a spread that is smaller against the values is left by the order of sums


def within_celltype_z(rows: DataFrame, value: str = "perturbation", out: str = "z") -> DataFrame:
    """Population z-score within the cell type; 0 where there is no spread but that of rounding. Two numbers per cell type are joined back, so
    that no window holds a cell type."""
    stats = rows.groupBy("celltype").agg(F.avg(value).alias("zs_m"), F.stddev_pop(value).alias("zs_s"), F.max(F.abs(value)).alias("zs_most"))
    z = F.when(F.col("zs_s") > ROUNDING * F.col("zs_most"), (F.col(value) - F.col("zs_m")) / F.col("zs_s")).otherwise(0.0)
    return rows.join(stats, "celltype").withColumn(out, z).drop("zs_m", "zs_s", "zs_most")


def strongly_perturbed(rows: DataFrame, limit: float = 1.0) -> DataFrame:
    return rows.filter(F.abs("z") >= limit).withColumn("high_perturbation", F.col("z") >= limit)


def capped(rows: DataFrame, value: str = "perturbation", share: float = 0.9) -> DataFrame:
    """value capped at its cell type's quantile (linear interpolation); a cell type without values has no cap."""
    limits = quantiles(rows, ["celltype"], value, {"cap": share})
    return rows.join(limits, "celltype", "left").withColumn("capped", F.least(F.col(value), F.coalesce("cap", F.col(value)))).drop("cap")


def aggregated(pairs: DataFrame, snvs: DataFrame, use_mean: bool = True) -> DataFrame:
    """snv, cosine, euclidean: mean or lower median over carriers, 0 without any."""
    if use_mean:
        out = pairs.groupBy("snv").agg(F.avg("score_cosine_distance").alias("c"), F.avg("score_euclidean").alias("e"))
    else:
        out = lower_medians(pairs, ["snv"], "score_cosine_distance", out="c").join(lower_medians(pairs, ["snv"], "score_euclidean", out="e"), "snv", "full")
    return snvs.select("snv").distinct().join(out, "snv", "left").select("snv", F.coalesce("c", F.lit(0.0)).alias("score_cosine_distance"), F.coalesce("e", F.lit(0.0)).alias("score_euclidean"))


def cell_totals(rna: DataFrame, matrix: DataFrame) -> DataFrame:
    """cell, log_umi, log_snv: log1p of all counts and of the variants with a call."""
    umi = rna.groupBy("cell").agg(F.log1p(F.sum("cnt")).alias("log_umi"))
    snv = matrix.filter("call <> 0").groupBy("cell").agg(F.log1p(F.count("*")).alias("log_snv"))
    return umi.join(snv, "cell", "left").select("cell", "log_umi", F.coalesce("log_snv", F.lit(0.0)).alias("log_snv"))


def aligned_cells(rna_cells: DataFrame, snv_cells: DataFrame) -> DataFrame:
    """Cells in both, in the order of the first (cell, ord, batch). If no name is in both, batch_barcode of the second is
    tried; repeated names are an error, and so is no overlap at all."""
    def once(rows: DataFrame) -> DataFrame:
        n = rows.groupBy("cell").agg(F.count("*").alias("al_n"))
        ok = F.assert_true(F.col("al_n") == 1, F.concat(F.lit("cell is given twice: "), "cell")).isNull()
        return rows.join(n, "cell").filter(ok).drop("al_n")

    plain = once(rna_cells).join(snv_cells.select("cell").distinct(), "cell", "left_semi")
    if not plain.isEmpty():
        return plain
    composite = snv_cells.select(F.concat("batch", F.lit("_"), "barcode").alias("cell")).distinct()
    out = once(rna_cells).join(composite, "cell", "left_semi")
    if out.isEmpty():
        raise ValueError("expression and variants have no cell in common, neither by name nor by batch_barcode")
    return out


# Columns of annotation files, the first that is there and not null counts.
FIELDS = {
    "Func": ["Func.refGeneWithVer", "Func.refGene"], "Gene": ["Gene.refGeneWithVer", "Gene.refGene"], "CLNALLELEID": ["CLNALLELEID"],
    "CLNDN": ["CLNDN"], "CLNSIG": ["CLNSIG"], "GeneDetail": ["GeneDetail.refGeneWithVer", "GeneDetail.refGene"], "ExonicFunc": ["ExonicFunc.refGeneWithVer", "ExonicFunc.refGene"],
}


def prepared_annotation(ann: DataFrame) -> DataFrame:
    """ann with ann_chrom, ann_pos, ann_ref, ann_alt, ann_name and ann_row. Columns are found whatever their case;
    positions are rounded half to even; names are built where no name column is."""
    low = {c.lower(): c for c in ann.columns}
    col = lambda *names: next((F.col(f"`{low[n]}`").cast("string") for n in names if n in low), F.lit(None).cast("string"))
    pos = F.rint(col("start", "pos", "position").try_cast("double")).cast("int")
    chrom = vt.normal_chromosome(col("chr", "chrom", "chromosome"))
    ref, alt = F.upper(col("ref", "reference")), F.upper(col("alt", "alternate"))
    built = F.concat(chrom, F.lit(":"), pos.cast("string"), F.lit("_"), ref, F.lit(">"), alt)
    return ann.select("*", chrom.alias("ann_chrom"), pos.alias("ann_pos"), ref.alias("ann_ref"), alt.alias("ann_alt"), F.coalesce(col("name", "snv", "variant", "id"), built).alias("ann_name"))


NAMES = ("name", "snv", "variant", "id")


def annotated(snvs: DataFrame, ann: DataFrame, order: str) -> DataFrame:
    """Each variant with the whole first row, by `order`, that has its text in the first name column in which any row has
    it, of the columns of ann from left to right; else of one at its place; else of one by its built name. Seven text fields."""
    rows = prepared_annotation(ann)
    pick = [F.coalesce(*[F.col(f"`{c}`").cast("string") for c in names if c in ann.columns], F.lit("")).alias(k) for k, names in FIELDS.items()]
    named = [F.struct(F.lit(i).alias("column"), F.col(f"`{c}`").cast("string").alias("text")) for i, c in enumerate(ann.columns) if c.lower() in NAMES]
    named.append(F.struct(F.lit(len(ann.columns)).alias("column"), F.col("ann_name").alias("text")))
    rows = rows.select(F.col(f"`{order}`").alias("ann_ord"), "ann_chrom", "ann_pos", "ann_ref", "ann_alt", F.array(*named).alias("named"), F.struct(*pick).alias("f"))
    texts = rows.select("ann_ord", "f", F.inline("named")).filter("text is not null")
    own = F.col("column") < len(ann.columns)
    first = F.struct("column", "ann_ord")
    by_name = texts.groupBy("text").agg(F.min_by(F.when(own, F.col("f")), F.when(own, first)).alias("f1"), F.min_by("f", "ann_ord").alias("f3"))
    by_place = rows.groupBy("ann_chrom", "ann_pos", "ann_ref", "ann_alt").agg(F.min_by("f", "ann_ord").alias("f2"))
    key = vt.parse_key(F.col("snv"))
    left = snvs.withColumns({"k_chrom": vt.normal_chromosome(key["chrom"]), "k_pos": key["pos"], "k_ref": key["ref"], "k_alt": key["alt"]})
    out = left.join(by_name, left["snv"] == F.col("text"), "left").join(by_place, (F.col("k_chrom") == F.col("ann_chrom")) & (F.col("k_pos") == F.col("ann_pos")) & (F.col("k_ref") == F.col("ann_ref")) & (F.col("k_alt") == F.col("ann_alt")), "left")
    found = F.coalesce("f1", "f2", "f3")
    return out.select(*snvs.columns, *(F.coalesce(found[k], F.lit("")).alias(k) for k in FIELDS))

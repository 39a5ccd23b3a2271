"""Quality control, normalisation and markers of expression counts in long form: (cell, batch, gene, cnt)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statistics import normal_tail
from ..sources.folder import Tables, kept
from .blocks import numbered
from .quantiles import quantiles


def cells_with_genes(rna: DataFrame, least: int = 100) -> DataFrame:
    kept = rna.groupBy("cell").agg(F.count_if(F.col("cnt") > 0).alias("g")).filter(F.col("g") >= least).select("cell")
    return rna.join(kept, "cell", "left_semi")


def genes_with_cells(rna: DataFrame, least: int = 100) -> DataFrame:
    kept = rna.groupBy("gene").agg(F.count_if(F.col("cnt") > 0).alias("c")).filter(F.col("c") >= least).select("gene")
    return rna.join(kept, "gene", "left_semi")


def is_mitochondrial(gene: Column) -> Column:
    return F.upper(gene).startswith("MT-")


def cell_totals(rna: DataFrame) -> DataFrame:
    """cell, batch, total, mt, genes, mt_percent (null for a cell without counts)."""
    out = rna.groupBy("cell", "batch").agg(F.sum("cnt").alias("total"), F.sum(F.when(is_mitochondrial(F.col("gene")), F.col("cnt")).otherwise(0.0)).alias("mt"), F.count_if(F.col("cnt") > 0).alias("genes"))
    return out.withColumn("mt_percent", F.when(F.col("total") > 0, F.col("mt") / F.col("total") * 100))


def cells_below_percentile(totals: DataFrame, percentile: float = 99.5) -> DataFrame:
    """Cells whose total is at most their batch's percentile (linear interpolation); a missing batch is a batch."""
    if not 0 < percentile < 100:
        raise ValueError("percentile must lie between 0 and 100")
    batch = F.coalesce("batch", F.lit("__MISSING__"))
    limits = quantiles(totals.select(batch.alias("b"), "total"), ["b"], "total", {"limit": percentile / 100})
    return totals.join(limits, batch == F.col("b")).filter("total <= limit").select(totals.columns)


def cells_below_mt(totals: DataFrame, most: float = 15.0) -> DataFrame:
    """A cell without counts has no percentage and goes."""
    return totals.filter(F.col("mt_percent") <= most)


def normalised(rna: DataFrame, target: float | None = None) -> DataFrame:
    """value: log1p of the count scaled to the target total per cell; by default the median total of cells with counts."""
    totals = rna.groupBy("cell").agg(F.sum("cnt").alias("total")).filter("total > 0")
    if target is None:
        totals = totals.join(quantiles(totals, [], "total", {"target": 0.5}))
    else:
        totals = totals.withColumn("target", F.lit(float(target)))
    return rna.join(totals, "cell").withColumn("value", F.log1p(F.col("cnt") / F.col("total") * F.col("target"))).drop("total", "target")


def variable_genes(values: DataFrame, cells: int, top: int = 10_000, bins: int = 20) -> DataFrame:
    """gene, mean, dispersion, z, rank: dispersion standardised within bins of the mean, zeros counted as values."""
    x = F.expm1("value")
    stats = values.groupBy("gene").agg((F.sum(x) / cells).alias("mean"), (F.sum(x * x) / cells).alias("square"))
    stats = stats.withColumn("variance", (F.col("square") - F.col("mean") * F.col("mean")) * (cells / max(1, cells - 1)))
    mean = F.when(F.col("mean") == 0, F.lit(1e-12)).otherwise(F.col("mean"))
    stats = stats.withColumn("log_mean", F.log1p("mean")).withColumn("dispersion", F.when(F.col("variance") > 0, F.ln(F.col("variance") / mean)))
    ends = stats.agg(F.min("log_mean").alias("low"), F.max("log_mean").alias("high"))
    span = F.col("high") - F.col("low")
    stats = stats.join(ends).withColumn("bin", F.when(span > 0, F.least(F.floor((F.col("log_mean") - F.col("low")) / span * bins), F.lit(bins - 1))).otherwise(F.lit(0)))
    w = Window.partitionBy("bin")
    sd = F.stddev_samp("dispersion").over(w)
    # a bin of one gene has no deviation: the gene is 1 by convention
    z = F.when(sd > 0, (F.col("dispersion") - F.avg("dispersion").over(w)) / sd).otherwise(F.lit(1.0))
    stats = stats.withColumn("z", F.when(F.col("dispersion").isNotNull(), z))
    ranked = stats.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(F.round("z", 9)), "gene")))
    return ranked.filter(F.col("rank") <= top).select("gene", "mean", "dispersion", "z", "rank")


def markers(values: DataFrame, labels: DataFrame, top: int | None = 20) -> DataFrame:
    """Per group the genes with the highest Wilcoxon rank-sum z against all other cells: grp, gene, z, p_value (both tails), p_adjusted (step-up, over
    all genes of the group), log2_change (of mean counts, expm1 of the values, against the other cells) and place; top None returns all genes. values:
    (cell, gene, value) of non-zero values; zeros tie below them and are counted, not stored. labels: (cell, grp).
    Ranks are taken over the distinct values of a gene, counted and written once, so that no window holds a gene's cells."""

    def make(tables: Tables) -> DataFrame:
        n = labels.count()
        sizes = labels.groupBy("grp").agg(F.count("*").alias("n_grp"))
        per = tables.save(values.filter("value > 0").join(labels, "cell").groupBy("gene", "value", "grp").agg(F.count("*").alias("k")), "per")
        ties = per.groupBy("gene", "value").agg(F.sum("k").alias("t"))
        whole = per.groupBy("gene").agg(F.sum("k").alias("nz"), F.sum(F.col("k") * F.expm1("value")).alias("sum_all"))
        run = Window.partitionBy("gene").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        ranked = ties.join(whole, "gene").withColumn("zeros", F.lit(n) - F.col("nz"))
        ranked = ranked.withColumn("mid", F.col("zeros") + F.sum("t").over(run) - F.col("t") + (F.col("t") + 1) / 2)
        cube = lambda t: F.pow(t.cast("double"), F.lit(3.0)) - t
        tie = ranked.groupBy("gene", "zeros", "sum_all").agg((F.sum(cube(F.col("t"))) + cube(F.col("zeros"))).alias("ties"))
        upper = per.join(ranked.select("gene", "value", "mid"), ["gene", "value"]).groupBy("gene", "grp").agg(F.sum(F.col("k") * F.col("mid")).alias("rank_sum"), F.sum("k").alias("nz_grp"), F.sum(F.col("k") * F.expm1("value")).alias("sum_grp"))
        # every gene in every group, also where it has no count; groups are few
        groups = sizes.agg(F.collect_list(F.struct("grp", "n_grp")).alias("groups"))
        each = tie.join(groups).select("gene", "zeros", "sum_all", "ties", F.explode("groups").alias("g")).select("gene", "zeros", "sum_all", "ties", "g.*")
        out = each.join(upper, ["gene", "grp"], "left").na.fill({"rank_sum": 0.0, "nz_grp": 0, "sum_grp": 0.0})
        rank_sum = F.col("rank_sum") + (F.col("n_grp") - F.col("nz_grp")) * (F.col("zeros") + 1) / 2
        rest = F.lit(n) - F.col("n_grp")
        variance = F.col("n_grp") * rest / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1.0)))
        out = out.withColumn("z", F.when(variance > 0, (rank_sum - F.col("n_grp") * (n + 1) / 2.0) / F.sqrt(variance)).otherwise(F.lit(0.0)))
        mean, other = F.col("sum_grp") / F.col("n_grp"), F.when(rest > 0, (F.col("sum_all") - F.col("sum_grp")) / rest).otherwise(0.0)
        out = out.select("grp", "gene", "z", F.least(F.lit(1.0), 2 * normal_tail(F.abs("z"))).alias("p_value"), F.log2((mean + 1e-9) / (F.greatest(other, F.lit(0.0)) + 1e-9)).alias("log2_change"))
        # a group has at most as many rows as there are genes; p-values that rounding tells apart are tied
        order = Window.partitionBy("grp").orderBy(F.round("p_value", 12), "gene")
        step = F.least(F.lit(1.0), F.col("p_value") * F.count("*").over(Window.partitionBy("grp")) / F.row_number().over(order))
        back = Window.partitionBy("grp").orderBy(F.desc(F.round("p_value", 12)), F.desc("gene")).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("step", step).withColumn("p_adjusted", F.min("step").over(back))
        place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc(F.round("z", 9)), "gene"))
        out = out.withColumn("place", place).select("grp", "gene", "z", "p_value", "p_adjusted", "log2_change", "place")
        return out if top is None else out.filter(F.col("place") <= top)

    return kept(values.sparkSession, "markers", make)


def gene_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """gene, in_a, in_b: in long form no zeros need to be filled in."""
    both = a.select("gene", F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select("gene", F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.groupBy("gene").agg((F.max("a") == 1).alias("in_a"), (F.max("b") == 1).alias("in_b"))


def in_layout(rna: DataFrame, genes: DataFrame) -> DataFrame:
    """rna in a gene layout (gene, ix). A listed gene that no row has is an error naming the first five."""
    missing = genes.join(rna.select("gene").distinct(), "gene", "left_anti").agg(F.array_join(F.slice(F.array_sort(F.collect_set("gene")), 1, 5), ", ").alias("missing"))
    checked = rna.join(genes, "gene").join(missing)
    fine = F.assert_true(F.col("missing") == "", F.concat(F.lit("genes are missing: "), "missing")).isNull()
    return checked.filter(fine).drop("missing")


def category_codes(rows: DataFrame, column: str, out: str = "code") -> DataFrame:
    """Codes from 0 in sorted order; a missing category is 0."""
    codes = rows.select(column).distinct().filter(F.col(column).isNotNull())
    codes = codes.withColumn(out, F.row_number().over(Window.orderBy(column)) - 1)
    return rows.join(codes, column, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def plain_types(rows: DataFrame) -> DataFrame:
    """Strings without nulls, for tables whose reader knows no nulls."""
    return rows.select(*(F.coalesce(F.col(n), F.lit("")).alias(n) if t == "string" else F.col(n) for n, t in rows.dtypes))


def simulated_doublets(cells: DataFrame, factor: int = 2, seed: int = 7) -> DataFrame:
    """batch, id, cell: `factor` doublets per cell, each of two cells of its batch (a row for each). In every round the
    cells of a batch are dealt into small buckets by a hash, and each is paired with the next of its bucket, the last with
    the first, so that no window holds a batch. A cell alone in its bucket is paired with itself. cells: (batch, cell)."""
    sizes = cells.groupBy("batch").agg(F.count("*").alias("n"))
    dealt = cells.join(sizes.withColumnRenamed("batch", "own"), F.col("batch").eqNullSafe(F.col("own"))).drop("own")
    dealt = dealt.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(factor))))
    draw = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), "round", "cell")
    dealt = dealt.withColumns({"bucket": F.pmod(draw("bucket"), F.ceil(F.col("n") / 64)), "place": draw("place")})
    ring = Window.partitionBy("batch", "round", "bucket").orderBy("place", "cell")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = F.coalesce(F.lead("cell").over(ring), F.first("cell").over(whole))
    pairs = dealt.withColumn("other", other)
    name = F.concat_ws("+", "cell", "other", F.col("round").cast("string"))
    return pairs.select("batch", name.alias("id"), F.explode(F.array("cell", "other")).alias("cell"))


COMPONENTS, OVERSAMPLED, PASSES = 30, 10, 4


def principal_axes(points: DataFrame, width: int, components: int = COMPONENTS, passes: int = PASSES, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Means, and the first principal axes as columns, by randomised subspace iteration over sparse rows (ix, v): every pass multiplies a block of
    components + OVERSAMPLED directions by the covariance. What a task returns, and what the driver holds, has the size width * directions."""
    from .training import summed_over

    def moments(b: pa.RecordBatch) -> dict:
        ix, v = b["ix"].flatten().to_numpy(), b["v"].flatten().to_numpy()
        return {"n": np.float64(len(b)), "sum": np.bincount(ix, v, width)}

    first = summed_over(points, moments)
    if "n" not in first:
        return np.zeros(width), np.zeros((width, 0))
    n, mean = float(first["n"][0]), first["sum"] / float(first["n"][0])
    directions = min(width, components + OVERSAMPLED)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, directions)))[0]
    for _ in range(passes):

        def product(b: pa.RecordBatch, q: np.ndarray = q) -> dict:
            of = np.repeat(np.arange(len(b)), b["ix"].value_lengths().to_numpy())
            ix, v = b["ix"].flatten().to_numpy(), b["v"].flatten().to_numpy()
            along = np.stack([np.bincount(of, v * q[ix, j], len(b)) for j in range(directions)], 1)
            return {"p": np.stack([np.bincount(ix, v * along[of, j], width) for j in range(directions)], 1)}

        p = summed_over(points, product)["p"].reshape(width, directions) / n - np.outer(mean, mean @ q)
        inner = q.T @ p
        q_next, _ = np.linalg.qr(p)
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        axes = (q @ turn)[:, ::-1][:, :components]
        q = q_next
    return mean, axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1, 1)


def valley(counts: np.ndarray, most: int = 10_000) -> float | None:
    """Where a histogram over 0..1, smoothed until it has two peaks, is lowest between them; None if it never has two."""
    smooth = np.asarray(counts, float)
    for _ in range(most):
        around = np.concatenate([[-1], smooth, [-1]])
        flat = [i for i in range(len(smooth)) if around[i + 1] > around[i] and around[i + 1] >= around[i + 2]]
        peaks = [i for i in flat if smooth[i] > 0]
        if len(peaks) == 2:
            low = peaks[0] + int(np.argmin(smooth[peaks[0]:peaks[1] + 1]))
            return (low + 0.5) / len(smooth)
        if len(peaks) < 2:
            return None
        smooth = np.convolve(np.concatenate([smooth[:1], smooth, smooth[-1:]]), np.ones(3) / 3, "valid")
    return None


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batch, id, ix, v of (batch, id, x), where x lists (ix, v) in any order: v of equal ix is added up, scaled to one total, and its logarithm taken."""
    for whole in batches:
        for start in range(0, len(whole), 1024):  # memory does not grow with the batch's counts
            b = whole.slice(start, 1024)
            of, x = np.repeat(np.arange(len(b)), b["x"].value_lengths().to_numpy()), b["x"].flatten()
            ix, v = x.field("ix").to_numpy(), x.field("v").to_numpy()
            order = np.lexsort((ix, of))
            of, ix, v = of[order], ix[order], v[order]
            at = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (ix[1:] != ix[:-1]))) if len(of) else np.zeros(0, int)
            of, ix, v = of[at], ix[at], np.add.reduceat(v, at) if len(at) else v
            of, ix, v = of[v != 0], ix[v != 0], v[v != 0]
            v = np.log1p(v * TARGET / np.maximum(np.bincount(of, v, len(b)), 1e-12)[of])
            ends = np.append(0, np.cumsum(np.bincount(of, minlength=len(b)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b["batch"], b["id"], pa.ListArray.from_arrays(ends, pa.array(ix, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(v))], names=["batch", "id", "ix", "v"])


def doublet_scores(rna: DataFrame, tables: Tables, genes: DataFrame | None = None, factor: int = 2, k: int = 15, rate: float = 0.05, threshold: float | None = None, seed: int = 7, components: int = COMPONENTS) -> DataFrame:
    """cell, batch, simulated (share of simulated doublets among about the k nearest neighbours in the cell's batch), doublet_score
    (the likelihood that follows from that share and the expected rate) and doublet (score above the threshold).

    Simulated doublets are sums of two cells. Counts over `genes` (default: every gene of rna) are scaled to the same total, so that two cells of one
    kind look like one, and their logarithms are projected on the principal axes of
    the cells; neighbours are those of the forest in that space. Without a threshold, shares above the valley between the two peaks of the simulated
    doublets' own shares are doublets: some of them resemble single cells and some do not. Where there is no valley, DEFAULT is the threshold. The result is one of `tables`."""
    from .neighbours import forest_neighbours

    rna = rna.select("batch", F.col("cell").cast("string").alias("cell"), F.col("gene").cast("string").alias("gene"), "cnt")
    genes = (rna if genes is None else genes).select(F.col("gene").cast("string").alias("gene")).distinct()
    places = tables.save(numbered(genes, [F.col("gene")], "ix", tables, "doublet-order"), "doublet-genes")
    width = places.count()
    # a cell is one row from here on; without any of the genes it is at the origin
    entry = F.when(F.col("ix").isNotNull() & F.col("cnt").isNotNull(), F.struct(F.col("ix").cast("int").alias("ix"), F.col("cnt").cast("double").alias("v")))
    lists = tables.save(rna.join(places, "gene", "left").groupBy("batch", "cell").agg(F.collect_list(entry).alias("x")), "doublet-cells")
    half = lists.select(F.col("batch").alias("own"), F.col("cell").alias("half"), "x")
    made = simulated_doublets(lists.select("batch", "cell"), factor, seed)
    summed = made.join(half, (F.col("cell") == F.col("half")) & F.col("batch").eqNullSafe(F.col("own"))).groupBy("batch", "id").agg(F.flatten(F.collect_list("x")).alias("x"))
    kind = f"batch {dict(rna.dtypes)['batch']}, id string, ix array<int>, v array<double>"
    single = tables.save(lists.select("batch", F.col("cell").alias("id"), "x").mapInArrow(_scaled, kind), "doublet-points")
    mean, axes = principal_axes(single.select("ix", "v"), max(1, width), components, seed=seed)
    held = rna.sparkSession.sparkContext.broadcast((mean @ axes, axes))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, axes = held.value
        for b in batches:
            of = np.repeat(np.arange(len(b)), b["ix"].value_lengths().to_numpy())
            ix, v = b["ix"].flatten().to_numpy(), b["v"].flatten().to_numpy()
            z = np.stack([np.bincount(of, v * axis[ix], len(b)) for axis in axes.T], 1) if axes.size else np.zeros((len(b), 1))
            yield pa.RecordBatch.from_arrays([b["batch"], b["made"], b["id"], pa.array([*(z - centre if axes.size else z)], pa.list_(pa.float64()))], names=["batch", "made", "cell", "z"])

    both = single.withColumn("made", F.lit(False)).unionByName(summed.mapInArrow(_scaled, kind).withColumn("made", F.lit(True)))
    placed = both.mapInArrow(project, f"batch {dict(rna.dtypes)['batch']}, made boolean, cell string, z array<double>")
    # a batch is a group of neighbours; the lowest bit of a point's number tells simulated doublets
    number = F.monotonically_increasing_id() * 2 + F.col("made").cast("long")
    points = tables.save(placed.select(number.alias("id"), F.xxhash64("batch").alias("grp"), "batch", "made", "cell", "z"), "points")
    near = forest_neighbours(points.select("id", "grp", "z"), tables, k)
    simulated = F.aggregate("near", F.lit(0), lambda n, b: n + b.bitwiseAND(1).cast("int"))
    shares = points.select("id", "batch", "made", "cell").join(near.select("id", simulated.alias("m"), F.size("near").alias("n")), "id").filter("n > 0")
    # the estimate of Wolock, Lopez and Klein (2019): a smoothed share, and the odds at the expected rate
    q = (F.col("m") + 1) / (F.col("n") + 2)
    odds = q * rate / factor / (1 - rate - q * (1 - rate - rate / factor))
    scored = tables.save(shares.select("batch", "made", "cell", (F.col("m") / F.col("n")).alias("simulated"), odds.alias("doublet_score")), "doublet-scored")
    above = F.col("doublet_score") > (DEFAULT if threshold is None else threshold)
    if threshold is None:
        counts = {r["b"]: r["n"] for r in scored.filter("made").groupBy(F.round(F.col("simulated") * k).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()}
        low = valley(np.array([counts.get(b, 0) for b in range(k + 1)]))
        above = above if low is None else F.col("simulated") > low
    return scored.filter("not made").select("cell", "batch", "simulated", "doublet_score", above.alias("doublet"))


DEFAULT, TARGET = 0.25, 10_000.0  # the threshold of scores without a valley; the total of scaled counts


def without_doublets(rna: DataFrame, scores: DataFrame) -> DataFrame:
    """rna without the cells that scores call doublets; a cell without a score stays."""
    gone = scores.filter("doublet").select(F.col("batch").alias("db_batch"), F.col("cell").alias("db_cell"))
    return rna.join(gone, rna["batch"].eqNullSafe(F.col("db_batch")) & (rna["cell"] == F.col("db_cell")), "left_anti")

"""The expression backbone and the variant-effect model: inference over cells. Training is in `training`.

Weights are a table (name, shape, data), broadcast as arrays: their size is that of the model, not of the data. A cell is
one row: cell, batch int, x array<double> (genes in layout order), snvs array<int> and signs array<int> (its non-zero
calls). All pairs of a cell are in its row, so attention needs no shuffle; results per pair are rows again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folder import Tables
from ..sources.stages import publish, published
from . import scoring

Weights = dict[str, np.ndarray]


def seeded_weights(genes: int, snvs: int, latent: int = 16, embedding: int = 8, batches: int = 1, batch_embedding: int = 4, hidden: tuple[int, int] = (64, 32), seed: int = 42) -> Weights:
    """A model with weights drawn from a seed; layer widths are parameters (512 and 256 in production)."""
    rng = np.random.default_rng(seed)
    lin = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
    h, g = hidden
    w = {"enc1.w": lin(genes, h), "enc1.b": np.zeros(h), "ln1.g": np.ones(h), "ln1.b": np.zeros(h), "enc2.w": lin(h, g), "enc2.b": np.zeros(g), "ln2.g": np.ones(g), "ln2.b": np.zeros(g),
         "mu.w": lin(g, latent), "mu.b": np.zeros(latent), "var.w": lin(g, latent) * 0.1, "var.b": np.zeros(latent), "batch": rng.normal(0, 1, (max(1, batches), batch_embedding)),
         "dec1.w": lin(latent + batch_embedding, g), "dec1.b": np.zeros(g), "dec2.w": lin(g, genes), "dec2.b": np.zeros(genes), "theta": np.zeros(genes),
         "snv": rng.normal(0, 1, (snvs, embedding)), "cond1.w": lin(latent + embedding, embedding), "cond1.b": np.zeros(embedding), "cond2.w": lin(embedding, embedding), "cond2.b": np.zeros(embedding),
         "attn1.w": lin(latent + embedding, 32), "attn1.b": np.zeros(32), "attn2.w": lin(32, 1), "attn2.b": np.zeros(1), "proj.w": lin(embedding, latent), "proj.b": np.zeros(latent)}
    return w


def weights_table(spark: SparkSession, w: Weights) -> DataFrame:
    return spark.createDataFrame([(k, list(map(int, v.shape)), v.astype(float).ravel().tolist()) for k, v in w.items()], "name string, shape array<int>, data array<double>")


def save_checkpoint(weights: DataFrame, path: str) -> None:
    """A table of weights (name, shape, data) under a path that names the version in use: a new version is written whole before a
    pointer to it replaces the old one, so that a write that fails leaves the old weights."""
    publish(weights, path)


def checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """The weights in use at a path, of save_checkpoint() or a plain table; names lose a leading 'module.'."""
    return published(spark, path).withColumn("name", F.regexp_replace("name", "^module\\.", ""))


def from_table(rows: DataFrame) -> Weights:
    """Names lose a leading 'module.'; the rows are the model's tensors, a fixed number."""
    return {r["name"].removeprefix("module."): np.array(r["data"]).reshape(r["shape"]) for r in rows.collect()}


def transferred(backbone: DataFrame, model: DataFrame) -> DataFrame:
    """model's weights with those of the backbone that agree in name and shape, but not the batch embedding."""
    b = backbone.select(F.regexp_replace("name", "^module\\.", "").alias("name"), "shape", F.col("data").alias("given")).filter("name <> 'batch'")
    return model.join(b, ["name", "shape"], "left").select("name", "shape", F.coalesce("given", "data").alias("data"))


def trainable(model: DataFrame, frozen: str = "encoder") -> DataFrame:
    """name, trained: 'encoder' freezes the encoder alone, 'backbone' all but the variant heads, '' nothing."""
    parts = {"encoder": "^(enc|ln|mu|var)", "backbone": "^(enc|ln|mu|var|dec|theta|batch)", "": "^$"}[frozen]
    return model.select("name", (~F.regexp_like("name", F.lit(parts))).alias("trained"))


def _norm(x: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5) * g + b


def encode(w: Weights, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.maximum(_norm(x @ w["enc1.w"] + w["enc1.b"], w["ln1.g"], w["ln1.b"]), 0)
    h = np.maximum(_norm(h @ w["enc2.w"] + w["enc2.b"], w["ln2.g"], w["ln2.b"]), 0)
    return h @ w["mu.w"] + w["mu.b"], h @ w["var.w"] + w["var.b"]


def decode(w: Weights, z: np.ndarray, batch: np.ndarray) -> np.ndarray:
    """Mean expression: exp of the output, clamped at 20."""
    h = np.maximum(np.concatenate([z, w["batch"][batch]], 1) @ w["dec1.w"] + w["dec1.b"], 0)
    return np.exp(np.minimum(h @ w["dec2.w"] + w["dec2.b"], 20))


def embedded(w: Weights, z: np.ndarray, of: np.ndarray, snvs: np.ndarray) -> np.ndarray:
    """The variants' embeddings given the cells' states."""
    c = np.concatenate([z[of], w["snv"][snvs]], 1) @ w["cond1.w"] + w["cond1.b"]
    return (c / (1 + np.exp(-c))) @ w["cond2.w"] + w["cond2.b"]


def attend_pairs(w: Weights, z: np.ndarray, of: np.ndarray, snvs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of a cell (its row of z) and a variant: the variant's embedding given the cell's state, and its attention
    (softmax over the cell's pairs)."""
    e = embedded(w, z, of, snvs)
    logit = (np.tanh(np.concatenate([z[of], e], 1) @ w["attn1.w"] + w["attn1.b"]) @ w["attn2.w"] + w["attn2.b"])[:, 0]
    top = np.full(len(z), -np.inf)
    np.maximum.at(top, of, logit)
    soft = np.exp(logit - top[of])
    return e, soft / (np.bincount(of, soft, len(z))[of] + 1e-12)


def attend(w: Weights, z: np.ndarray, snvs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one cell."""
    return attend_pairs(w, z[None], np.zeros(len(snvs), int), snvs)


def summed(terms: np.ndarray, of: np.ndarray, cells: int) -> np.ndarray:
    out = np.zeros((cells, terms.shape[1]))
    np.add.at(out, of, terms)
    return out


def shift(w: Weights, total: np.ndarray) -> np.ndarray:
    """Latent shift of a cell from its weighted, signed sum of embeddings; a cell without variants gets the bias."""
    return total @ w["proj.w"] + w["proj.b"]


CELLS_AT_ONCE, FLIPS_AT_ONCE = 64, 1024  # rows of a step, so that memory does not grow with the size of Arrow's batches


def _steps(batches: Iterator[pa.RecordBatch], values: int = 0) -> Iterator[pa.RecordBatch]:
    """values: more cells than CELLS_AT_ONCE are taken while their lists have no more elements, on the batch's average."""
    for b in batches:
        held = sum(len(c.flatten()) for c in b.columns if pa.types.is_list(c.type)) if values else 0
        rows = max(CELLS_AT_ONCE, values * len(b) // max(1, held) if values else 0)
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The elements of a list column, and the row of each; a null list has none."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy(zero_copy_only=False).astype(int)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel()))


def _state(w: Weights, b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """z of the cells; cell, variant and sign of the pairs, their embeddings and attention."""
    z = encode(w, _rows(b["x"]))[0]
    of, snvs = _flat(b["snvs"])
    return z, of, snvs, _flat(b["signs"])[1], *attend_pairs(w, z, of, snvs)


def encoded(cells: DataFrame, w: Weights) -> DataFrame:
    """cell, z (mean latent), log_variance."""
    held = cells.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _steps(batches):
            mu, var = encode(held.value, _rows(b["x"]))
            yield pa.RecordBatch.from_arrays([b["cell"], _lists(mu), _lists(var)], names=["cell", "z", "log_variance"])

    return cells.select("cell", "x").mapInArrow(run, "cell string, z array<double>, log_variance array<double>")


def attention(cells: DataFrame, w: Weights) -> DataFrame:
    """cell, snv, sign, attention for every pair."""
    held = cells.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _steps(batches):
            _, of, snvs, signs, _, a = _state(held.value, b)
            yield pa.RecordBatch.from_arrays([b["cell"].take(pa.array(of)), pa.array(snvs, pa.int32()), pa.array(signs, pa.int32()), pa.array(a)], names=["cell", "snv", "sign", "attention"])

    return cells.select("cell", "batch", "x", "snvs", "signs").mapInArrow(run, "cell string, snv int, sign int, attention double")


def reconstructed(cells: DataFrame, w: Weights) -> DataFrame:
    """cell, shift (latent), mean (expression after it)."""
    held = cells.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _steps(batches):
            z, of, _, signs, e, a = _state(held.value, b)
            dz = shift(held.value, summed((a * signs)[:, None] * e, of, len(b)))
            yield pa.RecordBatch.from_arrays([b["cell"], _lists(dz), _lists(decode(held.value, z + dz, b["batch"].to_numpy(zero_copy_only=False)))], names=["cell", "shift", "mean"])

    return cells.select("cell", "batch", "x", "snvs", "signs").mapInArrow(run, "cell string, shift array<double>, mean array<double>")


def _flips(w: Weights, z: np.ndarray, batch: np.ndarray, sums: np.ndarray, own: np.ndarray, terms: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(which, cosine distance, distance): of the mean expressions of the cells `own` before and after their sum of embeddings
    loses a term twice. All terms of a cell decode it once before."""
    before = decode(w, z + shift(w, sums), batch)
    length = np.maximum(np.linalg.norm(before, axis=1), 1e-6)
    for at in range(0, len(own), FLIPS_AT_ONCE):
        which = slice(at, at + FLIPS_AT_ONCE)
        cell = own[which]
        after = decode(w, z[cell] + shift(w, sums[cell] - 2 * terms[which]), batch[cell])
        dots, norms = (after * before[cell]).sum(1), np.maximum(np.linalg.norm(after, axis=1), 1e-6)
        yield which, 1 - dots / (norms * length[cell]), np.linalg.norm(after - before[cell], axis=1)


def _chosen_pairs(of: np.ndarray, snvs: np.ndarray, flip: pa.Array) -> np.ndarray:
    """Places of the pairs that flip, a list of variants for each cell, names."""
    in_cell, wanted = _flat(flip)
    width = max(snvs.max(initial=0), wanted.max(initial=0)) + 1
    return np.flatnonzero(np.isin(of * width + snvs, in_cell * width + wanted))


def counterfactuals(cells: DataFrame, w: Weights, chosen: DataFrame | None = None) -> DataFrame:
    """snv, cell, score_cosine_distance, score_euclidean: for each carrier, of either sign, the distance between mean
    expressions before and after the variant's sign is flipped. Attention does not depend on signs, so only one term of
    the cell's sum changes. chosen: (snv) to score, by default all."""
    held = cells.sparkSession.sparkContext.broadcast(w)
    rows = cells.select("cell", "batch", "x", "snvs", "signs")
    if chosen is None:
        rows = rows.withColumn("flip", F.col("snvs"))
    else:
        flips = rows.select("cell", F.explode("snvs").alias("snv")).join(chosen.select("snv").distinct(), "snv", "left_semi").groupBy("cell").agg(F.collect_list("snv").alias("flip"))
        rows = rows.join(flips, "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _steps(batches):
            z, of, snvs, signs, e, a = _state(held.value, b)
            terms = (a * signs)[:, None] * e
            every = _chosen_pairs(of, snvs, b["flip"])
            for which, cosine, euclidean in _flips(held.value, z, b["batch"].to_numpy(zero_copy_only=False), summed(terms, of, len(b)), of[every], terms[every]):
                ix = every[which]
                yield pa.RecordBatch.from_arrays([pa.array(snvs[ix], pa.int32()), b["cell"].take(pa.array(of[ix])), pa.array(cosine), pa.array(euclidean)], names=["snv", "cell", "score_cosine_distance", "score_euclidean"])

    return rows.mapInArrow(run, "snv int, cell string, score_cosine_distance double, score_euclidean double")


def states(cells: DataFrame, w: Weights) -> DataFrame:
    """cell, batch, z, total (weighted, signed sum of embeddings), snvs, signs, attention: what is left of a cell when the encoder and the
    attention have seen it."""
    held = cells.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _steps(batches):
            z, of, snvs, signs, e, a = _state(held.value, b)
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(b)))])
            lists = lambda v, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, kind))
            yield pa.RecordBatch.from_arrays(
                [b["cell"], b["batch"], _lists(z), _lists(summed((a * signs)[:, None] * e, of, len(b))), lists(snvs, pa.int32()), lists(signs, pa.int32()), lists(a, pa.float64())],
                names=["cell", "batch", "z", "total", "snvs", "signs", "attention"])

    return cells.select("cell", "batch", "x", "snvs", "signs").mapInArrow(run, "cell string, batch int, z array<double>, total array<double>, snvs array<int>, signs array<int>, attention array<double>")


def flipped(seen: DataFrame, w: Weights) -> DataFrame:
    """celltype, snv, score_cosine_distance, score_euclidean of states with celltype and `flip`, the variants to flip in each cell. Only the
    embeddings of these are made again; neither encoder nor attention runs."""
    held = seen.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _steps(batches):
            z, sums = _rows(b["z"]), _rows(b["total"])
            of, snvs = _flat(b["snvs"])
            every = _chosen_pairs(of, snvs, b["flip"])
            own, weight = of[every], (b["attention"].flatten().to_numpy() * _flat(b["signs"])[1])[every]
            terms = weight[:, None] * embedded(held.value, z, own, snvs[every])
            for which, cosine, euclidean in _flips(held.value, z, b["batch"].to_numpy(zero_copy_only=False), sums, own, terms):
                yield pa.RecordBatch.from_arrays([b["celltype"].take(pa.array(own[which])), pa.array(snvs[every[which]], pa.int32()), pa.array(cosine), pa.array(euclidean)], names=["celltype", "snv", "score_cosine_distance", "score_euclidean"])

    return seen.mapInArrow(run, "celltype string, snv int, score_cosine_distance double, score_euclidean double")


def by_celltype(cells: DataFrame, w: Weights, types: DataFrame, tables: Tables, top: int = 2000, more_than: int = 20, least_cells: int = 20) -> DataFrame:
    """celltype, snv, attention, score_cosine_distance, score_euclidean, cells: in every cell type of enough cells the `top` variants by
    mean attention there, of these the ones with more than a limit of calls of both kinds, scored over their carriers in the type. Cells go
    through encoder and attention once; what is flipped is chosen by (cell type, variant) before. types: (cell, celltype); cells without one take no part."""
    seen = tables.save(states(cells, w).join(types.filter("celltype is not null").select("cell", "celltype"), "cell"), "states")
    pairs = seen.select("celltype", "cell", F.explode(F.arrays_zip("snvs", "signs", "attention")).alias("p"))
    pairs = pairs.select("celltype", "cell", F.col("p.snvs").alias("snv"), F.col("p.signs").alias("call"), F.col("p.attention").alias("attention"))
    valid = scoring.valid_in_celltype(pairs, seen, more_than, least_cells)
    mean = pairs.groupBy("celltype", "snv").agg(F.avg("attention").alias("attention"))
    chosen = tables.save(scoring.top_then_valid(mean, valid, top).select("celltype", "snv", "attention"), "chosen")
    # one list for each cell type meets the states where they are: no state is shuffled or sorted again
    wanted = tables.save(chosen.groupBy("celltype").agg(F.collect_list("snv").alias("wanted")), "wanted")
    flips = seen.join(wanted, "celltype").withColumn("flip", F.array_intersect("snvs", "wanted")).filter(F.size("flip") > 0)
    scored = flipped(flips.select("celltype", "batch", "z", "total", "snvs", "signs", "attention", "flip"), w)
    sums = scored.groupBy("celltype", "snv").agg(F.avg("score_cosine_distance").alias("score_cosine_distance"), F.avg("score_euclidean").alias("score_euclidean"), F.count("*").alias("cells"))
    return chosen.join(sums, ["celltype", "snv"])

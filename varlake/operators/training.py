"""Training of the expression backbone and of the variant-effect model.

A pass over the cells is one Spark job: every task sums losses and gradients of its cells, Spark adds the sums by name
and piece, and the driver takes one step of Adam with what is of the model's size. An epoch has `steps` such passes, each over
the cells whose id hashes to it in that epoch; by default one pass takes all cells. Noise, validation cells and negatives depend on
cell ids alone, so that losses do not depend on how cells are partitioned (but for the order in which sums are taken).

The backbone's objective is the reconstruction (negative binomial, or squared error), the latents' divergence with free
bits, and, where a discriminator is given, its cross entropy on batches, whose gradient is reversed for the encoder. The
effect model's is the negative binomial after the shift by a cell's own calls and, from an epoch on, a rank term: the mean
loss under the cells' own calls should lie a margin below that under the calls of other cells of the same batch.

Defined results: cells without calls are shifted by the projection's bias; a batch with one cell has no negatives; cells
whose negatives differ in too few variants take no part in the rank term; without cells no step is taken.
"""

from __future__ import annotations

import copy
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folder import Tables
from .model import Weights, _flat, _norm, _rows, _steps

PIECE = 1024  # values of a gradient in one row
STEP_VALUES = 1 << 17  # counts and calls that a step takes at once, so that it has the more cells the fewer they have
GROUP, NEGATIVES = 256, 8  # cells among which negatives are dealt, and how many of them each cell has
Sums = dict[str, np.ndarray]


# ---- special functions of arrays

SHIFT = 10  # arguments are moved up to where the asymptotic series are exact


def lgamma(x: np.ndarray) -> np.ndarray:
    y = x + SHIFT
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - sum(np.log(x + k) for k in range(SHIFT))


def digamma(x: np.ndarray) -> np.ndarray:
    y = x + SHIFT
    return np.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8) - sum(1 / (x + k) for k in range(SHIFT))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


# ---- layers, forward and backward


def _norm_back(dy: np.ndarray, x: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sd = np.sqrt(x.var(1, keepdims=True) + 1e-5)
    n = (x - x.mean(1, keepdims=True)) / sd
    d = dy * g
    return (d - d.mean(1, keepdims=True) - n * (d * n).mean(1, keepdims=True)) / sd, (dy * n).sum(0), dy.sum(0)


def _linear_back(g: Sums, name: str, w: Weights, x: np.ndarray, dy: np.ndarray) -> np.ndarray:
    g[f"{name}.w"], g[f"{name}.b"] = x.T @ dy, dy.sum(0)
    return dy @ w[f"{name}.w"].T


def _added(terms: np.ndarray, of: np.ndarray, rows: int) -> np.ndarray:
    """The sums of the terms of each row."""
    return np.stack([np.bincount(of, column, rows) for column in terms.T], 1)


def _through(w: Weights, name: str, x: np.ndarray) -> np.ndarray:
    return x @ w[f"{name}.w"] + w[f"{name}.b"]


class Encoder:
    def __init__(self, w: Weights, x: np.ndarray):
        self.w, self.x = w, x
        self.p1 = _through(w, "enc1", x)
        self.h1 = np.maximum(_norm(self.p1, w["ln1.g"], w["ln1.b"]), 0)
        self.p2 = _through(w, "enc2", self.h1)
        self.h2 = np.maximum(_norm(self.p2, w["ln2.g"], w["ln2.b"]), 0)
        self.mean, self.log_variance = _through(w, "mu", self.h2), _through(w, "var", self.h2)

    def of(self, cells: np.ndarray) -> Encoder:
        """What it has made of some of its cells."""
        some = copy.copy(self)
        for k in ("x", "p1", "h1", "p2", "h2", "mean", "log_variance"):
            setattr(some, k, getattr(self, k)[cells])
        return some

    def back(self, g: Sums, d_mean: np.ndarray, d_log_variance: np.ndarray) -> None:
        d = _linear_back(g, "mu", self.w, self.h2, d_mean) + _linear_back(g, "var", self.w, self.h2, d_log_variance)
        d, g["ln2.g"], g["ln2.b"] = _norm_back(d * (self.h2 > 0), self.p2, self.w["ln2.g"])
        d = _linear_back(g, "enc2", self.w, self.h1, d)
        d, g["ln1.g"], g["ln1.b"] = _norm_back(d * (self.h1 > 0), self.p1, self.w["ln1.g"])
        _linear_back(g, "enc1", self.w, self.x, d)


class Decoder:
    """The mean of each gene. activation: umi (exponential, clamped at 20), softplus or identity."""

    def __init__(self, w: Weights, z: np.ndarray, batch: np.ndarray, activation: str = "umi"):
        self.w, self.batch, self.activation = w, batch, activation
        self.x = np.concatenate([z, w["batch"][batch]], 1)
        self.h = np.maximum(_through(w, "dec1", self.x), 0)
        self.out = _through(w, "dec2", self.h)
        self.mean = {"umi": lambda o: np.exp(np.minimum(o, 20)), "softplus": _softplus, "identity": lambda o: o}[activation](self.out)

    def back(self, g: Sums, d_mean: np.ndarray) -> np.ndarray:
        slope = {"umi": lambda: self.mean * (self.out <= 20), "softplus": lambda: _sigmoid(self.out), "identity": lambda: 1.0}[self.activation]()
        d = _linear_back(g, "dec2", self.w, self.h, d_mean * slope) * (self.h > 0)
        d = _linear_back(g, "dec1", self.w, self.x, d)
        latent = d.shape[1] - self.w["batch"].shape[1]
        g["batch"] = _added(d[:, latent:], self.batch, len(self.w["batch"]))
        return d[:, :latent]


class Heads:
    """The latent shift of cells by their calls: embeddings given the cell's state, attention over a cell's pairs, signed sum, projection."""

    def __init__(self, w: Weights, z: np.ndarray, of: np.ndarray, snvs: np.ndarray, signs: np.ndarray):
        self.w, self.of, self.snvs, self.signs = w, of, snvs, signs
        self.in1 = np.concatenate([z[of], w["snv"][snvs]], 1)
        self.c = _through(w, "cond1", self.in1)
        self.open = _sigmoid(self.c)
        self.s = self.c * self.open
        self.e = _through(w, "cond2", self.s)
        self.in2 = np.concatenate([z[of], self.e], 1)
        self.t = np.tanh(_through(w, "attn1", self.in2))
        logit = _through(w, "attn2", self.t)[:, 0]
        top = np.full(len(z), -np.inf)
        np.maximum.at(top, of, logit)
        soft = np.exp(logit - top[of])
        self.a = soft / (np.bincount(of, soft, len(z))[of] + 1e-12)
        self.total = _added((self.a * signs)[:, None] * self.e, of, len(z))
        self.shift = _through(w, "proj", self.total)

    def back(self, g: Sums, d_shift: np.ndarray) -> np.ndarray:
        """The gradient by the cells' states."""
        w, of = self.w, self.of
        d_total = _linear_back(g, "proj", w, self.total, d_shift)[of]
        d_e = (self.a * self.signs)[:, None] * d_total
        d_a = self.signs * (self.e * d_total).sum(1)
        d_logit = self.a * (d_a - np.bincount(of, self.a * d_a, len(d_shift))[of])
        d_t = _linear_back(g, "attn2", w, self.t, d_logit[:, None])
        d_in2 = _linear_back(g, "attn1", w, self.in2, d_t * (1 - self.t**2))
        k = d_shift.shape[1]
        d_s = _linear_back(g, "cond2", w, self.s, d_e + d_in2[:, k:])
        sig = self.open
        d_in1 = _linear_back(g, "cond1", w, self.in1, d_s * sig * (1 + self.c * (1 - sig)))
        g["snv"] = _added(d_in1[:, k:], self.snvs, len(w["snv"]))
        return _added(d_in1[:, :k] + d_in2[:, :k], of, len(d_shift))


@dataclass(frozen=True)
class Clamp:
    """Limits of means and dispersions, and what is added inside logarithms."""

    least: float
    most: float
    inside: float


BACKBONE, EFFECT = Clamp(1e-6, np.inf, 1e-6), Clamp(1e-5, 1e6, 0.0)


def _gamma_terms(th: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lgamma(th + c), lgamma(c + 1) and digamma(th + c), th for each column. Whole counts, of which there are fewer than rows, are looked up."""
    most = int(c.max(initial=0)) + 1 if c.size and c.max() < len(c) else len(c)
    if most < len(c) and (c == np.floor(c)).all():
        whole, at = np.arange(most, dtype=float)[:, None], c.astype(np.intp)
        column = np.arange(c.shape[1])
        return lgamma(th + whole)[at, column], lgamma(whole + 1)[at, 0], digamma(th + whole)[at, column]
    return lgamma(th + c), lgamma(c + 1), digamma(th + c)


def negative_binomial(counts: np.ndarray, mean: np.ndarray, raw_theta: np.ndarray, clamp: Clamp) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Negative log-likelihood of each cell, and its gradient by the means and by raw_theta (dispersion: softplus + 1e-5)."""
    soft = _softplus(raw_theta) + 1e-5
    c, mu, th = np.clip(counts, 0, clamp.most), np.clip(mean, clamp.least, clamp.most), np.clip(soft, clamp.least, clamp.most)
    i, both = clamp.inside, th + mu + clamp.inside
    log_both = np.log(both)
    gamma, factorial, slope = _gamma_terms(th, c)
    nll = -(gamma - lgamma(th) - factorial + th * (np.log(th + i) - log_both) + c * (np.log(mu + i) - log_both))
    d_mean = ((th + c) / both - c / (mu + i)) * ((mean >= clamp.least) & (mean <= clamp.most))
    d_theta = -(slope - digamma(th) + np.log(th + i) + th / (th + i) - log_both - (th + c) / both)
    return nll.sum(1), d_mean, d_theta.sum(0) * ((soft >= clamp.least) & (soft <= clamp.most)) * _sigmoid(raw_theta)


def divergence(mean: np.ndarray, log_variance: np.ndarray, free_bits: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each cell, at least the free bits in every dimension, and its gradient by both."""
    kl = 0.5 * (mean**2 + np.exp(log_variance) - log_variance - 1)
    on = kl >= free_bits
    return np.maximum(kl, free_bits).sum(1), on * mean, on * 0.5 * (np.exp(log_variance) - 1)


# ---- objectives: sums over cells


def with_discriminator(w: Weights, hidden: int | None = None, seed: int = 42) -> Weights:
    latent, batches = w["mu.b"].shape[0], w["batch"].shape[0]
    h, rng = hidden or latent, np.random.default_rng(seed)
    return w | {"disc1.w": rng.normal(0, 1 / np.sqrt(latent), (latent, h)), "disc1.b": np.zeros(h), "disc2.w": rng.normal(0, 1 / np.sqrt(h), (h, batches)), "disc2.b": np.zeros(batches)}


def backbone_sums(w: Weights, x: np.ndarray, batch: np.ndarray, noise: np.ndarray, beta: float, reverse: float = 0.0, likelihood: bool = True, activation: str = "umi") -> tuple[Sums, Sums]:
    """Losses (recon, kl, adv) and the gradient of recon + beta * kl + adv, with that of adv times -reverse for the encoder."""
    enc = Encoder(w, x)
    sd = np.exp(enc.log_variance / 2)
    z = enc.mean + sd * noise
    dec, g = Decoder(w, z, batch, activation), {}
    if likelihood:
        recon, d_mean, g["theta"] = negative_binomial(x, dec.mean, w["theta"], BACKBONE)
    else:
        recon, d_mean = ((dec.mean - x) ** 2).mean(1), 2 * (dec.mean - x) / x.shape[1]
    kl, kl_mean, kl_variance = divergence(enc.mean, enc.log_variance)
    d_z, adv = dec.back(g, d_mean), np.zeros(len(x))
    if "disc1.w" in w and reverse > 0:
        h = np.maximum(_through(w, "disc1", z), 0)
        logits = _through(w, "disc2", h)
        logits = logits - logits.max(1, keepdims=True)
        share = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
        adv = -np.log(share[np.arange(len(x)), batch])
        share[np.arange(len(x)), batch] -= 1
        d_z = d_z - reverse * _linear_back(g, "disc1", w, z, _linear_back(g, "disc2", w, h, share) * (h > 0))
    enc.back(g, d_z + beta * kl_mean, d_z * noise * sd / 2 + beta * kl_variance)
    return {"cells": np.float64(len(x)), "recon": recon.sum(), "kl": kl.sum(), "adv": adv.sum()}, g


def effect_sums(w: Weights, x: np.ndarray, batch: np.ndarray, of: np.ndarray, snvs: np.ndarray, signs: np.ndarray, noise: np.ndarray | None, enc: Encoder | None = None, encoder: bool = True) -> tuple[Sums, Sums]:
    """Losses (nll, kl) and norms of shifts and states, and the gradient of nll + kl. Without noise from the mean latent. enc: that of x, if there is
    one already. encoder: whether the gradient by the encoder's weights is wanted, too."""
    enc, g = enc or Encoder(w, x), {}
    sd = np.exp(enc.log_variance / 2)
    z = enc.mean if noise is None else enc.mean + sd * noise
    heads = Heads(w, z, of, snvs, signs)
    dec = Decoder(w, z + heads.shift, batch)
    nll, d_mean, g["theta"] = negative_binomial(x, dec.mean, w["theta"], EFFECT)
    kl, kl_mean, kl_variance = divergence(enc.mean, enc.log_variance)
    d = dec.back(g, d_mean)
    d_z = d + heads.back(g, d)
    if encoder:
        enc.back(g, d_z + kl_mean, (0 if noise is None else d_z * noise * sd / 2) + kl_variance)
    shifts, states = np.linalg.norm(heads.shift, axis=1), np.linalg.norm(z, axis=1)
    return {"cells": np.float64(len(x)), "nll": nll.sum(), "kl": kl.sum(), "shift": shifts.sum(), "state": states.sum(), "ratio": (shifts / np.maximum(states, 1e-12)).sum()}, g


def differing(of: np.ndarray, snvs: np.ndarray, signs: np.ndarray, of2: np.ndarray, snvs2: np.ndarray, signs2: np.ndarray, cells: int) -> np.ndarray:
    """Of each cell, in how many variants two lists of calls differ; a variant that is not listed is 0."""
    width = max(snvs.max(initial=0), snvs2.max(initial=0)) + 1
    a, b = of * width + snvs, of2 * width + snvs2
    count = lambda codes, by: np.bincount(codes // by, minlength=cells)
    both, alike = np.intersect1d(a, b), np.intersect1d(a * 3 + signs + 1, b * 3 + signs2 + 1)
    return np.bincount(of, minlength=cells) + np.bincount(of2, minlength=cells) - count(both, width) - count(alike, width * 3)


def rank_sums(w: Weights, x: np.ndarray, batch: np.ndarray, own: tuple[np.ndarray, ...], other: tuple[np.ndarray, ...], valid: np.ndarray, enc: Encoder | None = None, encoder: bool = True) -> tuple[Sums, Sums]:
    """Losses (below: own calls, above: others' calls) of the valid cells, and the gradient of their difference."""
    at = np.cumsum(valid) - 1
    pick = lambda c: (at[c[0][valid[c[0]]]], c[1][valid[c[0]]], c[2][valid[c[0]]])
    enc = enc.of(valid) if enc else Encoder(w, x[valid])
    below, g_below = effect_sums(w, x[valid], batch[valid], *pick(own), None, enc, encoder)
    above, g_above = effect_sums(w, x[valid], batch[valid], *pick(other), None, enc, encoder)
    return {"valid": below["cells"], "below": below["nll"] + below["kl"], "above": above["nll"] + above["kl"]}, {k: g_below[k] - g_above[k] for k in g_below}


# ---- passes over cells


def _noise(cells: pa.Array, size: int, seed: int, turn: int) -> np.ndarray:
    """Of every cell its own, however cells are dealt."""
    return np.array([np.random.default_rng([seed, turn, zlib.crc32((c or "").encode())]).normal(size=size) for c in cells.to_pylist()]).reshape(-1, size)


def summed_over(cells: DataFrame, work: Callable[[pa.RecordBatch], Sums]) -> Sums:
    """The sums that work returns for the batches of cells, added up. What reaches the driver has the size of one."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Sums = {}
        for b in _steps(batches, STEP_VALUES):
            if len(b):
                for k, v in work(b).items():
                    total[k] = total.get(k, 0) + v
        for k, v in total.items():
            flat = np.ravel(v)
            pieces = [flat[i:i + PIECE] for i in range(0, len(flat), PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(pieces)), pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.list_(pa.float64()))], names=["name", "piece", "v"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            for k, p, v in zip(b["name"].to_pylist(), b["piece"].to_pylist(), b["v"]):
                total[k, p] = total.get((k, p), 0) + v.values.to_numpy()
        if total:
            names, pieces = zip(*total)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(pieces, pa.int32()), pa.array([*total.values()], pa.list_(pa.float64()))], names=["name", "piece", "v"])

    kind = "name string, piece int, v array<double>"
    rows = cells.mapInArrow(partial, kind).repartition("name", "piece").mapInArrow(added, kind).toArrow().to_pylist()
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["name"], r["piece"])):
        out.setdefault(r["name"], []).append(r["v"])
    return {k: np.concatenate(v) for k, v in out.items()}


def weighted_losses(steps: DataFrame, by: list[str]) -> DataFrame:
    """by, value, cells: the mean of step losses (value) over the cells that each step had."""
    return steps.groupBy(*by).agg((F.sum(F.col("value") * F.col("cells")) / F.sum("cells")).alias("value"), F.sum("cells").alias("cells"))


class Adam:
    """With L2 decay added to the clipped gradient, and a linear warm-up of the rate before a cosine decay over the epochs."""

    def __init__(self, w: Weights, names: list[str], rate: float, decay: float, clip: float, epochs: int, warm: int = 10, least: float = 1e-8):
        self.w, self.names, self.rate, self.decay, self.clip, self.epochs, self.warm, self.least, self.t = w, names, rate, decay, clip, epochs, warm, least, 0
        self.m, self.v = {k: np.zeros_like(w[k]) for k in names}, {k: np.zeros_like(w[k]) for k in names}

    def rate_in(self, epoch: int) -> float:
        """epoch from 1"""
        if epoch <= self.warm:
            return self.rate * epoch / self.warm
        done = (epoch - 1 - self.warm) / max(1, self.epochs - self.warm)
        return self.least + 0.5 * (1 + math.cos(math.pi * done)) * (self.rate - self.least)

    def step(self, g: Sums, epoch: int) -> None:
        self.t += 1
        # a weight that no cell's loss reached, as of a discriminator that is still off, has no gradient and does not move
        g = {k: np.reshape(g[k], self.w[k].shape) for k in self.names if k in g}
        size = math.sqrt(sum(float((v**2).sum()) for v in g.values()))
        for k, v in g.items():
            v = v * min(1.0, self.clip / (size + 1e-6)) + self.decay * self.w[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * v
            self.v[k] = 0.999 * self.v[k] + 0.001 * v * v
            self.w[k] = self.w[k] - self.rate_in(epoch) * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def _step_of(epoch: int, steps: int, seed: int):
    return F.pmod(F.xxhash64("cell", F.lit(seed), F.lit(epoch)), F.lit(steps))


def train_backbone(cells: DataFrame, w: Weights, epochs: int = 100, likelihood: bool = False, activation: str = "umi", rate: float = 1e-3, decay: float = 1e-5, warm: int = 20, beta_most: float = 1.0,
                   reverse: float = 0.0, reverse_warm: int = 10, clip: float = 5.0, patience: int = 50, steps: int = 1, seed: int = 42) -> tuple[Weights, list[dict]]:
    """The weights, and a row per epoch, split and part: (epoch, split, part, value), parts loss, recon, kl and adv. cells:
    (cell, batch, x). A tenth of the cells, by hash, validates. Once the ramps are at their tops the best weights by validation loss are
    kept, and `patience` epochs without a better one end the training; before that the last weights count."""
    spark, history = cells.sparkSession, []
    w = {k: v.astype(float).copy() for k, v in (with_discriminator(w, seed=seed) if reverse > 0 and w["batch"].shape[0] > 1 and "disc1.w" not in w else w).items()}
    reverse = reverse if "disc1.w" in w else 0.0
    names = [k for k in w if not k.startswith(("snv", "cond", "attn", "proj"))]
    adam, best, best_w, bad = Adam(w, names, rate, decay, clip, epochs), None, None, 0
    with Tables(spark, "backbone") as tables:
        rows = tables.save(cells.select("cell", "batch", "x", (F.pmod(F.xxhash64("cell", F.lit(seed)), F.lit(10)) == 0).alias("held")), "cells")

        def run(part: DataFrame, beta: float, now: float, turn: int, gradient: bool) -> Sums:
            held = spark.sparkContext.broadcast(adam.w)

            def work(b: pa.RecordBatch) -> Sums:
                noise = _noise(b["cell"], held.value["mu.b"].shape[0], seed, turn)
                losses, g = backbone_sums(held.value, _rows(b["x"]), b["batch"].to_numpy(zero_copy_only=False), noise, beta, now, likelihood, activation)
                return losses | ({f"g.{k}": v for k, v in g.items()} if gradient else {})

            out = summed_over(part, work)
            held.unpersist()
            return out

        def log(epoch: int, split: str, sums: Sums, beta: float) -> float:
            n = max(1.0, float(sums["cells"][0]))
            parts = {k: float(sums[k][0]) / n for k in ("recon", "kl", "adv")}
            parts["loss"] = parts["recon"] + beta * parts["kl"] + parts["adv"]
            history.extend({"epoch": epoch, "split": split, "part": k, "value": v} for k, v in parts.items())
            return parts["loss"]

        for epoch in range(1, epochs + 1):
            beta, now = beta_most * min(1.0, epoch / max(1, warm)), reverse * min(1.0, epoch / max(1, reverse_warm))
            total: Sums = {}
            for step in range(steps):
                sums = run(rows.filter(~F.col("held") & (_step_of(epoch, steps, seed) == step)), beta, now, epoch, True)
                if "cells" in sums:
                    adam.step({k[2:]: v / sums["cells"][0] for k, v in sums.items() if k.startswith("g.")}, epoch)
                    total = {k: total.get(k, 0) + sums[k] for k in ("cells", "recon", "kl", "adv")}
            if not total:
                break
            log(epoch, "train", total, beta)
            sums = run(rows.filter("held"), beta, now, epoch, False)
            if "cells" not in sums:
                continue
            loss = log(epoch, "validation", sums, beta)
            if beta >= beta_most and now >= reverse:
                if best is None or loss + 1e-5 < best:
                    best, best_w, bad = loss, {k: v.copy() for k, v in adam.w.items()}, 0
                else:
                    bad += 1
                    if bad >= patience:
                        break
    return best_w or adam.w, history


def with_negatives(cells: DataFrame, group: int = GROUP, negatives: int = NEGATIVES, seed: int = 42) -> DataFrame:
    """cells with negs: the calls (snvs, signs) of up to `negatives` other cells of the same batch. A batch is dealt by hash into groups
    of about `group` cells; in each, in the order of another hash, every cell gets those of the cells 1, 2, ... places on. None gets its own."""
    n = cells.groupBy(F.col("batch").alias("of")).agg(F.count("*").alias("n"))
    place = lambda k: F.xxhash64("cell", F.lit(seed), F.lit(k))
    dealt = cells.select("cell", "batch", "snvs", "signs").join(n, F.col("batch") == F.col("of")).withColumn("bucket", F.pmod(place("group"), F.ceil(F.col("n") / group)))
    groups = dealt.groupBy("batch", "bucket").agg(F.array_sort(F.collect_list(F.struct(place("order").alias("by"), "cell", "snvs", "signs"))).alias("all"))
    size, at = F.size("all"), F.col("at")
    other = lambda k: F.element_at("all", ((at + 1 + (k - 1) % (size - 1)) % size + 1).cast("int"))
    negs = F.when(size > 1, F.transform(F.sequence(F.lit(1), F.least(F.lit(negatives), size - 1)), lambda k: F.struct(other(k)["snvs"].alias("snvs"), other(k)["signs"].alias("signs"))))
    each = groups.select("all", F.posexplode("all").alias("at", "own")).select(F.col("own.cell").alias("cell"), negs.alias("negs"))
    return cells.join(each, "cell")


@dataclass(frozen=True)
class Rank:
    """The rank term: its weight and margin grow to their tops over `warm` epochs from epoch `first` on."""

    first: int = 11
    warm: int = 10
    weight: float = 0.05
    margin: float = 0.05
    least_differing: int = 5


FROZEN = {"encoder": ("enc", "ln", "mu", "var"), "backbone": ("enc", "ln", "mu", "var", "dec", "theta", "batch"), "": ()}


def train_effect(cells: DataFrame, w: Weights, epochs: int = 500, frozen: str = "encoder", rate: float = 1e-3, decay: float = 1e-5, clip: float = 1.0, rank: Rank | None = Rank(), steps: int = 1, seed: int = 42) -> tuple[Weights, list[dict]]:
    """The weights, and a row per epoch and part: (epoch, part, value), parts loss, nll, kl, rank (times its weight), rank_valid (share of
    cells), shift, state and ratio (mean norms). cells: (cell, batch, x, snvs, signs). frozen: as in model.trainable."""
    spark, history = cells.sparkSession, []
    w = {k: v.astype(float).copy() for k, v in w.items()}
    names = [k for k in w if not k.startswith((*FROZEN[frozen], "disc"))]
    adam = Adam(w, names, rate, decay, clip, epochs)
    keep = {f"{side}.{k}" for side in "gr" for k in names}
    with Tables(spark, "effect") as tables:
        rows = cells.select("cell", "batch", "x", "snvs", "signs")
        rows = tables.save(with_negatives(rows, seed=seed) if rank else rows, "cells")
        for epoch in range(1, epochs + 1):
            ranked = rank is not None and epoch >= rank.first
            ramp = min(1.0, (epoch - rank.first + 1) / max(1, rank.warm)) if ranked else 0.0
            part = rows
            if ranked:  # the negatives take turns
                turn = F.pmod(F.lit(epoch - rank.first), F.size("negs")) + 1
                neg = F.when(F.size("negs") > 0, F.element_at("negs", turn))
                part = rows.select("cell", "batch", "x", "snvs", "signs", neg["snvs"].alias("other_snvs"), neg["signs"].alias("other_signs"))
            total: Sums = {}
            lost = 0.0
            for step in range(steps):
                held = spark.sparkContext.broadcast(adam.w)

                def work(b: pa.RecordBatch, held=held, epoch=epoch, ranked=ranked) -> Sums:
                    w, x, batch = held.value, _rows(b["x"]), b["batch"].to_numpy(zero_copy_only=False)
                    of, snvs = _flat(b["snvs"])
                    own = (of, snvs, _flat(b["signs"])[1])
                    enc, encoder = Encoder(w, x), frozen == ""
                    losses, g = effect_sums(w, x, batch, *own, _noise(b["cell"], w["mu.b"].shape[0], seed, epoch), enc, encoder)
                    out = losses | {f"g.{k}": v for k, v in g.items()}
                    if ranked:
                        of, snvs = _flat(b["other_snvs"])
                        other = (of, snvs, _flat(b["other_signs"])[1])
                        valid = b["other_snvs"].is_valid().to_numpy(zero_copy_only=False) & (differing(*own, *other, len(b)) >= rank.least_differing)
                        losses, g = rank_sums(w, x, batch, own, other, valid, enc, encoder)
                        out |= losses | {f"r.{k}": v for k, v in g.items()}
                    return {k: v for k, v in out.items() if "." not in k or k in keep}

                sums = summed_over(part.filter(_step_of(epoch, steps, seed) == step), work)
                held.unpersist()
                if "cells" not in sums:
                    continue
                n = float(sums["cells"][0])
                g = {k[2:]: v / n for k, v in sums.items() if k.startswith("g.")}
                valid = float(sums["valid"][0]) if ranked else 0.0
                hinge = rank.margin * ramp + float(sums["below"][0] - sums["above"][0]) / valid if valid else 0.0
                if hinge > 0:
                    lost += n * rank.weight * ramp * hinge
                    g = {k: v + rank.weight * ramp * sums[f"r.{k}"] / valid for k, v in g.items()}
                adam.step(g, epoch)
                total = {k: total.get(k, 0) + sums[k] for k in ("cells", "nll", "kl", "shift", "state", "ratio", "valid") if k in sums}
            if not total:
                break
            n = float(total["cells"][0])
            parts = {k: float(total[k][0]) / n for k in ("nll", "kl", "shift", "state", "ratio")}
            parts |= {"rank": lost / n, "rank_valid": float(total["valid"][0]) / n if ranked else 0.0}
            parts["loss"] = parts["nll"] + parts["kl"] + parts["rank"]
            history.extend({"epoch": epoch, "part": k, "value": v} for k, v in parts.items())
    return adam.w, history

"""Column expressions of the statistical model: priors, posteriors, likelihoods, schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-9
# Lanczos approximation of the gamma function, g = 7, nine terms.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def clamped(x: Column | float, low: float = TINY, high: float = 1 - TINY) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x if isinstance(x, Column) else F.lit(float(x))))


def variant_prior(freq: Column, default: float = 0.001, scale: float = 2.0, cap: float = 0.95) -> Column:
    """min(cap, max(default, scale * freq)); the default where no frequency is known."""
    return clamped(F.when(freq.isNull() | F.isnan(freq), F.lit(default)).otherwise(F.least(F.lit(cap), F.greatest(F.lit(default), freq * scale))))


def reference_posterior(prior: Column, ref_count: Column, p_alt: Column | float = 0.5, error: float = 0.001) -> Column:
    """P(no variant | only reference reads)."""
    r, p, e = F.greatest(F.lit(1), ref_count).cast("double"), clamped(p_alt), clamped(error)
    none, some = (1 - clamped(prior)) * F.pow(1 - e, r), clamped(prior) * F.pow(1 - p, r)
    return F.when(none + some > 0, none / (none + some))


def ternary_call(alt: Column, ref: Column, posterior: Column, threshold: float | None = None) -> Column:
    """1: variant seen; -1: reference only and sure enough; 0: neither."""
    sure = F.lit(True) if threshold is None else (posterior.isNull() | (posterior >= threshold))
    return F.when(alt > 0, 1).when((ref > 0) & sure, -1).otherwise(0)


def lgamma(x: Column) -> Column:
    """For positive x."""
    y = x - 1
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (y + i)
    t = y + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (y + 0.5) * F.ln(t) - t + F.ln(series)


def negative_binomial_nll(count: Column, mean: Column, theta: Column, least: float = 1e-6, most: float | None = None, shift: float | None = None) -> Column:
    """Of one count. The backbone uses least = shift = 1e-6; the effect model least 1e-5, most 1e6 and no shift."""
    top = lambda x: x if most is None else F.least(x, F.lit(most))
    shift = least if shift is None and most is None else shift or 0.0
    c, mu, th = top(F.greatest(count, F.lit(0.0))), top(F.greatest(mean, F.lit(least))), top(F.greatest(theta, F.lit(least)))
    both = F.ln(th + mu + shift)
    return -(lgamma(c + th) - lgamma(th) - lgamma(c + 1.0) + th * (F.ln(th + shift) - both) + c * (F.ln(mu + shift) - both))


def gaussian_kl(mean: Column, log_variance: Column, free_bits: float = 0.5) -> Column:
    """Of one dimension, at least the free bits."""
    return F.greatest(F.lit(free_bits), 0.5 * (mean * mean + F.exp(log_variance) - log_variance - 1.0))


def mean_activation(x: Column, kind: str = "umi") -> Column:
    if kind == "umi":
        return F.exp(F.least(x, F.lit(20.0)))
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))) if kind == "softplus" else x


def warm_cosine(epoch: Column, warm: int, total: int, base: float, least: float = 1e-8) -> Column:
    """Linear warm-up, then cosine decay."""
    down = F.lit(least) + (base - least) * 0.5 * (1 + F.cos(math.pi * (epoch - warm) / max(1, total - warm)))
    return F.when(epoch < warm, base * (epoch + 1) / max(1, warm)).otherwise(down)


def ramp(epoch: Column, warm: int, most: float = 1.0) -> Column:
    return F.lit(most) * F.least(F.lit(1.0), epoch / max(1, warm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column, epsilon: float = 1e-6) -> Column:
    norm = lambda v: F.greatest(F.sqrt(dot(v, v)), F.lit(epsilon))
    return 1 - dot(a, b) / (norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def exact_test(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Fisher's exact test, one-sided, of the table ((a, b), (c, d)): the probability of a or more in its place with the same margins. Terms are
    hypergeometric, from logarithms of factorials; there are at most min(b, c) + 1 of them."""
    chosen = lambda n, k: lgamma(n.cast("double") + 1) - lgamma(k.cast("double") + 1) - lgamma((n - k).cast("double") + 1)
    first, whole, hits = a + b, a + b + c + d, a + c
    term = lambda k: F.exp(chosen(hits, k) + chosen(whole - hits, first - k) - chosen(whole, first))
    return F.least(F.lit(1.0), F.aggregate(F.transform(F.sequence(a, a + F.least(b, c)), term), F.lit(0.0), lambda s, x: s + x))


SERIES, FRACTION = 40, 60  # terms; exact to the last few bits


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z of 0 or more: a series near 0, a continued fraction beyond 2."""
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    series = F.lit(0.0)
    for k in range(SERIES, 0, -1):
        series = (series + 1) * z * z / (2 * k + 1)
    fraction = z
    for k in range(FRACTION, 0, -1):
        fraction = z + F.lit(float(k)) / fraction
    return F.when(z < 2, 0.5 - density * z * (1 + series)).otherwise(density / fraction)

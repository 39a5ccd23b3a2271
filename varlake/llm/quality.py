"""Quality scores by Bradley-Terry pairwise ranking.

Every labelled pair (better, worse) is a preference; the score difference of its documents is a linear function of the
difference of their features, fitted by logistic loss. The threshold is a quantile of the training scores: the share of
worse documents among them. Scores are mapped to 0 to 1 so that this quantile is REJECT_BELOW.

The model is fitted on at most SAMPLE labelled rows (those of the smallest hash of the id), a documented bound, and on all
pairs of them: gradient and curvature of all pairs are matrix products over blocks of BLOCK rows. It is a vector of a dozen
numbers. Scoring runs over whole texts, inside Arrow batches, without a shuffle.

Defined results: null and empty texts are scored like a text without words; rows with a null label are not learned from;
with labels of one kind only, or none, every score is 0.5; rows that tie in the hash of the id are taken by their features,
repeated rows each count and are scored alike; null ids are never learned
from and are not held out; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

SAMPLE, BLOCK, REJECT_BELOW = 10_000, 1024, 0.3
# Classes of code points below U+0250: 0 other, 1 upper, 2 lower, 3 digit, 4 odd; those from there on are letters of class 0.
_PLAIN = " \t\n\r.,;:'’?()\"-_"
_CLASS = np.array([1 if c.isupper() else 2 if c.islower() else 3 if c in "0123456789" else 0 if c.isalnum() or c.isspace() or c in _PLAIN else 4 for c in map(chr, range(0x250))] + [0], np.uint8)
FEATURES = 14


def features(text: str | None) -> list[float]:
    """Language-neutral shape of a text; none of it uses labels, language, source or id."""
    text = text or ""
    words, n = text.split(), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    _, upper, lower, digits, odd = np.bincount(_CLASS[np.minimum(points, 0x250)], minlength=5).tolist()
    m, counts = max(1, len(words)), Counter(words)
    grams = Counter(zip(words, words[1:], words[2:]))
    capital = sum(c for w, c in counts.items() if w.isupper() and len(w) > 1) / m
    decorated = sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:?)\"'") / m
    again = sum(c for c in grams.values() if c > 1) / max(1, len(words) - 2)
    lengths = sum(map(len, words)) / m
    return [
        upper / max(1, upper + lower), capital, odd / n, decorated, digits / n, again,
        1 - len(counts) / m, max(counts.values(), default=0) / m, 1 - len(set(lines)) / max(1, len(lines)),
        min(lengths, 20) / 20, float(not words), min(10.0, np.log1p(len(words))) / 10, 1 / np.sqrt(m),
        text.count("\n") / m,
    ]


def all_pairs(better: np.ndarray, worse: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean logistic loss over all pairs (better, worse), its gradient and its curvature."""
    n, high, low = len(w), better @ w, worse @ w
    loss, grad, curve = 0.0, np.zeros(n), np.zeros((n, n))
    ahead, behind = np.zeros(len(better)), np.zeros(len(worse))
    for at in range(0, len(better), BLOCK):
        gap = np.clip(high[at:at + BLOCK, None] - low, -500, 500)
        p = 1 / (1 + np.exp(gap))  # of the wrong order
        loss += np.logaddexp(0, -gap).sum()
        grad -= better[at:at + BLOCK].T @ p.sum(axis=1) - worse.T @ p.sum(axis=0)
        p *= 1 - p
        ahead[at:at + BLOCK] = p.sum(axis=1)
        behind += p.sum(axis=0)
        cross = better[at:at + BLOCK].T @ (p @ worse)
        curve -= cross + cross.T
    curve += (better * ahead[:, None]).T @ better + (worse * behind[:, None]).T @ worse
    pairs = len(better) * len(worse)
    return loss / pairs, grad / pairs, curve / pairs


def fit(rows: np.ndarray, labels: np.ndarray, rounds: int = 25, ridge: float = 1e-3) -> dict:
    """Newton steps on the logistic loss of all pairs; returns weights, scale and the quantile threshold."""
    better, worse = rows[labels == 1], rows[labels == 0]
    if not len(better) or not len(worse):
        return {"w": np.zeros(rows.shape[1] if rows.ndim == 2 else FEATURES), "cut": 0.0, "spread": 1.0, "empty": True}
    scale = rows.std(axis=0) + 1e-6
    w = np.zeros(rows.shape[1])
    for _ in range(rounds):
        _, grad, curve = all_pairs(better / scale, worse / scale, w)
        step = np.linalg.solve(curve + ridge * np.eye(len(w)), -grad - ridge * w)
        w += step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    utility = rows @ (w / scale)
    share = len(worse) / len(rows)
    return {"w": w / scale, "cut": float(np.quantile(utility, share)), "spread": float(utility[labels == 1].std() + 1e-6), "empty": False}


def scores(model: dict, rows: np.ndarray) -> np.ndarray:
    if model["empty"]:
        return np.full(len(rows), 0.5)
    z = (rows @ model["w"] - model["cut"]) / model["spread"] + np.log(REJECT_BELOW / (1 - REJECT_BELOW))
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Only rows that are not held out. The sample of labels has at most `sample` rows of 16 bytes, so it is broadcast. Rows
    far beyond the sample's share of all hashes are left out before they are sorted."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter("doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id")))
    n = known.count()
    # twice the sample is expected to pass, so that fewer than it do not
    near = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) < int(2**31 * 2 * sample / n)) if n > 2 * sample else known
    known = near.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(2**31)), "doc_id", "quality").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["quality"], pa.array([features(t) for t in batch["text"].to_pylist()], pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    found = rows.mapInArrow(run, "doc_id long, quality int, x array<double>")
    # documents that share an id could be more than labels; the bound holds for them too
    got = found.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(2**31)), "doc_id", "quality", "x").limit(sample).toArrow()
    x = np.array(got["x"].to_pylist(), float).reshape(-1, FEATURES)
    return fit(x, np.array(got["quality"].to_pylist(), int))


def with_scores(docs: DataFrame, model: dict, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a score column; all other columns pass through unread."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the names of docs are
    at = docs.columns.index(text_col)
    inner = docs.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch[names[at]].to_pylist()], float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(model, x))], names=[*names, "s"])

    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, inner.schema))
    return inner.mapInArrow(run, f"{fields}, s double").toDF(*docs.columns, out)


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = with_scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= REJECT_BELOW).cast("int").alias("predicted"))

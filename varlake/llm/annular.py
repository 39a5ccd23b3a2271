"""Vector codes: product quantisation whose nearest entries are found by annular norm pruning.

Components become integers floor(256 * x); vectors are cut into 16 equal consecutive parts, each with a codebook that
starts as that part of the 64 vectors of the smallest ids and is refined in two rounds of assigning and averaging.

A part's nearest entry is searched among entries sorted by norm. The entries nearest in norm give a first distance d. By the
triangle inequality whatever is as near has a norm within d of the part's own, so binary search bounds an interval of the
sorted norms, both ends included. It is evaluated from the middle outwards, a few entries at a time, in integers; as d falls, the
interval is searched again, and nothing beyond it is evaluated. Norms are rounded, so the interval is widened by more than
the rounding; ties go to the lower index.

Codebooks (16 x 64 entries) are all that the driver holds; sums and counts come from partial sums per task, added by Spark.

Defined results: rows whose vector is null or holds null or non-finite components are dropped. Rows of another dimension
than most rows (the smaller, if as many) take no part in codebooks, errors or sums; their code and error are null. A dimension that 16 does not
divide is filled up with zeros. Components beyond 65,536 in size count as that. Rows with a null id come after all others in
the choice of first entries, equal ids in the order of their components; fewer than 64 vectors make smaller codebooks;
repeated rows count each; null labels are one label; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
RING = 4  # entries evaluated at a time on either side
LIMIT = 1 << 24  # of an integer component
CELLS = 1 << 21  # of an array that compares parts with entries
HOT_SHARE = 1000  # labels of more than one in so many rows are joined by a broadcast: fewer than so many labels


def integers(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a column as rows of PARTS * width integers."""
    if not len(column):
        return np.zeros((0, PARTS * width), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = np.floor(np.clip(flat * SCALE, -LIMIT, LIMIT)).astype(np.int64)
    return np.pad(x, ((0, 0), (0, PARTS * width - x.shape[1])))


class Codebook:
    """The entries of one part, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(axis=1))
        self.order = norms.argsort(kind="stable")
        self.sorted, self.norms = entries[self.order], norms[self.order]

    def annulus(self, norms: np.ndarray, squared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 of the sorted entries whose norms are within a distance of the parts' norms."""
        reach = np.sqrt(squared.astype(np.float64))
        slack = 1e-9 * (1 + norms + reach + self.norms[-1])
        return np.searchsorted(self.norms, norms - reach - slack, "left"), np.searchsorted(self.norms, norms + reach + slack, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of each part's nearest entry, and how many distances were evaluated."""
        step = max(1, CELLS // max(1, self.entries.size))
        done = [self._nearest(x[at:at + step]) for at in range(0, max(1, len(x)), step)]
        return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done]), sum(d[2] for d in done)

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        if not len(x):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        last = len(self.entries) - 1
        below = np.clip(np.searchsorted(self.norms, norms) - RING, 0, last)
        above = np.minimum(below + 2 * RING, last + 1)  # [below, above) has been evaluated
        best, index, seen = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), last + 1), 0

        def see(rows: np.ndarray, first: np.ndarray, end: np.ndarray) -> None:
            nonlocal seen
            rows, n, first = rows[end > first], (end - first)[end > first], first[end > first]
            if not len(rows):
                return
            start = np.cumsum(n) - n
            at = np.arange(n.sum()) - np.repeat(start - first, n)
            squared = ((x[np.repeat(rows, n)] - self.sorted[at]) ** 2).sum(axis=1)
            least = np.minimum.reduceat(squared, start)
            lowest = np.minimum.reduceat(np.where(squared == np.repeat(least, n), self.order[at], last + 1), start)
            better = (least < best[rows]) | (least == best[rows]) & (lowest < index[rows])
            best[rows[better]], index[rows[better]] = least[better], lowest[better]
            seen += len(at)

        rows = np.arange(len(x))
        see(rows, below, above)
        while len(rows):
            lo, hi = self.annulus(norms[rows], best[rows])
            rows = rows[(lo < below[rows]) | (hi > above[rows])]
            lo, hi = self.annulus(norms[rows], best[rows])
            for first, end in ((np.maximum(lo, below[rows] - RING), below[rows]), (above[rows], np.minimum(hi, above[rows] + RING))):
                see(rows, first, end)
            below[rows], above[rows] = np.minimum(below[rows], np.maximum(lo, below[rows] - RING)), np.maximum(above[rows], np.minimum(hi, above[rows] + RING))
        return index, best, seen


def _books(entries: np.ndarray) -> list[Codebook]:
    return [Codebook(entries[p]) for p in range(PARTS)]


def _sums(rows: DataFrame, entries: np.ndarray) -> DataFrame:
    """part, entry, pos, n, total: of the parts assigned to each entry."""
    width = entries.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, total, n = _books(entries), np.zeros(entries.shape, np.int64), np.zeros(entries.shape[:2], np.int64)
        for batch in batches:
            x = integers(batch["v"], width).reshape(-1, PARTS, width)
            for p in range(PARTS):
                index, _, _ = books[p].nearest(x[:, p])
                n[p] += np.bincount(index, minlength=n.shape[1])
                np.add.at(total[p], index, x[:, p])
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e], pa.int64()), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    partial = rows.select("v").mapInArrow(run, "part int, entry int, n long, total array<long>")
    return partial.select("part", "entry", "n", F.posexplode("total").alias("pos", "x")).groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("total"))


def fit(rows: DataFrame, width: int) -> np.ndarray:
    """The final entries, (part, entry, position), of rows (vec_id, v)."""
    start = rows.select("vec_id", "v").orderBy(F.col("vec_id").isNull(), "vec_id", "v").limit(ENTRIES).toArrow()
    entries = integers(start["v"].combine_chunks(), width).reshape(-1, PARTS, width).transpose(1, 0, 2).copy()
    for _ in range(ROUNDS):
        for r in _sums(rows, entries).collect():  # PARTS * ENTRIES * width rows at most
            entries[r["part"], r["entry"], r["pos"]] = r["total"] // r["n"]
    return entries


def encode(rows: DataFrame, entries: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of rows (vec_id, label, v)."""
    width = entries.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = _books(entries)
        for batch in batches:
            x = integers(batch["v"], width).reshape(-1, PARTS, width)
            code, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
            for p in range(PARTS):
                index, squared, _ = books[p].nearest(x[:, p])
                code[:, p] = index
                error += squared
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded (saved) with label_error. Labels of many rows are looked up where the rows are; no label of the rest is hot."""
    n = coded.count()
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"), F.count("*").alias("rows"))
    hot = totals.filter(F.col("rows") * HOT_SHARE > n).drop("rows")
    here = coded.join(F.broadcast(hot.withColumn("hot", F.lit(True))), F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    cold = totals.filter(F.col("rows") * HOT_SHARE <= n).drop("rows")
    rest = here.filter("hot is null").drop("label_error").join(cold, F.col("label").eqNullSafe(F.col("of"))).drop("of", "hot")
    return here.filter("hot").drop("hot").unionByName(rest)


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256."""
    scratch, v = Scratch(vectors.sparkSession, "codes"), F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    rows = rows.filter(v.isNotNull() & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))))
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    dimension = most["d"] if most else 0
    alike = rows.filter(F.size("v") == dimension)
    entries = fit(alike, max(1, -(-dimension // PARTS)))
    coded = with_label_error(scratch.save(encode(alike, entries), "coded"))
    other = rows.filter(F.size("v") != dimension).select("vec_id", "label")
    digest = hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()
    return coded.unionByName(other, allowMissingColumns=True).withColumn("codebooks_sha256", F.lit(digest)).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")


def annular_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def annular_sql() -> str:
    """The same by comparing every part with every entry."""
    whole = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"
    squared = "list_sum(list_transform(list_zip(q.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = lambda i: f"""near{i} AS (SELECT rid, p, d // {ENTRIES} AS d, d % {ENTRIES} AS e FROM
        (SELECT rid, q.p, min(CAST({squared} AS BIGINT) * {ENTRIES} + b.e) AS d FROM parts q JOIN book{i} b ON b.p = q.p GROUP BY rid, q.p))"""  # noqa: E731
    mean = lambda i: f"""sum{i} AS (SELECT p, e, i, CAST(floor(CAST(sum(y) AS DOUBLE) / count(*)) AS BIGINT) AS y FROM
        (SELECT q.p, n.e, unnest(range(len(q.x))) AS i, unnest(q.x) AS y FROM parts q JOIN near{i} n ON n.rid = q.rid AND n.p = q.p) GROUP BY p, e, i),
      mean{i} AS (SELECT p, e, list(y ORDER BY i) AS x FROM sum{i} GROUP BY p, e),
      book{i + 1} AS (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{i} b LEFT JOIN mean{i} m ON m.p = b.p AND m.e = b.e)"""  # noqa: E731
    return f"""
    WITH kept AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS rid, {whole} AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      parts AS (SELECT rid, p, list_slice(v, p * (len(v) // {PARTS}) + 1, (p + 1) * (len(v) // {PARTS})) AS x FROM kept, (SELECT unnest(range({PARTS})) AS p)),
      book0 AS (SELECT p, rid AS e, x FROM parts WHERE rid < {ENTRIES}),
      {near(0)}, {mean(0)}, {near(1)}, {mean(1)}, {near(2)},
      coded AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY rid),
      named AS (SELECT k.vec_id, coalesce(CAST(k.label AS VARCHAR), '-') AS label, c.code, c.error FROM coded c JOIN kept k ON k.rid = c.rid),
      totals AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM named GROUP BY label),
      books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
    SELECT n.vec_id, n.code, n.error, t.label_error, b.codebooks_sha256 FROM named n JOIN totals t ON t.label = n.label CROSS JOIN books b"""

"""Approximate nearest neighbours by inner product: a vantage-point tree per shard, below a tree of shards.

Vectors are lifted so that the largest inner product is the smallest Euclidean distance: x to (x / M, sqrt(1 - |x|^2 / M^2))
with M the largest norm, a query to (q / |q|, 0); both lie on the unit sphere. A tree stores, for each child, the range of
its distances to the vantage point. By the triangle inequality a child whose range is `gap` away from the query's own
distance holds nothing nearer than `gap`; it is visited if gap * factor <= distance of the k-th best. Factor 1 is exact
search, a larger factor prunes more. Unless one is given, the factor is the largest of FACTORS that finds TARGET of the true
neighbours among SHARD_ROWS rows of the sample, for its first CHUNK rows as queries.

The upper tree is built on the driver from a sample of at most 2 * SAMPLE rows; its leaves, LEAVES at most, are regions of
the space. Every row is indexed: it descends the upper tree to its region, and a region of more than SHARD_ROWS rows, say of
many copies of one vector, is dealt out to several shards of that size, each with a tree of its own. Exact ranges of all
rows of a region to the vantage points above it are kept beside the trees. A query first searches its own region; the k-th
best found there then decides, by the same rule, which other regions it is sent to: once to each group of shards, with the list of those in
reach, not once to each shard. Trees move once to the first and once to the second search (and once more for every QUERY_PART queries) and are
streamed past the queries of a group, which keep their k best and tighten their bounds from tree to tree.

Defined results: vectors that are null, empty, zero, of another dimension than most, or hold nulls or non-finite
components take no part, nor do rows with a null id; queries without candidates return no rows; ties go to the smaller
id; repeated rows are candidates each; a query's own id is never its neighbour; other columns are ignored. Components of
any finite size are scaled before they are squared; a score is what double arithmetic gives for the vectors as they are.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, table

K, SHARD_ROWS, LEAF = 20, 8192, 128
FACTORS, TARGET = (1.0, 1.5, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 12.0, 16.0), 0.97
SAMPLE, LEAVES = 65_536, 4096
QUERY_PART, CHUNK = 65_536, 256
SLACK = 1e-7  # distances within rounding of a bound are not pruned


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id long, v array<float or double>) of the rows that take part."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).filter("vec_id is not null and v is not null")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    rows = rows.filter(finite & F.exists(v, lambda x: x != 0))
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.filter(F.size("v") == (most["d"] if most else 0))


def _stack(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)


def _distance(sims: np.ndarray) -> np.ndarray:
    return np.sqrt(np.clip(2 - 2 * sims, 0, None))


def _unit(q: np.ndarray) -> np.ndarray:
    q = q / np.abs(q).max(axis=1, keepdims=True)
    return q / np.sqrt((q**2).sum(axis=1, keepdims=True))


class Lift:
    """x to the unit sphere: first by the largest component of all, then by the largest norm of the scaled vectors."""

    def __init__(self, largest: float, norm: float):
        self.largest, self.norm = largest, norm

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return x / self.largest / self.norm

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = self.scaled(x)
        return np.concatenate([y, np.sqrt(np.clip(1 - (y**2).sum(axis=1), 0, None))[:, None]], axis=1)


class Regions:
    """The upper tree. Inner nodes have a vantage point and the distance at which they part; leaves are regions, each with
    the path of vantage points and sides above it."""

    def __init__(self, lifted: np.ndarray, leaves: int):
        self.points, self.cuts, self.children, self.paths, self.shares = [], [], [], [], []
        self.depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
        self.root = self._build(lifted, self.depth, [])
        self.points = np.array(self.points).reshape(len(self.cuts), lifted.shape[1])
        self.paths = [np.array(p, int) for p in self.paths]

    def _leaf(self, rows: int, path: list[int]) -> int:
        self.paths.append(path)
        self.shares.append(rows)
        return -len(self.paths)

    def _build(self, lifted: np.ndarray, depth: int, path: list[int]) -> int:
        """The number of a node, or -1 - that of a region."""
        if depth == 0 or len(lifted) < 4:
            return self._leaf(len(lifted), path)
        d = _distance(lifted @ lifted[0])
        cut = float(np.median(d))
        near = d < cut
        if not near.any():  # copies of one vector
            return self._leaf(len(lifted), path)
        at = len(self.cuts)
        self.points.append(lifted[0])
        self.cuts.append(cut)
        self.children.append(None)
        self.children[at] = (self._build(lifted[near], depth - 1, [*path, at]), self._build(lifted[~near], depth - 1, [*path, at]))
        return at

    def distances(self, y: np.ndarray, to: np.ndarray | slice = slice(None)) -> np.ndarray:
        return _distance(y @ self.points[to].T)

    def of(self, y: np.ndarray) -> np.ndarray:
        """The region of each row: it descends, and is held against the vantage points on its way alone."""
        out = np.zeros(len(y), np.int32)

        def go(node: int, rows: np.ndarray) -> None:
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                near = _distance(y[rows] @ self.points[node]) < self.cuts[node]
                go(self.children[node][0], rows[near])
                go(self.children[node][1], rows[~near])

        go(self.root, np.arange(len(y)))
        return out


class Tree:
    """Nodes in arrays: [start, end) of the permuted rows; inner nodes have a vantage point (row `start`), two children
    and the ranges of their distances to it."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, lift: Lift):
        self.lift = lift
        lifted = lift(x.astype(np.float64))
        order, self.nodes = np.arange(len(ids)), []
        self._build(lifted, order, 0, len(ids))
        self.ids, self.x = ids[order], x[order]

    def _build(self, lifted: np.ndarray, order: np.ndarray, start: int, end: int) -> int:
        at = len(self.nodes)
        self.nodes.append((start, end, -1, -1, 0.0, 0.0, 0.0, 0.0))
        if end - start > LEAF:
            own = order[start:end]
            d = _distance(lifted[own[1:]] @ lifted[own[0]])
            by = d.argsort(kind="stable")
            order[start + 1:end] = own[1:][by]
            d, half = d[by], len(d) // 2
            left = self._build(lifted, order, start + 1, start + 1 + half)
            right = self._build(lifted, order, start + 1 + half, end)
            self.nodes[at] = (start, end, left, right, d[0], d[half - 1], d[half], d[-1])
        return at

    def search(self, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query rows, ids, scores) of the k best of each query, none of which is below its bound by more than rounding; and
        how many rows were compared. A bound is the k-th best similarity that is known from elsewhere."""
        x, raw = self.lift.scaled(self.x.astype(np.float64)), self.x.astype(np.float64)
        unit = _unit(queries)
        best = np.full((len(queries), k), -np.inf)
        least = bounds.astype(np.float64).copy()  # of each query: what a row must reach
        found: list[tuple[np.ndarray, np.ndarray]] = []
        seen = 0

        def see(active: np.ndarray, start: int, end: int) -> None:
            nonlocal seen
            s = unit[active] @ x[start:end].T
            seen += s.size
            own = query_ids[active][:, None] == self.ids[None, start:end]
            hit = (s >= least[active][:, None] - 1e-9) & ~own
            some = hit.any(axis=1)
            if some.any():
                rows, at = active[some], np.nonzero(hit)
                found.append((active[at[0]], at[1] + start))
                both = np.concatenate([best[rows], np.where(hit[some], s[some], -np.inf)], axis=1)
                best[rows] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                least[rows] = np.maximum(least[rows], best[rows].min(axis=1))

        def visit(at: int, active: np.ndarray) -> None:
            start, end, left, right, lo_in, hi_in, lo_out, hi_out = self.nodes[at]
            if left < 0:
                see(active, start, end)
                return
            see(active, start, start + 1)
            lifted = np.sqrt(max(0.0, 1 - (x[start] ** 2).sum()))
            d = np.sqrt(np.clip((unit[active] - x[start]) ** 2 @ np.ones(x.shape[1]) + lifted**2, 0, None))
            inner = d <= (hi_in + lo_out) / 2
            # the side of the query first, its bound may leave out the other
            for near in (True, False):
                for child, side, lo, hi in ((left, inner, lo_in, hi_in), (right, ~inner, lo_out, hi_out)):
                    gap = np.maximum(np.maximum(lo - d, d - hi), 0)
                    mine = (side if near else ~side) & (gap * factor <= _distance(least[active]) + SLACK)
                    if mine.any():
                        visit(child, active[mine])

        visit(0, np.arange(len(queries)))
        if not found:
            return np.zeros(0, int), self.ids[:0], np.zeros(0), seen
        rows, at = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        near = (unit[rows] * x[at]).sum(axis=1) >= least[rows] - 1e-9
        rows, at = rows[near], at[near]
        with np.errstate(over="ignore", invalid="ignore"):
            exact = (raw[at] * queries[rows]).sum(axis=1)  # row by row, so that equal vectors score exactly alike
        order = np.lexsort((self.ids[at], np.where(np.isnan(exact), np.inf, -exact), rows))
        rows, at, exact = rows[order], at[order], exact[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        return rows[place < k], self.ids[at[place < k]], exact[place < k], seen


def tuned_factor(sample: np.ndarray, lift: Lift, k: int = K) -> float:
    rows = sample[:SHARD_ROWS]
    ids, asked = np.arange(len(rows)), rows[:CHUNK]
    tree, sims = Tree(ids, rows, lift), _unit(asked) @ lift.scaled(rows).T
    sims[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    kth = np.sort(sims, axis=1)[:, -min(k, len(rows)):][:, 0] - 1e-9
    best = FACTORS[0]
    for factor in FACTORS[1:]:
        of, near, _, _ = tree.search(ids[:len(asked)], asked, np.full(len(asked), -np.inf), k, factor)
        if (sims[of, near] >= kth[of]).sum() < TARGET * min(k, len(rows) - 1) * len(asked):
            break
        best = factor
    return best


class Index:
    """What the driver knows of an index: the upper tree, its ranges and where its shards begin. The trees are in `trees`."""

    def __init__(self, trees: DataFrame, lift: Lift, regions: Regions, first: np.ndarray, factor: float):
        self.trees, self.lift, self.regions, self.first, self.factor = trees, lift, regions, first, factor
        depth = max([1, *map(len, regions.paths)])
        self.low, self.high = np.full((len(regions.paths), depth), np.inf), np.full((len(regions.paths), depth), -np.inf)
        rows = trees.select("region", F.posexplode(F.arrays_zip("low", "high"))).groupBy("region", "pos").agg(F.min("col.low").alias("low"), F.max("col.high").alias("high"))
        for r in rows.collect():  # LEAVES * log2(LEAVES) at most
            self.low[r["region"], r["pos"]], self.high[r["region"], r["pos"]] = r["low"], r["high"]

    def shards_of(self, regions: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(self.first[r], self.first[r + 1]) for r in regions]) if len(regions) else np.zeros(0, int)


def _reach(regions: Regions, low: np.ndarray, high: np.ndarray, d: np.ndarray, bound: np.ndarray, factor: float) -> np.ndarray:
    """Which regions each query may find something in: d holds its distances to all vantage points."""
    out = np.ones((len(d), len(regions.paths)), bool)
    far = bound + SLACK
    for r, path in enumerate(regions.paths):
        if len(path):
            gap = np.maximum(low[r, :len(path)] - d[:, path], d[:, path] - high[r, :len(path)]).max(axis=1)
            out[:, r] = np.maximum(gap, 0) * factor <= far
    return out


def build_index(vectors: DataFrame, scratch: Scratch, shard_rows: int = SHARD_ROWS) -> Index:
    """vectors: as usable() returns them."""
    n, largest = vectors.agg(F.count("*"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()
    largest = largest or 1.0
    norm = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x.cast("double") / largest) ** 2))).first()[0]
    lift = Lift(largest, float(np.sqrt(norm or 1.0)) * (1 + 1e-12))
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(2**31))
    sample = vectors.filter(place < int(2**31 * min(1.0, SAMPLE / max(1, n)))).select("v").limit(2 * SAMPLE).toArrow()["v"] if n else []
    sample = _stack(sample) if len(sample) else np.zeros((0, 1))
    regions = Regions(lift(sample) if len(sample) else sample, min(LEAVES, -(-n // shard_rows)))
    shares = np.array(regions.shares, float) / max(1, sum(regions.shares))
    count = np.maximum(1, np.ceil(shares * n / shard_rows * 0.999)).astype(int)  # shards of each region
    first = np.concatenate([[0], np.cumsum(count)])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                of = regions.of(lift(_stack(batch["v"])))
                shard = first[of] + batch["salt"].to_numpy() % count[of]
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(of, pa.int32()), batch["vec_id"], batch["v"]], names=["shard", "region", "vec_id", "v"])

    def build(rows: pa.Table) -> pa.Table:
        x = np.stack(rows["v"].to_numpy(zero_copy_only=False))
        region = rows["region"][0].as_py()
        d = regions.distances(lift(x.astype(np.float64)), regions.paths[region])
        tree = Tree(rows["vec_id"].to_numpy(), x, lift)
        return pa.table({"shard": rows["shard"][:1], "region": rows["region"][:1], "low": pa.array([d.min(axis=0)], pa.list_(pa.float64())), "high": pa.array([d.max(axis=0)], pa.list_(pa.float64())), "tree": pa.array([pickle.dumps(tree, protocol=5)], pa.binary())})

    kind = vectors.schema["v"].dataType.simpleString()
    routed = vectors.withColumn("salt", place).mapInArrow(route, f"shard long, region int, vec_id long, v {kind}")
    trees = routed.groupBy("shard").applyInArrow(build, "shard long, region int, low array<double>, high array<double>, tree binary")
    return Index(scratch.save(trees, "trees"), lift, regions, first, tuned_factor(sample, lift) if len(sample) else FACTORS[0])


class _Asked:
    """The queries of one cell, what they have found, and which of them each shard is asked by."""

    def __init__(self, lift: Lift, k: int, factor: float):
        self.lift, self.k, self.factor, self.parts, self.rows = lift, k, factor, [], None

    def add(self, batch: pa.RecordBatch) -> None:
        if len(batch):
            shards = batch["shards"].flatten().to_numpy()
            self.parts.append((batch["query_id"].to_numpy(), np.stack(batch["q"].to_numpy(zero_copy_only=False)), batch["bound"].to_numpy(), shards, batch["shards"].value_lengths().to_numpy()))

    def _ready(self) -> None:
        self.ids, self.q, self.bound, shards, sizes = (np.concatenate(c) for c in zip(*self.parts))
        self.parts = []
        self.rows = np.repeat(np.arange(len(self.ids)), sizes)
        order = shards.argsort(kind="stable")
        self.rows, self.shards = self.rows[order], shards[order]
        self.norms = np.sqrt(((self.q.astype(np.float64) / self.lift.largest) ** 2).sum(axis=1))
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def ask(self, shard: int, tree: Tree) -> None:
        if self.rows is None:
            if not self.parts:
                return
            self._ready()
        asking = self.rows[np.searchsorted(self.shards, shard, "left"):np.searchsorted(self.shards, shard, "right")]
        for a in range(0, len(asking), CHUNK):
            some = asking[a:a + CHUNK]
            of, near, scores, _ = tree.search(self.ids[some], self.q[some].astype(np.float64), self.bound[some], self.k, self.factor)
            self._merge(some[of], near, scores)

    def _merge(self, of: np.ndarray, near: np.ndarray, scores: np.ndarray) -> None:
        """The best of what has been found; a query that has k asks the next shards with the last of these as its bound."""
        held, touched = self.found, np.isin(self.found[0], of)
        rows, ids, values = (np.concatenate([h[touched], new]) for h, new in zip(held, (of, near, scores)))
        order = np.lexsort((ids, np.where(np.isnan(values), np.inf, -values), rows))
        rows, ids, values = rows[order], ids[order], values[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        last = place == self.k - 1
        with np.errstate(over="ignore", invalid="ignore"):
            bound = values[last] / self.lift.largest / self.lift.largest / self.lift.norm / self.norms[rows[last]] - 1e-9
        self.bound[rows[last]] = np.fmax(self.bound[rows[last]], np.where(np.isfinite(bound), bound, -np.inf))
        kept = place < self.k
        self.found = tuple(np.concatenate([h[~touched], new[kept]]) for h, new in zip(held, (rows, ids, values)))

    def result(self) -> pa.RecordBatch | None:
        if self.rows is None or not len(self.found[0]):
            return None
        of, near, scores = self.found
        return pa.RecordBatch.from_arrays([pa.array(self.ids[of], pa.int64()), pa.array(near, pa.int64()), pa.array(scores, pa.float64())], names=["query_id", "vec_id", "score"])


def _past_trees(index: Index, sent: DataFrame, n_queries: int, k: int, factor: float) -> DataFrame:
    """(query_id, vec_id, score): the k best that each query finds in each group of the shards it is sent to. sent: query_id, q, bound, shards. Shards
    are dealt into as many groups as there are shuffle partitions, and a query goes once to each group, not to each shard. A task holds one
    part of the queries of a group while the group's trees pass by, and asks each with bounds that the ones before have tightened."""
    parts, shards = max(1, -(-n_queries // QUERY_PART)), int(index.first[-1])
    groups = max(1, min(shards, int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    lift, found = index.lift, "query_id long, vec_id long, score double"
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    trees = index.trees.select("shard", F.pmod("shard", F.lit(groups)).cast("int").alias("grp"), part.alias("part"), F.lit(1).alias("kind"), "tree")
    asked = sent.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).withColumn("kind", F.lit(0))
    asked = asked.withColumn("grp", F.explode(F.array_distinct(F.transform("shards", lambda s: F.pmod(s, F.lit(groups)).cast("int")))))
    asked = asked.withColumn("shards", F.filter("shards", lambda s: F.pmod(s, F.lit(groups)) == F.col("grp")))
    both = trees.unionByName(asked, allowMissingColumns=True)
    by_cell = both.repartition(2 * groups * parts, "grp", "part").sortWithinPartitions("grp", "part", "kind", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            cell = np.stack([batch["grp"].to_numpy(), batch["part"].to_numpy()], axis=1)
            kinds = batch["kind"].to_numpy()
            cuts = [0, *(1 + np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1) | (kinds[1:] != kinds[:-1]))), len(batch)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if at != tuple(cell[start]):
                    if own is not None and (done := own.result()) is not None:
                        yield done
                    at, own = tuple(cell[start]), _Asked(lift, k, factor)
                rows = batch.slice(start, end - start)
                if kinds[start] == 0:
                    own.add(rows)
                    continue
                for shard, tree in zip(rows["shard"].to_numpy(), rows["tree"]):
                    own.ask(shard, pickle.loads(tree.as_py()))
        if own is not None and (done := own.result()) is not None:
            yield done

    return by_cell.mapInArrow(run, found)


def _best(found: DataFrame, k: int) -> DataFrame:
    score = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(score.desc(), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)


def search(queries: DataFrame, index: Index, scratch: Scratch, k: int = K, factor: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score. queries: as usable() returns them; rows with an id asked before are asked once."""
    regions, lift, low, high = index.regions, index.lift, index.low, index.high
    factor = index.factor if factor is None else factor
    groups = [index.shards_of(np.array([r])).tolist() for r in range(len(regions.paths))]
    asked = queries.dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    kind = asked.schema["q"].dataType.simpleString()

    def sent(rows: DataFrame, others: bool) -> DataFrame:
        """Each query, its bound, and every shard of its own region or of others in reach."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                unit = _unit(_stack(batch["q"]))
                lifted = np.concatenate([unit, np.zeros((len(unit), 1))], axis=1)
                home = regions.of(lifted)
                if others:
                    d = regions.distances(lifted) if len(regions.cuts) else np.zeros((len(unit), 0))
                    go = _reach(regions, low, high, d, _distance(batch["bound"].to_numpy()), factor)
                    go[np.arange(len(go)), home] = False
                    where = [[s for r in np.flatnonzero(g) for s in groups[r]] for g in go]
                else:
                    where = [groups[r] for r in home]
                yield pa.RecordBatch.from_arrays([batch["query_id"], batch["q"], batch["bound"], pa.array(where, pa.list_(pa.int64()))], names=["query_id", "q", "bound", "shards"])

        return rows.mapInArrow(run, f"query_id long, q {kind}, bound double, shards array<long>").filter(F.size("shards") > 0)

    n = asked.count()
    first = scratch.save(_best(_past_trees(index, sent(asked.withColumn("bound", F.lit(float("-inf"))), False), n, k, factor), k), "first")
    if len(regions.paths) == 1:
        return first.select("query_id", "rank", "vec_id", "score")
    # the k-th best so far as a similarity of lifted points; a little less, so that rounding loses nothing
    kth = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    scaled = F.aggregate("q", F.lit(0.0), lambda s, x: s + (x.cast("double") / lift.largest) ** 2)
    bound = F.col("kth") / lift.largest / lift.largest / lift.norm / F.sqrt(scaled) - 1e-9
    bounded = asked.join(kth, "query_id", "left").withColumn("bound", F.coalesce(F.when(F.isnan(bound) | F.isnull(bound), None).otherwise(bound), F.lit(float("-inf"))))
    more = _past_trees(index, sent(bounded.select("query_id", "q", "bound"), True), n, k, factor)
    return _best(first.select("query_id", "vec_id", "score").unionByName(more), k).select("query_id", "rank", "vec_id", "score")


def ann_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "ann")
    vectors = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(vectors.filter("vec_id % 20 = 0"), build_index(vectors, scratch), scratch)

"""Approximate nearest neighbours by descent: the neighbours of neighbours are likely neighbours.

Random projection trees, built on a bounded sample, deal the rows into blocks; the nearest within a row's blocks are its first pool of
neighbours. A round then brings together, for every row, rows of its pool and rows that have it in theirs, at most SAMPLE of either
in expectation and chosen by hash, and compares these with each other: what is nearer than the last of a row's pool is taken up. An entry is fresh until
it has been chosen once, and pairs of which neither is fresh are not compared again, so that later rounds move fewer vectors. Rounds end when
few rows change. Each round moves a bounded number of vectors per row, so its shuffle grows with the rows, not with their square.

Rows that many others point to are sampled by the number that do, so that no group grows with the table. Among equal distances a hash of both
rows decides, which spreads copies over one another's pools. Every round is written to the shared folder.

Where vectors have few dimensions a forest does with less: every tree deals the rows into regions, which their tasks split down to leaves, and
rows of a leaf are compared. Trees are added until the recall of a sample of rows, whose neighbours are found by comparing them with all, is high enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folder import Tables
from .blocks import by_group, vectors, whole_groups

TREES, LEAF_ROWS, LEAVES, TREE_SAMPLE = 4, 256, 4096, 65_536
POOL, SAMPLE, ROUNDS = 30, 20, 8
FEW = 0.002  # share of pool entries that a round must change for another one
REGION_ROWS, FOREST_LEAF, CHUNK = 32_768, 2048, 128
FIRST_TREES, MORE_TREES, MOST_TREES = 4, 6, 64
SURE, SURE_ROWS = 0.995, 512  # the recall at which a forest ends, and about how many rows it is measured on


class ProjectionTree:
    """Planes halfway between two rows' projections, down to leaves of few sample rows."""

    def __init__(self, x: np.ndarray, depth: int, rng: np.random.Generator):
        self.planes: list[tuple[np.ndarray, float]] = []
        self.children: list[tuple[int, int]] = []
        self.leaves = 0
        self.root = self._build(x, depth, rng)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _build(self, x: np.ndarray, depth: int, rng: np.random.Generator) -> int:
        if depth == 0 or len(x) < 4:
            return self._leaf()
        a, b = x[rng.integers(len(x), size=2)]
        plane = a - b if np.any(a != b) else rng.normal(size=x.shape[1])
        along = x @ plane
        cut = float(np.median(along))
        left = along < cut
        if not left.any():  # copies of one row
            return self._leaf()
        at = len(self.planes)
        self.planes.append((plane, cut))
        self.children.append((0, 0))
        self.children[at] = (self._build(x[left], depth - 1, rng), self._build(x[~left], depth - 1, rng))
        return at

    def of(self, x: np.ndarray, depths: np.ndarray) -> np.ndarray:
        """A number for the node that each row reaches at its own depth, or the leaf above that."""
        out, stack = np.zeros(len(x), np.int64), [(self.root, 0, np.arange(len(x)))]
        while stack:
            node, depth, rows = stack.pop()
            ends = depths[rows] <= depth if node >= 0 else np.ones(len(rows), bool)
            out[rows[ends]] = node + self.leaves
            rows = rows[~ends]
            if len(rows):
                plane, cut = self.planes[node]
                left = x[rows] @ plane < cut
                stack += [(self.children[node][0], depth + 1, rows[left]), (self.children[node][1], depth + 1, rows[~left])]
        return out


def squared_distances(x: np.ndarray) -> np.ndarray:
    """Between all rows of x; what rounding makes of copies is 0."""
    norms = (x**2).sum(1)
    both = norms[:, None] + norms[None]
    d = both - 2 * (x @ x.T)
    d[d < 1e-12 * both] = 0
    return d


def _nearest_in(ids: np.ndarray, d: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, squared distance): of each row up to k others that are nearer than its limit."""
    d = np.where(ids[:, None] == ids[None], np.inf, d)
    k = min(k, d.shape[1])
    # equal distances in an order of each row's own
    order = (ids[None] * 0x9E3779B1 + ids[:, None] * 0x85EBCA77) & 0x7FFFFFFF
    at = np.lexsort((order, d), axis=1)[:, :k]
    near = np.take_along_axis(d, at, 1)
    keep = (near < limit[:, None]) & np.isfinite(near)
    return np.repeat(ids, keep.sum(1)), ids[at[keep]], near[keep]


_FOUND = "a long, b long, d double"


def _batch(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["a", "b", "d"])


def _first_pools(points: DataFrame, n: int, pool: int, seed: int) -> DataFrame:
    sample = points.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2**31)) < int(2**31 * min(1.0, TREE_SAMPLE / n))).select("z").limit(2 * TREE_SAMPLE).toArrow()
    x, rng = vectors(sample["z"]) if len(sample) else np.zeros((0, 1)), np.random.default_rng(seed)
    deepest = max(0, int(np.ceil(np.log2(max(1, min(LEAVES, n / LEAF_ROWS))))))
    trees = [ProjectionTree(x, deepest, rng) for _ in range(TREES)]
    # every group goes down as far as its own size allows
    sizes = points.groupBy(F.col("grp").alias("of")).agg(F.count("*").alias("rows"))
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("rows") / LEAF_ROWS))).cast("long")
    points = points.join(sizes, F.col("grp") == F.col("of")).select("id", "grp", depth.alias("depth"), "z")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                z, depths = vectors(pa.chunked_array([b["z"]])), b["depth"].to_numpy()
                for t, tree in enumerate(trees):
                    yield pa.RecordBatch.from_arrays([b["id"], b["grp"], b["z"], pa.array(tree.of(z, depths) * TREES + t)], names=["id", "grp", "z", "leaf"])

    dealt = points.mapInArrow(deal, f"id long, grp long, z {dict(points.dtypes)['z']}, leaf long")
    # leaves beyond LEAVES, and copies, are dealt out by their own size
    large = dealt.groupBy("grp", "leaf").agg(F.ceil(F.count("*") / (4 * LEAF_ROWS)).alias("pieces")).filter("pieces > 1")
    dealt = dealt.join(large, ["grp", "leaf"], "left").withColumn("piece", F.pmod(F.xxhash64("id", "leaf"), F.coalesce("pieces", F.lit(1))))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in whole_groups(batches, "grp", "leaf", "piece"):
            ids, z = rows["id"].to_numpy(), vectors(rows["z"])
            yield _batch([_nearest_in(ids[i:j], squared_distances(z[i:j]), np.full(j - i, np.inf), pool) for i, j in zip(at, at[1:])])

    return by_group(dealt.select("grp", "leaf", "piece", "id", "z"), "grp", "leaf", "piece").mapInArrow(near, _FOUND)


def _best(found: DataFrame, pool: int) -> DataFrame:
    """The pool of each row: (a, b, d, fresh, born), the nearest of what was found, each other row once. One shuffle, by row, serves both steps."""
    once = found.repartition("a").groupBy("a", "b").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"), F.min("born").alias("born"))
    place = F.row_number().over(Window.partitionBy("a").orderBy("d", F.xxhash64("a", "b"), "b"))
    return once.withColumn("place", place).filter(F.col("place") <= pool)


def _drawn(graph: DataFrame, pool: int, sample: int, seed: int) -> DataFrame:
    """graph with drawn: whether an entry takes part in this round."""
    wanted = graph.groupBy(F.col("b").alias("to")).agg(F.count("*").alias("wanted"))
    links = graph.join(wanted, F.col("b") == F.col("to")).withColumn("draw", F.pmod(F.xxhash64("a", "b", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20))
    drawn = (F.col("draw") < F.lit(float(sample)) / F.greatest("wanted", F.lit(sample))) & (F.pmod(F.xxhash64("b", "a", F.lit(seed)), F.lit(pool)) < sample)
    return links.select(*graph.columns, drawn.alias("drawn"))


def _round(graph: DataFrame, points: DataFrame, pool: int, sample: int, seed: int) -> DataFrame:
    """(a, b, d): what rows that meet through a third one find in each other. Rows of which neither is fresh have met before, or had their chance;
    where no row is fresh, none moves. Without a column `drawn` entries are drawn here, and all are fresh."""
    if "drawn" not in graph.columns:
        graph = _drawn(graph.withColumn("fresh", F.lit(True)), pool, sample, seed)
    kept = graph.filter("drawn")
    members = kept.select(F.col("a").alias("v"), F.col("b").alias("u"), "fresh").union(kept.select(F.col("b").alias("v"), F.col("a").alias("u"), "fresh"))
    members = members.repartition("v").groupBy("v", "u").agg(F.max("fresh").alias("fresh"))
    members = members.withColumn("any", F.max("fresh").over(Window.partitionBy("v"))).filter("any").drop("any")
    last = graph.groupBy(F.col("a").alias("id")).agg(F.when(F.count("*") >= pool, F.max("d")).alias("limit"))
    known = points.drop("grp", "cell").join(last, "id", "left").select(F.col("id").alias("u"), "z", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in whole_groups(batches, "v"):
            ids, limit, z, fresh = rows["u"].to_numpy(), rows["limit"].to_numpy(), vectors(rows["z"]), rows["fresh"].to_numpy()
            yield _batch([_nearest_in(ids[i:j], np.where(fresh[i:j, None] | fresh[None, i:j], squared_distances(z[i:j]), np.inf), limit[i:j], pool) for i, j in zip(at, at[1:])])

    return by_group(members.join(known, "u").select("v", "u", "z", "limit", "fresh"), "v").mapInArrow(meet, _FOUND)


def approximate_neighbours(latents: DataFrame, tables: Tables, k: int = 15, pool: int = POOL, sample: int = SAMPLE, rounds: int = ROUNDS, seed: int = 3) -> DataFrame:
    """cell, neighbour, distance, place: about the k nearest by Euclidean distance. latents: (cell, z), names once each, and, if there is one,
    grp, a long: only cells of one group are neighbours then. Null vectors take no part. The result is one of `tables`."""
    pool = max(pool, k)
    grp = F.coalesce(F.col("grp").cast("long"), F.lit(0)) if "grp" in latents.columns else F.lit(0).cast("long")
    kind = "array<float>" if dict(latents.dtypes)["z"] == "array<float>" else "array<double>"  # distances are taken in double precision from either
    named = latents.filter("z is not null").select(F.col("cell").cast("string").alias("cell"), grp.alias("grp"), F.col("z").cast(kind).alias("z"))
    points = tables.save(named.withColumn("id", F.monotonically_increasing_id()), "points")
    n = points.count()
    if not n:
        return points.select("cell", F.col("cell").alias("neighbour"), F.lit(0.0).alias("distance"), F.lit(0).alias("place"))
    in_turn = lambda found, turn: found.select("a", "b", "d", F.lit(True).alias("fresh"), F.lit(turn).alias("born"))
    graph = tables.save(_best(in_turn(_first_pools(points, n, pool, seed), 0), pool), "graph-0")
    for turn in range(1, rounds + 1):
        drawn = tables.save(_drawn(graph.drop("place"), pool, sample, seed + turn), f"drawn-{turn}")
        known = drawn.select("a", "b", "d", (F.col("fresh") & ~F.col("drawn")).alias("fresh"), "born")
        graph = tables.save(_best(known.union(in_turn(_round(drawn, points, pool, sample, seed + turn), turn)), pool), f"graph-{turn}")
        new = graph.filter(F.col("born") == turn).count()
        tables.drop(f"graph-{turn - 1}", f"drawn-{turn}")
        if new <= FEW * n * pool:
            break
    names = points.select("id", "cell")
    near = graph.filter(F.col("place") <= k).join(names.withColumnRenamed("id", "a"), "a")
    near = near.join(names.select(F.col("id").alias("b"), F.col("cell").alias("neighbour")), "b")
    return tables.save(near.select("cell", "neighbour", F.sqrt("d").alias("distance"), "place"), "neighbours")


def _nearest_to(ids: np.ndarray, z: np.ndarray, limit: np.ndarray, others: np.ndarray, oz: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in ids, b, squared distance), by place: of each row up to k of the others that are nearer than its limit. One product tells which may be;
    only these are compared exactly. Equal distances are in an order of each row's own."""
    norms, theirs = (z**2).sum(1), (oz**2).sum(1)
    d = np.concatenate([z * -2, np.ones((len(z), 1))], 1) @ np.concatenate([oz, theirs[:, None]], 1).T  # less the row's own norm
    most = limit - norms
    open_ = np.flatnonzero(np.isinf(limit))
    if d.shape[1] > k + 1 and len(open_):  # one more: the row itself may be among the others
        most[open_] = np.partition(d if len(open_) == len(d) else d[open_], k, axis=1)[:, k]
    room = 1e-12 * (norms + theirs[np.isfinite(theirs)].max(initial=0))  # for rounding
    a, b = np.divmod(np.flatnonzero(d <= (most + room)[:, None]), d.shape[1])
    exact = ((z[a] - oz[b]) ** 2).sum(1)
    near = (exact < limit[a]) & (ids[a] != others[b])
    a, b, exact = a[near], others[b[near]], exact[near]
    order = np.lexsort(((b * 0x9E3779B1 + ids[a] * 0x85EBCA77) & 0x7FFFFFFF, exact, a))
    a, b, exact = a[order], b[order], exact[order]
    first = _place(a) < k
    return a[first], b[first], exact[first]


def _place(runs: np.ndarray) -> np.ndarray:
    """The place from 0 of each row in its run of equal values."""
    at = np.flatnonzero(np.append(True, runs[1:] != runs[:-1])) if len(runs) else np.zeros(0, int)
    return np.arange(len(runs)) - np.repeat(at, np.diff(np.append(at, len(runs))))


_NEAR = "id long, near array<long>, d array<double>"


def _lists(ids: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    """One row for each place in ids that a, sorted, has."""
    counts = np.bincount(a, minlength=len(ids))
    ends = np.append(0, np.cumsum(counts[counts > 0])).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(ids[counts > 0]), pa.ListArray.from_arrays(ends, pa.array(b)), pa.ListArray.from_arrays(ends, pa.array(d))], names=["id", "near", "d"])


def _leaves(z: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """The rows of a region in halves along the line through two of them, down to FOREST_LEAF; copies are cut anywhere."""
    stack = [np.arange(len(z))]
    while stack:
        rows = stack.pop()
        if len(rows) <= FOREST_LEAF:
            yield rows
            continue
        a, b = z[rows[rng.integers(len(rows), size=2)]]
        along = z[rows] @ (a - b if np.any(a != b) else rng.normal(size=z.shape[1]))
        order = np.lexsort((rng.random(len(rows)), along))
        stack += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]


def _merged(found: DataFrame, k: int) -> DataFrame:
    """One row for each id: its k nearest of all its rows, each other row once, the nearest first."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in whole_groups(batches, "id"):
            ids = rows["id"].to_numpy()
            lengths = rows["near"].combine_chunks().value_lengths().to_numpy()
            of = np.repeat(np.repeat(np.arange(len(at) - 1), np.diff(at)), lengths)
            b, d = rows["near"].combine_chunks().flatten().to_numpy(), rows["d"].combine_chunks().flatten().to_numpy()
            order = np.lexsort((b, of))
            of, b, d = of[order], b[order], d[order]
            once = np.append(True, (of[1:] != of[:-1]) | (b[1:] != b[:-1])) if len(of) else np.zeros(0, bool)
            of, b, d = of[once], b[once], d[once]
            order = np.lexsort(((b * 0x9E3779B1 + ids[at[:-1]][of] * 0x85EBCA77) & 0x7FFFFFFF, d, of))
            of, b, d = of[order], b[order], d[order]
            first = _place(of) < k
            yield _lists(ids[at[:-1]], of[first], b[first], d[first])

    return by_group(found.select("id", "near", "d"), "id").mapInArrow(merge, _NEAR)


def _forest(points: DataFrame, sample: np.ndarray, n: int, trees: range, k: int, seed: int) -> DataFrame:
    """(id, near, d): what rows (id, grp, depth, limit, z) find in the leaves of some trees, nearer than their limits. A tree's regions hold about
    REGION_ROWS; larger ones, which only more regions than LEAVES or many copies leave, are dealt out by hash."""
    deepest = max(0, int(np.ceil(np.log2(max(1, min(LEAVES, n / REGION_ROWS))))))
    made = {t: ProjectionTree(sample, deepest, np.random.default_rng([seed, t])) for t in trees}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                z, depths = vectors(pa.chunked_array([b["z"]])), b["depth"].to_numpy()
                for t, tree in made.items():
                    yield pa.RecordBatch.from_arrays([b["id"], b["grp"], b["limit"], b["z"], pa.array(tree.of(z, depths) * MOST_TREES + t)], names=["id", "grp", "limit", "z", "leaf"])

    dealt = points.mapInArrow(deal, f"id long, grp long, limit double, z {dict(points.dtypes)['z']}, leaf long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in deal([b]):
                yield pa.RecordBatch.from_struct_array(pa.Table.from_batches([rows]).group_by(["grp", "leaf"]).aggregate([([], "count_all")]).rename_columns({"count_all": "n"}).to_struct_array().combine_chunks())

    large = points.mapInArrow(count, "grp long, leaf long, n long").groupBy("grp", "leaf").agg(F.ceil(F.sum("n") / (8 * REGION_ROWS)).alias("pieces")).filter("pieces > 1")
    dealt = dealt.join(F.broadcast(large), ["grp", "leaf"], "left").withColumn("piece", F.pmod(F.xxhash64("id", "leaf"), F.coalesce("pieces", F.lit(1))))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in whole_groups(batches, "grp", "leaf", "piece"):
            ids, limit, z, leaf = rows["id"].to_numpy(), rows["limit"].to_numpy(), vectors(rows["z"]), rows["leaf"].to_numpy()
            for i, j in zip(at, at[1:]):
                for rest in _leaves(z[i:j], np.random.default_rng([seed, int(leaf[i])])):
                    rest = rest + i
                    for c in range(0, len(rest), CHUNK):
                        some = rest[c:c + CHUNK]
                        a, b, d = _nearest_to(ids[some], z[some], limit[some], ids[rest], z[rest], k)
                        if len(a):
                            yield _lists(ids[some], a, b, d)

    # tasks of about two regions each: their work grows faster than their bytes
    parts = max(points.sparkSession.sparkContext.defaultParallelism, -(-n * len(trees) // (2 * REGION_ROWS)))
    whole = dealt.select("grp", "leaf", "piece", "id", "limit", "z").repartition(parts, "grp", "leaf", "piece").sortWithinPartitions("grp", "leaf", "piece", "id")
    return whole.mapInArrow(near, _NEAR)


def forest_neighbours(points: DataFrame, tables: Tables, k: int = 15, seed: int = 3, sure: float = SURE) -> DataFrame:
    """id, near, d: the ids and squared distances of about the k nearest of each row in its group, the nearest first; rows without any are left out.
    points: (id, grp, z), longs and vectors in double precision, ids once each. Trees are added until the share of the nearest that are found is `sure` for about SURE_ROWS
    rows; where MOST_TREES do not reach that, as when vectors have many dimensions and no structure, the descent does the work. The result is one of `tables`."""
    sizes = points.groupBy(F.col("grp").alias("of")).agg(F.count("*").alias("rows"))
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("rows") / REGION_ROWS))).cast("long")
    rows = points.join(sizes, F.col("grp") == F.col("of")).select("id", "grp", depth.alias("depth"), "z")
    n = points.count()
    drawn = lambda most, salt: F.pmod(F.xxhash64("id", F.lit(seed + salt)), F.lit(2**31)) < int(2**31 * min(1.0, most / max(1, n)))
    sample = points.filter(drawn(TREE_SAMPLE, 0)).select("z").limit(2 * TREE_SAMPLE).toArrow()
    x = vectors(sample["z"]) if len(sample) else np.zeros((0, 1))
    asked = points.filter(drawn(SURE_ROWS, 1)).limit(2 * SURE_ROWS).toArrow()
    of, ids, z = asked["grp"].to_numpy(), asked["id"].to_numpy(), vectors(asked["z"]) if len(asked) else np.zeros((0, 1))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, len(b), 4096):
                part = b.slice(start, 4096)
                grp, others, oz = part["grp"].to_numpy(), part["id"].to_numpy(), vectors(pa.chunked_array([part["z"]]))
                for g in np.intersect1d(grp, of):
                    mine, its = np.flatnonzero(of == g), grp == g
                    yield _lists(ids[mine], *_nearest_to(ids[mine], z[mine], np.full(len(mine), np.inf), others[its], oz[its], k))

    last = {r["id"]: np.array(r["d"]) for r in _merged(points.mapInArrow(compare, _NEAR), k).collect()} if len(ids) else {}
    graph, grown = None, 0
    while grown < MOST_TREES:
        trees = range(grown, min(MOST_TREES, grown + (MORE_TREES if grown else FIRST_TREES)))
        if graph is None:
            found = _forest(rows.withColumn("limit", F.lit(float("inf"))), x, n, trees, k, seed)
        else:
            limit = F.when(F.size("near") >= k, F.get("d", F.lit(k - 1)))
            known = rows.join(graph.select("id", limit.alias("limit")), "id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
            found = _forest(known, x, n, trees, k, seed).union(graph)
        older, grown = grown, trees.stop
        graph = tables.save(_merged(found, k), f"forest-{grown}")
        if older:
            tables.drop(f"forest-{older}")
        got = {r["id"]: np.array(r["d"]) for r in graph.filter(drawn(SURE_ROWS, 1)).select("id", "d").collect()}
        hits = sum(int((got[i] <= d[-1] * (1 + 1e-9)).sum()) for i, d in last.items() if i in got and len(d))
        if hits >= sure * sum(len(d) for d in last.values()):
            return graph
    named = approximate_neighbours(points.select(F.col("id").cast("string").alias("cell"), "grp", "z"), tables, k)
    pair = F.struct("place", F.col("neighbour").cast("long").alias("b"), (F.col("distance") * F.col("distance")).alias("d"))
    lists = named.groupBy(F.col("cell").cast("long").alias("id")).agg(F.array_sort(F.collect_list(pair)).alias("x"))
    return tables.save(lists.select("id", F.col("x.b").alias("near"), F.col("x.d").alias("d")), "forest-none")

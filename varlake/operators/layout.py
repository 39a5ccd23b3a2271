"""A layout of cells in the plane that keeps neighbours together.

Each cell's distances become weights: 1 up to its nearest neighbour, and then falling so that they sum to the logarithm of the number of neighbours;
the scale is found by bisection. A pair's weight is that either direction holds. From the principal plane on, epochs of forces follow: along edges
cells attract each other by their weight, and cells that are dealt into the same block by a hash of the epoch repel each other. An epoch is two
joins and two sums over edges and cells; positions are written after each one, and the same input gives the same layout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folder import Tables

# The curve 1 / (1 + A d^(2 B)) that fits a smallest distance of 0.5 and a spread of 1.
A, B = 0.583030, 1.334167
EPOCHS, NEGATIVES, GROUP, MOST = 60, 5, 256, 4.0


def smooth_weights(distances: np.ndarray, steps: int = 64) -> np.ndarray:
    """Rows of ascending distances to weights: exp(-(d - nearest) / scale), with the scale at which they sum to log2 of their number. NaN is no neighbour."""
    there = ~np.isnan(distances)
    n = there.sum(1)
    nearest = np.nanmin(np.where(distances > 0, distances, np.nan), axis=1, initial=np.inf)
    nearest = np.where(np.isfinite(nearest), nearest, 0.0)
    over = np.where(there, np.maximum(distances - nearest[:, None], 0), np.inf)
    low, high, target = np.zeros(len(n)), np.full(len(n), np.inf), np.log2(np.maximum(n, 1))
    scale = np.ones(len(n))
    for _ in range(steps):
        large = np.exp(-over / scale[:, None]).sum(1) > target
        high, low = np.where(large, scale, high), np.where(large, low, scale)
        scale = np.where(np.isinf(high), scale * 2, (low + high) / 2)
    mean = np.where(there, distances, 0).sum(1) / np.maximum(n, 1)
    scale = np.maximum(scale, 1e-3 * np.where(mean > 0, mean, 1.0))
    return np.where(there, np.exp(-over / scale[:, None]), np.nan)


def fuzzy_graph(neighbours: DataFrame) -> DataFrame:
    """cell, neighbour, weight, each pair once with cell < neighbour. neighbours: (cell, neighbour, distance), a bounded number for each cell."""
    lists = neighbours.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct(F.col("distance").cast("double").alias("distance"), "neighbour"))).alias("near"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b["d"].to_pylist()
            if rows:
                most = max(map(len, rows))
                weights = smooth_weights(np.array([r + [np.nan] * (most - len(r)) for r in rows]))
                yield pa.RecordBatch.from_arrays([b["cell"], b["neighbour"], pa.array([w[:len(r)] for w, r in zip(weights, rows)], pa.list_(pa.float64()))], names=["cell", "neighbour", "weight"])

    weighted = lists.select("cell", F.col("near.neighbour").alias("neighbour"), F.col("near.distance").alias("d")).mapInArrow(run, "cell string, neighbour array<string>, weight array<double>")
    one = weighted.select("cell", F.explode(F.arrays_zip("neighbour", "weight")).alias("p")).select("cell", F.col("p.neighbour").alias("neighbour"), F.col("p.weight").alias("w"))
    pairs = one.groupBy(F.least("cell", "neighbour").alias("cell"), F.greatest("cell", "neighbour").alias("neighbour"))
    either = F.when(F.count("*") > 1, F.min("w") + F.max("w") - F.min("w") * F.max("w")).otherwise(F.max("w"))
    return pairs.agg(either.alias("weight"))


def _clipped(x):
    return F.greatest(F.lit(-MOST), F.least(F.lit(MOST), x))


def layout(graph: DataFrame, start: DataFrame, tables: Tables, epochs: int = EPOCHS, rate: float = 1.0, negatives: int = NEGATIVES, seed: int = 11) -> DataFrame:
    """cell, x, y. graph: as fuzzy_graph() returns it; start: (cell, x, y). The result is one of `tables`; cells without edges are only repelled."""
    largest = start.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 1.0
    jitter = lambda k: F.pmod(F.xxhash64("cell", F.lit(k), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20) * 1e-3
    ids = tables.save(start.select(F.col("cell").cast("string").alias("cell"), (F.col("x") * 10 / largest + jitter(0)).alias("x"), (F.col("y") * 10 / largest + jitter(1)).alias("y")), "start")
    ids = tables.save(ids.withColumn("node", F.monotonically_increasing_id()), "ids")
    n, most = ids.count(), graph.agg(F.max("weight")).first()[0] or 1.0
    of = lambda side: ids.select(F.col("cell").alias(side), F.col("node").alias(side[0]))
    one = graph.join(of("cell"), "cell").join(of("neighbour"), "neighbour").select(F.col("c").alias("a"), F.col("n").alias("b"), (F.col("weight") / most).alias("w"))
    edges = tables.save(one.union(one.select("b", "a", "w")), "edges")
    strength = tables.save(ids.select("node").join(edges.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("s")), "node", "left").select("node", F.coalesce("s", F.lit(0.1)).alias("s")), "strength")
    now = ids.select("node", "x", "y")
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        ends = edges.join(now.select(F.col("node").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")), "a").join(now.select(F.col("node").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by")), "b")
        dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
        d2 = dx * dx + dy * dy
        pull = F.when(d2 > 0, -2 * A * B * F.pow(d2, B - 1) / (1 + A * F.pow(d2, F.lit(B)))).otherwise(0.0)
        pulled = ends.groupBy(F.col("a").alias("node")).agg(F.sum(_clipped(pull * dx) * F.col("w")).alias("px"), F.sum(_clipped(pull * dy) * F.col("w")).alias("py"))
        dealt = now.join(strength, "node").withColumn("block", F.pmod(F.xxhash64("node", F.lit(seed), F.lit(epoch)), F.lit(max(1, -(-n // GROUP)))))
        blocks = dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("node", F.lit(epoch), F.lit(seed + 1)).alias("by"), "node", "x", "y", "s"))).alias("all"))
        each = blocks.select("all", F.posexplode("all").alias("at", "own"))

        def pushed(axis: str):
            def one(k):
                other = F.element_at("all", ((F.col("at") + k) % F.size("all") + 1).cast("int"))
                dx, dy = F.col("own.x") - other["x"], F.col("own.y") - other["y"]
                d2 = dx * dx + dy * dy
                push = 2 * B / ((0.001 + d2) * (1 + A * F.pow(d2, F.lit(B))))
                away = F.pmod(F.xxhash64("own.node", F.lit(axis)), F.lit(2)) * 2 - 1  # of two in one place
                return F.when(other["node"] == F.col("own.node"), 0.0).when(d2 == 0, away * MOST).otherwise(_clipped(push * (dx if axis == "x" else dy)))

            return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(negatives)), one), F.lit(0.0), lambda s, v: s + v) * F.col("own.s")

        moved = each.select(F.col("own.node").alias("node"), F.col("own.x").alias("x"), F.col("own.y").alias("y"), pushed("x").alias("qx"), pushed("y").alias("qy")).join(pulled, "node", "left")
        to = lambda c: F.col(c) + step * _clipped(F.coalesce(F.col(f"p{c}"), F.lit(0.0)) + F.col(f"q{c}"))
        after = tables.save(moved.select("node", to("x").alias("x"), to("y").alias("y")), f"epoch-{epoch}")
        if epoch:
            tables.drop(f"epoch-{epoch - 1}")
        now = after
    return tables.save(now.join(ids.select("node", "cell"), "node").select("cell", "x", "y"), "layout")

"""Communities of a weighted graph by modularity, in three steps that repeat on ever smaller graphs.

Local moving: nodes go to the neighbouring community that gains most. Refinement: within each community, nodes start alone again and join a
neighbouring part of it where modularity gains, so that parts are connected. Contraction: parts become nodes, which begin in the community that
their members have reached. Each step is rounds over edges, written before the next. As all nodes of a round decide at once, half of
them, by hash, may move, and a round of moves counts only if modularity rises; a node that joins a part joins one that no node leaves in that round.

Defined results: edges are taken both ways, the larger weight of repeated ones; loops are left out; a community that is not connected in the end is
split, which never lowers modularity; clusters are numbered by size, then by their first cell; cells without edges have no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folder import Tables
from .blocks import numbered

LEVELS, MOVES, JOINS = 16, 24, 12
LEAST_GAIN = 1e-9
ROWS = 1 << 16  # edges of a task, about


def undirected(edges: DataFrame) -> DataFrame:
    """a, b, w in both directions. edges: (cell, neighbour) and, if there is one, weight."""
    w = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    one = edges.select(F.col("cell").cast("string").alias("a"), F.col("neighbour").cast("string").alias("b"), w.alias("w")).filter("a <> b and w > 0")
    return one.union(one.select("b", "a", "w")).groupBy("a", "b").agg(F.max("w").alias("w"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """edges: (a, b, w) in both directions; labels: (cell, cluster) of every node."""
    return _modularity(edges, edges.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).join(labels.select(F.col("cell").alias("node"), F.col("cluster").alias("c")), "node"), None, resolution)


def _modularity(edges: DataFrame, nodes: DataFrame, loops: DataFrame | None, resolution: float) -> float:
    of = nodes.select("node", "c")
    inside = edges.join(of.withColumnRenamed("node", "a"), "a").join(of.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b").filter("c = cb").agg(F.sum("w").alias("w"))
    totals = nodes.groupBy("c").agg(F.sum("k").alias("k")).agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("s"))
    own = totals.select(F.lit(0.0).alias("l")) if loops is None else loops.agg(F.coalesce(F.sum("l"), F.lit(0.0)).alias("l"))
    r = totals.crossJoin(inside).crossJoin(own).first()
    return 0.0 if not r["m"] else ((r["w"] or 0.0) + r["l"]) / r["m"] - resolution * r["s"] / r["m"] ** 2


def _moves(salt: int, turn: int):
    return F.pmod(F.xxhash64("node", F.lit(salt), F.lit(turn)), F.lit(2)) == 0


def _dealt(edges: DataFrame, rows: int) -> DataFrame:
    """edges, kept dealt by b and in its order while a level lasts, so that each round moves what it joins to them and not the edges."""
    held = edges.select("a", "b", "w").repartition(max(1, -(-rows // ROWS)), "b").sortWithinPartitions("b").persist()
    held.count()
    return held


def _around(edges: DataFrame, to: DataFrame) -> DataFrame:
    """node, to, w, to_total: the weight between each node and each community or part next to it. edges: dealt; to: (b, to, to_total). One shuffle,
    by node, serves this sum and what is done by node next."""
    near = edges.join(to, "b").select(F.col("a").alias("node"), "to", "to_total", "w").repartition("node")
    return near.groupBy("node", "to").agg(F.sum("w").alias("w"), F.first("to_total").alias("to_total"))


def _best(rows: DataFrame, *own: str, wanted, gain, **more) -> DataFrame:
    """own columns of each node and go: (gain, o, to) of the largest gain among the wanted, the smallest of equals."""
    go = F.max(F.when(wanted, F.struct(gain.alias("gain"), (-F.col("to")).alias("o"), "to"))).alias("go")
    return rows.groupBy("node").agg(*(F.first(c).alias(c) for c in own), go, *(c.alias(k) for k, c in more.items()))


def _round_of_moves(edges: DataFrame, nodes: DataFrame, whole: float, resolution: float, seed: int, turn: int) -> DataFrame:
    """node, k, c after a round; was, own and total: the community before it, a node's weight to that, and the strength of that."""
    state = nodes.join(nodes.groupBy("c").agg(F.sum("k").alias("total")), "c").select("node", "k", "c", "total")
    rows = state.join(_around(edges, state.select(F.col("node").alias("b"), F.col("c").alias("to"), F.col("total").alias("to_total"))), "node", "left")
    share, here = F.lit(resolution / whole) * F.col("k"), F.col("to") == F.col("c")
    # what a node loses where it is, and gains elsewhere; its own strength does not count against it
    each = _best(rows, "k", "c", "total", wanted=F.col("to") != F.col("c"), gain=F.col("w") - share * F.col("to_total"), own=F.coalesce(F.sum(F.when(here, F.col("w"))), F.lit(0.0)))
    stay = F.col("own") - share * (F.col("total") - F.col("k"))
    goes = _moves(seed, turn) & (F.col("go.gain") > stay + LEAST_GAIN)
    return each.select("node", "k", F.when(goes, F.col("go.to")).otherwise(F.col("c")).alias("c"), F.col("c").alias("was"), "own", "total")


def _local_moving(edges: DataFrame, nodes: DataFrame, loops: DataFrame, whole: float, resolution: float, tables: Tables, name: str, seed: int) -> DataFrame:
    """nodes (node, k, c) after rounds of moves. A round tells the modularity of what it starts from: so a round from the nodes that have moved
    decides on the move, too."""
    inside = loops.agg(F.coalesce(F.sum("l"), F.lit(0.0))).first()[0]
    best, misses, turn, passes, tried = None, 0, 0, 0, nodes
    while True:
        after = tables.save(_round_of_moves(edges, tried, whole, resolution, seed, turn), f"{name}-moved-{passes}")
        r = after.agg(F.sum("own").alias("w"), F.sum("k").alias("m"), F.sum(F.col("k") * F.col("total")).alias("s"), F.count_if(F.col("c") != F.col("was")).alias("moved")).first()
        passes, reached = passes + 1, (r["w"] + inside) / r["m"] - resolution * r["s"] / r["m"] ** 2
        if best is None or reached > best + LEAST_GAIN:
            nodes, best, misses = tried, reached, 0
        elif tried is not nodes:
            misses, tried = misses + 1, nodes
            if misses == 2 or turn == MOVES:
                return nodes
            continue  # the same turn, from where the nodes were
        turn += 1
        if turn > MOVES:
            return nodes
        if r["moved"]:
            tried = after.select("node", "k", "c")
        else:
            misses += 1
            if misses == 2 or turn == MOVES:
                return nodes


def _refined(edges: DataFrame, nodes: DataFrame, whole: float, resolution: float, tables: Tables, name: str, seed: int) -> DataFrame:
    """nodes (node, k, c) with part: connected parts of the communities. The name of a part is that of a node in it."""
    nodes, misses = nodes.withColumn("part", F.col("node")), 0
    inner = edges.join(nodes.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b").join(nodes.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").filter("ca = cb").select("a", "b", "w")
    inner = tables.save(inner, f"{name}-inner")
    held = _dealt(inner, inner.count())
    for turn in range(JOINS):
        parts = nodes.groupBy("part").agg(F.sum("k").alias("total"), F.count("*").alias("n"))
        state = nodes.join(parts, "part").withColumn("mover", (F.col("n") == 1) & _moves(seed + 1, turn)).select("node", "k", "c", "part", "total", "mover")
        # only parts that no node leaves in this round are joined
        to = state.filter(~F.col("mover")).select(F.col("node").alias("b"), F.col("part").alias("to"), F.col("total").alias("to_total"))
        gain = F.col("w") - F.lit(resolution / whole) * F.col("k") * F.col("to_total")
        each = _best(state.join(_around(held, to), "node", "left"), "k", "c", "part", wanted=F.col("mover") & (gain > LEAST_GAIN), gain=gain)
        after = tables.save(each.select("node", "k", "c", F.coalesce("go.to", "part").alias("part"), F.col("go").isNotNull().alias("joined")), f"{name}-parts-{turn}")
        misses = 0 if not after.filter("joined").isEmpty() else misses + 1
        nodes = after.drop("joined")
        if misses == 2:
            break
    held.unpersist()
    return nodes


def _components(edges: DataFrame, nodes: DataFrame, tables: Tables, name: str) -> DataFrame:
    """node, part: the smallest node that each one reaches over edges (a, b). Rounds of taking the neighbours' smallest label and of jumping to that
    label's own."""
    labels, turn = tables.save(nodes.select("node", F.col("node").alias("part")), f"{name}-0"), 0
    while True:
        turn += 1
        near = edges.join(labels.select(F.col("node").alias("b"), "part"), "b").groupBy(F.col("a").alias("node")).agg(F.min("part").alias("near"))
        lower = labels.join(near, "node", "left").select("node", F.col("part").alias("was"), F.least("part", F.coalesce("near", "part")).alias("part"))
        lower = tables.save(lower, f"{name}-{turn}-lower")
        jumped = lower.join(lower.select(F.col("node").alias("up"), F.col("part").alias("upper")), F.col("part") == F.col("up")).select("node", "was", F.col("upper").alias("part"))
        after = tables.save(jumped, f"{name}-{turn}")
        if after.filter("part <> was").isEmpty():
            return after.select("node", "part")
        labels = after.select("node", "part")


def communities(edges: DataFrame, tables: Tables, resolution: float = 0.4, levels: int = LEVELS, seed: int = 5) -> DataFrame:
    """cell, cluster. edges: (cell, neighbour) and, if there is one, weight. The result is one of `tables`."""
    named = tables.save(undirected(edges), "named-edges")
    names = tables.save(named.select(F.col("a").alias("cell")).distinct().withColumn("node", F.monotonically_increasing_id()), "names")
    ids = lambda side: names.select(F.col("cell").alias(side), F.col("node").alias(f"{side}_id"))
    first = tables.save(named.join(ids("a"), "a").join(ids("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "w"), "edges")
    whole = first.agg(F.sum("w")).first()[0]
    if not whole:
        return names.select("cell", F.lit(0).cast("long").alias("cluster"))
    graph = first
    nodes = tables.save(graph.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")).withColumn("c", F.col("node")), "nodes")
    loops = graph.limit(0).select(F.col("a").alias("node"), F.col("w").alias("l"))
    members = nodes.select(F.col("node").alias("cell_id"), "node", "c")
    for level in range(levels):
        name = f"level-{level}"
        graph = _dealt(graph, graph.count())
        nodes = _local_moving(graph, nodes, loops, whole, resolution, tables, name, seed + 10 * level)
        members = tables.save(members.select("cell_id", "node").join(nodes.select("node", "c"), "node"), f"{name}-members")
        parts = _refined(graph, nodes, whole, resolution, tables, name, seed + 10 * level)
        of = parts.select("node", "part")
        members = tables.save(members.join(of, "node").select("cell_id", F.col("part").alias("node"), "c"), f"{name}-parts")
        joined = graph.join(of.select(F.col("node").alias("b"), F.col("part").alias("pb")), "b").join(of.select(F.col("node").alias("a"), F.col("part").alias("pa")), "a").groupBy("pa", "pb").agg(F.sum("w").alias("w"))
        joined = tables.save(joined, f"{name}-contracted")
        graph.unpersist()
        inner = joined.filter("pa = pb").select(F.col("pa").alias("node"), F.col("w").alias("l"))
        loops = tables.save(inner.union(loops.join(of, "node").select(F.col("part").alias("node"), "l")).groupBy("node").agg(F.sum("l").alias("l")), f"{name}-loops")
        graph = joined.filter("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b"), "w")
        fewer = tables.save(parts.groupBy(F.col("part").alias("node")).agg(F.sum("k").alias("k"), F.first("c").alias("c")), f"{name}-nodes")
        if fewer.count() == parts.count():  # every part is one node, and no move helps
            break
        nodes = fewer
    placed = members.select(F.col("cell_id").alias("node"), "c")
    same = first.join(placed.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(placed.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b").filter("ca = cb").select("a", "b")
    whole_parts = _components(tables.save(same, "same"), placed, tables, "connected")
    labelled = tables.save(whole_parts.join(names, "node").select("cell", "part"), "labelled")
    sizes = labelled.groupBy("part").agg(F.count("*").alias("n"), F.min("cell").alias("first"))
    codes = numbered(sizes, [F.desc("n"), F.col("first")], "cluster", tables, "codes")
    return tables.save(labelled.join(codes.select("part", "cluster"), "part").select("cell", "cluster"), "clusters")

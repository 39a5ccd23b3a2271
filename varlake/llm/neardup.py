"""Near-duplicate groups: MinHash signatures joined by a multi-index over Hamming distance, confirmed on full sets.

A signature has 50 symbols of 8 bits in 10 chunks of 5. Two signatures that differ in at most 19 symbols have, by the
pigeonhole principle, a chunk with at most one error, so they agree on four symbols of that chunk: every chunk is
indexed under each of its five one-symbol deletions. At a similarity of 0.8 a pair fails to meet with a probability of
(1 - 0.737) ** 10 = 1.6e-6. Every pair that meets and whose signatures differ in at most 27 symbols is a candidate;
links are confirmed on the full shingle sets (64-bit hashes).

All pairs of a group are never made. Equal sets are one node. Within each index bucket all nodes are held against two
leaders; of these candidate pairs one per node is confirmed first, then those that lead out of a component. Near signatures
alone join nodes into families, by leaders and then, where a bucket still spans several, by its other pairs, each in the
first bucket that it shares. Within a family that is not one component yet, pairs of different components are candidates
if they also share one of their rarest shingles, which similar sets must: documents that have only a common passage do not.
Pairs inside a component are left out: they cannot change the result.

Defined results: null and empty texts and texts without words have no shingles and link with nothing; rows with an equal
doc_id are one node; rows with a null doc_id take the component of their text's other copies, else null; other columns
are ignored and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, table

WORDS, SIMILARITY = 5, 80  # shingle length; per cent
CHUNKS, WIDTH = 10, 5
SYMBOLS = CHUNKS * WIDTH
PARITIES = 512
FARTHEST = 27  # symbols in which candidates may differ; P(more | similarity 0.8) is about 1e-9
_RNG = np.random.default_rng(20240501)
_MUL = _RNG.integers(1, 2**63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
_SHIFT = (np.uint64(8) * np.arange(WIDTH, dtype=np.uint64))
_MEMO: dict[bytes, int] = {}
_MEMO_MOST = 500_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles: A-Z lower-cased, words between ASCII white space."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(_MEMO) > _MEMO_MOST:
        _MEMO.clear()
    hashes = np.empty(len(parts), np.uint64)
    for i, w in enumerate(parts):
        h = _MEMO.get(w)
        if h is None:
            h = _MEMO[w] = xxhash.xxh3_64_intdigest(w)
        hashes[i] = h
    k = min(words, len(parts))
    mixed = np.full(len(parts) - k + 1, k, np.uint64)
    for j in range(k):
        mixed = _mixed(mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[j:len(parts) - k + 1 + j])
    return np.unique(mixed)


def signature(shingles: np.ndarray) -> list[int]:
    """The low 8 bits of 50 minima, five to a long."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[at:at + 2048, None] * _MUL + _ADD).min(axis=0), out=least)
    symbols = (_mixed(least) & np.uint64(255)).reshape(CHUNKS, WIDTH)
    return (symbols << _SHIFT).sum(axis=1).astype(np.int64).tolist()


def parity(shingles: np.ndarray) -> list[int]:
    """For each of PARITIES groups of hashes, whether the set has an odd number of them. Two sets differ in at least as
    many shingles as their parities do in bits."""
    odd = np.bincount((shingles >> np.uint64(32)).astype(np.int64) % PARITIES, minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _described(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"],
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([signature(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
            ], names=["doc_id", "n_shingles", "set_key", "sig"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"],
                pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                pa.array([parity(s) for s in sets], pa.list_(pa.int64())),
            ], names=["node", "shingles", "parity"])

    return run


def _errors(a: Column, b: Column, chunk: int) -> Column:
    """Symbols of a chunk in which two signatures differ."""
    x = a[chunk].bitwiseXOR(b[chunk])
    for s in (4, 2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, s))
    return F.bit_count(x.bitwiseAND(F.lit(0x0101010101)))


def distance(a: Column, b: Column) -> Column:
    """Symbols in which two signatures differ."""
    return sum((_errors(a, b, c) for c in range(1, CHUNKS)), _errors(a, b, 0))


def _meets_here(key: Column, a: Column, b: Column) -> Column:
    """Whether this bucket is the first that two signatures share, so that a pair comes once from all its buckets: the
    first chunk with at most one error, and there, of chunks without any, the first deletion."""
    slot = F.shiftright(key, 40)
    first = F.coalesce(*(F.when(_errors(a, b, c) <= 1, F.lit(c)) for c in range(CHUNKS)))
    exact = F.element_at(a, (first + 1).cast("int")) == F.element_at(b, (first + 1).cast("int"))
    return (F.floor(slot / WIDTH) == first) & (~exact | (slot % WIDTH == 0))


def _index(nodes: DataFrame) -> DataFrame:
    """node, key: each chunk with each of its symbols left out."""
    keys = [
        F.col("sig")[c].bitwiseAND(F.lit(((1 << 40) - 1) & ~(255 << (8 * d)))).bitwiseOR(F.lit((c * WIDTH + d) << 40))
        for c in range(CHUNKS) for d in range(WIDTH)
    ]
    return nodes.select("node", F.explode(F.array(*keys)).alias("key"))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, comp: the smallest node that each node of the edges (a, b) reaches. Rounds of taking the neighbours'
    smallest label and of jumping to that label's own label, each written before the next."""
    both = scratch.save(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), f"{name}-0")
    done, turn = False, 0
    while not done:
        turn += 1
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        lower = scratch.save(lower, f"{name}-{turn}l")
        up = lower.select(F.col("node").alias("up"), F.col("comp").alias("upper"))
        after = lower.join(up, lower["comp"] == up["up"]).select("node", "was", F.col("upper").alias("comp"))
        after = scratch.save(after, f"{name}-{turn}")
        done = after.filter("comp <> was").isEmpty()
        scratch.drop(f"{name}-{turn - 1}", f"{name}-{turn}l")
        labels = after.select("node", "comp")
    scratch.drop(f"{name}-edges")
    return labels


def merged(comps: DataFrame, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """comps (node, comp) with the edges (a, b) added: only edges between components are followed, once each."""
    at = lambda n: comps.select(F.col("node").alias(n), F.col("comp").alias(f"c{n}"))
    between = edges.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    between = scratch.save(between.filter("a <> b").distinct(), f"{name}-between")
    if between.isEmpty():
        return comps
    up = components(between, scratch, f"{name}-up").select(F.col("node").alias("was"), F.col("comp").alias("now"))
    alone = up.join(comps.select("comp").distinct(), up["was"] == F.col("comp"), "left_anti").select(F.col("was").alias("node"), F.col("was").alias("comp"))
    every = comps.select("node", "comp").union(alone)
    return scratch.save(every.join(up, every["comp"] == up["was"], "left").select("node", F.coalesce("now", "comp").alias("comp")), f"{name}-merged")


def _sets_of(ids: DataFrame, docs: DataFrame, words: int, scratch: Scratch, name: str) -> DataFrame:
    """node, shingles, parity of the ids (doc_id)."""
    sets = docs.join(ids, "doc_id", "left_semi").mapInArrow(_sets(words), "node long, shingles array<long>, parity array<long>")
    return scratch.save(sets, name)


def _similar(a: Column, b: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both * 100 >= (F.size(a) + F.size(b) - both) * percent


def _linked(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose full sets (node, shingles) are similar enough."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return scratch.save(pairs.join(a, "a").join(b, "b").filter(_similar(F.col("sa"), F.col("sb"), percent)).select("a", "b"), f"{name}-links")


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose full sets, made of the texts, are similar enough."""
    ids = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{name}-ids")
    links = _linked(pairs, _sets_of(ids, docs, words, scratch, f"{name}-sets"), percent, scratch, name)
    scratch.drop(f"{name}-ids", f"{name}-sets")
    return links


def _rare_shingles(kin: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """family, node, shingle, place, leading: of each node the shingles that come first when those of its family are put
    in order of how many nodes have them, without those that no other node has. Two similar sets share one among the
    first (100 - percent) per cent of the larger set, and of the smaller one even among the `leading` first."""
    every = kin.select("family", "node", "n_shingles").join(sets, "node").select("family", "node", "n_shingles", F.explode("shingles").alias("shingle"))
    held = every.groupBy("family", "shingle").agg(F.count("*").alias("holders")).filter("holders > 1")
    shared = every.join(held, ["family", "shingle"])
    # alone: shingles of the node's own, which come before all of these
    own = Window.partitionBy("node")
    alone = F.col("n_shingles") - F.count("*").over(own)
    placed = shared.withColumn("place", alone + F.row_number().over(own.orderBy("holders", "shingle")))
    part = lambda of, to: F.col("n_shingles") + 1 - F.ceil(F.col("n_shingles") * of / to)
    first = placed.withColumn("leading", part(2 * percent, 100 + percent)).filter(F.col("place") <= part(percent, 100))
    return first.select("family", "node", "shingle", "place", "leading")


def _may_link(percent: int) -> Column:
    """Whether two nodes a and b with a shingle in common may be similar, a the smaller one. No similar pair fails at the
    first shingle that it shares: what follows it must suffice for the overlap, and few enough parities differ."""
    na, nb = F.col("n_shingles_a"), F.col("n_shingles_b")
    smaller = (na < nb) | ((na == nb) & (F.col("node_a") < F.col("node_b")))
    follow = F.least(na - F.col("place_a"), nb - F.col("place_b")) + 1
    differ = sum((F.bit_count(F.col("parity_a")[i].bitwiseXOR(F.col("parity_b")[i])) for i in range(PARITIES // 64)), F.lit(0))
    return smaller & (follow * (100 + percent) >= (na + nb) * percent) & (differ * (100 + percent) <= (na + nb) * (100 - percent))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "neardup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = scratch.save(docs.mapInArrow(_described(words), "doc_id long, n_shingles long, set_key binary, sig array<long>"), "base")
    classes = scratch.save(base.filter("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("node")), "classes")
    members = scratch.save(base.join(classes, "set_key", "left").select("doc_id", "n_shingles", "node", "sig"), "members")
    scratch.drop("base", "classes")
    nodes = scratch.save(members.filter("doc_id = node").select("node", "n_shingles", "sig").dropDuplicates(["node", "sig"]), "nodes")

    flip = 0x2F0B4C47A3D1
    keys = _index(nodes)
    led = keys.groupBy("key").agg(F.min("node").alias("lead"), F.min(F.col("node").bitwiseXOR(F.lit(flip))).bitwiseXOR(F.lit(flip)).alias("lead2"), F.count("*").alias("n"))
    led = scratch.save(led.filter("n > 1").drop("n"), "led")
    hits = scratch.save(keys.join(led, "key").select("key", "node", "lead", "lead2"), "hits")
    scratch.drop("led")
    pairs = hits.select("node", F.explode(F.array("lead", "lead2")).alias("other")).filter("node <> other")
    pairs = pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    left = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("ga"))
    right = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("gb"))
    near = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (distance(F.col("ga"), F.col("gb")) <= FARTHEST)
    pairs = scratch.save(pairs.join(left, "a").join(right, "b").filter(near).select("a", "b"), "pairs")
    # one link for each node at first: within a group it settles most of what the other pairs would say again
    first = scratch.save(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "firsts")
    comps = components(_confirmed(first, docs, words, percent, scratch, "first"), scratch, "comps")
    at = lambda n: comps.select(F.col("node").alias(n), F.col("comp").alias(f"c{n}"))
    rest = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    rest = scratch.save(rest.join(first, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        comps = merged(comps, _confirmed(rest, docs, words, percent, scratch, "rest"), scratch, "rest")

    families = merged(components(first, scratch, "families"), pairs, scratch, "pairs")
    placed = hits.join(families, "node", "left").select("key", "node", "lead", "lead2", F.coalesce("comp", "node").alias("family"))
    placed = scratch.save(placed, "placed")
    mixed = scratch.save(placed.groupBy("key").agg(F.min("family").alias("low"), F.max("family").alias("high")).filter("low < high").select("key", "low"), "mixed")
    open_ = scratch.save(placed.filter("node <> lead and node <> lead2").join(mixed, "key").select("key", "node", "family", "low").join(nodes, "node"), "open")
    side = lambda n: [F.col("node").alias(n), F.col("n_shingles").alias(f"n{n}"), F.col("sig").alias(f"g{n}")]
    a = open_.filter("family <> low").select("key", F.col("family").alias("fa"), *side("a"))
    b = open_.select("key", F.col("family").alias("fb"), *side("b"))
    across = a.join(b, (a["key"] == b["key"]) & (F.col("fa") != F.col("fb")) & near & _meets_here(a["key"], F.col("ga"), F.col("gb")))
    families = merged(families, scratch.save(across.select("a", "b"), "across"), scratch, "across")
    scratch.drop("hits", "placed", "mixed", "open")

    kin = families.select("node", F.col("comp").alias("family")).join(comps, "node", "left").select("node", "family", F.coalesce("comp", "node").alias("comp"))
    kin = scratch.save(kin, "kin")
    # settled are families of one component, and small ones of which every pair has been held against each other
    split = kin.groupBy("family").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).filter("low < high")
    held = pairs.join(kin.select(F.col("node").alias("a"), "family"), "a").groupBy("family").agg(F.count("*").alias("held"))
    split = split.join(held, "family", "left").filter("n * (n - 1) > 2 * coalesce(held, 0)").select("family")
    kin = scratch.save(kin.join(scratch.save(split, "split"), "family").join(nodes, "node"), "unsettled")
    if not kin.isEmpty():
        sets = _sets_of(kin.select(F.col("node").alias("doc_id")), docs, words, scratch, "kin-sets")
        rare = scratch.save(_rare_shingles(kin, sets, percent), "rare").join(kin.select("node", "comp", "n_shingles"), "node").join(sets.select("node", "parity"), "node")
        mine = lambda n: [F.col(c).alias(f"{c}_{n}") for c in ("node", "comp", "n_shingles", "place", "parity")]
        a = rare.filter("place <= leading").select("family", "shingle", *mine("a"))
        b = rare.select(F.col("family").alias("fb"), F.col("shingle").alias("tb"), *mine("b"))
        met = (F.col("family") == F.col("fb")) & (F.col("shingle") == F.col("tb")) & (F.col("comp_a") != F.col("comp_b"))
        late = a.join(b, met & _may_link(percent)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
        comps = merged(comps, _linked(scratch.save(late, "late"), sets, percent, scratch, "late"), scratch, "late")
    out = members.join(comps, "node", "left").select("doc_id", "n_shingles", F.coalesce("comp", "node", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def neardup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)

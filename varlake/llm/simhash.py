"""Near duplicates by SimHash: a binary trie over the fingerprints is joined with itself.

A fingerprint has a bit set if more than half of the hashes of the text's shingles have it. Distinct fingerprints are the
leaves of a binary trie. The join goes down the trie with pairs of nodes: a node with itself gives its two children with
themselves and with each other, two nodes give their four pairs of children, and every pair carries the number of bits in which the
paths have differed; beyond the error budget it is dropped. Small pairs of subtries are compared leaf by leaf. A subtrie is a
range of sorted fingerprints, so that a whole level of node pairs descends in a few array operations; wide levels are
taken in parts.

To deal the join out, there are four tries, each with another quarter of the bits on top. Fingerprints that differ in at most three
bits agree in one of the quarters, so they meet below a node 16 levels down; a pair counts in the first trie where it does.
A unit of work is such a node, paired with itself. Units of more than UNIT_ROWS fingerprints go down eight levels at a time in Spark:
their children are counted, pairs of children within the budget become units, and each fingerprint goes to the units of its
child. Copies do not count: there is one leaf for each fingerprint, and among n of them at most n times a power of log n
pairs can be within three bits. Even those are not emitted: a task returns a forest with the same components as its pairs.

Defined results: null and empty texts and texts without words have the fingerprint zero and link like others; fewer words
than a shingle has are one shingle; rows belong together by their texts' fingerprints, so that one id with two texts does not link
them; the component of rows without any id is null; repeated rows are repeated; an empty table gives no rows; other
columns are ignored and may have any names. Texts are whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .neardup import components
from .shared import Scratch, table

WORDS, ERRORS, SEED = 3, 3, 42
BITS, QUARTERS = 64, 4
TOP = BITS // QUARTERS  # levels above the units' first nodes
STEP = 8  # levels that a large unit goes down at a time
UNIT_ROWS = 1 << 20
CHUNK_ROWS = 1 << 17  # units are taken together until they have so many rows
FRONTIER, LEAF_PAIRS = 1 << 16, 32
HASHES = 1 << 16  # hashes whose bits are counted at a time


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Of the shingles of `words` words, A-Z lower-cased, words between ASCII white space, joined by a space."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    whole, k = b" ".join(parts), min(words, len(parts))
    ends = [*accumulate(len(w) + 1 for w in parts)]
    spans = [*zip([0, *ends], ends[k - 1:])]
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(spans), HASHES):
        hashes = np.array([xxhash.xxh64_intdigest(whole[a:b - 1], SEED) for a, b in spans[at:at + HASHES]], np.uint64)
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(spans), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id long, fp long (the fingerprint's bits) for every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps.view(np.int64), pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _cut(s: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each sorted range [lo, hi), the first place whose value is not below `at`."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        below = open_ & (s[np.minimum(mid, len(s) - 1)] < at)
        lo = np.where(below, mid + 1, lo)
        hi = np.where(open_ & ~below, mid, hi)
    return lo


def node_pairs(s: np.ndarray, pairs: np.ndarray, errors: int = ERRORS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j): places in s of values that differ in at most `errors` bits, once each. pairs has a column for each pair of nodes to go down
    from: its ranges a_lo, a_hi, b_lo, b_hi, its depth and the bits that differ so far. A node is paired with itself if the ranges are
    the same."""
    stack = [pairs]
    while stack:
        pairs = stack.pop()
        if pairs.shape[1] > FRONTIER:
            stack += np.array_split(pairs, -(-pairs.shape[1] // FRONTIER), axis=1)
            continue
        n_a, n_b = pairs[1] - pairs[0], pairs[3] - pairs[2]
        small = n_a * n_b <= LEAF_PAIRS
        a_lo, _, b_lo, *_ = pairs[:, small]
        n, wide = (n_a * n_b)[small], n_b[small]
        of = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(of)) - (np.cumsum(n) - n)[of]
        i, j = a_lo[of] + place // wide[of], b_lo[of] + place % wide[of]
        near = ((a_lo != b_lo)[of] | (i < j)) & (np.bitwise_count(s[i] ^ s[j]) <= errors)
        yield i[near], j[near]
        a_lo, a_hi, b_lo, b_hi, depth, differ = pairs = pairs[:, ~small]
        if not pairs.shape[1]:
            continue
        shift = (BITS - 1 - depth).astype(np.uint64)
        a_mid, b_mid = (_cut(s, lo, hi, ((s[lo] >> shift) | np.uint64(1)) << shift) for lo, hi in ((a_lo, a_hi), (b_lo, b_hi)))
        other = a_lo != b_lo
        below = [
            np.stack([a_lo, a_mid, b_lo, b_mid, depth + 1, differ]),
            np.stack([a_mid, a_hi, b_mid, b_hi, depth + 1, differ]),
            np.stack([a_lo, a_mid, b_mid, b_hi, depth + 1, differ + 1]),
            np.stack([a_mid, a_hi, b_lo, b_mid, depth + 1, differ + 1])[:, other],
        ]
        below = np.concatenate(below, axis=1)
        stack.append(below[:, (below[5] <= errors) & (below[0] < below[1]) & (below[2] < below[3])])


def forest(n: int, edges: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n places the smallest that edges connect it with."""
    label = np.arange(n)
    for a, b in edges:
        while len(a):
            a, b = label[a], label[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := label[label], label):
                label = up
    return label


def _unit_pairs(starts: np.ndarray, side: np.ndarray, depth: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """A pair of nodes for each unit that begins at starts (which ends with the number of rows): itself, or its two sides."""
    lo, hi = starts[:-1], starts[1:]
    second = np.concatenate([[0], np.cumsum(side)])
    n_b = second[hi] - second[lo]
    crossed = n_b > 0
    return np.stack([lo, hi - n_b, np.where(crossed, hi - n_b, lo), hi, depth[lo], differ[lo]])


def _joined(errors: int):
    def links(rows: pa.Table) -> pa.RecordBatch:
        unit, side, turn, fp = (rows[c].to_numpy() for c in ("unit", "side", "turn", "fp"))
        path = rows["path"].combine_chunks().dictionary_encode()
        codes = (path.chunk(0) if isinstance(path, pa.ChunkedArray) else path).indices.to_numpy()
        new = np.flatnonzero((unit[1:] != unit[:-1]) | (codes[1:] != codes[:-1])) + 1
        s = fp.view(np.uint64)
        pairs = _unit_pairs(np.concatenate([[0], new, [len(s)]]), side, rows["depth"].to_numpy().astype(np.int64), rows["differ"].to_numpy().astype(np.int64))

        def first_met() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Pairs that no earlier trie has: what led there is at the end of the turned values."""
            for i, j in node_pairs(s, pairs, errors):
                x, own = s[i] ^ s[j], turn[i]
                met = np.zeros(len(x), bool)
                for q in range(QUARTERS - 1):
                    met |= (q < own) & ((x >> np.uint64(TOP * q)) & np.uint64((1 << TOP) - 1) == 0)
                yield i[~met], j[~met]

        label = forest(len(s), first_met())
        linked = np.flatnonzero(label != np.arange(len(s)))
        by = (turn.astype(np.uint64) * np.uint64(TOP))
        back = (s >> by) | np.where(by > 0, s << ((np.uint64(BITS) - by) % np.uint64(BITS)), np.uint64(0))
        return pa.RecordBatch.from_arrays([pa.array(back[linked].view(np.int64)), pa.array(back[label[linked]].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            count += len(batch)
            if count < CHUNK_ROWS:
                continue
            rows = pa.Table.from_batches(held)
            same = pc.and_(pc.equal(rows["unit"], rows["unit"][-1]), pc.equal(rows["path"], rows["path"][-1]))
            whole = same.index(True).as_py()  # where the last unit, which may go on, begins
            if whole:
                yield links(rows.slice(0, whole))
            held = rows.slice(whole).combine_chunks().to_batches()
            count = len(rows) - whole
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def _first_units(nodes: DataFrame) -> DataFrame:
    """unit, path, side, turn, depth, differ, fp: each fingerprint (fp) in four tries, turned left by as many quarters."""
    turned = lambda r: F.shiftleft("fp", TOP * r).bitwiseOR(F.shiftrightunsigned("fp", BITS - TOP * r)) if r else F.col("fp")
    four = nodes.select(F.explode(F.array(*(F.struct(F.lit(r).alias("turn"), turned(r).alias("fp")) for r in range(QUARTERS)))).alias("x")).select("x.*")
    unit = F.shiftrightunsigned("fp", BITS - TOP) + F.col("turn") * (1 << TOP)
    return four.select(unit.alias("unit"), F.lit("").alias("path"), F.lit(0).alias("side"), "turn", F.lit(TOP).alias("depth"), F.lit(0).alias("differ"), "fp")


def _descended(rows: DataFrame, errors: int) -> DataFrame:
    """The rows of units, STEP levels down: pairs of children within the budget are units, each row goes to those of its child."""
    child = F.expr(f"shiftrightunsigned(fp, {BITS - STEP} - depth)").bitwiseAND((1 << STEP) - 1).cast("int")
    rows = rows.withColumn("child", child)
    kids = rows.groupBy("unit", "path", "side", "depth", "differ", "child").agg(F.count("*").alias("n"))
    crossed = kids.groupBy("unit", "path").agg(F.max("side").alias("crossed"))
    kids = kids.join(crossed, ["unit", "path"])
    a = kids.filter("side = 0").select("unit", "path", "crossed", "depth", "differ", F.col("child").alias("a"))
    b = kids.filter("side = crossed").select("unit", "path", F.col("child").alias("b"))
    differ = F.col("differ") + F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = a.join(b, ["unit", "path"]).filter(((F.col("crossed") == 1) | (F.col("a") <= F.col("b"))) & (differ <= errors))
    pairs = pairs.withColumn("differ", differ.cast("int")).withColumn("to", F.concat("path", F.lit("/"), F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string")))
    # a child paired with itself in a unit of one node stays one side
    own = (F.col("crossed") == 0) & (F.col("a") == F.col("b"))
    ends = pairs.select("unit", "path", "to", (F.col("depth") + STEP).alias("depth"), "differ", F.explode(F.when(own, F.array(
        F.struct(F.lit(0).alias("side"), F.lit(0).alias("new"), F.col("a").alias("child")))).otherwise(F.array(
        F.struct(F.lit(0).alias("side"), F.lit(0).alias("new"), F.col("a").alias("child")),
        F.struct(F.col("crossed").alias("side"), F.lit(1).alias("new"), F.col("b").alias("child"))))).alias("x"))
    ends = ends.select("unit", "path", "to", "depth", "differ", "x.*")
    went = rows.select("unit", "path", "side", "child", "turn", "fp").join(ends, ["unit", "path", "side", "child"])
    return went.select("unit", F.col("to").alias("path"), F.col("new").alias("side"), "turn", "depth", "differ", "fp")


def links(nodes: DataFrame, scratch: Scratch, errors: int = ERRORS, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """(a, b): a forest over the fingerprints of nodes (fp, distinct), with the components of all pairs that differ in at most
    `errors` bits; errors is less than QUARTERS."""
    assert 0 <= errors < QUARTERS
    rows = scratch.save(_first_units(nodes), "units-0")
    done, turn = [], 0
    while True:
        large = rows.groupBy("unit", "path").agg(F.count("*").alias("n"), F.max("depth").alias("d")).filter((F.col("n") > unit_rows) & (F.col("d") + STEP <= BITS))
        large = scratch.save(large.select("unit", "path"), f"large-{turn}")
        if large.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(large, ["unit", "path"], "left_anti"))
        turn += 1
        rows = scratch.save(_descended(rows.join(large, ["unit", "path"], "left_semi"), errors), f"units-{turn}")
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    found = every.repartition("unit", "path").sortWithinPartitions("unit", "path", "side", "fp").mapInArrow(_joined(errors), "a long, b long")
    return scratch.save(found, "links")


def simhash_groups(docs: DataFrame, words: int = WORDS, errors: int = ERRORS, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for every row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(fingerprints(docs, words), "fingerprints")
    nodes = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    comps = components(links(nodes.select("fp"), scratch, errors, unit_rows), scratch, "comps")
    placed = nodes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("comp", "fp").alias("comp"))
    placed = scratch.save(placed, "placed")
    least = placed.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = scratch.save(placed.join(least, "comp").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))

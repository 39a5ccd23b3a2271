"""SimHash groups against all pairs of fingerprints."""

import itertools
import random

import numpy as np
import pytest
import xxhash
from varlake.llm import simhash
from varlake.llm.shared import Scratch


def plain_fingerprint(text, k=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: 32 for c in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def roots(fps, errors=3):
    """fp: the smallest fp that it reaches."""
    comp = {f: f for f in fps}

    def root(f):
        while comp[f] != f:
            f = comp[f]
        return f

    for a, b in itertools.combinations(sorted(comp), 2):
        if (a ^ b).bit_count() <= errors:
            x, y = sorted((root(a), root(b)))
            comp[y] = x
    return {f: root(f) for f in comp}


def brute(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    of = roots(fps)
    least = {}
    for (doc, _), f in zip(rows, fps):
        if doc is not None:
            least[of[f]] = min(least.get(of[f], doc), doc)
    return sorted(((d, f"{f:016x}", least.get(of[f])) for (d, _), f in zip(rows, fps)), key=repr)


def near_copies(rng, n):
    words = [f"w{i}" for i in range(2000)]
    base = [rng.choice(words) for _ in range(300)]
    for _ in range(n):
        copy = base[:]
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        yield " ".join(copy)


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n\x0b", "one", "ONE", "a b", "A  B", "a b c", "a b c a b c a b c", "Ä   x", "same text here now", "Same\ttext here\nnow"]
    for _ in range(6):
        texts += near_copies(rng, 25)
    texts += ["long " * 30_000 + "tail", "long " * 30_001 + "tail"]
    rows = [*enumerate(texts), (None, "one"), (None, "nothing like it anywhere"), (3, "another text of the same id"), (3, "one")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, component_id int")
    assert sorted((tuple(r) for r in simhash.simhash_groups(docs).collect()), key=repr) == brute(rows)


def test_whole_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in simhash.simhash_query(spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert got == brute(rows)


def test_empty_table(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def planted(rng, n):
    """Random fingerprints, dense groups around some, and the extremes."""
    fps = {0, 2**64 - 1, 1, 2**63, 2**63 + 7}
    while len(fps) < n:
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(rng.choice([0, 0, 3, 60])):
            g = f
            for _ in range(rng.randrange(1, 7)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
    return sorted(fps)


@pytest.mark.parametrize("unit_rows", [1 << 20, 40, 3])
def test_links_at_every_size_of_units(spark, unit_rows):
    """Large units that go down in Spark give the same components."""
    fps = planted(random.Random(unit_rows), 900)
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    found = simhash.links(nodes, Scratch(spark, "test"), unit_rows=unit_rows).collect()
    pairs = [(r["a"] % 2**64, r["b"] % 2**64) for r in found]
    assert all((a ^ b).bit_count() <= 60 for a, b in pairs)
    comp = {f: f for f in fps}

    def root(f):
        while comp[f] != f:
            f = comp[f]
        return f

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        comp[y] = x
    assert {f: root(f) for f in fps} == roots(fps)


@pytest.mark.parametrize("errors", [0, 1, 3, 5])
def test_trie_join_finds_each_pair_once(errors):
    fps = planted(random.Random(errors), 1500)
    s = np.array(fps, np.uint64)
    found = [(int(i), int(j)) for a, b in simhash.node_pairs(s, np.array([[0], [len(s)], [0], [len(s)], [0], [0]]), errors) for i, j in zip(a, b)]
    assert len(found) == len(set(found))
    x = s[:, None] ^ s[None, :]
    want = {(i, j) for i, j in zip(*np.nonzero(np.bitwise_count(x) <= errors)) if i < j}
    assert set(found) == want


def test_wide_levels_are_taken_in_parts(monkeypatch):
    s = np.array(planted(random.Random(9), 800), np.uint64)
    start = np.array([[0], [len(s)], [0], [len(s)], [0], [0]])
    whole = {(int(i), int(j)) for a, b in simhash.node_pairs(s, start) for i, j in zip(a, b)}
    monkeypatch.setattr(simhash, "FRONTIER", 7)
    assert {(int(i), int(j)) for a, b in simhash.node_pairs(s, start) for i, j in zip(a, b)} == whole


def test_dense_group_emits_a_forest(spark):
    """All 2^10 fingerprints of ten free bits: far more pairs than rows come back."""
    free = [1, 7, 13, 22, 30, 31, 40, 47, 55, 63]
    fps = [sum(1 << b for k, b in enumerate(free) if i >> k & 1) for i in range(1024)]
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    for unit_rows in (1 << 20, 100):
        found = simhash.links(nodes, Scratch(spark, "dense"), unit_rows=unit_rows)
        pairs = [(r["a"] % 2**64, r["b"] % 2**64) for r in found.collect()]
        comp = {f: f for f in fps}

        def root(f):
            while comp[f] != f:
                f = comp[f]
            return f

        for a, b in pairs:
            x, y = sorted((root(a), root(b)))
            comp[y] = x
        assert {root(f) for f in fps} == {0}
    assert len(pairs) <= 4 * 1024 * 20

"""Near duplicates against all pairs of exact sets."""

import itertools
import random

import pytest

from varlake.llm import neardup


def brute(rows, k):
    sets = {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        sets[doc] = {tuple(words)} if 0 < len(words) < k else {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}
    comp = {d: d for d in sets}

    def root(d):
        while comp[d] != d:
            d = comp[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return sorted((d, len(sets[d]), root(d), root(d) == d) for d in ids)


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows, n = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "two words"), (6, "Two words"), (7, "two WORDS")], 8
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([6, 30, 200]))]
        for _ in range(rng.choice([1, 1, 3, 20])):
            copy = base[:]
            for _ in range(rng.randrange(0, max(1, len(base) // 14))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    rows.append((n, "long " * 30000 + "tail"))
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_components_equal_brute_force(spark, k):
    rows = corpus(k)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, key int")
    got = sorted(tuple(r) for r in neardup.near_duplicates(docs, words=k).collect())
    assert got == brute(rows, k)


def test_common_passages(spark):
    """Documents that share three quarters of their words are no links by that; copies among them are."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    common, rows = [rng.choice(words) for _ in range(90)], []
    for _ in range(40):
        text = common + [rng.choice(words) for _ in range(rng.randrange(10, 30))]
        for _ in range(rng.choice([1, 1, 1, 2, 4])):
            copy = text[:]
            for _ in range(rng.randrange(0, 7)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in neardup.near_duplicates(docs, words=2).collect()) == brute(rows, 2)


def test_similar_sets_share_a_rare_shingle(spark):
    rng = random.Random(5)
    base = rng.sample(range(10**6), 60)
    sets = {}
    for node in range(60):
        own = set(rng.sample(base, rng.randrange(40, 61))) if node % 2 else set(base)
        sets[node] = own | set(rng.sample(range(10**6), rng.randrange(0, 12)))
    kin = spark.createDataFrame([(1, n, len(s)) for n, s in sets.items()], "family long, node long, n_shingles long")
    rows = neardup._rare_shingles(kin, spark.createDataFrame([(n, sorted(s)) for n, s in sets.items()], "node long, shingles array<long>"), 80).collect()
    leading = {n: {r["shingle"] for r in rows if r["node"] == n and r["place"] <= r["leading"]} for n in sets}
    first = {n: {r["shingle"] for r in rows if r["node"] == n} for n in sets}
    similar = [(a, b) for a in sets for b in sets if (len(sets[a]), a) < (len(sets[b]), b) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert similar and all(leading[a] & first[b] for a, b in similar)
    for a, b in itertools.combinations(sets, 2):
        x, y = (neardup.parity(neardup.np.array(sorted(sets[n]), neardup.np.uint64) << neardup.np.uint64(32)) for n in (a, b))
        assert sum((i ^ j).bit_count() if (i ^ j) >= 0 else ((i ^ j) + 2**64).bit_count() for i, j in zip(x, y)) <= len(sets[a] ^ sets[b])


def test_whole_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in neardup.neardup_query(spark, "/root/testdata/sf0.001").collect())
    assert got == brute(rows, 2)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (None, "z"), (9, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in neardup.near_duplicates(odd, words=2).collect()), key=repr)
    assert got == sorted([(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (None, 1, None, True), (9, 0, 9, True)], key=repr)


def test_index_guarantee():
    """Signatures within the radius share a key."""
    rng = random.Random(0)
    radius = 2 * neardup.CHUNKS - 1
    keys = lambda s: {(c, d, tuple(x for i, x in enumerate(s[c * 5:c * 5 + 5]) if i != d)) for c in range(10) for d in range(5)}
    for _ in range(300):
        a = [rng.randrange(256) for _ in range(neardup.SYMBOLS)]
        b = a[:]
        for i in rng.sample(range(neardup.SYMBOLS), radius):
            b[i] ^= 1
        assert keys(a) & keys(b)

"""Vantage-point trees, mixing, sharding, winnowing, and the pipeline."""

import hashlib
import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from varlake.llm import ann, mixing, queries, sharding, winnow
from varlake.llm.shared import Scratch


def exact(rows, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(axis=1)
        pick = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in pick]
    return out


def test_ann_recall_and_scores(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = exact(rows, 20)
    got = {}
    for r in queries.QUERIES["op6_nearest_neighbours"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    hit = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) / sum(map(len, want.values()))
    assert hit >= 0.9
    vec = dict(rows)
    for q, found in got.items():
        assert found == sorted(found, key=lambda t: (-t[1], t[0])) and len(found) == 20
        assert all(abs(s - sum(float(a) * float(b) for a, b in zip(vec[q], vec[v]))) < 1e-9 for v, s in found)


def ann_found(spark, frame, shard_rows=400, k=20, factor=None):
    vectors = ann.usable(frame, "vec_id", "embedding")
    scratch = Scratch(spark, "t")
    index = ann.build_index(vectors, scratch, shard_rows)
    got = {}
    for r in ann.search(vectors.filter("vec_id % 20 = 0"), index, scratch, k, factor).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(got[r["query_id"]]) == r["rank"]
    return index, got


def test_ann_factor_one_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(3000, 8)) * rng.gamma(2.0, size=(3000, 1))).astype(np.float32)
    x[1000:2500] = x[1000]  # a large group of copies: several shards of one region
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    monkeypatch.setattr(ann, "QUERY_PART", 60)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index, got = ann_found(spark, frame, 250, 10, 1.0)
    assert len(index.regions.paths) > 4 and index.trees.count() > len(index.regions.paths)
    assert got == exact(rows, 10)


def test_ann_prunes_and_keeps_recall(spark):
    """What the regions and trees leave out is a real share of the rows, and clustered vectors need few of them."""
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(40, 16)) * 4)[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16)) * 0.3
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    index, got = ann_found(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 800)
    want = exact(rows, 20)
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.95 * sum(map(len, want.values()))
    import pickle

    seen, q = 0, [r for r in rows if r[0] % 20 == 0]
    for r in index.trees.collect():
        tree = pickle.loads(r["tree"])
        kth = np.array([want[i][-1][1] for i, _ in q]) / index.lift.largest / index.lift.norm
        seen += tree.search(np.array([i for i, _ in q]), np.array([v for _, v in q]), kth, 20, index.factor)[3]
    assert index.factor > 1 and seen < 0.3 * len(q) * len(rows)


def test_ann_extreme_sizes(spark):
    rng = np.random.default_rng(2)
    for size in (1e-300, 1e150):
        x = rng.normal(size=(300, 4)) * size
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        _, got = ann_found(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 100, 5, 1.0)
        assert len(got) == 15 and all(len(f) == 5 for f in got.values())
        if size > 1:
            assert got == exact(rows, 5)


def test_ann_edges(spark):
    rows = [(0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (80, [1.0, None]), (100, []), (120, [1.0]), (None, [1.0, 1.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    assert ann_found(spark, frame)[1] == {0: [(7, 2.0), (7, 2.0)]}
    assert ann_found(spark, frame.limit(0))[1] == {}
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(100)], "vec_id long, embedding array<double>")
    assert ann_found(spark, same, 10, 3)[1] == {q: [(i, 5.0) for i in range(4) if i != q][:3] for q in range(0, 100, 20)}


def brute_exponent(tokens, repeats, target, most):
    p = [t / sum(tokens) for t in tokens]
    low, high = 0.0, 1.0
    over = lambda a: (lambda z: (math.log(z) - a * sum(x**a * math.log(x) for x in p) / z > target * math.log(len(p)) + 1e-12) or max(x ** (a - 1) for x in p) / z * repeats > most + 1e-12)(sum(x**a for x in p))
    if not over(0.0):
        return 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if over(mid) else (low, mid)
    return high


def test_mixing_meets_the_weights(spark):
    rows = [(i, "w " * (1 + i % 37), "hot" if i % 3 else f"s{i % 7}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    tokens = {}
    for _, t, s in rows:
        tokens[s] = tokens.get(s, 0) + len(t.split()) + 1
    out = mixing.stream(mixing.plan(docs, Scratch(spark, "t"), max_repeats=3.0)).collect()
    a = brute_exponent([*tokens.values()], 1.0, mixing.TARGET_ENTROPY, 3.0)
    assert abs(out[0]["exponent"] - a) < 1e-6
    whole = sum(tokens.values())
    z = sum((t / whole) ** a for t in tokens.values())
    got = {}
    for r in out:
        got[r["source"]] = got.get(r["source"], 0) + r["tokens"]
    for s, t in tokens.items():
        want = (t / whole) ** a / z
        assert abs(got[s] / whole - want) < 0.02 * want + 0.001
    places, times = {}, {}
    for r in out:
        places.setdefault((r["source"], r["block"], r["epoch"]), []).append(r["place"])
        times.setdefault((r["source"], r["block"]), {}).setdefault(r["doc_id"], []).append(r["epoch"])
    assert all(sorted(p) == [*range(len(p))] for p in places.values())
    for docs_of in times.values():  # whole epochs take all of a block, the last one a part
        last = max(map(max, docs_of.values()))
        assert all(sorted(e) in ([*range(last + 1)], [*range(last)]) for e in docs_of.values())


def test_mixing_cover_and_edges(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, None), (None, "", "y"), (3, "long " * 5000, "x")]
    docs = spark.createDataFrame([(*r, "b") for r in rows], "doc_id long, text string, source string, block string")
    planned = mixing.plan(docs, Scratch(spark, "t"), cover=True, max_repeats=2.0)
    out = mixing.mixed(docs, planned)
    assert out.columns == docs.columns
    got = [tuple(r)[:3] for r in out.collect()]
    assert all(got.count(r) >= rows.count(r) for r in set(rows))
    empty = docs.limit(0)
    assert mixing.stream(mixing.plan(empty, Scratch(spark, "t"))).count() == 0
    assert mixing.mixed(empty, mixing.plan(empty, Scratch(spark, "t"), cover=True)).count() == 0


def test_sharding(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op8_sharding"](spark, sf).collect()
    slots = {}
    for r in rows:
        data = docs[r["doc_id"]].encode()
        assert r["size"] == len(data) + 1 and r["text_crc32"] == zlib.crc32(data) and r["law"] == "key"
        assert r["grown_shard"] in (r["shard"], 16)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == len(docs) and all(sorted(s) == [*range(len(s))] for s in slots.values())


def test_sharding_moves_and_weights(spark):
    keys = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    tree = {0: {0: {0: 1.0, 1: 3.0}}, 1: {0: {2: 2.0}, 1: {3: 2.0}}}
    more = {0: {0: {0: 1.0, 1: 3.0}}, 1: {0: {2: 2.0}, 1: {3: 4.0}}}
    rows = sharding.with_shard(sharding.with_shard(keys, F.col("k"), tree, "a"), F.col("k"), more, "b")
    n = {tuple(r)[:2]: r[2] for r in rows.groupBy("a", "b").count().collect()}
    share = {s: sum(v for (a, _), v in n.items() if a == s) / 20000 for s in range(4)}
    assert all(abs(share[s] - w) < 0.02 for s, w in enumerate([1 / 8, 3 / 8, 2 / 8, 2 / 8]))
    # only moves into the region, and in it into the rack, that grew
    assert all(a == b or (a in (0, 1) and b in (2, 3)) or (a, b) == (2, 3) for a, b in n)
    odd = spark.createDataFrame([(None, "x"), (None, "x"), (1, None)], "k string, t string")
    placed = sharding.with_slots(sharding.with_shard(odd, F.col("k"), tree, "s"), Scratch(spark, "t"), "s", sharding.uniform(F.coalesce("k", F.lit(""))), ["t"])
    assert placed.count() == 3


def winnow_brute(text):
    if not text:
        return []

    def hash_of(gram):
        h = 0
        for c in gram:
            h = (h * winnow.BASE + ord(c)) % 2**30
        return h

    hashes = [hash_of(text[i:i + winnow.K]) for i in range(max(1, len(text) - winnow.K + 1))]
    kept = []
    for i in range(max(1, len(hashes) - winnow.WINDOW + 1)):
        window = hashes[i:i + winnow.WINDOW]
        low = min(window)
        at = i + max(j for j, h in enumerate(window) if h == low)
        if (low, at) not in kept[-1:]:
            kept.append((low, at))
    return kept


def winnow_check(spark, folder, rows):
    order = sorted(rows, key=lambda r: -r[0])
    follow = {order[i][0]: order[(i + 1) % len(order)][1] or "" for i in range(len(order))}
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_winnowing"](spark, folder).collect()}
    assert len(got) == len(rows)
    for doc, text in rows:
        text = text or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + follow[doc][:cut]
        a, b, c = winnow_brute(text), winnow_brute(edited), winnow_brute(follow[doc])
        r = got[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == " ".join(f"{h:x}:{i}" for h, i in a) and r["edited_fingerprint"] == " ".join(f"{h:x}:{i}" for h, i in b)
        of = lambda f: {h for h, _ in f}
        assert abs(r["near_edited"] - like(of(a), of(b))) < 1e-12 and abs(r["near_next"] - like(of(a), of(c))) < 1e-12


def test_winnowing_equals_brute_force(spark, sf):
    winnow_check(spark, sf, [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])


def test_winnowing_edges(spark, tmp_path):
    rows = [(5, None), (9, ""), (7, " "), (100, "é日 x" * 3), (3, "same text here"), (2, "same text here"), (-4, "w" * 30000), (10**15, "tie tie tie tie tie tie tie tie tie tie tie tie")]
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, head int, kept string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    winnow_check(spark, str(tmp_path), rows)
    frame.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.QUERIES["op10_winnowing"](spark, f"{tmp_path}/none").count() == 0


def test_winnowing_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = {r["doc_id"]: r["next_text"] for r in winnow.with_next(rows, "doc_id", ["text"], ["text"], 10).collect()}
    assert got == {i * i: str((i - 1) % 1000) for i in range(1000)}


def test_winnowing_chunks_and_ties(spark, tmp_path, monkeypatch):
    import random

    rng = random.Random(3)
    texts = ["ab" * 300, "x" * 500] + ["".join(rng.choice("ab") for _ in range(n)) for n in (1, 15, 16, 17, 46, 47, 48, 63, 64, 65, 139, 140, 141, 142, 143, 400)]
    rows = [*enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(winnow, "CHUNK", 50)
    winnow_check(spark, str(tmp_path), rows)


def test_winnowing_null_and_tied_ids(spark, tmp_path):
    rows = [(None, "last of all " * 9), (4, "b" * 60), (4, "a" * 60), (9, "first of all " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r["doc_id"], r["edited_sha256"]) for r in queries.QUERIES["op10_winnowing"](spark, str(tmp_path)).collect()]
    order = [rows[3], rows[2], rows[1], rows[0]]
    edited = lambda t, n: t[:len(t) - len(t) // 3] + n[:len(t) // 3]
    assert sorted(got, key=repr) == sorted(((d, hashlib.sha256(edited(t, order[(i + 1) % 4][1]).encode()).hexdigest()) for i, (d, t) in enumerate(order)), key=repr)


def test_winnowing_guarantee(spark, tmp_path):
    """Passages of WINDOW + K - 1 code points, spaced or not, at any offsets, share a print in the query's own result."""
    import random

    rng = random.Random(5)
    need = winnow.WINDOW + winnow.K - 1
    scripts = [lambda: chr(0x4E00 + rng.randrange(2000)), lambda: chr(0x20000 + rng.randrange(2000)), lambda: rng.choice("0123456789abcdef"), lambda: rng.choice("some words of it")]
    run = lambda one, n: "".join(one() for _ in range(n))
    rows = []
    for one in scripts:
        for shift in range(12):
            shared = run(one, need)
            rows += [(len(rows) + 1, run(one, 40) + shared + run(one, 40)), (len(rows), run(one, 40 + shift) + shared + run(one, 40))]
    long = run(scripts[0], 3000)
    rows += [(1001, long), (1000, "x" + long)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_winnowing"](spark, str(tmp_path)).collect()}
    assert all(got[i + 1]["near_next"] > 0 for i in range(0, len(rows) - 2, 2)) and got[1001]["near_next"] > 0.97


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.count()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = Scratch(spark, "t").path(name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] == seen[3] <= seen[4]
    assert docs.select("doc_id").distinct().count() == seen[3]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == seen[4]


def test_mixing_of_a_row_that_is_most_of_the_table(spark):
    """Copies beyond what one task makes, ties and nulls: places without gaps, every copy as often as the others."""
    rows = [(7, "the same row", "hot")] * 2600 + [(i, "w " * (i % 5), f"s{i % 3}") for i in range(200)] + [(None, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rows", F.lit("clash")).withColumn("place", F.lit(1))
    out = mixing.stream(mixing.plan(docs, Scratch(spark, "t"), max_repeats=3.0)).collect()
    places, hot = {}, {}
    for r in out:
        places.setdefault((r["source"], r["block"], r["epoch"]), []).append(r["place"])
        if r["doc_id"] == 7 and r["source"] == "hot":
            hot[r["epoch"]] = hot.get(r["epoch"], 0) + 1
    assert all(sorted(p) == [*range(len(p))] for p in places.values())
    assert hot and set(hot.values()) == {2600}


def test_mixing_query_places(spark, sf):
    rows = queries.QUERIES["op7_mixing"](spark, sf).collect()
    places = {}
    for r in rows:
        places.setdefault((r["source"], r["block"], r["epoch"]), []).append(r["place"])
    assert len(rows) > 100 and all(sorted(p) == [*range(len(p))] for p in places.values())


def test_sharding_of_repeated_rows_and_ids(spark, tmp_path):
    """Repeated rows, one id with many texts, null ids and texts, columns with clashing names, and an empty table."""
    rows = [(5, "same", "x")] * 2300 + [(6, f"text {i}", "y") for i in range(300)] + [(None, None, None)] * 4 + [(None, f"t{i}", "z") for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, slot string").withColumn("copies", F.lit("a")).withColumn("shard", F.lit("b"))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.sharding_query(spark, str(tmp_path)).collect()
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(rows) and all(sorted(s) == [*range(len(s))] for s in slots.values())
    count = lambda xs: {x: xs.count(x) for x in set(xs)}
    assert count([(r["doc_id"], r["size"]) for r in got]) == count([(d, len(t or "") + 1) for d, t, _ in rows])
    assert len({r["shard"] for r in got if r["doc_id"] == 6}) == 1
    frame.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert sharding.sharding_query(spark, f"{tmp_path}/none").count() == 0

"""Vector codes against plain loops, and the annulus against all entries."""

import hashlib
import math
import random

import numpy as np
import pytest
from varlake.llm import annular


def brute(rows, dimension, entries=64):
    """rows (vec_id, vector, label) as plain lists; integers are Python's."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-dimension // 16))
    whole = [(i, ([max(-2**24, min(2**24, math.floor(256 * x))) for x in v] + [0] * (16 * width))[:16 * width], lab) for i, v, lab in kept if len(v) == dimension]
    parts = [[v[p * width:(p + 1) * width] for p in range(16)] for _, v, _ in whole]
    first = sorted(range(len(whole)), key=lambda k: (whole[k][0] is None, whole[k][0] or 0, whole[k][1]))[:entries]
    books = [[parts[k][p] for k in first] for p in range(16)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(2):
        after = []
        for p in range(16):
            of = [nearest(p, q[p])[1] for q in parts]
            after.append([[sum(c) // len(c) for c in zip(*own)] if (own := [q[p] for q, k in zip(parts, of) if k == e]) else entry for e, entry in enumerate(books[p])])
        books = after
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, total = [], {}
    for (i, _, lab), q in zip(whole, parts):
        hits = [nearest(p, q[p]) for p in range(16)]
        error = sum(d for d, _ in hits)
        total[lab] = total.get(lab, 0) + error
        out.append((i, lab, "".join(f"{k:02x}" for _, k in hits), error))
    out = [(i, code, error, total[lab], digest) for i, lab, code, error in out]
    return sorted(out + [(i, None, None, None, digest) for i, v, _ in kept if len(v) != dimension], key=repr)


def vectors(n, dimension, seed):
    rng = random.Random(seed)
    f = lambda: float(np.float32(rng.gauss(0, 0.3)))
    rows = [(k, [f() for _ in range(dimension)], rng.choice([0, 0, 0, 1, 2, None])) for k in range(n)]
    return rows + [(n + k, rows[0][1], 0) for k in range(n // 3)]


ODD = [(None, [0.5] * 32, 1), (7, [0.25] * 32, None), (7, [0.25] * 32, 5), (900, None, 1), (901, [None] + [0.1] * 31, 1), (902, [float("nan")] + [0.1] * 31, 1),
       (903, [float("inf")] + [0.1] * 31, 1), (904, [-float("inf")] * 32, None), (905, [0.1] * 16, 2), (906, [], 2), (907, [1e30] * 32, 9), (908, [-3e4] * 32, 9), (909, [0.0] * 32, 1)]


@pytest.mark.parametrize("n, dimension", [(300, 32), (20, 32), (150, 40)])
def test_codes_equal_plain_loops(spark, n, dimension):
    rows = vectors(n, dimension, n) + (ODD if dimension == 32 else [])
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    got = annular.vector_codes(table).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, dimension)


def test_every_label_its_own(spark):
    rows = [(i, v, i) for i, v, _ in vectors(1500, 16, 4)[:1500]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert all(r["error"] == r["label_error"] for r in annular.vector_codes(table).collect())


def test_small_table_equals_plain_loops(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted((tuple(r) for r in annular.annular_query(spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert got == brute(rows, len(rows[0][1]))


def test_empty_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert annular.vector_codes(spark.createDataFrame([], kind)).collect() == []
    assert annular.vector_codes(spark.createDataFrame([(1, None, 1), (2, [None], 1)], kind)).collect() == []


@pytest.mark.parametrize("width, entries, spread", [(1, 64, 5), (4, 64, 300), (4, 64, 2), (8, 3, 100), (4, 1, 50), (32, 64, 10**6), (4, 64, 2**24)])
def test_annulus_loses_no_nearest_entry(width, entries, spread):
    rng = np.random.default_rng(width)
    book = rng.integers(-spread, spread + 1, (entries, width))
    book[entries // 2:] = book[:entries - entries // 2]  # ties
    x = np.concatenate([rng.integers(-spread, spread + 1, (3000, width)), book, np.zeros((1, width), np.int64)])
    index, squared, seen = annular.Codebook(book).nearest(x)
    every = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (squared == every.min(axis=1)).all() and (index == every.argmin(axis=1)).all()


def test_annulus_prunes(spark):
    """Fewer distances than all on parts of real vectors, of few and of many components."""
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").toArrow()["embedding"].combine_chunks()
    x = annular.integers(rows, 4).reshape(-1, 16, 4)
    shares = [annular.Codebook(x[:64, p]).nearest(x[:, p])[2] / (64 * len(x)) for p in range(16)]
    assert max(shares) < 0.7


def test_small_table_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    got = annular.annular_query(spark, "/root/testdata/sf0.001")
    cursor = con.execute(annular.annular_sql())
    assert sorted(got.columns) == sorted(d[0] for d in cursor.description)
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    order = [[d[0] for d in cursor.description].index(c) for c in names]
    assert sorted(tuple(r) for r in got.select(names).collect()) == sorted(tuple(r[k] for k in order) for r in cursor.fetchall())

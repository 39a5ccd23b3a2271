"""Approximate neighbours, communities and layouts against exact distances, modularity in SQL and planted groups."""

import random

import numpy as np
import pytest
from varlake.operators import blocks, communities as cm, graph, layout, neighbours as nb
from varlake.sources.folder import Tables


def latents(spark, x):
    return spark.createDataFrame([(f"c{i:05d}", v.tolist()) for i, v in enumerate(x)], "cell string, z array<double>")


def planted(n, groups=6, width=12, seed=1, apart=3.0):
    rng = np.random.default_rng(seed)
    centres, of = rng.normal(size=(groups, width)) * apart, rng.integers(0, groups, n)
    return centres[of] + rng.normal(size=(n, width)), of


def recall(rows, x, k, asked):
    got = {}
    for r in rows:
        got.setdefault(int(r["cell"][1:]), {})[int(r["neighbour"][1:])] = r["distance"]
    hit = 0
    for i in asked:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        assert i not in got[i] and len(got[i]) == min(k, len(x) - 1)
        assert all(v == pytest.approx(d[j], abs=1e-5) for j, v in got[i].items())
        kth = np.sort(np.delete(d, i))[:k][-1]
        hit += sum(v <= kth + 1e-9 for v in got[i].values())
    return hit / (len(asked) * k)


@pytest.mark.parametrize("n", [300, 1200, 5000])
def test_descent_finds_nine_of_ten(spark, n):
    """At three sizes, and without structure the smallest too."""
    for x in [planted(n)[0]] + ([np.random.default_rng(3).normal(size=(n, 32))] if n == 1200 else []):
        with Tables(spark, "descent") as tables:
            rows = nb.approximate_neighbours(latents(spark, x), tables, k=10).collect()
        assert recall(rows, x, 10, random.Random(n).sample(range(n), 150)) >= 0.9


def test_descent_on_copies_and_few_rows(spark):
    x = planted(900)[0]
    x[:300] = x[0]  # a third of the rows are copies
    with Tables(spark, "copies") as tables:
        rows = nb.approximate_neighbours(latents(spark, x), tables, k=10).collect()
    by = {}
    for r in rows:
        by.setdefault(r["cell"], []).append(r["distance"])
    assert all(by[f"c{i:05d}"] == [0.0] * 10 for i in range(300)) and len(by) == 900
    assert recall(rows, x, 10, range(300, 900, 7)) >= 0.9
    for few in (0, 1, 2, 5):
        with Tables(spark, "few") as tables:
            rows = nb.approximate_neighbours(latents(spark, x[400:400 + few]), tables, k=10).collect()
        assert len(rows) == few * (few - 1)
        assert sorted(r["place"] for r in rows) == sorted([*range(1, few)] * few)
    odd = spark.createDataFrame([("a", [0.0, 1.0]), ("b", None), ("c", [0.0, 2.0])], "cell string, z array<double>")
    with Tables(spark, "odd") as tables:
        assert {r["cell"] for r in nb.approximate_neighbours(odd, tables).collect()} == {"a", "c"}


def test_members_of_a_round_are_bounded(spark):
    """A row that all others point to meets no more than a sample of them."""
    n = 3000
    hub = spark.createDataFrame([(i, 0, 1.0, 1) for i in range(1, n)], "a long, b long, d double, place int")
    points = spark.createDataFrame([(i, [float(i)]) for i in range(n)], "id long, z array<double>")
    found = nb._round(hub, points, 30, 20, 1).collect()
    assert 0 < len({r["a"] for r in found}) <= 60


def test_rows_that_have_met_do_not_move_again(spark):
    """Of three rows around one, only pairs with a fresh entry are compared; without any nothing is."""
    points = spark.createDataFrame([(i, [float(i)]) for i in range(4)], "id long, z array<double>")
    graph = lambda fresh: spark.createDataFrame([(0, b, float(b * b), 1, b in fresh, True) for b in (1, 2, 3)], "a long, b long, d double, place int, fresh boolean, drawn boolean")
    assert nb._round(graph(()), points, 30, 20, 1).collect() == []
    assert {(r["a"], r["b"]) for r in nb._round(graph((3,)), points, 30, 20, 1).collect()} == {(1, 3), (3, 1), (2, 3), (3, 2)}


def test_whole_groups_are_whole(spark):
    import pyarrow as pa

    rng = random.Random(1)
    keys = sorted(rng.choices(range(40), k=500))
    rows = [pa.record_batch({"k": keys[i:i + 7], "v": [*range(i, min(i + 7, 500))]}) for i in range(0, 500, 7)]
    for least in (1, 50, 10_000):
        seen = []
        for table, at in blocks.whole_groups(iter(rows), "k", least=least):
            for i, j in zip(at, at[1:]):
                assert len({*table["k"].to_pylist()[i:j]}) == 1
                seen.append((table["k"][int(i)].as_py(), table["v"].to_pylist()[i:j]))
        assert [k for k, _ in seen] == sorted({*keys}) and [v for _, g in seen for v in g] == [*range(500)]
    assert list(blocks.whole_groups(iter([]), "k")) == []


def test_numbered(spark):
    values = random.Random(2).sample(range(1000), 300)
    with Tables(spark, "numbered") as tables:
        rows = blocks.numbered(spark.createDataFrame([(v,) for v in values], "v int").repartition(5), [blocks.F.desc("v")], "n", tables, "t").collect()
        assert [r["v"] for r in sorted(rows, key=lambda r: r["n"])] == sorted(values, reverse=True) and sorted(r["n"] for r in rows) == [*range(300)]


def sql_modularity(edges, labels, resolution):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("e", pd.DataFrame([(r["a"], r["b"], r["w"]) for r in edges], columns=["a", "b", "w"]))
    con.register("l", pd.DataFrame([*labels.items()], columns=["cell", "c"]))
    return con.execute(f"""with n as (select a, c, sum(w) k from e join l on cell=a group by a, c) select (select sum(w) from e join l x on x.cell=a join l y on y.cell=b where x.c=y.c)/sum(k)
      - {resolution}*(select sum(t*t) from (select sum(k) t from n group by c))/(sum(k)*sum(k)) from n""").fetchone()[0]


def connected(edges, labels):
    near = {}
    for r in edges:
        near.setdefault(r["a"], set()).add(r["b"])
    for c in set(labels.values()):
        own = {n for n, v in labels.items() if v == c}
        seen, todo = set(), [min(own)]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += [m for m in near.get(n, ()) if m in own]
        if seen != own:
            return False
    return True


def clusters(spark, edges, resolution=0.4):
    with Tables(spark, "clusters") as tables:
        return {r["cell"]: r["cluster"] for r in cm.communities(edges, tables, resolution).collect()}


def test_planted_communities(spark):
    x, of = planted(400, groups=5, apart=4.0)
    cells = latents(spark, x)
    near = graph.nearest_cells(cells, 10).persist()
    fuzzy = layout.fuzzy_graph(near).persist()
    got = clusters(spark, fuzzy)
    edges = cm.undirected(fuzzy).collect()
    assert connected(edges, got)
    pairs = {(of[int(c[1:])], v) for c, v in got.items()}
    assert len(pairs) == len({p for p, _ in pairs}) == len({v for _, v in pairs}) == 5  # the planted groups, one cluster each
    sizes = [sum(v == c for v in got.values()) for c in range(5)]
    assert sizes == sorted(sizes, reverse=True) and sum(sizes) == 400
    spread = {r["cell"]: r["cluster"] for r in graph.propagated_labels(near).collect()}
    found, other = sql_modularity(edges, got, 0.4), sql_modularity(edges, spread, 0.4)
    assert found >= other - 1e-9
    labels = spark.createDataFrame([*got.items()], "cell string, cluster long")
    assert cm.modularity(cm.undirected(fuzzy), labels, 0.4) == pytest.approx(found, abs=1e-9)
    near.unpersist(), fuzzy.unpersist()


def test_communities_without_clear_groups(spark):
    """A ring of cliques, a bridge, and weights: not below label propagation, connected, the same on a rerun."""
    rng = random.Random(7)
    rows = []
    for c in range(8):
        rows += [(f"{c}-{i}", f"{c}-{j}", rng.choice([1.0, 2.0])) for i in range(6) for j in range(i)]
        rows.append((f"{c}-0", f"{(c + 1) % 8}-3", 1.0))
    rows += [(f"r{i}", f"r{rng.randrange(60)}", 0.5) for i in range(60) for _ in range(3)] + [("r0", "0-0", 1.0)]
    edges = spark.createDataFrame(rows, "cell string, neighbour string, weight double")
    got = clusters(spark, edges, 1.0)
    both = cm.undirected(edges).collect()
    spread = {r["cell"]: r["cluster"] for r in graph.propagated_labels(edges.filter("cell <> neighbour")).collect()}
    assert connected(both, got) and sql_modularity(both, got, 1.0) >= sql_modularity(both, spread, 1.0) - 1e-9
    assert len({got[f"{c}-{i}"] for c in range(8) for i in range(6)}) in range(4, 9) and all(len({got[f"{c}-{i}"] for i in range(6)}) == 1 for c in range(8))
    assert clusters(spark, edges.repartition(7), 1.0) == got


def test_communities_of_odd_graphs(spark):
    none = spark.createDataFrame([], "cell string, neighbour string")
    assert clusters(spark, none) == {}
    loops = spark.createDataFrame([("a", "a"), ("b", "c"), ("c", "b"), ("b", "c"), ("d", "e")], "cell string, neighbour string")
    assert clusters(spark, loops) == {"b": 0, "c": 0, "d": 1, "e": 1}


def test_rounds_do_not_take_the_edges_again(spark):
    """A level reads its edges a few times, however many rounds it takes, and a round moves no edge to join it to where its end is."""
    x, _ = planted(300, groups=4, apart=2.0)
    fuzzy = layout.fuzzy_graph(graph.nearest_cells(latents(spark, x), 8)).persist()
    edges, seen = cm.undirected(fuzzy).count(), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    class Watched(Tables):
        def save(self, df, name):
            out = super().save(df, name)
            self.rounds = getattr(self, "rounds", 0) + ("level-0-moved" in name)
            return out.mapInArrow(counted, out.schema) if name == "edges" else out

    with Watched(spark, "watched") as tables:
        cm.communities(fuzzy, tables, levels=1).collect()
        assert tables.rounds > 4 and 0 < seen.value <= 8 * edges
    few = spark.createDataFrame([(i, (i + 1) % 50, 1.0) for i in range(50)] + [((i + 1) % 50, i, 1.0) for i in range(50)], "a long, b long, w double")
    held = cm._dealt(few, 100)
    nodes = spark.createDataFrame([(i, 2.0, i) for i in range(50)], "node long, k double, c long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = cm._round_of_moves(held, nodes, 100.0, 0.4, 1, 0)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("InMemoryTableScan") == 1 and plan.count("hashpartitioning(b#") <= 2  # the labels, and how the edges were dealt
        assert rows.count() == 50 and {(r["own"], r["total"]) for r in rows.collect()} == {(0.0, 2.0)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        held.unpersist(), fuzzy.unpersist()


def test_smooth_weights():
    rng = np.random.default_rng(4)
    d = np.sort(rng.gamma(2, 1, (50, 15)), axis=1)
    d[0] = 2.0  # all alike
    d[1, :5] = 0.0  # copies
    w = layout.smooth_weights(d)
    assert (np.diff(w, axis=1) <= 1e-12).all() and np.allclose(w[2:].sum(1), np.log2(15), atol=1e-6) and np.allclose(w[2:, 0], 1)
    assert np.allclose(w[0], 1) and np.allclose(w[1, :6], 1)
    short = layout.smooth_weights(np.array([[1.0, 2.0, np.nan], [1.0, np.nan, np.nan]]))
    assert np.isnan(short[0, 2]) and short[1, 0] == 1


def test_fuzzy_union(spark):
    rows = [("a", "b", 1.0), ("a", "c", 2.0), ("b", "a", 1.0), ("b", "c", 3.0), ("c", "a", 2.0)]
    got = {(r["cell"], r["neighbour"]): r["weight"] for r in layout.fuzzy_graph(spark.createDataFrame(rows, "cell string, neighbour string, distance double")).collect()}
    one = {c: dict(zip([n for a, n, _ in rows if a == c], layout.smooth_weights(np.array([[d for a, _, d in rows if a == c]]))[0])) for c in "abc"}
    either = lambda p, q: p + q - p * q
    assert got == pytest.approx({("a", "b"): either(one["a"]["b"], one["b"]["a"]), ("a", "c"): either(one["a"]["c"], one["c"]["a"]), ("b", "c"): one["b"]["c"]})


def preserved(x, rows, k=10):
    y = np.array([(r["x"], r["y"]) for r in sorted(rows, key=lambda r: r["cell"])])
    assert np.isfinite(y).all() and len(y) == len(x)
    near = lambda p: [{*np.argsort(((p - v) ** 2).sum(1), kind="stable")[1:k + 1]} for v in p]
    return np.mean([len(a & b) / k for a, b in zip(near(x), near(y))])


def test_layout_keeps_more_neighbours_than_the_plane(spark):
    """On a rolled-up sheet, whose layers lie on each other in the plane; and the same layout on a rerun."""
    rng = np.random.default_rng(6)
    t, h = rng.uniform(4.5, 14, 300), rng.uniform(0, 12, 300)
    x = np.stack([t * np.cos(t), h, t * np.sin(t)], 1) @ np.linalg.qr(rng.normal(size=(6, 6)))[0][:3] + rng.normal(0, 0.05, (300, 6))
    cells = latents(spark, x)
    fuzzy = layout.fuzzy_graph(graph.nearest_cells(cells, 10)).persist()
    plane = graph.principal_plane(cells)

    def run(part):
        with Tables(spark, "layout") as tables:
            return layout.layout(fuzzy.repartition(part), plane, tables, epochs=25).collect()

    rows = run(2)
    assert preserved(x, rows) > 1.3 * preserved(x, plane.collect())
    again = {r["cell"]: (r["x"], r["y"]) for r in run(2)}
    assert all(again[r["cell"]] == pytest.approx((r["x"], r["y"]), abs=1e-6) for r in rows)
    fuzzy.unpersist()


def test_layout_of_copies_and_lone_cells(spark):
    start = spark.createDataFrame([(c, 0.0, 0.0) for c in "abcd"], "cell string, x double, y double")
    edges = spark.createDataFrame([("a", "b", 1.0)], "cell string, neighbour string, weight double")
    with Tables(spark, "layout") as tables:
        rows = layout.layout(edges, start, tables, epochs=5).collect()
    assert len(rows) == 4 and np.isfinite([v for r in rows for v in (r["x"], r["y"])]).all() and len({(r["x"], r["y"]) for r in rows}) == 4


@pytest.mark.parametrize("kind, offset", [(np.float64, 0.0), (np.float32, 0.0), (np.float64, 1e4)])
def test_few_exact_distances_find_the_nearest(monkeypatch, kind, offset):
    """With copies and equal distances, around a far centre too: what the products leave is a small share of the pairs."""
    rng, taken = np.random.default_rng(5), []
    y = np.round(rng.normal(size=(3000, 8)) * 16) / 16
    y[2000:2100] = y[:100]
    y = (y + offset).astype(kind)
    x, rank = y[:300], rng.permutation(len(y))
    take = graph.Nearest._take
    monkeypatch.setattr(graph.Nearest, "_take", lambda self, r, c: (taken.append(len(r)), take(self, r, c))[1])
    found = graph.Nearest(x, y, np.arange(300), np.arange(3000), rank, np.full(300, np.inf), 7)
    for first in (0, 1000, 2000):
        found.visit(np.arange(300), first, first + 1000, y[first].astype(float))
    d = np.sqrt(((x[:, None].astype(float) - y[None].astype(float)) ** 2).sum(2))
    d[np.arange(300), np.arange(300)] = np.inf
    want = np.stack([np.lexsort((rank, r))[:7] for r in d])
    assert (found.at == want).all() and (found.d == np.take_along_axis(d, want, 1)).all()
    assert sum(taken) < 0.03 * d.size


def test_nearest_cells_in_large_parts(spark, monkeypatch):
    """Parts of several units, bundles of several parts, and names that meet themselves."""
    monkeypatch.setattr(graph, "PIVOTS", 3)
    monkeypatch.setattr(graph, "VALUES", 40 * 4)
    x = np.concatenate([np.random.default_rng(2).normal(size=(150, 4)), np.random.default_rng(3).normal(size=(20, 4)) + 30])
    x[5] = x[6] = x[7]
    rows = graph.nearest_cells(latents(spark, x), 5, 20).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    d[np.arange(170), np.arange(170)] = np.inf
    names = [f"c{i:05d}" for i in range(170)]
    want = {(names[i], names[j], p + 1) for i in range(170) for p, j in enumerate(np.argsort(d[i], kind="stable")[:5])}
    assert {(r["cell"], r["neighbour"], r["place"]) for r in rows} == want


def test_forest_finds_the_nearest_within_groups(spark):
    """Of points in few dimensions, copies among them, in groups of unequal size and place; what is found is right and nearly all."""
    rng = np.random.default_rng(11)
    z = rng.normal(size=(7000, 6)) * np.linspace(3, 1, 6)
    grp = np.where(np.arange(7000) < 6000, 1, 2)
    z[grp == 2] += 40
    z[:80] = z[0]
    rows = [(int(i) * 5, int(g), v.tolist()) for i, (g, v) in enumerate(zip(grp, z))] + [(1, 3, z[5].tolist()), (2, 4, z[5].tolist()), (3, 4, z[6].tolist())]
    points = spark.createDataFrame(rows, "id long, grp long, z array<double>")
    with Tables(spark, "forest") as tables:
        got = {r["id"]: (r["near"], r["d"]) for r in nb.forest_neighbours(points, tables, 10).collect()}
        nothing = nb.forest_neighbours(points.limit(0), tables, 10).count()
    assert nothing == 0 and 1 not in got and got[2] == ([3], [0.0]) and len(got) == 7002
    hits = 0
    for i in rng.choice(7000, 300, replace=False):
        near, d = np.array(got[i * 5][0]) // 5, np.array(got[i * 5][1])
        true = ((z - z[i]) ** 2).sum(1)
        assert i not in near and len(set(near)) == 10 and (grp[near] == grp[i]).all() and np.allclose(true[near], d) and (np.diff(d) >= 0).all()
        true[(grp != grp[i]) | (np.arange(7000) == i)] = np.inf
        hits += (d <= np.sort(true)[9] + 1e-9).sum()
    assert hits >= 0.98 * 3000
    assert all(max(got[i * 5][1]) == 0 for i in range(80)) and len({b for i in range(80) for b in got[i * 5][0]}) > 60  # copies are spread


def test_forest_without_structure_is_left_to_the_descent(spark, monkeypatch):
    monkeypatch.setattr(nb, "MOST_TREES", 1)
    monkeypatch.setattr(nb, "FOREST_LEAF", 64)
    z = np.random.default_rng(12).normal(size=(600, 24))
    points = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(z)], "id long, grp long, z array<double>")
    with Tables(spark, "forest") as tables:
        got = {r["id"]: r["near"] for r in nb.forest_neighbours(points, tables, 10).collect()}
    true = ((z[:, None] - z[None]) ** 2).sum(-1) + np.diag([np.inf] * 600)
    assert np.mean([len(set(got[i]) & set(np.argsort(true[i])[:10])) / 10 for i in range(600)]) > 0.95

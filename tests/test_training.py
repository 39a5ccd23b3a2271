"""Gradients against finite differences, training against a plain loop, and independence of partitions."""

import math
import random
import zlib

import numpy as np
import pytest
from varlake.operators import model, training as t

TINY = dict(genes=6, snvs=5, latent=3, embedding=2, batches=2, batch_embedding=2, hidden=(5, 4))


def tiny_weights(seed=0, spread=0.3):
    rng = np.random.default_rng(seed)
    return {k: v + rng.normal(0, spread, v.shape) for k, v in model.seeded_weights(**TINY).items()}


def tiny_cells(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        snvs = sorted(rng.sample(range(5), rng.choice([0, 1, 3, 5])))
        rows.append((f"c{i}", rng.choice([0, 1]), [float(rng.choice([0, 0, 1, 2, 9])) for _ in range(6)], snvs, [rng.choice([-1, 1]) for _ in snvs]))
    return rows


def arrays(rows):
    of = np.repeat(np.arange(len(rows)), [len(r[3]) for r in rows])
    flat = lambda k: np.array([v for r in rows for v in r[k]], int)
    return np.array([r[2] for r in rows]), np.array([r[1] for r in rows]), of, flat(3), flat(4)


def assert_derivative(loss, w, g, names=None):
    """Every single weight."""
    for k in names or g:
        flat = np.ravel(g[k]) if np.shape(g[k]) else np.array([g[k]])
        for i in range(w[k].size):
            diff = []
            for e in (1e-6, -1e-6):
                v = {n: a.copy() for n, a in w.items()}
                v[k].ravel()[i] += e
                diff.append(loss(v))
            assert flat[i] == pytest.approx((diff[0] - diff[1]) / 2e-6, rel=2e-4, abs=2e-5), (k, i)


def test_special_functions():
    x = np.array([1e-5, 0.3, 1.0, 2.5, 17.0, 1e4, 1e6])
    assert np.allclose(t.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    step = 1e-5 * x
    assert np.allclose(t.digamma(x), [(math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h) for v, h in zip(x, step)], rtol=1e-5, atol=1e-5)


@pytest.mark.parametrize("likelihood, activation, reverse", [(True, "umi", 0.0), (True, "softplus", 0.0), (False, "softplus", 0.4), (False, "identity", 0.0)])
def test_backbone_gradient_is_the_derivative(likelihood, activation, reverse):
    x, batch, *_ = arrays(tiny_cells(5))
    w, noise = tiny_weights(), np.random.default_rng(1).normal(size=(5, 3))
    if reverse:
        w = t.with_discriminator(w, 4)

    def sums(v, part=None):
        return t.backbone_sums(v, x, batch, noise, 0.7, reverse, likelihood, activation)

    encoder = ("enc", "ln", "mu", "var")
    _, g = sums(w)
    plain = [k for k in g if not k.startswith((*encoder, "disc"))]
    total = lambda v: (lambda s: s["recon"] + 0.7 * s["kl"])(sums(v)[0])
    assert_derivative(total, w, g, plain)
    if reverse:  # the discriminator goes down its loss, the encoder up
        assert_derivative(lambda v: sums(v)[0]["adv"], w, g, [k for k in g if k.startswith("disc")])
        assert_derivative(lambda v: total(v) - reverse * sums(v)[0]["adv"], w, g, [k for k in g if k.startswith(encoder)])
    else:
        assert_derivative(total, w, g, [k for k in g if k.startswith(encoder)])


@pytest.mark.parametrize("noisy", [True, False])
def test_effect_gradient_is_the_derivative(noisy):
    x, batch, of, snvs, signs = arrays(tiny_cells(6))
    noise, w = np.random.default_rng(2).normal(size=(6, 3)) if noisy else None, tiny_weights(3)
    losses, g = t.effect_sums(w, x, batch, of, snvs, signs, noise)
    assert {*g} == {*w}
    assert_derivative(lambda v: (lambda s: s["nll"] + s["kl"])(t.effect_sums(v, x, batch, of, snvs, signs, noise)[0]), w, g)


def test_rank_gradient_is_the_derivative():
    rows = tiny_cells(6)
    x, batch, *own = arrays(rows)
    _, _, *other = arrays(rows[1:] + rows[:1])
    valid, w = np.array([True, False, True, True, False, True]), tiny_weights(4)
    losses, g = t.rank_sums(w, x, batch, own, other, valid)
    assert losses["valid"] == 4
    assert_derivative(lambda v: (lambda s: s["below"] - s["above"])(t.rank_sums(v, x, batch, own, other, valid)[0]), w, g)


def test_differing_variants():
    rows, others = tiny_cells(40, 5), tiny_cells(40, 6)
    _, _, *own = arrays(rows)
    _, _, *other = arrays(others)
    dense = lambda rs: np.array([[dict(zip(r[3], r[4])).get(s, 0) for s in range(5)] for r in rs])
    assert (t.differing(*own, *other, 40) == (dense(rows) != dense(others)).sum(1)).all()
    none = (np.zeros(0, int),) * 3
    assert (t.differing(*none, *none, 3) == 0).all()


def test_negatives(spark):
    rows = tiny_cells(90) + [("lone", 7, [0.0] * 6, [1], [1]), ("p", 8, [0.0] * 6, [2], [1]), ("q", 8, [0.0] * 6, [], [])]
    df = spark.createDataFrame(rows, "cell string, batch int, x array<double>, snvs array<int>, signs array<int>")
    marked = df.select("cell", "batch", "x", model.F.array((model.F.crc32("cell") % (1 << 30)).cast("int")).alias("snvs"), model.F.array(model.F.lit(1)).alias("signs"))
    of = {zlib.crc32(r[0].encode()) % (1 << 30): r for r in rows}
    got = {r["cell"]: [of[n["snvs"][0]] for n in r["negs"] or []] for r in t.with_negatives(marked, group=16, negatives=4).collect()}
    assert {*got} == {r[0] for r in rows} and got["lone"] == [] and [n[0] for n in got["p"]] == ["q"] and [n[0] for n in got["q"]] == ["p"]
    batch = {r[0]: r[1] for r in rows}
    for c, negs in got.items():
        assert all(n[0] != c and n[1] == batch[c] for n in negs) and len({n[0] for n in negs}) == len(negs)
    first = [negs[0][0] for c, negs in got.items() if negs]
    assert len(first) == len({*first})  # a derangement
    again = {r["cell"]: [of[n["snvs"][0]] for n in r["negs"] or []] for r in t.with_negatives(marked.repartition(7), group=16, negatives=4).collect()}
    assert again == got


KIND = "cell string, batch int, x array<double>, snvs array<int>, signs array<int>"


def near(a, b):
    return [{k: v for k, v in r.items() if k != "value"} for r in a] == [{k: v for k, v in r.items() if k != "value"} for r in b] and np.allclose([r["value"] for r in a], [r["value"] for r in b], rtol=1e-8)


def test_losses_do_not_depend_on_partitions(spark):
    cells = spark.createDataFrame(tiny_cells(200), KIND)
    w = tiny_weights(7)
    rank = t.Rank(first=2, warm=2, least_differing=2, weight=1.0, margin=50.0)
    for steps in (1, 2):
        runs = [t.train_effect(cells.repartition(n), w, epochs=4, rate=1e-2, rank=rank, steps=steps) for n in (1, 5)]
        assert near(runs[0][1], runs[1][1]) and all(np.allclose(runs[0][0][k], runs[1][0][k], rtol=1e-6, atol=1e-9) for k in w)
        runs = [t.train_backbone(cells.repartition(n), w, epochs=3, likelihood=True, reverse=0.2, steps=steps) for n in (1, 5)]
        assert near(runs[0][1], runs[1][1])
    assert any(r["part"] == "rank_valid" and r["value"] > 0 for r in t.train_effect(cells, w, epochs=2, rank=rank)[1])


def plain_adam(loss, w, names, rates, decay, clip):
    """Steps by finite differences of a loss, in loops."""
    m, v = {k: np.zeros(w[k].size) for k in names}, {k: np.zeros(w[k].size) for k in names}
    for step, rate in enumerate(rates, 1):
        g = {}
        for k in names:
            g[k] = np.zeros(w[k].size)
            for i in range(w[k].size):
                up, down = ({n: a.copy() for n, a in w.items()} for _ in range(2))
                up[k].ravel()[i] += 1e-5
                down[k].ravel()[i] -= 1e-5
                g[k][i] = (loss(up, step) - loss(down, step)) / 2e-5
        size = math.sqrt(sum((a**2).sum() for a in g.values()))
        yield step, {k: a.copy() for k, a in w.items()}
        for k in names:
            for i in range(w[k].size):
                d = g[k][i] * min(1, clip / (size + 1e-6)) + decay * w[k].ravel()[i]
                m[k][i] = 0.9 * m[k][i] + 0.1 * d
                v[k][i] = 0.999 * v[k][i] + 0.001 * d * d
                w[k].ravel()[i] -= rate * (m[k][i] / (1 - 0.9**step)) / (math.sqrt(v[k][i] / (1 - 0.999**step)) + 1e-8)


def test_effect_training_equals_a_plain_loop(spark):
    """Weights by finite differences of losses that are written out with math.lgamma over the plain forward pass of test_units."""
    from tests.test_units import plain_forward

    rows = [r for r in tiny_cells(14, 9)]
    cells = spark.createDataFrame(rows, KIND).repartition(3)
    rank = t.Rank(first=2, warm=2, weight=2.0, margin=3.0, least_differing=2)
    negs = {r["cell"]: r["negs"] for r in t.with_negatives(cells).collect()}

    def nll(w, x, mean):
        theta = [math.log1p(math.exp(v)) + 1e-5 for v in w["theta"]]
        return -sum(math.lgamma(h + c) - math.lgamma(h) - math.lgamma(c + 1) + h * math.log(h / (h + u)) + c * math.log(u / (h + u)) for c, u, h in zip(x, mean, theta))

    def one(w, r, snvs, signs, noise):
        mu, lv = model.encode(w, np.array([r[2]]))
        z = mu[0] + noise * np.exp(lv[0] / 2)
        # the plain pass takes its state from the encoder, so the noise goes there
        moved = w | {"mu.b": w["mu.b"] + z - mu[0]}
        mean = plain_forward(moved, r[2], r[1], snvs, signs)[3] if snvs else model.decode(w, (z + w["proj.b"])[None], np.array([r[1]]))[0]
        return nll(w, r[2], mean) + np.maximum(0.5 * (mu**2 + np.exp(lv) - lv - 1), 0.5).sum()

    def loss(w, epoch):
        total = sum(one(w, r, r[3], r[4], np.random.default_rng([42, epoch, zlib.crc32(r[0].encode())]).normal(size=3)) for r in rows) / len(rows)
        if epoch < rank.first:
            return total
        ramp, below, above = min(1, (epoch - rank.first + 1) / rank.warm), [], []
        for r in rows:
            others = negs[r[0]] or []
            if others:
                n = others[(epoch - rank.first) % len(others)]
                a, b = dict(zip(r[3], r[4])), dict(zip(n["snvs"], n["signs"]))
                if sum(a.get(s, 0) != b.get(s, 0) for s in range(5)) >= rank.least_differing:
                    below.append(one(w, r, r[3], r[4], 0.0))
                    above.append(one(w, r, n["snvs"], n["signs"], 0.0))
        assert below
        return total + rank.weight * ramp * max(0.0, rank.margin * ramp + sum(below) / len(below) - sum(above) / len(above))

    names = [k for k in tiny_weights() if not k.startswith(("enc", "ln", "mu", "var"))]
    rates = [2e-2 * e / 10 for e in (1, 2, 3)]
    want = [(step, loss(w, step)) for step, w in plain_adam(loss, tiny_weights(8), names, rates, 1e-5, 1.0)]
    _, history = t.train_effect(cells, tiny_weights(8), epochs=3, rate=2e-2, rank=rank)
    got = {r["epoch"]: r["value"] for r in history if r["part"] == "loss"}
    assert [got[e] for e, _ in want] == pytest.approx([v for _, v in want], rel=1e-5)
    assert any(r["part"] == "rank" and r["value"] > 0 for r in history)


def test_backbone_training(spark):
    cells = spark.createDataFrame(tiny_cells(120), KIND)
    w, history = t.train_backbone(cells, tiny_weights(5), epochs=12, likelihood=True, rate=3e-2, warm=1, reverse=0.1, reverse_warm=1)
    assert {(r["epoch"], r["split"], r["part"]) for r in history} == {(e, s, p) for e in range(1, 13) for s in ("train", "validation") for p in ("loss", "recon", "kl", "adv")}
    loss = [r["value"] for r in history if r["split"] == "train" and r["part"] == "loss"]
    assert loss[-1] < loss[0] and "disc1.w" in w
    # no better epoch for two in a row ends the training, and the best weights count
    w, history = t.train_backbone(cells, tiny_weights(5), epochs=40, likelihood=True, rate=1.0, warm=1, patience=2)
    of = {r["epoch"]: r["value"] for r in history if r["split"] == "validation" and r["part"] == "loss"}
    last = max(of)
    assert last < 40 and min(of, key=of.get) == last - 2
    assert t.train_backbone(cells.limit(0), tiny_weights(), epochs=2)[1] == []
    assert t.train_effect(cells.limit(0), tiny_weights(), epochs=2)[1] == []


def test_rates():
    adam = t.Adam(tiny_weights(), ["snv"], 1e-3, 0, 1, 30)
    assert [adam.rate_in(e) for e in (1, 10, 11)] == pytest.approx([1e-4, 1e-3, 1e-3]) and adam.rate_in(30) < 2e-5
    assert [adam.rate_in(e) for e in range(11, 31)] == sorted((adam.rate_in(e) for e in range(11, 31)), reverse=True)


def test_frozen_weights_stay(spark):
    cells, w = spark.createDataFrame(tiny_cells(20), KIND), tiny_weights()
    for frozen in ("encoder", "backbone", ""):
        out, _ = t.train_effect(cells, w, epochs=1, frozen=frozen, rate=1e-2, rank=None)
        assert {k for k in w if np.array_equal(w[k], out[k])} == {k for k in w if k.startswith(t.FROZEN[frozen] or "-")}


def test_whole_counts_are_looked_up(monkeypatch):
    rng, seen = np.random.default_rng(3), []
    th, c = np.exp(rng.normal(size=7)), rng.poisson(2.0, (200, 7)).astype(float)
    plain = t.lgamma(th + c), t.lgamma(c + 1), t.digamma(th + c)
    for name in ("lgamma", "digamma"):
        monkeypatch.setattr(t, name, lambda x, f=getattr(t, name): (seen.append(x.size), f(x))[1])
    mean, raw = np.exp(rng.normal(size=c.shape)), np.log(np.expm1(th))
    t.negative_binomial(c, mean, raw, t.EFFECT)
    assert max(seen) <= 7 * (c.max() + 1) < c.size / 5
    assert all((a == b).all() for a, b in zip(t._gamma_terms(th, c), plain))
    half = c + 0.5  # parts of counts, and counts without end, are not
    assert (t._gamma_terms(th, half)[0] == t.lgamma(th + half)).all()
    c[0, 0] = 1e6
    assert t._gamma_terms(th, c)[2][0, 0] == t.digamma(th + c)[0, 0]


def test_one_encoder_serves_all_terms():
    rows = tiny_cells(9)
    x, batch, *own = arrays(rows)
    _, _, *other = arrays(rows[1:] + rows[:1])
    valid, w = np.arange(9) % 3 > 0, tiny_weights(4)
    losses, g = t.rank_sums(w, x, batch, own, other, valid)
    again, some = t.rank_sums(w, x, batch, own, other, valid, t.Encoder(w, x), False)
    assert {*g} - {*some} == {k for k in w if k.startswith(t.FROZEN["encoder"])}
    assert all(losses[k] == pytest.approx(again[k]) for k in losses) and all(np.allclose(g[k], some[k]) for k in some)

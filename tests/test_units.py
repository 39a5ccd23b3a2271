"""Functions and operators on hand-written rows, quirks of the formats, and properties."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

from varlake.functions import statistics as st
from varlake.functions import variants as vt
from varlake.operators import calls, graph, model, reads as rd, scoring, vcf
from varlake.sources import text


def one(spark, column, **values):
    names = [*values]
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for n, v in values.items()) if names else "x int")
    return frame.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("info,want", [("A=1;A=2", {"A": "2"}), ("F;X= a=b ;;", {"F": "", "X": "a=b"}), ("", {})])
def test_info(spark, info, want):
    assert one(spark, vt.info_map(F.col("t")), t=info) == want


@pytest.mark.parametrize("raw,want", [(".", None), ("", None), ("0.1,nan", 0.1), ("nan,0.1", 0.1), ("x,0.2,0.1", 0.2), ("inf", math.inf)])
def test_allele_frequency(spark, raw, want):
    assert one(spark, vt.allele_frequency(F.col("t")), t=raw) == want


@pytest.mark.parametrize("fmt,sample,want", [("GT:FREQ", "0/1:29%", 29 / 100.0), ("AD:DP", "6,2,2:10", 0.4), ("AD:DP", "4:10", 0.4), ("AD:DP", "4:0", None), ("GT", "0/1", None), ("FREQ:AD:DP", ".:5:10", 0.5)])
def test_frequency(spark, fmt, sample, want):
    assert one(spark, vt.variant_frequency(F.col("f"), F.col("s")), f=fmt, s=sample) == want


def test_percent_is_divided_and_multiplied(spark):
    rows = spark.createDataFrame([("29%",), ("30%",)], "s string").select(F.lit("FREQ").alias("format"), F.col("s").alias("sample_text"))
    assert [r["sample_text"] for r in vcf.kept_by_frequency(rows, 29).collect()] == ["29%"]
    assert vcf.kept_by_frequency(rows, None).count() == 2


@pytest.mark.parametrize("key,strict,loose", [("chr1:5_a>t", ("chr1", 5, "A", "T"), ("chr1", "5", "a", "t")), ("HLA:A:3_C>T", None, None), ("1:5-a>t", None, None), ("x:7_<DEL>>A", None, None)])
def test_keys(spark, key, strict, loose):
    got = one(spark, vt.parse_key(F.col("t")), t=key)
    assert (tuple(got) if got else None) == strict
    got = one(spark, vt.parse_key_loose(F.col("t")), t=key)
    assert (tuple(got) if got else None) == loose


@settings(max_examples=15, deadline=None)
@given(some.floats(1e-6, 0.999), some.integers(1, 60), some.floats(0.01, 0.99))
def test_posterior_is_a_probability_that_grows(spark, prior, reads, p):
    a, b = (one(spark, st.reference_posterior(F.col("q"), F.col("r"), p), q=float(prior), r=r) for r in (reads, reads + 1))
    assert 0 <= a <= 1 and b >= a - 1e-12


@settings(max_examples=25, deadline=None)
@given(some.floats(0.01, 1e5))
def test_lgamma(spark, x):
    assert one(spark, st.lgamma(F.col("x")), x=float(x)) == pytest.approx(math.lgamma(x), rel=1e-10, abs=1e-9)


def test_weighted_median(spark):
    rng = random.Random(1)
    rows = [(g, rng.randint(0, 9) / 10, rng.randint(0, 4)) for g in range(5) for _ in range(rng.randint(1, 30))]
    got = {r["g"]: r["weighted_median"] for r in calls.weighted_median(spark.createDataFrame(rows, "g int, v double, w int"), ["g"], "v", "w").collect()}
    for g in range(5):
        own = sorted((v, w) for h, v, w in rows if h == g and w > 0)
        run, want = 0, None
        for v, w in own:
            run += w
            if run >= sum(w for _, w in own) / 2:
                want = v
                break
        assert got.get(g) == want


def greedy(nodes, edges):
    around = {n: set() for n in nodes}
    for a, b in edges:
        around[a].add(b)
        around[b].add(a)
    state = {}
    for n in sorted(nodes, key=lambda n: (-nodes[n][0], nodes[n][1])):
        if n not in state and around[n]:
            state[n] = "kept"
            state.update({m: "removed" for m in around[n] if m not in state})
    return state


def test_thinning_equals_greedy(spark):
    rng = random.Random(3)
    all_edges, all_scores, want = [], [], {}
    for g in range(12):
        n = rng.randint(2, 14)
        nodes = {f"n{i}": (rng.choice([0.1, 0.5, 0.9, float("-inf")]), i) for i in range(n)}
        edges = {(f"n{min(a, b)}", f"n{max(a, b)}") for a, b in (rng.sample(range(n), 2) for _ in range(rng.randint(1, 2 * n)))}
        want |= {(f"c{g}", k): v for k, v in greedy(nodes, edges).items()}
        all_edges += [(f"c{g}", "s", a, b) for a, b in edges]
        all_scores += [(f"c{g}", k, v if math.isfinite(v) else float("nan"), o) for k, (v, o) in nodes.items()]
    states = graph.thinned(spark.createDataFrame(all_edges, "celltype string, sample string, a string, b string"), spark.createDataFrame(all_scores, "celltype string, snv string, score_euclidean double, ord int"))
    rows = [tuple(r) for r in states.collect()]
    assert len(rows) == len(want) and {(c, s): v for c, s, v in rows} == want


def test_softmax_forms_agree(spark):
    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", -2.0)], "cell string, snv string, logit double")
    for f in (scoring.segment_softmax, scoring.clamped_softmax):
        got = {(r["cell"], r["snv"]): r["attention"] for r in f(rows).collect()}
        assert got["a", "y"] == pytest.approx(1 / (1 + math.exp(-2))) and got["b", "x"] == pytest.approx(1)


def test_alignment_explodes_along_the_cigar(spark):
    row = spark.createDataFrame([("r", "chr1", 100, "2S2M1I1D2M1H", "NNACTGA", "IIIIIII")], "name string, chrom string, start int, cigar string, seq string, qual string")
    assert [(r["pos"], r["base"], r["base_q"]) for r in rd.exploded_alignments(row).orderBy("pos").collect()] == [(100, "A", 40), (101, "C", 40), (103, "G", 40), (104, "A", 40)]


def test_missing_quality_is_an_error(spark):
    with pytest.raises(Exception, match="no base quality"):
        rd.kept_by_quality(spark.createDataFrame([(None, 30)], "base_q int, map_q int")).collect()


def test_files(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\n\nchr1\t5\t.\tA\tG\t.\t.\tDP=1\tFREQ\t5%\nchr1\t6\t.\tA\n")
    (tmp_path / "b.bed").write_text("#c\nchr1\t4\t5\nbad\n")
    (tmp_path / "c.fa").write_text(">one x\nac\nGT\n>two\nNN\n")
    (tmp_path / "d.csv").write_text("AA,1,0,0,1.0,1.0\nBB,0,0,0,1.0,1.0\n")
    (tmp_path / "e.tsv").write_text("Chr,Start\n1,5\n")
    (tmp_path / "f.sam").write_text("@HD\nr1\t0\tchr1\t5\t60\t2M\t*\t0\t0\tAC\tII\tCB:Z:AA\tUB:Z:U1\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\n")
    (tmp_path / "g.txt").write_text("chr1\t5\tA\tG\tAA:2,B:x:3\nchr1\t6\tA\tG\t\n")
    records = text.read_vcf(spark, {"s": f"{tmp_path}/a.vcf"})
    assert [(r["chrom"], r["pos"], r["sample_text"], r["sample"]) for r in records.collect()] == [("chr1", 5, "5%", "s")]
    assert vcf.outside_intervals(records, text.read_bed(spark, f"{tmp_path}/b.bed")).count() == 0
    assert {tuple(r) for r in text.read_fasta(spark, f"{tmp_path}/c.fa").collect()} == {("one", "ACGT"), ("two", "NN")}
    assert [r["barcode"] for r in text.read_barcodes(spark, f"{tmp_path}/d.csv", "spatial").collect()] == ["AA"]
    assert text.read_annotation(spark, f"{tmp_path}/e.tsv").columns == ["Chr", "Start"]
    assert [(r["barcode"], r["umi"]) for r in text.read_sam(spark, f"{tmp_path}/f.sam").orderBy("name").collect()] == [("AA", "U1"), (None, None)]
    assert [(r["barcode"], r["n"]) for r in text.read_sidecar(spark, f"{tmp_path}/g.txt").collect()] == [("AA", 2), ("B:x", 3)]
    text.write_vcf(records, f"{tmp_path}/out", ["##h"])
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/out").collect()][0] == "##h"


def test_cells_align_or_fail(spark):
    rna = spark.createDataFrame([("S0_A", 0)], "cell string, ord int")
    snv = spark.createDataFrame([("A", "S0", "A")], "cell string, batch string, barcode string")
    assert scoring.aligned_cells(rna, snv).count() == 1
    with pytest.raises(ValueError, match="no cell in common"):
        scoring.aligned_cells(rna, snv.filter("batch = 'x'"))
    with pytest.raises(Exception, match="given twice"):
        scoring.aligned_cells(rna.union(rna), snv.withColumn("cell", F.lit("S0_A"))).collect()


def test_min_max_of_one_value(spark):
    rows = spark.createDataFrame([(1.0,), (1.0,), (None,)], "s double")
    assert [r["n"] for r in scoring.min_max(rows, "s", "n").collect()] == [0.0, 0.0, None]


def test_rounding_is_no_spread(spark):
    """Cells that carry the same variants have one mean score, whatever the order of its sum."""
    same = [(f"C{i}", "T0", x) for i, x in enumerate([0.34028499653768346, 0.34028499653768384, 0.3402849965376839])]
    rows = spark.createDataFrame([*same, ("C3", "T1", 1e-9), ("C4", "T1", 3e-9), ("C5", "T2", 0.0)], "cell string, celltype string, perturbation double")
    got = {r["cell"]: r["z"] for r in scoring.within_celltype_z(rows).collect()}
    assert got == pytest.approx({"C0": 0, "C1": 0, "C2": 0, "C3": -1, "C4": 1, "C5": 0})


def test_counterfactual_equals_two_full_passes():
    w = model.seeded_weights(6, 4, latent=3, hidden=(5, 4))
    x, snvs, signs = np.array([[1.0, 0, 2, 5, 0, 1]]), np.array([0, 2, 3]), np.array([1.0, -1, 1])
    z = model.encode(w, x)[0][0]
    e, a = model.attend(w, z, snvs)
    flipped = signs * [1, -1, 1]
    full = model.decode(w, (z + model.shift(w, (a * flipped) @ e))[None], np.array([0]))
    short = model.decode(w, (z + model.shift(w, (a * signs) @ e - 2 * a[1] * signs[1] * e[1]))[None], np.array([0]))
    assert np.allclose(full, short)


@pytest.mark.parametrize("clusters", [1, 6])
def test_neighbours_are_exact(spark, clusters):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 4)) + 20 * rng.integers(0, clusters, (240, 1))
    x[:80] = x[0]  # a third of the rows are copies
    rows = graph.nearest_cells(spark.createDataFrame([(f"{i:03d}", v.tolist()) for i, v in enumerate(x)], "cell string, z array<double>"), 5, 40).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["place"]):
        got.setdefault(r["cell"], []).append(r["neighbour"])
    for i in range(240):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        assert got[f"{i:03d}"] == [f"{j:03d}" for j in np.argsort(d, kind="stable") if j != i][:5]


def test_few_or_no_neighbours(spark):
    rows = lambda *n: spark.createDataFrame([(c, [float(i), 0.0]) for i, c in enumerate(n)], "cell string, z array<double>")
    assert graph.nearest_cells(rows()).count() == 0 and graph.nearest_cells(rows("a")).count() == 0
    assert [(r["cell"], r["neighbour"], r["place"]) for r in graph.nearest_cells(rows("a", "b")).orderBy("cell").collect()] == [("a", "b", 1), ("b", "a", 1)]


def test_bases_at_sites_are_those_of_all_bases(spark):
    rows = [(i, "1", 4090 + i, c, "ACGTACGT", "IIIIHHHH") for i, c in enumerate(["8M", "2S6M", "3M2D5M", "2M3I3M", "1M5000N7M"])]
    reads = spark.createDataFrame(rows, "id int, chrom string, start int, cigar string, seq string, qual string")
    sites = spark.createDataFrame([("1", p) for p in (4091, 4095, 4096, 4097, 9098, 9099, 50)] + [("2", 4096)], "chrom string, pos int")
    pick = lambda df: sorted(tuple(r) for r in df.select("id", "chrom", "pos", "base", "base_q").collect())
    want = pick(rd.exploded_alignments(reads).join(sites, ["chrom", "pos"], "left_semi"))
    assert pick(rd.bases_at_sites(reads, sites)) == want and len(want) > 8


def test_depth_counts_reads_that_later_filters_leave_out(spark):
    from varlake.config import CallSettings
    from varlake.plans import dags

    good = [("S1", f"B{i}", f"U{i}", "chr1", p, "G", 40, 60) for p in (10, 20) for i in range(5)]
    poor = [("S1", None, None, "chr1", 20, "G", 40, 60)] * 4 + [("S1", "B9", "U9", "chr1", 20, "G", 40, 0)] * 4  # untagged, or of low mapping quality
    reads = spark.createDataFrame(good + poor, "sample string, barcode string, umi string, chrom string, pos int, base string, base_q int, map_q int")
    record = lambda p: ("S1", 0, p, "chr1", p, ".", "A", "G", ".", "PASS", ".", "GT:FREQ", "0/1:50%")
    vcfs = spark.createDataFrame([record(10), record(20)], "sample string, sample_ix int, line long, chrom string, pos int, id string, ref string, alt string, qual string, filter string, info string, format string, sample_text string")
    cells = spark.createDataFrame([("S1", f"B{i}") for i in range(5)], "sample string, barcode string")
    settings = CallSettings()
    sites = lambda deepest: {r["snv"] for r in dags.call_matrices(reads, vcfs, cells, settings, deepest=deepest).collect()}
    assert len(sites(13)) == 2 and len(sites(10)) == 1


def doublet_counts():
    rng = np.random.default_rng(5)
    base = {"a": rng.poisson([9, 9, 9, 1, 0, 0, 1, 0], (40, 8)), "b": rng.poisson([0, 1, 0, 1, 9, 9, 9, 0], (40, 8))}
    counts = {f"a{i:02d}": r for i, r in enumerate(base["a"])} | {f"b{i:02d}": r for i, r in enumerate(base["b"])}
    counts |= {f"d{i}": base["a"][i] + base["b"][i] for i in range(4)}  # planted doublets
    counts["zero"] = np.zeros(8, int)
    return counts, [("S", c, f"g{g}", float(v)) for c, r in counts.items() for g, v in enumerate(r)] + [(None, "lone", "g0", 2.0), ("T", "one", "g1", 1.0), ("T", "two", "g1", 1.0)]


def test_doublets_equal_brute_force(spark):
    """With as many axes as genes distances are exact, so are the shares of simulated neighbours, up to ties."""
    from varlake.operators import expression
    from varlake.sources.folder import Tables

    counts, rows = doublet_counts()
    rna = spark.createDataFrame(rows, "batch string, cell string, gene string, cnt double")
    made = expression.simulated_doublets(rna.select("batch", "cell").distinct()).filter("batch = 'S'").collect()
    sims: dict = {}
    for r in made:
        sims[r["id"]] = sims.get(r["id"], 0) + counts[r["cell"]]
    assert len(sims) == 2 * len(counts)
    scaled = lambda r: np.log1p(r * 10_000 / max(1, r.sum()))
    points = [(c, False, scaled(r)) for c, r in counts.items()] + [(c, True, scaled(r)) for c, r in sims.items()]
    low, high = {}, {}
    for c, r in counts.items():
        near = sorted((round(((scaled(r) - v) ** 2).sum(), 6), m) for n, m, v in points if m or n != c)
        sure = [m for d, m in near if d < near[14][0]]
        tied = [m for d, m in near if d == near[14][0]]
        left = 15 - len(sure)
        low[c] = (sum(sure) + max(0, left - tied.count(False))) / 15
        high[c] = (sum(sure) + min(left, tied.count(True))) / 15
    with Tables(spark, "doublets") as tables:
        got = {(r["batch"], r["cell"]): r for r in expression.doublet_scores(rna, tables, threshold=0.25).collect()}
    share = {c: got["S", c]["simulated"] for c in counts}
    assert all(low[c] - 1e-9 <= share[c] <= high[c] + 1e-9 for c in counts)
    # in a group, all neighbours are of the group: of three cells of T and none, few
    assert (None, "lone") in got and ("T", "two") in got and len(got) == len(counts) + 3
    scores = spark.createDataFrame([("lone", None, True), ("one", "T", True), ("two", "T", False)], "cell string, batch string, doublet boolean")
    left = {r["cell"] for r in expression.without_doublets(rna, scores).select("cell").distinct().collect()}
    assert left == {*counts, "two"}
    with Tables(spark, "doublets") as tables:
        assert expression.doublet_scores(rna.limit(0), tables).count() == 0


def test_planted_doublets_are_found(spark):
    """Two kinds of cells in many genes and two batches, and doublets of both kinds; the threshold is the valley's."""
    from varlake.operators import expression
    from varlake.sources.folder import Tables

    rng = np.random.default_rng(8)
    kinds = [np.where(rng.random(60) < 0.5, 8.0, 0.3) for _ in range(2)]
    rows, planted = [], set()
    for batch in "ST":
        cells = [(f"{batch}{k}{i}", rng.poisson(kinds[k])) for k in (0, 1) for i in range(120)]
        for i in range(10):
            planted.add(f"{batch}d{i}")
            cells.append((f"{batch}d{i}", rng.poisson(kinds[0]) + rng.poisson(kinds[1])))
        rows += [(batch, c, f"g{g}", float(v)) for c, r in cells for g, v in enumerate(r) if v]
    rna = spark.createDataFrame(rows, "batch string, cell string, gene string, cnt double")
    with Tables(spark, "planted") as tables:
        got = expression.doublet_scores(rna, tables, components=8, k=30).collect()
    called = {r["cell"] for r in got if r["doublet"]}
    assert planted <= called and len(called - planted) <= 25 and len(got) == 500


def test_principal_axes(spark):
    from varlake.operators import expression

    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 20)) * 3 + rng.normal(size=(300, 20)) * 0.1
    x[rng.random(x.shape) < 0.3] = 0
    rows = [([int(j) for j in np.flatnonzero(r)], [float(v) for v in r[r != 0]]) for r in x]
    mean, axes = expression.principal_axes(spark.createDataFrame(rows, "ix array<int>, v array<double>"), 20, 3)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(mean, x.mean(0)) and np.allclose(np.abs((axes * vectors[:, ::-1][:, :3]).sum(0)), 1, atol=1e-3)
    mean, axes = expression.principal_axes(spark.createDataFrame([], "ix array<int>, v array<double>"), 20, 3)
    assert axes.shape == (20, 0)


def test_valley():
    from varlake.operators import expression

    assert expression.valley([9, 30, 12, 3, 1, 2, 8, 20, 9, 1]) == pytest.approx(0.45, abs=0.06)
    assert expression.valley([1, 5, 9, 5, 1]) is None and expression.valley([0] * 10) is None


@pytest.mark.parametrize("piece", [1_000_000, 100])
def test_quantiles_are_exact(spark, monkeypatch, piece):
    """In one piece, and in many of which some hold several groups and some groups several pieces."""
    from varlake.operators import quantiles as module
    from varlake.operators.quantiles import lower_medians, quantiles

    monkeypatch.setattr(module, "PIECE_ROWS", piece)

    rng = random.Random(3)
    rows = [("one", 5.0)] * 7 + [(None, float(i)) for i in range(4)] + [("many", rng.choice([rng.random(), rng.randint(0, 3) / 2])) for _ in range(3000)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"q0": 0.0, "q1": 0.01, "q33": 1 / 3, "q50": 0.5, "q99": 0.99, "q100": 1.0}
    got = {r["g"]: r for r in quantiles(df, ["g"], "v", shares).collect()}
    assert {*got} == {"one", None, "many"}
    for g, r in got.items():
        own = [v for h, v in rows if h == g]
        assert [r[c] for c in shares] == pytest.approx([float(np.quantile(own, q)) for q in shares.values()], abs=1e-12)
    whole = quantiles(df, [], "v", {"m": 0.5}).first()["m"]
    assert whole == pytest.approx(np.median([v for _, v in rows if v is not None]), abs=1e-12)
    medians = {r["g"]: r["median"] for r in lower_medians(df, ["g"], "v").collect()}
    assert medians == {g: sorted(v for h, v in rows if h == g)[(sum(h == g for h, _ in rows) - 1) // 2] for g in got}
    assert quantiles(df.limit(0), [], "v", {"m": 0.5}).count() == 0


def plain_forward(w, x, batch, snvs, signs):
    """Latent, attention, shift and mean of one cell, with loops over lists only."""
    w = {k: v.tolist() for k, v in w.items()}
    through = lambda v, name: [sum(a * row[j] for a, row in zip(v, w[f"{name}.w"])) + b for j, b in enumerate(w[f"{name}.b"])]

    def norm(v, name):
        m = sum(v) / len(v)
        sd = math.sqrt(sum((a - m) ** 2 for a in v) / len(v) + 1e-5)
        return [max(0.0, (a - m) / sd * g + b) for a, g, b in zip(v, w[f"{name}.g"], w[f"{name}.b"])]

    z = through(norm(through(norm(through(x, "enc1"), "ln1"), "enc2"), "ln2"), "mu")
    es = [through([c / (1 + math.exp(-c)) for c in through(z + w["snv"][s], "cond1")], "cond2") for s in snvs]
    logits = [through([math.tanh(t) for t in through(z + e, "attn1")], "attn2")[0] for e in es]
    a = [math.exp(t) / sum(math.exp(u) for u in logits) for t in logits]

    def mean(signs):
        total = [sum(p * s * e[j] for p, s, e in zip(a, signs, es)) for j in range(len(w["cond2.b"]))]
        dz = through(total, "proj")
        h = [max(0.0, t) for t in through([p + q for p, q in zip(z, dz)] + w["batch"][batch], "dec1")]
        return dz, [math.exp(min(t, 20)) for t in through(h, "dec2")]

    return z, a, *mean(signs), [mean([-s if j == i else s for j, s in enumerate(signs)])[1] for i in range(len(signs))]


def test_forward_pass_equals_plain_loops(spark):
    rng = random.Random(4)
    w = model.seeded_weights(5, 6, latent=3, embedding=2, batches=2, batch_embedding=2, hidden=(4, 3))
    w = {k: v + np.random.default_rng(len(k)).normal(0, 0.1, v.shape) for k, v in w.items()}  # biases that are not zero
    cells = {}
    for i in range(150):  # more than one step
        snvs = rng.sample(range(6), rng.choice([0, 1, 3, 6]))
        cells[f"c{i}"] = ([float(rng.randint(0, 9)) for _ in range(5)], rng.randint(0, 1), snvs, [rng.choice([-1, 1]) for _ in snvs])
    df = spark.createDataFrame([(c, b, x, s, g) for c, (x, b, s, g) in cells.items()], "cell string, batch int, x array<double>, snvs array<int>, signs array<int>").coalesce(2)
    want = {c: plain_forward(w, x, b, s, g) for c, (x, b, s, g) in cells.items()}
    near = lambda v: pytest.approx(v, rel=1e-7, abs=1e-9)
    got = {r["cell"]: r for r in model.encoded(df, w).collect()}
    assert {*got} == {*cells} and all(got[c]["z"] == near(want[c][0]) for c in cells)
    pairs = {(r["cell"], r["snv"]): r["attention"] for r in model.attention(df, w).collect()}
    assert pairs == near({(c, s): a for c in cells for s, a in zip(cells[c][2], want[c][1])})
    got = {r["cell"]: r for r in model.reconstructed(df, w).collect()}
    assert {*got} == {*cells} and all(got[c]["shift"] == near(want[c][2]) and got[c]["mean"] == near(want[c][3]) for c in cells)
    scores = {}
    for c, (_, _, _, before, flipped) in want.items():
        for s, after in zip(cells[c][2], flipped):
            length = lambda v: math.sqrt(sum(t * t for t in v))
            scores[c, s] = (1 - sum(p * q for p, q in zip(before, after)) / length(before) / length(after), length([p - q for p, q in zip(before, after)]))
    for chosen in (None, [1, 4]):
        given = None if chosen is None else spark.createDataFrame([(s,) for s in chosen], "snv int")
        rows = {(r["cell"], r["snv"]): (r["score_cosine_distance"], r["score_euclidean"]) for r in model.counterfactuals(df, w, given).collect()}
        kept = {k: v for k, v in scores.items() if chosen is None or k[1] in chosen}
        assert {*rows} == {*kept} and all(rows[k] == near(kept[k]) for k in kept)
    assert model.counterfactuals(df.limit(0), w).count() == 0


def test_by_celltype_equals_a_loop_over_types(spark):
    """Types one after the other in plain loops: attention, the best of it, then the valid ones, then flips of all their carriers."""
    from varlake.sources.folder import Tables

    rng = random.Random(11)
    w = model.seeded_weights(5, 6, latent=3, embedding=2, batches=2, batch_embedding=2, hidden=(4, 3))
    cells, types = {}, {}
    for i in range(170):
        snvs = sorted(rng.sample(range(6), rng.choice([0, 2, 4, 6])))
        cells[f"c{i}"] = ([float(rng.randint(0, 9)) for _ in range(5)], rng.randint(0, 1), snvs, [rng.choice([-1, 1, 1]) if s != 5 else 1 for s in snvs])
        types[f"c{i}"] = "small" if i < 7 else None if i < 10 else rng.choice(["A", "A", "B"])
    plain = {c: plain_forward(w, x, b, s, g) for c, (x, b, s, g) in cells.items()}
    length = lambda v: math.sqrt(sum(t * t for t in v))
    want = {}
    for kind in ("A", "B", "small"):
        own = [c for c in cells if types[c] == kind]
        if len(own) < 20:
            continue
        seen = {s: [plain[c][1][cells[c][2].index(s)] for c in own if s in cells[c][2]] for s in range(6)}
        best = sorted((s for s in seen if seen[s]), key=lambda s: (-sum(seen[s]) / len(seen[s]), s))[:4]
        for s in best:
            signs = [cells[c][3][cells[c][2].index(s)] for c in own if s in cells[c][2]]
            if min(signs.count(1), signs.count(-1)) <= 10:
                continue
            euclid, cosine = [], []
            for c in own:
                if s in cells[c][2]:
                    before, after = plain[c][3], plain[c][4][cells[c][2].index(s)]
                    euclid.append(length([p - q for p, q in zip(before, after)]))
                    cosine.append(1 - sum(p * q for p, q in zip(before, after)) / length(before) / length(after))
            want[kind, s] = (sum(seen[s]) / len(seen[s]), sum(cosine) / len(cosine), sum(euclid) / len(euclid), len(euclid))
    assert len(want) > 3
    df = spark.createDataFrame([(c, b, x, s, g) for c, (x, b, s, g) in cells.items()], "cell string, batch int, x array<double>, snvs array<int>, signs array<int>").repartition(3)
    of = spark.createDataFrame([*types.items()], "cell string, celltype string")
    with Tables(spark, "test") as tables:
        got = {(r["celltype"], r["snv"]): (r["attention"], r["score_cosine_distance"], r["score_euclidean"], r["cells"]) for r in model.by_celltype(df, w, of, tables, 4, 10).collect()}
        assert {*got} == {*want} and all(got[k] == pytest.approx(want[k], rel=1e-7, abs=1e-9) for k in want)
        assert model.by_celltype(df.limit(0), w, of, tables, 4, 10).count() == 0


def test_stages_are_whole_or_not_there(spark, tmp_path):
    from pyspark.errors import PySparkException

    from varlake.sources import stages

    path, rows = f"file://{tmp_path}/stage", spark.range(10)
    bad = spark.range(10).selectExpr("if(id = 7, raise_error('half-way'), id) as id")
    with pytest.raises(PySparkException):
        stages.run_stage(spark, path, {"a": 1}, lambda: {"one": rows, "two": bad})
    assert stages.manifest(spark, path) is None and not stages.finished(spark, path, {"a": 1})
    with pytest.raises(FileNotFoundError):
        stages.read_stage(spark, path)
    (tmp_path / "stage" / "v-killed" / "one").mkdir(parents=True)  # of a driver that was killed
    made = stages.run_stage(spark, path, {"a": 1, "b": 2}, lambda: {"one": rows, "two": rows.limit(3)})
    assert {k: v.count() for k, v in made.items()} == {"one": 10, "two": 3}
    assert len([p for p in (tmp_path / "stage").iterdir() if p.name.startswith("v-")]) == 1
    # settings in another order are the same; others make the stage anew
    assert stages.run_stage(spark, path, {"b": 2, "a": 1}, lambda: 1 / 0)["two"].count() == 3
    with pytest.raises(ZeroDivisionError):
        stages.run_stage(spark, path, {"a": 2}, lambda: 1 / 0)
    assert stages.read_stage(spark, path)["two"].count() == 3
    assert stages.run_stage(spark, path, {"a": 2}, lambda: {"two": rows})["two"].count() == 10


def test_four_places_are_those_of_the_binary_number(spark):
    from varlake.operators.vcf import four_places

    rng = random.Random(12)
    values = [0.0, 1.0, 0.5, 0.00015, 0.00025, 0.00005, 0.99995, 0.12345, 2.00005, 123.45675, 1 / 3, 0.0001, 0.00009999999999999999]
    values += [k / 20_000 for k in range(0, 2000)] + [rng.random() for _ in range(2000)] + [rng.randrange(1, 400) / rng.randrange(1, 400) for _ in range(2000)] + [k / 2**14 for k in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", four_places(model.F.col("v")).alias("t")).collect()
    assert [r["t"] for r in rows] == [f"{r['v']:.4f}" for r in rows]


def test_exact_test_and_normal_tail(spark):
    from varlake.functions.statistics import exact_test, normal_tail

    rng = random.Random(13)
    tables = [(rng.randrange(0, 12), rng.randrange(0, 40), rng.randrange(0, 9), rng.randrange(0, 60)) for _ in range(80)] + [(0, 0, 0, 5), (3, 0, 0, 3), (5, 5, 0, 10)]
    c = model.F.col
    rows = spark.createDataFrame(tables, "a long, b long, c long, d long").withColumn("p", exact_test(c("a"), c("b"), c("c"), c("d"))).collect()
    for r in rows:
        n, hits, first = r["a"] + r["b"] + r["c"] + r["d"], r["a"] + r["c"], r["a"] + r["b"]
        want = sum(math.comb(hits, k) * math.comb(n - hits, first - k) for k in range(r["a"], min(hits, first) + 1)) / math.comb(n, first)
        assert r["p"] == pytest.approx(want, rel=1e-9, abs=1e-14)
    z = [0.0, 0.3, 1.0, 1.9999, 2.0, 3.3, 8.0, 30.0]
    rows = spark.createDataFrame([(v,) for v in z], "z double").withColumn("p", normal_tail(c("z"))).collect()
    assert [r["p"] for r in rows] == pytest.approx([0.5 * math.erfc(v / math.sqrt(2)) for v in z], rel=1e-10)


def test_strand_and_p_value_filters(spark):
    from varlake.operators.vcf import called_variants

    def site(pos, ref, ref_back, alt, alt_back, base="G"):
        return [("S", "c", pos, "A", "A", 16 if i < ref_back else 0) for i in range(ref)] + [("S", "c", pos, "A", base, 16 if i < alt_back else 0) for i in range(alt)]

    rows = site(1, 20, 10, 10, 5) + site(2, 20, 10, 10, 0) + site(3, 20, 0, 10, 0) + site(4, 0, 0, 9, 9) + site(5, 4, 2, 3, 1) + site(6, 20, 10, 2, 1) + site(7, 990, 500, 10, 5) + site(8, 30, 10, 10, 1) + site(9, 20, 10, 9, 4, "N")
    reads = spark.createDataFrame(rows, "sample string, chrom string, pos int, ref string, base string, flag int")
    got = {r["pos"]: r for r in called_variants(reads).collect()}
    assert {*got} == {1, 3, 7, 8} and got[1]["forward"] == 5  # 2 and 4: one strand only, though the reference's reads are not, or are none
    assert {r["pos"] for r in called_variants(reads, one_strand=None).collect()} == {1, 2, 3, 4, 7, 8}
    assert {r["pos"] for r in called_variants(reads, most_p=0.001).collect()} == {1, 3, 8}


def test_markers_equal_plain_loops(spark):
    """All genes of all groups, those without a count in a group too: z, tails, step-up adjustment, and change of means."""
    from varlake.operators import expression

    rng = np.random.default_rng(14)
    labels = {f"c{i}": "AAB"[i % 3] if i % 7 else "D" for i in range(60)}
    dense = {c: np.round(np.log1p(rng.poisson([0.3, 4, 4, 0.0, 1] if g != "B" else [0.3, 9, 2, 0.8, 1])), 6) for c, g in labels.items()}
    values = spark.createDataFrame([(c, f"g{j}", float(v)) for c, r in dense.items() for j, v in enumerate(r) if v], "cell string, gene string, value double")
    rows = expression.markers(values, spark.createDataFrame([*labels.items()], "cell string, grp string"), top=None).collect()
    got = {(r["grp"], r["gene"]): r for r in rows}
    cells, n = [*labels], len(labels)
    want = {}
    for j in range(5):
        x = [dense[c][j] for c in cells]
        ranks = [sum(v < u for v in x) + (sum(v == u for v in x) + 1) / 2 for u in x]
        ties = sum(x.count(v) ** 3 - x.count(v) for v in {*x})
        for g in "ABD":
            own = [i for i, c in enumerate(cells) if labels[c] == g]
            spread = len(own) * (n - len(own)) / 12 * ((n + 1) - ties / (n * (n - 1)))
            z = (sum(ranks[i] for i in own) - len(own) * (n + 1) / 2) / math.sqrt(spread) if spread > 0 else 0.0
            mean = lambda ix: sum(math.expm1(x[i]) for i in ix) / len(ix)
            change = math.log2((mean(own) + 1e-9) / (mean([i for i in range(n) if i not in own]) + 1e-9))
            want[g, f"g{j}"] = (z, math.erfc(abs(z) / math.sqrt(2)), change)
    assert {*got} == {*want}
    for g in "ABD":
        order = sorted((k for k in want if k[0] == g), key=lambda k: (round(want[k][1], 12), k[1]))
        least = 1.0
        for place in range(len(order), 0, -1):
            k = order[place - 1]
            least = min(least, want[k][1] * len(order) / place)
            assert (got[k]["z"], got[k]["p_value"], got[k]["log2_change"], got[k]["p_adjusted"]) == pytest.approx((*want[k], least), rel=1e-8, abs=1e-10)
        assert [k[1] for k in sorted((k for k in got if k[0] == g), key=lambda k: got[k]["place"])] == [k[1] for k in sorted((k for k in want if k[0] == g), key=lambda k: (-round(want[k][0], 9), k[1]))]


def test_preflight(spark, tmp_path):
    from varlake.operators import preflight

    for name in ("a/x.bam", "b/x.bam", "y.vcf", "c.csv"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    files = preflight.files_below(spark, f"file://{tmp_path}")
    assert files.count() == 4
    at = lambda n: f"{tmp_path}/{n}"
    rows = [("S1", at("a/x.bam"), at("y.vcf"), at("c.csv"), None), ("S2", at("b/x.bam"), "  ", at("none.csv"), at("y.vcf"))]
    samples = spark.createDataFrame(rows, "sample string, bam string, vcf string, cb string, annotated_vcf string")
    got = {(r["sample"], r["input"]): r["problem"] for r in preflight.missing_inputs(samples, files, annotated=True).collect()}
    assert got == {("S1", "annotated_vcf"): "not given", ("S2", "vcf"): "not given", ("S2", "cb"): f"no file {at('none.csv')}"}
    assert [tuple(r) for r in preflight.repeated_prefixes(samples).collect()] == [("x", 2)]
    with pytest.raises(FileNotFoundError, match="3 problems.*S2: cb no file.*several samples write x"):
        preflight.checked(samples, files)
    assert preflight.checked(samples.limit(1), files).count() == 1
    assert preflight.missing_inputs(samples.limit(0), files).count() == 0


def test_name_lists(spark, tmp_path):
    from varlake.sources import tables

    rows = [("a", 2, "zwei"), ("a", 1, "eins"), ("b", 5, "größer"), ("b", 7, ""), ("c d", 0, "x" * 300)]
    tables.write_name_lists(spark.createDataFrame(rows, "list string, ix int, name string"), f"{tmp_path}/lists")
    got = sorted(tuple(r) for r in tables.read_name_lists(spark, f"{tmp_path}/lists").collect())
    assert got == [("a", 0, "eins"), ("a", 1, "zwei"), ("b", 0, "größer"), ("b", 1, ""), ("c d", 0, "x" * 300)]
    np.save(tmp_path / "genes.npy", np.array(["g1", "g22"]))
    np.save(tmp_path / "bytes.npy", np.array([b"g1", "ü".encode()]))
    for name, want in (("genes", ["g1", "g22"]), ("bytes", ["g1", "ü"])):
        assert [(r["list"], r["name"]) for r in tables.read_name_lists(spark, f"{tmp_path}/{name}.npy").orderBy("ix").collect()] == [(None, w) for w in want]
    np.save(tmp_path / "numbers.npy", np.array([1, 2]))
    with pytest.raises(Exception, match="not a list of names"):
        tables.read_name_lists(spark, f"{tmp_path}/numbers.npy").collect()

"""Configuration, BAM, the stages end to end on tiny files, and the commands."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from varlake import cli
from varlake.config import CallSettings, as_bool, as_positive, picked, score_suffix
from varlake.plans import dags
from varlake.sources import bam, text

REF = "ACGTACGTACGTACGTACGT"


def sam_lines():
    """Site chr1:5 (A in the reference): cell AA has G in 4 of 6 reads, cell BB only A; site 8 is T everywhere."""
    out = []
    for i in range(12):
        cell, base = ("AA", "G") if i < 4 else ("AA", "A") if i < 6 else ("BB", "A")
        seq = REF[2:4] + base + REF[5:9]
        out.append(("r%02d" % i, 0, "chr1", 3, 60, "7M", seq, "I" * 7, cell, "U%d" % (i % 3)))
    out.append(("dup", 1024, "chr1", 3, 60, "7M", "GTGCGTA", "I" * 7, "BB", "U9"))
    out.append(("low", 0, "chr1", 3, 60, "7M", "GTGCGTA", "#" * 7, "BB", "U9"))
    out.append(("none", 0, "chr1", 3, 60, "7M", "GTGCGTA", "I" * 7, None, None))
    return out


def write_sam(path):
    path.write_text("@HD\tVN:1.6\n" + "".join("\t".join([n, str(f), c, str(p), str(q), g, "*", "0", "0", s, u] + ([f"CB:Z:{cb}", f"UB:Z:{ub}"] if cb else [])) + "\n" for n, f, c, p, q, g, s, u, cb, ub in sam_lines()))


def write_bam(path):
    """A BAM file in members of a few hundred bytes."""
    data = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", len(REF))
    for n, f, c, p, q, g, s, u, cb, ub in sam_lines():
        nib = ["=ACMGRSVTWYHKDBN".index(x) for x in s] + [0]
        body = struct.pack("<iiBBHHHiiii", 0, p - 1, len(n) + 1, q, 0, 1, f, len(s), -1, -1, 0) + n.encode() + b"\0" + struct.pack("<I", 7 << 4)
        body += bytes(nib[i] << 4 | nib[i + 1] for i in range(0, len(s), 2)) + bytes(ord(x) - 33 for x in u)
        body += f"CBZ{cb}\0UBZ{ub}\0".encode() if cb else b""
        data += struct.pack("<i", len(body)) + body
    path.write_bytes(b"".join(bam._block(data[i:i + 200]) for i in range(0, len(data), 200)) + bam.LAST)


def test_bam_equals_sam(spark, tmp_path):
    write_sam(tmp_path / "a.sam")
    write_bam(tmp_path / "a.bam")
    plain, packed = (sorted((tuple(r) for r in f(spark, f"{tmp_path}/a.{e}").collect()), key=repr) for f, e in ((text.read_sam, "sam"), (bam.read_bam, "bam")))
    assert plain == packed and len(plain) == 15


def test_calls_from_files(spark, tmp_path):
    write_bam(tmp_path / "s1.bam")
    (tmp_path / "s1.vcf").write_text("#CHROM\nchr1\t5\t.\tA\tG\t.\t.\tX=1\tGT:FREQ\t0/1:30%\nchr1\t6\t.\tC\tT\t.\t.\tX=1\tGT:FREQ\t0/1:90%\n")
    (tmp_path / "ann.vcf").write_text("chr1\t5\t.\tA\tG\t.\t.\tgnomad41_genome_AF=0.5\n")
    (tmp_path / "cb.csv").write_text("AA\nBB\n")
    base = {"output_dir": f"{tmp_path}/out", "percentage": "50", "default_prior": 0.001}
    sample = {"S1": {"bam": f"{tmp_path}/s1.bam", "vcf": f"{tmp_path}/s1.vcf", "cb": f"{tmp_path}/cb.csv", "annotated_vcf": f"{tmp_path}/ann.vcf"}}
    settings = CallSettings.of({"settings": base, "samples": sample})
    rows = {(r["cell"], r["snv"]): (r["alt_count"], r["ref_count"], r["call"]) for r in dags.run_calls(spark, settings).collect()}
    assert rows == {("S1_AA", "chr1:5_A>G"): (4, 2, 1), ("S1_BB", "chr1:5_A>G"): (0, 6, -1)}
    umis = CallSettings.of({"settings": base | {"count_unit": "umis", "estimate_p_per_sample": "yes"}, "samples": sample})
    assert umis.digest() != settings.digest()
    rows = {r["cell"]: (r["alt_count"], r["ref_count"], r["call"]) for r in dags.run_calls(spark, umis).collect()}
    assert rows == {"S1_AA": (3, 2, 1), "S1_BB": (0, 3, -1)}
    common = CallSettings.of({"settings": base | {"af_filter_enabled": True}, "samples": sample})
    assert dags.run_calls(spark, common).count() == 0
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"settings": base, "samples": sample}))
    cli.main(["calls", str(path)])


def test_variants_command(spark, tmp_path):
    write_sam(tmp_path / "s1.sam")
    (tmp_path / "r.fa").write_text(f">chr1 x\n{REF[:9]}\n{REF[9:]}\n")
    (tmp_path / "e.bed").write_text("chr2\t0\t100\n")
    cli.main(["variants", f"{tmp_path}/s1.sam", "--reference", f"{tmp_path}/r.fa", "--editing", f"{tmp_path}/e.bed", "--out", f"{tmp_path}/o"])
    rows = [(r["chrom"], r["pos"], r["ref"], r["alt"], r["depth"], r["alt_reads"]) for r in spark.read.parquet(f"{tmp_path}/o/s1").collect()]
    assert rows == [("chr1", 5, "A", "G", 13, 5)]
    with pytest.raises(SystemExit):
        cli.main(["variants", "a/s1.sam", "b/s1.bam", "--reference", "r", "--editing", "e", "--out", "o"])


def test_scores_command(spark, tmp_path):
    cells = [(f"c{i}", "T", "S") for i in range(6)]
    matrix = [("S", f"c{i}", s, 1) for i in range(5) for s in ("a", "b")] + [("S", "c5", "x", 1)]
    spark.createDataFrame(matrix, "sample string, cell string, snv string, call int").write.parquet(f"{tmp_path}/m")
    spark.createDataFrame(cells, "cell string, celltype string, sample string").write.parquet(f"{tmp_path}/c")
    spark.createDataFrame([("T", "a", 0.9, 1), ("T", "b", 0.8, 2), ("T", "x", 0.1, 3)], "celltype string, snv string, score_euclidean double, ord int").write.parquet(f"{tmp_path}/s")
    (tmp_path / "k.json").write_text(json.dumps({"scoring": {"min_carrier_cells": 2, "min_shared_cells": 2}}))
    cli.main(["scores", f"{tmp_path}/m", f"{tmp_path}/c", f"{tmp_path}/s", "--config", f"{tmp_path}/k.json", "--out", f"{tmp_path}/o"])
    read = lambda n: spark.read.option("header", True).csv(f"{tmp_path}/o/{n}")
    assert {r["snv"] for r in read("scores").collect()} == {"a", "x"}
    assert [(r["removed_snv"], r["kept_snv"]) for r in read("removed").collect()] == [("b", "a")]
    assert read("cells").filter(F.col("z").isNotNull()).count() == 6


def test_template_and_query(spark, tmp_path):
    cli.main(["template", f"{tmp_path}/t.json"])
    assert CallSettings.of(json.loads((tmp_path / "t.json").read_text())).count_unit == "reads"
    with pytest.raises(SystemExit):
        cli.main(["template", f"{tmp_path}/t.json"])
    cli.main(["template", f"{tmp_path}/t.json", "--force"])
    cli.main(["query", "src_fasta", "/root/testdata/sf0.001", "--out", f"{tmp_path}/q"])
    assert spark.read.parquet(f"{tmp_path}/q").count() == 25


def test_all_problems_in_one_error():
    with pytest.raises(ValueError) as e:
        CallSettings.of({"settings": {"count_unit": "x", "prior_cap": 2, "af_filter_enabled": "maybe", "neg1_prob_threshold": ""}, "samples": {"A": {"bam": "b"}}})
    for part in ("output_dir", "count_unit", "prior_cap", "af_filter_enabled", "samples.A.vcf", "samples.A.cb"):
        assert part in str(e.value)
    assert as_bool("Yes", "x") and not as_bool("", "x") and as_positive("3", "x") == 3
    for bad in (0, "x", True, None):
        with pytest.raises(ValueError):
            as_positive(bad, "x")
    assert picked({"a": {"k": 1}, "k": 2}, "a", "k") == 1 and picked({"k": 2}, "a", "k") == 2 and picked({}, "a", "k", 3) == 3
    assert score_suffix("score_cosine-x") == "cosine_x"

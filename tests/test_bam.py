"""BAM files of all kinds of blocks and splits against the records they were made of."""

import random
import struct

import pytest
from varlake.sources import bam, text

CONTIGS = [("chr1", 10_000), ("chr2", 5_000), ("chrM", 300)]


def alignments(n, seed=1, long=False):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size = rng.choice([0, 1, 20, 51, 150]) if not long else rng.choice([90_000, 3])
        seq = "".join(rng.choice("ACGTN") for _ in range(size))
        qual = None if size == 0 or rng.random() < 0.1 else "".join(chr(rng.randrange(33, 74)) for _ in range(size))
        mapped = rng.random() > 0.05
        tags = rng.choice([("AA-1", "UU"), (None, None), ("CC", None)])
        out.append((f"read{i}:x", rng.choice([0, 16, 4, 1024]), rng.choice(CONTIGS)[0] if mapped else None, rng.randrange(1, 5000) if mapped else 0, rng.randrange(0, 61), f"{size}M" if size else "*", seq, qual, *tags))
    return out


def file_of(rows, block, straddle=True):
    """A file whose records lie across blocks, or not."""
    refs = {c: i for i, (c, _) in enumerate(CONTIGS)}
    head = b"BAM\1" + struct.pack("<i", 4) + b"@CO\n" + struct.pack("<i", 3) + b"".join(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in CONTIGS)
    parts = [head] + [bam._encoded(dict(zip(bam.NAMES, r)), refs) for r in rows]
    if straddle:
        data = b"".join(parts)
        chunks = [data[i:i + block] for i in range(0, len(data), block)]
    else:
        chunks = [p[i:i + block] for p in parts for i in range(0, len(p), block)]
    return b"".join(map(bam._block, chunks)) + bam.LAST


def same(df, rows):
    want = sorted(((*r[:3], r[3], *r[4:]) for r in rows), key=repr)
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == want


@pytest.fixture
def small_splits(spark):
    """Splits of 3 KB."""
    keys = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("block, straddle", [(700, True), (1500, False), (37, True), (60_000, True)])
def test_records_over_blocks_and_splits(spark, tmp_path, small_splits, block, straddle):
    rows = alignments(400 if block > 100 else 60)
    (tmp_path / "a.bam").write_bytes(file_of(rows, block, straddle))
    df = bam.read_bam(spark, f"{tmp_path}/a.bam")
    same(df, rows)
    size = (tmp_path / "a.bam").stat().st_size
    tasks = spark.read.option("encoding", "ISO-8859-1").option("lineSep", bam.BLOCK.decode("latin-1")).text(f"{tmp_path}/a.bam").rdd.getNumPartitions()
    assert tasks >= min(4, size // 3000)


def test_records_longer_than_splits(spark, tmp_path, small_splits):
    rows = alignments(12, 3, long=True) + alignments(30, 4)
    (tmp_path / "a.bam").write_bytes(file_of(rows, 4000))
    same(bam.read_bam(spark, f"{tmp_path}/a.bam"), rows)


def test_several_files_and_regions(spark, tmp_path):
    (tmp_path / "in put").mkdir()
    first, second = alignments(100, 5), alignments(80, 6)
    (tmp_path / "in put" / "a.bam").write_bytes(file_of(first, 900))
    (tmp_path / "in put" / "b.bam").write_bytes(file_of(second, 60_000))
    (tmp_path / "in put" / "none.bam").write_bytes(file_of([], 500))
    same(bam.read_bam(spark, f"{tmp_path}/in put"), first + second)
    regions = [("chr1", 100, 2000), ("chrM", 1, 900)]
    inside = [r for r in first + second if any(r[2] == c and a <= r[3] <= z for c, a, z in regions)]
    same(bam.read_bam(spark, f"{tmp_path}/in put", regions), inside)
    assert 0 < len(inside) < 150


def test_broken_files_are_errors(spark, tmp_path, small_splits):
    whole = file_of(alignments(300), 700)
    cut = whole[:whole.rindex(bam.BLOCK, 0, len(whole) - 2000)]  # at a block, but within a record
    for name, data, error in (("cut", cut, "cut off"), ("other", b"plain text that is no BAM at all", "BGZF"), ("half", whole[:-700], "whole BGZF block|cut off")):
        (tmp_path / f"{name}.bam").write_bytes(data)
        with pytest.raises(Exception, match=error):
            bam.read_bam(spark, f"{tmp_path}/{name}.bam").count()
    with pytest.raises(FileNotFoundError):
        bam.read_bam(spark, f"{tmp_path}/not-there.bam")


def test_written_files_are_read(spark, tmp_path, small_splits):
    rows = alignments(500, 8)
    df = spark.createDataFrame(rows, bam.SCHEMA).repartition(3)
    bam.write_bam(df, f"{tmp_path}/out", CONTIGS, block=800)
    same(bam.read_bam(spark, f"{tmp_path}/out"), rows)
    for part in (tmp_path / "out").glob("part-*"):
        data = part.read_bytes()
        assert data.startswith(bam.BLOCK) and data.endswith(bam.LAST)  # a whole file of its own
        at = 0
        while at < len(data):
            assert data.startswith(bam.BLOCK, at)
            at += struct.unpack_from("<H", data, at + 16)[0] + 1
        assert at == len(data)


def test_tags_of_every_kind():
    tags = b"NMC\x05" + b"XAc\xff" + b"XSs\x01\x02" + b"XIi\0\0\0\0" + b"XFf\0\0\0\0" + b"XXAq" + b"XBBs" + struct.pack("<i", 3) + b"\0" * 6 + b"CBZACGT-1\0" + b"XHHAB\0" + b"UBZTTT\0" + b"CCZCBZno\0"
    assert bam._tags(tags, 0, len(tags)) == {b"CB": "ACGT-1", b"UB": "TTT"}

"""BAM files as DataFrames, split like text.

A BAM file is a sequence of BGZF blocks of at most 64 KB, all of which begin with the same bytes. Taken as a line separator, these
let Spark's text source cut a file of any size, on any store, into splits of whole blocks. A task inflates the blocks of its split one after the
other. Its first record may begin anywhere: the task looks for a place from which everything up to the end of the first blocks reads as records. What lies before
that place belongs to a record of an earlier split, and what is left after the last whole record goes on in a later one; a second, lighter pass
over the blocks gathers these ends, and what they join to must read as whole records, or the file is an error.

Fixed values of the format: the bytes that begin a block (no modification time, unknown system, one extra field), operation letters, base codes
and the end-of-file block.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = bytes([0x1F, 0x8B, 8, 4, 0, 0, 0, 0, 0, 0xFF, 6, 0]) + b"BC" + bytes([2, 0])
LAST = BLOCK + bytes([0x1B, 0, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
CIGAR, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"

SCHEMA = "name string, flag int, chrom string, start int, map_q int, cigar string, seq string, qual string, barcode string, umi string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
KINDS = [pa.int32() if c.endswith("int") else pa.string() for c in SCHEMA.split(", ")]
LARGEST = 1 << 26  # bytes of a record; a larger one is not taken for one
SURE = 1 << 17  # bytes that must read as records before a place counts as the beginning of one
ROWS = 4096
_LETTERS = str.maketrans("0123456789abcdef", BASES)
_QUALITY = bytes(min(q + 33, 255) for q in range(256))


def _inflated(block: bytes) -> bytes:
    """The data of a block without its first bytes."""
    if len(block) + len(BLOCK) != struct.unpack_from("<H", block)[0] + 1:
        raise ValueError("not a whole BGZF block")
    return zlib.decompress(block[2:-8], -15)


def _record_at(data: bytes, at: int, contigs: int) -> int:
    """Where the record at a place ends if one may be there, else -1; beyond the data where it is cut off."""
    if at + 36 > len(data):
        return len(data) + 1
    size, ref, pos, n_name, _, _, n_ops, _, n_seq, other, other_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not (32 <= size <= LARGEST and -1 <= ref < contigs and pos >= -1 and n_name and n_seq >= 0 and -1 <= other < contigs and other_pos >= -1):
        return -1
    if 32 + n_name + 4 * n_ops + (n_seq + 1) // 2 + n_seq > size:
        return -1
    name = data[at + 36:at + 36 + n_name]
    if len(name) == n_name and (name[-1] or not all(33 <= c <= 126 for c in name[:-1])):
        return -1
    for i in range(n_ops):
        o = at + 36 + n_name + 4 * i
        if o < len(data) and data[o] & 15 > 8:
            return -1
    return at + 4 + size


def _first_record(data: bytes, contigs: int, whole: bool) -> int:
    """The first place from which the data reads as records to its end; -1 if there is none. Without `whole` more data follows it."""
    for at in range(len(data)):
        end, n = at, 0
        while 0 <= end < len(data):
            end = _record_at(data, end, contigs)
            n += 1
        if end >= 0 and (n > 1 or end <= len(data)) and (whole or end - at >= min(SURE, len(data)) // 2):
            return at
    return -1


def _decoded(data: bytes, at: int, end: int, contigs: list[str]) -> tuple:
    ref, pos, n_name, map_q, _, n_ops, flag, n_seq = struct.unpack_from("<iiBBHHHi", data, at + 4)
    at += 36
    name = data[at:at + n_name - 1].decode()
    at += n_name
    ops = struct.unpack_from(f"<{n_ops}I", data, at)
    at += 4 * n_ops
    seq = data[at:at + (n_seq + 1) // 2].hex().translate(_LETTERS)[:n_seq]
    at += (n_seq + 1) // 2
    qual, tags = data[at:at + n_seq], _tags(data, at + n_seq, end)
    cigar = "".join([f"{o >> 4}{CIGAR[o & 15]}" for o in ops]) or "*"
    return (name, flag, contigs[ref] if ref >= 0 else None, pos + 1, map_q, cigar, seq, None if qual[:1] in (b"", b"\xff") else qual.translate(_QUALITY).decode("latin-1"), tags.get(b"CB"), tags.get(b"UB"))


_WIDTH = {ord(c): n for c, n in zip("AcCsSiIf", (1, 1, 1, 2, 2, 4, 4, 4))}


def _tags(data: bytes, at: int, end: int) -> dict[bytes, str]:
    """The text tags of a record that are barcodes."""
    out: dict[bytes, str] = {}
    while at + 3 <= end:
        tag, kind = data[at:at + 2], data[at + 2]
        at += 3
        if kind in b"ZH":
            stop = data.index(b"\0", at, end)
            if tag in (b"CB", b"UB") and stop > at:
                out[tag] = data[at:stop].decode()
            at = stop + 1
        elif kind == ord("B"):
            at += 5 + _WIDTH[data[at]] * struct.unpack_from("<i", data, at + 1)[0]
        else:
            at += _WIDTH[kind]
    return out


def _place(path: str) -> str:
    """A path however its scheme is written."""
    return re.sub(r"^([a-z0-9]+):/+", r"\1:/", unquote(path))


class Header:
    """Of one file: names of contigs, and how many bytes of inflated data it takes."""

    def __init__(self, contigs: list[str], size: int):
        self.contigs, self.size = contigs, size

    @classmethod
    def of(cls, data: bytes) -> Header | None:
        """None if the data is too short."""
        if len(data) >= 4 and data[:4] != b"BAM\1":
            raise ValueError("not a BAM file")
        try:
            at = 12 + struct.unpack_from("<i", data, 4)[0]
            contigs = []
            for _ in range(struct.unpack_from("<i", data, at - 4)[0]):
                n = struct.unpack_from("<i", data, at)[0]
                contigs.append(data[at + 4:at + 3 + n].decode())
                at += 8 + n
        except struct.error:
            return None
        return cls(contigs, at) if at <= len(data) else None


def headers(spark: SparkSession, path: str) -> dict[str, Header]:
    """By file. Only the first blocks of each are read, by the driver; they name the contigs, whatever the file's size."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, out = at.getFileSystem(spark._jsc.hadoopConfiguration()), {}
    found = fs.globStatus(at)
    if not found:
        raise FileNotFoundError(path)
    files = [f for s in found for f in (fs.listStatus(s.getPath()) if s.isDirectory() else [s])]
    for f in files:
        if f.isDirectory() or f.getPath().getName().startswith(("_", ".")) or not f.getLen():
            continue
        stream, held, data, header = fs.open(f.getPath()), b"", b"", None
        try:
            while header is None:
                more = bytes(stream.readNBytes(1 << 18))
                held += more
                if held and not held.startswith(BLOCK):
                    raise ValueError(f"{f.getPath()} is not in BGZF blocks")
                while len(held) >= 18 and len(held) > (size := struct.unpack_from("<H", held, 16)[0]):
                    data, held = data + _inflated(held[len(BLOCK):size + 1]), held[size + 1:]
                header = Header.of(data)
                if header is None and not more:
                    raise ValueError(f"{f.getPath()} ends within its header")
        finally:
            stream.close()
        out[_place(f.getPath().toString())] = header
    return out


class _Split:
    """The inflated data of one split, record by record. Blocks are fed in order."""

    def __init__(self, header: Header, first: bool):
        self.contigs, self.data, self.skip, self.head = header.contigs, bytearray(), header.size if first else 0, b""
        self.synced = first

    def feed(self, block: bytes) -> None:
        self.data += _inflated(block)
        if self.skip:
            n = min(self.skip, len(self.data))
            del self.data[:n]
            self.skip -= n

    def spans(self, last: bool) -> Iterator[tuple[bytes, int, int]]:
        """(data, begin, end) of the whole records that have come in; `last`: nothing more will."""
        if not self.synced:
            if len(self.data) < SURE and not last:
                return
            at = _first_record(bytes(self.data), len(self.contigs), last)
            if at < 0:
                return
            self.synced, self.head = True, bytes(self.data[:at])
            del self.data[:at]
        data, at = bytes(self.data), 0
        while at + 4 <= len(data) and (end := at + 4 + struct.unpack_from("<i", data, at)[0]) <= len(data):
            if _record_at(data, at, len(self.contigs)) != end:
                raise ValueError("a BAM record does not read as one")
            yield data, at, end
            at = end
        del self.data[:at]


def _splits(batches: Iterator[pa.RecordBatch], found: dict[str, Header]) -> Iterator[tuple[str, int, _Split, bool]]:
    """(file, begin, split, whether all of it has come in) whenever blocks have come in."""
    now, split = None, None
    for b in batches:
        for file, begin, block in zip(b["file"].to_pylist(), b["begin"].to_pylist(), b["block"]):
            if (file, begin) != now:
                if split is not None:
                    yield *now, split, True
                now, split = (file, begin), _Split(found[_place(file)], begin == 0)
            if len(block := block.as_py()):
                split.feed(block)
                if len(split.data) >= SURE:
                    yield *now, split, False
    if split is not None:
        yield *now, split, True


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], names=NAMES)


def read_bam(spark: SparkSession, path: str, regions: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """The columns of read_sam(). regions: (chrom, first, last) of which one must hold a record's start; others are passed over before they are
    decoded. A file is as many tasks as it has splits (spark.sql.files.maxPartitionBytes); a task holds a split's blocks and one of them inflated."""
    found = headers(spark, path)
    text = spark.read.option("encoding", "ISO-8859-1").option("lineSep", BLOCK.decode("latin-1")).text(path)
    blocks = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.col("value").cast("binary").alias("block"))

    def inside(data: bytes, at: int, contigs: list[str]) -> bool:
        ref, pos = struct.unpack_from("<ii", data, at + 4)
        return regions is None or ref >= 0 and any(c == contigs[ref] and a <= pos + 1 <= z for c, a, z in regions)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for _, _, split, last in _splits(batches, found):
            for data, at, end in split.spans(last):
                if inside(data, at, split.contigs):
                    rows.append(_decoded(data, at, end, split.contigs))
                if len(rows) == ROWS:
                    yield _columns(rows)
                    rows = []
        if rows:
            yield _columns(rows)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, begin, split, last in _splits(batches, found):
            for _ in split.spans(last):
                pass
            if last:
                head, tail = (split.head, bytes(split.data)) if split.synced else (bytes(split.data), b"")
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([begin], pa.int64()), pa.array([int(split.synced)], pa.int32()), pa.array([head], pa.binary()), pa.array([tail], pa.binary())], names=["file", "begin", "synced", "head", "tail"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, parts in zip(b["file"].to_pylist(), b["parts"].to_pylist()):
                data, header, at, rows = b"".join(p["bytes"] for p in parts), found[_place(file)], 0, []
                while at < len(data):
                    end = _record_at(data, at, len(header.contigs))
                    if not at < end <= len(data):
                        raise ValueError(f"records of {file} do not fit together between splits, or it is cut off")
                    if inside(data, at, header.contigs):
                        rows.append(_decoded(data, at, end, header.contigs))
                    at = end
                if rows:
                    yield _columns(rows)

    # what a split leaves over goes on in the heads of the next ones, up to the first that holds the beginning of a record
    pieces = blocks.mapInArrow(ends, "file string, begin long, synced int, head binary, tail binary")
    upto = F.sum("synced").over(Window.partitionBy("file").orderBy("begin"))
    both = pieces.withColumn("run", upto).select("file", F.explode(F.array(
        F.struct((F.col("run") - F.col("synced")).alias("run"), "begin", F.lit(0).alias("k"), F.col("head").alias("bytes")),
        F.struct(F.col("run").alias("run"), "begin", F.lit(1).alias("k"), F.col("tail").alias("bytes")))).alias("p"))
    runs = both.filter(F.length("p.bytes") > 0).groupBy("file", "p.run").agg(F.array_sort(F.collect_list(F.struct("p.begin", "p.k", "p.bytes"))).alias("parts"))
    return blocks.mapInArrow(records, SCHEMA).union(runs.select("file", "parts").mapInArrow(joined, SCHEMA))


def _encoded(r: dict, refs: dict[str, int]) -> bytes:
    name, seq = r["name"].encode() + b"\0", r["seq"] or ""
    ops = [(int(n), CIGAR.index(o)) for n, o in re.findall(f"([0-9]+)([{CIGAR}])", r["cigar"] or "")]
    codes = [max(0, BASES.find(c)) for c in seq] + [0]
    body = struct.pack("<iiBBHHHiiii", refs[r["chrom"]] if r["chrom"] is not None else -1, r["start"] - 1, len(name), r["map_q"], 0, len(ops), r["flag"], len(seq), -1, -1, 0)
    body += name + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
    body += bytes(ord(q) - 33 for q in r["qual"]) if r["qual"] is not None else b"\xff" * len(seq)
    body += b"".join(t + b"Z" + r[c].encode() + b"\0" for t, c in ((b"CB", "barcode"), (b"UB", "umi")) if r[c] is not None)
    return struct.pack("<i", len(body)) + body


def _block(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = packer.compress(data) + packer.flush()
    return BLOCK + struct.pack("<H", len(packed) + len(BLOCK) + 9) + packed + struct.pack("<II", zlib.crc32(data), len(data))


def write_bam(alignments: DataFrame, path: str, contigs: list[tuple[str, int]], block: int = 60_000) -> None:
    """A whole BAM file for each partition, in its order. contigs: (name, length), in the order of the header. The text sink writes
    rows of blocks with the end-of-file block, which is empty, between them and after the last."""
    refs = {c: i for i, (c, _) in enumerate(contigs)}
    listed = b"".join(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in contigs)
    text = "".join(f"@SQ\tSN:{c}\tLN:{n}\n" for c, n in contigs).encode()
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs)) + listed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, blocks = head, []
        for b in batches:
            for r in b.to_pylist():
                data += _encoded(r, refs)
                while len(data) >= block:
                    blocks.append(_block(data[:block]))
                    data = data[block:]
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], names=["value"])
                blocks = []
        yield pa.RecordBatch.from_arrays([pa.array([_block(data)] if data else [], pa.binary())], names=["value"])

    rows = alignments.select(*NAMES).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    rows.write.option("encoding", "ISO-8859-1").option("lineSep", LAST.decode("latin-1")).text(path)

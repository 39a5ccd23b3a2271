"""Content-addressed WARC archive.

An archive is a folder with two tables. `payloads` holds each distinct payload once under its SHA-256 address;
`headers` holds the exact header block of every record with the address of its payload. read_records() joins the two
and gives back the original record bytes; it recomputes the address of every payload it reads and fails on a mismatch.

Defined results: a null payload counts as empty; a null URI leaves out WARC-Target-URI; repeated rows are repeated
records; among equal payloads, rows that tie for the largest id are all responses; a null id is smaller than any other.
Columns beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, table

DATE = "2024-01-01T00:00:00Z"  # fixed, so that an archive is the same whenever it is written
# Fixed values of RFC 4648: digits of base 32 as conv() writes them, and the alphabet that the RFC names.
CONV_DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: 160 bits are 4 times 10 hex digits, each 8 digits of base 32."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32)


def _text(data: Column) -> Column:
    return F.decode(data, "utf-8")


def plan_records(pages: DataFrame, scratch: Scratch, id_col: str, uri_col: str, payload: Column) -> tuple[DataFrame, DataFrame]:
    """(records with exact header blocks, the rows' ids and addresses)."""
    light = pages.select(
        F.col(id_col).cast("long").alias("rid"),
        F.col(uri_col).cast("string").alias("uri"),
        F.sha2(payload, 256).alias("address"),
        base32_sha1(payload).alias("sha1"),
        F.octet_length(payload).cast("long").alias("n"),
    )
    light = scratch.save(light, "light")
    # written before the join, so that the join shuffles both sides and AQE can split a payload that many rows share
    winners = scratch.save(light.groupBy("address").agg(F.max("rid").alias("winner")), "winners")
    joined = light.join(winners, "address")
    first = F.col("rid").eqNullSafe(F.col("winner"))
    uid = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(first, "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: "), uid(F.col("rid")), F.lit(f"\r\nWARC-Date: {DATE}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.regexp_replace("uri", "[\r\n]", " ")), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(first, "").otherwise(F.concat(F.lit("\r\nWARC-Refers-To: "), uid(F.col("winner")),
                                             F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(first, F.col("n")).otherwise(0).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return joined.select("rid", "address", header.alias("header")), light


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> None:
    """Write one record per row to the archive at `path`. Only payloads that several rows share are shuffled, after a
    map-side step that keeps one copy per task; the table of their addresses is written first, so that Spark knows its
    size: it is broadcast if small and joined by a shuffle if not."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    records, light = plan_records(pages, scratch, id_col, uri_col, payload)
    records.write.option("compression", "zstd").parquet(f"{path}/headers")
    shared = scratch.save(light.groupBy("address").agg(F.count("*").alias("copies")).filter("copies > 1").select("address"), "shared")
    stored = pages.select(F.sha2(payload, 256).alias("address"), payload.alias("payload"))
    once = stored.join(shared, "address", "left_anti")
    many = stored.join(shared, "address", "left_semi").groupBy("address").agg(F.first("payload").alias("payload"))
    once.unionByName(many).write.option("compression", "zstd").parquet(f"{path}/payloads")
    scratch.drop("light", "winners", "shared")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """header, payload (of revisits too: that of the record they refer to), block (what the record itself carries) and
    record (its exact bytes). A payload that does not have its address raises an error."""
    headers = spark.read.schema("rid long, address string, header string").parquet(f"{path}/headers")
    payloads = spark.read.schema("address string, payload binary").parquet(f"{path}/payloads")
    checked = payloads.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload is damaged: "), "address")).cast("binary")))
    joined = headers.join(checked, "address")
    block = F.when(F.col("header").contains("WARC-Type: response\r\n"), F.col("payload")).otherwise(F.lit(b""))
    return joined.select("header", "payload", block.alias("block"),
                         F.concat(F.encode("header", "utf-8"), block, F.lit(b"\r\n\r\n")).alias("record"))


def write_warc_files(records: DataFrame, path: str, records_per_file: int = 5000) -> None:
    """The records as plain .warc files: the line separator of Spark's text writer is the end of a record."""
    exact = F.concat(F.encode("header", "utf-8"), F.col("block")).cast("string")
    records.select(exact.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(path)


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """header and block of each record of the .warc files below `path`; a file is read by one task, so
    write_warc_files() bounds its size."""

    def parse(batches):
        import pandas as pd

        for batch in batches:
            for data in batch["content"]:
                rows, at = [], 0
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at) + 4
                    header = data[at:end].decode("utf-8")
                    size = int(header.lower().split("\r\ncontent-length:")[1].split("\r\n")[0])
                    rows.append((header, data[end:end + size]))
                    at = end + size + 4
                yield pd.DataFrame(rows, columns=["header", "block"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInPandas(parse, "header string, block binary")


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "archive").path("records")
    write_archive(table(spark, sf_dir, "pages"), path)
    field = lambda name, what: F.regexp_extract("header", f"\r\n{name}: {what}", 1)
    return read_records(spark, path).select(
        field("WARC-Record-ID", "<urn:record:(-?[0-9]*)").try_cast("long").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        field("WARC-Refers-To", "<urn:record:(-?[0-9]*)").try_cast("long").alias("refers_to"),
    )


_PART = "(select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((v >> (5 * (7 - i))) & 31 as int) + 1, 1), '' order by i) from range(8) r(i))"
WARC_SQL = f"""
with p as (select page_id, coalesce(html, '') h from pages),
d as (select page_id, octet_length(encode(h)) n, sha1(h) s, h, max(page_id) over (partition by h) w from p),
x as (select *, cast('0x' || substr(s, 1, 10) as bigint) v0, cast('0x' || substr(s, 11, 10) as bigint) v1,
  cast('0x' || substr(s, 21, 10) as bigint) v2, cast('0x' || substr(s, 31, 10) as bigint) v3 from d)
select page_id, cast(n as bigint) payload_bytes,
  {" || ".join(_PART.replace("v >>", f"v{i} >>") for i in range(4))} payload_digest,
  case when page_id = w then 'response' else 'revisit' end record_type,
  case when page_id = w then null else w end refers_to
from x"""

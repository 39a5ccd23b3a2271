"""Shards by a hierarchical weighted hash tree, with DataFrame functions only.

A layout is a tree of regions, racks and shards with weights; an inner node weighs as much as its leaves. At each level
every child draws -ln(u) / weight, with u a hash of the row's key and the child's path, and the smallest draw wins. When
the weight of a child grows, its draw shrinks and the others' stay: rows move only into the subtree that grew. grow() adds
a shard in a region of its own, so that one more shard takes rows into itself alone; a shard added inside a region
confines the moves to that region.

Slots number a shard's rows from 0 without gaps: rows are dealt to ranges of a hash of all that they have, counted per range, and numbered
within the range from the range's offset, so no task sorts a whole shard. Rows that agree in everything are one until they have their slots, so
that neither an id nor a row that is repeated very often fills a range.

Defined results: a null key draws as an empty string; a null text has no bytes; repeated rows get slots of their own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, copied, table

SHARDS, REGION, RACK, RANGE_ROWS = 16, 8, 4, 2000
Layout = dict[int, dict[int, dict[int, float]]]  # region, rack, shard: weight


def layout(shards: int, region: int = REGION, rack: int = RACK) -> Layout:
    tree: Layout = {}
    for s in range(shards):
        tree.setdefault(s // region, {}).setdefault(s % region // rack, {})[s] = 1.0
    return tree


def grow(tree: Layout, weight: float = 1.0) -> Layout:
    new = 1 + max(s for racks in tree.values() for leaves in racks.values() for s in leaves)
    return tree | {max(tree) + 1: {0: {new: weight}}}


def uniform(text: Column) -> Column:
    """The first 52 bits of the MD5 as a number in (0, 1)."""
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def _drawn(key: Column, path: str, weights: dict[int, float]) -> Column:
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    draws = [F.struct((-F.ln(uniform(F.concat(key, F.lit(f"|{path}{c}")))) / w).alias("d"), F.lit(c).alias("c")) for c, w in weights.items()]
    return F.array_min(F.array(*draws))["c"]


def with_shard(rows: DataFrame, key: Column, tree: Layout, out: str) -> DataFrame:
    """rows with the shard of the tree that their key descends to."""
    leaves = lambda t: sum(t.values()) if not isinstance(next(iter(t.values())), dict) else sum(map(leaves, t.values()))
    key = F.coalesce(key.cast("string"), F.lit(""))
    rows = rows.withColumn("tree_region", _drawn(key, "", {r: leaves(t) for r, t in tree.items()}))
    of = lambda pairs: F.coalesce(*(F.when(c, e) for c, e in pairs))
    rows = rows.withColumn("tree_rack", of([(F.col("tree_region") == r, _drawn(key, f"{r}/", {k: leaves(t) for k, t in racks.items()})) for r, racks in tree.items()]))
    at = lambda r, k: (F.col("tree_region") == r) & (F.col("tree_rack") == k)
    shard = of([(at(r, k), _drawn(key, f"{r}/{k}/", own)) for r, racks in tree.items() for k, own in racks.items()])
    return rows.withColumn(out, shard.cast("int")).drop("tree_region", "tree_rack")


def with_slots(rows: DataFrame, scratch: Scratch, shard: str, place: Column, ties: list[str], copies: str | None = None) -> DataFrame:
    """rows with slot: their place in the shard by `place` (a number in (0, 1)) and ties. copies: a column that says how many rows each one stands
    for; it is expanded, and goes."""
    times = F.col(copies) if copies else F.lit(1)
    ranges = max(1, -(-rows.count() // (SHARDS * RANGE_ROWS)))
    rows = scratch.save(rows.withColumn("slot_place", place).withColumn("slot_range", F.floor(F.col("slot_place") * ranges).cast("long")), "placed")
    counts = rows.groupBy(shard, "slot_range").agg(F.sum(times).alias("slot_n"))
    before = F.sum("slot_n").over(Window.partitionBy(shard).orderBy("slot_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("slot_n")
    offsets = counts.select(shard, "slot_range", before.alias("slot_before"))
    offsets = scratch.save(offsets, "offsets")
    upto = F.sum(times).over(Window.partitionBy(shard, "slot_range").orderBy("slot_place", *ties).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("slot_within", upto - times).join(offsets, [shard, "slot_range"]).withColumn("slot", (F.col("slot_before") + F.col("slot_within")).cast("long")).drop("slot_place", "slot_range", "slot_within", "slot_n", "slot_before")
    return copied(out, copies, "slot").drop(copies) if copies else out


def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))  # rows that agree are one until they have their slots
    tree = layout(SHARDS)
    rows = with_shard(with_shard(rows, F.col("doc_id"), tree, "shard"), F.col("doc_id"), grow(tree), "grown_shard")
    place = uniform(F.concat_ws("|", F.lit("slot"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"), F.col("size").cast("string")))
    placed = with_slots(rows, Scratch(spark, "sharding"), "shard", place, ["doc_id", "text_crc32", "size"], "copies")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def sharding_sql() -> str:
    """The same draws in DuckDB. Its CRC-32 is computed from a table made by the polynomial's rule."""
    key = "coalesce(cast(doc_id as varchar), '')"
    uni = lambda t: f"((cast('0x' || substr(md5({t}), 1, 13) as bigint) + 0.5) / 4503599627370496.0)"

    def drawn(path: str, weights: dict[int, float]) -> str:
        if len(weights) == 1:
            return str(next(iter(weights)))
        return "list_sort([" + ", ".join(f"{{'d': -ln({uni(f"{key} || '|{path}{c}'")}) / {w}, 'c': {c}}}" for c, w in weights.items()) + "])[1].c"

    def shard(tree: Layout) -> str:
        leaves = lambda t: sum(t.values()) if not isinstance(next(iter(t.values())), dict) else sum(map(leaves, t.values()))
        racks = lambda r, t: "case " + drawn(f"{r}/", {k: leaves(own) for k, own in t.items()}) + " " + " ".join(f"when {k} then {drawn(f'{r}/{k}/', own)}" for k, own in t.items()) + " end"
        return f"case {drawn('', {r: leaves(t) for r, t in tree.items()})} " + " ".join(f"when {r} then {racks(r, t)}" for r, t in tree.items()) + " end"

    tree = layout(SHARDS)
    step = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    return f"""
with recursive bits as (select i, cast(i as bigint) c, 0 n from range(256) t(i) union all select i, {step}, n + 1 from bits where n < 8),
crc as (select list(c order by i) t from bits where n = 8),
d as (select doc_id, coalesce(text, '') x from documents),
h as (select doc_id, octet_length(encode(x)) + 1 size, hex(encode(x)) b,
  list_reduce(list_concat([4294967295], list_transform(range(1, octet_length(encode(x)) + 1), lambda i: cast('0x' || substr(hex(encode(x)), cast(2 * i - 1 as int), 2) as bigint))),
    lambda a, v: xor(a >> 8, t[cast(xor(a, v) & 255 as int) + 1])) r
  from d, crc),
s as (select doc_id, size, xor(r, 4294967295) text_crc32, {shard(tree)} shard, {shard(grow(tree))} grown_shard,
  {uni(f"'slot|' || {key} || '|' || cast(xor(r, 4294967295) as varchar) || '|' || cast(size as varchar)")} place from h)
select doc_id, cast(size as bigint) size, cast(text_crc32 as bigint) text_crc32, 'key' law, cast(shard as int) shard,
  cast(row_number() over (partition by shard order by place, doc_id, text_crc32, size) - 1 as bigint) slot, cast(grown_shard as int) grown_shard
from s"""

"""Exact quantiles of groups of any size.

Values are counted and written once. The counts are dealt by ranges of (group, value) into pieces of about PIECE_ROWS rows; the sums of the pieces tell
in which piece of a group a wanted rank lies, and only there a running sum is taken. No task holds more than a piece, whatever a group has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folder import Tables, kept

PIECE_ROWS = 1_000_000


def _key(by: list[str]) -> Column:
    """A struct, so that groups with nulls in their keys meet in joins."""
    return F.struct(*by) if by else F.struct(F.lit(0).alias("whole"))


def _reached(counts: DataFrame, wanted: Callable[[Column], Column]) -> DataFrame:
    """g, n, name, part, v: the smallest value of a group at which the running weight reaches `part`. counts: (g, v, k), a row
    per value of a group. wanted: from the group's whole weight to an array of structs (name, part)."""

    def make(tables: Tables) -> DataFrame:
        held = tables.save(counts, "counts")
        pieces = max(1, -(-held.count() // PIECE_ROWS))
        placed = held.withColumn("piece", F.lit(0))
        if pieces > 1:
            placed = tables.save(held.repartitionByRange(pieces, "g", "v").withColumn("piece", F.spark_partition_id()), "placed")
        # at most as many rows of a group as there are pieces
        run = Window.partitionBy("g").orderBy("piece")
        sizes = placed.groupBy("g", "piece").agg(F.sum("k").alias("own")).withColumn("upto", F.sum("own").over(run)).withColumn("n", F.sum("own").over(Window.partitionBy("g")))
        parts = sizes.withColumn("w", F.explode(wanted(F.col("n")))).filter((F.col("w.part") <= F.col("upto")) & ((F.col("w.part") > F.col("upto") - F.col("own")) | (F.col("upto") == F.col("own"))))
        found = parts.groupBy(F.col("g").alias("hit_g"), F.col("piece").alias("hit_piece"), "n", (F.col("upto") - F.col("own")).alias("before")).agg(F.collect_list("w").alias("parts"))
        inner = placed.join(found, (F.col("g") == F.col("hit_g")) & (F.col("piece") == F.col("hit_piece")))
        inner = inner.withColumn("reached", F.col("before") + F.sum("k").over(Window.partitionBy("g", "piece").orderBy("v")))
        each = inner.select("g", "n", "v", "reached", F.explode("parts").alias("p")).filter(F.col("p.part") <= F.col("reached"))
        return each.groupBy("g", "n", F.col("p.name").alias("name"), F.col("p.part").alias("part")).agg(F.min("v").alias("v"))

    return kept(counts.sparkSession, "quantiles", make)


def _counted(rows: DataFrame, by: list[str], value: str | Column, weight: str | Column | None = None) -> DataFrame:
    v = F.col(value) if isinstance(value, str) else value
    k = F.lit(1) if weight is None else F.col(weight) if isinstance(weight, str) else weight
    rows = rows.select(_key(by).alias("g"), v.alias("v"), k.alias("k")).filter("v is not null and k > 0")
    return rows.groupBy("g", "v").agg(F.sum("k").alias("k"))


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and a column per share: the quantile with linear interpolation between neighbours. Nulls do not count; a group
    without values has no row. Null keys are groups of their own; without keys, the whole table is one group."""
    at = lambda n, q: F.lit(float(q)) * (n - 1)
    part = lambda name, rank: F.struct(F.lit(name).alias("name"), (rank + 1).cast("double").alias("part"))
    names = [*shares]
    wanted = lambda n: F.array(*(part(f"{side}{i}", how(at(n, shares[c]))) for i, c in enumerate(names) for side, how in (("low", F.floor), ("high", F.ceil))))
    found = _reached(_counted(rows, by, F.col(value).cast("double")), wanted)
    ends = found.groupBy("g", "n").agg(*(F.max(F.when(F.col("name") == f"{side}{i}", F.col("v"))).alias(f"{side}{i}") for i in range(len(names)) for side in ("low", "high")))

    def between(i: int, q: float) -> Column:
        p, low, high = at(F.col("n"), q), F.col(f"low{i}"), F.col(f"high{i}")
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return ends.select(*(F.col("g")[c].alias(c) for c in by), *(between(i, q).alias(c) for i, (c, q) in enumerate(shares.items())))


def lower_medians(rows: DataFrame, by: list[str], value: str, weight: str | None = None, out: str = "median") -> DataFrame:
    """by, out: the smallest value at which half of the weight (by default: of the rows) is reached."""
    half = lambda n: F.array(F.struct(F.lit("half").alias("name"), (n / 2).cast("double").alias("part")))
    return _reached(_counted(rows, by, value, weight), half).select(*(F.col("g")[c].alias(c) for c in by), F.col("v").alias(out))


def running(rows: DataFrame, by: list[str], order: list[str], weight: str, out: str = "running") -> DataFrame:
    """rows with the weight that has been reached at each of them, in its group and order; rows that are alike in the order follow each other in
    that of all columns, so that each has a weight of its own. A group is in one task; lower_medians() and quantiles() need none."""
    window = Window.partitionBy(*by).orderBy(*order, *(c for c in rows.columns if c not in (*by, *order))).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.sum(weight).over(window))

"""Whole groups of rows in Python tasks, many at a time, so that small groups cost no call each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_ROWS = 4096


def by_group(rows: DataFrame, *keys: str, order: tuple[str, ...] = ()) -> DataFrame:
    """rows with each group of keys in one partition and in a run, for whole_groups()."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def whole_groups(batches: Iterator[pa.RecordBatch], *keys: str, least: int = LEAST_ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with numeric keys, at least `least` rows where there are so many, and where their groups begin (and the end)."""
    held: list[pa.RecordBatch] = []
    count = 0

    def starts(rows: pa.Table) -> np.ndarray:
        new = np.zeros(len(rows), bool)
        new[0] = True
        for k in keys:
            v = rows[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(new), len(rows))

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        count += len(batch)
        if count < least:
            continue
        rows = pa.Table.from_batches(held)
        at = starts(rows)
        if len(at) > 2:  # the last group may go on
            yield rows.slice(0, at[-2]), at[:-1]
        else:
            at = np.array([0, 0])
        held = rows.slice(at[-2]).combine_chunks().to_batches()
        count = len(rows) - at[-2]
    if held:
        rows = pa.Table.from_batches(held)
        yield rows, starts(rows)


def vectors(column: pa.ChunkedArray) -> np.ndarray:
    """A list column whose lists are as long as each other, as rows."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def numbered(rows: DataFrame, order: list, out: str, tables, name: str) -> DataFrame:
    """rows with `out`, their place from 0 in the order. Rows are sorted by ranges; only the ranges' sizes reach the driver."""
    marked = tables.save(rows.orderBy(*order).withColumn("place_", F.monotonically_increasing_id()), name)
    part = F.shiftright("place_", 33).cast("int")
    sizes = {r["p"]: r["n"] for r in marked.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, upto = {}, 0
    for p in range(max(sizes, default=-1) + 1):
        offsets[p] = upto
        upto += sizes.get(p, 0)
    first = F.get(F.array(*(F.lit(offsets[p]).cast("long") for p in sorted(offsets))), part) if offsets else F.lit(0).cast("long")
    return marked.withColumn(out, first + F.col("place_").bitwiseAND((1 << 33) - 1)).drop("place_")

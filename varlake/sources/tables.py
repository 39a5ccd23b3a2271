"""The native forms of matrices, weights and summaries: Parquet tables, and text where other programs read it."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_matrix(matrix: DataFrame, cells: DataFrame, snvs: DataFrame, path: str, mode: str = "ignore") -> None:
    """x (by sample), obs and var below one path. A finished table is left alone unless the mode is overwrite: Spark commits
    a table as a whole, so what exists is whole."""
    matrix.write.mode(mode).partitionBy("sample").parquet(f"{path}/x")
    cells.write.mode(mode).parquet(f"{path}/obs")
    snvs.write.mode(mode).parquet(f"{path}/var")


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{t}") for t in ("x", "obs", "var"))


def write_text_table(rows: DataFrame, path: str, sep: str = ",", by: str | None = None) -> None:
    out = rows.write.mode("overwrite").option("header", True).option("sep", sep)
    (out.partitionBy(by) if by else out).csv(path)


def read_text_table(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def write_cell_counts(counts: DataFrame, path: str, by: str | None = None) -> None:
    """barcode, count, list per line, zero counts too; one folder for each value of `by`."""
    line = F.concat_ws("\t", "barcode", F.col("n").cast("string"), "variants").alias("value")
    out = counts.select(line, *([by] if by else [])).write.mode("overwrite")
    (out.partitionBy(by) if by else out).text(path)


def write_name_lists(names: DataFrame, path: str) -> None:
    """An array file of names for each list, below a folder of its own. names: (list, ix, name). A file is one array, as other programs read it,
    so a list, such as a model's genes or variants, is made by one task."""

    def array(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["ix"].to_numpy(), kind="stable")
        data = io.BytesIO()
        np.save(data, np.array(rows["name"].to_pylist(), dtype=str)[order], allow_pickle=False)
        return pa.table({"list": rows["list"][:1], "value": pa.array([data.getvalue()], pa.binary())})

    files = names.select("list", "ix", "name").groupBy("list").applyInArrow(array, "list string, value binary")
    files.select("list", F.col("value").cast("string").alias("value")).write.mode("overwrite").partitionBy("list").text(path)


def read_name_lists(spark: SparkSession, path: str) -> DataFrame:
    """list, ix, name of array files below folders list=...; a single file, or files without such folders, have no list. Arrays are of text, or of
    bytes in UTF-8; others are an error."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["list"], batch["content"]):
                found = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                if found.dtype.kind not in "US" or found.ndim != 1:
                    raise ValueError(f"not a list of names: {found.dtype}, {found.ndim} dimensions")
                texts = [x.decode() if isinstance(x, bytes) else x for x in found.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(texts), pa.string()), pa.array(range(len(texts)), pa.int32()), pa.array(texts, pa.string())], names=["list", "ix", "name"])

    files = spark.read.format("binaryFile").load(path)
    own = F.col("list").cast("string") if "list" in files.columns else F.lit(None).cast("string")
    return files.select(own.alias("list"), "content").mapInArrow(rows, "list string, ix int, name string")

"""Training-data pipeline over `documents`: five stages, each written as Parquet and read again by the next.

quality: documents that the classifier rejects go. near_duplicates: of each group of near copies (shingles of five words,
similarity 0.8) one row stays. personal_data: spans are replaced by their kind, n_chars follows. mixing: sources are taken as
often as the mixture says, every document at least once. bpe: token ids of every document taken.

Defined results: null and empty texts are kept or rejected by their score like others, have no duplicates, spans or
tokens; repeated rows and rows with null or repeated ids are told apart by place, so that of copies exactly one row stays
(the first by doc_id, nulls last, then text digest); ties in the mixture's order are broken by doc_id and text; an empty
table gives no rows; texts are whole, however long; further columns may have any names and pass through unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varlake.llm import bpe, mixing, neardup, pii, quality
from varlake.llm.shared import Scratch, table

READ = ("doc_id", "text", "source", "n_chars")


def plain(docs: DataFrame) -> DataFrame:
    """docs with names that nothing here uses for the columns that no stage reads."""
    return docs.toDF(*(c if c in READ else f"other_{i}" for i, c in enumerate(docs.columns)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = plain(docs)
    scored = quality.with_scores(rows, quality.train(rows, table(spark, sf_dir, "labels")), out="quality_score")
    return scored.filter(F.col("quality_score") >= quality.REJECT_BELOW).select(rows.columns).toDF(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each group stays. Every row has an id of its own, so that repeated rows, null ids and ids with
    several texts are told apart. Rows without shingles all stay."""
    named = plain(docs)
    rows = Scratch(spark, "rows").save(named.withColumn("row_id", F.monotonically_increasing_id()), "rows")
    groups = neardup.near_duplicates(rows.select(F.col("row_id").alias("doc_id"), "text")).filter("n_shingles > 0")
    groups = groups.select(F.col("doc_id").alias("row_id"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.sha2(F.encode("text", "utf-8"), 256), "row_id")
    stay = groups.join(rows.select("row_id", order.alias("order")), "row_id").groupBy("component_id").agg(F.min_by("row_id", "order").alias("row_id"))
    gone = groups.join(stay, ["component_id", "row_id"], "left_anti").select("row_id")
    return rows.join(gone, "row_id", "left_anti").select(named.columns).toDF(*docs.columns)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = plain(docs)
    clean = pii.redact(rows, pii.train(rows))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(rows.columns).toDF(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, mixing.plan(plain(docs), Scratch(spark, "mixing"), cover=True, max_repeats=2.0))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.bpe_digests(plain(docs), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

# Trained models, signatures and merges are not SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stages = Scratch(spark, "pipeline")  # removed when the interpreter ends
    for name, stage in STAGES[:-1]:
        docs = stages.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

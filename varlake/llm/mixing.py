"""Mixing sources to target weights by temperature, with DataFrame functions only.

Each source's token share is raised to an exponent and normalised. The exponent is bisected between 1 (shares as they are)
and 0 (all sources alike) until the weights' entropy meets a target, but never below the exponent at which a source would
be repeated more often than allowed. One pass evaluates 16 exponents, four bisection steps, in one aggregate over the
sources; nothing but these 16 rows reaches the driver, however many sources there are.

Weights are realised per source in blocks of about BLOCK_ROWS documents dealt by hash. Every epoch orders a block anew;
whole epochs take all of it, the last one a prefix of its permutation worth the remaining budget. So no window holds more
than a block, and a hot source is many blocks; a row that is repeated very often is one row there, and its copies are dealt out.

A document's tokens are its white-space separated words and one end mark. Defined results: a null text has no words; a
null source is a source; repeated rows are repeated and count each; an empty table gives no rows; a null doc_id is a
value like any other; other columns pass through unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, copied, table

BLOCK_ROWS, GRID, PASSES, SEED = 1000, 16, 6, 17
TARGET_ENTROPY, MAX_REPEATS = 0.98, 4.0


def units(docs: DataFrame) -> DataFrame:
    """doc_id, source, mark (hash of the text), tokens, rows: one row for rows that agree in all of these."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("mark"),
                        (F.regexp_count(text, F.lit(r"\S+")) + 1).cast("long").alias("tokens"))
    return keyed.groupBy("doc_id", "source", "mark", "tokens").agg(F.count("*").alias("rows"))


def evaluate(shares: DataFrame, exponents: list[float]) -> list:
    """For each exponent a: the entropy of the weights, and the largest weight in proportion to its share."""
    a, p = F.col("a"), F.col("p")
    rows = shares.withColumn("a", F.explode(F.array(*map(F.lit, exponents))))
    z = rows.groupBy("a").agg(F.sum(F.pow(p, a)).alias("z"), F.sum(F.pow(p, a) * F.ln(p)).alias("s"), F.max(F.pow(p, a - 1)).alias("m"))
    return z.select("a", (F.ln("z") - a * F.col("s") / F.col("z")).alias("entropy"), (F.col("m") / F.col("z")).alias("lift")).orderBy(F.desc("a")).collect()


def exponent(shares: DataFrame, repeats: float, target_entropy: float, max_repeats: float) -> float:
    """The largest exponent that meets the target, or the smallest within the repetition limit if that is larger.
    repeats: how often the budget holds the whole corpus. target_entropy: as a part of ln(sources)."""
    goal = target_entropy * float(shares.agg(F.ln(F.count("*").cast("double")).alias("h")).first()["h"] or 0.0)
    high, low = 1.0, 0.0  # at high neither the target nor the limit is passed
    for _ in range(PASSES):
        step = (high - low) / GRID
        inside = [high - step * i for i in range(1, GRID + 1)]
        passed = [r["a"] for r in evaluate(shares, inside) if r["entropy"] > goal + 1e-12 or r["lift"] * repeats > max_repeats + 1e-12]
        if not passed:
            return low
        high, low = max(passed) + step, max(passed)
    return high


def plan(docs: DataFrame, scratch: Scratch, budget: float | None = None, cover: bool = False, target_entropy: float = TARGET_ENTROPY,
         max_repeats: float = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """units with weight, exponent, block, whole (epochs that take it) and extra (whether the last, partial epoch does).
    budget: tokens, by default as many as there are; cover: instead the least budget with which every document is taken
    at least once, as far as the repetition limit holds."""
    rows = scratch.save(units(docs), "units")
    totals = rows.groupBy("source").agg(F.sum(F.col("tokens") * F.col("rows")).alias("t"), F.sum("rows").alias("n"))
    totals = scratch.save(totals, "totals")
    whole = totals.agg(F.sum("t")).first()[0] or 1
    shares = totals.select("source", "n", "t", (F.col("t") / F.lit(whole)).alias("p"))
    if cover:
        # weight / share is least for the largest source; with that source taken once, another is repeated as often as
        # its own lift is larger, so the limit is one on the exponent: (p_max / p_min) ** (1 - a) <= max_repeats
        low, high = shares.agg(F.min("p"), F.max("p")).first()
        import math
        limit = 1.0 if low is None or low == high else max(0.0, 1 - math.log(max_repeats) / math.log(high / low))
        a = max(limit, exponent(shares, 0.0, target_entropy, max_repeats))
        lift = lambda p: F.pow(p / F.lit(high or 1.0), F.lit(a - 1))
        weighed = shares.withColumn("repeats", lift(F.col("p")))
    else:
        repeats = (budget or whole) / whole
        a = exponent(shares, repeats, target_entropy, max_repeats)
        z = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0
        weighed = shares.withColumn("repeats", F.pow("p", F.lit(a - 1)) / F.lit(z) * F.lit(repeats))
    total = weighed.agg(F.sum(F.col("p") * F.col("repeats"))).first()[0] or 1.0
    weighed = weighed.select(F.col("source").alias("s"), (F.col("p") * F.col("repeats") / F.lit(total)).alias("weight"), "repeats",
                             F.ceil(F.col("n") / F.lit(BLOCK_ROWS)).alias("blocks"))
    rows = rows.join(weighed, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("exponent", F.lit(float(a)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "mark", F.lit(seed)), F.col("blocks")).cast("long")).drop("blocks")
    # rounded, so that 1.0 of a whole epoch is not 0.9999999 of it
    rows = rows.withColumn("repeats", F.round("repeats", 9)).withColumn("whole", F.floor("repeats").cast("int"))
    size = F.col("tokens") * F.col("rows")
    block = Window.partitionBy("source", "block")
    before = F.sum(size).over(block.orderBy(F.xxhash64("doc_id", "mark", F.col("whole") + seed), "doc_id", "mark", "tokens").rowsBetween(Window.unboundedPreceding, 0)) - size
    share = (F.col("repeats") - F.col("whole")) * F.sum(size).over(block)
    return rows.withColumn("extra", before + size / 2 <= share)


def stream(planned: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per taken document and epoch: doc_id, source, tokens, weight, exponent, epoch, block, place in the block's
    permutation (from 0). Blocks of an epoch may be read in any order, such as by hash."""
    taken = planned.withColumn("times", F.col("whole") + F.col("extra").cast("int")).filter("times > 0")
    taken = taken.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    order = Window.partitionBy("source", "block", "epoch").orderBy(F.xxhash64("doc_id", "mark", F.col("epoch") + seed), "doc_id", "mark", "tokens")
    # rows that agree follow each other, so that their places are numbers; they become rows only after the window
    before = F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")
    return copied(taken.withColumn("place", before), "rows", "place").select("doc_id", "source", "tokens", "weight", "exponent", "epoch", "block", F.col("place").cast("long").alias("place"))


def mixed(docs: DataFrame, planned: DataFrame) -> DataFrame:
    """docs with each row as often as it is taken; its columns may have any names beside doc_id, source and text."""
    at = {c: f"c{docs.columns.index(c)}" for c in ("doc_id", "source", "text")}
    inner = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text = F.coalesce(F.col(at["text"]).cast("string"), F.lit(""))
    times = planned.select(F.col("doc_id").alias("mix_doc"), F.col("source").alias("mix_source"), F.col("mark").alias("mix_mark"), (F.col("whole") + F.col("extra").cast("int")).alias("mix_times"))
    met = F.col(at["doc_id"]).eqNullSafe(F.col("mix_doc")) & F.col(at["source"]).cast("string").eqNullSafe(F.col("mix_source")) & (F.xxhash64(text) == F.col("mix_mark"))
    taken = inner.join(times.filter("mix_times > 0"), met).withColumn("mix_copy", F.explode(F.sequence(F.lit(1), "mix_times")))
    return taken.select(*inner.columns).toDF(*docs.columns)


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(plan(table(spark, sf_dir, "documents"), Scratch(spark, "mixing")))

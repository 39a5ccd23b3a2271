"""Document fingerprints by winnowing, with DataFrame functions only.

Every K neighbouring code points of a text, from each of its places, are a gram. Its hash is the polynomial
c1 * BASE^(K-1) + ... + cK modulo 2^30. It rolls: the hash of a gram follows from those of its halves, so that the hashes at
all places of a text are found in log2(K) passes over an array instead of one pass for each gram. Of every WINDOW
neighbouring grams the smallest hash is kept, the rightmost of equals, with its position in code points; that minimum is
found in the same way. So two texts that share any WINDOW + K - 1 code points, at any offsets and in any script, share a
fingerprint. A text with fewer grams than a window is one window; one with fewer code points than K is one gram; equal
texts have equal fingerprints. The likeness of two fingerprints is the Jaccard index of their hashes; two empty
fingerprints are alike (1.0), an empty and another are not (0.0). Long texts are taken CHUNK windows at a time, so that a
task holds arrays of that size besides the text and its fingerprint.

The edited text starts as the text does. What windows inside the common start keep is taken from the text's own
fingerprint; only windows that reach further are hashed.

The next document by descending doc_id is found inside ranges of doc_id of bounded size; the last row of a range gets the
head of the next one from a table of range heads. Every text is shuffled once, before it is hashed.

Defined results: a null text counts as empty; rows that tie on doc_id follow by their text; null ids come last; a single
row is its own next document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table

K, WINDOW = 16, 32  # powers of two
BASE, MASK = 0x2545F491, 2**30 - 1
CHUNK = 16_384
RANGE_ROWS, FANOUT = 500, 256
ALL = 2**30 - 1  # longer than any array; positions are packed below it


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once for each row."""
    return F.transform(F.array(value), then)[0]


def _doubled(values: Column, length: int, join: Callable[[Column, Column, int], Column]) -> Column:
    """At each place, of runs of 1, 2, 4, ... up to `length` values: join() of the run's halves; null if one is beyond the end."""

    def once(values: Column, width: int) -> Column:
        return _let(values, lambda v: F.zip_with(v, F.slice(v, width + 1, ALL), lambda a, b: join(a, b, width)))

    for power in range(length.bit_length() - 1):
        values = once(values, 2**power)
    return values


def _polynomial(ahead: Column, behind: Column, width: int) -> Column:
    """The hash of a run from those of its halves, of which the one behind has `width` code points."""
    return (ahead * F.lit(pow(BASE, width, MASK + 1)).cast("long") + behind).bitwiseAND(F.lit(MASK).cast("long"))


def gram_hashes(text: Column) -> Column:
    """array<long>: the hash of the K code points from each place; of a shorter text that of all of it; none of an empty one."""
    points = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    rolled = lambda p: F.slice(_doubled(p, K, _polynomial), 1, F.size(p) - (K - 1))
    one = lambda p: F.array(F.aggregate(p, F.lit(0).cast("long"), lambda h, c: _polynomial(h, c, 1)))
    return F.when(text == "", F.array().cast("array<long>")).otherwise(_let(points, lambda p: F.when(F.size(p) < K, one(p)).otherwise(rolled(p))))


def _minima(hashes: Column, before: Column) -> Column:
    """array<long> of hash * 2^30 + 2^30 - 1 - position, by position: the smallest of each window, each once. Of equal hashes
    that is the rightmost. before: the number of code points ahead of the first gram."""
    packed = _let((ALL - before).cast("long"), lambda top: F.transform(hashes, lambda h, i: h * F.lit(ALL + 1).cast("long") + (top - i)))
    least = lambda p: F.slice(_doubled(p, WINDOW, lambda a, b, _: F.least(a, b)), 1, F.greatest(F.size(p) - (WINDOW - 1), F.lit(1)))
    return F.array_distinct(_let(packed, least))


def winnowed(text: Column, before: Column | int = 0) -> Column:
    """The kept grams of a text, as _minima packs them; before is added to the positions."""
    before = F.lit(before) if isinstance(before, int) else before
    reach = K + WINDOW - 2

    def whole(t: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(t) - (reach + 1), F.lit(0)), F.lit(CHUNK))
        return F.flatten(F.transform(starts, lambda at: _minima(gram_hashes(F.substring(t, at + 1, F.lit(CHUNK + reach))), at + before)))

    return F.array_distinct(_let(text, whole))


def position(packed: Column) -> Column:
    return F.lit(ALL) - packed.bitwiseAND(F.lit(ALL))


def winnowed_edit(kept: Column, same: Column, edited: Column) -> Column:
    """winnowed(edited), where the first `same` code points of it are those of the text that kept is of. Windows that keep a
    gram start at or before it, so that grams no later than the last window inside the common start stay as they are; later
    ones need that window and the WINDOW - 2 before it again."""
    inside = F.greatest(same - (K + WINDOW - 2), F.lit(0))  # windows inside the common start

    def both(n: Column) -> Column:
        ahead = F.greatest(n - (WINDOW - 1), F.lit(0))
        return F.array_distinct(F.concat(F.filter(kept, lambda x: position(x) < n), winnowed(F.substring(edited, ahead + 1, F.lit(ALL)), ahead)))

    return _let(inside, both)


def fingerprint_hashes(kept: Column) -> Column:
    return F.array_distinct(F.transform(kept, lambda x: F.shiftright(x, 30)))


def fingerprint_text(kept: Column) -> Column:
    """hash:position, by position."""
    return F.array_join(F.transform(kept, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 30))), F.lit(":"), position(x).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def ranges_of(rows: DataFrame, id_col: str, range_rows: int = RANGE_ROWS) -> Column:
    """The number of the row's id range: a search among at most 256 * 256 quantiles, in two steps. They come from a sketch
    of bounded size, which is all that the driver sees."""
    cuts = max(1, min(FANOUT * FANOUT, rows.count() // range_rows))
    if cuts == 1:
        return F.lit(0)
    found = rows.agg(F.percentile_approx(id_col, [i / cuts for i in range(1, cuts)], 100_000)).first()[0]
    marks = sorted(set(found or []))
    nested = [marks[i:i + FANOUT] for i in range(0, len(marks), FANOUT)]
    below = lambda values: F.size(F.filter(values, lambda m: m < F.col(id_col)))
    coarse = below(F.from_json(F.lit(str([x[-1] for x in nested])), "array<bigint>"))
    fine = F.from_json(F.lit(str([*nested, []])), "array<array<bigint>>")
    return coarse * (FANOUT + 1) + below(F.element_at(fine, coarse + 1))


def with_next(rows: DataFrame, id_col: str, fields: list[str], ties: list[str], range_rows: int = RANGE_ROWS, derived: dict[str, Column] | None = None) -> DataFrame:
    """rows with next_<field> of the row that follows by descending id; after the last comes the first. Rows with a null
    id come last. The head of each range also stands, marked, at the end of the range before it, and is left out again.
    derived: further columns, computed after the rows are shuffled and before their fields are looked ahead."""
    rows = rows.withColumn("seq_id", F.coalesce(F.col(id_col), F.lit(-(2**63))))
    rows = rows.withColumn("seq_range", ranges_of(rows, "seq_id", range_rows))
    heads = rows.groupBy("seq_range").agg(F.max("seq_id").alias("head"))
    # as many rows as ranges: 256 * 256 at most
    every = Window.orderBy(F.desc("seq_range"))
    follow = heads.select(F.coalesce(F.lead("head").over(every), F.max("head").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("seq_id"), F.col("seq_range").alias("seq_before"))
    copies = rows.join(F.broadcast(follow), "seq_id").withColumn("seq_range", F.col("seq_before")).drop("seq_before")
    both = rows.withColumn("seq_copy", F.lit(0)).unionByName(copies.withColumn("seq_copy", F.lit(1)))
    both = both.repartition("seq_range").withColumns(derived or {})  # the windows below need no other shuffle
    order = Window.partitionBy("seq_range").orderBy("seq_copy", F.desc("seq_id"), *ties)
    for f in fields:
        both = both.withColumn(f"next_{f}", F.lead(f).over(order))
    return both.filter("seq_copy = 0").drop("seq_id", "seq_range", "seq_copy")


def winnow_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(docs, "doc_id", ["text", "kept"], ["text"], derived={"kept": winnowed(F.col("text"))})
    n = F.length("text")
    same = n - F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), same), F.substring("next_text", F.lit(1), n - same)))
    rows = rows.withColumn("edited_kept", winnowed_edit(F.col("kept"), same, F.col("edited"))).withColumn("hashes", fingerprint_hashes(F.col("kept")))
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        fingerprint_text(F.col("kept")).alias("fingerprint"), fingerprint_text(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), fingerprint_hashes(F.col("edited_kept"))).alias("near_edited"),
        likeness(F.col("hashes"), fingerprint_hashes(F.col("next_kept"))).alias("near_next"),
    )

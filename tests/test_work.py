"""How often queries read their tables, and into how many files they deal rows."""

import pytest

from varlake.operators import model
from varlake.plans import models, registry
from varlake.sources import bam, derived
from varlake.streaming import pileup


@pytest.mark.parametrize("name, most", [("jn_cells", 3), ("snk_vcf", 1), ("gr_modularity", 2)])
def test_lines_are_read_so_often_at_most(spark, sf, monkeypatch, name, most):
    seen, table = spark.sparkContext.accumulator(0), derived.table

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    def watched(spark, sf_dir, name):
        rows = table(spark, sf_dir, name)
        return rows.mapInArrow(counted, rows.schema) if name == "lineitem" else rows

    monkeypatch.setattr(derived, "table", watched)
    registry.QUERIES[name](spark, sf).count()
    assert 0 < seen.value <= most * table(spark, sf, "lineitem").count()


def test_files_grow_with_the_reads(spark, sf, monkeypatch):
    written, seen = bam.write_bam, []
    monkeypatch.setattr(derived, "FILE_READS", 1000)
    monkeypatch.setattr(bam, "write_bam", lambda rows, *rest: (seen.append(rows.rdd.getNumPartitions()), written(rows, *rest)))
    lines = derived.table(spark, sf, "lineitem").count()
    assert registry.QUERIES["src_bam"](spark, sf).count() == derived.all_reads(spark, sf).count()
    assert seen == [-(-lines // 1000)]


def test_streamed_files_grow_with_the_reads(spark, sf, monkeypatch):
    dealt, seen = pileup.counts_of_stream, []
    monkeypatch.setattr(derived, "FILE_READS", 1000)
    monkeypatch.setattr(pileup, "counts_of_stream", lambda spark, reads, *how: (seen.append(how), dealt(spark, reads, *how))[1])
    assert registry.QUERIES["stream_pileup"](spark, sf).count() == derived.counts(spark, sf).count()
    assert seen == [(-(-derived.table(spark, sf, "lineitem").count() // 1000), 4)]


def test_the_map_of_a_cell_is_made_once(spark, sf):
    plan = models._cells(spark, sf, grown=True).select("cell", "batch", "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries" in plan and "coalesce(map_from_entries" not in plan


def test_reads_of_a_join_are_dealt_by_their_number(spark, sf, monkeypatch):
    """And the states of cells are not dealt again to find what flips in them."""
    before, lines = {tuple(r) for r in derived.rna(spark, sf, True).collect()}, derived.table(spark, sf, "lineitem").count()
    monkeypatch.setattr(derived, "JOINED_READS", 1000)
    rows, parts = derived.rna(spark, sf, True), -(-lines // 1000)
    assert parts > spark.sparkContext.defaultParallelism
    assert rows._jdf.queryExecution().executedPlan().toString().count(f", {parts}), REPARTITION_BY_NUM") == 2 and {tuple(r) for r in rows.collect()} == before
    flipped, plans = model.flipped, []
    monkeypatch.setattr(model, "flipped", lambda seen, w: (plans.append(seen._jdf.queryExecution().executedPlan().toString()), flipped(seen, w))[1])
    assert registry.QUERIES["ml_bycelltype"](spark, sf).count() > 0
    assert len(plans) == 1 and "hashpartitioning(cell" not in plans[0]

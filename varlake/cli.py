"""Commands: calls (files to the call matrix), variants (alignments to variant records), scores (matrix and scores to kept
scores and cells), query (a registered query to Parquet) and template (a configuration to start from)."""

from __future__ import annotations

import argparse
import json
import os
import sys

from . import config


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("varlake").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def calls(args: argparse.Namespace) -> None:
    from .plans import dags

    settings = config.CallSettings.of(config.load(args.config))
    dags.run_calls(_session(), settings)


def variants(args: argparse.Namespace) -> None:
    from .operators import reads as rd
    from .plans import dags
    from .sources import bam, text

    prefixes = [os.path.basename(p).split(".")[0] for p in args.alignments]
    if len(set(prefixes)) < len(prefixes):
        sys.exit("two inputs have the same sample name")
    from pyspark.sql import functions as F

    spark = _session()
    fasta, bed = text.read_fasta(spark, args.reference), text.read_bed(spark, args.editing)
    for sample, path in zip(prefixes, args.alignments):
        rows = (bam.read_bam if path.endswith(".bam") else text.read_sam)(spark, path)
        bases = rd.exploded_alignments(rd.kept_by_flag(rows)).withColumn("sample", F.lit(sample)).select("sample", "chrom", "pos", "base", "base_q", "map_q", "flag")
        dags.called_sites(text.with_reference(bases, fasta), bed).write.mode("ignore").parquet(f"{args.out}/{sample}")


def scores(args: argparse.Namespace) -> None:
    from .plans import dags

    spark = _session()
    limits = config.load(args.config).get("scoring", {}) if args.config else {}
    names = {"min_carrier_cells": "least_carriers", "min_shared_cells": "least_shared", "jaccard": "jaccard", "overlap": "overlap"}
    kept, audit, cells = dags.cell_scores(*(spark.read.parquet(p) for p in (args.matrix, args.cells, args.scores)), **{v: limits[k] for k, v in names.items() if k in limits})
    for name, rows in (("scores", kept), ("removed", audit), ("cells", cells)):
        rows.write.mode("overwrite").option("header", True).csv(f"{args.out}/{name}")


def query(args: argparse.Namespace) -> None:
    from .plans import registry

    registry.QUERIES[args.name](_session(), args.tables).write.mode("overwrite").parquet(args.out)


def template(args: argparse.Namespace) -> None:
    if os.path.exists(args.out) and not args.force:
        sys.exit(f"{args.out} exists; --force overwrites it")
    with open(args.out, "w", encoding="utf-8") as f:
        json.dump(config.TEMPLATE, f, indent=2)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="varlake", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("calls", help="files of a configuration to the call matrix")
    p.add_argument("config")
    p.set_defaults(run=calls)
    p = sub.add_parser("variants", help="alignments to variant records")
    p.add_argument("alignments", nargs="+")
    p.add_argument("--reference", required=True)
    p.add_argument("--editing", required=True)
    p.add_argument("--out", required=True)
    p.set_defaults(run=variants)
    p = sub.add_parser("scores", help="scores to kept scores, audit and cells")
    for name in ("matrix", "cells", "scores"):
        p.add_argument(name)
    p.add_argument("--config")
    p.add_argument("--out", required=True)
    p.set_defaults(run=scores)
    p = sub.add_parser("query", help="a registered query to Parquet")
    p.add_argument("name")
    p.add_argument("tables")
    p.add_argument("--out", required=True)
    p.set_defaults(run=query)
    p = sub.add_parser("template", help="write a configuration to start from")
    p.add_argument("out")
    p.add_argument("--force", action="store_true")
    p.set_defaults(run=template)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(args)


if __name__ == "__main__":
    main()

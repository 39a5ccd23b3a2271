"""The queries of this subpackage, and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import alignment_query
from .ann import ann_query
from .annular import annular_query, annular_sql
from .bpe import bpe_query
from .mainhtml import html_query
from .mixing import mixing_query
from .neardup import neardup_query
from .pii import pii_query
from .quality import quality_query
from .sharding import sharding_query, sharding_sql
from .simhash import simhash_query
from .warc import WARC_SQL, warc_query
from .winnow import winnow_query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": warc_query,
    "op2_near_duplicates": neardup_query,
    "op3_personal_data": pii_query,
    "op4_bpe": bpe_query,
    "op5_quality": quality_query,
    "op6_nearest_neighbours": ann_query,
    "op7_mixing": mixing_query,
    "op8_sharding": sharding_query,
    "op9_html_text": html_query,
    "op10_winnowing": winnow_query,
    "op11_token_alignment": alignment_query,
    "op12_vector_codes": annular_query,
    "op13_simhash": simhash_query,
}

ORACLE_SQL: dict[str, str] = {"op1_warc": WARC_SQL, "op8_sharding": sharding_sql(), "op12_vector_codes": annular_sql()}

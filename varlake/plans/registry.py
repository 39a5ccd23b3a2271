"""Named queries and their DuckDB counterparts."""

from __future__ import annotations

from . import calling, expression, files, functions, models, scores, variants
from .register import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "calling", "expression", "files", "functions", "models", "scores", "variants"]

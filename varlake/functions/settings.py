"""Column expressions that read settings and names from text, as tables of runs hold them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import FALSE, TRUE

# Short names of the two score columns.
ALIASES = {"score_euclidean": "euclidean", "score_cosine_distance": "cosine"}


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def boolean(text: Column) -> Column:
    """true or false by the words for them in any case, an empty text is false; null for anything else."""
    word = F.lower(stripped(text))
    return F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False)


def positive_integer(text: Column) -> Column:
    """A number of digits that do not begin with 0, as a long; null for anything else, and for what no long holds."""
    digits = stripped(text)
    return F.when(F.regexp_like(digits, F.lit(r"^[1-9][0-9]*$")), digits.try_cast("long"))


def required_path(text: Column) -> Column:
    """The path as it is given; null where there is none or only white space."""
    return F.when(stripped(text) != "", text)


def score_alias(column: Column) -> Column:
    """A short suffix for a score column: the known names, else what is not a letter, digit or underscore becomes one underscore, none at the ends, in
    lower case."""
    clean = F.lower(F.regexp_replace(F.regexp_replace(column, "[^0-9A-Za-z_]+", "_"), "^_+|_+$", ""))
    known = F.coalesce(*(F.when(column == name, F.lit(short)) for name, short in ALIASES.items()))
    return F.when(column.isNotNull(), F.coalesce(known, clean))

"""Names of conditions in their normal forms: one for ranking, one for grouping, one for judging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import ACRONYMS
from .text import as_column, fold, lookup, squeeze

_ENDING = r"\s+(?:symptoms?|signs?|disease|disorder|syndrome)\s*$"
_TITLE_REST = r"\s*[-–|]\s*(?:symptoms?\b|signs?\b|causes?\b|diagnosis\b|treatment\b|overview\b|endocrinology\b|pulmonology\b|cardiology\b|neurology\b|msd manual\b|mayo clinic\b).*$"


def ranking_name(c: str | Column) -> Column:
    """Without a leading number, what a page title adds after a dash, and a generic ending; acronyms spelt out."""
    n = F.regexp_replace(F.lower(F.trim(as_column(c))), r"^\d+\s+", "")
    n = F.trim(F.regexp_replace(F.trim(F.regexp_replace(n, "(?s)" + _TITLE_REST, "")), _ENDING, ""))
    return lookup(n, ACRONYMS, n)


def grouping_name(c: str | Column) -> Column:
    """Hyphens as spaces, without a leading number, a generic ending and outer punctuation; acronyms spelt out."""
    n = F.regexp_replace(F.lower(F.trim(F.coalesce(as_column(c), F.lit("")))), r"[_\-]+", " ")
    n = F.regexp_replace(F.regexp_replace(n, r"^\d+\s+", ""), r"\s+", " ")
    n = F.regexp_replace(F.regexp_replace(n, _ENDING, ""), r"^[ .,:;]+|[ .,:;]+$", "")
    return lookup(n, ACRONYMS, n)


def judged_name(c: str | Column) -> Column:
    """Without accents, in lower case, white space collapsed; empty for null."""
    return squeeze(fold(F.coalesce(as_column(c), F.lit(""))))

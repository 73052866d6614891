"""Concepts named in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.lexicons import CONCEPTS_EN, COVERAGE_ALIASES
from ..functions.text import any_of, as_column, contains_phrase, normalize_symptom, phrase_pattern


def extract(text: str | Column, lexicon: dict[str, list[str]] | None = None) -> Column:
    """Sorted ids of the concepts of which an alias stands anywhere in the text, also inside words. One pattern per concept."""
    low = F.lower(F.coalesce(as_column(text), F.lit("")))
    lex = lexicon or CONCEPTS_EN
    return F.array_compact(F.array(*[F.when(low.rlike(phrase_pattern(lex[k]).replace("\\ ", " ")), F.lit(k)) for k in sorted(lex)]))


def by_alias(text: str | Column) -> Column:
    """Sorted ids of the concepts of which a coverage alias stands in the text as whole words."""
    n = normalize_symptom(text)
    return F.array_compact(F.array(*[F.when(any_of([contains_phrase(n, a) for a in COVERAGE_ALIASES[k]]), F.lit(k)) for k in sorted(COVERAGE_ALIASES)]))


def of_query(text: str | Column) -> Column:
    return F.array_sort(F.array_union(extract(text), by_alias(text)))

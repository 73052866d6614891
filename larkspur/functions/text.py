"""Text functions as Spark columns; Python only where the JVM has no such function."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .lexicons import NAME_STOPWORDS, NON_HEAD, STOPWORDS_EN, STOPWORDS_ES

ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñç"
PLAIN = "aaaaaaeeeeiiiiooooouuuunc"


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def round6(c: str | Column) -> Column:
    """Six decimals, the same in every engine."""
    return F.floor(as_column(c) * 1000000 + 0.5) / 1000000.0


def fold(c: str | Column) -> Column:
    """Lower case without accents on Latin letters."""
    return F.translate(F.lower(as_column(c)), ACCENTED, PLAIN)


def tokens(c: str | Column) -> Column:
    """Runs of a-z and 0-9 of the folded text."""
    return F.regexp_extract_all(fold(c), F.lit("[a-z0-9]+"), F.lit(0))


def word_tokens(c: str | Column) -> Column:
    """Alphanumeric runs that hyphens and apostrophes may join."""
    return F.regexp_extract_all(as_column(c), F.lit("[a-zA-Z0-9]+(?:[-'][a-zA-Z0-9]+)*"), F.lit(0))


def squeeze(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(as_column(c), r"\s+", " "))


def normalize_text(c: str | Column) -> Column:
    """Controls to spaces, dashes to hyphens, lower case, accents off, white space collapsed."""
    s = F.regexp_replace(as_column(c), r"[\x00-\x1f\x7f]", " ")
    return squeeze(fold(F.regexp_replace(s, "[‐-―−]", "-")))


def normalize_symptom(c: str | Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(as_column(c)), "[^a-z0-9áéíóúñü]+", " "))


def contains_phrase(text: str | Column, phrase: str | Column) -> Column:
    """Whether a normalised text holds a normalised phrase as whole words."""
    p = as_column(phrase) if isinstance(phrase, Column) else F.lit(phrase)
    return F.concat(F.lit(" "), as_column(text), F.lit(" ")).contains(F.concat(F.lit(" "), p, F.lit(" ")))


def clean_markup(c: str | Column) -> Column:
    """Block tags to line ends, other tags off, CRLF to LF, blanks collapsed. Entities are left to :func:`clean_text`."""
    s = F.regexp_replace(as_column(c), r"(?i)<\s*(?:br|/p|/div|/li|/ul|/ol|/h[1-6]|p|div|li|ul|ol|h[1-6])\b[^>]*>", "\n")
    s = F.regexp_replace(s, r"<[^>]+>", "")
    s = F.regexp_replace(F.regexp_replace(s, "\r\n?", "\n"), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r" ?\n ?", "\n"), r"\n{2,}", "\n"), r"^\s+|\s+$", "")


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", html.unescape(x)))


def clean_text(c: str | Column) -> Column:
    """Entities resolved and compatibility forms composed (in Arrow batches), then :func:`clean_markup`."""
    return clean_markup(_unescape(as_column(c)))


@F.pandas_udf(StringType())
def title_case(s: pd.Series) -> pd.Series:
    """Python's title case, which also starts a word after an apostrophe or digit."""
    return s.map(lambda x: None if x is None else x.title())


def display_title(c: str | Column) -> Column:
    return squeeze(F.regexp_replace(as_column(c), r"<[^>]+>", ""))


def preview(c: str | Column, most: int = 200) -> Column:
    """At most ``most`` characters, cut at the last space, with dots when cut."""
    s = as_column(c)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.regexp_replace(F.substring(s, 1, most), " [^ ]*$", ""), F.lit("...")))


def language_guess(toks: str | Column, sample: int = 500) -> Column:
    """es if the first tokens hold strictly more Spanish than English stop words, else en."""
    head = F.slice(as_column(toks), 1, sample)
    hits = lambda ws: F.size(F.filter(head, lambda t: t.isin(*ws)))
    return F.when(hits(STOPWORDS_ES) > hits(STOPWORDS_EN), F.lit("es")).otherwise(F.lit("en"))


def filter_tokens(toks: str | Column, lang: str | Column, least: int = 2, most: int = 40) -> Column:
    """Tokens of acceptable length that are no stop words of the language."""
    # the language is decided once a row, outside the lambda
    kept = lambda words: F.filter(as_column(toks), lambda t: F.length(t).between(least, most) & ~t.isin(*words))
    return F.when(as_column(lang).startswith("es"), kept(STOPWORDS_ES)).otherwise(kept(STOPWORDS_EN))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Shared over all distinct elements; 0 when either is empty."""
    x, y = as_column(a), as_column(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)).cast("double"))


def name_tokens(c: str | Column) -> Column:
    """Distinct content tokens of a condition's name."""
    return F.array_except(F.array_distinct(tokens(c)), literal_array(NAME_STOPWORDS))


def coverage(a: str | Column, b: str | Column) -> Column:
    """Share of a's elements that b holds; 0 when either is empty."""
    x, y = as_column(a), as_column(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(x).cast("double"))


def head_token(toks: str | Column) -> Column:
    """The longest token that is no qualifier, or else the longest; ties go to the first in the alphabet."""
    x = as_column(toks)
    specific = F.array_except(x, literal_array(NON_HEAD))
    pool = F.when(F.size(specific) > 0, specific).otherwise(x)
    first = F.array_sort(F.transform(pool, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.try_element_at(first, F.lit(1))["t"]


def is_match(retrieved: str | Column, expected: str | Column, least: float = 0.8) -> Column:
    """Whether the tokens of a retrieved name cover those of an expected one, or hold its head."""
    r, e = as_column(retrieved), as_column(expected)
    return (coverage(e, r) >= least) | F.coalesce(F.array_contains(r, head_token(e)), F.lit(False))


def sigmoid(c: str | Column) -> Column:
    x = as_column(c)
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def unit_score(c: str | Column) -> Column:
    """Scores in [0, 1] as they are, others through the sigmoid."""
    x = as_column(c)
    return F.when(x.between(0, 1), x).otherwise(sigmoid(x))


def clamp(c: str | Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), as_column(c)))


def lookup(c: str | Column, table: dict[str, str] | dict[str, float], otherwise: Column) -> Column:
    """A small fixed table as a map literal."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, as_column(c)), otherwise)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def whole_term(text: str | Column, term: str) -> Column:
    """Whether a text holds a term that no letter or digit touches, in any case."""
    return as_column(text).rlike(r"(?i)(?<![a-z0-9])" + re.escape(term) + r"(?![a-z0-9])")


def phrase_pattern(phrases: list[str]) -> str:
    return "|".join(re.escape(p) for p in phrases)


#: Forms of dates inside a text, as patterns and what they are parsed by (fixed values).
DATE_FORMS = [
    (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", "yyyy-MM-dd HH:mm:ss"),
    (r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"),
    (r"\d{4}/\d{2}/\d{2}", "yyyy/MM/dd"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"),
    (r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2}, \d{4}", "MMMM d, yyyy"),
    (r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d{1,2}, \d{4}", "MMM d, yyyy"),
    (r"\d{1,2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d{4}", "d MMM yyyy"),
    (r"\d{1,2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{4}", "d MMMM yyyy"),
]


def normalize_date(c: str | Column) -> Column:
    """The first date that a text holds, as ``yyyy-MM-ddTHH:mm:ss``; null when there is none or it does not exist."""
    s = as_column(c)
    read = []
    for pattern, form in DATE_FORMS:
        found = F.regexp_extract(s, pattern, 0)
        read.append(F.try_to_timestamp(F.when(found != "", found), F.lit(form)))
    return F.date_format(F.coalesce(*read), "yyyy-MM-dd'T'HH:mm:ss")

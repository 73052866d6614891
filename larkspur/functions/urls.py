"""URL functions."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .lexicons import DENIED_SCHEMES, DENIED_SUBSTRINGS, TRACKING_PARAMETERS
from .text import any_of, as_column

_TRACKING = frozenset(TRACKING_PARAMETERS)


def strip_url(url: str | None) -> str | None:
    """Without fragment and tracking parameters, the query encoded anew."""
    if url is None:
        return None
    try:
        parts = urlsplit(url)
        kept = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k not in _TRACKING]
        return urlunsplit(parts._replace(fragment="", query=urlencode(kept, doseq=True)))
    except ValueError:
        return url


@F.pandas_udf(StringType())
def normalize_url(url: pd.Series) -> pd.Series:
    return url.map(strip_url)


@F.pandas_udf(StringType())
def absolutize(base: pd.Series, href: pd.Series) -> pd.Series:
    """The link as seen from its page, normalised."""
    return pd.Series([None if b is None or h is None else strip_url(urljoin(b, h)) for b, h in zip(base, href)])


def domain(url: str | Column) -> Column:
    """Authority in lower case, with port and user."""
    return F.lower(F.regexp_extract(as_column(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def source_of(domain_or_url: str | Column) -> Column:
    """A source's name: lower case, host of a URL, without slashes and leading www."""
    v = F.lower(F.trim(F.coalesce(as_column(domain_or_url), F.lit(""))))
    host = F.when(v.contains("://"), F.regexp_extract(v, r"://([^/?#]*)", 1)).otherwise(v)
    return F.regexp_replace(F.regexp_replace(F.trim(host), "^/+|/+$", ""), r"^www\.", "")


def is_denied(url: str | Column) -> Column:
    u = F.lower(as_column(url))
    return any_of([u.startswith(s + ":") for s in DENIED_SCHEMES] + [u.contains(s) for s in DENIED_SUBSTRINGS])


def within(url: str | Column, allowed: list[str]) -> Column:
    """Whether the URL's domain is one of the allowed or below one."""
    d = domain(url)
    return any_of([(d == a.lower()) | d.endswith("." + a.lower()) for a in allowed]) if allowed else F.lit(False)


def url_hash(url: str | Column, digits: int = 16) -> Column:
    return F.substring(F.sha1(as_column(url)), 1, digits)


def parameters(url: str | Column) -> Column:
    """The query string as a map; of repeated names the last counts."""
    q = F.regexp_extract(as_column(url), r"\?([^#]*)", 1)
    pairs = F.filter(F.split(q, "&"), lambda x: x != "")
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.split(x, "=", 2)[0], F.coalesce(F.try_element_at(F.split(x, "=", 2), F.lit(2)), F.lit("")))))


#: Path segments that say nothing about a page (fixed values).
NOISE_SLUGS = [r"syc[ ]?\d+", r"pmc\d+", r"\d+", r"symptoms? causes?", r"causes?", r"symptoms?", r"diagnosis", r"treatment", r"prevention", r"health topics?", r"article", r"ency", r"medlineplus"]


def slug_words(url: str | Column) -> Column:
    """The last path segment that is no noise, with spaces for hyphens; the last of all if every one is noise; null without any."""
    path = F.regexp_extract(as_column(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    clean = lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"(?i)\.(html?|aspx?|php)$", ""), "[-_]", " "))
    good = F.filter(F.transform(segments, clean), lambda s: (s != "") & ~s.rlike("(?i)^(?:" + "|".join(NOISE_SLUGS) + ")$"))
    last = F.trim(F.regexp_replace(F.try_element_at(segments, F.lit(-1)), "[-_]", " "))
    return F.coalesce(F.try_element_at(good, F.lit(-1)), F.when(last != "", last))


"""Location labels, street tokens and record-field cleaning, all as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from . import fixed


def token_any(cols: Sequence[Column], tokens: Sequence[str], fold: str = "upper") -> Column:
    """True when any token occurs in any column, case folded; null text never matches."""
    folded = [F.upper(c) if fold == "upper" else F.lower(c) for c in cols]
    hit = F.lit(False)
    for c in folded:
        for t in tokens:
            hit = hit | F.coalesce(c.contains(t), F.lit(False))
    return hit


def slash_intersection(c: Column) -> Column:
    """'A ST \\ B ST' to 'A ST / B ST'."""
    return F.replace(F.replace(F.trim(c), F.lit(" \\ "), F.lit(" / ")), F.lit("\\"), F.lit(" / "))


def before_comma(c: Column) -> Column:
    return F.trim(F.substring_index(c, ",", 1))


def clean_location(c: Column) -> Column:
    """Cell label: slashes for corners, street part only for addresses."""
    return before_comma(slash_intersection(c))


def strip_city_tail(c: Column, city: str) -> Column:
    """Live-view label: drop the city/state tail and a leading INTERSECTION."""
    no_tail = F.regexp_replace(c, rf"(?i),?\s*{city}\b.*$", "")
    no_head = F.regexp_replace(no_tail, r"(?i)^INTERSECTION\s+", "")
    return slash_intersection(F.coalesce(no_head, F.lit("")))


def canon_district(c: Column) -> Column:
    return F.upper(F.coalesce(c, F.lit("")))


def first_upper(c: Column) -> Column:
    """First letter upper, rest lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def sentence_case(c: Column) -> Column:
    """First letter upper, rest unchanged."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30))


def truncated(c: Column, limit: int) -> Column:
    """Trimmed and cut to `limit`; empty becomes null."""
    return F.nullif(F.substring(F.trim(c), 1, limit), F.lit(""))


def _plain(c: Column) -> Column:
    """Lower case, everything but letters, digits and blanks turned into blanks."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " ")


def words(c: Column) -> Column:
    """Lower-case alphanumeric words."""
    return F.filter(F.split(_plain(c), r"\s+"), lambda w: w != "")


_NO_STREET = r"\b(and|" + "|".join(fixed.STREET_SUFFIXES) + r")\b"


def street_tokens(c: Column) -> Column:
    """Significant street words: no 'and', ordinals reduced to digits, no leading zeros,
    no street-type suffixes, each once in first-seen order.  The rules run over the whole
    text before it is split, which is cheaper than a function call per word."""
    digits = F.regexp_replace(_plain(c), r"\b(\d+)(st|nd|rd|th)\b", "$1")
    unpadded = F.regexp_replace(digits, r"\b0+(\d+)\b", "$1")
    kept = F.trim(F.regexp_replace(unpadded, _NO_STREET, " "))
    return F.array_distinct(F.filter(F.split(kept, r"\s+"), lambda w: w != ""))


def token_key(tokens: Column) -> Column:
    return F.array_join(F.array_sort(tokens), " ")


def pair_key(a: Column, b: Column) -> Column:
    """Order-free key of two street names."""
    keys = F.array(token_key(street_tokens(a)), token_key(street_tokens(b)))
    return F.array_join(F.array_sort(keys), " x ")


def name_tokens(c: Column) -> Column:
    """Loose stop-name words."""
    return F.filter(words(c), lambda w: ~w.isin(*fixed.STOP_NAME_WORDS))


def fold_street(c: Column) -> Column:
    """Upper, apostrophes dropped: the form compared against corner names."""
    return F.trim(F.replace(F.upper(F.coalesce(c, F.lit(""))), F.lit("'"), F.lit("")))


def basis_types(c: Column) -> Column:
    """Every matching basis label, or ['unstated']."""
    text = F.coalesce(c, F.lit(""))
    marks = F.array(*[F.when(text.rlike(rx), F.lit(k)) for k, rx in fixed.BASIS_PATTERNS])
    hits = F.filter(marks, lambda k: k.isNotNull())
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("unstated")))


def parse_stop_code(c: Column) -> Column:
    """5-digit public code with a leading 1 to its 4-digit id; anything else null."""
    return F.nullif(F.regexp_extract(c, r"^1(\d{4})$", 1), F.lit(""))


def is_email(c: Column) -> Column:
    return c.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def well_formed_links(c: Column) -> Column:
    """Well-formed http(s) links of at most 2048 characters, trimmed."""
    trimmed = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda u: F.trim(u))
    return F.filter(trimmed, lambda u: u.rlike(r"(?i)^https?://") & (F.length(u) <= 2048))


def parse_links(c: Column) -> Column:
    """One link per line or comma; bare hosts get https://."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[\n,]+"), lambda u: F.trim(u))
    kept = F.filter(parts, lambda u: u != "")
    return F.transform(
        kept,
        lambda u: F.when(u.rlike(r"(?i)^https?://"), u).otherwise(F.concat(F.lit("https://"), u)),
    )


def query_param(url: Column, key: str) -> Column:
    """Decoded query-string parameter of a URL, null when absent."""
    return F.url_decode(F.parse_url(url, F.lit("QUERY"), F.lit(key)))

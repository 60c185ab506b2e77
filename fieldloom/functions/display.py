"""Bands, labels and small formatting for proposals and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.text import text


def confidence_band(c, high_min: float = 85, medium_min: float = 60) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c >= high_min, "high").when(c >= medium_min, "medium").otherwise("low")


def leaf_name(c) -> Column:
    """Last dotted part of a table name."""
    return F.substring_index(text(c), ".", -1)


def title_words(c) -> Column:
    return F.initcap(F.replace(text(c), F.lit("_"), F.lit(" ")))


def preview(c, length: int = 100) -> Column:
    return F.substring(text(c), 1, length)


def details_json(**values) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]))


def format_half_even(c, pattern: str) -> Column:
    """A number in a decimal pattern, halves to even."""
    return F.call_function("format_number", c, F.lit(pattern))


def percent(part, whole, pattern: str = "0") -> Column:
    """`part` of `whole` in percent, 0 when the whole is empty."""
    share = F.when(whole == 0, F.lit(0.0)).otherwise(part / whole * 100)
    return F.concat(format_half_even(share, pattern), F.lit("%"))


def contains_text(needle: str, *cols) -> Column:
    """Any of the columns holds the text, ignoring case; null counts as ''."""
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.contains(F.lower(text(c)), F.lit(needle.lower()))
    return hit

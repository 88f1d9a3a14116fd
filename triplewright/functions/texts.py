"""Strings as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def tokens(text: Column) -> Column:
    """The parts of a line between blanks; what is between double quotes is one part, without them."""
    found = F.regexp_extract_all(text, F.lit(r'("[^"]*"|[^\s"]+)'), F.lit(1))
    return F.transform(found, lambda t: F.regexp_replace(t, '^"|"$', ""))


def trimmed(text: Column) -> Column:
    """The text without the blanks at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")

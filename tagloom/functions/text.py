"""Splitting text into lines and words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the ASCII white space that separates words.
WHITESPACE = r"[ \t\n\x0B\f\r]+"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")


def words(line: Column) -> Column:
    """White-space separated items of a line, without empty ones."""
    return F.array_remove(F.split(line, WHITESPACE), "")

"""Chunk tags: prefix and type, and where chunks start and end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OUTSIDE = "O"

# Prefix -> previous prefixes after which it opens a chunk.
OPENS_AFTER = {"B": ["B", "I", "O"], "I": ["E", "O"], "E": ["E", "O"]}
# Prefix -> following prefixes before which it closes a chunk.
CLOSES_BEFORE = {"B": ["B", "O"], "I": ["B", "O"], "E": ["E", "I", "O"]}
# Prefixes outside any chunk, and prefixes of one-token chunks.
NO_CHUNK = ["O", "."]
SINGLE = ["[", "]"]

def prefix(tag: Column) -> Column:
    """The part before the first hyphen; the whole tag if there is none."""
    return F.substring_index(tag, "-", 1)


def chunk_type(tag: Column) -> Column:
    """The part after the first hyphen, or '' (also for the type '0')."""
    kind = F.substr(tag, F.length(prefix(tag)) + 2)
    return F.when(kind == "0", "").otherwise(kind)


def raw(tag: Column, outside: str = OUTSIDE) -> Column:
    """A tag without chunk prefixes, read as a one-token chunk of its own type."""
    return F.when(tag.isin(outside, OUTSIDE), OUTSIDE).otherwise(F.concat(F.lit("B-"), tag))


def _any(tests: list[Column]) -> Column:
    found = tests[0]
    for test in tests[1:]:
        found = found | test
    return found


def opens(before: Column, now: Column, type_before: Column, type_now: Column) -> Column:
    """True where a chunk starts between the previous and the current token."""
    by_prefix = [(now == p) & before.isin(earlier) for p, earlier in OPENS_AFTER.items()]
    return _any([*by_prefix, ~now.isin(NO_CHUNK) & (type_before != type_now), now.isin(SINGLE)])


def closes(before: Column, now: Column, type_before: Column, type_now: Column) -> Column:
    """True where a chunk ended between the previous and the current token."""
    by_prefix = [(before == p) & now.isin(later) for p, later in CLOSES_BEFORE.items()]
    return _any([*by_prefix, ~before.isin(NO_CHUNK) & (type_before != type_now), before.isin(SINGLE)])

"""The feature grammar: strings ``family:context:tag``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Padding tags, family names and suffix lengths.
START, STOP = "*", "STOP"
TRIGRAM, TAG, SUFF = "TRIGRAM", "TAG", "SUFF"
SUFFIX_LENGTHS = (1, 2)
FAMILIES = (TRIGRAM, TAG, SUFF)
# Families the decoder scores unless told otherwise; the trainer uses all.
DECODER_FAMILIES = (TRIGRAM, TAG)


def trigram(t2: Column, t1: Column, tag: Column) -> Column:
    return F.concat_ws(":", F.lit(TRIGRAM), t2, t1, tag)


def word_tag(word: Column, tag: Column) -> Column:
    return F.concat_ws(":", F.lit(TAG), word, tag)


def suffix_context(word: Column, length: int) -> Column:
    """``SUFF:<last characters>:<length>``; null for shorter words."""
    context = F.concat_ws(":", F.lit(SUFF), F.right(word, F.lit(length)), F.lit(str(length)))
    return F.when(F.length(word) >= length, context)


def suffix_tag(word: Column, length: int, tag: Column) -> Column:
    return F.concat(suffix_context(word, length), F.lit(":"), tag)


def word_contexts(word: Column, families: tuple[str, ...]) -> Column:
    """All contexts of a word, i.e. its features without the tag."""
    found = []
    if TAG in families:
        found.append(F.concat_ws(":", F.lit(TAG), word))
    if SUFF in families:
        found += [suffix_context(word, j) for j in SUFFIX_LENGTHS]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def feature_tag(feature: Column) -> Column:
    """The tag: everything after the last colon."""
    return F.substring_index(feature, ":", -1)


def feature_context(feature: Column) -> Column:
    """Everything before the last colon."""
    return F.left(feature, F.length(feature) - F.length(feature_tag(feature)) - 1)

"""Text output for tagged sentences and evaluation lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.runtime import stored


def _lines(sentences: DataFrame, *arrays: str) -> DataFrame:
    """One string per sentence: a line per token, and a line break after the last."""
    token = F.arrays_zip(*arrays)
    lines = F.transform(token, lambda t: F.concat_ws(" ", *[t[a] for a in arrays]))
    return sentences.select("sent_id", F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("lines"))


def tagged_lines(predictions: DataFrame) -> DataFrame:
    """``word tag`` lines."""
    return _lines(predictions, "words", "tags")


def eval_lines(sentences: DataFrame) -> DataFrame:
    """``word gold guess`` lines, the input of the evaluator."""
    return _lines(sentences, "words", "tags", "guesses")


def write_lines(lines: DataFrame, path: str) -> None:
    """Write sentence strings in corpus order with a blank line after each.

    Sorting samples its input before it moves it; the lines are stored first, so that they are made once.
    """
    stored(lines, "unsorted").orderBy("sent_id").select(F.col("lines").alias("value")).write.text(path)

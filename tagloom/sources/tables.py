"""Sentences from tables with a text column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import text


def tokenize(df: DataFrame, key_cols: list[str], text_col: str) -> DataFrame:
    """One sentence per text line: ``sent_id`` is the row's key with the line number.

    A struct key cannot overflow or collide, however many lines a text has.
    """
    lines = df.select(*key_cols, F.posexplode(F.split(text_col, "\n")).alias("at", "line"))
    key = F.struct(*key_cols, (F.col("at") + 1).alias("line_no"))
    return lines.select(key.alias("sent_id"), text.words(F.col("line")).alias("words")).filter(F.size("words") > 0)


def literal_pairs(spark: SparkSession, pairs: list[tuple[str, int]]) -> DataFrame:
    """In-memory key/value pairs as a table."""
    return spark.createDataFrame(pairs, "k string, v bigint")

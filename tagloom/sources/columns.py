"""Readers for column files: one token per line, a blank line ends a sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import text
from tagloom.runtime import stored
from tagloom.sources.records import paragraphs


def _item(line: Column, column: int) -> Column:
    """A column of a line, failing on lines that are too short."""
    items = text.words(line)
    short = F.raise_error(F.concat(F.lit(f"no column {column} in line: "), line)).cast("string")
    return F.when(F.size(items) > column, F.get(items, F.lit(column))).otherwise(short)


def read_conll(
    spark: SparkSession,
    path: str,
    word_col: int = 0,
    tag_col: int = 3,
    keep_unterminated: bool = True,
) -> DataFrame:
    """Labelled column files as sentences; lines of white space part them, whatever the line ends.

    ``keep_unterminated=False`` drops a last sentence that no blank line follows.
    """
    return paragraphs(spark, path, keep_unterminated).select(
        "sent_id",
        F.transform("lines", lambda line: _item(line, word_col)).alias("words"),
        F.transform("lines", lambda line: _item(line, tag_col)).alias("tags"),
    )


def read_unlabeled(spark: SparkSession, path: str, keep_unterminated: bool = True) -> DataFrame:
    """Files with one word per line as sentences; the whole stripped line is the word."""
    return paragraphs(spark, path, keep_unterminated).select("sent_id", F.col("lines").alias("words"))


def parse_eval_lines(lines: DataFrame, delimiter: str = " ", boundary: str = "-X-") -> DataFrame:
    """Evaluation lines (``sent_id, lines``) as sentences with gold tags and guesses.

    The last two items are gold and guess, the first is the word. A line that
    starts with ``boundary`` becomes an outside token of that name, so it ends
    chunks on both sides; scoring does not count it as a token.
    """

    def measure(items: Column) -> Column:
        # Empty items at the end of a line do not count.
        last = F.array_max(F.transform(items, lambda item, i: F.when(item != "", i + 1).otherwise(0)))
        return F.struct(items.alias("items"), F.when(F.element_at(items, -1) != "", F.size(items)).otherwise(last).alias("width"))

    def parse(line: Column) -> Column:
        items, width = line["items"], line["width"]
        first = F.when(width > 0, F.get(items, F.lit(0)))
        edge = first == boundary
        outside = F.lit("O")
        return F.struct(
            first.alias("word"),
            F.when(edge, outside).otherwise(F.get(items, width - 2)).alias("tag"),
            F.when(edge, outside).otherwise(F.get(items, width - 1)).alias("guess"),
            width.alias("width"),
        )

    # Steps of their own, as a lambda evaluates an expression anew wherever it stands: each line is split once.
    split = F.transform("lines", lambda line: F.split(line, delimiter))
    parsed = lines.select("sent_id", F.transform(F.transform(split, measure), parse).alias("rows"))
    return parsed.select(
        "sent_id",
        F.col("rows.word").alias("words"),
        F.col("rows.tag").alias("tags"),
        F.col("rows.guess").alias("guesses"),
        F.array_min("rows.width").alias("narrowest"),
        F.array_max("rows.width").alias("widest"),
    )


def read_eval(
    spark: SparkSession, path: str, delimiter: str = " ", boundary: str = "-X-", cut_at_boundary: bool = False
) -> DataFrame:
    """Evaluation files as sentences; all lines must have the same number of items.

    ``cut_at_boundary`` makes every boundary line a sentence of its own, for files whose
    sentences are parted by such lines only; the scores are the same. The sentences are stored while the
    lines are checked, so the files are parsed once.
    """
    records = paragraphs(spark, path, boundary=boundary if cut_at_boundary else None)
    parsed = stored(parse_eval_lines(records, delimiter, boundary), "eval")
    width = parsed.agg(F.min("narrowest").alias("low"), F.max("widest").alias("high")).first()
    if width.low is not None and width.low < 2:
        raise ValueError("evaluation lines need a gold and a guessed tag")
    if width.low != width.high:
        raise ValueError(f"unexpected number of items: {width.low} to {width.high} per line")
    return parsed.drop("narrowest", "widest")

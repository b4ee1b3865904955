"""Labelled sentences derived from the driver tables.

The tables carry no entity labels. A deterministic rule over the word and its
position gives gold tags and, by another hash, guesses with typical errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators.features import feature_rows, histories
from tagloom.runtime import spread
from tagloom.sources.tables import tokenize

# Chunk types by hash digit modulo 4.
TYPES = ("LOC", "MISC", "ORG", "PER")


def gold_tag(word: Column, pos: Column) -> Column:
    digest = F.md5(word)
    prefix = F.when(F.substring(digest, 1, 1) < "4", "B-").otherwise("I-")
    index = F.conv(F.substring(digest, 2, 1), 16, 10).cast("int") % 4
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), index + 1)
    return F.when((pos > 1) & word.rlike("^[A-Z]"), F.concat(prefix, kind)).otherwise("O")


def guess_tag(word: Column, pos: Column, gold: Column) -> Column:
    digit = F.substring(F.md5(F.concat(word, F.lit(":"), pos.cast("string"))), 1, 1)
    inside = gold != "O"
    swapped = F.concat(F.when(F.substring(gold, 1, 1) == "B", "I").otherwise("B"), F.substr(gold, F.lit(2)))
    return (
        F.when(inside & (digit < "3"), "O")
        .when(digit == "3", "I-PER")
        .when(inside & (digit == "4"), swapped)
        .otherwise(gold)
    )


def label(sentences: DataFrame) -> DataFrame:
    """Add ``tags`` and ``guesses`` by the rules above."""
    gold = sentences.withColumn("tags", F.transform("words", lambda w, i: gold_tag(w, i + 1)))
    pairs = F.transform(F.arrays_zip("words", "tags"), lambda t, i: guess_tag(t["words"], i + 1, t["tags"]))
    return gold.withColumn("guesses", pairs)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the ``conversations`` table, one per text line."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    return tokenize(spread(table), ["conv_id", "turn"], "text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the ``documents`` table, one per text line."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return tokenize(spread(table), ["doc_id"], "text")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label(conversations(spark, sf_dir))


def line_stream(sentences: DataFrame, files: int) -> DataFrame:
    """The raw lines of labelled sentences as streams (``key, line_no, line``), one per conversation turn.

    A line is a token with its tags, a blank line follows each sentence and a null the last. The partitions,
    ``files`` of equal size, hold runs of seven lines, dealt by a hash, so sentences are torn apart and
    later lines may come first.
    """
    fields = F.transform(F.arrays_zip("words", "tags", "guesses"), lambda t: F.concat_ws(" ", t["words"], t["tags"], t["guesses"]))
    rows = sentences.select(
        F.struct("sent_id.conv_id", "sent_id.turn").alias("key"), "sent_id.line_no", F.concat(fields, F.array(F.lit(""))).alias("lines")
    )
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "lines")))
    turns = rows.groupBy("key").agg(F.flatten(F.transform(ordered, lambda s: s["lines"])).alias("lines"))
    ended = F.concat("lines", F.array(F.lit(None).cast("string")))
    lines = turns.select("key", F.posexplode(ended).alias("at", "line"))
    dealt = lines.repartition(files, "key", F.expr("at div 7"))
    return dealt.select("key", (F.col("at") + 1).cast("bigint").alias("line_no"), "line")


def model(sentences: DataFrame) -> DataFrame:
    """Integer weights from the feature counts of a labelled corpus; sums are exact in any order."""
    counts = feature_rows(histories(sentences)).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("feature", (F.col("n") % 7 - 3).cast("double").alias("weight"))

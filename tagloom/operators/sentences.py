"""Sentences as rows: ``sent_id``, ``words ARRAY``, and further arrays such as ``tags``.

``sent_id`` is any orderable column that is unique per sentence, for instance a
number or a struct of table keys. One row holds one sentence, so features,
decoding and scoring need no window and no shuffle to see the neighbours of a token.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.features import START, STOP, TRIGRAM

# array column of a sentence -> column of its tokens
TOKEN_COLUMNS = {"words": "word", "tags": "tag", "guesses": "guess"}
# More tags than this cannot come from a tag inventory; see ``tag_list``.
MAX_TAGS = 10_000


def unpack(sentences: DataFrame) -> DataFrame:
    """One row per token, ``pos`` counted from 1."""
    arrays = [c for c in TOKEN_COLUMNS if c in sentences.columns]
    rows = sentences.select("sent_id", F.posexplode(F.arrays_zip(*arrays)).alias("at", "token"))
    return rows.select(
        "sent_id",
        (F.col("at") + 1).alias("pos"),
        *[F.col(f"token.{c}").alias(TOKEN_COLUMNS[c]) for c in arrays],
    )


def pack(tokens: DataFrame) -> DataFrame:
    """Gather the tokens of every sentence in order: the one shuffle a token table needs."""
    singles = [t for t in TOKEN_COLUMNS.values() if t in tokens.columns]
    ordered = F.sort_array(F.collect_list(F.struct("pos", *singles)))
    packed = tokens.groupBy("sent_id").agg(ordered.alias("tokens"))
    arrays = {t: a for a, t in TOKEN_COLUMNS.items()}
    return packed.select("sent_id", *[F.col(f"tokens.{t}").alias(arrays[t]) for t in singles])


def strip_labels(tokens: DataFrame) -> DataFrame:
    """Decoder input: the tokens without their tags."""
    return tokens.select("sent_id", "pos", "word")


def tag_set(sentences: DataFrame) -> DataFrame:
    """Distinct tags of a corpus."""
    return sentences.select(F.explode(F.array_distinct("tags")).alias("tag")).distinct()


def tags_from_weights(weights: DataFrame) -> DataFrame:
    """Distinct tags of a model: the parts of its trigram features but for the padding."""
    parts = F.slice(F.split("feature", ":"), 2, 3)
    return (
        weights.filter(F.col("feature").startswith(f"{TRIGRAM}:"))
        .select(F.explode(parts).alias("tag"))
        .filter(~F.col("tag").isin(START, STOP))
        .distinct()
    )


def tag_list(tags: DataFrame) -> list[str]:
    """A tag table as a list, in ascending order, after a check of its size."""
    return checked_tags([row.tag for row in tags.select("tag").limit(MAX_TAGS + 1).collect()])


def checked_tags(found: Iterable[str]) -> list[str]:
    """Tags in ascending order, if there are any and not absurdly many."""
    names = sorted(found)
    if not names:
        raise ValueError("no tags: the model has no trigram features, or the corpus is empty")
    if len(names) > MAX_TAGS:
        raise ValueError(f"more than {MAX_TAGS} distinct tags; is the tag column the right one?")
    return names


def tag_lattice(tokens: DataFrame, tags: list[str]) -> DataFrame:
    """Every token with every candidate tag. Fans out inside the row; no join."""
    return tokens.withColumn("candidate", F.explode(F.array(*[F.lit(t) for t in tags])))


def mistakes(sentences: DataFrame) -> DataFrame:
    """Sentences whose guessed tags differ from the gold tags."""
    return sentences.filter(F.col("tags") != F.col("guesses"))


def corpus_stats(sentences: DataFrame) -> DataFrame:
    """Numbers of sentences, tokens and sentences with a mistake."""
    return sentences.agg(
        F.count(F.lit(1)).alias("sentences"),
        F.coalesce(F.sum(F.size("words").cast("bigint")), F.lit(0)).alias("tokens"),
        F.count_if(F.col("tags") != F.col("guesses")).alias("mistakes"),
    )

"""Weight vectors as tables ``feature, weight``: mixing, updates, model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions import features as fx
from tagloom.operators.features import feature_rows, histories
from tagloom.operators.sentences import mistakes, tag_list
from tagloom.runtime import counted, lookup_join


def mean_by_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean per key; sums and counts are combined before the shuffle."""
    return df.groupBy(key).agg(F.avg(value).alias("mean"))


def mix(shard_weights: DataFrame, mode: str = "present", n_shards: int | None = None) -> DataFrame:
    """Parameter mixing of the weights of several shards.

    ``present`` divides by the number of shards which emitted the feature (rows
    with weight 0 count); ``uniform`` divides by ``n_shards``.
    """
    if mode == "present":
        mixed = F.avg("weight")
    elif mode == "uniform" and n_shards:
        mixed = F.sum("weight") / F.lit(n_shards)
    else:
        raise ValueError("mode is 'present', or 'uniform' with n_shards")
    return shard_weights.groupBy("feature").agg(mixed.alias("weight"))


def signed_features(sentences: DataFrame) -> DataFrame:
    """Feature rows of the wrong sentences: +1 for the gold tags, -1 for the guesses.

    Both taggings come out of the same row, so the corpus is read once.
    """
    gold = F.struct(F.col("tags").alias("tags"), F.lit(1).alias("sign"))
    guess = F.struct(F.col("guesses").alias("tags"), F.lit(-1).alias("sign"))
    taggings = mistakes(sentences).select("sent_id", "words", F.inline(F.array(gold, guess)))
    return feature_rows(histories(taggings, stop_word=True))


def perceptron_delta(sentences: DataFrame) -> DataFrame:
    """Summed update of all wrong sentences per feature; entries that cancel stay, as 0."""
    total = F.sum("sign").cast("double").alias("weight")
    return signed_features(sentences).groupBy("feature").agg(total)


def apply_update(weights: DataFrame, delta: DataFrame) -> DataFrame:
    """Add an update to a weight vector, creating new features as needed."""
    both = weights.select("feature", "weight").unionByName(delta.select("feature", "weight"))
    return both.groupBy("feature").agg(F.sum("weight").alias("weight"))


def reset_weights(weights: DataFrame) -> DataFrame:
    """Keep the features, set the weights to 0."""
    return weights.withColumn("weight", F.lit(0.0))


def context_rows(weights: DataFrame) -> DataFrame:
    """Weights keyed by context, so one look-up of a word finds the weights of all tags."""
    feature = F.col("feature")
    return weights.select(
        fx.feature_context(feature).alias("context"), fx.feature_tag(feature).alias("tag"), "weight"
    )


def by_context(weights: DataFrame, tags: list[str]) -> DataFrame:
    """The word and suffix weights as one row per context: ``by_tag ARRAY<STRUCT<tag, weight>>``."""
    rows = context_rows(weights).filter(F.col("tag").isin(tags) & ~F.col("context").startswith(f"{fx.TRIGRAM}:"))
    return rows.groupBy("context").agg(F.collect_list(F.struct("tag", "weight")).alias("by_tag"))


def emission_scores(
    words: DataFrame, tags: list[str], weights: DataFrame, families: tuple[str, ...] = fx.FAMILIES
) -> DataFrame:
    """Score of every distinct word with every tag. ``weights`` is counted, so store or pin it.

    Works on the vocabulary rather than on tokens, and joins contexts rather than
    (context, tag) pairs: one row per word and context meets one row of the model.
    """
    vocabulary = words.select("word").distinct()
    contexts = fx.word_contexts(F.col("word"), families)
    asked = vocabulary.select("word", F.posexplode_outer(contexts).alias("at", "context"))
    # A suffix can be shared by very many words, hence the salted join.
    hits = lookup_join(asked, by_context(weights, tags), "context", ["word"], "left", **counted(weights, "feature"))
    none = F.array().cast("array<struct<tag: string, weight: double>>")
    # Every word has a score for every tag, so its first context brings zeros for all.
    zeros = F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(0.0).alias("weight")) for t in tags])
    padding = F.when(F.coalesce("at", F.lit(0)) == 0, zeros).otherwise(none)
    scores = hits.select("word", F.inline(F.concat(F.coalesce("by_tag", none), padding)))
    return scores.groupBy("word", "tag").agg(F.sum("weight").alias("score"))


def transition_scores(tags: DataFrame, weights: DataFrame) -> DataFrame:
    """Trigram scores for all tag histories, missing ones 0.

    The grid fans out from the tag table; its size depends on the tag set only.
    """
    names = tag_list(tags)
    padded = F.array(*[F.lit(t) for t in [fx.START, *names]])
    ending = F.array(*[F.lit(t) for t in [*names, fx.STOP]])
    grid = (
        tags.sparkSession.range(1)
        .select(F.explode(padded).alias("t2"))
        .withColumn("t1", F.explode(padded))
        .withColumn("tag", F.explode(ending))
        .withColumn("feature", fx.trigram(F.col("t2"), F.col("t1"), F.col("tag")))
    )
    known = weights.filter(F.col("feature").startswith(f"{fx.TRIGRAM}:")).select("feature", "weight")
    return grid.join(known, "feature", "left").select(
        "t2", "t1", "tag", F.coalesce("weight", F.lit(0.0)).alias("score")
    )

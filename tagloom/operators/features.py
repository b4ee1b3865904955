"""Tag histories and feature rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import features as fx
from tagloom.operators.sentences import TOKEN_COLUMNS
from tagloom.runtime import counted, lookup_join

STEP = ("t2", "t1", "tag", "word")


def _steps(stop_word: bool) -> Column:
    """The histories of a sentence as an array."""
    y = F.col("tags")
    padding = F.lit(fx.START)
    steps = F.size(y) + 1
    end = F.lit(fx.STOP) if stop_word else F.lit(None).cast("string")
    return F.arrays_zip(
        F.slice(F.concat(F.array(padding, padding), y), F.lit(1), steps).alias("t2"),
        F.concat(F.array(padding), y).alias("t1"),
        F.concat(y, F.array(F.lit(fx.STOP))).alias("tag"),
        F.concat(F.col("words"), F.array(end)).alias("word"),
    )


def histories(sentences: DataFrame, stop_word: bool = False) -> DataFrame:
    """One row per position with the two previous tags, and a STOP row per sentence.

    The STOP row has no word unless ``stop_word``: training updates look at the
    sentence with STOP appended to it, which adds word features for that position.
    Columns other than the token arrays stay with the rows.
    """
    kept = [c for c in sentences.columns if c not in TOKEN_COLUMNS]
    rows = sentences.select(*kept, F.posexplode(_steps(stop_word)).alias("at", "step"))
    return rows.select(*kept, (F.col("at") + 1).alias("pos"), *[f"step.{c}" for c in STEP])


def _by_family(families: tuple[str, ...], t2: Column, t1: Column, tag: Column, word: Column) -> list[Column]:
    found = []
    if fx.TRIGRAM in families:
        found.append(fx.trigram(t2, t1, tag))
    if fx.TAG in families:
        found.append(F.when(word.isNotNull(), fx.word_tag(word, tag)))
    if fx.SUFF in families:
        found += [fx.suffix_tag(word, j, tag) for j in fx.SUFFIX_LENGTHS]
    return found


def feature_rows(steps: DataFrame, families: tuple[str, ...] = fx.FAMILIES) -> DataFrame:
    """The features of every history, each at most once per position.

    All families come from one pass over the histories, not from a union of scans.
    """
    features = F.array_compact(F.array(*_by_family(families, *map(F.col, STEP))))
    return steps.select(*[c for c in steps.columns if c not in STEP], F.explode(features).alias("feature"))


def feature_counts(sentences: DataFrame, families: tuple[str, ...] = fx.FAMILIES) -> DataFrame:
    """Sentence-level feature vectors as rows.

    A sentence is a row, so its features are sorted and counted by the lengths of their runs inside it.
    """
    per_step = F.transform(_steps(False), lambda step: F.array_compact(F.array(*_by_family(families, *[step[c] for c in STEP]))))
    rows = sentences.select("sent_id", F.array_sort(F.flatten(per_step)).alias("features"))
    before = F.concat(F.array(F.lit(None).cast("string")), "features")
    begins = F.transform(F.arrays_zip(F.col("features").alias("now"), before.alias("before")), lambda x, i: F.when(~x["now"].eqNullSafe(x["before"]), i))
    rows = rows.withColumn("begins", F.array_compact(begins))
    following = F.slice("begins", F.lit(2), F.size("begins"))
    runs = F.zip_with(
        "begins",
        following,
        lambda a, b: F.struct(F.get("features", a).alias("feature"), (b - a).cast("long").alias("n")),
    )
    # The place after the last feature, where only ``before`` has an item, begins the run that closes the last one.
    counted = rows.select("sent_id", F.explode(F.filter(runs, lambda run: run["n"].isNotNull())).alias("run"))
    return counted.select("sent_id", "run.*")


def parse_feature(weights: DataFrame) -> DataFrame:
    """Split feature strings; words and suffixes may hold colons.

    ``context`` is the word, the suffix or ``t2:t1``; ``j`` is the suffix length.
    """
    feature = F.col("feature")
    family = F.substring_index(feature, ":", 1)
    middle = F.regexp_extract(feature, r"(?s)^[^:]*:(.*):[^:]*$", 1)
    suffix = family == fx.SUFF
    return weights.select(
        "feature",
        family.alias("family"),
        F.when(suffix, F.regexp_extract(middle, r"(?s)^(.*):\d+$", 1)).otherwise(middle).alias("context"),
        F.when(suffix, F.substring_index(middle, ":", -1).cast("int")).alias("j"),
        fx.feature_tag(feature).alias("tag"),
    )


def known_features(features: DataFrame, weights: DataFrame) -> DataFrame:
    """Keep the feature rows the model has a weight for. ``weights`` is counted, so store or pin it."""
    return lookup_join(
        features, weights.select("feature"), "feature", ["sent_id", "pos"], "left_semi", **counted(weights, "feature")
    )


def score_features(features: DataFrame, weights: DataFrame) -> DataFrame:
    """Attach weights to feature rows; a missing weight is 0. ``weights`` is counted, so store or pin it."""
    known = weights.select("feature", "weight")
    scored = lookup_join(features, known, "feature", ["sent_id", "pos"], "left", **counted(weights, "feature"))
    return scored.withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def sentence_score(features: DataFrame, weights: DataFrame) -> DataFrame:
    """Inner product of a sentence's feature vector with the weights."""
    return score_features(features, weights).groupBy("sent_id").agg(F.sum("weight").alias("score"))

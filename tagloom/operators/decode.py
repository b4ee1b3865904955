"""Trigram Viterbi decoding of sentences.

Sentences are rows, so decoding is a narrow map over Arrow batches. What differs
is how the word scores reach the tasks: a model whose size was checked is
broadcast and nothing is shuffled; a larger one is joined to the vocabulary of
bounded shards of sentences, and each shard meets only the weights it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from tagloom.functions import features as fx
from tagloom.operators.sentences import checked_tags
from tagloom.operators.viterbi import HISTORY, Transitions, best_paths
from tagloom.operators.weights import by_context
from tagloom.runtime import counted, lookup_join, ship, task_partitions

# Weights, and cells of their context-by-tag matrix, a broadcast may have: every Python worker holds a copy.
MAX_BROADCAST_WEIGHTS = 1_000_000
MAX_BROADCAST_CELLS = 20_000_000
# Trigram weights all tasks need; tag sets that exceed it are out of reach for Viterbi anyway.
MAX_TRIGRAMS = 10_000_000
# Token-by-tag cells of a shard when the model is joined: at most, and when cores would be idle. The
# larger a shard, the more of its tokens share a row of the model.
SHARD_CELLS = 50_000_000
SMALL_SHARD_CELLS = 1_000_000
# Score cells held at a time within a batch.
CHUNK_CELLS = 4_000_000


class WordScores:
    """Scores of contexts for all tags, held as one matrix with a zero last row."""

    def __init__(self, tags: list[str], contexts: pa.Table, families: tuple[str, ...]):
        self.families = families
        self.row = {c: i for i, c in enumerate(contexts.column("context").to_pylist())}
        self.matrix = np.zeros((len(self.row) + 1, len(tags)))
        by_tag = contexts.column("by_tag").combine_chunks()
        rows = np.repeat(np.arange(len(by_tag)), by_tag.value_lengths().to_numpy(zero_copy_only=False))
        names, weights = by_tag.flatten().flatten()
        columns = pc.index_in(names, pa.array(tags, pa.string())).to_numpy(zero_copy_only=False)
        self.matrix[rows, columns] = weights.to_numpy(zero_copy_only=False)

    def of(self, words: list[str]) -> np.ndarray:
        """One row of tag scores per word."""
        missing = len(self.row)
        total = np.zeros((len(words), self.matrix.shape[1]))
        for contexts in word_context_columns(words, self.families):
            total += self.matrix[[self.row.get(c, missing) for c in contexts]]
        return total


def word_context_columns(words: list[str], families: tuple[str, ...]) -> Iterator[list[str | None]]:
    """Context strings of words, a list per kind of context; None for too short words."""
    if fx.TAG in families:
        yield [f"{fx.TAG}:{w}" for w in words]
    if fx.SUFF in families:
        for j in fx.SUFFIX_LENGTHS:
            yield [f"{fx.SUFF}:{w[-j:]}:{j}" if len(w) >= j else None for w in words]


def _chunks(lengths: np.ndarray, cells: int) -> Iterator[tuple[int, int]]:
    """Runs of sentences whose tokens need at most CHUNK_CELLS score cells."""
    low, used = 0, 0
    for high, need in enumerate(lengths * cells):
        if used and used + need > CHUNK_CELLS:
            yield low, high
            low, used = high, 0
        used += need
    yield low, len(lengths)


def _decode_words(
    words: pa.ListArray, tags: list[str], scores: WordScores, moves: Transitions
) -> tuple[pa.ListArray, pa.Array]:
    """Tags and score of every sentence in an Arrow column of word lists."""
    lengths = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    by_word = scores.of(coded.dictionary.to_pylist())
    token_word = coded.indices.to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    found, totals = [], []
    for low, high in _chunks(lengths, moves.size**2):
        part = token_word[offsets[low] : offsets[high]]
        path, total = best_paths(lengths[low:high], by_word[part], moves)
        found.append(path)
        totals.append(total)
    names = pa.array(tags, pa.string()).take(pa.array(np.concatenate(found)))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names), pa.array(np.concatenate(totals))


def transition_rows(weights: DataFrame) -> pa.Table:
    """The trigram weights of a model; their number is bounded by the tag set, not the data."""
    rows = weights.filter(F.col("feature").startswith(f"{fx.TRIGRAM}:"))
    if rows.count() > MAX_TRIGRAMS:
        raise ValueError(f"more than {MAX_TRIGRAMS} trigram weights")
    parts = F.split("feature", ":")
    columns = [F.get(parts, F.lit(i + 1)).alias(name) for i, name in enumerate(HISTORY)]
    return rows.select(*columns, "weight").toArrow()


def shard_contexts(sharded: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """The contexts each shard can ask for: one row per shard and context.

    Distinct words are taken before the contexts, so a hot word is one row per shard.
    """
    words = sharded.select("shard", F.explode(F.array_distinct("words")).alias("word")).distinct()
    asked = words.select("shard", F.explode(fx.word_contexts(F.col("word"), families)).alias("context"))
    return asked.distinct()


def shard_weights(asked: DataFrame, weights: DataFrame, tags: list[str]) -> DataFrame:
    """The word and suffix weights of a model that each shard, here ``owner``, needs."""
    hits = lookup_join(asked, by_context(weights, tags), "context", ["shard"], "inner", **counted(weights, "feature"))
    return hits.select(F.col("shard").alias("owner"), "context", "by_tag")


def output_schema(sentences: DataFrame) -> StructType:
    """Columns of decoded sentences."""
    return StructType(
        [
            sentences.schema["sent_id"],
            sentences.schema["words"],
            StructField("tags", ArrayType(StringType())),
            StructField("score", DoubleType()),
        ]
    )


def _table(batch: pa.RecordBatch | pa.Table, decoded: tuple[pa.ListArray, pa.Array]) -> pa.RecordBatch:
    names = ["sent_id", "words", "tags", "score"]
    return pa.RecordBatch.from_arrays([batch.column("sent_id"), batch.column("words"), *decoded], names=names)


def _broadcast_decoder(
    sentences: DataFrame, tags: list[str], moves: Transitions, scores: WordScores
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    model = sentences.sparkSession.sparkContext.broadcast((tags, moves, scores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, trigrams, word_scores = model.value
        for batch in batches:
            if batch.num_rows:
                yield _table(batch, _decode_words(batch.column("words"), names, word_scores, trigrams))

    return run


def decode(
    sentences: DataFrame,
    weights: DataFrame,
    families: tuple[str, ...] = fx.DECODER_FAMILIES,
    tags: list[str] | None = None,
    max_broadcast: int = MAX_BROADCAST_WEIGHTS,
) -> DataFrame:
    """Best tag sequence and its score for every sentence.

    ``weights`` should be a stored or pinned table: its size is checked first. The
    candidate tags are those of the model's trigrams (``tags_from_weights``) unless given.
    """
    ship(sentences.sparkSession)
    asked = sentences.select("sent_id", "words").filter(F.size("words") > 0)
    trigrams = transition_rows(weights)
    found = {tag for c in HISTORY for tag in trigrams.column(c).unique().to_pylist()} - {fx.START, fx.STOP}
    names = checked_tags(tags or found)[::-1]
    moves = Transitions(names, trigrams if fx.TRIGRAM in families else trigrams.slice(0, 0), fx.START, fx.STOP)
    schema = output_schema(asked)
    if weights.count() <= max_broadcast:
        contexts = by_context(weights, names).toArrow()
        if contexts.num_rows * len(names) <= MAX_BROADCAST_CELLS:
            scores = WordScores(names, contexts, tuple(families))
            return asked.mapInArrow(_broadcast_decoder(asked, names, moves, scores), schema)
    if asked.isStreaming:
        raise ValueError("the model is too large to broadcast: decode the stream with streaming.decode_to, by foreachBatch")
    return _decode_by_shard(asked, weights, names, moves, tuple(families), schema)


def _decode_by_shard(
    sentences: DataFrame,
    weights: DataFrame,
    tags: list[str],
    moves: Transitions,
    families: tuple[str, ...],
    schema: StructType,
) -> DataFrame:
    tokens = sentences.agg(F.sum(F.size("words").cast("bigint"))).first()[0] or 0
    cells = tokens * len(tags)
    cores = sentences.sparkSession.sparkContext.defaultParallelism
    n_shards = max(cells // SHARD_CELLS, min(4 * cores, cells // SMALL_SHARD_CELLS)) + 1
    sharded = sentences.withColumn("shard", F.pmod(F.xxhash64("sent_id"), F.lit(n_shards)))
    partitions = task_partitions(sentences.sparkSession, n_shards)
    needed = shard_weights(shard_contexts(sharded, families), weights, tags).repartition(partitions, "owner")
    model = sentences.sparkSession.sparkContext.broadcast((tags, moves))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, trigrams = model.value
        scores = WordScores(names, right, families)
        batches = [b for b in left.to_batches() if b.num_rows]
        return pa.Table.from_batches(
            [_table(b, _decode_words(b.column("words"), names, scores, trigrams)) for b in batches]
        )

    placed = sharded.repartition(partitions, "shard")
    return placed.groupBy("shard").cogroup(needed.groupBy("owner")).applyInArrow(run, schema)

"""Registered queries: every operator over a whole driver table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom import streaming
from tagloom.functions import features as fx
from tagloom.functions import tags as tg
from tagloom.functions.sql import register
from tagloom.operators import evaluate as ev
from tagloom.operators import features as ft
from tagloom.operators import sentences as st
from tagloom.operators import weights as wt
from tagloom.operators.combine import combine_by_key
from tagloom.operators.decode import decode
from tagloom.operators.train import assign_shards, train
from tagloom.plans import corpora
from tagloom.runtime import pin, scratch_path
from tagloom.sources import columns, sinks
from tagloom.sources import weights as weight_files
from tagloom.sources.tables import tokenize
from tagloom.streaming import lines as lines_of

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

KEYS = ("conv_id", "turn", "line_no")
SHARDS = 8


def query(run: Query) -> Query:
    REGISTRY[run.__name__] = run
    return run


def keyed(df: DataFrame) -> DataFrame:
    """Show the parts of the sentence key as columns."""
    return df.select("sent_id.*", *[c for c in df.columns if c != "sent_id"])


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _positive(weights: DataFrame) -> DataFrame:
    return weights.filter(F.col("weight") > 0)


def _features(spark: SparkSession, sf: str, families: tuple[str, ...] = fx.FAMILIES) -> DataFrame:
    return ft.feature_rows(ft.histories(corpora.labelled(spark, sf)), families)


def _model(spark: SparkSession, sf: str) -> DataFrame:
    return corpora.model(corpora.labelled(spark, sf))


# Sources and sinks


@query
def tokenize_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(st.unpack(corpora.conversations(spark, sf)))


@query
def tokenize_documents(spark: SparkSession, sf: str) -> DataFrame:
    tokens = st.unpack(corpora.documents(spark, sf))
    return keyed(tokens).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("tokens"), F.max("line_no").alias("lines"), F.max("pos").alias("longest")
    )


def _written(lines: DataFrame) -> str:
    path = scratch_path(lines.sparkSession, "lines")
    sinks.write_lines(lines, path)
    return path


@query
def read_conll(spark: SparkSession, sf: str) -> DataFrame:
    sentences = corpora.labelled(spark, sf)
    four = F.transform(F.arrays_zip("words", "tags"), lambda t: F.concat_ws(" ", t["words"], F.lit("X X"), t["tags"]))
    lines = F.concat(F.array_join(four, "\n"), F.lit("\n"))
    path = _written(sentences.select("sent_id", lines.alias("lines")))
    return st.unpack(columns.read_conll(spark, path))


@query
def read_unlabeled(spark: SparkSession, sf: str) -> DataFrame:
    lines = corpora.conversations(spark, sf).select(
        "sent_id", F.concat(F.array_join("words", "\n"), F.lit("\n")).alias("lines")
    )
    return st.unpack(columns.read_unlabeled(spark, _written(lines)))


@query
def read_weights(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "weights")
    weight_files.write_weights(_model(spark, sf), path, fmt="text")
    return weight_files.read_weights(spark, path)


@query
def weights_to_text(spark: SparkSession, sf: str) -> DataFrame:
    return weight_files.weights_to_text(_model(spark, sf))


@query
def decode_output_lines(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(sinks.tagged_lines(corpora.labelled(spark, sf)))


@query
def eval_parse_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = sinks.eval_lines(corpora.labelled(spark, sf))
    parsed = columns.parse_eval_lines(lines.select("sent_id", F.array_remove(F.split("lines", "\n"), "").alias("lines")))
    tokens = st.unpack(parsed)
    return keyed(tokens).withColumnsRenamed({"word": "first_item", "tag": "correct_tag", "guess": "guessed_tag"})


@query
def read_eval(spark: SparkSession, sf: str) -> DataFrame:
    return st.unpack(columns.read_eval(spark, _written(sinks.eval_lines(corpora.labelled(spark, sf)))))


@query
def make_eval_lines(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(sinks.eval_lines(_joined(spark, sf)))


@query
def unlabeled_projection(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(st.strip_labels(st.unpack(corpora.labelled(spark, sf))))


# Projections and filters


@query
def features_trigram(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(_features(spark, sf, (fx.TRIGRAM,)))


@query
def features_tag(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(_features(spark, sf, (fx.TAG,)))


@query
def features_suffix(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(_features(spark, sf, (fx.SUFF,)))


@query
def feature_vector(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(_features(spark, sf))


@query
def parse_feature(spark: SparkSession, sf: str) -> DataFrame:
    return ft.parse_feature(_model(spark, sf))


@query
def known_feature_filter(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(ft.known_features(_features(spark, sf), _positive(pin(_model(spark, sf)))))


@query
def mistakes(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(st.mistakes(corpora.labelled(spark, sf)).select("sent_id"))


@query
def eval_tag_split(spark: SparkSession, sf: str) -> DataFrame:
    tokens = ev.split_tag(st.unpack(corpora.labelled(spark, sf)))
    return keyed(tokens).select(*KEYS, "pos", "prefix", "type", "guess_prefix", "guess_type")


@query
def eval_raw_mode(spark: SparkSession, sf: str) -> DataFrame:
    sentences = corpora.labelled(spark, sf)
    bare = sentences.withColumns({a: F.transform(a, _bare) for a in ("tags", "guesses")})
    return keyed(st.unpack(ev.raw_tags(bare, outside="NONE"))).select(*KEYS, "pos", "tag", "guess")


def _bare(tag: Column) -> Column:
    """A tag without its prefix, ``NONE`` outside chunks."""
    return F.when(tag == tg.OUTSIDE, "NONE").otherwise(tg.chunk_type(tag))


@query
def pad_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(ft.histories(corpora.labelled(spark, sf), stop_word=True))


# Joins


@query
def weight_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(ft.score_features(_features(spark, sf), _positive(pin(_model(spark, sf)))))


@query
def tag_lattice(spark: SparkSession, sf: str) -> DataFrame:
    sentences = corpora.labelled(spark, sf)
    lattice = st.tag_lattice(st.unpack(sentences.select("sent_id", "words")), st.tag_list(st.tag_set(sentences)))
    return keyed(lattice)


def _joined(spark: SparkSession, sf: str) -> DataFrame:
    sentences = corpora.labelled(spark, sf)
    predicted = sentences.select("sent_id", F.col("guesses").alias("tags"))
    return ev.join_gold_pred(sentences, predicted)


@query
def join_gold_pred(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(st.unpack(_joined(spark, sf)))


# Aggregations


@query
def mean_by_key(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet")
    return rounded(wt.mean_by_key(events, "event_type", "value"), "mean")


@query
def combine_mean(spark: SparkSession, sf: str) -> DataFrame:
    """The mean by the user functions of a fold."""
    events = spark.read.parquet(f"{sf}/events.parquet").filter("value is not null")
    sums = combine_by_key(
        events, "event_type", "value",
        lambda v: (v, 1), lambda c, v: (c[0] + v, c[1] + 1), lambda a, b: (a[0] + b[0], a[1] + b[1]),
        "struct<total: double, n: bigint>",
    )
    return rounded(sums.select("event_type", (F.col("combined.total") / F.col("combined.n")).alias("mean")), "mean")


@query
def combine_top_values(spark: SparkSession, sf: str) -> DataFrame:
    """The three largest distinct values per key: a fold that no built-in aggregate does in bounded space."""
    events = spark.read.parquet(f"{sf}/events.parquet").filter("value is not null")

    def largest(values: list[float]) -> list[float]:
        return sorted(set(values), reverse=True)[:3]

    top = combine_by_key(
        events, "event_type", "value",
        lambda v: [v], lambda c, v: c if len(c) == 3 and v <= c[2] else largest([*c, v]), lambda a, b: largest(a + b),
        "array<double>",
    )
    places = [F.get("combined", F.lit(i)).alias(name) for i, name in enumerate(("first", "second", "third"))]
    return top.select("event_type", *places)


def _shard_weights(spark: SparkSession, sf: str) -> DataFrame:
    sharded = assign_shards(corpora.labelled(spark, sf), SHARDS, "contiguous")
    rows = ft.feature_rows(ft.histories(sharded))
    counts = rows.groupBy("shard", "feature").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("shard", "feature", (F.col("n") % 7 - 3).cast("double").alias("weight"))


@query
def mix_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(wt.mix(_shard_weights(spark, sf)), "weight")


@query
def mix_weights_uniform(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(wt.mix(_shard_weights(spark, sf), "uniform", SHARDS), "weight")


@query
def inner_product(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(ft.sentence_score(_features(spark, sf), pin(_model(spark, sf))))


@query
def feature_counts(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(ft.feature_counts(corpora.labelled(spark, sf)))


@query
def tag_set(spark: SparkSession, sf: str) -> DataFrame:
    return st.tag_set(corpora.labelled(spark, sf))


@query
def tags_from_weights(spark: SparkSession, sf: str) -> DataFrame:
    return st.tags_from_weights(_model(spark, sf))


@query
def collect_sentences(spark: SparkSession, sf: str) -> DataFrame:
    packed = st.pack(st.unpack(corpora.labelled(spark, sf)))
    return keyed(packed).select(
        *KEYS, *[F.array_join(a, " ").alias(a) for a in ("words", "tags", "guesses")]
    )


@query
def sentence_stats(spark: SparkSession, sf: str) -> DataFrame:
    return st.corpus_stats(corpora.labelled(spark, sf))


# Windows over tags


@query
def history_trigrams(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(ft.histories(corpora.labelled(spark, sf)).drop("word"))


@query
def eval_prev_tags(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(ev.previous_tags(corpora.labelled(spark, sf)))


@query
def eval_correct_scan(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(ev.correct_scan(corpora.labelled(spark, sf)))


# Model


@query
def emission_scores(spark: SparkSession, sf: str) -> DataFrame:
    sentences = corpora.labelled(spark, sf)
    model = pin(corpora.model(sentences))
    return wt.emission_scores(st.unpack(sentences), st.tag_list(st.tags_from_weights(model)), model)


@query
def transition_scores(spark: SparkSession, sf: str) -> DataFrame:
    model = pin(_model(spark, sf))
    return wt.transition_scores(st.tags_from_weights(model), model)


@query
def viterbi_decode(spark: SparkSession, sf: str) -> DataFrame:
    """The decoder: trigrams and words."""
    sentences = corpora.conversations(spark, sf)
    return keyed(st.unpack(decode(sentences, pin(_model(spark, sf))).drop("score")))


@query
def viterbi_score(spark: SparkSession, sf: str) -> DataFrame:
    """The scores with all families, as in training."""
    sentences = corpora.conversations(spark, sf)
    found = decode(sentences, pin(_model(spark, sf)), fx.FAMILIES)
    return keyed(found.select("sent_id", "score"))


@query
def viterbi_decode_joined(spark: SparkSession, sf: str) -> DataFrame:
    """The decoder for models too large to broadcast."""
    sentences = corpora.conversations(spark, sf)
    return keyed(st.unpack(decode(sentences, pin(_model(spark, sf)), max_broadcast=0).drop("score")))


@query
def perceptron_delta(spark: SparkSession, sf: str) -> DataFrame:
    return wt.perceptron_delta(corpora.labelled(spark, sf))


@query
def apply_update(spark: SparkSession, sf: str) -> DataFrame:
    return wt.apply_update(_model(spark, sf), wt.perceptron_delta(corpora.labelled(spark, sf)))


@query
def reset_weights(spark: SparkSession, sf: str) -> DataFrame:
    return wt.reset_weights(_model(spark, sf))


@query
def train_parameter_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return train(corpora.labelled(spark, sf), epochs=5)


@query
def train_iterative_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return train(corpora.labelled(spark, sf), epochs=1, rounds=3)


@query
def train_pm_singleton(spark: SparkSession, sf: str) -> DataFrame:
    """One sentence per shard and one epoch: the only training with a plain SQL answer."""
    sentences = corpora.labelled(spark, sf)
    return rounded(train(sentences, n_shards=sentences.count(), epochs=1, rule="contiguous"), "weight")


@query
def train_iterative_singleton(spark: SparkSession, sf: str) -> DataFrame:
    """Two rounds of one-sentence shards: the second decodes with the mixed weights."""
    sentences = corpora.labelled(spark, sf)
    found = train(sentences, n_shards=sentences.count(), epochs=1, rounds=2, rule="contiguous")
    return rounded(found, "weight")


def _trained_items(spark: SparkSession, sf: str, n_shards: int, epochs: int, rounds: int) -> DataFrame:
    """Weights from the benchmark's sentences. Means over two shards are exact, so ties do not hang on rounding."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    gold = corpora.label(tokenize(items, ["item_id"], "text"))
    return rounded(train(gold, n_shards, epochs, rounds, rule="contiguous"), "weight")


@query
def train_items_one_shard(spark: SparkSession, sf: str) -> DataFrame:
    """Sequential training: one shard, five passes."""
    return _trained_items(spark, sf, 1, 5, 1)


@query
def train_items_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """One-shot mixing: two shards of many sentences, five passes each."""
    return _trained_items(spark, sf, 2, 5, 1)


@query
def train_items_iterative(spark: SparkSession, sf: str) -> DataFrame:
    """Iterative mixing: three rounds of two shards, which start from the mixed weights."""
    return _trained_items(spark, sf, 2, 1, 3)


@query
def shard_assign(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(assign_shards(corpora.conversations(spark, sf), SHARDS, "contiguous").select("sent_id", "shard"))


@query
def shard_assign_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Contiguous shards of equal work."""
    return keyed(assign_shards(corpora.conversations(spark, sf), SHARDS, "tokens").select("sent_id", "shard"))


# SQL text


@query
def sql_chunk_events(spark: SparkSession, sf: str) -> DataFrame:
    """Tag parts and chunk edges of both sides, in SQL."""
    register(spark)
    corpora.labelled(spark, sf).createOrReplaceTempView("labelled")
    return spark.sql("""
        WITH sides AS (
          SELECT sent_id, concat(array('O'), tags) AS before, concat(tags, array('O')) AS tag,
                 concat(array('O'), guesses) AS guess_before, concat(guesses, array('O')) AS guess
          FROM labelled
        ),
        pairs AS (SELECT sent_id, posexplode(arrays_zip(before, tag, guess_before, guess)) AS (at, p) FROM sides)
        SELECT sent_id.*, at + 1 AS pos, tag_prefix(p.tag) AS prefix, tag_type(p.tag) AS type,
               chunk_starts(p.before, p.tag) AS open_gold, chunk_starts(p.guess_before, p.guess) AS open_guess,
               chunk_ended(p.before, p.tag) AS end_gold, chunk_ended(p.guess_before, p.guess) AS end_guess
        FROM pairs""")


@query
def sql_features(spark: SparkSession, sf: str) -> DataFrame:
    """Feature strings taken apart and counted, in SQL: cells of the model per family, tag and suffix length."""
    register(spark)
    _model(spark, sf).createOrReplaceTempView("model")
    return spark.sql("""
        SELECT feature_family(feature) AS family, feature_tag(feature) AS tag, feature_length(feature) AS j,
               count(*) AS features, count(DISTINCT feature_context(feature)) AS contexts, sum(weight) AS weight,
               max(feature_context(feature)) AS last_context
        FROM model GROUP BY ALL""")


@query
def sql_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the documents by their last two characters, from the text on in SQL."""
    register(spark)
    spark.read.parquet(f"{sf}/documents.parquet").createOrReplaceTempView("texts")
    return spark.sql("""
        WITH lines AS (SELECT explode(split(text, '\\n')) AS line FROM texts),
             listed AS (SELECT line_words(strip_line(line)) AS words FROM lines),
             words AS (SELECT explode(words) AS word FROM listed)
        SELECT word_suffix(word, 2) AS suffix, count(*) AS n, count(DISTINCT word) AS words FROM words
        WHERE word_suffix(word, 2) IS NOT NULL GROUP BY word_suffix(word, 2)""")


# Evaluation


@query
def eval_chunk_starts(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(ev.chunk_starts(corpora.labelled(spark, sf)))


@query
def eval_chunk_ends(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(ev.chunk_ends(corpora.labelled(spark, sf)))


@query
def eval_chunks_gold(spark: SparkSession, sf: str) -> DataFrame:
    return ev.count_chunks(corpora.labelled(spark, sf), "found_gold")


@query
def eval_chunks_guess(spark: SparkSession, sf: str) -> DataFrame:
    return ev.count_chunks(corpora.labelled(spark, sf), "found_guess")


@query
def eval_chunks_correct(spark: SparkSession, sf: str) -> DataFrame:
    return ev.count_chunks(corpora.labelled(spark, sf), "correct_chunks")


@query
def eval_token_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return ev.token_accuracy(corpora.labelled(spark, sf))


@query
def chunk_spans(spark: SparkSession, sf: str) -> DataFrame:
    return keyed(ev.chunk_spans(corpora.labelled(spark, sf)))


@query
def prf(spark: SparkSession, sf: str) -> DataFrame:
    """Scores per conversation turn: the same counts, grouped by other keys."""
    facts = ev.sentence_facts(corpora.labelled(spark, sf))
    counts = facts.groupBy(F.col("sent_id.turn").alias("turn")).agg(*[F.sum(c).alias(c) for c in ev.COUNTS])
    return rounded(ev.prf(counts), "precision", "recall", "f1")


@query
def eval_overall(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.evaluate(corpora.labelled(spark, sf)), "accuracy", "precision", "recall", "f1")


@query
def eval_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.evaluate_by_type(corpora.labelled(spark, sf)), "precision", "recall", "f1")


@query
def eval_sorted_types(spark: SparkSession, sf: str) -> DataFrame:
    return ev.sorted_types(corpora.labelled(spark, sf))


@query
def eval_report_text(spark: SparkSession, sf: str) -> DataFrame:
    return ev.report(corpora.labelled(spark, sf), "text")


@query
def eval_report_latex(spark: SparkSession, sf: str) -> DataFrame:
    return ev.report(corpora.labelled(spark, sf), "latex")


@query
def eval_documents(spark: SparkSession, sf: str) -> DataFrame:
    sentences = corpora.label(corpora.documents(spark, sf))
    return rounded(ev.evaluate(sentences), "accuracy", "precision", "recall", "f1")


@query
def tag_and_score(spark: SparkSession, sf: str) -> DataFrame:
    """End to end: tokenize, decode with the corpus model, score against the gold tags."""
    gold = corpora.labelled(spark, sf)
    predicted = decode(gold, pin(corpora.model(gold)), fx.FAMILIES)
    scored = ev.evaluate_by_type(ev.join_gold_pred(gold, predicted))
    return rounded(scored, "precision", "recall", "f1")


# Streams


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    table = streaming.stream_table(spark, f"{sf}/conversations.parquet")
    return tokenize(table, ["conv_id", "turn"], "text")


@query
def stream_decode(spark: SparkSession, sf: str) -> DataFrame:
    found = streaming.run_decoded(_stream(spark, sf), pin(_model(spark, sf)))
    return keyed(st.unpack(found.drop("score")))


@query
def stream_decode_joined(spark: SparkSession, sf: str) -> DataFrame:
    """The stream with a model too large to broadcast: each micro-batch joins its own shards."""
    path = scratch_path(spark, "decoded")
    streaming.decode_to(_stream(spark, sf), pin(_model(spark, sf)), path, max_broadcast=0).awaitTermination()
    return keyed(st.unpack(spark.read.parquet(path).drop("score", "batch")))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Raw evaluation lines as a stream of four micro-batches, of as many files as keep the cores busy."""
    path = scratch_path(spark, "lines")
    files = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    corpora.line_stream(corpora.labelled(spark, sf), 4 * files).write.parquet(path)
    return streaming.stream_table(spark, path, files_per_batch=files)


@query
def stream_lines_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences are made from lines as they arrive, then decoded."""
    sentences = lines_of.stream_sentences(_lines(spark, sf))
    words = F.transform("lines", lambda line: F.substring_index(line, " ", 1))
    found = streaming.run_decoded(sentences.select("sent_id", words.alias("words")), pin(_model(spark, sf)))
    tokens = st.unpack(found.drop("score"))
    return tokens.select("sent_id.key.*", "sent_id.sentence", "pos", "word", "tag")


@query
def stream_lines_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of a line stream from its running counts."""
    updates = streaming.run_updates(lines_of.stream_line_counts(_lines(spark, sf)))
    return rounded(ev.by_type(lines_of.latest_counts(updates)), "precision", "recall", "f1")


@query
def stream_eval_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = streaming.run_counts(streaming.stream_counts(corpora.label(_stream(spark, sf))))
    return counts.filter(F.col("type").isNotNull()).select("type", *ev.COUNTS[2:])

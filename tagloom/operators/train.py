"""Distributed training of a structured perceptron by parameter mixing.

Each shard of sentences is trained on its own, in order, as online updates ask
for; the weights of all shards are then mixed by one aggregate. One round of
several epochs is one-shot mixing; several rounds of one epoch are iterative mixing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions import features as fx
from tagloom.operators.decode import WordScores, shard_contexts, shard_weights, transition_rows, word_context_columns
from tagloom.operators.sentences import MAX_TAGS, checked_tags
from tagloom.operators.viterbi import CELLS, HISTORY, Transitions, best_path, best_paths_apart
from tagloom.runtime import MAX_PARTITIONS, broadcast_if_small, even_keys, pin, ship, stored_bucketed

# Tokens of a shard when the number of shards is left open.
SHARD_TOKENS = 50_000
# One row per partition of a sorted table.
MAX_BROADCAST_PARTITIONS = 1_000_000

NO_TRIGRAMS = pa.table({**{c: pa.array([], pa.string()) for c in HISTORY}, "weight": pa.array([], pa.float64())})
DELTA_SCHEMA = "feature string, delta double, made bigint"
# Shards that learn in step, and cells of their weights; token-by-tag cells of a bundle of shards, which a task holds.
TEAM, TEAM_CELLS = 128, 40_000_000
BUNDLE_CELLS = 50_000_000
# Fewer sentences than this are decoded faster one by one.
FEW = 4


def _sorted_parts(sentences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids and token counts in corpus order with the ``part`` of a range-partitioned sort and the ``row``
    inside it, pinned; and for every part what the parts before it add to row numbers and tokens."""
    slim = sentences.select("sent_id", F.size("words").cast("bigint").alias("tokens"))
    ids = slim.orderBy("sent_id").withColumn("row", F.monotonically_increasing_id())
    ordered = pin(ids).withColumn("part", F.shiftright("row", 33))
    sizes = ordered.groupBy("part").agg(
        F.min("row").alias("first_row"), F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("size")
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before, base = (F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in ("n", "size"))
    shifts = pin(sizes.select("part", (before - F.col("first_row") + 1).alias("shift"), base.alias("base"), "size"))
    return ordered, shifts


def corpus_ranks(sentences: DataFrame) -> DataFrame:
    """Rank of every sentence in corpus order, from 1, without a global window.

    The row number inside a part of the sorted ids plus the number of rows in the parts before.
    """
    ordered, shifts = _sorted_parts(sentences)
    placed = ordered.join(broadcast_if_small(shifts.select("part", "shift"), MAX_BROADCAST_PARTITIONS), "part")
    return placed.select("sent_id", (F.col("row") + F.col("shift")).alias("rank"))


def token_offsets(sentences: DataFrame) -> tuple[DataFrame, int]:
    """``sent_id, before``: the tokens of all sentences earlier in corpus order; and the number of all tokens.

    A prefix sum in two levels: running sums inside each part of the sorted ids, raised by the parts before.
    """
    ordered, shifts = _sorted_parts(sentences)
    total = shifts.agg(F.sum("size")).first()[0] or 0
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    running = ordered.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    placed = running.join(broadcast_if_small(shifts.select("part", "base"), MAX_BROADCAST_PARTITIONS), "part")
    return placed.select("sent_id", (F.col("base") + F.col("inside")).alias("before")), total


def assign_shards(sentences: DataFrame, n_shards: int, rule: str = "hash") -> DataFrame:
    """Add the ``shard`` of every sentence, from 0.

    ``contiguous`` cuts the corpus into ordered slices of as many sentences each, ``tokens`` into ordered
    slices of as many tokens: a sentence belongs to the slice in which it starts, so a shard is within
    one sentence of the mean. ``hash`` needs no order and no extra pass.
    """
    if rule == "hash":
        return sentences.withColumn("shard", F.pmod(F.xxhash64("sent_id"), F.lit(n_shards).cast("bigint")))
    if rule == "tokens":
        offsets, tokens = token_offsets(sentences)
        starts = offsets.select("sent_id", F.expr(f"({n_shards}L * before) div {max(tokens, 1)}L").alias("shard"))
        return sentences.join(starts, "sent_id")
    if rule != "contiguous":
        raise ValueError("rule is 'hash', 'contiguous' or 'tokens'")
    ranks = corpus_ranks(sentences)
    total = ranks.count()
    slices = ranks.select("sent_id", F.expr(f"({n_shards}L * rank - 1) div {max(total, 1)}L").alias("shard"))
    return sentences.join(slices, "sent_id")


def _profile(corpus: DataFrame) -> tuple[list[str], int]:
    """Tags in ascending order and the number of tokens, from one pass."""
    size = F.struct(F.lit(None).cast("string").alias("tag"), F.size("words").cast("bigint").alias("tokens"))
    tags = F.transform(F.array_distinct("tags"), lambda t: F.struct(t.alias("tag"), F.lit(0).cast("bigint").alias("tokens")))
    sums = corpus.select(F.inline(F.concat(F.array(size), tags))).groupBy("tag").agg(F.sum("tokens").alias("tokens"))
    found = {row.tag: row.tokens for row in sums.limit(MAX_TAGS + 2).collect()}
    tokens = found.pop(None, 0)
    return checked_tags(found), tokens


class TeamTrainer:
    """Online updates over the sentences of several shards, a team, each with weights of its own.

    Shards do not depend on each other, so they learn in step: the next sentence of each is decoded in the
    same array operations. Contexts are numbered per shard, as rows of one matrix; ``counts`` and ``touched``
    hold the updates per (row, tag), so counts that cancel stay, as 0.
    """

    def __init__(self, tags: list[str], families: tuple[str, ...], moves: Transitions, scores: np.ndarray, members: int):
        self.families, self.size, self.scores = families, len(tags), scores
        self.moves = moves.copies(members)
        self.side = None if moves.whole is None else self.moves[0].whole.base
        # Short words lack some contexts and point at the last, unused row.
        self.unused = len(scores) - 1
        self.counts, self.touched = np.zeros(scores.shape, np.int32), np.zeros(scores.shape, bool)
        self.trigrams = [np.zeros((2, 0), dtype=np.int64)]
        self.pending = 0
        self.wrong = np.zeros(members, bool)

    def _guess(self, lengths: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """Paths of a sentence of each of the first members."""
        ends = np.cumsum(lengths)
        cells = lengths * self.size**2
        if self.side is None or len(lengths) < FEW or cells.max() > CELLS:
            parts = zip(ends - lengths, ends, self.moves)
            return np.concatenate([best_path(gain[low:high], moves) for low, high, moves in parts])
        found, low = [], 0
        while low < len(lengths):
            high = low + max(1, int(np.searchsorted(np.cumsum(cells[low:]), CELLS, side="right")))
            words = slice(ends[low] - lengths[low], ends[high - 1])
            found.append(best_paths_apart(lengths[low:high], gain[words], self.side[low:high]))
            low = high
        return np.concatenate(found)

    def learn(self, lengths: np.ndarray, rows: np.ndarray, gold: np.ndarray) -> None:
        """The next sentence of each of the first members, one after the other in ``rows`` and ``gold``."""
        guess = self._guess(lengths, self.scores[rows].sum(axis=1))
        wrong = np.logical_or.reduceat(guess != gold, np.cumsum(lengths) - lengths)
        members = np.flatnonzero(wrong)
        if len(members):
            self.wrong[members] = True
            inside = np.repeat(wrong, lengths)
            for path, sign in ((gold, 1), (guess, -1)):
                self._shift(members, lengths[members], rows[inside], path[inside], sign)

    def _shift(self, members: np.ndarray, lengths: np.ndarray, rows: np.ndarray, path: np.ndarray, sign: int) -> None:
        if fx.TRIGRAM in self.families:
            nth = np.arange(len(members))
            padded = np.full(len(path) + 3 * len(members), self.size)
            padded[np.arange(len(path)) + np.repeat(3 * nth + 2, lengths)] = path
            at = np.arange(len(path) + len(members)) + np.repeat(2 * nth, lengths + 1)
            history, owner = np.stack([padded[at], padded[at + 1], padded[at + 2]], axis=1), np.repeat(members, lengths + 1)
            side = self.size + 1
            codes = owner * side**3 + history @ [side * side, side, 1]
            if self.side is None:
                for member in members.tolist():
                    self.moves[member].add(history[owner == member], sign)
            else:
                np.add.at(self.side.reshape(-1), codes, float(sign))
            self.trigrams.append(np.stack([codes, np.full(len(codes), sign)]))
            self.pending += len(codes)
            if self.pending > CELLS:
                self._compact()
        real = rows != self.unused
        cells = (rows * self.size + path[:, None])[real]
        # Amounts of the arrays' own types, which numpy adds without a cast for each.
        np.add.at(self.scores.reshape(-1), cells, float(sign))
        np.add.at(self.counts.reshape(-1), cells, np.int32(sign))
        self.touched.reshape(-1)[cells] = True

    def _compact(self) -> None:
        codes, signs = np.concatenate(self.trigrams, axis=1)
        held, at = np.unique(codes, return_inverse=True)
        self.trigrams, self.pending = [np.stack([held, _sums(at, signs)])], 0

    def trigram_deltas(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of tag histories, the sums of their updates, and the number of shards that made any."""
        self._compact()
        codes, amounts = self.trigrams[0]
        return _by_code(codes % (self.size + 1) ** 3, amounts)

    def lexical_deltas(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for (context, tag), given the context of every row."""
        cells = np.flatnonzero(self.touched)
        codes = contexts[cells // self.size] * self.size + cells % self.size
        return _by_code(codes, self.counts.reshape(-1)[cells])


def _sums(at: np.ndarray, amounts: np.ndarray) -> np.ndarray:
    return np.rint(np.bincount(at, weights=amounts)).astype(np.int64)


def _by_code(codes: np.ndarray, amounts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    held, at = np.unique(codes, return_inverse=True)
    return held, _sums(at, amounts), np.bincount(at, minlength=len(held))


def _order(key: object) -> object:
    return tuple(key.values()) if isinstance(key, dict) else key


def _teams(pairs: np.ndarray, cells: int, side: int) -> Iterator[tuple[int, int]]:
    """Runs of shards that learn together. ``pairs`` counts the distinct words of each; a word has ``cells`` cells."""
    low, used = 0, 0
    for high, need in enumerate((pairs * cells + side).tolist()):
        if high > low and (used + need > TEAM_CELLS or high - low == TEAM):
            yield low, high
            low, used = high, 0
        used += need
    yield low, len(pairs)


def _train_bundle(
    bundle: pa.Table, start: pa.Table | None, tags: list[str], trigrams: pa.Table, families: tuple[str, ...], epochs: int
) -> pa.Table:
    """The updates of all shards of a bundle, summed; ``made`` is the number of shards that made a feature."""
    keys = [_order(key) for key in bundle.column("sent_id").to_pylist()]
    shards = bundle.column("shard").to_numpy()
    words = bundle.column("words").combine_chunks()
    coded = words.flatten().dictionary_encode()
    tokens = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    gold = bundle.column("tags").combine_chunks().flatten()
    paths = pc.index_in(gold, pa.array(tags, pa.string())).to_numpy(zero_copy_only=False)
    lengths = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    begins = np.cumsum(lengths) - lengths

    columns = list(word_context_columns(coded.dictionary.to_pylist(), families))
    contexts = list(dict.fromkeys(c for column in columns for c in column if c))
    number = {c: i for i, c in enumerate(contexts)}
    numbered = [[number.get(c, -1) for c in column] for column in columns]
    by_word = np.array(numbered, dtype=np.int64).reshape(len(columns), len(coded.dictionary)).T
    model = WordScores(tags, start, families) if start is not None else None
    known = np.array([model.row.get(c, -1) for c in contexts], dtype=np.int64) if model else None
    moves = Transitions(tags, trigrams, fx.START, fx.STOP)

    # Sentences of a shard in corpus order; shards of many sentences first, so those still learning are a prefix.
    order: dict[int, list[int]] = {}
    for i in sorted(range(len(keys)), key=lambda i: (shards[i], keys[i])):
        order.setdefault(int(shards[i]), []).append(i)
    members = sorted(order.values(), key=len, reverse=True)
    distinct = np.array([len(np.unique(np.concatenate([tokens[begins[i] : begins[i] + lengths[i]] for i in m]))) for m in members])
    found: list[pa.Table] = []
    single = moves.whole is None
    for low, high in _teams(distinct, len(columns) * len(tags), TEAM_CELLS if single else moves.whole.size):
        team = members[low:high]
        steps = [[m[j] for m in team if len(m) > j] for j in range(len(team[0]))]
        flat = np.array([i for step in steps for i in step], dtype=np.int64)
        owner = np.array([n for step in steps for n in range(len(step))], dtype=np.int64)
        size = lengths[flat]
        edges = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(begins[flat] - edges[:-1], size) + np.arange(edges[-1])
        pairs, pair_of = np.unique(np.repeat(owner, size) * len(by_word) + tokens[at], return_inverse=True)
        asked = by_word[pairs % len(by_word)]
        codes, row = np.unique((pairs // len(by_word))[:, None] * len(contexts) + asked, return_inverse=True)
        row, held = row.reshape(asked.shape), asked >= 0
        # Codes of missing contexts are dropped, and their places point at the last row.
        used = np.zeros(len(codes), bool)
        used[row[held]] = True
        place = np.cumsum(used) - 1
        rows = np.where(held, place[row], used.sum())
        context = codes[used] % max(len(contexts), 1)
        scores = np.zeros((len(context) + 1, len(tags)))
        if model is not None:
            scores[:-1] = model.matrix[known[context]]
        trainer = TeamTrainer(tags, families, moves, scores, len(team))
        gold_path = paths[at]
        counted = np.concatenate([[0], np.cumsum([len(step) for step in steps])])
        for _ in range(epochs):
            for a, b in zip(counted[:-1], counted[1:]):
                part = slice(edges[a], edges[b])
                trainer.learn(size[a:b], rows[pair_of[part]], gold_path[part])
        found.append(_team_deltas(trainer, tags, contexts, context))
    return pa.concat_tables(found)


def _team_deltas(trainer: TeamTrainer, tags: list[str], contexts: list[str], context: np.ndarray) -> pa.Table:
    """feature, delta and made of a team; empty if no sentence was wrong."""
    side, size = len(tags) + 1, len(tags)
    ends = [[*tags, end] for end in (fx.START, fx.START, fx.STOP)]
    codes, amounts, made = trainer.trigram_deltas()
    names = [":".join([fx.TRIGRAM, ends[0][c // side**2], ends[1][c // side % side], ends[2][c % side]]) for c in codes.tolist()]
    cells, more, makers = trainer.lexical_deltas(context)
    names += [f"{contexts[c // size]}:{tags[c % size]}" for c in cells.tolist()]
    # Updates see STOP as a word as well: these features always cancel.
    wrong = int(trainer.wrong.sum())
    stops = [f"{column[0]}:{fx.STOP}" for column in word_context_columns([fx.STOP], trainer.families)] if wrong else []
    return pa.table(
        {
            "feature": pa.array(names + stops, pa.string()),
            "delta": pa.array(np.concatenate([amounts, more, np.zeros(len(stops))]), pa.float64()),
            "made": pa.array(np.concatenate([made, makers, np.full(len(stops), wrong)]).astype(np.int64), pa.int64()),
        }
    )


def mix_round(deltas: DataFrame, weights: DataFrame | None, n_shards: int) -> DataFrame:
    """Mean over the shards' weight vectors.

    ``deltas`` has sums of the updates and, as ``made``, the number of shards behind each. A shard returns
    its start weights with its updates applied. So a known feature is averaged over all shards, changed or not, and a new one over those that made it.
    """
    rows = deltas.select("feature", F.lit(0.0).alias("weight"), "delta", "made", F.lit(False).alias("known"))
    if weights is not None:
        kept = weights.select(
            "feature", "weight", F.lit(0.0).alias("delta"), F.lit(0).cast("bigint").alias("made"), F.lit(True).alias("known")
        )
        rows = rows.unionByName(kept)
    sums = rows.groupBy("feature").agg(
        F.sum("weight").alias("weight"), F.sum("delta").alias("delta"), F.sum("made").alias("made"),
        F.bool_or("known").alias("known"),
    )
    divisor = F.when(F.col("known"), F.lit(n_shards)).otherwise(F.col("made"))
    return sums.select("feature", (F.col("weight") + F.col("delta") / divisor).alias("weight"))


def train(
    sentences: DataFrame,
    n_shards: int | None = None,
    epochs: int = 5,
    rounds: int = 1,
    families: tuple[str, ...] = fx.FAMILIES,
    rule: str = "hash",
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Weights of a structured perceptron trained from zero.

    A shard is trained by one task, next to others of its bundle. Unless ``n_shards`` is given, there is one for every
    ``shard_tokens`` tokens; mixing makes the weights depend on it. ``rounds > 1``
    starts every shard from the mixed weights of the round before; each bundle of shards
    is sent only the weights its words can use, and lineage is cut after each round.
    """
    ship(sentences.sparkSession)
    families = tuple(families)
    corpus = sentences.select("sent_id", "words", "tags").filter(F.size("words") > 0)
    ascending, tokens = _profile(corpus)
    tags = ascending[::-1]
    count = n_shards or tokens // shard_tokens + 1
    sharded = assign_shards(corpus, count, rule)

    # Small shards travel together: a task's overhead is paid per bundle, of a size that does not depend on the corpus.
    cores = sentences.sparkSession.sparkContext.defaultParallelism
    waves = tokens * len(tags) // (BUNDLE_CELLS * cores) + 1
    bundles = min(count, waves * cores, MAX_PARTITIONS)
    names = F.array(*[F.lit(key).cast("bigint") for key in even_keys(sentences.sparkSession, bundles)])
    bundled = sharded.withColumn("bundle", F.get(names, F.pmod("shard", F.lit(bundles))))

    def first(bundle: pa.Table) -> pa.Table:
        return _train_bundle(bundle, None, tags, NO_TRIGRAMS, families, epochs)

    if rounds == 1:
        placed = bundled.repartition(bundles, "bundle")
        return mix_round(placed.groupBy("bundle").applyInArrow(first, DELTA_SCHEMA), None, count)

    # Bucketed by bundle: no round shuffles sentences.
    with stored_bucketed(bundled, "bundle", bundles) as stored:
        asked = pin(shard_contexts(stored.select(F.col("bundle").alias("shard"), "words"), families))
        weights = pin(mix_round(stored.groupBy("bundle").applyInArrow(first, DELTA_SCHEMA), None, count))
        for _ in range(rounds - 1):
            trigrams = sentences.sparkSession.sparkContext.broadcast(transition_rows(weights))

            def again(bundle: pa.Table, start: pa.Table) -> pa.Table:
                return _train_bundle(bundle, start, tags, trigrams.value, families, epochs)

            needed = shard_weights(asked, weights, tags)
            pairs = stored.groupBy("bundle").cogroup(needed.groupBy("owner"))
            weights = pin(mix_round(pairs.applyInArrow(again, DELTA_SCHEMA), weights, count))
    return weights

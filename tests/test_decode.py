import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from tagloom import runtime
from tagloom.functions.features import DECODER_FAMILIES, FAMILIES
from tagloom.operators import viterbi
from tagloom.operators.decode import decode
from tagloom.operators.features import feature_rows, histories, sentence_score

TAGS = ["B-X", "I-X", "O"]


def features(words, tags, families=FAMILIES):
    padded = ["*", "*", *tags, "STOP"]
    for i in range(len(words) + 1):
        yield "TRIGRAM:" + ":".join(padded[i : i + 3])
        if i < len(words):
            word, tag = words[i], tags[i]
            yield f"TAG:{word}:{tag}"
            if "SUFF" in families:
                for j in (1, 2):
                    if len(word) >= j:
                        yield f"SUFF:{word[-j:]}:{j}:{tag}"


def score(words, tags, weights, families=FAMILIES):
    return sum(weights.get(f, 0) for f in features(words, tags, families))


def exhaustive(words, weights, families=FAMILIES, tags=TAGS):
    """Best path over all tag sequences; ties as in a search that keeps the largest
    last two tags, and then the largest tag before each pair, from the end backwards."""
    paths = itertools.product(tags, repeat=len(words))
    return max(paths, key=lambda p: (score(words, p, weights, families), p[-2:], p[::-1][2:]))


def random_model(rng, vocabulary):
    model = {}
    for t2, t1, t in itertools.product([*TAGS, "*"], [*TAGS, "*"], [*TAGS, "STOP"]):
        if rng.random() < 0.7:
            model[f"TRIGRAM:{t2}:{t1}:{t}"] = rng.randint(-2, 2)
    model["TRIGRAM:B-X:I-X:O"] = 1
    for word, tag in itertools.product(vocabulary, TAGS):
        if rng.random() < 0.6:
            model[f"TAG:{word}:{tag}"] = rng.randint(-2, 2)
            model[f"SUFF:{word[-1:]}:1:{tag}"] = rng.randint(-1, 1)
            model[f"SUFF:{word[-2:]}:{min(2, len(word))}:{tag}"] = rng.randint(-1, 1)
    return model


@pytest.mark.parametrize("families", [FAMILIES, DECODER_FAMILIES])
@pytest.mark.parametrize("seed", range(3))
def test_equals_exhaustive_search(sentences, weights, seed, families, monkeypatch):
    monkeypatch.setattr(runtime, "MAX_LOOKUP_ROWS", seed * 10**6)
    rng = random.Random(seed)
    vocabulary = ["ab", "b", "::", "a:b", "über", "STOP"]
    model = random_model(rng, vocabulary)
    rows = [[rng.choice([*vocabulary, "new"]) for _ in range(rng.randint(1, 5))] for _ in range(60)]
    table = sentences(*[(words, ["O"] * len(words)) for words in rows])
    broadcast = decode(table, weights(model), families).orderBy("sent_id").collect()
    joined = decode(table, weights(model), families, max_broadcast=0).orderBy("sent_id").collect()
    assert broadcast == joined
    for words, found in zip(rows, broadcast):
        best = exhaustive(words, model, families)
        assert (found.words, tuple(found.tags), found.score) == (words, best, score(words, best, model, families))


def test_zero_weights_give_the_largest_tag(sentences, weights):
    model = {f"TRIGRAM:*:{t}:O": 0 for t in TAGS}
    found = decode(sentences((["a", "b", "c"], ["O"] * 3), (["d"], ["O"])), weights(model)).orderBy("sent_id").collect()
    assert [r.tags for r in found] == [["O"] * 3, ["O"]]


def test_score_is_the_inner_product_of_the_path(spark, sentences, weights):
    rng = random.Random(9)
    model = random_model(rng, ["ab", "cd", "e"])
    table = sentences(*[([rng.choice(["ab", "cd", "e"]) for _ in range(12)], ["O"] * 12) for _ in range(20)])
    found = decode(table, weights(model), FAMILIES).cache()
    again = {r.sent_id: r.score for r in sentence_score(feature_rows(histories(found)), weights(model)).collect()}
    gold = {r.sent_id: r.score for r in sentence_score(feature_rows(histories(table)), weights(model)).collect()}
    for row in found.collect():
        assert row.score == again[row.sent_id] >= gold[row.sent_id]


@pytest.mark.parametrize("max_broadcast", [0, 10])
def test_models_without_word_weights_or_trigrams(sentences, weights, max_broadcast):
    table = sentences((["a", "b"], ["O", "O"]))
    model = weights({"TRIGRAM:*:*:B-X": 3, "TRIGRAM:B-X:O:STOP": 1, "TRIGRAM:*:O:O": 2})
    found = decode(table, model, max_broadcast=max_broadcast).first()
    assert (found.tags, found.score) == (["B-X", "O"], 4)
    words_only = decode(table, model, families=("TAG",), max_broadcast=max_broadcast).first()
    assert (words_only.tags, words_only.score) == (["O", "O"], 0)


def test_model_without_tags(sentences, weights):
    with pytest.raises(ValueError, match="no tags"):
        decode(sentences((["a"], ["O"])), weights({"TAG:a:O": 1}))


def trigram_table(rows):
    return pa.table(dict(zip(("t2", "t1", "tag", "weight"), map(list, zip(*rows)))))


@pytest.mark.parametrize("cells", [1, 50, 200, 4_000_000])
def test_blockwise_arithmetic(monkeypatch, cells):
    """Blocks of any size, sparse or dense transitions, one sentence or many: the same paths."""
    rng = np.random.default_rng(cells)
    tags = [f"t{i}" for i in range(6)][::-1]
    rows = [(a, b, c, float(rng.integers(-2, 3))) for a in [*tags, "*"] for b in [*tags, "*"] for c in [*tags, "STOP"]]
    lengths = rng.integers(1, 15, 80)
    gain = rng.integers(-2, 3, (lengths.sum(), 6)).astype(float)
    expected = viterbi.best_paths(lengths, gain, viterbi.Transitions(tags, trigram_table(rows), "*", "STOP"))
    monkeypatch.setattr(viterbi, "CELLS", cells)
    moves = viterbi.Transitions(tags, trigram_table(rows), "*", "STOP")
    found = viterbi.best_paths(lengths, gain, moves)
    assert np.array_equal(found[0], expected[0]) and np.array_equal(found[1], expected[1])
    ends = np.cumsum(lengths)
    for low, high in zip(ends - lengths, ends):
        assert np.array_equal(viterbi.best_path(gain[low:high], moves), expected[0][low:high])


def test_updates_of_sparse_and_dense_transitions(monkeypatch):
    at = np.array([[0, 1, 1], [2, 2, 0], [0, 1, 1]])
    dense = viterbi.Transitions(["b", "a"], trigram_table([("*", "*", "b", 2.0)]), "*", "STOP")
    monkeypatch.setattr(viterbi, "CELLS", 1)
    sparse = viterbi.Transitions(["b", "a"], trigram_table([("*", "*", "b", 2.0)]), "*", "STOP")
    for moves in (dense, sparse):
        moves.add(at, 1.0)
    assert np.array_equal(dense.block(0, 3), sparse.block(0, 3)) and dense.block(1, 2)[0, 1, 0] == 2


@pytest.mark.parametrize("k", [2, 5])
def test_sentences_of_several_models_at_once(k):
    """Each sentence has a model of its own, and the path that it has alone."""
    rng = np.random.default_rng(k)
    lengths = np.array([3, 1, 7, 2, 1, 4])
    gain = rng.integers(-2, 3, (lengths.sum(), k)).astype(float)
    side = rng.integers(-2, 3, (len(lengths), k + 1, k + 1, k + 1)).astype(float)
    found, ends = viterbi.best_paths_apart(lengths, gain, side), np.cumsum(lengths)
    for model, low, high in zip(side, ends - lengths, ends):
        names = [str(i) for i in range(k)]
        alone = viterbi.Transitions(names, no_trigrams(), "*", "STOP")
        alone.whole = model
        assert np.array_equal(found[low:high], viterbi.best_path(gain[low:high], alone))


def no_trigrams():
    return pa.table({**{c: pa.array([], pa.string()) for c in viterbi.HISTORY}, "weight": pa.array([], pa.float64())})

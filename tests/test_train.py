import random
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from test_decode import exhaustive, features

from tagloom.functions.features import FAMILIES
from tagloom.operators import train as training
from tagloom.operators.decode import decode
from tagloom.operators.train import assign_shards, train
from tagloom.operators.weights import apply_update, mix, perceptron_delta, reset_weights

WORDS = ["ab", "cab", "b", "a:b", "STOP", "zz"]


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(1, 4))]
        rows.append((words, [rng.choice(["O", "O", "B-X", "I-X"]) for _ in words]))
    rows[0] = (["ab", "ab", "ab"], ["B-X", "I-X", "O"])
    return rows


def update(words, tags, weights, sign):
    # Updates see STOP as a word after the sentence.
    counts = Counter(features(words, tags))
    counts.update(["TAG:STOP:STOP", "SUFF:P:1:STOP", "SUFF:OP:2:STOP"])
    for feature, n in counts.items():
        weights[feature] = weights.get(feature, 0) + sign * n


def train_list(rows, epochs, start=None):
    weights = dict(start or {})
    for _ in range(epochs):
        for words, gold in rows:
            guess = exhaustive(words, weights)
            if list(guess) != gold:
                update(words, gold, weights, 1)
                update(words, guess, weights, -1)
    return weights


def mixed(vectors):
    total, n = Counter(), Counter()
    for vector in vectors:
        for feature, weight in vector.items():
            total[feature] += weight
            n[feature] += 1
    return {f: total[f] / n[f] for f in n}


def shards_of(table, rows, n, rule):
    found = assign_shards(table, n, rule).select("sent_id", "shard").collect()
    shards = [[] for _ in range(n)]
    for row in sorted(found):
        shards[row.shard].append(rows[row.sent_id - 1])
    return shards


def collected(df):
    return {r.feature: r.weight for r in df.collect()}


@pytest.mark.parametrize("seed", range(2))
def test_one_shard_is_sequential_training(sentences, seed):
    rows = corpus(seed, 25)
    assert collected(train(sentences(*rows), n_shards=1)) == train_list(rows, 5)


@pytest.mark.parametrize("rule", ["hash", "contiguous", "tokens"])
def test_parameter_mixing(sentences, rule):
    rows = corpus(3, 40)
    table = sentences(*rows)
    expected = mixed(train_list(shard, 5) for shard in shards_of(table, rows, 4, rule))
    assert collected(train(table, n_shards=4, rule=rule)) == pytest.approx(expected)


def test_iterative_mixing(sentences):
    # Powers of two keep the means exact, so both sides break the same ties.
    rows = corpus(4, 40)
    table = sentences(*rows)
    shards = shards_of(table, rows, 2, "hash")
    weights = {}
    for _ in range(4):
        found = [train_list(shard, 1, weights) for shard in shards]
        weights = mixed(found)
    assert collected(train(table, n_shards=2, epochs=1, rounds=4)) == weights


def test_one_round_of_iterative_mixing_is_parameter_mixing(sentences):
    table = sentences(*corpus(5, 30))
    assert collected(train(table, 4, epochs=1, rounds=1)) == collected(train(table, 4, epochs=1))


def test_empty_shards_do_not_matter(sentences):
    rows = corpus(6, 3)
    expected = mixed(train_list([row], 5) for row in rows)
    assert collected(train(sentences(*rows), n_shards=3, rule="contiguous")) == pytest.approx(expected)


def test_separable_corpus_is_learned(sentences):
    rows = [(["the", "cat", "Rome"], ["O", "O", "B-LOC"]), (["Rome", "fell"], ["B-LOC", "O"]), (["the", "fall"], ["O", "O"])]
    table = sentences(*rows)
    model = train(table, n_shards=2, epochs=1, rounds=6)
    found = decode(table, model, FAMILIES).orderBy("sent_id").collect()
    assert [r.tags for r in found] == [tags for _, tags in rows]


def test_no_mistakes_no_weights(sentences):
    assert train(sentences((["a", "b"], ["O", "O"])), n_shards=1).count() == 0


def test_shards_follow_from_the_corpus(sentences):
    table = sentences(*corpus(7, 30))
    whole = {r.feature: r.weight for r in train(table, n_shards=1).collect()}
    assert whole == {r.feature: r.weight for r in train(table, shard_tokens=10**6).collect()}
    assert train(table, shard_tokens=10).count() > 0


@pytest.mark.parametrize("total, n", [(10, 3), (3, 3), (7, 8), (50, 7)])
def test_contiguous_shards(sentences, total, n):
    table = sentences(*[(["a"], ["O"])] * total)
    found = {r.sent_id: r.shard for r in assign_shards(table, n, "contiguous").collect()}
    slices = [range(i * total // n, (i + 1) * total // n) for i in range(n)]
    assert found == {at + 1: i for i, cut in enumerate(slices) for at in cut}


def test_delta_keeps_zero_entries(sentences):
    found = collected(perceptron_delta(sentences((["ab"], ["B-X"], ["O"]), (["zz"], ["O"], ["O"]))))
    assert found["TAG:ab:B-X"] == 1 and found["TAG:ab:O"] == -1
    assert found["TAG:STOP:STOP"] == found["SUFF:OP:2:STOP"] == 0 and "TAG:zz:O" not in found


def test_update_and_reset(weights):
    found = apply_update(weights({"a": 1, "b": 2}), weights({"b": -2, "c": 4}))
    assert collected(found) == {"a": 1, "b": 0, "c": 4}
    assert collected(reset_weights(found)) == {"a": 0, "b": 0, "c": 0}


def test_mixing_denominators(spark):
    rows = spark.createDataFrame([("a", 3.0), ("a", 0.0), ("b", 6.0)], "feature string, weight double")
    assert collected(mix(rows)) == {"a": 1.5, "b": 6.0}
    assert collected(mix(rows, "uniform", 3)) == {"a": 1.0, "b": 2.0}
    with pytest.raises(ValueError):
        mix(rows, "uniform")


@pytest.mark.parametrize("n", [1, 3, 7, 40])
def test_shards_of_equal_work(sentences, n):
    """Every shard is within one sentence of the mean; shards are ordered slices."""
    rng = random.Random(n)
    table = sentences(*[(["w"] * k, ["O"] * k) for k in rng.choices([1, 2, 30], k=90)])
    rows = sorted((r.sent_id, r.shard, len(r.words)) for r in assign_shards(table, n, "tokens").collect())
    assert [s for _, s, _ in rows] == sorted(s for _, s, _ in rows) and len(rows) == 90
    mean = sum(k for *_, k in rows) / n
    for shard in range(n):
        assert abs(sum(k for _, s, k in rows if s == shard) - mean) <= 30


def labelled_shards(seed, shards, tags):
    """Sentences of 1 to 9 words by shard, as a task of the trainer gets them."""
    rng = random.Random(seed)
    words = [[rng.choice(WORDS) for _ in range(rng.randint(1, 9))] for _ in shards]
    return pa.table({
        "shard": pa.array(shards, pa.int64()), "sent_id": pa.array(range(len(shards)), pa.int64()),
        "words": pa.array(words), "tags": pa.array([[rng.choice(tags) for _ in w] for w in words]),
    })


@pytest.mark.parametrize("cells", [1, 2000, 10**7])
@pytest.mark.parametrize("k", [3, 160])
def test_shards_of_a_bundle_learn_as_if_alone(monkeypatch, cells, k):
    """Teams of any size, and tag sets without dense transitions, give the updates of single shards."""
    tags = sorted((f"T{i}" for i in range(k)), reverse=True)
    rows = labelled_shards(k, [0, 1, 1, 1, 5, 5, 9, 0, 7], tags)
    start = pa.table({"context": ["TAG:ab", "SUFF:b:1"], "by_tag": [[{"tag": "T1", "weight": 0.3}], [{"tag": "T0", "weight": -0.7}]]})
    known = pa.table({"t2": ["*", "T0"], "t1": ["*", "T1"], "tag": ["T0", "STOP"], "weight": [0.1, 0.2]})
    monkeypatch.setattr(training, "TEAM_CELLS", cells)
    expected = {}
    for shard in (0, 1, 5, 7, 9):
        alone = training._train_bundle(rows.filter(pc.equal(rows["shard"], shard)), start, tags, known, FAMILIES, 2)
        assert alone["made"].unique().to_pylist() == [1]
        for row in alone.to_pylist():
            delta, made = expected.get(row["feature"], (0, 0))
            expected[row["feature"]] = (delta + row["delta"], made + 1)
    found = {}
    for row in training._train_bundle(rows, start, tags, known, FAMILIES, 2).to_pylist():
        delta, made = found.get(row["feature"], (0, 0))
        found[row["feature"]] = (delta + row["delta"], made + row["made"])
    assert found == expected


def test_many_tiny_shards_do_not_mean_many_tasks(sentences, monkeypatch):
    """A shard per sentence: tasks follow the cores and tokens, not the number of shards."""
    asked = []
    monkeypatch.setattr(training, "even_keys", lambda spark, n: asked.append(n) or list(range(n)))
    rows = corpus(8, 60)
    found = collected(train(sentences(*rows), n_shards=60, epochs=1, rule="contiguous"))
    assert found == pytest.approx(mixed(train_list([row], 1) for row in rows)) and asked == [4]

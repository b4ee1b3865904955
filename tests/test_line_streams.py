"""Streams of raw lines, cut at any place, against the batch operators."""

import random
from collections import Counter

import pandas as pd
import pytest
from paths import TESTDATA
from pyspark.sql import functions as F

from tagloom.operators.decode import decode
from tagloom.operators.evaluate import COUNTS, chunk_counts
from tagloom.plans import corpora
from tagloom.runtime import pin
from tagloom.sources.columns import read_eval
from tagloom.streaming import decode_batch, decode_to, run_to_files, run_updates, stream_table
from tagloom.streaming import lines as ln

TAGS = ["O", "O", "B-A", "I-A", "I-B", "B-B", "E-A", "E-B", "[-A", "]-B", ".", ".-A", "I", "I-0"]


class Memory:
    """A key's state between calls."""

    def __init__(self):
        self.get, self.exists = None, False

    def update(self, value):
        self.get, self.exists = value, True


def feed(function, lines, cuts, shuffle=None):
    """The rows that a keyed function gives for numbered lines in micro-batches."""
    state, rows = Memory(), []
    numbered = list(enumerate(lines, 1))
    if shuffle:
        shuffle.shuffle(numbered)
    for low, high in zip([0, *cuts], [*cuts, len(numbered)], strict=True):
        frames = [pd.DataFrame(numbered[i : min(i + 3, high)], columns=["line_no", "line"]) for i in range(low, high, 3)]
        for found in function(("k",), iter(frames), state):
            rows += found.itertuples(index=False, name=None)
    return rows


LINES = ["", " a ", "b", " ", "\t", "c", "d", "e", "\r", "", "f", "", "g", None]
SENTENCES = [("k", 1, ["a", "b"]), ("k", 2, ["c", "d", "e"]), ("k", 3, ["f"]), ("k", 4, ["g"])]


def test_sentences_for_every_cut():
    for first in range(len(LINES) + 1):
        for second in range(first, len(LINES) + 1):
            assert feed(ln._sentences, LINES, [first, second]) == SENTENCES


def test_sentences_out_of_order_and_twice():
    for seed in range(30):
        rng = random.Random(seed)
        assert feed(ln._sentences, LINES, sorted(rng.choices(range(len(LINES)), k=4)), rng) == SENTENCES
    state = Memory()
    whole = pd.DataFrame(list(enumerate(LINES, 1)), columns=["line_no", "line"])
    given = [[*ln._sentences(("k",), iter([whole]), state)] for _ in range(2)]
    assert len(given[0][0]) == 4 and given[1] == []


def eval_lines(rng, n):
    lines = []
    for _ in range(n):
        lines += [f"w {rng.choice(TAGS)} {rng.choice(TAGS)}" if rng.random() < 0.5 else "w {0} {0}".format(rng.choice(TAGS)) for _ in range(rng.randrange(6))]
        lines += rng.choice([[""], ["  ", ""], ["-X- -X- -X-", ""]])
    return lines


def totals(rows):
    """Last counts per type of the rows of one key."""
    last = {}
    for _, lines, kind, *counts in rows:
        last[kind] = max(last.get(kind, (0, [])), (lines, counts))
    return {kind: tuple(counts) for kind, (_, counts) in last.items()}


def test_counts_for_every_cut(spark, tmp_path):
    rng = random.Random(8)
    lines = eval_lines(rng, 60)
    (tmp_path / "a").write_text("\n".join(lines) + "\n")
    batch = chunk_counts(read_eval(spark, str(tmp_path)))
    expected = {r["type"]: tuple(r[c] for c in COUNTS) for r in batch.collect()}
    count = ln._counts(" ", "-X-")
    for cut in range(len(lines) + 1):
        assert totals(feed(count, [*lines, None], [cut])) == expected
    for seed in range(20):
        mixed = random.Random(seed)
        cuts = sorted(mixed.choices(range(len(lines)), k=6))
        assert totals(feed(count, [*lines, None], cuts, mixed)) == expected


def test_running_counts_name_the_lines_they_cover():
    rows = feed(ln._counts(" ", "-X-"), ["a B-P B-P", "b I-P I-P", "", None], [1, 2])
    assert rows == [
        ("k", 1, None, 1, 1, 0, 0, 0), ("k", 1, "P", 0, 0, 1, 1, 0),
        ("k", 2, None, 2, 2, 0, 0, 0),
        ("k", 4, None, 2, 2, 0, 0, 0), ("k", 4, "P", 0, 0, 1, 1, 1),
    ]


def test_uneven_lines_fail():
    with pytest.raises(ValueError, match="unexpected number"):
        feed(ln._counts(" ", "-X-"), ["a O O", "b O"], [])
    with pytest.raises(ValueError, match="unexpected number"):
        feed(ln._counts(" ", "-X-"), ["a"], [])
    assert totals(feed(ln._counts("|", "-X-"), ["a|B-P|B-P|", ""], []))["P"] == (0, 0, 1, 1, 1)


@pytest.fixture(scope="module")
def streams(spark, tmp_path_factory):
    """Lines of streams of many lengths, one with a third of all lines, in files whose edges cut sentences."""
    rng = random.Random(4)
    path = str(tmp_path_factory.mktemp("lines"))
    keys = {f"k{i}": [*eval_lines(rng, rng.choice([1, 4, 9])), "open B-A B-A", None] for i in range(25)}
    keys["hot"] = [*eval_lines(rng, 60), "open B-A B-A", None]
    rows = [(k, n, line) for k, lines in keys.items() for n, line in enumerate(lines, 1)]
    rows += [rows[3]] * 2
    rng.shuffle(rows)
    for part in range(4):
        table = spark.createDataFrame(rows[part::4], "key string, line_no int, line string")
        table.coalesce(1).write.mode("append").parquet(path)
    return path, keys


def test_stream_of_lines(spark, streams):
    path, keys = streams
    found = run_to_files(ln.stream_sentences(stream_table(spark, path, files_per_batch=1)))
    sentences, expected = {tuple(r.sent_id): r.lines for r in found.collect()}, {}
    for key, lines in keys.items():
        blocks = "\n".join((line or "").strip() for line in lines).split("\n\n")
        kept = [b.strip("\n").split("\n") for b in blocks if b.strip("\n")]
        expected |= {(key, i): b for i, b in enumerate(kept, 1)}
    assert sentences == expected


def test_counts_of_a_stream(spark, streams, tmp_path):
    path, keys = streams
    found = ln.latest_counts(run_updates(ln.stream_line_counts(stream_table(spark, path, files_per_batch=1))))
    for key, lines in keys.items():
        (tmp_path / key).write_text("\n".join(line or "" for line in lines) + "\n")
    assert Counter(map(tuple, found.select("type", *COUNTS).collect())) == Counter(
        map(tuple, chunk_counts(read_eval(spark, str(tmp_path))).select("type", *COUNTS).collect())
    )


# A model too large to broadcast


def test_batches_that_run_again(spark, tmp_path, weights, sentences):
    """A batch replaces its own rows; a query that stops after writing goes on where it stood."""
    model = pin(weights({"TRIGRAM:*:*:O": 1, "TRIGRAM:*:O:B-X": 1, "TAG:a:O": 1, "TAG:b:B-X": 5}))
    table = sentences((["a", "b"], ["O", "O"]), (["b"], ["O"]))
    work = decode_batch(model, str(tmp_path / "out"), ("TRIGRAM", "TAG"), 0)
    for number in (0, 1, 1):
        work(table, number)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("batch").count().orderBy("batch").collect() == [(0, 2), (1, 2)]


def test_restart_with_a_large_model(spark, tmp_path, monkeypatch):
    batch = corpora.conversations(spark, TESTDATA).limit(60)
    batch = pin(batch)
    model = pin(corpora.model(corpora.labelled(spark, TESTDATA)))
    for _ in range(3):
        batch.sample(1.0).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: stream_table(spark, str(tmp_path / "in"), files_per_batch=1)
    out, progress, calls = str(tmp_path / "out"), str(tmp_path / "progress"), []
    true = decode_batch

    def failing(*args):
        work = true(*args)

        def run(frame, number):
            work(frame, number)
            calls.append(number)
            if len(calls) == 2:
                raise RuntimeError("lost")

        return run

    monkeypatch.setattr("tagloom.streaming.decode_batch", failing)
    with pytest.raises(Exception, match="lost"):
        decode_to(source(), model, out, progress, max_broadcast=0).awaitTermination()
    decode_to(source(), model, out, progress, max_broadcast=0).awaitTermination()
    assert calls == [0, 1, 1, 2]
    found = spark.read.parquet(out).select("sent_id", "tags")
    expected = decode(batch, model).select("sent_id", "tags")
    assert Counter(map(str, found.collect())) == Counter(map(str, expected.withColumn("k", F.explode(F.array(*map(F.lit, range(3))))).drop("k").collect()))


def test_lines_of_one_stream_are_spread_over_the_files(spark):
    """No task writes a whole micro-batch, even if all lines are of one turn."""
    rows = [((1, 2, n), ["Rome"] * 6, ["B-LOC"] * 6, ["O"] * 6) for n in range(1, 301)]
    schema = "sent_id struct<conv_id: long, turn: int, line_no: int>, words array<string>, tags array<string>, guesses array<string>"
    lines = corpora.line_stream(spark.createDataFrame(rows, schema), 16).withColumn("at", F.spark_partition_id()).collect()
    sizes = Counter(r["at"] for r in lines)
    assert sorted(r.line_no for r in lines) == list(range(1, 300 * 7 + 2))
    assert len(sizes) == 16 and max(sizes.values()) < len(lines) / 6

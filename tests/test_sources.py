import random
import re
from contextlib import contextmanager

import pytest
from pyspark.errors import PySparkException

from tagloom.functions.features import FAMILIES
from tagloom.operators.evaluate import chunk_counts
from tagloom.operators.features import feature_rows, histories, parse_feature
from tagloom.operators.sentences import pack, unpack
from tagloom.sources.columns import parse_eval_lines, read_conll, read_eval, read_unlabeled
from tagloom.sources.records import paragraphs
from tagloom.sources.sinks import eval_lines, tagged_lines, write_lines
from tagloom.sources.tables import literal_pairs, tokenize
from tagloom.sources.weights import read_weights, weights_to_text, write_weights
from tagloom.operators.weights import mean_by_key


def put(path, content):
    path.write_bytes(content.encode())
    return str(path)


@contextmanager
def splits_of(spark, size):
    """Cut files into splits of ``size`` bytes; a file opened costs as much, so a task gets few splits."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for name in names:
        spark.conf.set(name, str(size))
    try:
        yield
    finally:
        for name in names:
            spark.conf.unset(name)


def listed(df, *columns):
    return [tuple(row[c] for c in columns) for row in df.orderBy("sent_id").collect()]


def test_labelled_sentence(spark, tmp_path):
    path = put(tmp_path / "a", "EU NNP I-NP I-ORG\nrejects VBZ I-VP O\n\n")
    assert listed(read_conll(spark, path), "sent_id", "words", "tags") == [(1, ["EU", "rejects"], ["I-ORG", "O"])]


@pytest.mark.parametrize(
    "content",
    [
        "a x y O\nb x y O\n\nc x y B-LOC\n\n",
        "a x y O\r\nb x y O\r\n\r\nc x y B-LOC\r\n\r\n",
        "a x y O\nb x y O\n\n\n\nc x y B-LOC\n",
        "  a x y O  \nb\tx y\tO\n \t \nc x y B-LOC",
        "\n\na x y O\nb x y O\n \n\n \nc x y B-LOC\n\n\n",
    ],
)
@pytest.mark.parametrize("split", [128 << 20, 16, 3])
def test_line_ends_and_blank_lines(spark, tmp_path, content, split):
    with splits_of(spark, split):
        found = read_conll(spark, put(tmp_path / "a", content))
        assert listed(found, "sent_id", "words", "tags") == [(1, ["a", "b"], ["O", "O"]), (2, ["c"], ["B-LOC"])]


@pytest.mark.parametrize(
    "end, kept", [("", 1), ("\n", 1), ("\n\n", 2), ("\n \n", 2), ("\r\n\r\n", 2), ("\n\n\n", 2), ("\n ", 2)]
)
def test_unterminated_sentence(spark, tmp_path, end, kept):
    path = put(tmp_path / "a", f"a x y O\n\nb x y O{end}")
    assert read_conll(spark, path).count() == 2
    assert read_conll(spark, path, keep_unterminated=False).count() == kept
    assert read_unlabeled(spark, path, keep_unterminated=False).count() == kept


def test_short_line_fails(spark, tmp_path):
    with pytest.raises(PySparkException, match="no column 3"):
        read_conll(spark, put(tmp_path / "a", "a x O\n\n")).collect()


def test_unlabelled_words_keep_inner_blanks(spark, tmp_path):
    found = read_unlabeled(spark, put(tmp_path / "a", " New York \nis\n\nbig\n"))
    assert listed(found, "sent_id", "words") == [(1, ["New York", "is"]), (2, ["big"])]


def test_ids_follow_files_and_splits(spark, tmp_path):
    """Dense ids in file order, also when files are cut into many splits."""
    expected = []
    for name in ("a", "b", "c"):
        lines = [f"{name}{i} x y O\nend x y O\n" for i in range(200)]
        put(tmp_path / name, "\n".join(lines) + "\n")
        expected += [f"{name}{i}" for i in range(200)]
    with splits_of(spark, 257):
        found = listed(read_conll(spark, str(tmp_path)), "sent_id", "words")
    assert [i for i, _ in found] == list(range(1, 601))
    assert [words for _, words in found] == [[w, "end"] for w in expected]


def paragraphs_of(content, keep, boundary=None):
    """Line by line, as a file would be read; the last lines count as a paragraph only if one follows or ``keep``."""
    found, now = [], []
    for line in content.split("\n") if not content.endswith("\n") else content[:-1].split("\n"):
        line = line.strip(" \t\n\x0b\f\r")
        if line and boundary and line.startswith(boundary):
            found += [now, [line]] if now else [[line]]
            now = []
        elif line:
            now.append(line)
        elif now:
            found, now = [*found, now], []
    return found + [now] if now and keep else found


BREAKS = {
    "plain": ["\n\n"],
    "white space": ["\n \n", "\n\t \x0b\n"],
    "crlf": ["\r\n\r\n"],
    "mixed": ["\n\n", "\n \n", "\r\n\r\n", "\n\r\n", "\n\n\n", "\n\f\n \n\n"],
}


@pytest.mark.parametrize("kind", sorted(BREAKS))
@pytest.mark.parametrize("size", [13, 120, 1 << 20])
def test_paragraphs_at_any_split(spark, tmp_path, kind, size):
    """Blank lines of any kind, paragraphs over many splits, files with and without a last blank line."""
    rng = random.Random(f"{kind}{size}")
    expected, kept = [], []
    for name in "abc":
        line = "\r\n" if kind == "crlf" else "\n"
        blocks = [line.join(f"{name}{i}.{k}" + "x" * rng.randrange(9) for k in range(rng.choice([1, 2, 12]))) for i in range(5)]
        content = rng.choice(["", "\n", " \n\n"]) + "".join(b + rng.choice(BREAKS[kind]) for b in blocks) + rng.choice(["", "", "end", "end\n"])
        put(tmp_path / name, content)
        expected += paragraphs_of(content, True)
        kept += paragraphs_of(content, False)
    with splits_of(spark, size):
        assert listed(paragraphs(spark, str(tmp_path)), "sent_id", "lines") == list(enumerate(expected, 1))
        found = listed(paragraphs(spark, str(tmp_path), keep_unterminated=False), "lines")
        assert found == [(lines,) for lines in kept]


def test_records_are_no_longer_than_a_sentence(spark, tmp_path):
    """A file without a plain blank line is many rows, spread over its splits."""
    put(tmp_path / "a", "".join(f"w{i} x y O\n \n" for i in range(5000)))
    with splits_of(spark, 4096):
        found = read_conll(spark, str(tmp_path))
        assert found.count() == 5000 and found.rdd.getNumPartitions() > 8
        assert found.agg({"sent_id": "max"}).first()[0] == 5000


def test_batches_smaller_than_a_paragraph(spark, tmp_path):
    content = "\n\n".join("\n".join(f"p{i}l{k}" for k in range(i)) for i in range(1, 12)) + "\n"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = listed(paragraphs(spark, put(tmp_path / "a", content)), "lines")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == [(lines,) for lines in paragraphs_of(content, True)]


@pytest.mark.parametrize("size", [9, 1 << 20])
def test_boundary_lines_cut(spark, tmp_path, size):
    content = "-X- O O\na B-X B-X\nb I-X O\n-X- O O\n-X- O O\nc O O\n\nd O O\n-X- O O"
    path = put(tmp_path / "a", content)
    with splits_of(spark, size):
        assert [x for (x,) in listed(paragraphs(spark, path, boundary="-X-"), "lines")] == paragraphs_of(content, True, "-X-")
        cut, whole = (read_eval(spark, path, cut_at_boundary=c) for c in (True, False))
        assert (cut.count(), whole.count()) == (7, 2)
        assert {tuple(r) for r in chunk_counts(cut).collect()} == {tuple(r) for r in chunk_counts(whole).collect()}


def test_files_changed_between_passes(spark, tmp_path):
    put(tmp_path / "a", "a x y O\n\nb x y O\n")
    found = read_conll(spark, str(tmp_path))
    with splits_of(spark, 4):
        other = found.select("sent_id").distinct()
        (tmp_path / "a").write_text("a x y O\n\n" * 50)
        try:
            assert other.count() <= 2
        except PySparkException as error:
            assert "have changed" in str(error)


def test_weights_round_trip(spark, tmp_path, weights):
    model = weights({"TAG:::O": 0.25, "TAG:a:O": -4.0, "SUFF::b:2:I-PER": 1 / 3})
    write_weights(model, str(tmp_path / "parquet"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "parquet")).collect()} == {tuple(r) for r in model.collect()}
    write_weights(model, str(tmp_path / "text"), fmt="text")
    read = {r.feature: r.weight for r in read_weights(spark, str(tmp_path / "text")).collect()}
    assert read == {"TAG:::O": 0.2, "TAG:a:O": -4.0, "SUFF::b:2:I-PER": 0.3}
    assert {r.line for r in weights_to_text(model, 2).collect()} >= {"TAG:::O 0.25", "SUFF::b:2:I-PER 0.33"}


def test_last_weight_of_a_feature_wins(spark, tmp_path):
    path = put(tmp_path / "w", "TAG:a:O 1.0\nTAG:b:O 2.0\n\nTAG:a:O -3.5\n")
    assert {tuple(r) for r in read_weights(spark, path).collect()} == {("TAG:a:O", -3.5), ("TAG:b:O", 2.0)}


def test_tagged_and_eval_files(spark, tmp_path, sentences):
    table = sentences((["EU", "is"], ["I-ORG", "O"], ["O", "O"]), (["a"], ["O"], ["B-PER"]))
    assert listed(tagged_lines(table), "lines") == [("EU I-ORG\nis O\n",), ("a O\n",)]
    write_lines(eval_lines(table), str(tmp_path / "eval"))
    found = read_eval(spark, str(tmp_path / "eval"))
    assert listed(found, "words", "tags", "guesses") == [
        (["EU", "is"], ["I-ORG", "O"], ["O", "O"]),
        (["a"], ["O"], ["B-PER"]),
    ]


def test_eval_lines_are_split_once(spark, tmp_path):
    """The plan splits a line in one place, and the checked sentences are read from storage, not parsed again."""
    lines = spark.createDataFrame([(1, ["a|O|B-P|", "", "||", "b", "-X-|O|O", None])], "sent_id int, lines array<string>")
    parsed = parse_eval_lines(lines, r"\|")
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert parsed.first()[1:] == (
        ["a", None, None, "b", "-X-", None],
        ["O", None, None, None, "O", None],
        ["B-P", None, None, "b", "O", None],
        0,
        3,
    )
    found = read_eval(spark, put(tmp_path / "a", "a O O\nb B-X O\n\n"))
    assert "split(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert listed(found, "words", "tags", "guesses") == [(["a", "b"], ["O", "B-X"], ["O", "O"])]


def test_eval_file_with_boundary_lines_and_delimiter(spark, tmp_path):
    path = put(tmp_path / "a", "-X-|O|O\na|B-X|B-X\n-X-|-X-|-X-\nb|I-X|O\n\nc|O|O\n")
    found = read_eval(spark, path, delimiter=r"\|")
    assert listed(found, "words", "tags", "guesses") == [
        (["-X-", "a", "-X-", "b"], ["O", "B-X", "O", "I-X"], ["O", "B-X", "O", "O"]),
        (["c"], ["O"], ["O"]),
    ]


@pytest.mark.parametrize("content, message", [("a O O\nb O\n\n", "unexpected number"), ("a\n\n", "gold and a guessed")])
def test_eval_file_with_bad_width(spark, tmp_path, content, message):
    with pytest.raises(ValueError, match=message):
        read_eval(spark, put(tmp_path / "a", content))


def test_features_of_colon_and_short_words(sentences, weights):
    steps = histories(sentences(([":", "a:b", "x"], ["O", "B-X", "O"])))
    found = {r.feature for r in feature_rows(steps, FAMILIES).collect()}
    assert {"TAG:::O", "TAG:a:b:B-X", "SUFF:::1:O", "SUFF::b:2:B-X", "SUFF:x:1:O", "TRIGRAM:B-X:O:STOP"} <= found
    assert not any(f.startswith("SUFF") and f.endswith(":2:O") for f in found)
    parsed = {r.feature: tuple(r)[1:] for r in parse_feature(weights(dict.fromkeys(found, 0))).collect()}
    assert parsed["TAG:::O"] == ("TAG", ":", None, "O")
    assert parsed["SUFF::b:2:B-X"] == ("SUFF", ":b", 2, "B-X")
    assert parsed["TRIGRAM:B-X:O:STOP"] == ("TRIGRAM", "B-X:O", None, "STOP")


def test_pack_undoes_unpack(sentences):
    table = sentences((["a", "b", "c"], ["O", "B-X", "O"]), (["d"], ["O"]))
    assert listed(pack(unpack(table).orderBy("word", ascending=False)), "words", "tags") == listed(table, "words", "tags")


def test_tokenize_skips_blank_lines_and_keeps_line_numbers(spark):
    table = spark.createDataFrame([(7, " a  b\n\n \t\nc\r\n"), (8, None)], "id bigint, text string")
    found = tokenize(table, ["id"], "text").select("sent_id.*", "words").collect()
    assert sorted(map(tuple, found)) == [(7, 1, ["a", "b"]), (7, 4, ["c"])]


def test_mean_by_key(spark):
    pairs = [("a", 1), ("b", 2), ("a", 3), ("b", 1), ("c", 2), ("d", 4), ("c", 8)]
    found = {tuple(r) for r in mean_by_key(literal_pairs(spark, pairs), "k", "v").collect()}
    assert found == {("a", 2.0), ("b", 1.5), ("c", 5.0), ("d", 4.0)}


def test_weights_round_by_their_exact_value(spark):
    values = [k / 20 for k in range(-19, 20)] + [0.25, 0.75, 2.5, 0.05]
    table = spark.createDataFrame([(f"f{i}", v) for i, v in enumerate(values)], "feature string, weight double")
    assert sorted(r.line for r in weights_to_text(table).collect()) == sorted(f"f{i} {v:.1f}" for i, v in enumerate(values))


def test_weight_line_without_number(spark, tmp_path):
    (tmp_path / "w.txt").write_text("TAG:O:a 1.0\nTAG:O:b\n")
    with pytest.raises(Exception, match="without a number"):
        read_weights(spark, str(tmp_path)).collect()


def test_empty_items_at_the_end_do_not_count(spark):
    lines = spark.createDataFrame([(1, ["a|O|B-P|", "b|O|O"])], "sent_id int, lines array<string>")
    assert parse_eval_lines(lines, r"\|").select("tags", "guesses").first() == (["O", "O"], ["B-P", "O"])

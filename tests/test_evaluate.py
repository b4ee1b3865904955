import random
from collections import Counter

import pytest

from tagloom.operators import evaluate as ev

OPENING = {"BB", "IB", "OB", "OI", "EE", "EI", "OE"}
CLOSING = {"BB", "BO", "IB", "IO", "EE", "EI", "EO"}


def parts(tag):
    head, _, kind = tag.partition("-")
    return head, "" if kind == "0" else kind


def opens(before, now):
    return before[0] + now[0] in OPENING or (now[0] not in "O." and before[1] != now[1]) or now[0] in "[]"


def closes(before, now):
    return before[0] + now[0] in CLOSING or (before[0] not in "O." and before[1] != now[1]) or before[0] in "[]"


def sequential(sentences):
    """Chunk counts by a walk over the tokens with one state flag."""
    counts = Counter()
    for gold, guess in sentences:
        agreeing, pg, ph = False, ("O", ""), ("O", "")
        for g, h in [*zip(map(parts, gold), map(parts, guess)), (("O", ""), ("O", ""))]:
            ends = closes(pg, g), closes(ph, h)
            if agreeing and all(ends) and pg[1] == ph[1]:
                counts["correct_chunks", pg[1]] += 1
                agreeing = False
            elif ends[0] != ends[1] or g[1] != h[1]:
                agreeing = False
            starts = opens(pg, g), opens(ph, h)
            if all(starts) and g[1] == h[1]:
                agreeing = True
            counts["found_gold", g[1]] += starts[0]
            counts["found_guess", h[1]] += starts[1]
            last, pg, ph = pg[1], g, h
        if agreeing:
            counts["correct_chunks", last] += 1
    return +counts


def table(spark, rows):
    data = [(i, [f"w{j}" for j in range(len(g))], list(g), list(h)) for i, (g, h) in enumerate(rows)]
    return spark.createDataFrame(data, "sent_id bigint, words array<string>, tags array<string>, guesses array<string>")


def counted(sentences):
    found = Counter()
    for row in ev.chunk_counts(sentences).collect():
        if row.type is not None:
            found.update({(c, row.type): row[c] for c in ev.COUNTS[2:]})
    return +found


@pytest.mark.parametrize("prefixes", ["OI", "OIB", "OIBE", "OIBES", "OIB[]", "OIBE."])
def test_random_tag_schemes(spark, prefixes):
    rng = random.Random(prefixes)

    def tag():
        head = rng.choice(prefixes)
        return head if head == "O" and rng.random() < 0.9 else head + rng.choice(["-X", "-Y", "-X-Y", "", "-0"])

    rows = []
    for _ in range(1500):
        gold = [tag() for _ in range(rng.randint(1, 9))]
        rows.append((gold, [g if rng.random() < 0.7 else tag() for g in gold]))
    assert counted(table(spark, rows)) == sequential(rows)


def spans_by_walk(tags):
    found, start = [], None
    steps = [("O", ""), *map(parts, tags), ("O", "")]
    for pos in range(1, len(steps)):
        if start and closes(steps[pos - 1], steps[pos]):
            found.append((start[0], pos - 1, start[1]))
            start = None
        if pos < len(steps) - 1 and opens(steps[pos - 1], steps[pos]):
            start = (pos, steps[pos][1])
    return found


def test_chunk_spans(spark):
    rng = random.Random(5)
    tags = ["O", "B-X", "I-X", "B-Y", "I-Y"]
    rows = [([rng.choice(tags) for _ in range(8)], [rng.choice(tags) for _ in range(8)]) for _ in range(300)]
    for side, at in (("gold", 0), ("guess", 1)):
        found = {tuple(r) for r in ev.chunk_spans(table(spark, rows), side).collect()}
        assert found == {(i, *span) for i, row in enumerate(rows) for span in spans_by_walk(row[at])}


# Published scores of the three CoNLL-2003 splits: correct, gold, found, P, R, F1.
PUBLISHED = [
    (1321, 1837, 1647, 80.21, 71.91, 75.83), (573, 922, 813, 70.48, 62.15, 66.05),
    (573, 1341, 885, 64.75, 42.73, 51.48), (1401, 1842, 2040, 68.68, 76.06, 72.18),
    (3868, 5942, 5385, 71.83, 65.10, 68.30), (1063, 1668, 1502, 70.77, 63.73, 67.07),
    (359, 702, 635, 56.54, 51.14, 53.70), (532, 1661, 910, 58.46, 32.03, 41.38),
    (1085, 1617, 1986, 54.63, 67.10, 60.23), (3039, 5648, 5033, 60.38, 53.81, 56.90),
    (6070, 7140, 6966, 87.14, 85.01, 86.06), (2530, 3438, 3420, 73.98, 73.59, 73.78),
    (3872, 6321, 5149, 75.20, 61.26, 67.52), (6042, 6600, 7856, 76.91, 91.55, 83.59),
    (18514, 23499, 23391, 79.15, 78.79, 78.97), (0, 0, 0, 0.0, 0.0, 0.0), (0, 4, 0, 0.0, 0.0, 0.0),
]


def test_published_scores(spark):
    counts = spark.createDataFrame(
        [p[:3] for p in PUBLISHED], "correct_chunks bigint, found_gold bigint, found_guess bigint"
    )
    found = {(r[0], r[1], r[2], round(r.precision, 2), round(r.recall, 2), round(r.f1, 2)) for r in ev.prf(counts).collect()}
    assert found == set(PUBLISHED)


def test_boundary_tokens_are_not_counted(sentences):
    rows = sentences((["a", "-X-", "b"], ["B-X", "O", "I-X"], ["B-X", "O", "I-X"]))
    total = ev.evaluate(rows).first()
    assert (total.tokens, total.correct_tags, total.found_gold, total.correct_chunks) == (2, 2, 2, 2)


def test_no_tokens(sentences):
    rows = sentences((["a"], ["O"], ["O"])).limit(0)
    assert ev.evaluate(rows).first().tokens == 0
    lines = [r.line for r in ev.report(rows).collect()]
    assert lines == ["processed 0 tokens with 0 phrases; found: 0 phrases; correct: 0."]


def test_raw_mode(sentences):
    rows = ev.raw_tags(sentences((["a", "b"], ["X", "N"], ["X", "X"])), outside="N")
    assert tuple(rows.select("tags", "guesses").first()) == (["B-X", "O"], ["B-X", "B-X"])


def test_uneven_predictions_fail(sentences):
    gold = sentences((["a", "b"], ["O", "O"]))
    with pytest.raises(Exception, match="differ in length"):
        ev.join_gold_pred(gold, sentences((["a"], ["O"]))).collect()


def test_text_report(sentences):
    rows = sentences((["a", "b", "c"], ["B-LOC", "O", "B-PER"], ["B-LOC", "O", "O"]))
    assert [r.line for r in ev.report(rows).collect()] == [
        "processed 3 tokens with 2 phrases; found: 1 phrases; correct: 1.",
        "accuracy:  66.67%; precision: 100.00%; recall:  50.00%; FB1:  66.67",
        "              LOC: precision: 100.00%; recall: 100.00%; FB1: 100.00  1",
        "              PER: precision:   0.00%; recall:   0.00%; FB1:   0.00  0",
    ]


def test_latex_report(sentences):
    rows = sentences((["a"], ["B-LOC"], ["B-LOC"]))
    assert [r.line for r in ev.report(rows, "latex").collect()] == [
        r"        & Precision &  Recall  & F$_{\beta=1} \\\hline",
        r"LOC     &  100.00\% & 100.00\% & 100.00 \\\hline",
        r"Overall &  100.00\% & 100.00\% & 100.00 \\\hline",
    ]


def test_sentences_of_one_side_are_an_error(spark):
    gold = spark.createDataFrame([(1, ["a"], ["B-X"]), (2, ["b"], ["O"])], "sent_id int, words array<string>, tags array<string>")
    for left, right in ((gold, gold.filter("sent_id = 1")), (gold.filter("sent_id = 1"), gold)):
        with pytest.raises(Exception, match="no gold tags or no prediction"):
            ev.evaluate(ev.join_gold_pred(left, right)).collect()


def test_boundary_rows_hold_no_chunks(spark):
    rows = [(1, ["-X-", "a"], ["B-P", "I-P"], ["B-P", "I-P"])]
    table = spark.createDataFrame(rows, "sent_id int, words array<string>, tags array<string>, guesses array<string>")
    found = ev.chunk_counts(table).filter("type = 'P'").first()
    assert (found.found_gold, found.found_guess, found.correct_chunks) == (1, 1, 1)
    assert ev.chunk_spans(table).select("start", "end").collect() == [(2, 2)]

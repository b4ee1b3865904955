"""Chunk scoring: boundaries, counts, precision, recall, F1 and reports.

Input are sentences with gold ``tags`` and ``guesses``. All rules look at a token
and the one before it, so the pairs are formed inside the sentence row; only
counts per chunk type are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions import tags as tg

BOUNDARY = "-X-"
COUNTS = ("tokens", "correct_tags", "found_gold", "found_guess", "correct_chunks")


def join_gold_pred(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Align gold sentences and predictions: one shuffle by sentence, not by token.

    A sentence that only one side has is an error, as it would be missing from every rate.
    """
    guesses = pred.select("sent_id", F.col("tags").alias("guesses"))
    joined = gold.select("sent_id", "words", "tags").join(guesses, "sent_id", "full_outer")
    uneven = F.raise_error(F.lit("gold and guess differ in length")).cast("array<string>")
    same = F.size("tags") == F.size("guesses")
    alone = F.raise_error(F.lit("a sentence has no gold tags or no prediction")).cast("array<string>")
    paired = F.col("tags").isNotNull() & F.col("guesses").isNotNull()
    return joined.withColumn("guesses", F.when(~paired, alone).when(same, F.col("guesses")).otherwise(uneven))


def raw_tags(sentences: DataFrame, outside: str = tg.OUTSIDE) -> DataFrame:
    """Read tags without prefixes as one-token chunks; ``outside`` is the non-chunk tag."""
    return sentences.withColumns(
        {a: F.transform(a, lambda t: tg.raw(t, outside)) for a in ("tags", "guesses")}
    )


def split_tag(tokens: DataFrame) -> DataFrame:
    """Prefix and type of the gold tag and of the guess of each token."""
    return tokens.withColumns(
        {
            "prefix": tg.prefix(F.col("tag")),
            "type": tg.chunk_type(F.col("tag")),
            "guess_prefix": tg.prefix(F.col("guess")),
            "guess_type": tg.chunk_type(F.col("guess")),
        }
    )


def _pairs(boundary: str) -> Column:
    """The steps of a sentence: every token with the one before it, and a closing step.

    A boundary token is outside any chunk on both sides, whatever its tags.

    ``g`` and ``h`` are the gold tag and the guess, ``pg`` and ``ph`` those before.
    """
    outside = F.array(F.lit(tg.OUTSIDE))

    def inner(side: str) -> Column:
        masked = F.zip_with("words", side, lambda w, t: F.when(w == boundary, F.lit(tg.OUTSIDE)).otherwise(t))
        # Boundary tokens are rare, and lambdas are dear.
        return F.when(F.array_contains("words", boundary), masked).otherwise(F.col(side))

    tags, guesses = inner("tags"), inner("guesses")
    return F.arrays_zip(
        F.sequence(F.lit(1), F.size("words") + 1).alias("pos"),
        F.concat("words", F.array(F.lit(None).cast("string"))).alias("word"),
        F.concat(outside, tags).alias("pg"),
        F.concat(tags, outside).alias("g"),
        F.concat(outside, guesses).alias("ph"),
        F.concat(guesses, outside).alias("h"),
    )


def _busy(pair: Column) -> Column:
    """Whether a step can hold an event: some tag of the pair is in a chunk."""
    return ~((pair["g"] == "O") & (pair["h"] == "O") & (pair["pg"] == "O") & (pair["ph"] == "O"))


def _parsed(pair: Column, boundary: str) -> dict[str, Column]:
    columns = {"pos": pair["pos"], "token": pair["word"].isNotNull() & (pair["word"] != boundary)}
    for side in ("pg", "g", "ph", "h"):
        columns[side] = tg.prefix(pair[side])
        columns[f"{side}_type"] = tg.chunk_type(pair[side])
    return columns


def _events(p: Column) -> dict[str, Column]:
    columns = {}
    for side, now in (("gold", "g"), ("guess", "h")):
        before = f"p{now}"
        around = (p[before], p[now], p[f"{before}_type"], p[f"{now}_type"])
        columns[f"open_{side}"] = tg.opens(*around)
        columns[f"end_{side}"] = tg.closes(*around)
    return columns


def _states(p: Column, e: Column) -> dict[str, Column]:
    """Effect of a step on the scan for correct chunks: ``start_ok`` opens a chunk that
    agrees so far, ``close`` ends one on both sides, ``reset`` ends the agreement."""
    close = e["end_gold"] & e["end_guess"] & (p["pg_type"] == p["ph_type"])
    differ = p["g_type"] != p["h_type"]
    return {
        "close": close,
        "reset": close | (e["end_gold"] != e["end_guess"]) | differ,
        "start_ok": e["open_gold"] & e["open_guess"] & ~differ,
    }


def _struct(columns: dict[str, Column]) -> Column:
    return F.struct(*[column.alias(name) for name, column in columns.items()])


def token_events(sentences: DataFrame, boundary: str = BOUNDARY) -> DataFrame:
    """Chunk events as rows, one per step."""
    rows = sentences.select("sent_id", F.explode(_pairs(boundary)).alias("pair"))
    parsed = rows.select("sent_id", _struct(_parsed(F.col("pair"), boundary)).alias("p"))
    events = parsed.select("sent_id", "p", _struct(_events(F.col("p"))).alias("e"))
    states = _struct(_states(F.col("p"), F.col("e"))).alias("s")
    return events.select("sent_id", "p", "e", states).select("sent_id", "p.*", "e.*", "s.*")


def chunk_starts(sentences: DataFrame) -> DataFrame:
    """Whether a chunk starts at a token, on both sides."""
    return token_events(sentences).filter("token").select("sent_id", "pos", "open_gold", "open_guess")


def chunk_ends(sentences: DataFrame) -> DataFrame:
    """Whether a chunk ended just before a step, on both sides."""
    return token_events(sentences).select("sent_id", "pos", "end_gold", "end_guess")


def previous_tags(sentences: DataFrame) -> DataFrame:
    """Prefix and type of the token before, on both sides."""
    events = token_events(sentences).filter("token")
    return events.select("sent_id", "pos", "pg", "pg_type", "ph", "ph_type")


def _scanned(sentences: DataFrame, boundary: str) -> DataFrame:
    """``steps``, the busy steps of each sentence, and ``kept``, those the scan acts on.

    After a step that opens or ends an agreement the state of the scan is that
    step's ``start_ok``; other steps leave it alone. So a closing step completes a
    correct chunk exactly if the kept step before it has ``start_ok``: a shift by
    one of a filtered array, where a running state would be an ordered fold.
    """
    pairs = F.filter(_pairs(boundary), _busy)
    parsed = F.transform(pairs, lambda pair: _struct(_parsed(pair, boundary)))
    events = F.transform(parsed, lambda p: F.struct(p.alias("p"), _struct(_events(p)).alias("e")))
    states = F.transform(
        events, lambda x: F.struct(x["p"].alias("p"), x["e"].alias("e"), _struct(_states(x["p"], x["e"])).alias("s"))
    )
    last_type = tg.chunk_type(F.try_element_at("tags", F.lit(-1)))
    steps = sentences.select("sent_id", "words", last_type.alias("last_type"), states.alias("steps"))
    kept = steps.withColumn("kept", F.filter("steps", lambda x: x["s"]["reset"] | x["s"]["start_ok"]))
    opened = F.concat(F.array(F.lit(False)), F.transform("kept", lambda x: x["s"]["start_ok"]))
    return kept.withColumn("was_open", F.slice(opened, F.lit(1), F.size("kept")))


def correct_scan(sentences: DataFrame, boundary: str = BOUNDARY) -> DataFrame:
    """The steps that change the scan state; ``correct`` marks the end of a correct chunk."""
    linked = F.zip_with(
        "kept",
        "was_open",
        lambda x, o: _struct(
            {"pos": x["p"]["pos"], **{c: x["s"][c] for c in ("close", "reset", "start_ok")}, "correct": x["s"]["close"] & o}
        ),
    )
    return _scanned(sentences, boundary).select("sent_id", F.explode(linked).alias("at")).select("sent_id", "at.*")


def _fact(kind: Column, **counts: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    filled = [counts[c].cast("bigint") if c in counts else zero for c in COUNTS]
    return F.struct(kind.alias("type"), *[n.alias(c) for n, c in zip(filled, COUNTS)])


def sentence_facts(sentences: DataFrame, boundary: str = BOUNDARY) -> DataFrame:
    """All countable facts of the sentences: one row per chunk event, and one per
    sentence with its token counts (type null)."""
    one = F.lit(1)
    tokens = F.size(F.array_remove("words", boundary))
    wrong = F.filter(
        "steps", lambda x: x["p"]["token"] & ((x["p"]["g"] != x["p"]["h"]) | (x["p"]["g_type"] != x["p"]["h_type"]))
    )
    total = _fact(F.lit(None).cast("string"), tokens=tokens, correct_tags=tokens - F.size(wrong))
    gold = F.transform(
        F.filter("steps", lambda x: x["e"]["open_gold"]), lambda x: _fact(x["p"]["g_type"], found_gold=one)
    )
    guess = F.transform(
        F.filter("steps", lambda x: x["e"]["open_guess"]), lambda x: _fact(x["p"]["h_type"], found_guess=one)
    )
    correct = F.zip_with(
        "kept", "was_open", lambda x, o: F.when(x["s"]["close"] & o, _fact(x["p"]["pg_type"], correct_chunks=one))
    )
    # Only a chunk that runs into the prefix '.' can still be open at the end; it takes the last token's type.
    left_open = F.when(
        F.try_element_at("kept", F.lit(-1))["s"]["start_ok"], _fact(F.col("last_type"), correct_chunks=one)
    )
    facts = F.array_compact(F.concat(F.array(total), gold, guess, correct, F.array(left_open)))
    return _scanned(sentences, boundary).select("sent_id", F.explode(facts).alias("fact")).select("sent_id", "fact.*")


def chunk_counts(sentences: DataFrame, boundary: str = BOUNDARY) -> DataFrame:
    """Counts per chunk type, and the token counts in the row with type null.

    Facts are summed before the shuffle, so only a row per type and task moves.
    """
    facts = sentence_facts(sentences, boundary)
    return facts.groupBy("type").agg(*[F.sum(c).alias(c) for c in COUNTS])


def token_accuracy(sentences: DataFrame) -> DataFrame:
    """Numbers of tokens and of tokens with the right tag."""
    return chunk_counts(sentences).filter(F.col("type").isNull()).select("tokens", "correct_tags")


def count_chunks(sentences: DataFrame, count: str) -> DataFrame:
    """One of the chunk counts (``found_gold``, ``found_guess``, ``correct_chunks``) per type."""
    typed = chunk_counts(sentences).filter(F.col("type").isNotNull() & (F.col(count) > 0))
    return typed.select("type", count)


def chunk_spans(sentences: DataFrame, side: str = "gold", boundary: str = BOUNDARY) -> DataFrame:
    """Chunks of one side as rows: first and last position, and type.

    A chunk ends at the first end event after its start, which nearly always is the
    next event of its sentence; everything is found inside the row.
    """
    kind = "g_type" if side == "gold" else "h_type"
    parsed = F.transform(F.filter(_pairs(boundary), _busy), lambda pair: _struct(_parsed(pair, boundary)))
    events = F.transform(parsed, lambda p: F.struct(p.alias("p"), _struct(_events(p)).alias("e")))
    marks = F.transform(
        events,
        lambda x: F.struct(
            x["p"]["pos"].alias("pos"), x["p"][kind].alias("type"), x["e"][f"open_{side}"].alias("open"), x["e"][f"end_{side}"].alias("end")
        ),
    )
    rows = sentences.select("sent_id", F.size("words").alias("size"), F.filter(marks, lambda m: m["open"] | m["end"]).alias("marks"))
    rows = rows.withColumn("ends", F.transform(F.filter("marks", lambda m: m["end"]), lambda m: m["pos"]))

    def span(mark: Column, following: Column) -> Column:
        # A chunk that runs into the prefix '.' has no end event; it ends with a later one or with the sentence.
        later = F.coalesce(F.array_min(F.filter("ends", lambda end: end > mark["pos"])), F.col("size") + 1)
        end = F.when(following["end"], following["pos"]).otherwise(later) - 1
        return F.when(mark["open"], F.struct(mark["pos"].alias("start"), end.alias("end"), mark["type"].alias("type")))

    following = F.slice("marks", F.lit(2), F.size("marks"))
    spans = rows.select("sent_id", F.explode(F.array_compact(F.zip_with("marks", following, span))).alias("span"))
    return spans.select("sent_id", "span.*")


def _rate(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, 100 * F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def prf(counts: DataFrame) -> DataFrame:
    """Add precision, recall and F1 in percent; 0 where a denominator is 0."""
    both = F.col("precision") + F.col("recall")
    rates = counts.withColumns(
        {"precision": _rate("correct_chunks", "found_guess"), "recall": _rate("correct_chunks", "found_gold")}
    )
    return rates.withColumn(
        "f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0))
    )


def overall(counts: DataFrame) -> DataFrame:
    """One row of totals with accuracy, precision, recall and F1."""
    totals = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTS])
    return prf(totals.withColumn("accuracy", _rate("correct_tags", "tokens")))


def by_type(counts: DataFrame) -> DataFrame:
    """One row per chunk type of gold or guess, with precision, recall and F1."""
    typed = counts.filter(F.col("type").isNotNull() & (F.col("found_gold") + F.col("found_guess") > 0))
    return prf(typed.select("type", *COUNTS[2:]))


def evaluate(sentences: DataFrame) -> DataFrame:
    return overall(chunk_counts(sentences))


def evaluate_by_type(sentences: DataFrame) -> DataFrame:
    return by_type(chunk_counts(sentences))


def sorted_types(sentences: DataFrame) -> DataFrame:
    """Chunk types of gold or guess in byte order."""
    return evaluate_by_type(sentences).select("type").orderBy("type")


def report(sentences: DataFrame, fmt: str = "text") -> DataFrame:
    """The printed report as numbered lines. ``fmt`` is ``text`` or ``latex``.

    A rollup over the counts per type gives the type rows and the overall row, so
    the last window sees a row per type and no data.
    """
    # A row of zeros, so that an empty corpus has its overall row too.
    zero = sentences.sparkSession.range(1).select(_fact(F.lit(None).cast("string")).alias("fact")).select("fact.*")
    levels = chunk_counts(sentences).unionByName(zero).rollup("type").agg(
        F.grouping("type").alias("total"), *[F.sum(c).alias(c) for c in COUNTS]
    )
    total = F.col("total") == 1
    shown = total | (F.col("type").isNotNull() & (F.col("found_gold") + F.col("found_guess") > 0))
    rows = prf(levels.filter(shown).withColumn("accuracy", _rate("correct_tags", "tokens")))
    kind = F.coalesce("type", F.lit(""))
    scores = [F.col(c) for c in ("precision", "recall", "f1")]
    # The line formats of the report.
    if fmt == "text":
        rates = "precision: %6.2f%%; recall: %6.2f%%; FB1: %6.2f"
        processed = F.format_string(
            "processed %d tokens with %d phrases; found: %d phrases; correct: %d.",
            "tokens", "found_gold", "found_guess", "correct_chunks",
        )
        accuracy = F.when(F.col("tokens") > 0, F.format_string(f"accuracy: %6.2f%%; {rates}", "accuracy", *scores))
        lines = F.when(total, F.array(_line(0, processed), _line(1, accuracy))).otherwise(
            F.array(_line(2, F.format_string(f"%17s: {rates}  %d", kind, *scores, "found_guess")))
        )
    elif fmt == "latex":
        cells = r"&  %6.2f\%% & %6.2f\%% & %6.2f \\"
        title = F.lit(r"        & Precision &  Recall  & F$_{\beta=1} \\\hline")
        lines = F.when(
            total, F.array(_line(0, title), _line(3, F.format_string(rf"Overall {cells}\hline", *scores)))
        ).otherwise(F.array(_line(2, F.format_string(f"%-7s {cells}", kind, *scores))))
    else:
        raise ValueError("fmt is 'text' or 'latex'")
    placed = rows.select(kind.alias("type"), F.explode(lines).alias("l")).select("type", "l.rank", "l.line")
    order = Window.orderBy("rank", "type")
    # In the table a rule stands between the type rows and the overall row.
    ruled = F.when(F.lead("rank").over(order) == 3, F.concat("line", F.lit(r"\hline"))).otherwise(F.col("line"))
    printed = placed.filter(F.col("line").isNotNull())
    return printed.select(F.row_number().over(order).alias("line_no"), ruled.alias("line")).orderBy("line_no")


def _line(rank: int, line: Column) -> Column:
    return F.struct(F.lit(rank).alias("rank"), line.alias("line"))

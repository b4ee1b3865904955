"""License scan as an exact set-similarity join of text blocks with templates, with DataFrame functions.

A notice stands where at most ``span`` words in a row, whatever the line ends, hold at
least ``threshold`` of a template's distinct words; the span is twice the template's length, rounded
up to a power of 2, and ``BLOCK`` at least. For each span, documents are cut into blocks of twice
as many words which overlap by half, so every such place lies in one block.
A block that may meet a template of its span must have enough words (length). Words are put in order
of the number of such blocks, rarest first, over the whole corpus. The block must hold one of
the template's first words in that order (prefix) and, from the
place of the first shared word on, have enough words left on both sides (position);
what is left is compared exactly, word by word. Labels of the templates join the base labels,
which come from places where a phrase stands word by word.

Defined results: words are runs of digits, letters a-z (A-Z lower-cased) and
all characters from U+0080; null and empty texts have none; equal rows get equal
results. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from math import ceil
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.runtime import pin, ship

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Longest run of words that a short notice may take.
BLOCK = 64
# Phrases of the base scan and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Short public license notices and their labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
)


def split_words(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(text, upper, upper.lower()), F.lit(WORD), 0)


def phrase_places(words: Column, phrase: str) -> Column:
    """Starts (from 0) where the phrase's words follow each other."""
    parts = phrase.split(" ")
    last = F.size(words) - len(parts)

    def starts_here(i: Column) -> Column:
        here = F.lit(True)
        for k, part in enumerate(parts):
            here = here & (F.get(words, i + k) == part)
        return here

    places = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), starts_here)
    return F.when((last >= 0) & F.array_contains(words, parts[-1]), places).otherwise(F.array().cast("array<int>"))


class Template(NamedTuple):
    """A notice: its distinct words, how many of them must stand in a run of ``span`` words."""

    label: str
    words: frozenset[str]
    need: int
    span: int


def parse_templates(templates: tuple[tuple[str, str], ...], threshold: float) -> list[Template]:
    out = []
    for label, text in templates:
        words = text.split(" ")
        distinct = frozenset(words)
        span = max(BLOCK, 1 << (2 * len(words) - 1).bit_length())
        out.append(Template(label, distinct, ceil(threshold * len(distinct) - 1e-9), span))
    return out


def blocks(words: Column, vocabulary: list[str], least: dict[int, int]) -> Column:
    """Words of the vocabulary and their places, for every block of an array of words that may meet a template.

    ``least``: for each span the fewest distinct words that a template needs.
    """
    known = F.transform(words, lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("word"), i.alias("at"))))

    def cut(known: Column, span: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(known) - span - 1, F.lit(0)), F.lit(span))
        held = F.transform(starts, lambda s: F.array_compact(F.slice(known, s + 1, F.lit(2 * span))))
        enough = F.filter(held, lambda b: F.size(distinct_words(b)) >= least[span])
        return F.transform(enough, lambda b: F.struct(F.lit(span).alias("span"), b.alias("words")))

    # Within the lambda the words are looked up once a row, not once a block.
    return F.flatten(F.transform(F.array(known), lambda k: F.concat(*[cut(k, span) for span in sorted(least)])))


def distinct_words(block: Column) -> Column:
    return F.array_distinct(F.transform(block, lambda k: k["word"]))


def scan_texts(docs: DataFrame, key: str, text: str, vocabulary: list[str], least: dict[int, int]) -> DataFrame:
    """key, text_hash, the base scan, and the blocks as their words of the vocabulary."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("text_hash"), split_words(body).alias("words"))
    for i, (phrase, _) in enumerate(PHRASES):
        rows = rows.withColumn(f"at{i}", phrase_places(F.col("words"), phrase))
    places = F.concat(*[F.col(f"at{i}") for i in range(len(PHRASES))])
    labels = F.array(*[F.when(F.size(f"at{i}") > 0, label) for i, (_, label) in enumerate(PHRASES)])
    return rows.select(
        "key", "text_hash", F.size("words").cast("long").alias("n_words"), F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(labels))).alias("base"), blocks(F.col("words"), vocabulary, least).alias("blocks"),
    )


def word_order(scanned: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary, rarest first by the number of blocks in the corpus; one row per word of it."""
    counted = scanned.select(F.explode("blocks.words").alias("b")).select(F.explode(distinct_words(F.col("b"))).alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in counted.collect()}
    return sorted(vocabulary, key=lambda w: (found.get(w, 0), w))


class Place(NamedTuple):
    """First and last word of a run that meets a template, and the template's words in it."""

    first: int
    last: int
    words: frozenset[str]
    cover: float


def places_of(known: list[tuple[int, str]], template: Template) -> list[Place]:
    """The shortest runs of at most ``span`` words with enough words of the template, in order of both ends."""
    latest: dict[str, int] = {}
    out: list[Place] = []
    for at, word in known:
        if word not in template.words:
            continue
        latest[word] = at
        held = {w: p for w, p in latest.items() if p > at - template.span}
        first = min(held.values())
        # A run with the same start is longer than the one before it and has to hold more.
        if len(held) >= template.need and not (out and out[-1].first == first and len(out[-1].words) >= len(held)):
            out.append(Place(first, at, frozenset(held), len(held) / len(template.words)))
    return out


def outdone(place: Place, rivals: list[Place]) -> bool:
    """Whether a run over the same place covers its template better and holds all words matched here.

    So versions of one license that differ in a word name the best one, and other notices are kept.
    """
    for rival in rivals[bisect_left(rivals, place.first, key=lambda r: r.last) :]:
        if rival.first > place.last:
            return False
        if rival.cover > place.cover and place.words <= rival.words:
            return True
    return False


def named_templates(known: list[tuple[int, str]], templates: list[Template]) -> tuple[list[str], float]:
    """Labels of the templates met, and the best cover (0 without any)."""
    places = [places_of(known, template) for template in templates]
    labels = set()
    for template, own in zip(templates, places, strict=True):
        others = [rivals for rivals in places if rivals is not own]
        if any(not any(outdone(place, rivals) for rivals in others) for place in own):
            labels.add(template.label)
    return sorted(labels), max((p.cover for own in places for p in own), default=0.0)


def scan_licenses(
    docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.8,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The base scan of every row, with ``labels`` and ``score`` by the templates met."""
    spark = docs.sparkSession
    ship(spark)
    wanted = parse_templates(templates, threshold)
    vocabulary = sorted({w for t in wanted for w in t.words})
    least = {span: min(t.need for t in wanted if t.span == span) for span in {t.span for t in wanted}}
    scanned = pin(scan_texts(docs, key, text, vocabulary, least))
    order = word_order(scanned, vocabulary)
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for at, template in enumerate(wanted):
        ranked = sorted(rank[w] for w in template.words)
        index += [(template.span, r, p, at, ranked, template.need) for p, r in enumerate(ranked[: len(ranked) - template.need + 1])]
    # Rows of the prefix index: bounded by the words of the templates.
    prefixes = F.broadcast(spark.createDataFrame(index, "span int, rank int, place int, template int, ranked array<int>, need int"))
    ranks = F.map_from_arrays(F.array(*[F.lit(w) for w in order]), F.array(*[F.lit(i) for i in range(len(order))]))
    held = scanned.select("key", "text_hash", F.inline("blocks"))
    held = held.withColumn("has", F.array_sort(F.transform(distinct_words(F.col("words")), lambda w: F.element_at(ranks, w))))
    pairs = held.select("*", F.posexplode("has").alias("place_b", "rank")).join(prefixes, ["span", "rank"])
    left = F.least(F.size("ranked") - F.col("place"), F.size("has") - F.col("place_b"))
    pairs = pairs.filter((F.size("has") >= F.col("need")) & (F.col("place") + left >= F.col("need")))
    met = pairs.filter(F.size(F.array_intersect("has", "ranked")) >= F.col("need"))
    by_row = met.groupBy("key", "text_hash").agg(F.collect_set("template").alias("templates"), F.collect_set("words").alias("words"))
    known = F.array_sort(F.array_distinct(F.flatten("words")), lambda a, b: a["at"] - b["at"])
    by_row = by_row.withColumn("known", known)

    def name(at: pd.Series, words: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        rows = zip(at, words, numbers, strict=True)
        out = [named_templates(list(zip(a.tolist(), w, strict=True)), [wanted[t] for t in n]) for a, w, n in rows]
        return pd.DataFrame(out, columns=["more", "best"])

    named = F.pandas_udf(name, "more array<string>, best double")(F.col("known.at"), F.col("known.word"), F.col("templates"))
    found = by_row.select(F.col("key").alias("k2"), F.col("text_hash").alias("h2"), named.alias("named")).select("k2", "h2", "named.more", "named.best")

    whole = scanned.drop("blocks").join(found, F.col("key").eqNullSafe(F.col("k2")) & (F.col("text_hash") == F.col("h2")), "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return whole.select(
        F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", more)), ",").alias("labels"), score.alias("score"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon of words and word beginnings is learned from a part of the labelled
texts, where a term must occur in enough toxic texts and hardly in others; the
trees are grown on another part, whose features no lexicon entry has seen, and
calibrated on a third. Features: densities of hits of the seed lexicon, the learned
words and beginnings, hits after obfuscation is undone, nearness of hits to a
second-person word, rates of capitals, marks, exclamation marks and obfuscated words.

Defined results: null and empty texts get the score of a text without any hit;
without labels of both kinds the score is hits / (hits + 1) of the seed lexicon.
Labelled texts are taken up to ``SAMPLE``; all statistics of a text use all of it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.labelled import DIGITS, LETTERS_ONLY, LOWER, SPACE, UPPER, count_of, labelled_texts
from tagloom.runtime import pin, ship

#: Labelled texts used at most.
SAMPLE = 20_000
#: Entries of the learned lexicon at most, and least number of toxic texts and share of them behind one.
LEXICON, SUPPORT, PURITY = 2_000, 3, 0.9
# Common insults and second-person words.
SEEDS = frozenset(b"idiot moron stupid scum trash loser clown pathetic worthless disgusting dumb ugly bastard".split())
SECOND_PERSON = frozenset(b"you your yours yourself du dich dir dein vous votre tu toi usted ustedes tus".split())
# Characters that stand for letters.
LEET = bytes.maketrans(b"013457@$!|", b"oieasTasil".lower())
PREFIXES = (4, 5, 6)
_INSIDE = re.compile(rb"[A-Za-z][0-9@$!|*.\-_]+[A-Za-z]")
_MARKS = bytes(b for b in range(33, 127) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
#: Value of a text without any word or beginning of the lexicon.
NO_HIT = -20.0


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term and label of each distinct word and beginning of each text, counted in the batch."""
    for batch in batches:
        counts: Counter[tuple[bytes, float]] = Counter()
        labels = batch.column("label").to_pylist()
        for text, label in zip(batch.column("text").cast(pa.binary()).to_pylist(), labels, strict=True):
            words = set(text.translate(LETTERS_ONLY).lower().split())
            terms = {b"=" + w for w in words} | {b"^" + w[:n] for w in words for n in PREFIXES if len(w) >= n}
            counts.update((t, label) for t in terms)
        if counts:
            names, marks = zip(*counts, strict=True)
            columns = [pa.array([n.decode("latin-1") for n in names]), pa.array(marks, pa.float64()), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "label", "n"])


def learn_lexicon(sample: DataFrame) -> dict[bytes, float]:
    """Words (``=``) and beginnings (``^``) that mark toxic texts, the best ``LEXICON`` of them.

    The value is how unlikely the term's toxic texts are by chance, in natural log units, less what the
    number of terms tried makes likely: above 0 chance alone hardly gives such a term.
    """
    counted = sample.mapInArrow(_terms, "term string, label double, n long").groupBy("term")
    both = pin(counted.agg(F.sum(F.when(F.col("label") > 0, F.col("n")).otherwise(0)).alias("toxic"), F.sum("n").alias("texts")))
    share = sample.agg(F.avg((F.col("label") > 0).cast("double"))).first()[0]
    if not share or share >= 1:
        return {}
    good = both.filter((F.col("toxic") >= SUPPORT) & (F.col("toxic") >= PURITY * F.col("texts")))
    value = F.col("toxic") * -log(share) - log(both.count()) - 2 * (F.col("texts") - F.col("toxic"))
    rows = good.select("term", value.alias("value")).orderBy(F.col("value").desc(), "term").limit(LEXICON).collect()
    return {r["term"].encode("latin-1"): r["value"] for r in rows}


def _bare(token: bytes) -> bytes:
    """Letters of a token, with signs that stand for letters put back."""
    return token.lower().translate(LEET).translate(LETTERS_ONLY).replace(b" ", b"")


class Featurizer:
    def __init__(self, lexicon: dict[bytes, float]) -> None:
        self.words = {t[1:]: v for t, v in lexicon.items() if t[:1] == b"="}
        self.beginnings = {t[1:]: v for t, v in lexicon.items() if t[:1] == b"^"}

    def _begins(self, word: bytes) -> float:
        return max((self.beginnings.get(word[:n], NO_HIT) for n in PREFIXES if len(word) >= n), default=NO_HIT)

    def features(self, text: bytes) -> list[float]:
        words = text.translate(LETTERS_ONLY).lower().split()
        counts = Counter(words)
        n = max(1, len(words))
        seeds = learned = begun = second = 0
        best_word = best_beginning = NO_HIT
        hits = set()
        for word, k in counts.items():
            value, beginning = self.words.get(word, NO_HIT), self._begins(word) if self.beginnings else NO_HIT
            if value > NO_HIT:
                best_word = max(best_word, value)
                learned += k * (value > 0)
            if beginning > NO_HIT:
                best_beginning = max(best_beginning, beginning)
                begun += k * (beginning > 0)
            if word in SEEDS:
                seeds += k
            elif max(value, beginning) <= 0:
                second += k * (word in SECOND_PERSON)
                continue
            hits.add(word)
        hidden = odd = 0
        if _INSIDE.search(text):
            for token in text.split():
                if _INSIDE.search(token):
                    odd += 1
                    bare = _bare(token)
                    hidden += bare in SEEDS or self.words.get(bare, NO_HIT) > 0
        near = 0.0
        if hits and second:
            at_hit = [i for i, w in enumerate(words) if w in hits]
            at_you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
            near = 1.0 / _least_distance(at_hit, at_you)
        letters = max(1, count_of(text, UPPER + LOWER))
        solid = max(1, len(text) - count_of(text, SPACE))
        return [
            float(seeds), 100.0 * seeds / n, best_word, 100.0 * learned / n, best_beginning, 100.0 * begun / n,
            float(hidden), near, 100.0 * second / n, count_of(text, UPPER) / letters, count_of(text, _MARKS) / solid,
            count_of(text, b"!") / solid, 100.0 * odd / n, count_of(text, DIGITS) / solid,
        ]


def _least_distance(a: list[int], b: list[int]) -> int:
    i = j = 0
    best = 1 << 30
    while i < len(a) and j < len(b):
        best = min(best, abs(a[i] - b[j]) + 1)
        if a[i] < b[j]:
            i += 1
        else:
            j += 1
    return best


def _featurize(lexicon: dict[bytes, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurizer = Featurizer(lexicon)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = pa.array([featurizer.features(t or b"") for t in texts], pa.list_(pa.float64()))
            rest = [i for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], found], names=[*[batch.schema.names[i] for i in rest], "features"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _part(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit("part")), F.lit(10))


class Model:
    """Lexicon, trees and calibration; trees are missing if there was nothing to learn from."""

    def __init__(self, docs: DataFrame, labels: DataFrame, use: Column) -> None:
        ship(docs.sparkSession)
        sample = labelled_texts(docs, labels, "toxic", SAMPLE, use)
        part = _part(F.col("doc_id"))
        self.lexicon = learn_lexicon(sample.filter(part < 5))
        rest = sample.filter(part >= 5).coalesce(4)
        rows = rest.mapInArrow(_featurize(self.lexicon), "doc_id long, label double, features array<double>")
        rows = pin(rows.select("label", array_to_vector("features").alias("features"), part.alias("part")))
        grow, fit = rows.filter("part < 8"), rows.filter("part >= 8")
        classes = {(r["late"], r["label"]) for r in rows.select((F.col("part") >= 8).alias("late"), "label").distinct().collect()}
        self.trees = self.isotonic = None
        if {(False, 0.0), (False, 1.0)} <= classes:
            self.trees = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.3, maxBins=64, minInstancesPerNode=2, seed=7).fit(grow)
            if {(True, 0.0), (True, 1.0)} <= classes:
                raw = self.trees.transform(fit).select("label", vector_to_array("probability")[1].alias("p"))
                self.isotonic = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="score").fit(raw)

    def score(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` columns and ``score``."""
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        slim = docs.select(*keep, text.alias("text"))
        schema = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keep)
        rows = slim.mapInArrow(_featurize(self.lexicon), f"{schema}, features array<double>")
        if self.trees is None:
            hits = F.get("features", F.lit(0))
            return rows.select(*keep, (hits / (hits + 1)).alias("score"))
        vectors = rows.select(*keep, array_to_vector("features").alias("features"))
        p = self.trees.transform(vectors).select(*keep, vector_to_array("probability")[1].alias("p"))
        if self.isotonic is None:
            return p.withColumnRenamed("p", "score")
        return self.isotonic.transform(p).select(*keep, F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = Model(docs, labels, ~held_out(F.col("doc_id"))).score(docs, ["doc_id"])
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )

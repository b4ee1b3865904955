"""Filter interaction audit: what every order of a set of text filters removes, by path counting.

A pass over the texts turns each document into the set of filters it fails. Counts
per part and failure set are all that is needed: the states are the sets of filters
already applied, an edge (state, filter) removes the documents that fail the filter
and none of the state. Paths from the empty state reach a state in ``reach`` orders and
leave it in ``leave`` orders; so an edge lies on reach x leave orders, which is its
weight in the filter's Shapley sum. The steps of each order are read from the same edges.

Defined results: a null text is empty; texts are equal if their SHA-256 is; repeated rows
of one id are different documents and do not make each other fail ``E``; a null id is
larger than all others, and null ids are not smaller than each other; a null part is the
empty string; of several labels of one id the largest counts, null ids have none. Parts without
rows do not occur, so an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.labelled import UPPER, count_of
from tagloom.runtime import counted, lookup_join, pin, ship

#: Name of each filter; the bit of a filter in a failure set or state is its place here.
FILTERS = "ABCDE"
#: Fewest words, least percent of distinct words, most percent of capitals, marks.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, MARKS = 50, 65, 5, b"#$%&*|"
#: Rows of a look-up table that passes through the driver: a few dozen MB there, whatever the corpus. Rows are small, so larger tables are shuffled.
LOOKUP_ROWS = 100_000
#: Bytes of a text that are cut into words at a time.
PIECE = 4 << 20
SPACES = (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")


def _pieces(text: bytes) -> Iterator[bytes]:
    """Slices of a text which end before white space, so that a very long text is never one list of words."""
    at = 0
    while len(text) - at > PIECE:
        cut = min((p for s in SPACES if (p := text.find(s, at + PIECE)) >= 0), default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_counts(text: bytes) -> tuple[int, int]:
    """Words and distinct words between ASCII white space."""
    if len(text) <= PIECE:
        words = text.split()
        return len(words), len(set(words))
    total, seen = 0, set()
    for piece in _pieces(text):
        words = piece.split()
        total += len(words)
        seen.update(words)
    return total, len(seen)


def text_failures(text: bytes, characters: int) -> int:
    """Failure set of the filters that look at one text alone: A, B, C, D."""
    words, distinct = word_counts(text)
    few = words < MIN_WORDS
    repeated = 100 * distinct < MIN_DISTINCT * words
    loud = 100 * count_of(text, UPPER) > MAX_CAPITALS * characters
    marked = len(text.translate(None, MARKS)) != len(text)
    return few | repeated << 1 | loud << 2 | marked << 3


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("text")
        characters = pc.utf8_length(column).to_pylist()
        texts = column.cast(pa.large_binary()).to_pylist()
        fails = [text_failures(t, n) for t, n in zip(texts, characters, strict=True)]
        digests = [hashlib.sha256(t).digest() for t in texts]
        columns = [*(batch.column(c) for c in ("id", "part")), pa.array(fails, pa.int32()), pa.array(digests, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "part", "fails", "digest"])


def failure_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """id, part and ``fails`` (bits of ``FILTERS``) of every document; pinned.

    Only texts that occur more than once can fail ``E``; they are looked up by digest, so a text
    that holds a third of all rows is one row of the look-up table, counted before it moves.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(
        F.col(key).alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    rows = pin(slim.mapInArrow(_scan, f"id {kind}, part string, fails int, digest binary"))
    copies = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    repeated = pin(copies.filter("n > 1").select("digest", "first"))
    found = lookup_join(rows, repeated, "digest", ["id"], "left", **counted(repeated, "digest"), most=LOOKUP_ROWS)
    # ``first`` is null where the text is single or all its ids are null.
    later = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    last = 1 << FILTERS.index("E")
    return found.select("id", "part", (F.col("fails") + F.when(later, last).otherwise(0)).alias("fails"))


def failure_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails, n, good, toxic: documents of each failure set, and those labelled good or toxic."""
    marks = [F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int")).alias(c) for c in ("quality", "toxic")]
    known = pin(labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(*marks))
    size = known.count()
    # Ids are numbers or short strings; 16 bytes a key keep the bound of the look-up.
    marked = lookup_join(rows, known, "id", ["part", "fails"], "left", size, 16 * size, most=LOOKUP_ROWS)
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long"))
    sums = [F.count(F.lit(1)).alias("n"), total("quality").alias("good"), total("toxic").alias("toxic")]
    return marked.groupBy("part", "fails").agg(*sums)


def reach(filters: int) -> list[int]:
    """Orders that reach every state, by adding up over the edges that enter it."""
    counts = [1] + [0] * ((1 << filters) - 1)
    for state in range(1 << filters):
        for f in range(filters):
            if not state >> f & 1:
                counts[state | 1 << f] += counts[state]
    return counts


def leave(filters: int) -> list[int]:
    """Orders in which the remaining filters can follow every state: the same sums, backward."""
    full = (1 << filters) - 1
    counts = [0] * full + [1]
    for state in range(full - 1, -1, -1):
        counts[state] = sum(counts[state | 1 << f] for f in range(filters) if not state >> f & 1)
    return counts


def lattice_edges(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """part, state, filter, weight and what the edge removes or leaves, for all edges of every part.

    A row of ``counts`` meets each edge once, so the work is the number of failure sets times a constant.
    """
    n = len(names)
    into, out = reach(n), leave(n)
    edges = [
        F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(into[s] * out[s | 1 << f]).cast("long").alias("weight"))
        for s in range(1 << n)
        for f in range(n)
        if not s >> f & 1
    ]
    met = counts.select("*", F.inline(F.array(*edges)))
    bit = F.expr("shiftleft(1, filter)")
    fails, before = F.col("fails").bitwiseAND(bit) != 0, F.col("fails").bitwiseAND(F.col("state")) != 0

    def total(condition: Column, what: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(what)).otherwise(0)).cast("long")

    return met.groupBy("part", "state", "filter", "weight").agg(
        total(~fails & ~before).alias("kept"),
        total(fails & ~before).alias("removed"),
        total(fails & before).alias("redundant"),
        total(F.col("fails") == bit).alias("unique_fails"),
        total(fails & ~before, "good").alias("good_lost"),
        total(fails & ~before, "toxic").alias("toxic_lost"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """A row per part, order of the filters and step. ``shapley`` is the filter's removals summed over all orders."""
    edges = pin(lattice_edges(failure_counts(failure_sets(docs, part=part), labels)))
    shapley = edges.groupBy("part", "filter").agg(F.sum(F.col("weight") * F.col("removed")).alias("shapley"))
    # As many rows as orders have steps, whatever the data: 600 for five filters.
    steps = edges.sparkSession.createDataFrame(
        [
            ("".join(FILTERS[f] for f in order), i + 1, sum(1 << f for f in order[:i]), order[i])
            for order in permutations(range(len(FILTERS)))
            for i in range(len(order))
        ],
        "filter_order string, step int, state int, filter int",
    )
    whole = edges.join(shapley, ["part", "filter"]).join(F.broadcast(steps), ["state", "filter"])
    measures = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return whole.select("part", "filter_order", "step", *measures)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return audit_filters(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

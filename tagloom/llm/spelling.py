"""Spelling variants: words within one edit of each other, by a bit-sliced position index.

The index of a set of words holds a bitset over them for every (position, letter).
A query word is read letter by letter; the words that agree so far (no error), and those
with one replaced, one further or one missing letter, are bitsets as well, advanced for all
words at once: an error set takes over from the error-free set at the position of the
edit and goes on with the slices shifted by one position where the lengths differ.
Queries of a set are advanced together in numpy.

An edit leaves the first or the last half of a word as it was. So words meet in blocks: by
lesser length of the pair, side and half; a pair that shares both halves counts for the first
only, whose words are the error-free set after half the letters. Blocks are packed into buckets of
bounded size with one index each; a block of more than ``PIECE`` words is cut into pieces, and
each pair of pieces is a cell of its own, so no task holds a large block. Only the number of near
words and the best of them leave a cell, never the pairs.

Defined results: words are the maximal runs of ``LETTERS``, with A-Z in lower case; a null or empty
text has none; all rows count, repeated ones too; a null id is the empty text in the slip's
checksum. Of near words with equal counts the first in code-point order is the form. An empty table has no
words. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.runtime import counted, lookup_join, pin, ship, task_partitions

#: Characters of words.
LETTERS = "A-Za-zÀ-ÿ"
#: Least letters and occurrences of a word, and how many times as frequent a form must be.
MIN_LENGTH, MIN_COUNT, FORM_RATIO = 6, 5, 5
#: One in so many pairs of document and run loses a letter.
SLIPS = 199
#: Different words a task counts before it hands them on, and characters cut into runs at a time.
COUNTED, SLICE = 200_000, 4 << 20
#: Words of a piece of a large block, rows of a bucket, queries advanced together, letters of an index.
PIECE, BUCKET, TOGETHER, INDEX_LETTERS = 2048, 8192, 512, 1 << 22
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_OTHER = re.compile(f"[^{LETTERS}]")


def _slices(text: str) -> Iterator[str]:
    """Parts of a text that end where no run goes on."""
    at = 0
    while len(text) - at > SLICE:
        found = _OTHER.search(text, at + SLICE)
        cut = found.start() if found else len(text)
        yield text[at:cut]
        at = cut
    yield text[at:]


def _count(min_length: int, slips: int) -> Callable:
    # A match begins where a run does: from there it is the longest, and shorter runs have none.
    runs = re.compile(f"[{LETTERS}]{{{min_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            columns = [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())]
            total.clear()
            return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

        for batch in batches:
            ids = batch.column("id").to_pylist()
            for key, text in zip(ids, batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                start = zlib.crc32(f"{key}:".encode())
                for part in _slices(text.translate(_LOWER).decode()):
                    found = Counter(runs.findall(part))
                    total.update(found)
                    if not slips:
                        continue
                    for word, n in found.items():
                        h = zlib.crc32(word.encode(), start)
                        if not h % slips:
                            at = h % len(word)
                            total[word] -= n
                            if len(word) > min_length:
                                total[word[:at] + word[at + 1 :]] += n
                if len(total) > COUNTED:
                    yield flush()
        if total:
            yield flush()

    return run


def vocabulary(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, slips: int = SLIPS
) -> DataFrame:
    """word, n of the words with enough letters and occurrences; pinned. ``slips=0`` leaves all runs as they are."""
    ship(docs.sparkSession)
    named = F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id")
    slim = docs.select(named, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counts = slim.mapInArrow(_count(min_length, slips), "word string, n long")
    return pin(counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count))


class PositionIndex:
    """Bitsets over words of ``length`` or one letter more, per position and letter."""

    def __init__(self, words: list[str], length: int):
        self.length, self.size = length, len(words)
        self.columns = _letters(words, length + 1)
        self.longer = self.bits((self.columns[:, length] != 0)[None, :])[0]
        self.all = self.bits(np.ones((1, self.size), dtype=bool))[0]
        self.slices = [self._slice(self.columns[:, i]) for i in range(length + 1)]

    @staticmethod
    def bits(rows: np.ndarray) -> np.ndarray:
        """Rows of flags as rows of 64-bit words."""
        packed = np.packbits(rows, axis=1, bitorder="little")
        return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)

    def _slice(self, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        letters, which = np.unique(column, return_inverse=True)
        rows = self.bits(which[None, :] == np.arange(len(letters))[:, None])
        # Code point 0 is no letter; a last row without bits stands for letters that no word has here.
        rows[letters == 0] = 0
        return letters, np.concatenate([rows, np.zeros((1, rows.shape[1]), dtype=np.uint64)])

    def having(self, position: int, letters: np.ndarray) -> np.ndarray:
        """For each letter the words that have it at ``position``."""
        known, rows = self.slices[position]
        at = np.minimum(np.searchsorted(known, letters), len(known) - 1)
        return rows[np.where(known[at] == letters, at, len(known))]

    def near(self, words: list[str], half: int) -> tuple[np.ndarray, np.ndarray]:
        """For query words of one length: the words one edit away, and those with the same first ``half`` letters."""
        return (self._shorter if len(words[0]) == self.length else self._longer)(_letters(words, len(words[0])), half)

    def _shorter(self, query: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
        exact = np.repeat(self.all[None, :], len(query), axis=0)
        replaced, further, same = np.zeros_like(exact), np.zeros_like(exact), exact
        for i in range(self.length):
            here = self.having(i, query[:, i])
            further = (further | exact) & self.having(i + 1, query[:, i])
            replaced = (replaced & here) | (exact & ~here)
            exact = exact & here
            if i + 1 == half:
                same = exact
        return (replaced & ~self.longer) | ((further | exact) & self.longer), same

    def _longer(self, query: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
        exact = np.repeat(self.all[None, :], len(query), axis=0)
        missing, same = np.zeros_like(exact), exact
        for i in range(self.length + 1):
            missing = exact if not i else (missing & self.having(i - 1, query[:, i])) | exact
            exact = exact & self.having(i, query[:, i])
            if i + 1 == half:
                same = exact
        return missing & ~self.longer, same


def _letters(words: list[str], width: int) -> np.ndarray:
    """Code points of words as rows of ``width``, 0 after the end."""
    return np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)


def _search(index: pa.Table, queries: pa.Table, length: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """For the queries with near words in the same cell: word, their number, place of the best in ``index``.

    ``index`` is in descending order of counts, so the best near word is the first bit.
    """
    slices = PositionIndex(index.column("word").to_pylist(), length)
    cells, of_word = np.unique(index.column("cell").to_numpy(), return_inverse=True)
    members = slices.bits(of_word[None, :] == np.arange(len(cells))[:, None])
    words = queries.column("word").to_pylist()
    sizes, at = np.array([len(w) for w in words]), np.searchsorted(cells, queries.column("cell").to_numpy())
    last = queries.column("last").to_numpy(zero_copy_only=False)
    at = np.minimum(at, len(cells) - 1)
    known = cells[at] == queries.column("cell").to_numpy()
    for size in (length, length + 1):
        rows = np.flatnonzero((sizes == size) & known)
        for low in range(0, len(rows), TOGETHER):
            part = rows[low : low + TOGETHER]
            asked = [words[i] for i in part.tolist()]
            near, same = slices.near(asked, length // 2)
            near &= members[at[part]]
            near[last[part]] &= ~same[last[part]]
            counts = np.bitwise_count(near).sum(axis=1).astype(np.int64)
            hits = np.flatnonzero(counts)
            if len(hits):
                first = np.unpackbits(near[hits].view(np.uint8), axis=1, bitorder="little").argmax(axis=1)
                yield [asked[i] for i in hits.tolist()], counts[hits], first


NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])


def _search_bucket(bucket: pa.Table) -> pa.Table:
    """Near words within the cells of a bucket: a row per query word and index that has some."""
    found = []
    for length in bucket.column("length").unique().to_pylist():
        rows = bucket.filter(pc.equal(bucket.column("length"), length))
        queries = rows.filter(rows.column("asks"))
        index = rows.filter(rows.column("listed")).sort_by([("n", "descending"), ("word", "ascending")])
        step = max(64, min(BUCKET, INDEX_LETTERS // (length + 1)))
        for low in range(0, index.num_rows, step):
            part = index.slice(low, step).combine_chunks()
            for words, counts, first in _search(part, queries, length):
                best = part.take(pa.array(first))
                columns = [pa.array(words), pa.array(counts), best.column("n"), best.column("word")]
                found.append(pa.table(columns, names=NEAR.names).cast(NEAR))
    return pa.concat_tables(found) if found else NEAR.empty_table()


def cells(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Rows of the cells in which words may be near: cell, length, last, word, n, listed, asks.

    ``listed`` rows are in the cell's index, ``asks`` rows are its queries. Blocks of a single word,
    or without a word of the lesser length, hold no pair and are left out.
    """
    size = F.length("word")
    lesser = F.explode(F.filter(F.array(size, size - 1), lambda k: k >= min_length)).alias("length")
    half = F.expr("length div 2").cast("int")
    sides = F.explode(F.array(
        F.struct(F.lit(False).alias("last"), F.substr("word", F.lit(1), half).alias("half")),
        F.struct(F.lit(True).alias("last"), F.right("word", half).alias("half")),
    )).alias("side")
    keyed = words.select("word", "n", lesser).select("word", "n", "length", sides)
    keyed = keyed.select("word", "n", "length", "side.last", F.concat_ws(":", "length", "side.last", "side.half").alias("block"))
    blocks = keyed.groupBy("block").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.length("word") == F.col("length")).alias("short"))
    shared = pin(blocks.filter("rows > 1 and short > 0").select("block", F.ceil(F.col("rows") / PIECE).cast("int").alias("pieces")))
    met = lookup_join(keyed, shared, "block", ["word"], "inner", **counted(shared, "block"))
    own = F.pmod(F.xxhash64("word"), F.col("pieces").cast("long")).cast("int")
    every = F.sequence(F.lit(0), F.col("pieces") - 1)

    def cell(i, j, listed, asks):
        return F.struct(i.alias("i"), j.alias("j"), listed.alias("listed"), asks.alias("asks"))

    yes, no = F.lit(True), F.lit(False)
    listed = F.transform(every, lambda j: cell(F.col("own"), j, yes, j == F.col("own")))
    asking = F.transform(F.filter(every, lambda i: i != F.col("own")), lambda i: cell(i, F.col("own"), no, yes))
    placed = met.withColumn("own", own).withColumn("at", F.explode(F.concat(listed, asking)))
    name = F.concat_ws(":", "block", "at.i", "at.j").alias("cell")
    return placed.select(name, "length", "last", "word", "n", "at.listed", "at.asks")


def near_words(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """word, n_near, form_n, form of every word (word, n; unique) with near words; ``form`` is the most frequent of them."""
    rows = pin(cells(words, min_length))
    buckets = rows.count() // BUCKET + 1
    named = rows.withColumn("bucket", F.pmod(F.xxhash64("cell"), F.lit(buckets)))
    # Cells of a bucket are told apart by number.
    dealt = named.withColumn("cell", F.xxhash64("cell")).repartition(task_partitions(words.sparkSession, buckets), "bucket")
    schema = "word string, n_near long, form_n long, form string"
    found = dealt.groupBy("bucket").applyInArrow(_search_bucket, schema)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    sums = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return sums.select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


def follow(links: DataFrame) -> DataFrame:
    """word, root for the links word, form: the last word that forms lead to.

    Each round doubles the steps. Counts grow along a chain by ``FORM_RATIO`` at least, so
    there are about log2(log5(largest count)) rounds.
    """
    now = pin(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = pin(now.join(ahead, "root", "left").select("word", "root", "beyond"))
        if step.filter("beyond is not null").isEmpty():
            return now
        now = step.select("word", F.coalesce("beyond", "root").alias("root"))


def group_variants(words: DataFrame, ratio: int = FORM_RATIO, min_length: int = MIN_LENGTH) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of a pinned vocabulary."""
    ship(words.sparkSession)
    met = words.join(near_words(words, min_length), "word", "left")
    good = F.col("form_n") >= ratio * F.col("n")
    judged = pin(met.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n"),
    ))
    roots = follow(judged.filter("form is not null"))
    whole = judged.join(roots, "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return group_variants(vocabulary(docs))

"""Benchmark decontamination by edit distance, with CGK embeddings and bit sampling.

Texts are words, lower-cased and without marks; in scripts that put no spaces between
words (Chinese, Japanese, Thai, Lao, Khmer, Burmese) every character counts as a word. The CGK embedding walks over a
word sequence: at each step it writes the present word and moves on by a random
bit that depends on step and word, so two windows at a small edit distance walk
alike most of the time and differ in few steps. Sampled steps of that embedding are
a locality sensitive hash of the window. Each item is hashed from several anchor
words, so that edits at its start do not hide it, and with ``repeats`` independent
walks; windows from every word of every document are hashed in the same way, and
leave as soon as a sampled word fits no item. A pair of window and item that
agrees in one hash is checked: the exact edit distance of the item to the best
stretch of the document about the window must be at most ``ratio`` of its words.

The walks of ``STEPS`` steps are a sample and miss some edits, more so in short items, and items
of fewer words have none. So each item is also cut into one piece more than it may have edits: of
any allowed match at least one piece stands unchanged in the document, and every window that
holds a piece is checked. By that no match is lost, at any length of items: recall is 1.

Items are taken in blocks of ``BLOCK_WORDS`` words, and all documents meet every
block; nothing is shuffled. Items of fewer than 1 / ``ratio`` words (5) may have no edits:
they match where all their words stand in a row. Null and empty texts have no words and
match nothing. Equal items are reported each. Extra columns are ignored by the queries
and kept by the filter.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.ngram_join import _mixed, word_hashes
from tagloom.runtime import ship

#: Share of an item's words that may be edited.
RATIO = 0.2
#: Independent walks, steps of a walk, sampled steps, words between anchors.
REPEATS, STEPS, SAMPLED, STRIDE = 4, 12, 5, 3
#: Words of all items of a block; a block travels to every task.
BLOCK_WORDS = 2_000_000
#: Words of documents that are walked over together.
CHUNK_WORDS = 200_000
#: Cells of the distance rows that are filled together.
TABLE_CELLS = 1 << 18
_BITS, _PIECE_BITS = 16, 20
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Characters of scripts without spaces between words, and the marks of such texts.
_UNSPACED = re.compile(
    "([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3021-\u3029\u3031-\u3035\u303b\u3041-\u30fa\u30fc-\u312f\u31a0-\u31bf"
    "\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua9e0-\ua9ff\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f\U00016fe0-\U00018dff\U0001aff0-\U0001b16f\U00020000-\U0003ffff])"
)
_MARKS = re.compile("[\u3000-\u3004\u3008-\u3020\u3030\u303d\u30fb\ufe30-\ufe4f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
MATCH = "array<struct<item_id:bigint,n_words:bigint,distance:bigint,start:bigint,end:bigint>>"


def plain_words(text: str) -> np.ndarray:
    """Hashes of the words of a text."""
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \1 ", _MARKS.sub(" ", text))
    return word_hashes(text.encode().translate(_KEEP))


class Walk(NamedTuple):
    """One repeat: salt of the words' bits and the sampled steps in order."""

    salt: np.uint64
    sampled: tuple[int, ...]


def make_walks(repeats: int, steps: int, sampled: int, seed: int = 11) -> list[Walk]:
    rng = np.random.default_rng(seed)
    picks = [tuple(sorted(rng.choice(steps, min(sampled, steps), replace=False).tolist())) for _ in range(repeats)]
    return [Walk(np.uint64(rng.integers(1, 2**63)), p) for p in picks]


def walk_hashes(words: np.ndarray, starts: np.ndarray, walk: Walk, fits=None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the sampled words. ``words`` ends with as many zeros as there are steps.

    ``fits(level, hashes)`` tells which may still match; the others are not walked further.
    """
    bits = _mixed(words ^ walk.salt)
    at, hashes, level = starts.copy(), np.zeros(len(starts), np.uint64), 0
    for step in range(walk.sampled[-1] + 1):
        if step == walk.sampled[level]:
            hashes = _mixed(hashes + words[at] + np.uint64(level))
            if fits is not None:
                good = fits(level, hashes)
                at, starts, hashes = at[good], starts[good], hashes[good]
            level += 1
        if not len(at):
            break
        at += ((bits[at] >> np.uint64(step)) & np.uint64(1)).astype(at.dtype)
    return starts, hashes


def pieces_of(n: int, allowed: int) -> list[tuple[int, int]]:
    """Offset and length of ``allowed`` + 1 pieces of n words."""
    cuts = [n * i // (allowed + 1) for i in range(allowed + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pieces(NamedTuple):
    """Pieces of one length, sorted by hash, and which leading bits the hashes have."""

    hashes: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    filter: np.ndarray


def piece_tables(words: list[np.ndarray], ratio: float) -> dict[int, Pieces]:
    rows: dict[int, list[tuple[int, int]]] = {}
    for number, item in enumerate(words):
        for offset, length in pieces_of(len(item), int(ratio * len(item))):
            rows.setdefault(length, []).append((number, offset))
    joined = np.concatenate(words)
    begins = np.concatenate([[0], np.cumsum([len(w) for w in words])[:-1]])
    tables = {}
    for length, found in sorted(rows.items()):
        item, offset = np.array(found, np.int64).T
        hashes = np.zeros(len(found), np.uint64)
        for level in range(length):
            hashes = _mixed(hashes + joined[begins[item] + offset + level] + np.uint64(level))
        order = np.argsort(hashes, kind="stable")
        bits = np.zeros(1 << _PIECE_BITS, bool)
        bits[(hashes >> np.uint64(64 - _PIECE_BITS)).astype(np.int64)] = True
        tables[length] = Pieces(hashes[order], item[order], offset[order], bits)
    return tables


def _equal_rows(hashes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``hashes`` and of the sorted ``table`` that are equal."""
    low, high = np.searchsorted(table, hashes, "left"), np.searchsorted(table, hashes, "right")
    counts = high - low
    rows = np.repeat(np.arange(len(hashes)), counts)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    return rows, low[rows] + within


class Items:
    """Hash tables of a block of items, built once per task from their words."""

    def __init__(self, ids: list[int | None], words: list[np.ndarray], ratio: float, repeats: int) -> None:
        self.ids, self.words, self.ratio = ids, words, ratio
        self.pieces = piece_tables(words, ratio)
        self.pad = np.zeros(max(STEPS + 1, *self.pieces), np.uint64)
        self.walks = make_walks(repeats, STEPS, SAMPLED)
        self.known = [np.unique(w) for w in words]
        pad = self.pad
        anchors = [sorted({*range(0, len(w) - STEPS + 1, STRIDE), len(w) - STEPS}) if len(w) >= STEPS else [] for w in words]
        joined = np.concatenate([np.concatenate([w, pad]) for w in words])
        begins = np.concatenate([[0], np.cumsum([len(w) + len(pad) for w in words])[:-1]])
        self.item = np.concatenate([np.full(len(a), i, np.int64) for i, a in enumerate(anchors)])
        self.offset = np.concatenate([np.array(a, np.int64) for a in anchors])
        starts = begins[self.item] + self.offset
        self.filters, self.tables = [], []
        for walk in self.walks:
            filters = np.zeros((len(walk.sampled), 1 << _BITS), bool)

            def note(level: int, hashes: np.ndarray, filters=filters) -> np.ndarray:
                filters[level][(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
                return np.ones(len(hashes), bool)

            _, hashes = walk_hashes(joined, starts, walk, note)
            order = np.argsort(hashes, kind="stable")
            self.filters.append(filters)
            self.tables.append((hashes[order], order))

    def piece_places(self, words: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Item numbers, offsets and places of all pieces that stand in ``words``."""
        out, hashes = [], np.zeros(len(starts), np.uint64)
        for level in range(max(self.pieces)):
            hashes = _mixed(hashes + words[starts + level] + np.uint64(level))
            if level + 1 in self.pieces:
                table = self.pieces[level + 1]
                may = np.flatnonzero(table.filter[(hashes >> np.uint64(64 - _PIECE_BITS)).astype(np.int64)])
                rows, entry = _equal_rows(hashes[may], table.hashes)
                out.append((table.item[entry], table.offset[entry], starts[may][rows]))
        return out

    def candidates(self, words: np.ndarray, starts: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Item numbers, where in ``words`` the item would begin and in which document, without repeats."""
        places = self.piece_places(words, starts)
        for walk, filters, (table, order) in zip(self.walks, self.filters, self.tables, strict=True):

            def fits(level: int, hashes: np.ndarray, filters=filters) -> np.ndarray:
                return filters[level][(hashes >> np.uint64(64 - _BITS)).astype(np.int64)]

            found, hashes = walk_hashes(words, starts, walk, fits)
            rows, at = _equal_rows(hashes, table)
            places.append((self.item[order[at]], self.offset[order[at]], found[rows]))
        item, offset, at = (np.concatenate([p[k] for p in places]) for k in range(3))
        # The item may begin before its document, if its first words were cut off.
        return np.unique(np.stack([item, at - offset, np.searchsorted(begin, at, "right") - 1]), axis=1)

    def matches(self, texts: list[np.ndarray]) -> list[list[dict]]:
        """For each document, one entry per item within the allowed distance."""
        out: list[list[dict]] = [[] for _ in texts]
        sizes = np.array([len(t) for t in texts])
        pad = self.pad
        words = np.concatenate([np.concatenate([t, pad]) for t in texts])
        begin = np.concatenate([[0], np.cumsum(sizes + len(pad))[:-1]])
        owner = np.repeat(np.arange(len(texts)), sizes)
        starts = np.arange(sizes.sum()) + owner * len(pad)
        items, at, docs = self.candidates(words, starts, begin)
        pairs: list[tuple[int, int, int]] = []
        stretches: list[np.ndarray] = []
        for number in np.unique(items):
            item, where, doc = self.words[number], at[items == number], docs[items == number]
            n = len(item)
            allowed = int(self.ratio * n)
            low = np.maximum(where - allowed, begin[doc])
            reach = np.minimum(where + n + allowed, begin[doc] + sizes[doc])
            index = np.minimum(low[:, None] + np.arange(n + 2 * allowed)[None, :], len(words) - 1)
            inside = (low[:, None] + np.arange(n + 2 * allowed)[None, :]) < reach[:, None]
            shared = (np.isin(words[index], self.known[number]) & inside).sum(axis=1)
            for j in np.flatnonzero(shared >= n - allowed):
                pairs.append((int(number), int(doc[j]), int(low[j] - begin[doc[j]])))
                stretches.append(words[low[j] : reach[j]])
        limits = np.array([int(self.ratio * len(self.words[number])) for number, _, _ in pairs])
        best: dict[tuple[int, int], tuple] = {}
        found = best_stretches([self.words[number] for number, _, _ in pairs], stretches, limits)
        for (number, d, first), limit, (distance, a, b) in zip(pairs, limits, found, strict=True):
            if distance <= limit:
                entry = (distance, first + a, first + b)
                best[number, d] = min(best.get((number, d), entry), entry)
        for (number, d), (distance, a, b) in best.items():
            out[d].append({"item_id": self.ids[number], "n_words": len(self.words[number]), "distance": distance, "start": a, "end": b})
        return out


def _last_rows(items: np.ndarray, lengths: np.ndarray, stretches: np.ndarray, free: bool) -> np.ndarray:
    """Edit distances of each row's item to the parts of its stretch that end at each place.

    Items, a row each, are padded and sorted by length, longest first. ``free``: the parts may begin anywhere.
    """
    along = np.arange(stretches.shape[1] + 1, dtype=np.int32)
    row = np.zeros((len(items), len(along)), np.int32)
    if not free:
        row += along
    for i in range(items.shape[1]):
        now = int(np.searchsorted(-lengths, -i, "left"))
        old = row[:now]
        new = np.empty_like(old)
        new[:, 0] = i + 1
        np.minimum(old[:, 1:] + 1, old[:, :-1] + (stretches[:now] != items[:now, i, None]), out=new[:, 1:])
        new -= along
        np.minimum.accumulate(new, axis=1, out=new)
        row[:now] = new + along
    return row


def _padded(words: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(words), max(map(len, words))), np.uint64)
    for row, found in zip(out, words, strict=True):
        row[: len(found)] = found
    return out


def _best_of(items: list[np.ndarray], stretches: list[np.ndarray], allowed: np.ndarray) -> list[tuple[int, int, int]]:
    lengths = np.array([len(w) for w in items])
    rows = _last_rows(_padded(items), lengths, _padded(stretches), free=True)
    widths = np.array([len(w) for w in stretches])
    rows[np.arange(rows.shape[1]) > widths[:, None]] = np.iinfo(np.int32).max
    ends = rows.argmin(axis=1)
    least = rows[np.arange(len(rows)), ends]
    begins = np.zeros(len(rows), np.int64)
    near = np.flatnonzero(least <= allowed)
    if len(near):
        back = _last_rows(_padded([items[j][::-1] for j in near]), lengths[near], _padded([stretches[j][: ends[j]][::-1] for j in near]), free=False)
        back[np.arange(back.shape[1]) > ends[near, None]] = np.iinfo(np.int32).max
        begins[near] = ends[near] - back.argmin(axis=1)
    return list(zip(least.tolist(), begins.tolist(), ends.tolist(), strict=True))


def best_stretches(items: list[np.ndarray], stretches: list[np.ndarray], allowed: np.ndarray) -> list[tuple[int, int, int]]:
    """For each item the least edit distance to a part of its stretch, and where that part begins and ends.

    Where the distance is above ``allowed`` the part is not looked for. Pairs of like size are worked on together.
    """
    order = sorted(range(len(items)), key=lambda j: -len(items[j]))
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * len(items)
    while order:
        size = max(1, TABLE_CELLS // (len(items[order[0]]) * 2 + 1))
        batch, order = order[:size], order[size:]
        found = _best_of([items[j] for j in batch], [stretches[j] for j in batch], allowed[batch])
        for j, best in zip(batch, found, strict=True):
            out[j] = best
    return out


_built: dict[tuple, Items] = {}


def _match_column(text: Column, block: list[tuple[int | None, str]], ratio: float, repeats: int, sent) -> Column:
    number = id(block)

    def match(texts: pd.Series) -> pd.Series:
        key = (sent.value[0], number, ratio, repeats)
        if key not in _built:
            _built.clear()
            rows = [(i, plain_words(t)) for i, t in sent.value[1]]
            _built[key] = Items([i for i, _ in rows], [w for _, w in rows], ratio, repeats)
        items, out, chunk, size = _built[key], [], [], 0
        for text in texts:
            chunk.append(plain_words(text or ""))
            size += len(chunk[-1])
            if size > CHUNK_WORDS:
                out += items.matches(chunk)
                chunk, size = [], 0
        if chunk:
            out += items.matches(chunk)
        return pd.Series(out, index=texts.index)

    return F.pandas_udf(match, MATCH)(text)


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> list[list[tuple[int | None, str]]]:
    """Items with words, in lists of at most about ``block_words`` words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text"))
    blocks, size = [[]], 0
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        n = len(plain_words(row["text"]))
        if n:
            if size + n > block_words and blocks[-1]:
                blocks.append([])
                size = 0
            blocks[-1].append((row["item_id"], row["text"]))
            size += n
    return [b for b in blocks if b]


def with_matches(docs: DataFrame, benchmark: DataFrame, ratio: float = RATIO, repeats: int = REPEATS) -> DataFrame:
    """The rows as a column ``row`` and ``matches``: item_id, n_words, distance, start and end word of each item found."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    found = [
        _match_column(text, block, ratio, repeats, spark.sparkContext.broadcast((spark.sparkContext.applicationId, block)))
        for block in item_blocks(benchmark)
    ]
    none = F.array().cast(MATCH)
    return rows.withColumn("matches", F.concat(*found) if found else none)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return with_matches(docs, benchmark).filter(F.size("matches") == 0).select("row.*")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = with_matches(docs, benchmark).select("row.doc_id", F.explode("matches").alias("m"))
    return found.select("doc_id", "m.item_id", "m.n_words", "m.distance", "m.start", "m.end")

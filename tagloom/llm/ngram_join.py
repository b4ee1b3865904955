"""Size-aware heavy-light Jaccard join over word shingles, and the groups it links.

A text is the set of its distinct word n-grams. Texts with equal sets are one set
from the start. Sets up to a boundary are light: all subsets that an overlap
partner could share are enumerated, and two sets that share a subset of a size
large enough for both are linked, no further check needed. Larger sets are heavy:
they are met by scanning inverted lists. A list belongs to a run of the hash range
and holds the sets with the same shingles in it: a partner differs in at most d
shingles, so of more runs some are the same in both. Empty runs make no lists, as most sets
would share them. Lists of single shingles would grow with every passage that many texts share;
these grow less. The pigeonhole also tells how many lists a set shares with any partner: sets that share
fewer with all others together have none and leave before pairs are made. The boundary is where
the subsets of a size would cost more than its lists, by the histogram of set sizes.

The sets of the lists with the same first set (the smallest id) are a group. Groups need no more than one chain of
links, so its sets are first compared with that first set. Sets of one group which are still in different components are
compared with each other, a pair of pieces of the group in each task, by inverted lists of their differences
from the first set, whose overlaps give the exact similarity; only links that join something leave the task.

Before sets move, sketches are compared: a bit per residue of the hashes tells whether an odd number of shingles has it.
Every bit that differs stands for a shingle which one set holds alone, so a pair with too many of them cannot be linked, and
all others are checked exactly. No link between different components is lost.

Defined results: texts are lower-cased in A-Z and cut at ASCII white space; fewer
words than n make one shingle of all of them; null, empty and blank texts have no
shingles and link with nothing. Equal keys with different texts are different rows.
Extra columns are ignored. Shingles, and sets with lists, are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.llm.graph import components
from tagloom.runtime import pin, ship

#: Words whose hashes a Python worker remembers.
CACHE_WORDS = 250_000
#: Upper ends of the size classes of heavy sets grow by this factor.
CLASS_RATIO = 1.5
#: Low bits of a list's key, which hold its size class, and bits of the hash above them.
CLASS_BITS, KEY_BITS = 6, 48
#: Sets of a piece of a group.
PIECE = 512
#: Sets that a task remembers not to list them again.
SEEN_SETS = 1_000_000
#: List keys after which a batch of them is handed on: a batch of texts has thousands of times as many.
BATCH_KEYS = 100_000
#: Size of the bitmap of wanted documents, as a power of 2 in bits (half a megabyte).
BLOOM_BITS = 22
_SCANNED = "key {kind}, text_hash long, set_lo long, set_hi long, n long, nid long, sketch binary, shingles array<long>"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = int(pd.util.hash_array(np.array([word.decode("utf-8", "replace")], dtype=object))[0])
        self[word] = value
        return value


_hashes = _Hashes()


def _mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def word_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()
    missing = list({w for w in words if w not in _hashes})
    if missing:
        if len(_hashes) > CACHE_WORDS:
            _hashes.clear()
            missing = list(set(words))
        values = pd.util.hash_array(np.array([w.decode("utf-8", "replace") for w in missing], dtype=object), categorize=False)
        _hashes.update(zip(missing, values.tolist(), strict=True))
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(n, len(words))
    rolled = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for i in range(width):
        rolled = _mixed(rolled * np.uint64(0x100000001B3) + words[i : len(words) - width + 1 + i] + np.uint64(width))
    return np.unique(rolled)


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def least_overlap(size: int, percent: int) -> int:
    """Shingles that a set of this size shares at least with any partner."""
    return -(-size * percent // 100)


def subset_count(size: int, percent: int) -> int:
    return sum(comb(size, i) for i in range(size - least_overlap(size, percent) + 1))


def size_class(size: int) -> tuple[int, int]:
    """Number and upper end of the class of a heavy set."""
    k, top = 0, 16
    while size > top:
        k, top = k + 1, int(top * CLASS_RATIO)
    return k, top


def runs_of(top: int, percent: int) -> int:
    """Some more than the shingles in which two partners of at most ``top`` shingles may differ."""
    least = 2 * top * (100 - percent) // (100 + percent) + 1
    return least + max(2, least // 8)


def list_keys(shingles: np.ndarray, percent: int) -> list[tuple[np.ndarray, int]]:
    """Keys of the inverted lists that hold a heavy set, for its own class and for the next if a partner
    may be there; each with the number of keys that any partner of that class shares at least."""
    size, out = len(shingles), []
    k, top = size_class(size)
    classes = [(k, top)]
    if size * 100 >= percent * (top + 1):
        classes.append(size_class(top + 1))
    body = _mixed(shingles + np.uint64(0x51ED2701))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(body, dtype=np.uint64)])
    for k, top in classes:
        runs = runs_of(top, percent)
        run = ((shingles >> np.uint64(32)) * np.uint64(runs)) >> np.uint64(32)
        ends = np.searchsorted(run, np.arange(runs + 1, dtype=np.uint64))
        inside = sums[ends[1:]] - sums[ends[:-1]]
        # Partners agree on so many runs at least; if fewer are empty, they agree on a run with shingles.
        agree = runs - (size + min(100 * size // percent, top)) * (100 - percent) // (100 + percent)
        empty = np.diff(ends) == 0
        keep = ~empty if empty.sum() < agree else np.ones(runs, bool)
        hashes = _mixed(inside + np.arange(runs, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k + 1))[keep]
        keys = np.unique(((hashes >> np.uint64(64 - KEY_BITS)) << np.uint64(CLASS_BITS)) | np.uint64(k))
        # A partner may have left out its empty runs even if this set has not; equal keys of two runs count once.
        out.append((keys, max(1, int(agree - empty.sum()) - (len(hashes) - len(keys)))))
    return out


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """For each residue of the mixed hashes a bit: whether an odd number of shingles has it. About a bit a shingle."""
    bits = max(64, 1 << (len(shingles) - 1).bit_length())
    at = _mixed(shingles + np.uint64(0x7F4A7C15)) & np.uint64(bits - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").view(np.uint64)


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """The sketches of the same sets for fewer residues."""
    while sketches.shape[-1] > words:
        half = sketches.shape[-1] // 2
        sketches = sketches[..., :half] ^ sketches[..., half:]
    return sketches


def least_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At least so many shingles are in only one of the sets, for sketches in the last dimension."""
    words = min(a.shape[-1], b.shape[-1])
    return np.bitwise_count(folded(a, words) ^ folded(b, words)).sum(axis=-1, dtype=np.int64)


def subset_keys(shingles: np.ndarray, percent: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Keys and sizes of all subsets that a light set may share with a partner."""
    size = len(shingles)
    body = _mixed(shingles + np.uint64(0x2545F491))
    total = body.sum(dtype=np.uint64)
    keys, sizes = [], []
    for gone in range(size - least_overlap(size, percent) + 1):
        left = size - gone
        if gone:
            picks = np.array(list(combinations(range(size), gone)))
            sums = total - body[picks].sum(axis=1, dtype=np.uint64)
        else:
            sums = np.array([total], dtype=np.uint64)
        keys.append(_mixed(sums + np.uint64(left)))
        sizes.append(np.full(len(sums), left, dtype=np.int64))
    return keys, sizes


def _as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _set_id(low: int, high: int, size: int) -> int:
    parts = np.array([low, high], dtype=np.int64).view(np.uint64)
    return int(signed(_mixed(parts[:1] * np.uint64(0x100000001B3) + _mixed(parts[1:] + np.uint64(size))))[0])


def _identity(found: np.ndarray) -> tuple[int, int]:
    if not len(found):
        return 0, 0
    return int(signed(found.sum(dtype=np.uint64, keepdims=True))[0]), int(signed(_mixed(found).sum(dtype=np.uint64, keepdims=True))[0])


def _scan(n: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high, sizes, ids, sketches, small = [], [], [], [], [], []
            for text in _as_bytes(batch.column("text")):
                found = shingle_set(text, n) if text else np.zeros(0, np.uint64)
                identity = _identity(found)
                low.append(identity[0])
                high.append(identity[1])
                sizes.append(len(found))
                ids.append(_set_id(*identity, len(found)))
                sketches.append(sketch_of(found).tobytes() if len(found) else None)
                small.append(signed(found) if 0 < len(found) <= LIGHT_MOST else None)
            columns = [batch.column("key"), batch.column("text_hash"), *[pa.array(c, pa.int64()) for c in (low, high, sizes, ids)]]
            columns += [pa.array(sketches, pa.binary()), pa.array(small, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "text_hash", "set_lo", "set_hi", "n", "nid", "sketch", "shingles"])

    return scan


def _scan_lists(n: int, percent: int, least: int):
    """List keys of the sets of ``least`` shingles or more; a task gives those of equal sets once."""

    def handed(keys: list[np.ndarray], ids: list[int], needs: list[int]) -> pa.RecordBatch:
        counts = [len(k) for k in keys]
        columns = [signed(np.concatenate(keys)), np.repeat(np.array(ids, np.int64), counts), np.repeat(np.array(needs, np.int32), counts)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "nid", "need"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, ids, needs, held = [], [], [], 0
            for text in _as_bytes(batch.column("text")):
                found = shingle_set(text, n) if text else np.zeros(0, np.uint64)
                if len(found) < least:
                    continue
                nid = _set_id(*_identity(found), len(found))
                if nid in seen:
                    continue
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(nid)
                for own, need in list_keys(found, percent):
                    keys.append(own)
                    ids.append(nid)
                    needs.append(need)
                    held += len(own)
                if held >= BATCH_KEYS:
                    yield handed(keys, ids, needs)
                    keys, ids, needs, held = [], [], [], 0
            if keys:
                yield handed(keys, ids, needs)

    return scan


#: Sizes between which the boundary of light sets may lie.
LIGHT_LEAST, LIGHT_MOST = 8, 39


def scan_sets(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """key, text_hash, identity of the set, its size, id and sketch; the shingles of small sets."""
    ship(docs.sparkSession)
    body = F.col(text).cast("string")
    slim = docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
    schema = _SCANNED.format(kind=slim.schema["key"].dataType.simpleString())
    return slim.mapInArrow(_scan(n), schema)


def light_boundary(sets: DataFrame, percent: int) -> int:
    """The largest size whose subsets cost less than its lists.

    A list entry costs one row, and one comparison for every further set in the
    list; the mean length of lists is taken from the histogram of sizes, at one
    chance in 2^8 that two sets of a class agree on a run.
    """
    sizes = {r["n"]: r["sets"] for r in sets.filter(F.col("n").between(1, LIGHT_MOST)).groupBy("n").agg(F.count(F.lit(1)).alias("sets")).collect()}
    best, boundary, cost = None, LIGHT_LEAST, 0
    for x in range(LIGHT_LEAST, LIGHT_MOST + 1):
        cost = sum(k * subset_count(s, percent) for s, k in sizes.items() if s <= x)
        for s, k in sizes.items():
            if s > x:
                top = size_class(s)[1]
                peers = sum(v for t, v in sizes.items() if size_class(t)[1] == top)
                cost += k * runs_of(top, percent) * (1 + peers / 256)
        if best is None or cost < best:
            best, boundary = cost, x
    return boundary


def _light_edges(sets: DataFrame, boundary: int, percent: int) -> DataFrame:
    """Links of light sets: every holder of a subset with the smallest one."""

    def enumerate_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, keys, lefts = [], [], [], []
            for node, shingles in zip(batch.column("nid").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                found = np.array(shingles, dtype=np.int64).view(np.uint64)
                for key, left in zip(*subset_keys(found, percent), strict=True):
                    ids.append(np.full(len(key), node, dtype=np.int64))
                    sizes.append(np.full(len(key), len(found), dtype=np.int64))
                    keys.append(signed(key))
                    lefts.append(left)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (ids, sizes, keys, lefts)], names=["nid", "n", "key", "left"])

    light = sets.filter(F.col("n").between(1, boundary)).select("nid", "shingles")
    rows = light.mapInArrow(enumerate_, "nid long, n long, key long, left long")
    first = rows.groupBy("key", "left").agg(F.min(F.struct("n", "nid")).alias("first"), F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    pairs = rows.join(first, ["key", "left"]).filter(F.col("nid") != F.col("first.nid"))
    linked = 100 * F.col("left") >= percent * (F.col("n") + F.col("first.n") - F.col("left"))
    return pairs.filter(linked).select(F.col("nid").alias("a"), F.col("first.nid").alias("b")).distinct()


def _wanted_bits(owners: DataFrame):
    """A bitmap of fixed size with a bit for each wanted document's hash.

    It only saves moving texts that no list asks for; a full one saves nothing and changes nothing.
    """
    word = F.shiftrightunsigned("kh", 64 - BLOOM_BITS + 6)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(kh, {64 - BLOOM_BITS}) & 63 as int))")
    bits = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)
    # As many rows as the bitmap has words at most, in one job; an iterator would run a job for each partition.
    found = owners.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return owners.sparkSession.sparkContext.broadcast(bits)


def _sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """nid and sorted shingles (binary) of the wanted nodes, from the text of one document of each."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t or b"", n).tobytes() for t in _as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("nid"), pa.array(found, pa.binary())], names=["nid", "found"])

    owners = nodes.join(wanted, "nid", "left_semi").select("nid", F.col("owner.key").alias("k2"), F.col("owner.text_hash").alias("h"))
    owners = pin(owners.withColumn("kh", F.xxhash64("k2", "h")))
    sent = _wanted_bits(owners)

    def asked_for(hashes: pd.Series) -> pd.Series:
        at = hashes.to_numpy().view(np.uint64) >> np.uint64(64 - BLOOM_BITS)
        return pd.Series((sent.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1, index=hashes.index)

    body = F.col(text).cast("string")
    slim = docs.select(F.col(key).alias("k"), F.xxhash64(body).alias("h"), body.alias("text"))
    slim = slim.withColumn("kh", F.xxhash64("k", "h")).filter(F.pandas_udf(asked_for, "boolean")("kh"))
    # Rows equal in key and text give one set several times. Compared before the window and judged after it, the keys are no
    # part of the join, so the rows are in one partition by kh and h already and texts move once.
    rows = slim.join(owners, ["kh", "h"]).withColumn("same", F.col("k").eqNullSafe(F.col("k2")))
    nth = F.row_number().over(Window.partitionBy("kh", "h").orderBy(F.desc("same"), "nid"))
    rows = rows.withColumn("nth", nth).filter("same and nth = 1").select("nid", "text")
    return rows.mapInArrow(encode, "nid long, found binary")


def _overlap(column_a: str, column_b: str, percent: int) -> Column:
    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out, memo = [], {}
        for x, y in zip(a, b, strict=True):
            left = memo.get(x)
            if left is None:
                memo.clear()
                left = memo[x] = np.frombuffer(x, np.uint64)
            right = np.frombuffer(y, np.uint64)
            at = np.searchsorted(left, right)
            at[at == len(left)] = 0
            shared = int((left[at] == right).sum())
            out.append(100 * shared >= percent * (len(left) + len(right) - shared))
        return pd.Series(out, dtype=bool)

    return linked(column_a, column_b)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes whose sets are similar enough."""
    left = sets.select(F.col("nid").alias("a"), F.col("found").alias("found_a"))
    right = sets.select(F.col("nid").alias("b"), F.col("found").alias("found_b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.filter(_overlap("found_a", "found_b", percent)).select("a", "b")


def _members(docs: DataFrame, text: str, n: int, percent: int, least: int) -> DataFrame:
    """nid, first: the sets that share a list with others and the first set of that list, which belongs to itself too.

    Sets that share fewer lists of a size class than any partner would have with them are left out of these lists.
    """
    by_key, by_set = Window.partitionBy("key"), Window.partitionBy("nid", "kind")
    lists = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_scan_lists(n, percent, least), "key long, nid long, need int")
    ends = {"first": F.min("nid").over(by_key), "last": F.max("nid").over(by_key)}
    # Copies of a set in several tasks are no company.
    shared = lists.withColumns(ends).filter("first < last").select("key", "nid", "need").dropDuplicates(["key", "nid"])
    kind = F.col("key").bitwiseAND(F.lit((1 << CLASS_BITS) - 1))
    enough = shared.withColumn("kind", kind).withColumn("held", F.count(F.lit(1)).over(by_set)).filter("held >= need").select("key", "nid")
    return enough.withColumns(ends).filter("first < last").select("nid", "first").distinct()


def _may_link(sketch_a: str, sketch_b: str, n_a: str, n_b: str, percent: int) -> Column:
    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        apart = [int(least_apart(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))) for x, y in zip(a, b, strict=True)]
        return (100 + percent) * pd.Series(apart, index=a.index, dtype="int64") <= (na + nb) * (100 - percent)

    fit = F.least(n_a, n_b) * 100 >= percent * F.greatest(n_a, n_b)
    return fit & near(sketch_a, sketch_b, n_a, n_b)


def _stars(members: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a set and the first of its group whose sketches allow a link."""
    left = facts.select(F.col("nid").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    right = facts.select(F.col("nid").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    pairs = members.filter("nid <> first").select(F.col("nid").alias("a"), F.col("first").alias("b"))
    return pairs.join(left, "a").join(right, "b").filter(_may_link("sketch_a", "sketch_b", "n_a", "n_b", percent)).select("a", "b")


def _cells(members: DataFrame, *columns: str) -> DataFrame:
    """Members of groups (nid, first) dealt to cells (first, i, j): a group is cut into pieces of about ``PIECE`` sets, and
    every pair of pieces is a cell of its own, so no task holds a large group."""
    sizes = members.groupBy("first").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"))
    cut = members.join(sizes, "first").withColumn("own", F.pmod(F.xxhash64("nid"), F.col("pieces").cast("long")).cast("int"))
    every = F.sequence(F.lit(0), F.col("pieces") - 1)
    # Cell (i, j), i <= j, holds piece i on the left and piece j on the right; where they are one, it is there once.
    cells = F.transform(every, lambda k: F.struct(
        F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j"), (F.col("own") <= k).alias("left")))
    return cut.withColumn("cell", F.explode(cells)).select("first", "cell.i", "cell.j", "cell.left", "nid", *columns)


def _with_company(left: pa.Table, right: pa.Table | None, percent: int) -> set[int]:
    """Sets of two pieces (or of one) of a group whose sketches allow a link with a set of another root."""
    other = left if right is None else right
    ids, sizes, roots = (other.column(c).to_numpy() for c in ("nid", "n", "root"))
    sketches = [np.frombuffer(s, np.uint64) for s in other.column("sketch").to_pylist()]
    words = np.array([len(s) for s in sketches], dtype=np.int64)
    blocks = [(at, np.stack([sketches[i] for i in at])) for at in (np.flatnonzero(words == w) for w in np.unique(words))]
    found: set[int] = set()
    rows = zip(*[left.column(c).to_pylist() for c in ("nid", "n", "root", "sketch")], strict=True)
    for nid, n, root, sketch in rows:
        mine = np.frombuffer(sketch, np.uint64)
        for at, block in blocks:
            fit = (np.minimum(sizes[at], n) * 100 >= percent * np.maximum(sizes[at], n)) & (roots[at] != root)
            if not fit.any():
                continue
            near = at[fit][(100 + percent) * least_apart(mine, block[fit]) <= (n + sizes[at][fit]) * (100 - percent)]
            if len(near):
                found.add(nid)
                found.update(ids[near].tolist())
    return found


def _undecided(members: DataFrame, facts: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """nid, first, root, n of the members that may be linked with a member of their group in another component."""

    def meet(cell: pa.Table) -> pa.Table:
        found = sorted(_with_company(*_sides(cell), percent))
        return pa.table({"first": pa.array([cell.column("first")[0].as_py()] * len(found), pa.int64()), "nid": pa.array(found, pa.int64())})

    by_group = Window.partitionBy("first")
    placed = members.join(groups.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    ends = placed.withColumns({"low": F.min("root").over(by_group), "high": F.max("root").over(by_group)})
    open_ = pin(ends.filter("low < high").select("nid", "first", "root"))
    dealt = _cells(open_.join(facts, "nid"), "root", "n", "sketch")
    near = dealt.groupBy("first", "i", "j").applyInArrow(meet, "first long, nid long").distinct()
    return open_.join(near, ["first", "nid"]).join(facts.select("nid", "n"), "nid").select("nid", "first", "root", "n")


def _near_pairs(left: pa.Table, right: pa.Table | None, percent: int) -> list[tuple[int, int]]:
    """Links between sets of two pieces (or of one) of a group, as many as join different roots.

    Sets are given by their differences from the group's first set. Two sets differ in what only one of these
    holds, so overlaps of differences give exact similarities. The inverted lists of the right piece are
    bitsets, which a set of the left piece adds up.
    """
    other = left if right is None else right
    sizes, roots = other.column("n").to_numpy(), other.column("root").to_pylist()
    ids, lists = other.column("nid").to_pylist(), [np.frombuffer(d, np.uint64) for d in other.column("diff").to_pylist()]
    lengths = np.array([len(d) for d in lists], dtype=np.int64)
    held, element = np.unique(np.concatenate(lists), return_inverse=True)
    owner = np.repeat(np.arange(len(lists)), lengths)
    flags = np.zeros((len(held) + 1, -(-len(lists) // 8)), dtype=np.uint8)
    np.bitwise_or.at(flags, (element, owner >> 3), (1 << (owner & 7)).astype(np.uint8))
    parent: dict[int, int] = {}

    def find(root: int) -> int:
        while parent.get(root, root) != root:
            root = parent[root]
        return root

    found = []
    rows = zip(left.column("nid").to_pylist(), left.column("root").to_pylist(), left.column("n").to_pylist(), left.column("diff").to_pylist(), strict=True)
    for at, (nid, root, n, diff) in enumerate(rows):
        mine = np.frombuffer(diff, np.uint64)
        places = np.searchsorted(held, mine)
        places = places[(places < len(held)) & (held[np.minimum(places, len(held) - 1)] == mine)] if len(held) else places[:0]
        common = np.zeros(len(lists), dtype=np.int64)
        for low in range(0, len(places), 4096):
            bits = np.unpackbits(flags[places[low : low + 4096]], axis=1, bitorder="little", count=len(lists))
            common += bits.sum(axis=0, dtype=np.int64)
        apart = len(mine) + lengths - 2 * common
        good = (100 + percent) * apart <= (n + sizes) * (100 - percent)
        if right is None:
            good[: at + 1] = False
        for j in np.flatnonzero(good).tolist():
            low, high = find(root), find(roots[j])
            if low != high:
                parent[high] = low
                found.append((nid, ids[j]))
    return found


def _links_of_undecided(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between undecided members of a group.

    The differences from the group's first set are short where sets are alike. No pairs of sets are made
    but the links that a cell needs to join what is linked in it.
    """

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("found").to_pylist(), batch.column("found_first").to_pylist(), strict=True)
            diffs = [np.setxor1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), True).tobytes() for a, b in rows]
            columns = [*[batch.column(c) for c in ("nid", "first", "root", "n")], pa.array(diffs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["nid", "first", "root", "n", "diff"])

    def meet(cell: pa.Table) -> pa.Table:
        pairs = _near_pairs(*_sides(cell), percent)
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    both = open_.join(sets, "nid").join(sets.select(F.col("nid").alias("first"), F.col("found").alias("found_first")), "first")
    diffs = both.select("nid", "first", "root", "n", "found", "found_first").mapInArrow(differ, "nid long, first long, root long, n long, diff binary")
    dealt = _cells(diffs, "root", "n", "diff")
    return dealt.groupBy("first", "i", "j").applyInArrow(meet, "a long, b long").distinct()


def _sides(cell: pa.Table) -> tuple[pa.Table, pa.Table | None]:
    """The left and the right piece of a cell; None on the right if they are one."""
    left = cell.filter(cell.column("left"))
    return left, (None if left.num_rows == cell.num_rows else cell.filter(pc.invert(cell.column("left"))))


def link_documents(docs: DataFrame, n: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text_hash, n_shingles, set_id, root and component_id (smallest key reachable) of every row."""
    same_set = ["set_lo", "set_hi", "n"]
    owner = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "text_hash")).alias("owner")
    firsts = [F.first(c).alias(c) for c in ("nid", "sketch", "shingles")]
    rows = pin(scan_sets(docs, key, text, n))
    nodes = pin(rows.filter("n > 0").groupBy(*same_set).agg(owner, *firsts))
    boundary = light_boundary(nodes, percent)
    edges = pin(_light_edges(nodes, boundary, percent))

    # A partner of a heavy set may be light itself, but not smaller than this.
    least = -(-percent * (boundary + 1) // 100)
    facts = nodes.select("nid", "n", "sketch")
    members = pin(_members(docs, text, n, percent, least))
    stars = pin(_stars(members, facts, percent))
    sets = pin(_sets_of(docs, nodes, stars.select(F.explode(F.array("a", "b")).alias("nid")).distinct(), key, text, n))
    edges = pin(edges.unionByName(_verified(stars, sets, percent)))

    groups = components(edges)
    open_ = pin(_undecided(members, facts, groups, percent))
    if not open_.isEmpty():
        sets = pin(_sets_of(docs, nodes, open_.select(F.explode(F.array("nid", "first")).alias("nid")).distinct(), key, text, n))
        more = pin(_links_of_undecided(open_, sets, percent))
        if not more.isEmpty():
            groups = components(edges.unionByName(more))

    found = nodes.select(*same_set, "nid", "owner").join(groups.withColumnRenamed("node", "nid"), "nid", "left")
    found = found.withColumn("root", F.coalesce("root", "nid"))
    least = found.groupBy("root").agg(F.min("owner").alias("least"))
    named = found.join(least, "root").select(*[F.col(c).alias(f"s_{c}") for c in same_set], F.col("nid").alias("set_id"), "root", "least")
    rows = rows.select("key", "text_hash", *same_set)
    same = [F.col(c) == F.col(f"s_{c}") for c in same_set]
    joined = rows.join(named, same, "left")
    component = F.when(F.col("n") > 0, F.col("least.key")).otherwise(F.col("key"))
    return joined.select(
        F.col("key").alias(key), "text_hash", F.col("n").alias("n_shingles"), "set_id", "root", component.alias("component_id"),
        (F.col("least.text_hash") == F.col("text_hash")).alias("is_least_text"),
    )


def keep_one(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """One row of each group: smallest doc_id, then smallest text hash. Rows without shingles all stay."""
    linked = link_documents(docs, n, percent)
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("is_least_text")
    winners = linked.filter((F.col("n_shingles") == 0) | first).select(F.col("doc_id").alias("k2"), F.col("text_hash").alias("h"), "n_shingles").distinct()
    winners = winners.withColumn("kh", F.xxhash64("k2", "h"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("k"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    kept = rows.withColumn("kh", F.xxhash64("k", "h")).join(winners, ["kh", "h"]).withColumn("same", F.col("k").eqNullSafe(F.col("k2")))
    # As in _sets_of, rows equal in key and text are in one partition by kh and h already, so texts move once.
    nth = F.row_number().over(Window.partitionBy("kh", "h", "k").orderBy(F.desc("same"), "n_shingles"))
    return kept.withColumn("nth", nth).filter(F.col("same") & ((F.col("nth") == 1) | (F.col("n_shingles") == 0))).select("row.*")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return link_documents(docs).select("doc_id", "n_shingles", "component_id")

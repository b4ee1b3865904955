"""Exact deduplication by composable polynomial fingerprints and chunkwise comparison.

A text is its UTF-8 bytes with every run of ASCII white space as one space. The
fingerprint of bytes c0, c1, ... is the sum of c_i * base^i modulo a prime, for two
primes, with the length. Fingerprints of neighbouring chunks combine by shifting the
right one by base^(length of the left one); where white space touches on both sides of
the cut, the right chunk first loses its leading space. So chunks may be cut at any
byte and hashed at once: those of a batch side by side in numpy, those of a text
longer than ``huge`` bytes as rows of their own over the whole cluster.

Equal fingerprints only make rows candidates. The texts of candidates, and no others,
are cut into chunk rows which meet the chunks of the group's representative, the row with
the smallest id, in a sort-merge join: one chunk of it is held at a time. A large group
is dealt to a task for every ``GROUP`` of its rows. Rows that differ from their representative
are fingerprinted anew by other bases and compared again, until none is left.

Defined results: a null text is empty, and equal to other empty texts; a null id is larger
than all others; repeated rows (one id, one text) are rows of one group, of which one is
kept; of rows with equal smallest ids one is kept. Rows with the same id, fingerprint
and SHA-256 count as repeats without a comparison. Extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.runtime import counted, lookup_join, pin, ship

#: Two primes below 2^31, so that a byte times a power, summed over a chunk, fits 64 bits.
PRIMES = (2_147_483_629, 2_147_483_587)
#: Bytes of a chunk.
CHUNK = 1 << 16
#: Bytes from which the chunks of a text are dealt to all tasks.
HUGE = 16 << 20
#: Rows of a group that meet one copy of its representative, and copies at most. Rows stream past
#: their copy, so beyond that a task has more rows, not more memory.
GROUP, MAX_DEALS = 512, 4096
#: Bytes of texts that a task holds as numpy arrays at a time.
SLICE = 2 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def base_of(round_: int, prime: int) -> int:
    """The base of a round, from a hash of its number."""
    digest = hashlib.sha256(f"{round_}:{prime}".encode()).digest()
    return 256 + int.from_bytes(digest[:8], "big") % (prime - 512) if prime > 1024 else 2 + digest[0] % (prime - 2)


class Part(NamedTuple):
    """Fingerprint of a stretch of normalised text: a value and a shift (base^length) per prime, and its edges."""

    values: tuple[int, ...]
    shifts: tuple[int, ...]
    length: int
    opens: bool  # with a space
    closes: bool


class Fingerprints:
    """Fingerprints of one round; ``primes`` are smaller in tests, so that fingerprints collide."""

    def __init__(self, round_: int = 0, primes: tuple[int, ...] = PRIMES):
        self.primes = primes
        self.bases = tuple(base_of(round_, p) for p in primes)
        self.inverses = tuple(pow(b, -1, p) for b, p in zip(self.bases, primes, strict=True))
        self.powers = [self._powers(b, p) for b, p in zip(self.bases, primes, strict=True)]

    @staticmethod
    def _powers(base: int, prime: int) -> np.ndarray:
        """base^0 ... base^CHUNK by doubling."""
        out, n = np.ones(CHUNK + 1, dtype=np.uint64), 1
        while n <= CHUNK:
            m = min(n, CHUNK + 1 - n)
            out[n : n + m] = out[:m] * np.uint64(pow(base, n, prime)) % np.uint64(prime)
            n += m
        return out

    def empty(self) -> Part:
        return Part((0,) * len(self.primes), (1,) * len(self.primes), 0, False, False)

    def join(self, a: Part, b: Part) -> Part:
        """The stretch ``a`` followed by ``b``; associative."""
        if not a.length or not b.length:
            return a if a.length else b
        values, shifts, length = b.values, b.shifts, b.length
        if a.closes and b.opens:
            values = tuple((v - 32) * i % p for v, i, p in zip(values, self.inverses, self.primes, strict=True))
            shifts = tuple(s * i % p for s, i, p in zip(shifts, self.inverses, self.primes, strict=True))
            length -= 1
            if not length:
                return a
        return Part(
            tuple((v + s * w) % p for v, s, w, p in zip(a.values, a.shifts, values, self.primes, strict=True)),
            tuple(s * t % p for s, t, p in zip(a.shifts, shifts, self.primes, strict=True)),
            a.length + length, a.opens, b.closes,
        )

    def fold(self, parts: list[Part]) -> Part:
        whole = self.empty()
        for part in parts:
            whole = self.join(whole, part)
        return whole

    def key(self, part: Part) -> str:
        return ":".join(f"{v:x}" for v in (*part.values, part.length))

    def chunks(self, data: np.ndarray, bounds: np.ndarray) -> tuple[list[list[int]], np.ndarray]:
        """Values per prime and chunk of normalised texts; the chunks are the runs of ``CHUNK`` bytes of each."""
        lengths = np.diff(bounds)
        counts = -(-lengths // CHUNK)
        first = np.repeat(np.cumsum(counts) - counts, counts)
        starts = np.repeat(bounds[:-1], counts) + (np.arange(counts.sum()) - first) * CHUNK
        if not len(starts):
            return [[] for _ in self.primes], starts
        ends = np.append(starts[1:], bounds[-1])
        place = np.arange(bounds[-1] - starts[0]) - np.repeat(starts - starts[0], ends - starts)
        wide = data[starts[0] :].astype(np.uint64)
        sums = [np.add.reduceat(wide * powers[place], starts - starts[0]) for powers in self.powers]
        return [(s % np.uint64(p)).tolist() for s, p in zip(sums, self.primes, strict=True)], starts

    def texts(self, data: np.ndarray, bounds: np.ndarray) -> list[Part]:
        """Fingerprints of normalised texts, their chunks hashed side by side and joined."""
        values, starts = self.chunks(data, bounds)
        per_text = np.searchsorted(starts, bounds)
        edges, found = bounds.tolist(), []
        for i, (low, high) in enumerate(zip(per_text[:-1].tolist(), per_text[1:].tolist(), strict=True)):
            start, end = edges[i], edges[i + 1]
            if start == end:
                found.append(self.empty())
                continue
            opens, closes = bool(data[start] == 32), bool(data[end - 1] == 32)
            # Normalised spaces never meet at the cuts inside a text, so these parts just add up.
            total, shifts = [v[low] for v in values], [int(p[min(end - start, CHUNK)]) for p in self.powers]
            for k in range(low + 1, high):
                size = min(end - start - (k - low) * CHUNK, CHUNK)
                total = [(t + s * v[k]) % p for t, s, v, p in zip(total, shifts, values, self.primes, strict=True)]
                shifts = [s * int(w[size]) % p for s, w, p in zip(shifts, self.powers, self.primes, strict=True)]
            found.append(Part(tuple(total), tuple(shifts), end - start, opens, closes))
        return found


def normalise(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ASCII white space as one space, in texts laid end to end, and the new bounds."""
    space = _SPACE[data]
    again = np.zeros(len(data), dtype=bool)
    again[1:] = space[1:] & space[:-1]
    again[bounds[:-1][bounds[:-1] < len(data)]] = False
    kept = np.concatenate([[0], np.cumsum(~again)])
    out = np.where(space, np.uint8(32), data)[~again]
    return out, kept[bounds]


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of some ``SLICE`` bytes: first and last row, bytes and bounds after normalising."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    values = column.buffers()[2]
    data = np.frombuffer(values, dtype=np.uint8) if values else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE, "right")) - 1)
        yield low, high, *normalise(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        low = high


def _fingerprint_rows(printer: Callable[[], Fingerprints]) -> Callable:
    """Batches of (id, key, text) to (id, key, print, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = printer()
        for batch in batches:
            keys, digests = [], []
            for _, _, data, bounds in _slices(batch.column("text")):
                keys += map(prints.key, prints.texts(data, bounds))
                view, edges = memoryview(data), bounds.tolist()
                digests += [hashlib.sha256(view[s:e]).hexdigest() for s, e in zip(edges[:-1], edges[1:], strict=True)]
            columns = [batch.column("id"), batch.column("key"), pa.array(keys, pa.string()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "print", "digest"])

    return run


def _chunk_parts(printer: Callable[[], Fingerprints]) -> Callable:
    """Batches of (id, key, digest, raw, at, chunk), chunks of huge texts as they were read, to their parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = printer()
        for batch in batches:
            parts = [p for _, _, data, bounds in _slices(batch.column("chunk")) for p in prints.texts(data, bounds)]
            columns = [batch.column(c) for c in ("id", "key", "digest", "raw", "at")]
            columns += [pa.array([list(getattr(p, f)) for p in parts], pa.list_(pa.int64())) for f in ("values", "shifts")]
            columns += [pa.array([p.length for p in parts], pa.int64())]
            columns += [pa.array([getattr(p, f) for p in parts], pa.bool_()) for f in ("opens", "closes")]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "digest", "raw", "at", *Part._fields])

    return run


def _joined_parts(printer: Callable[[], Fingerprints]) -> Callable:
    """Batches of (id, key, digest, raw, parts) to (id, key, print, digest, raw): the parts of a text joined in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = printer()
        for batch in batches:
            keys = []
            for parts in batch.column("parts").to_pylist():
                ordered = sorted(parts, key=lambda p: p["at"])
                whole = [Part(tuple(p["values"]), tuple(p["shifts"]), p["length"], p["opens"], p["closes"]) for p in ordered]
                keys.append(prints.key(prints.fold(whole)))
            columns = [batch.column("id"), batch.column("key"), pa.array(keys, pa.string()), batch.column("digest"), batch.column("raw")]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "print", "digest", "raw"])

    return run


def _printer(round_: int, primes: tuple[int, ...]) -> Callable[[], Fingerprints]:
    return lambda: Fingerprints(round_, primes)


def _normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")


def fingerprint(texts: DataFrame, round_: int = 0, primes: tuple[int, ...] = PRIMES, huge: int = HUGE) -> DataFrame:
    """id, key, print, digest, n: rows of ``texts`` (id, key, text), repeats of one row counted; pinned.

    Texts of more than ``huge`` bytes are cut into chunk rows, which all tasks hash; their parts are
    some hundred bytes each and meet again by text. SHA-256 cannot be combined, so it stays one pass.
    """
    kind = texts.schema["id"].dataType.simpleString()
    printer, shape = _printer(round_, primes), f"id {kind}, key string, print string, digest string"
    size = F.octet_length("text")
    whole = texts.filter(size <= huge).mapInArrow(_fingerprint_rows(printer), shape)
    data, starts = F.col("text").cast("binary"), F.sequence(F.lit(0), F.octet_length("text") - 1, F.lit(CHUNK))
    # A text as it was read has a digest of its own: other white space, other chunks.
    digests = [F.sha2(_normalised(F.col("text")), 256).alias("digest"), F.sha2("text", 256).alias("raw")]
    large = texts.filter(size > huge).select("*", *digests)
    cut = large.select("id", "key", "digest", "raw", "text", F.explode(starts).alias("at"))
    chunks = cut.select("id", "key", "digest", "raw", "at", F.substring(data, F.col("at") + 1, F.lit(CHUNK)).alias("chunk"))
    dealt = chunks.repartition(F.xxhash64("key", "raw", "at"))
    fields = f"id {kind}, key string, digest string, raw string, at int, values array<long>, shifts array<long>, length long, opens boolean, closes boolean"
    parts = dealt.mapInArrow(_chunk_parts(printer), fields).dropDuplicates(["key", "raw", "at"])
    listed = parts.groupBy("id", "key", "digest", "raw").agg(F.collect_list(F.struct("at", *Part._fields)).alias("parts"))
    # Repeats of one huge row have given one list; they are counted where they were read.
    times = large.groupBy("key", "raw").agg(F.count(F.lit(1)).alias("n"))
    joined = listed.mapInArrow(_joined_parts(printer), f"{shape}, raw string").join(times, ["key", "raw"])
    both = whole.withColumn("n", F.lit(1).cast("long")).unionByName(joined.drop("raw"))
    return pin(both.groupBy("id", "key", "print", "digest").agg(F.sum("n").alias("n")))


def _groups(rows: DataFrame) -> DataFrame:
    """print, distinct rows, size and representative of every group of several distinct rows."""
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "key", "digest")).alias("rep")
    groups = rows.groupBy("print").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("size"), first)
    return groups.filter("rows > 1").select("print", "rows", "size", "rep.id", "rep.key", "rep.digest")


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of candidates with their texts to chunk rows of the normalised texts."""
    names = ["print", "key", "digest", "deal", "lead"]
    schema = pa.schema([("print", pa.string()), ("key", pa.string()), ("digest", pa.string()), ("deal", pa.int32()),
                        ("lead", pa.int32()), ("at", pa.int32()), ("chunk", pa.binary())])
    for batch in batches:
        rows = list(zip(*(batch.column(n).to_pylist() for n in names), strict=True))
        for low, _, data, bounds in _slices(batch.column("text")):
            edges, found = bounds.tolist(), []
            for i, (start, end) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if hashlib.sha256(memoryview(data[start:end])).hexdigest() != rows[low + i][2]:
                    continue  # another text of the same id
                for at in range(start, max(end, start + 1), CHUNK):
                    found.append((*rows[low + i], (at - start) // CHUNK, data[at : min(at + CHUNK, end)].tobytes()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)


def differing(texts: DataFrame, rows: DataFrame, groups: DataFrame) -> DataFrame:
    """key, digest of the rows whose text is not that of their group's representative.

    Every row belongs to a deal of its group; the representative's chunks are copied to all deals.
    """
    found = lookup_join(rows, groups.select("print", "rows", F.struct("key", "digest").alias("rep")), "print", ["key", "digest"], "inner", **counted(groups, "print"))
    deals = F.least(F.ceil(F.col("rows") / GROUP), F.lit(MAX_DEALS)).cast("int")
    lead = F.struct("key", "digest") == F.col("rep")
    deal = F.pmod(F.xxhash64("digest", "key"), deals.cast("long")).cast("int")
    # ``lead``: copies of a representative's chunks, 0 for the other rows.
    wanted = pin(found.select("print", "key", "digest", deal.alias("deal"), F.when(lead, deals).otherwise(0).alias("lead")))
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("key") + F.octet_length("print") + 80), F.lit(0)).alias("b")).first()
    chosen = lookup_join(texts, wanted, "key", ["text"], "inner", size.n, size.b)
    schema = "print string, key string, digest string, deal int, lead int, at int, chunk binary"
    chunks = chosen.select("print", "key", "digest", "deal", "lead", "text").mapInArrow(_chunk_rows, schema)
    # One shuffle: the representative's chunks go to every deal, the others to their own.
    every = F.when(F.col("lead") > 0, F.sequence(F.lit(0), F.col("lead") - 1)).otherwise(F.array("deal"))
    dealt = chunks.withColumn("deal", F.explode(every))
    leads = dealt.filter("lead > 0").dropDuplicates(["print", "deal", "at"]).select("print", "deal", "at", F.col("chunk").alias("same"))
    others = dealt.filter("lead = 0").select("print", "deal", "at", "key", "digest", "chunk")
    met = others.join(leads.hint("merge"), ["print", "deal", "at"], "left")
    return met.filter(~F.col("chunk").eqNullSafe(F.col("same"))).select("key", "digest").distinct()


def group_equal(
    docs: DataFrame, key: str = "doc_id", text: str = "text", primes: tuple[int, ...] = PRIMES, huge: int = HUGE
) -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256 of every row."""
    ship(docs.sparkSession)
    named = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("null")).alias("key")
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    texts = docs.select(F.col(key).alias("id"), named, body)
    rows, groups, done = fingerprint(texts, 0, primes, huge), None, []
    round_ = 0
    while True:
        groups = pin(_groups(rows))
        odd = pin(differing(texts, rows, groups))
        if odd.isEmpty():
            break
        # Fingerprints that collided: these rows leave their groups and get others.
        round_ += 1
        size = odd.count()
        same = rows.join(odd, ["key", "digest"], "left_anti")
        done.append((pin(same), pin(_groups(same))))
        left = lookup_join(texts, odd.select("key").distinct(), "key", ["text"], "left_semi", size, 100 * size)
        rows = pin(fingerprint(left.select("id", "key", "text"), round_, primes, huge).join(odd, ["key", "digest"], "left_semi"))
    out = None
    for part, grouped in [*done, (rows, groups)]:
        keep = grouped.select("print", "size", F.struct("id", "key", "digest").alias("rep"))
        met = lookup_join(part, keep, "print", ["key", "digest"], "left", **counted(grouped, "print"))
        first = F.col("rep").isNull() | (F.struct("key", "digest") == F.struct("rep.key", "rep.digest"))
        rest = met.select(
            "id",
            F.when(F.col("rep").isNull(), F.col("id")).otherwise(F.col("rep.id")).alias("keep_id"),
            F.coalesce("size", "n").cast("long").alias("group_size"),
            F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda i: first & (i == 1))).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
        out = rest if out is None else out.unionByName(rest)
    return out


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return group_equal(docs).withColumnRenamed("id", "doc_id")

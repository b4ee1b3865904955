"""Token-id files: flat unsigned integers plus 64-bit document offsets, read back by memory map.

``write_tokens`` sorts documents by key over the cluster; every task writes one
flat file of ids and one of offsets in the shared folder. ``token_spans`` adds the
place of each document in the whole sequence: the base of a file is the prefix
sum of the ids in the files before it. ``read_tokens`` maps the files again.

Defined results: a null or empty text is one end id; a null key sorts first;
equal keys follow each other in the order of a hash of their text; an empty table
writes no file. Columns other than key and text are ignored, whatever their names.
A task that is run again writes a file of a new name, and only the files named by
the index, which is pinned, are ever read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.runtime import pin, scratch_path, ship

#: Distinct units whose ids a Python worker remembers, and characters of a unit that is not remembered.
CACHE_UNITS, LONG_UNIT = 1_200_000, 200
#: Documents whose unknown words go to the tokenizer together.
DOCS_AT_ONCE = 500
# Only before a space between two other white space characters would a cut change the tokens.
_UNSAFE = re.compile(r"\s \s")


class TokenFiles(NamedTuple):
    """``index``: key, part, file, pos, n_tokens; ``folder``: where the files are."""

    index: DataFrame
    folder: str
    dtype: str


def shared_uri(path: str) -> str:
    """A URI for pyarrow's file systems; plain paths are local."""
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    uri = shared_uri(folder)
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
    return pafs.FileSystem.from_uri(uri)


def _byte_alphabet() -> dict[int, int]:
    """Byte-level BPE writes a byte as itself if it is printable, else as one of the code points from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(others)}


# Characters which Unicode and the tokenizer's pattern class alike: letters, digits, marks and white space.
_L, _M, _W = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-/:-@\[-`{-~", r" \t\n\r"
_KNOWN = re.compile(f"[{_L}{_M}{_W}0-9]*")
# The tokenizer's own pattern, for these characters.
_UNITS = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[0-9]+| ?[{_M}]+|[{_W}]+(?![^{_W}])|[{_W}]+")


class WordEncoder:
    """Ids of a text as bytes.

    A byte-level BPE tokenizer cuts a text into units by its pattern and never merges across them, so units are
    encoded once and remembered. Texts of known characters are cut here, by the same pattern, and the units go to
    the BPE model directly. Other texts are cut before spaces first, where no cut changes the tokens; pieces
    that hold other characters, or a token added to the vocabulary, go to the whole tokenizer.
    """

    def __init__(self, tokenizer_path: str, dtype: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.alphabet = _byte_alphabet()
        self.space = chr(self.alphabet[ord(" ")])
        self.blanks = str.maketrans({c: chr(self.alphabet[ord(c)]) for c in " \t\n\r"})
        self.code = {1: "B", 2: "H", 4: "I", 8: "Q"}[np.dtype(dtype).itemsize]
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in found]

    def _unit(self, unit: str) -> bytes:
        if not unit.isascii():
            mapped = unit.encode().decode("latin-1").translate(self.alphabet)
        else:
            mapped = unit.translate(self.blanks) if unit.isspace() else unit.replace(" ", self.space)
        return array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _regular(self, text: str) -> bool:
        return _KNOWN.fullmatch(text) is not None and not any(a in text for a in self.added)

    def _units(self, text: str, whole: set[str]) -> list[str]:
        """The units of a text; pieces of it with unknown characters or added tokens stay, and join ``whole``."""
        if self._regular(text):
            return _UNITS.findall(text)
        first, *others = [text] if _UNSAFE.search(text) else text.split(" ")
        units = []
        for piece in [first, *[" " + p for p in others]]:
            if self._regular(piece):
                units += _UNITS.findall(piece)
            else:
                whole.add(piece)
                units.append(piece)
        return units

    def _learn(self, units: set[str], whole: set[str]) -> dict[str, bytes]:
        """Ids of new units; they are remembered, but for long ones, which hardly come again."""
        irregular = [*(units & whole)]
        new = dict(zip(irregular, self.encode(irregular), strict=True))
        before, encode = self.before.get, self._unit
        new.update((u, before(u) or encode(u)) for u in units - whole)
        self.known.update(new)
        for unit in irregular:
            if len(unit) > LONG_UNIT:
                del self.known[unit]
        return new

    def texts(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_UNITS // 2:
            # Units in use come back from the older half; rare ones are forgotten.
            self.before, self.known = self.known, {}
        whole: set[str] = set()
        rows = [self._units(t, whole) for t in texts]
        get = self.known.get
        found = [[*map(get, row)] for row in rows]
        lacking = [i for i, ids in enumerate(found) if None in ids]
        if lacking:
            new = self._learn({u for i in lacking for u, ids in zip(rows[i], found[i], strict=True) if ids is None}, whole)
            for i in lacking:
                found[i] = [new[u] if ids is None else ids for u, ids in zip(rows[i], found[i], strict=True)]
        return [b"".join(ids) for ids in found]


_encoders: dict[tuple[str, str], WordEncoder] = {}


def _encoder(path: str, dtype: str) -> WordEncoder:
    if (path, dtype) not in _encoders:
        _encoders[path, dtype] = WordEncoder(path, dtype)
    return _encoders[path, dtype]


def _writer(folder: str, tokenizer_path: str, dtype: str, end_id: int, schema: pa.Schema) -> Callable:
    end = np.array([end_id], dtype=dtype).tobytes()
    width = len(end)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, pos, offsets, ids = context.partitionId(), 0, [0], None
        fs, root = _open(folder)
        name = f"part-{part:06d}-{context.taskAttemptId()}"
        encoder = _encoder(tokenizer_path, dtype)
        for batch in batches:
            if not batch.num_rows:
                continue
            if ids is None:
                fs.create_dir(root, recursive=True)
                ids = fs.open_output_stream(f"{root}/{name}.bin")
            counts = []
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), DOCS_AT_ONCE):
                for encoded in encoder.texts([t or "" for t in texts[at : at + DOCS_AT_ONCE]]):
                    ids.write(encoded + end)
                    counts.append((len(encoded) + len(end)) // width)
                    offsets.append(offsets[-1] + counts[-1])
            n = batch.num_rows
            columns = [batch.column(0), pa.array([part] * n, pa.int32()), pa.array([name] * n)]
            columns += [pa.array(range(pos, pos + n), pa.int64()), pa.array(counts, pa.int64())]
            pos += n
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        if ids is not None:
            ids.close()
            with fs.open_output_stream(f"{root}/{name}.idx") as out:
                out.write(np.array(offsets, dtype="<i8").tobytes())

    return write


def write_tokens(
    docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = 0,
    folder: str | None = None, dtype: str = "<u2",
) -> TokenFiles:
    """Encode ``text`` in ascending order of ``key`` and write the files.

    ``dtype`` must hold every id: two bytes do for vocabularies of up to 65,536.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or scratch_path(spark, "tokens")
    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    ordered = slim.withColumn("tie", F.xxhash64("text")).repartitionByRange("key", "tie")
    ordered = ordered.sortWithinPartitions("key", "tie").select("key", "text")
    kind = slim.schema["key"].dataType
    fields = [T.StructField("key", kind), T.StructField("part", T.IntegerType()), T.StructField("file", T.StringType())]
    fields += [T.StructField("pos", T.LongType()), T.StructField("n_tokens", T.LongType())]
    from pyspark.sql.pandas.types import to_arrow_schema

    run = _writer(folder, tokenizer_path, dtype, end_id, to_arrow_schema(T.StructType(fields)))
    index = pin(ordered.mapInArrow(run, T.StructType(fields)))
    return TokenFiles(index, folder, dtype)


def file_bases(files: TokenFiles) -> DataFrame:
    """A row per file: the number of ids in all files before it. Rows: one per writing task."""
    sizes = files.index.groupBy("part", "file").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long"))


class _Mapped:
    """One pair of files; local ones by memory map, others by ranged reads."""

    def __init__(self, folder: str, name: str, dtype: str) -> None:
        fs, root = _open(folder)
        self.dtype = np.dtype(dtype)
        if isinstance(fs, pafs.LocalFileSystem):
            self.ids = np.memmap(f"{root}/{name}.bin", dtype=dtype, mode="r")
            self.offsets = np.memmap(f"{root}/{name}.idx", dtype="<i8", mode="r")
        else:
            self.ids = None
            self.file = fs.open_input_file(f"{root}/{name}.bin")
            with fs.open_input_file(f"{root}/{name}.idx") as f:
                self.offsets = np.frombuffer(f.read(), dtype="<i8")

    def document(self, pos: int) -> tuple[int, np.ndarray]:
        start, end = int(self.offsets[pos]), int(self.offsets[pos + 1])
        if self.ids is not None:
            return start, self.ids[start:end]
        width = self.dtype.itemsize
        self.file.seek(start * width)
        return start, np.frombuffer(self.file.read((end - start) * width), dtype=self.dtype)


def _reader(folder: str, dtype: str, schema: pa.Schema) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, mapped = None, None
        for batch in batches:
            starts, counts, sums = [], [], []
            rows = zip(batch.column("file").to_pylist(), batch.column("pos").to_pylist(), batch.column("base").to_pylist(), strict=True)
            for file, pos, base in rows:
                if file != name:
                    name, mapped = file, _Mapped(folder, file, dtype)
                start, ids = mapped.document(pos)
                starts.append(base + start)
                counts.append(len(ids))
                sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
            columns = [batch.column("key"), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return read


def read_tokens(files: TokenFiles) -> DataFrame:
    """Map the files again: key, start in the whole sequence, n_tokens, ids_crc32."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = files.index.schema["key"].dataType
    schema = T.StructType([T.StructField("key", kind), *[T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32")]])
    # One row per writing task, so the broadcast is bounded by the number of tasks.
    placed = files.index.join(F.broadcast(file_bases(files).select("part", "file", "base")), ["part", "file"])
    return placed.mapInArrow(_reader(files.folder, files.dtype, to_arrow_schema(schema)), schema)


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(files).withColumnRenamed("key", "doc_id")

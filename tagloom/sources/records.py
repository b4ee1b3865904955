"""Paragraphs of text files, cut at blank lines of any kind, with dense numbers in file order.

Spark's text source hands every line to the split in which it begins. Inside a split lines are
gathered into pieces, runs of visible lines; only the first and the last piece of a split can be
part of a paragraph that goes on next door. Two passes follow from that: one keeps a row per split
(the number of pieces and its two edge pieces), which gives each split its place and tells which
edges belong together; the other reads the files again and numbers the pieces. No line is
shuffled but those of paragraphs that cross a split, and no record is longer than a paragraph.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.runtime import broadcast_if_small, pin, ship

# One row per file split; a split stands for up to maxPartitionBytes of text.
MAX_BROADCAST_SPLITS = 1_000_000
# Fixed value: the ASCII white space that is stripped from lines.
BLANKS = " \t\n\x0b\f\r"

PIECES = "file bigint, start bigint, seq bigint, head boolean, tail boolean, lines array<string>"
_NAMES = ["file", "start", "seq", "head", "tail", "lines"]


class _Split:
    """The pieces of one split, fed with its lines batch by batch.

    ``head`` marks the piece at the first line, ``tail`` the one at the last. Where that line is
    blank or a boundary, an empty piece takes the mark; its ``seq`` is out of the count from 1.
    """

    def __init__(self, key: tuple[int, int], boundary: str | None):
        self.key, self.boundary = key, boundary
        self.seq, self.open, self.head, self.shut = 0, [], False, True
        self.fresh = True

    def _rows(self, lines: pa.ListArray, head: bool = False, tail: bool = False, seq: int | None = None) -> pa.RecordBatch:
        n = len(lines)
        first = self.seq + 1 if seq is None else seq
        if seq is None:
            self.seq += n
        heads = np.zeros(n, dtype=bool)
        heads[:1] = head
        columns = [np.full(n, k, dtype=np.int64) for k in self.key]
        columns += [np.arange(first, first + n, dtype=np.int64), heads, np.full(n, tail)]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), lines], names=_NAMES)

    def _piece(self, tail: bool) -> pa.RecordBatch:
        values = pa.concat_arrays(self.open)
        self.open = []
        return self._rows(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), self.head, tail)

    def _empty(self, **mark: bool) -> pa.RecordBatch:
        none = pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), pa.array([], pa.string()))
        return self._rows(none, seq=0, **mark)

    def feed(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        visible = pc.not_equal(lines, "").to_numpy(zero_copy_only=False)
        alone = np.zeros(len(visible), dtype=bool)
        if self.boundary is not None:
            alone = pc.starts_with(lines, self.boundary).to_numpy(zero_copy_only=False)
        if self.fresh:
            self.head = bool(visible[0] and not alone[0])
            if not self.head:
                yield self._empty(head=True)
        # A paragraph begins at a visible line after a blank one, and on both sides of a boundary line.
        after = np.concatenate([[self.shut], ~visible[:-1] | alone[:-1]]) | alone
        begins = visible & after
        at = np.cumsum(visible) - 1
        starts, values = at[begins], lines.filter(pa.array(visible))
        if self.open and (len(starts) or not visible[-1]):
            first = int(starts[0]) if len(starts) else len(values)
            self.open.append(values.slice(0, first))
            yield self._piece(False)
            self.head = False
        elif self.open:
            self.open.append(values)
        bounds = np.append(starts, len(values)) if len(starts) else starts
        closed = len(bounds) - 1 - bool(visible[-1])
        if closed > 0:
            offsets = pa.array(bounds[: closed + 1] - bounds[0], pa.int32())
            part = values.slice(int(bounds[0]), int(bounds[closed] - bounds[0]))
            yield self._rows(pa.ListArray.from_arrays(offsets, part), self.head)
            self.head = False
        if len(starts) and visible[-1]:
            self.open = [values.slice(int(starts[-1]))]
        self.fresh, self.shut = False, bool(not visible[-1] or alone[-1])

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.open:
            yield self._piece(not self.shut)
        if self.shut:
            yield self._empty(tail=True)


def _gather(boundary: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines of a task (file, start, value), in order, to pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None
        for batch in batches:
            if not batch.num_rows:
                continue
            lines = pc.utf8_trim(batch.column("value").cast(pa.string()), characters=BLANKS)
            keys = [batch.column(c).to_numpy() for c in ("file", "start")]
            edges = np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])) + 1
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(lines)], strict=True):
                key = int(keys[0][low]), int(keys[1][low])
                if split is None or split.key != key:
                    if split is not None:
                        yield from split.end()
                    split = _Split(key, boundary)
                yield from split.feed(lines.slice(low, high - low))
        if split is not None:
            yield from split.end()

    return run


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The files behind a path: number and full name. Their content is not read."""
    names = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("name"))
    return names.distinct().select(F.xxhash64("name").alias("file"), "name")


def _places(pieces: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For every split: what to add to ``seq``, and whether its edge pieces are parts of longer paragraphs.

    Returned with the edge pieces themselves, of which a split has two at most; both pinned.
    """
    seen = F.size("lines") > 0
    edge = F.when(F.col("head") | F.col("tail"), F.struct("seq", "head", "tail", "lines"))
    splits = pin(pieces.groupBy("file", "start").agg(
        F.count_if(seen).alias("n"),
        F.bool_or(seen & F.col("head")).alias("from_first"),
        F.bool_or(seen & F.col("tail")).alias("to_last"),
        F.collect_list(edge).alias("edges"),
    ))
    named = splits.drop("edges").join(broadcast_if_small(pin(files), MAX_BROADCAST_SPLITS), "file", "left")
    # Windows over splits, not over lines.
    row = Window.orderBy("name", "start")
    same = lambda step: F.coalesce(step("file").over(row) == F.col("file"), F.lit(False))
    goes_on = F.col("from_first") & same(F.lag) & F.coalesce(F.lag("to_last").over(row), F.lit(False))
    is_continued = F.col("to_last") & same(F.lead) & F.coalesce(F.lead("from_first").over(row), F.lit(False))
    marked = named.withColumns({"goes_on": goes_on, "is_continued": is_continued, "last": ~same(F.lead)})
    begun = F.col("n") - F.col("goes_on").cast("bigint")
    before = F.coalesce(F.sum(begun).over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The first piece of a split which goes on gets the number of the paragraph begun last.
    shift = before - F.col("goes_on").cast("bigint")
    open_end = F.col("last") & F.col("to_last")
    places = marked.select("file", "start", shift.alias("shift"), "goes_on", "is_continued", open_end.alias("open_end"))
    return pin(places), splits.select("file", "start", F.inline("edges"))


def paragraphs(spark: SparkSession, path: str, keep_unterminated: bool = True, boundary: str | None = None) -> DataFrame:
    """``sent_id, lines``: stripped visible lines of every paragraph, numbered from 1 in file order.

    Blank lines are those of white space only, whatever the line ends. ``keep_unterminated=False`` drops a
    paragraph at the end of a file which no blank line follows. With ``boundary`` a line that starts with it is
    a paragraph of its own. The files are read when the result is used; if they have changed since, that fails.
    """
    ship(spark)
    source = spark.read.option("lineSep", "\n").text(path)
    lines = source.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    pieces = lines.mapInArrow(_gather(boundary), PIECES)
    places, edges = _places(pieces, _files(spark, path))
    changed = F.raise_error(F.lit("the files or the size of their splits have changed")).cast("bigint")
    number = (F.coalesce("shift", changed) + F.col("seq")).alias("sent_id")
    part = (F.col("head") & F.col("goes_on")) | (F.col("tail") & F.col("is_continued"))
    kept = F.lit(True) if keep_unterminated else ~(F.col("tail") & F.col("open_end"))

    small = broadcast_if_small(places, MAX_BROADCAST_SPLITS)
    whole = pieces.filter(F.size("lines") > 0).join(small, ["file", "start"], "left").select(number, "lines", part.alias("part"), kept.alias("kept"))
    alone = whole.filter("kept and not part").select("sent_id", "lines")
    placed = edges.filter(F.size("lines") > 0).join(small, ["file", "start"]).filter(part).select(number, "start", "lines", kept.alias("kept"))
    ordered = F.sort_array(F.collect_list(F.struct("start", "lines")))
    joined = placed.groupBy("sent_id").agg(ordered.alias("parts"), F.bool_and("kept").alias("kept")).filter("kept")
    return alone.unionByName(joined.select("sent_id", F.flatten("parts.lines").alias("lines")))

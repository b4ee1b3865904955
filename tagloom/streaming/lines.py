"""Streams of raw lines: sentences and running counts, whatever the edges of micro-batches.

A line is a record of a keyed stream (``key``, ``line_no`` counted from 1 without gaps, ``line``), such as
the lines of a file or of a socket as a message log delivers them; a null line ends its stream. Keyed
state carries what a micro-batch leaves open: lines that came before their predecessors, the words of an
unfinished sentence, or the tags before and the chunk that is still right on both sides. A line that
is delivered again is ignored. So the result depends on the lines only, not on how they arrive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tagloom.functions import tags as tg
from tagloom.operators.evaluate import BOUNDARY, COUNTS
from tagloom.runtime import ship
from tagloom.sources.records import BLANKS

_ORDER = "next bigint, held_no array<bigint>, held array<string>"
_SENTENCES = f"{_ORDER}, sentence bigint, open array<string>"
_COUNTS = (
    f"{_ORDER}, width int, gold string, guess string, agrees boolean, tokens bigint, correct_tags bigint, "
    "types array<string>, counts array<array<bigint>>"
)


def _in_order(frames: Iterable[pd.DataFrame], following: int, numbers: list[int], lines: list[str | None]) -> tuple[list, int, list, list]:
    """Lines that follow without a gap from number ``following`` on; the next number, and the lines held back."""
    waiting = dict(zip(numbers, lines, strict=True))
    for frame in frames:
        waiting.update((n, x) for n, x in zip(frame["line_no"].tolist(), frame["line"].tolist(), strict=True) if n >= following)
    ready = []
    while following in waiting:
        ready.append(waiting.pop(following))
        following += 1
    return ready, following, list(waiting), list(waiting.values())


def _old(state: GroupState, fresh: tuple) -> tuple:
    return tuple(state.get) if state.exists else fresh


def _sentences(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The sentences that the new lines complete."""
    following, numbers, held, sentence, words = _old(state, (1, [], [], 0, []))
    ready, following, numbers, held = _in_order(frames, following, list(numbers), list(held))
    words, found = list(words), []
    for line in ready:
        word = "" if line is None else line.strip(BLANKS)
        if word:
            words.append(word)
        elif words:
            sentence += 1
            found.append((key[0], sentence, words))
            words = []
    state.update((following, numbers, held, sentence, words))
    if found:
        yield pd.DataFrame(found, columns=["key", "sentence", "lines"])


def _keyed(lines: DataFrame) -> DataFrame:
    ship(lines.sparkSession)
    return lines.select("key", F.col("line_no").cast("bigint").alias("line_no"), "line")


def stream_sentences(lines: DataFrame) -> DataFrame:
    """``sent_id, lines``: sentences of a stream of lines as soon as a blank line or the end completes them.

    ``sent_id`` is the key with the number of the sentence in its stream. State per key: the open sentence.
    """
    kind = lines.schema["key"].dataType.simpleString()
    found = _keyed(lines).groupBy("key").applyInPandasWithState(
        _sentences, f"key {kind}, sentence bigint, lines array<string>", _SENTENCES, "append", GroupStateTimeout.NoTimeout
    )
    return found.select(F.struct("key", "sentence").alias("sent_id"), "lines")


def _split(tag: str) -> tuple[str, str]:
    """Prefix and type of a tag, as ``functions.tags`` has them for columns."""
    before, hyphen, after = tag.partition("-")
    return before, "" if after == "0" or not hyphen else after


def _opens(before: tuple[str, str], now: tuple[str, str]) -> bool:
    if now[0] in tg.SINGLE or before[0] in tg.OPENS_AFTER.get(now[0], ()):
        return True
    return now[0] not in tg.NO_CHUNK and before[1] != now[1]


def _closes(before: tuple[str, str], now: tuple[str, str]) -> bool:
    if before[0] in tg.SINGLE or now[0] in tg.CLOSES_BEFORE.get(before[0], ()):
        return True
    return before[0] not in tg.NO_CHUNK and before[1] != now[1]


class ChunkCounter:
    """Counts of one stream, token by token. ``agrees``: an open chunk began alike on both sides and nothing differed since."""

    def __init__(self, gold: str, guess: str, agrees: bool, types: dict[str, list[int]]):
        self.gold, self.guess, self.agrees, self.types = gold, guess, agrees, types
        self.changed: set[str] = set()

    def _add(self, kind: str, count: int) -> None:
        self.types.setdefault(kind, [0, 0, 0])[count] += 1
        self.changed.add(kind)

    def step(self, gold: str, guess: str) -> bool:
        """Go on to the next token; whether its tags are the same."""
        was_gold, was_guess, now_gold, now_guess = _split(self.gold), _split(self.guess), _split(gold), _split(guess)
        end_gold, end_guess = _closes(was_gold, now_gold), _closes(was_guess, now_guess)
        if self.agrees:
            if end_gold and end_guess and was_gold[1] == was_guess[1]:
                self.agrees = False
                self._add(was_gold[1], 2)
            elif end_gold != end_guess or now_gold[1] != now_guess[1]:
                self.agrees = False
        begins_gold, begins_guess = _opens(was_gold, now_gold), _opens(was_guess, now_guess)
        if begins_gold and begins_guess and now_gold[1] == now_guess[1]:
            self.agrees = True
        if begins_gold:
            self._add(now_gold[1], 0)
        if begins_guess:
            self._add(now_guess[1], 1)
        self.gold, self.guess = gold, guess
        return now_gold == now_guess

    def end(self) -> None:
        """The end of a sentence. Only a chunk that ran into the prefix ``.`` is still open after the step."""
        last = _split(self.gold)[1]
        self.step(tg.OUTSIDE, tg.OUTSIDE)
        if self.agrees:
            self._add(last, 2)
            self.agrees = False


def _items(line: str, delimiter: str) -> list[str]:
    """Items of a line; empty ones at its end do not count."""
    items = line.split(delimiter)
    while items and not items[-1]:
        items.pop()
    return items


def _counts(delimiter: str, boundary: str) -> Callable:
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fresh = (1, [], [], 0, tg.OUTSIDE, tg.OUTSIDE, False, 0, 0, [], [])
        following, numbers, held, width, gold, guess, agrees, tokens, right, types, counts = _old(state, fresh)
        ready, following, numbers, held = _in_order(frames, following, list(numbers), list(held))
        counter = ChunkCounter(gold, guess, agrees, {t: list(c) for t, c in zip(types, counts, strict=True)})
        for line in ready:
            text = "" if line is None else line.strip(BLANKS)
            if not text:
                counter.end()
                continue
            items = _items(text, delimiter)
            width = width or len(items)
            if len(items) != width or width < 2:
                raise ValueError(f"unexpected number of items: {len(items)} after {width} in line: {line}")
            if items[0] == boundary:
                counter.step(tg.OUTSIDE, tg.OUTSIDE)
            else:
                right += counter.step(items[-2], items[-1])
                tokens += 1
        every = counter.types
        state.update((following, numbers, held, width, counter.gold, counter.guess, counter.agrees, tokens, right, list(every), list(every.values())))
        if ready:
            rows = [(key[0], following - 1, None, tokens, right, 0, 0, 0)]
            rows += [(key[0], following - 1, t, 0, 0, *every[t]) for t in sorted(counter.changed)]
            yield pd.DataFrame(rows, columns=["key", "lines", "type", *COUNTS])

    return run


def stream_line_counts(lines: DataFrame, delimiter: str = " ", boundary: str = BOUNDARY) -> DataFrame:
    """Running counts of a stream of evaluation lines, in update mode: ``key, lines, type`` and the counts.

    A row holds the totals of a type (null: the token counts) after the first ``lines`` lines of the stream
    ``key``; a micro-batch gives the rows that it changed. State per key: the tags before, and a
    row per chunk type. ``latest_counts`` sums the last rows. ``delimiter`` is a plain string.
    """
    kind = lines.schema["key"].dataType.simpleString()
    shape = f"key {kind}, lines bigint, type string, " + ", ".join(f"{c} bigint" for c in COUNTS)
    grouped = _keyed(lines).groupBy("key")
    return grouped.applyInPandasWithState(_counts(delimiter, boundary), shape, _COUNTS, "update", GroupStateTimeout.NoTimeout)


def latest_counts(updates: DataFrame) -> DataFrame:
    """Counts per chunk type, as ``evaluate.chunk_counts`` has them, from the rows of ``stream_line_counts``.

    Counts only grow, and a row that is written again is the same, so the largest is the last.
    """
    last = updates.groupBy("key", "type").agg(*[F.max(c).alias(c) for c in COUNTS])
    return last.groupBy("type").agg(*[F.sum(c).alias(c) for c in COUNTS])

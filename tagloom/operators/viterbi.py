"""Array arithmetic of the trigram decoder, for use inside Arrow tasks.

Tags are indexed in descending string order, so that the first maximum numpy
finds is the largest tag: ties go to the largest tag, as for ordered tuples.
Index ``K`` stands for the start padding in the history and for STOP as last tag.
"""

from __future__ import annotations

from copy import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Columns of a table of trigram weights, besides ``weight``.
HISTORY = ("t2", "t1", "tag")
# Cells of the largest temporary array, and of one that stays in the processor's cache.
CELLS = 4_000_000
BLOCK = 100_000


class Transitions:
    """Sparse trigram weights, read as dense blocks over the last tag."""

    def __init__(self, tags: list[str], rows: pa.Table, start: str, stop: str):
        self.size = len(tags)
        names = [pa.array([*tags, end], pa.string()) for end in (start, start, stop)]
        known = [pc.index_in(rows.column(c), value_set=n).fill_null(-1) for c, n in zip(HISTORY, names)]
        at = np.stack([column.to_numpy() for column in known], axis=1).astype(np.int64)
        kept = (at >= 0).all(axis=1)
        self.at, self.weight = at[kept], rows.column("weight").to_numpy()[kept]
        self.whole = self._fill(0, self.size + 1) if (self.size + 1) ** 3 <= CELLS else None

    def _fill(self, low: int, high: int) -> np.ndarray:
        out = np.zeros((self.size + 1, self.size + 1, high - low))
        inside = (self.at[:, 2] >= low) & (self.at[:, 2] < high)
        a, b, c = self.at[inside].T
        np.add.at(out, (a, b, c - low), self.weight[inside])
        return out

    def incoming(self, u: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Weights of all (t, u, s), a row for each pair of last tags."""
        if self.whole is not None:
            return self.whole[: self.size, u, s].T
        out = np.empty((len(u), self.size))
        for tag in np.unique(s):
            out[s == tag] = self.block(tag, tag + 1)[: self.size, u[s == tag], 0].T
        return out

    def add(self, at: np.ndarray, amount: float) -> None:
        """Add ``amount`` to the weight of each (t2, t1, t) row of ``at``."""
        if self.whole is not None:
            np.add.at(self.whole, tuple(at.T), amount)
        else:
            self.at = np.concatenate([self.at, at])
            self.weight = np.concatenate([self.weight, np.full(len(at), amount)])

    def copies(self, count: int) -> list[Transitions]:
        """Copies to be changed on their own; dense ones lie side by side in the array ``whole.base`` of any."""
        found = [copy(self) for _ in range(count)]
        if self.whole is not None:
            side = np.repeat(self.whole[None], count, axis=0)
            for i, moves in enumerate(found):
                moves.whole = side[i]
        return found

    def block(self, low: int, high: int) -> np.ndarray:
        """Weights of (t2, t1, t) for ``low <= t < high``."""
        return self._fill(low, high) if self.whole is None else self.whole[:, :, low:high]


def _advance(pi: np.ndarray, moves: Transitions) -> np.ndarray:
    """Best score over the oldest tag, for every new pair of last tags."""
    count, k = len(pi), moves.size
    best = np.empty_like(pi)
    width = max(1, min(k, CELLS // (k * k)))
    depth = max(1, min(CELLS, BLOCK) // (k * k * width))
    for low in range(0, k, width):
        block = moves.block(low, min(low + width, k))[:k, :k]
        for row in range(0, count, depth):
            options = pi[row : row + depth, :, :, None] + block
            options.max(axis=1, out=best[row : row + depth, :, low : low + width])
    return best


def best_path(gain: np.ndarray, moves: Transitions) -> np.ndarray:
    """Decode one sentence, given a row of K tag scores per token.

    The lean form of ``best_paths`` for trainers, which see a sentence at a time.
    """
    n, k = len(gain), moves.size
    if moves.whole is None or n < 3 or n * k * k > CELLS:
        return best_paths(np.array([n]), gain, moves)[0]
    inner, begin, ending = moves.whole[:k, :k, :k], moves.whole[k], moves.whole[:k, :k, k]
    pi = (begin[k, :k] + gain[0])[:, None] + begin[:k, :k] + gain[1]
    steps = []
    for here in gain[2:]:
        steps.append(pi)
        pi = np.add(pi[:, :, None], inner).max(axis=0) + here
    u, s = divmod(int((pi + ending).argmax()), k)
    path = [s, u]
    # The oldest tag is asked for on the best path only.
    for pi in reversed(steps):
        u, s = int((pi[:, u] + inner[:, u, s]).argmax()), u
        path.append(u)
    return np.array(path[::-1])


def best_paths_apart(lengths: np.ndarray, gain: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Decode a sentence for each of several models at once: ``side`` holds their dense weights, one after the other.

    ``best_path`` for trainers whose shards learn in step: the same sums in the same order, so the same paths. The
    longest sentences come first, as in ``best_paths``.
    """
    k = side.shape[1] - 1
    order = np.argsort(-lengths, kind="stable")
    first, size, side = (np.cumsum(lengths) - lengths)[order], lengths[order], side[order]
    running = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    edges = np.concatenate([[0], np.cumsum(running)])
    # Tokens by step: the first of every sentence, the second, and so on.
    token = first[np.arange(edges[-1]) - np.repeat(edges[:-1], running)] + np.repeat(np.arange(len(running)), running)
    gain, steps = gain[token][:, None, :], list(zip(edges.tolist(), running.tolist()))
    inner, options = np.ascontiguousarray(side[:, :k, :k, :k]), np.empty((len(size), k, k, k))
    kept, closing = [], np.empty((len(size), k, k))
    for at, (low, count) in enumerate(steps):
        here = gain[low : low + count]
        if at == 0:
            pi = side[:, k, k:, :k] + here
        elif at == 1:
            pi = pi[:count, 0, :, None] + side[:count, k, :k, :k] + here
        else:
            pi = np.add(pi[:count, :, :, None], inner[:count], out=options[:count]).max(axis=1)
            pi += here
        kept.append(pi)
        done = steps[at + 1][1] if at + 1 < len(steps) else 0
        if done < count:
            # A sentence of one token has the padding as its tag before: its other rows cannot win.
            closing[done:count, 1:] = -np.inf
            closing[done:count, : 1 if at == 0 else k] = pi[done:] + (side[done:count, k:, :k, k] if at == 0 else side[done:count, :k, :k, k])
    u, s = np.divmod(closing.reshape(len(size), -1).argmax(axis=1), k)
    tags, oldest = np.empty(len(token), dtype=np.int64), np.arange(k)
    old_pi = np.arange(len(size))[:, None] * k**2 + oldest * k
    old_inner = np.arange(len(size))[:, None] * k**3 + oldest * k**2
    for at in range(len(steps) - 1, -1, -1):
        low, count = steps[at]
        tags[low : low + count] = s[:count]
        if at > 1:
            before = u[:count].copy()
            at_pi, at_inner = old_pi[:count] + before[:, None], old_inner[:count] + (before * k + s[:count])[:, None]
            u[:count] = (kept[at - 1].take(at_pi) + inner.take(at_inner)).argmax(axis=1)
            s[:count] = before
        else:
            s[:count] = u[:count]
    found = np.empty(len(token), dtype=np.int64)
    found[token] = tags
    return found


def best_paths(lengths: np.ndarray, emissions: np.ndarray, moves: Transitions) -> tuple[np.ndarray, np.ndarray]:
    """Decode several sentences at once.

    ``emissions`` has a row of K tag scores per token, sentence after sentence.
    Returns the tag index of every token and the score of every sentence. The
    sentences advance together, longest first, so that those still running are
    always a prefix of the arrays. Scores are kept to trace the best paths; of very
    long sentences only every n-th step is kept, and the steps between are redone.
    """
    k = moves.size
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    running = [int(n) for n in np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")]
    ending = moves.block(k, k + 1)[:, :, 0]
    stride = 1 if len(emissions) * k * k <= CELLS else int(np.sqrt(len(running))) + 1

    def step(pi: np.ndarray | None, at: int) -> np.ndarray:
        count = running[at]
        gain = emissions[first[:count] + at]
        if pi is None:
            return (moves.block(0, k)[k, k] + gain)[:, None, :]
        if at == 1:
            return pi[:count, 0, :, None] + moves.block(0, k)[k, :k] + gain[:, None, :]
        return _advance(pi[:count], moves) + gain[:, None, :]

    score = np.empty(len(size))
    last = np.zeros((len(size), 2), dtype=np.int64)
    kept: dict[int, np.ndarray] = {}
    pi = None
    for at, count in enumerate(running):
        pi = step(pi, at)
        if at % stride == 0:
            kept[at] = pi
        done = running[at + 1] if at + 1 < len(running) else 0
        if done < count:
            closing = pi[done:] + (ending[k:, :k] if at == 0 else ending[:k, :k])
            flat = closing.reshape(count - done, -1)
            pick = flat.argmax(axis=1)
            score[done:count] = flat[np.arange(count - done), pick]
            last[done:count] = np.stack(np.divmod(pick, k), axis=1)
    tags = np.empty(len(emissions), dtype=np.int64)
    u, s = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
    for at in range(len(running) - 1, -1, -1):
        count = running[at]
        done = running[at + 1] if at + 1 < len(running) else 0
        u[done:count], s[done:count] = last[done:count, 0], last[done:count, 1]
        tags[first[:count] + at] = s[:count]
        kept.pop(at, None)
        # The oldest tag is asked for on the best paths only.
        oldest = np.zeros(count, dtype=np.int64)
        if at > 1:
            base = (at - 1) - (at - 1) % stride
            for redo in range(base + 1, at) if at - 1 not in kept else ():
                kept[redo] = step(kept[redo - 1], redo)
            before = kept[at - 1][np.arange(count), :, u[:count]]
            oldest = (before + moves.incoming(u[:count], s[:count])).argmax(axis=1)
        s[:count], u[:count] = u[:count], oldest
    scores = np.empty(len(size))
    scores[order] = score
    return tags, scores

"""Suffix sorting by induced sorting with queues on disk, for strings compared up to a fixed depth.

The text is an array of small numbers that ends with a unique least symbol. Suffixes are of type S if they are smaller than the next
one, else L; the leftmost S suffixes of each run (LMS) are sorted first, through names of the substrings between them: names are ranked,
and then pairs of names, again and again, until all are distinct or the depth is covered. Then two scans induce the rest: a queue for
each first symbol holds tuples of position and common prefix with the tuple before, in order; taking a batch from the least queue puts
the positions to its left into the queues of their own symbols (L suffixes upwards, S suffixes downwards). The common prefix of two
neighbours of one queue is one more than the least value between their sources; only the first of a batch is compared by its symbols.

Batches that don't fit `memory` go to a file and come back when their queue is taken, so memory beyond the text, its types and the
largest batch is bounded. Everything is done on arrays.
"""

from __future__ import annotations

import os
import tempfile
from collections import deque

import numpy as np

from .tokens import eight_bytes


def common_prefix(words: np.ndarray, p: np.ndarray, q: np.ndarray, depth: int) -> np.ndarray:
    """Equal leading symbols, up to depth, at p and q; words: the 8 bytes from every position on, little end first."""
    out = np.full(len(p), depth, dtype=np.int64)
    left = np.arange(len(p))
    for k in range(0, depth, 8):
        x = words[p[left] + k] ^ words[q[left] + k]
        differ = x != 0
        if differ.any():
            low = x[differ] & (~x[differ] + np.uint64(1))
            out[left[differ]] = np.minimum(depth, k + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3))
            left = left[~differ]
        if not len(left):
            break
    return out


class Queues:
    """First-in, first-out queues of (position, common prefix) batches, one for each symbol; beyond `memory` bytes they go to disk."""

    def __init__(self, symbols: int, memory: int):
        self.queues = [deque() for _ in range(symbols)]
        self.last = np.full(symbols, -1, dtype=np.int64)
        self.memory, self.used, self.file = memory, 0, None

    def put(self, symbol: int, positions: np.ndarray, prefix: np.ndarray) -> None:
        size = positions.nbytes + prefix.nbytes
        self.last[symbol] = positions[-1]
        if self.used + size <= self.memory:
            self.used += size
            self.queues[symbol].append((positions, prefix))
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, os.SEEK_END)
        self.file.write(positions.tobytes())
        self.file.write(prefix.tobytes())
        self.queues[symbol].append((at, len(positions), positions.dtype))

    def take(self, symbol: int):
        """The oldest batches of a symbol as one, of at most about a quarter of `memory` (one batch at least), or None."""
        queue, parts, size = self.queues[symbol], [], 0
        while queue and (not parts or size <= self.memory // 4):
            batch = queue.popleft()
            if len(batch) == 2:
                self.used -= batch[0].nbytes + batch[1].nbytes
            else:
                at, n, kind = batch
                self.file.seek(at)
                batch = np.frombuffer(self.file.read(n * kind.itemsize), dtype=kind), np.frombuffer(self.file.read(n), dtype=np.uint8)
            parts.append(batch)
            size += batch[0].nbytes
        if len(parts) < 2:
            return parts[0] if parts else None
        return np.concatenate([p for p, _ in parts]), np.concatenate([v for _, v in parts])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _sorted_lms(text: np.ndarray, words: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """LMS positions in the order of their suffixes, up to depth."""
    length = np.append(lms[1:] - lms[:-1] + 1, 1)
    order = np.arange(len(lms))
    columns = []
    for k in range(0, min(int(length.max()), depth + 8), 8):
        # big end first, and after its end a substring counts as larger than any that goes on: there it would be of type L
        x = words[lms + k].byteswap()
        have = np.clip(length - k, 0, 8)
        fill = np.where(have >= 8, np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * np.minimum(have, 7)).astype(np.uint64))
        columns.append(np.where(have > 0, x | fill, np.uint64(0xFFFFFFFFFFFFFFFF)))
    order = np.argsort(columns[0], kind="stable") if len(columns) == 1 else np.lexsort(columns[::-1])
    new = np.zeros(len(lms), dtype=bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    name = np.empty(len(lms), dtype=np.int64)
    name[order] = np.cumsum(new)
    span = 1  # names cover so many LMS substrings, each of two symbols at least
    while not new[1:].all() and 2 * span <= depth + 1:
        follow = np.full(len(lms), -1, dtype=np.int64)
        follow[: len(lms) - span] = name[span:] if span < len(lms) else name[:0]
        key = name * (len(lms) + 1) + follow + 1
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.concatenate(([False], s[1:] != s[:-1]))
        name = np.empty(len(lms), dtype=np.int64)
        name[order] = np.cumsum(new)
        span *= 2
    return lms[order]


def suffix_order(text: np.ndarray, depth: int, memory: int = 128 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Positions of `text` (bytes up to 254, the last one 0 and the only 0) in the order of their suffixes up to `depth` (at most 254),
    and the common prefix of each with the one before, up to depth."""
    n = len(text)
    kind = np.int32 if n < 2**31 else np.int64
    if n == 1:
        return np.zeros(1, dtype=kind), np.zeros(1, dtype=np.uint8)
    words = eight_bytes(text, depth + 8)
    step = np.diff(text.astype(np.int16))
    at = np.where(step != 0, np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where the symbol changes
    small = np.ones(n, dtype=bool)  # type S
    small[:-1] = step[np.minimum(at, n - 2)] > 0
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    lms = _sorted_lms(text, words, lms, depth)
    prefix = np.zeros(len(lms), dtype=np.uint8)
    prefix[1:] = common_prefix(words, lms[:-1], lms[1:], depth)
    lms = lms.astype(kind)
    first = text[lms]
    cut = np.searchsorted(first, np.arange(257))

    def induce(queues: Queues, positions: np.ndarray, prefix: np.ndarray, large: bool) -> None:
        left = positions - 1
        take = np.flatnonzero((left >= 0) & (small[left] != large))
        if not len(take):
            return
        symbol = text[left[take]]
        order = np.argsort(symbol, kind="stable")
        take, symbol = take[order], symbol[order]
        values = np.zeros(len(take), dtype=np.int64)
        same = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
        if len(same):
            bounds = np.empty(2 * len(same), dtype=np.int64)
            bounds[::2], bounds[1::2] = take[same - 1] + 1, take[same] + 1
            values[same] = np.minimum(depth, 1 + np.minimum.reduceat(np.append(prefix, np.uint8(0)), bounds)[::2].astype(np.int64))
        heads = np.concatenate(([0], np.flatnonzero(symbol[1:] != symbol[:-1]) + 1))
        before = queues.last[symbol[heads]]
        known = before >= 0
        values[heads[known]] = common_prefix(words, before[known], left[take[heads[known]]].astype(np.int64), depth)
        values = values.astype(np.uint8)
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(take)]):
            queues.put(int(symbol[a]), left[take[a:b]], values[a:b])

    up, ups = Queues(256, memory), [[] for _ in range(256)]
    for c in range(256):
        while (batch := up.take(c)) is not None:
            ups[c].append(batch)
            induce(up, *batch, True)
        if cut[c] < cut[c + 1]:
            seeds, values = lms[cut[c] : cut[c + 1]], prefix[cut[c] : cut[c + 1]].copy()
            induce(up, seeds, values, True)
    up.close()
    down, order, shared = Queues(256, memory), [], []
    for c in range(255, -1, -1):
        while (batch := down.take(c)) is not None:
            order.append(batch[0])
            shared.append(batch[1])
            induce(down, *batch, False)
        if ups[c]:
            positions = np.concatenate([p for p, _ in ups[c]])[::-1]
            values = np.concatenate([v for _, v in ups[c]])
            ups[c] = []
            values = np.concatenate(([np.uint8(0)], values[1:][::-1])).astype(np.uint8)  # now with the next larger one
            induce(down, positions, values, False)
            order.append(positions)
            shared.append(values)
    down.close()
    order.append(np.array([n - 1], dtype=kind))
    shared.append(np.zeros(1, dtype=np.uint8))
    # what was put out runs from the largest suffix to the least; heads of the two types of a symbol are compared by their symbols
    heads = np.cumsum([0] + [len(x) for x in order[:-1]])
    order, shared = np.concatenate(order), np.concatenate(shared)
    heads = heads[heads > 0]
    shared[heads] = common_prefix(words, order[heads - 1].astype(np.int64), order[heads].astype(np.int64), depth)
    return order[::-1], np.concatenate(([np.uint8(0)], shared[1:][::-1]))

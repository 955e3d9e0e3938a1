"""A run-length index over a collection of byte strings (contexts).

The Burrows-Wheeler transform of the collection is kept as runs: for every run its byte, its start and how
many of its byte stand before it. That is enough to step from a suffix to the one that starts a byte
earlier. Samples are kept at the heads of the intervals of suffixes that share their first ``depth`` bytes: the
smallest owner of any string in the interval.

``earlier`` streams every string through the index backwards, all strings in step, and reads at each place whether
its match of ``depth`` bytes lies in a string with a smaller owner.
"""

from __future__ import annotations

import numpy as np


class RunIndex:
    """Index of ``strings``, ordered by ``owners``, the smallest first. A string holds no zero byte."""

    def __init__(self, strings: list[bytes], owners: np.ndarray, depth: int):
        self.owners, self.depth, self.n = owners, depth, len(strings)
        self.sizes = np.fromiter(map(len, strings), np.int64, self.n)
        raw = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8)  # a terminator, smaller than all bytes
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        of = np.repeat(np.arange(self.n), self.sizes + 1)
        left = (self.starts + self.sizes)[of] - np.arange(len(raw))  # bytes up to the terminator
        order, heads = self._sort(raw, left, depth)
        # the byte in front of each suffix; 0 where a string begins
        self._runs(np.where(order == self.starts[of[order]], 0, raw[order - 1]).astype(np.int64))
        self.interval = np.cumsum(heads, dtype=np.int32) - 1
        self.interval_owner = np.minimum.reduceat(owners[of[order]], np.flatnonzero(heads))

    def _sort(self, raw: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix order, and where a suffix doesn't share its first ``depth`` bytes with the one before it.

        Sorted by prefix doubling: suffixes are ranked by eight bytes, and from then on by their rank and that of the suffix as many bytes
        further on, each time only those still equal to a neighbour, in one sort of one number. All sorts are stable, so suffixes
        that end alike stay in the order of their strings.
        """
        words = _words(raw, left)
        order = np.argsort(words, kind="stable")
        at = words[order]
        apart = np.r_[True, at[1:] != at[:-1]]
        # the rank of a suffix is the first row of those it is equal to so far
        first = np.flatnonzero(apart)[np.cumsum(apart) - 1]
        rank = np.empty(len(order), np.int64)
        rank[order] = first
        rows, deep = np.arange(len(order)), 8
        while True:
            # of the rows at hand, those in groups of two or more; suffixes of less than ``deep`` bytes are equal to their end
            alone = apart & np.r_[apart[1:], True]
            rows = rows[~alone & (left[order[rows]] >= deep)]
            if not len(rows):
                break
            suffix = order[rows]
            key = (rank[suffix] << 32) | rank[suffix + deep]
            by = np.argsort(key, kind="stable")
            order[rows], key = suffix[by], key[by]
            apart = np.r_[True, key[1:] != key[:-1]]
            rank[order[rows]] = rows[np.flatnonzero(apart)[np.cumsum(apart) - 1]]
            deep *= 2
        return order, np.r_[True, ~_share(words, left, order[1:], order[:-1], depth)]

    def _runs(self, symbols: np.ndarray) -> None:
        heads = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
        lengths = np.diff(np.r_[heads, len(symbols)])
        by = np.argsort(symbols[heads], kind="stable")
        self.run_starts, self.run_targets = heads, np.empty(len(heads), np.int64)
        # the rows of one symbol lead to consecutive rows, those of smaller symbols before them
        self.run_targets[by] = np.cumsum(lengths[by]) - lengths[by]

    def steps(self) -> np.ndarray:
        """For every row the row of the suffix that starts one byte earlier, unrolled from the runs."""
        lengths = np.diff(np.r_[self.run_starts, len(self.interval)])
        return np.repeat((self.run_targets - self.run_starts).astype(np.int32), lengths) + np.arange(
            len(self.interval), dtype=np.int32
        )

    def earlier(self) -> np.ndarray:
        """Per string a 64-bit mask: bit i says that its ``depth`` bytes from i on occur in a string of a smaller owner."""
        masks = np.zeros(self.n, np.uint64)
        back = self.steps()
        rows, alive = np.arange(self.n), np.arange(self.n)  # terminators come first, in the order of the strings
        for step in range(1, int(self.sizes.max(initial=0)) + 1):
            alive = alive[self.sizes[alive] >= step]
            rows[alive] = back[rows[alive]]
            if step < self.depth:
                continue
            hit = alive[self.interval_owner[self.interval[rows[alive]]] < self.owners[alive]]
            masks[hit] |= np.uint64(1) << (self.sizes[hit] - step).astype(np.uint64)
        return masks


def _words(raw: np.ndarray, left: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as a big-endian number, with zeros from the terminator on."""
    out = raw.astype(np.uint64)
    for width in (1, 2, 4):
        ahead = np.r_[out[width:], np.zeros(min(width, len(out)), np.uint64)][: len(out)]
        out = (out << np.uint64(8 * width)) | ahead
    short = np.flatnonzero(left < 8)
    drop = (8 * (8 - np.maximum(left[short], 1))).astype(np.uint64)
    out[short] = np.where(left[short] == 0, 0, (out[short] >> drop) << drop)
    return out


def _share(words: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Whether the suffixes ``a`` and ``b`` have ``depth`` bytes and share them, eight at a time."""
    out = (left[a] >= depth) & (left[b] >= depth)
    some = np.flatnonzero(out)
    for at in range(0, depth, 8):
        rest = np.uint64(8 * max(0, 8 - depth + at))  # bits of the last word beyond ``depth``
        some = some[words[a[some] + at] >> rest == words[b[some] + at] >> rest]
    out[:] = False
    out[some] = True
    return out
